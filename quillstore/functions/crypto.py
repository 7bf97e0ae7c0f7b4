"""Digests, ciphers and compression."""

from __future__ import annotations

import os
import zlib

from .registry import RANDOM, UDFS, define, same

same("md5 sha1 sha", 1, 1)
define("sha2", 2, 2, "CASE WHEN ({1}) IN (0, 224, 256, 384, 512) THEN sha2({0}, CAST({1} AS INT)) END")
define("password", 1, 1, "CASE WHEN ({0}) IS NULL OR ({0}) = '' THEN '' ELSE concat('*', upper(sha1(unhex(sha1({0}))))) END")


def _fold_key(key: bytes | None) -> bytes | None:
    """A key of any length folded to 16 bytes by exclusive or."""
    if key is None:
        return None
    out = bytearray(16)
    for i, byte in enumerate(key):
        out[i % 16] ^= byte
    return bytes(out)


def _compress(data: bytes | None) -> bytes | None:
    if not data:
        return data
    packed = zlib.compress(data)
    return len(data).to_bytes(4, "little") + packed + (b"." if packed.endswith(b" ") else b"")


def _uncompress(data: bytes | None) -> bytes | None:
    if not data:
        return data
    try:
        return zlib.decompressobj().decompress(data[4:]) if len(data) > 4 else None
    except zlib.error:
        return None


def _stream(data: bytes | None, password: str | None) -> bytes | None:
    """A keyed byte stream over the data; the legacy cipher's own stream is not public, so texts it made can't be read."""
    import hashlib

    if data is None or password is None:
        return None
    out, block = bytearray(), b""
    for i, byte in enumerate(data):
        if i % 32 == 0:
            block = hashlib.sha256(password.encode() + (i // 32).to_bytes(8, "little")).digest()
        out.append(byte ^ block[i % 32])
    return bytes(out)


def _random_bytes(n: int | None) -> bytes | None:
    return None if n is None or not 1 <= n <= 1024 else os.urandom(n)


UDFS |= {
    "quill_fold_key": (_fold_key, "binary"),
    "quill_compress": (_compress, "binary"),
    "quill_uncompress": (_uncompress, "binary"),
    "quill_stream": (_stream, "binary"),
    "quill_random_bytes": (_random_bytes, "binary"),
}
define("aes_encrypt", 2, 3, lambda a, b, c=None: f"aes_encrypt(CAST({a} AS BINARY), quill_fold_key(CAST({b} AS BINARY)), 'ECB', 'PKCS')")
define("aes_decrypt", 2, 3, lambda a, b, c=None: f"try_aes_decrypt(CAST({a} AS BINARY), quill_fold_key(CAST({b} AS BINARY)), 'ECB', 'PKCS')")
define("compress", 1, 1, "quill_compress(CAST({0} AS BINARY))")
define("uncompress", 1, 1, "quill_uncompress(CAST({0} AS BINARY))")
define(
    "uncompressed_length", 1, 1,
    lambda a: f"CASE WHEN ({a}) IS NULL THEN NULL WHEN octet_length({a}) <= 4 THEN 0 ELSE CAST(conv(concat(" + ", ".join(f"substring(hex(CAST({a} AS BINARY)), {p}, 2)" for p in (7, 5, 3, 1)) + "), 16, 10) AS BIGINT) END",
)
define("encode", 2, 2, "quill_stream(CAST({0} AS BINARY), {1})")
define("decode", 2, 2, "quill_stream(CAST({0} AS BINARY), {1})")
RANDOM.add("quill_random_bytes")
define("random_bytes", 1, 1, "quill_random_bytes(CAST({0} AS BIGINT))")
