"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text's encoding is a node: its pre-tokens and their ids.  Halves are encoded
recursively and neighbours joined by encoding a boundary window anew:

* Pre-tokens.  The pattern looks only forward, so a match is settled by the text from
  its start to one character past its end, or to ``LOOK_AHEAD`` characters from its
  start if that is more (a contraction).  In the left node all matches that end, or
  could look, past the seam are open; in the right node all matches hold from a start
  that the new scan also reaches.  The window starts at the first open match and takes
  in right matches, twice as many each time, until a settled match ends at such a start.
* Merges inside a long pre-token.  A sequence of tokens is the encoding of its bytes
  if and only if every pair of neighbours is the encoding of its own bytes.  The window
  of tokens around the seam doubles until both its outer pairs are such pairs.

Decoding concatenates the tokens' bytes up the same kind of tree.

Defined results: a null text is the empty text; the empty text has no tokens; a
repeated row is encoded again; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_ENTRIES, Generations, arrow_batches

#: Characters of text, and bytes of a pre-token, that a leaf holds at most.
LEAF_CHARS, LEAF_BYTES = 512, 2048
#: Characters of the pattern's longest literal alternative.
LOOK_AHEAD = 3


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class ByteBpe:
    """An encoder over one rank file and pattern."""

    def __init__(self, path: str, pattern: str, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES):
        ranks = load_ranks(path)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.scan = regex.compile(pattern)
        self.leaf_chars, self.leaf_bytes = leaf_chars, leaf_bytes
        self._plain = tiktoken.Encoding("leaf", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._pieces = Generations(self._encode_piece)
        self._pairs: dict[tuple[int, int], bool] = {}

    # -- merges inside one pre-token ---------------------------------------------------

    def _leaf(self, piece: bytes) -> list[int]:
        return self._plain._encode_single_piece(piece)

    def _settled(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart where they meet."""
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) >= CACHE_ENTRIES:
                self._pairs.clear()
            known = self._pairs[left, right] = self._leaf(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def _join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        width = 1
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            window = left[a:] + right[:b]
            window = self._tokens(b"".join(map(self.bytes_of.__getitem__, window))) if len(window) < len(left) + len(right) else self._leaf(b"".join(map(self.bytes_of.__getitem__, window)))
            if (a == 0 or self._settled(left[a - 1], window[0])) and (b == len(right) or self._settled(window[-1], right[b])):
                return left[:a] + window + right[b:]
            width *= 2

    def _tokens(self, piece: bytes) -> list[int]:
        if len(piece) <= self.leaf_bytes:
            return self._leaf(piece)
        middle = len(piece) // 2
        return self._join_tokens(self._tokens(piece[:middle]), self._tokens(piece[middle:]))

    def _encode_piece(self, piece: str) -> bytes:
        return np.array(self._tokens(piece.encode("utf-8", "replace")), "<u4").tobytes()

    # -- pre-tokens --------------------------------------------------------------------

    def _join(self, left: list[str], right: list[str]) -> list[str]:
        if not left or not right:
            return left or right
        seam = len(left) - 1
        reach = len(left[seam])
        while seam and reach < LOOK_AHEAD - 1:  # the match before could look past the seam
            seam -= 1
            reach += len(left[seam])
        settled, opened = left[:seam], "".join(left[seam:])
        width = 1
        while True:
            taken = right[:width]
            more = width < len(right)
            starts, at = {}, len(opened)
            for skipped, piece in enumerate(taken):
                starts[at] = skipped
                at += len(piece)
            window, out = opened + "".join(taken), []
            for match in self.scan.finditer(window):
                end = match.end()
                if more and (end == len(window) or match.start() + LOOK_AHEAD > len(window)):
                    break  # more text could change this match
                out.append(match.group())
                if end in starts:  # from here on the right node's matches hold
                    return settled + out + right[starts[end] :]
            else:
                if not more:
                    return settled + out
            width *= 2

    def pieces(self, text: str) -> list[str]:
        """The pattern's matches in ``text``, from a balanced tree over its leaves."""
        if len(text) <= self.leaf_chars:
            return self.scan.findall(text)
        middle = len(text) // 2
        return self._join(self.pieces(text[:middle]), self.pieces(text[middle:]))

    # -- whole texts -------------------------------------------------------------------

    def encode_bytes(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers."""
        return b"".join(map(self._pieces.__getitem__, self.pieces(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf_chars:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


_LOADED: dict[tuple, ByteBpe] = {}


def encoder(path: str, pattern: str) -> ByteBpe:
    """One encoder for each worker process."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBpe(path, pattern)
    return _LOADED[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if wanted, ids (array of int) of each row of ``docs``.

    One pass without a shuffle; the work of a task is bounded by its own rows.
    """
    arrow_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in batches:
            counts, ids_of, hashes, decoded = [], [], [], []
            for text in batch.column(1).to_pylist():
                data = bpe.encode_bytes(text or "")
                ids = np.frombuffer(data, "<u4")
                counts.append(len(ids))
                hashes.append(hashlib.sha256(data).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids.tolist())).hexdigest())
                if with_ids:
                    ids_of.append(ids.astype(np.int32))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(ids_of, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
