"""Addresses and identifiers."""

from __future__ import annotations

import ipaddress

from .compare import flag
from .registry import UDFS, define

_PART = "(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
define(
    "inet_aton", 1, 1,
    # The last part stands last; missing ones before it are zero.
    lambda a: f"CASE WHEN ({a}) RLIKE '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{0,3}}$' AND NOT exists(split({a}, '[.]'), q_x -> CAST(q_x AS INT) > 255)"
    f" THEN aggregate(slice(concat(slice(split({a}, '[.]'), 1, size(split({a}, '[.]')) - 1), array_repeat('0', 4 - size(split({a}, '[.]'))), slice(split({a}, '[.]'), -1, 1)), 1, 4), CAST(0 AS BIGINT), (q_s, q_x) -> q_s * 256 + CAST(q_x AS BIGINT)) END",
)
define("inet_ntoa", 1, 1, lambda a: f"CASE WHEN ({a}) BETWEEN 0 AND 4294967295 THEN concat_ws('.', " + ", ".join(f"CAST(shiftright(CAST({a} AS BIGINT), {s}) & 255 AS STRING)" for s in (24, 16, 8, 0)) + ") END")
define("is_ipv4", 1, 1, lambda a: flag(f"coalesce(({a}) RLIKE '^({_PART}[.]){{3}}{_PART}$', false)"))
define("is_ipv4_compat", 1, 1, lambda a: flag(f"coalesce(octet_length({a}) = 16 AND startswith(hex({a}), repeat('0', 24)), false)"))
define("is_ipv4_mapped", 1, 1, lambda a: flag(f"coalesce(octet_length({a}) = 16 AND startswith(hex({a}), concat(repeat('0', 20), 'FFFF')), false)"))
define("uuid", 0, 0, "uuid()")


def _aton6(text: str | None) -> bytes | None:
    try:
        return ipaddress.ip_address(text).packed if text else None
    except ValueError:
        return None


def _ntoa6(data: bytes | None) -> str | None:
    if data is None or len(data) not in (4, 16):
        return None
    address = ipaddress.ip_address(bytes(data))
    mapped = getattr(address, "ipv4_mapped", None)
    return f"::ffff:{mapped}" if mapped else str(address)


def _is_v6(text: str | None) -> int:
    try:
        return int(ipaddress.ip_address(text or "").version == 6)
    except ValueError:
        return 0


UDFS |= {"quill_inet6_aton": (_aton6, "binary"), "quill_inet6_ntoa": (_ntoa6, "string"), "quill_is_ipv6": (_is_v6, "bigint")}
define("inet6_aton", 1, 1, "quill_inet6_aton({0})")
define("inet6_ntoa", 1, 1, "quill_inet6_ntoa({0})")
define("is_ipv6", 1, 1, "quill_is_ipv6({0})")
