"""Arithmetic, bits and mathematics; what the domain excludes is NULL."""

from .registry import define, same

same("abs atan2 ceil ceiling cos cot degrees exp floor ln log2 log10 pi pow power radians sin tan", 0, 2)
define("atan", 1, 2, lambda a, b=None: f"atan2({a}, {b})" if b else f"atan({a})")
for _name in ("acos", "asin"):
    define(_name, 1, 1, lambda a, n=_name: f"CASE WHEN abs({a}) <= 1 THEN {n}({a}) END")
define("log", 1, 2, lambda a, b=None: f"CASE WHEN ({a}) > 0 AND ({a}) <> 1 AND ({b}) > 0 THEN ln({b}) / ln({a}) END" if b else f"ln({a})")
define("conv", 3, 3, "conv(CAST({0} AS STRING), {1}, {2})")
define("crc32", 1, 1, "crc32(encode(CAST({0} AS STRING), 'UTF-8'))")
define("rand", 0, 1, "rand({*})")
define("round", 1, 2, "round({*})")
define("sign", 1, 1, "CAST(sign({0}) AS BIGINT)")
define("sqrt", 1, 1, "CASE WHEN ({0}) >= 0 THEN sqrt({0}) END")
define("truncate", 2, 2, "CASE WHEN ({0}) >= 0 THEN floor(({0}) * pow(10, {1})) / pow(10, {1}) ELSE ceil(({0}) * pow(10, {1})) / pow(10, {1}) END")

define("plus", 2, 2, "({0}) + ({1})")
define("minus", 2, 2, "({0}) - ({1})")
define("mul", 2, 2, "({0}) * ({1})")
define("div", 2, 2, "try_divide({0}, {1})")
define("intdiv", 2, 2, "CASE WHEN ({1}) <> 0 THEN CAST(({0}) / ({1}) AS BIGINT) END")
define("mod", 2, 2, "try_mod({0}, {1})")
define("unaryminus", 1, 1, "-({0})")
define("bitand", 2, 2, "CAST({0} AS BIGINT) & CAST({1} AS BIGINT)")
define("bitor", 2, 2, "CAST({0} AS BIGINT) | CAST({1} AS BIGINT)")
define("bitxor", 2, 2, "CAST({0} AS BIGINT) ^ CAST({1} AS BIGINT)")
#: Unsigned 64-bit results are shown as such.
define("bitneg", 1, 1, "CAST(conv(hex(~CAST({0} AS BIGINT)), 16, 10) AS DECIMAL(20, 0))")
define("leftshift", 2, 2, "CASE WHEN ({1}) BETWEEN 0 AND 63 THEN shiftleft(CAST({0} AS BIGINT), CAST({1} AS INT)) ELSE IF(({0}) IS NULL OR ({1}) IS NULL, NULL, 0) END")
define("rightshift", 2, 2, "CASE WHEN ({1}) BETWEEN 0 AND 63 THEN shiftrightunsigned(CAST({0} AS BIGINT), CAST({1} AS INT)) ELSE IF(({0}) IS NULL OR ({1}) IS NULL, NULL, 0) END")
define("bit_count", 1, 1, "CAST(bit_count(CAST({0} AS BIGINT)) AS BIGINT)")
