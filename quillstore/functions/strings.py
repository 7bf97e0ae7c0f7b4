"""Strings: lengths in bytes or characters as named, positions from 1, NULL in gives NULL unless said."""

from .registry import define, same

define("ascii", 1, 1, "CASE WHEN octet_length({0}) = 0 THEN 0 ELSE CAST(conv(hex(substring(encode({0}, 'UTF-8'), 1, 1)), 16, 10) AS BIGINT) END")
define("bin", 1, 1, "bin(CAST({0} AS BIGINT))")
define("concat", 1, None, "concat({*})")
define("concat_ws", 2, None, "concat_ws({*})")
define("convert", 2, 2, "decode(encode({0}, 'UTF-8'), 'UTF-8')")
define("elt", 2, None, lambda n, *v: f"CASE WHEN ({n}) >= 1 THEN try_element_at(array({', '.join(v)}), CAST({n} AS INT)) END")


def _export_set(bits: str, on: str, off: str, separator: str = "','", count: str = "64") -> str:
    places = f"sequence(0, least(64, CASE WHEN ({count}) < 0 THEN 64 ELSE ({count}) END) - 1)"
    return f"CASE WHEN ({count}) = 0 THEN '' ELSE array_join(transform({places}, q_i -> CASE WHEN getbit(CAST({bits} AS BIGINT), CAST(q_i AS INT)) = 1 THEN {on} ELSE {off} END), {separator}) END"


define("export_set", 3, 5, _export_set)
define("field", 2, None, lambda a, *b: f"coalesce(array_position(array({', '.join(b)}), {a}), CAST(0 AS BIGINT))")
define("format", 2, 3, lambda a, b, locale="": f"format_number({a}, CAST(least(greatest({b}, 0), 30) AS INT))")
define("from_base64", 1, 1, "try_to_binary(regexp_replace({0}, '[ \\\\t\\\\n\\\\r]', ''), 'base64')")
define(
    "insert", 4, 4,
    "CASE WHEN ({1}) < 1 OR ({1}) > char_length({0}) THEN IF(({2}) IS NULL OR ({3}) IS NULL, NULL, {0})"
    " WHEN ({2}) < 0 OR ({1}) + ({2}) > char_length({0}) THEN concat(left({0}, ({1}) - 1), {3})"
    " ELSE concat(left({0}, ({1}) - 1), {3}, substring({0}, CAST(({1}) + ({2}) AS INT))) END",
)
define("instr", 2, 2, "instr({0}, {1})")
same("lcase lower upper ucase ltrim rtrim reverse space", 1, 1)
define("left", 2, 2, "left({0}, {1})")
define("right", 2, 2, "right({0}, {1})")
define("length octet_length", 1, 1, "CAST(octet_length({0}) AS BIGINT)")
define("bit_length", 1, 1, "CAST(bit_length({0}) AS BIGINT)")
define("char_length character_length", 1, 1, "CAST(char_length({0}) AS BIGINT)")
define("locate position", 2, 3, lambda a, b, c="1": f"CASE WHEN ({c}) < 1 OR ({c}) > char_length({b}) + 1 THEN 0 WHEN ({a}) = '' THEN {c} ELSE locate({a}, {b}, CAST({c} AS INT)) END")
for _name in ("lpad", "rpad"):
    define(_name, 3, 3, lambda a, b, c, n=_name: f"CASE WHEN ({b}) < 0 OR (char_length({a}) < ({b}) AND ({c}) = '') THEN NULL ELSE {n}({a}, CAST({b} AS INT), {c}) END")


def _substring(a: str, b: str, c: str | None = None) -> str:
    text = f"substring({a}, CAST({b} AS INT)" + (f", CAST({c} AS INT))" if c else ")")
    short = f" OR ({c}) < 1" if c else ""
    return f"CASE WHEN ({b}) = 0 OR (({b}) < 0 AND -({b}) > char_length({a})){short} THEN IF(({a}) IS NULL, NULL, '') ELSE {text} END"


define("substring substr mid", 2, 3, _substring)
define("make_set", 2, None, lambda a, *v: f"CASE WHEN ({a}) IS NOT NULL THEN array_join(filter(transform(array({', '.join(v)}), (q_x, q_i) -> CASE WHEN getbit(CAST({a} AS BIGINT), q_i) = 1 THEN q_x END), q_x -> q_x IS NOT NULL), ',') END")
define("oct", 1, 1, "conv(CAST({0} AS STRING), 10, 8)")
define("ord", 1, 1, "CASE WHEN octet_length({0}) = 0 THEN 0 ELSE CAST(conv(hex(encode(left({0}, 1), 'UTF-8')), 16, 10) AS BIGINT) END")
define("quote", 1, 1, lambda a: f"coalesce(concat('\\'', replace(replace(replace({a}, '\\\\', '\\\\\\\\'), '\\'', '\\\\\\''), chr(0), '\\\\0'), '\\''), 'NULL')")
define("repeat", 2, 2, "repeat({0}, CAST({1} AS INT))")
define("replace", 3, 3, "replace({0}, {1}, {2})")
define("strcmp", 2, 2, "CASE WHEN ({0}) < ({1}) THEN -1 WHEN ({0}) > ({1}) THEN 1 WHEN ({0}) = ({1}) THEN 0 END")
define("substring_index", 3, 3, "substring_index({0}, {1}, CAST({2} AS INT))")
define("to_base64", 1, 1, lambda a: f"regexp_replace(regexp_replace(base64(CAST({a} AS BINARY)), '[\\\\r\\\\n]', ''), '(.{{76}})(?=.)', '$1\\n')")


def _trim(text: str, what: str | None = None, side: str = "BOTH") -> str:
    """``what`` is removed as a whole string, again and again."""
    side = side.strip("'").upper()
    if what is None:
        return f"trim({side} FROM {text})"
    quoted = f"concat('(?:\\\\Q', replace({what}, '\\\\E', '\\\\E\\\\\\\\E\\\\Q'), '\\\\E)+')"
    start, end = f"regexp_replace({text}, concat('^', {quoted}), '')", "regexp_replace({0}, concat({1}, '$'), '')"
    if side == "LEADING":
        out = start
    elif side == "TRAILING":
        out = end.format(text, quoted)
    else:
        out = end.format(start, quoted)
    return f"CASE WHEN ({what}) = '' THEN {text} ELSE {out} END"


define("trim", 1, 3, _trim)
define("hex", 1, 1, "hex({0})")
define("unhex", 1, 1, "CASE WHEN ({0}) RLIKE '^[0-9A-Fa-f]*$' THEN unhex({0}) END")
define(
    "char", 1, None,
    lambda *codes: "decode(unhex(concat(" + ", ".join(f"coalesce(regexp_replace(lpad(hex(CAST({c} AS INT)), CASE WHEN ({c}) > 16777215 OR ({c}) < 0 THEN 8 WHEN ({c}) > 65535 THEN 6 WHEN ({c}) > 255 THEN 4 ELSE 2 END, '0'), '^F{{8}}(?=.{{8}}$)', ''), '')" for c in codes) + ")), 'UTF-8')",
)
define("find_in_set", 2, 2, "CASE WHEN ({0}) IS NULL OR ({1}) IS NULL THEN NULL WHEN ({1}) = '' THEN 0 ELSE coalesce(array_position(split({1}, ','), {0}), 0) END")
define("weight_string", 1, 3, "hex(encode({0}, 'UTF-8'))")
