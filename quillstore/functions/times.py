"""Dates and times.  TIME values are text ([-]HH:MM:SS[.ffffff]), hours may exceed 23; invalid input is NULL."""

from __future__ import annotations

from .registry import define, same

UNITS = ("MICROSECOND", "SECOND", "MINUTE", "HOUR", "DAY", "WEEK", "MONTH", "QUARTER", "YEAR")
#: Composite unit -> its fields from the largest, and the unit and factors they add up in.
COMPOSITE = {
    "SECOND_MICROSECOND": ("SECOND", "MICROSECOND"),
    "MINUTE_MICROSECOND": ("MINUTE", "SECOND", "MICROSECOND"),
    "MINUTE_SECOND": ("MINUTE", "SECOND"),
    "HOUR_MICROSECOND": ("HOUR", "MINUTE", "SECOND", "MICROSECOND"),
    "HOUR_SECOND": ("HOUR", "MINUTE", "SECOND"),
    "HOUR_MINUTE": ("HOUR", "MINUTE"),
    "DAY_MICROSECOND": ("DAY", "HOUR", "MINUTE", "SECOND", "MICROSECOND"),
    "DAY_SECOND": ("DAY", "HOUR", "MINUTE", "SECOND"),
    "DAY_MINUTE": ("DAY", "HOUR", "MINUTE"),
    "DAY_HOUR": ("DAY", "HOUR"),
    "YEAR_MONTH": ("YEAR", "MONTH"),
}
IN_MICROSECONDS = {"MICROSECOND": 1, "SECOND": 10**6, "MINUTE": 60 * 10**6, "HOUR": 3600 * 10**6, "DAY": 86400 * 10**6}
#: Digits of each field where a composite unit is extracted as one number.
DIGITS = {"MONTH": 100, "HOUR": 100, "MINUTE": 100, "SECOND": 100, "MICROSECOND": 1_000_000}
EPOCH_DAY = 719528


def unit_of(arg: str) -> str:
    return arg.strip().strip("'\"").upper()


def stamp(a: str) -> str:
    return f"CAST({a} AS TIMESTAMP_NTZ)"


def _shift(a: str, n: str, unit: str, sign: int = 1) -> str:
    unit, minus = unit_of(unit), "-" if sign < 0 else ""
    if unit in UNITS:
        return f"timestampadd({unit}, CAST({minus}({n}) AS {'BIGINT' if unit == 'MICROSECOND' else 'INT'}), {stamp(a)})"
    fields = COMPOSITE[unit]
    parts = f"filter(split(CAST({n} AS STRING), '[^0-9]+'), q_x -> q_x <> '')"
    # Missing leading fields are zero: the last number belongs to the smallest unit.
    value = lambda i: f"CAST(coalesce(try_element_at({parts}, {i - len(fields)}), '0') AS BIGINT)"
    whole, base = ("MONTH", {"YEAR": 12, "MONTH": 1}) if unit == "YEAR_MONTH" else ("MICROSECOND", IN_MICROSECONDS)
    total = " + ".join(f"{value(i)} * {base[f]}" for i, f in enumerate(fields))
    signed = f"{minus}(({total}) * IF(startswith(ltrim(CAST({n} AS STRING)), '-'), -1, 1))"
    return f"timestampadd({whole}, CAST({signed} AS {'INT' if whole == 'MONTH' else 'BIGINT'}), {stamp(a)})"


define("adddate date_add", 3, 3, lambda a, n, unit: _shift(a, n, unit))
define("subdate date_sub", 3, 3, lambda a, n, unit: _shift(a, n, unit, -1))
define("timestampadd", 3, 3, lambda unit, n, a: _shift(a, n, unit))
define("timestampdiff", 3, 3, lambda unit, a, b: f"timestampdiff({unit_of(unit)}, {stamp(a)}, {stamp(b)})")


# -- TIME as text -------------------------------------------------------------------------


def micros(a: str) -> str:
    """Microseconds of a TIME text, or of the time of day of a timestamp.

    What reads as a timestamp, or as a time of day, is read by a cast; only other texts
    (hours above 23, signs) go through a pattern.
    """
    text = f"CAST({a} AS STRING)"
    moment = f"try_cast({text} AS TIMESTAMP_NTZ)"
    of_day = f"timestampdiff(MICROSECOND, CAST(CAST({moment} AS DATE) AS TIMESTAMP_NTZ), {moment})"
    return f"CASE WHEN contains({text}, ':') THEN coalesce({of_day}, {_long_micros(a)}) END"


def _long_micros(a: str) -> str:
    text = f"element_at(split(trim(CAST({a} AS STRING)), ' '), -1)"
    bare = f"ltrim('-', {text})"
    field = lambda i: f"CAST(coalesce(nullif(try_element_at(split({bare}, ':'), {i}), ''), '0') AS DECIMAL(20, 6))"
    total = f"{field(1)} * 3600 + {field(2)} * 60 + {field(3)}"
    return f"CASE WHEN {text} RLIKE '^-?[0-9]+(:[0-9]+){{1,2}}([.][0-9]*)?$' THEN CAST(({total}) * 1000000 AS BIGINT) * IF(startswith({text}, '-'), -1, 1) END"


def time_text(us: str) -> str:
    """A TIME text from microseconds, held within 838:59:59."""
    held = f"least(greatest(({us}), -3020399000000L), 3020399000000L)"
    size = f"abs({held})"
    whole = f"lpad(CAST({size} DIV 3600000000 AS STRING), greatest(2, length(CAST({size} DIV 3600000000 AS STRING))), '0')"
    rest = f"lpad(CAST({size} DIV 60000000 % 60 AS STRING), 2, '0'), ':', lpad(CAST({size} DIV 1000000 % 60 AS STRING), 2, '0')"
    part = f"IF({size} % 1000000 = 0, '', concat('.', lpad(CAST({size} % 1000000 AS STRING), 6, '0')))"
    return f"concat(IF({held} < 0, '-', ''), {whole}, ':', {rest}, {part})"


def _add_time(a: str, b: str, sign: int) -> str:
    """A timestamp stays one, as text; a TIME gives a TIME."""
    step = f"({micros(b)}) * {sign}"
    return f"CASE WHEN CAST({a} AS STRING) RLIKE '^[0-9]{{4}}-' THEN CAST(timestampadd(MICROSECOND, {step}, try_cast(CAST({a} AS STRING) AS TIMESTAMP_NTZ)) AS STRING) ELSE {time_text(f'({micros(a)}) + {step}')} END"


define("addtime", 2, 2, lambda a, b: _add_time(a, b, 1))
define("subtime", 2, 2, lambda a, b: _add_time(a, b, -1))
define("time", 1, 1, lambda a: time_text(micros(a)))
define("timeliteral", 1, 1, lambda a: time_text(micros(a)))
define("maketime", 3, 3, lambda h, m, s: f"CASE WHEN ({m}) BETWEEN 0 AND 59 AND ({s}) >= 0 AND ({s}) < 60 THEN {time_text(f'IF(({h}) < 0, -1, 1) * CAST((abs({h}) * 3600 + ({m}) * 60 + CAST({s} AS DECIMAL(20, 6))) * 1000000 AS BIGINT)')} END")
define("sec_to_time", 1, 1, lambda a: time_text(f"CAST(CAST({a} AS DECIMAL(20, 6)) * 1000000 AS BIGINT)"))
define("time_to_sec", 1, 1, lambda a: f"({micros(a)}) DIV 1000000")
define(
    "timediff", 2, 2,
    lambda a, b: f"CASE WHEN CAST({a} AS STRING) RLIKE '^[0-9]{{4}}-' AND CAST({b} AS STRING) RLIKE '^[0-9]{{4}}-' THEN {time_text(f'timestampdiff(MICROSECOND, try_cast(CAST({b} AS STRING) AS TIMESTAMP_NTZ), try_cast(CAST({a} AS STRING) AS TIMESTAMP_NTZ))')}"
    f" WHEN NOT CAST({a} AS STRING) RLIKE '^[0-9]{{4}}-' AND NOT CAST({b} AS STRING) RLIKE '^[0-9]{{4}}-' THEN {time_text(f'({micros(a)}) - ({micros(b)})')} END",
)
define("microsecond", 1, 1, lambda a: f"({micros(a)}) % 1000000")
for _name, _div, _mod in (("hour", 3600, ""), ("minute", 60, " % 60"), ("second", 1, " % 60")):
    define(_name, 1, 1, lambda a, d=_div, m=_mod: f"abs({micros(a)}) DIV {d * 1000000}{m}")

# -- fields -------------------------------------------------------------------------------

define("date", 1, 1, lambda a: f"try_cast(CAST({a} AS STRING) AS DATE)")
define("dateliteral", 1, 1, lambda a: f"CAST({a} AS DATE)")
define("timestampliteral", 1, 2, lambda a, b=None: _add_time(a, b, 1) if b else stamp(a))
define("timestamp", 1, 2, lambda a, b=None: f"CAST({_add_time(f'CAST({stamp(a)} AS STRING)', b, 1)} AS TIMESTAMP_NTZ)" if b else f"try_cast(CAST({a} AS STRING) AS TIMESTAMP_NTZ)")
same("year month day dayofmonth dayofweek dayofyear quarter weekday weekofyear last_day", 1, 1)
define("dayname", 1, 1, "date_format({0}, 'EEEE')")
define("monthname", 1, 1, "date_format({0}, 'MMMM')")
define("datediff", 2, 2, "datediff({0}, {1})")
define("from_days", 1, 1, f"date_add(DATE'1970-01-01', CAST({{0}} AS INT) - {EPOCH_DAY})")
define("to_days", 1, 1, f"CAST(datediff({{0}}, DATE'1970-01-01') + {EPOCH_DAY} AS BIGINT)")
define("to_seconds", 1, 1, lambda a: f"(CAST(datediff({a}, DATE'1970-01-01') + {EPOCH_DAY} AS BIGINT) * 86400) + hour({stamp(a)}) * 3600 + minute({stamp(a)}) * 60 + CAST(second({stamp(a)}) AS INT)")
define(
    "makedate", 2, 2,
    lambda a, b: f"CASE WHEN ({b}) > 0 AND ({a}) BETWEEN 0 AND 9999 THEN date_add(make_date(CAST(CASE WHEN ({a}) < 70 THEN ({a}) + 2000 WHEN ({a}) < 100 THEN ({a}) + 1900 ELSE ({a}) END AS INT), 1, 1), CAST({b} AS INT) - 1) END",
)


def _months(period: str) -> str:
    year = f"(({period}) DIV 100)"
    return f"((CASE WHEN {year} < 70 THEN {year} + 2000 WHEN {year} < 100 THEN {year} + 1900 ELSE {year} END) * 12 + ({period}) % 100 - 1)"


define("period_add", 2, 2, lambda a, b: f"({_months(a)} + ({b})) DIV 12 * 100 + ({_months(a)} + ({b})) % 12 + 1")
define("period_diff", 2, 2, lambda a, b: f"{_months(a)} - {_months(b)}")


def _extract(unit: str, a: str) -> str:
    unit = unit_of(unit)
    one = {
        "MICROSECOND": f"({micros(a)}) % 1000000", "SECOND": f"abs({micros(a)}) DIV 1000000 % 60", "MINUTE": f"abs({micros(a)}) DIV 60000000 % 60", "HOUR": f"abs({micros(a)}) DIV 3600000000",
        "DAY": f"day({a})", "WEEK": week(a, 0)[0], "MONTH": f"month({a})", "QUARTER": f"quarter({a})", "YEAR": f"year({a})",
    }
    if unit in one:
        return one[unit]
    fields = COMPOSITE[unit]
    out = one[fields[0]]
    for field in fields[1:]:
        out = f"(({out}) * {DIGITS[field]} + ({one[field]}))"
    return out


define("extract", 2, 2, _extract)


def week(a: str, mode: int) -> tuple[str, str]:
    """(week, year of the week) of a date in one of the eight modes.

    Odd modes begin weeks on Monday.  In modes 1, 3, 4 and 6 a week belongs to the year
    that has four or more of its days, so to the year of its fourth day; in the others
    to the year of its first day.  Modes 2, 3, 6 and 7 number it in that year; the rest
    in the date's own year, from 0.
    """
    date = f"CAST({a} AS DATE)"
    since = f"weekday({date})" if mode & 1 else f"(dayofweek({date}) - 1)"
    anchor = 3 if mode in (1, 3, 4, 6) else 0
    key = f"date_add({date}, {anchor} - {since})"
    number = f"((dayofyear({key}) - 1) DIV 7 + 1)"
    if mode in (2, 3, 6, 7):
        return number, f"year({key})"
    before = f"date_add({date}, {anchor} - 7 - {since})"
    own = f"CASE WHEN year({key}) < year({date}) THEN 0 WHEN year({key}) > year({date}) THEN (dayofyear({before}) - 1) DIV 7 + 2 ELSE {number} END"
    return own, f"year({key})"


def _mode(mode: str) -> int:
    return int(mode.strip("() ")) & 7


define("week", 1, 2, lambda a, mode="0": week(a, _mode(mode))[0])
define("yearweek", 1, 2, lambda a, mode="0": "{1} * 100 + {0}".format(*week(a, _mode(mode) | 2)))

# -- formats ------------------------------------------------------------------------------

#: Format specifiers and the patterns that stand for them.
PATTERNS = {
    "Y": "yyyy", "y": "yy", "m": "MM", "c": "M", "d": "dd", "e": "d", "H": "HH", "k": "H", "h": "hh", "I": "hh", "l": "h", "i": "mm", "s": "ss", "S": "ss",
    "f": "SSSSSS", "p": "a", "M": "MMMM", "b": "MMM", "W": "EEEE", "a": "EEE", "j": "DDD", "T": "HH:mm:ss", "r": "hh:mm:ss a",
}
WEEKS = {"U": (0, 0), "u": (1, 0), "V": (2, 0), "v": (3, 0), "X": (2, 1), "x": (3, 1)}


def _specifiers(text: str) -> list[tuple[str | None, str]]:
    """(specifier, or None for plain text, and the text) of a quoted format."""
    body, out, i = text.strip()[1:-1].replace("\\'", "'").replace("''", "'"), [], 0
    while i < len(body):
        if body[i] == "%" and i + 1 < len(body):
            out.append((body[i + 1], body[i + 1]))
            i += 2
        else:
            out.append((None, body[i]))
            i += 1
    return out


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _is_constant(text: str) -> bool:
    return len(text.strip()) > 1 and text.strip()[0] in "'\"" and text.strip()[-1] == text.strip()[0]


def _date_format(a: str, fmt: str) -> str:
    if not _is_constant(fmt):
        raise ValueError("the format is a constant")
    parts = []
    for kind, text in _specifiers(fmt):
        if kind in PATTERNS:
            parts.append(f"date_format({a}, {_quoted(PATTERNS[kind])})")
        elif kind in WEEKS:
            mode, which = WEEKS[kind]
            parts.append(f"lpad(CAST({week(a, mode)[which]} AS STRING), {4 if which else 2}, '0')")
        elif kind == "w":
            parts.append(f"CAST(dayofweek({a}) - 1 AS STRING)")
        elif kind == "D":
            parts.append(f"concat(CAST(day({a}) AS STRING), CASE WHEN day({a}) IN (11, 12, 13) THEN 'th' WHEN day({a}) % 10 = 1 THEN 'st' WHEN day({a}) % 10 = 2 THEN 'nd' WHEN day({a}) % 10 = 3 THEN 'rd' ELSE 'th' END)")
        else:
            parts.append(_quoted(text))
    return f"concat({', '.join(parts)})" if parts else "''"


#: Numbers that may be written with one digit when read.
LOOSE = {"m": "M", "d": "d", "H": "H", "k": "H", "h": "h", "I": "h", "i": "m", "s": "s", "S": "s"}


def java_pattern(fmt: str) -> str:
    """The pattern that reads ``fmt``; fields next to each other have their full width."""
    parts = _specifiers(fmt)
    width = PATTERNS if any(x and y for (x, _), (y, _) in zip(parts, parts[1:])) else PATTERNS | LOOSE
    return "".join(width.get(kind, "") if kind else ("''" if text == "'" else f"'{text}'" if text.isalpha() else text) for kind, text in parts)


def _str_to_date(a: str, fmt: str) -> str:
    if not _is_constant(fmt):
        raise ValueError("the format is a constant")
    kinds = {kind for kind, _ in _specifiers(fmt) if kind}
    parsed = f"CAST(try_to_timestamp({a}, {_quoted(java_pattern(fmt))}) AS TIMESTAMP_NTZ)"
    clock = kinds & set("HkhIlisSfpTr")
    if not kinds & set("YymcdeMbj"):
        return f"date_format({parsed}, 'HH:mm:ss')"
    return parsed if clock else f"CAST({parsed} AS DATE)"


define("date_format", 2, 2, _date_format)
define("time_format", 2, 2, lambda a, fmt: _time_format(a, fmt))
define("str_to_date", 2, 2, _str_to_date)
define("from_unixtime", 1, 2, lambda a, fmt=None: _date_format(f"timestamp_seconds({a})", fmt) if fmt else f"timestamp_seconds({a})")
define("unix_timestamp", 0, 1, lambda a=None: f"greatest(CAST(0 AS BIGINT), unix_timestamp(CAST({a} AS TIMESTAMP)))" if a else "unix_timestamp()")


def _time_format(a: str, fmt: str) -> str:
    hours = f"abs({micros(a)}) DIV 3600000000"
    pad = lambda x, n: f"lpad(CAST({x} AS STRING), greatest({n}, length(CAST({x} AS STRING))), '0')"
    half = f"(({hours}) + 11) % 12 + 1"
    fields = {
        "H": pad(hours, 2), "k": f"CAST({hours} AS STRING)", "h": pad(half, 2), "I": pad(half, 2), "l": f"CAST({half} AS STRING)", "i": pad(f"abs({micros(a)}) DIV 60000000 % 60", 2),
        "s": pad(f"abs({micros(a)}) DIV 1000000 % 60", 2), "S": pad(f"abs({micros(a)}) DIV 1000000 % 60", 2), "f": pad(f"abs({micros(a)}) % 1000000", 6), "p": f"IF(({hours}) % 24 >= 12, 'PM', 'AM')",
    }
    fields["T"] = f"concat({fields['H']}, ':', {fields['i']}, ':', {fields['s']})"
    return "concat(" + ", ".join(fields.get(kind, _quoted(text)) if kind else _quoted(text) for kind, text in _specifiers(fmt)) + ")"


#: Formats by kind and region.
FORMATS = {
    "DATE": {"USA": "%m.%d.%Y", "JIS": "%Y-%m-%d", "ISO": "%Y-%m-%d", "EUR": "%d.%m.%Y", "INTERNAL": "%Y%m%d"},
    "DATETIME": {"USA": "%Y-%m-%d %H.%i.%s", "JIS": "%Y-%m-%d %H:%i:%s", "ISO": "%Y-%m-%d %H:%i:%s", "EUR": "%Y-%m-%d %H.%i.%s", "INTERNAL": "%Y%m%d%H%i%s"},
    "TIME": {"USA": "%h:%i:%s %p", "JIS": "%H:%i:%s", "ISO": "%H:%i:%s", "EUR": "%H.%i.%s", "INTERNAL": "%H%i%s"},
}
FORMATS["TIMESTAMP"] = FORMATS["DATETIME"]
define("get_format", 2, 2, lambda kind, region: "CASE " + " ".join(f"WHEN upper({region}) = '{r}' THEN '{f}'" for r, f in FORMATS[unit_of(kind)].items()) + " END")

# -- now ----------------------------------------------------------------------------------

define("curdate current_date", 0, 0, "current_date()")
define("curtime current_time", 0, 1, "date_format(current_timestamp(), 'HH:mm:ss')")
define("current_timestamp now localtime localtimestamp sysdate", 0, 1, "current_timestamp()")
_UTC = "to_utc_timestamp(current_timestamp(), current_timezone())"
define("utc_date", 0, 0, f"to_date({_UTC})")
define("utc_time", 0, 1, f"date_format({_UTC}, 'HH:mm:ss')")
define("utc_timestamp", 0, 1, _UTC)
_ZONE = "^([+-](0[0-9]|1[0-4]):[0-5][0-9]|[A-Za-z_]+(/[A-Za-z_+0-9-]+)*)$"
define("convert_tz", 3, 3, lambda a, b, c: f"CASE WHEN startswith(translate({b}, '-', '+'), '+') = startswith(translate({c}, '-', '+'), '+') AND {b} RLIKE '{_ZONE}' AND {c} RLIKE '{_ZONE}' THEN convert_timezone({b}, {c}, {stamp(a)}) END")
define("tidb_parse_tso", 1, 1, "CASE WHEN ({0}) > 0 THEN timestamp_millis(shiftright({0}, 18)) END")
