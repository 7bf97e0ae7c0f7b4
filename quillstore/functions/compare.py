"""Comparison, control and logic; booleans are 0 and 1, NULL stays NULL."""

from .registry import define, same


def any_null(*args: str) -> str:
    return " OR ".join(f"({a}) IS NULL" for a in args)


def flag(condition: str) -> str:
    return f"CAST(({condition}) AS BIGINT)"


def truth(arg: str) -> str:
    """The truth of a number, a boolean or the number at a string's start."""
    return f"(CAST(({arg}) AS DOUBLE) <> 0)"


same("coalesce ifnull", 1, None)
define("isnull", 1, 1, lambda a: flag(f"({a}) IS NULL"))
define("greatest", 2, None, lambda *a: f"CASE WHEN {any_null(*a)} THEN NULL ELSE greatest({', '.join(a)}) END")
define("least", 2, None, lambda *a: f"CASE WHEN {any_null(*a)} THEN NULL ELSE least({', '.join(a)}) END")
define("interval", 2, None, lambda a, *b: f"CAST(CASE WHEN ({a}) IS NULL THEN -1 ELSE size(filter(array({', '.join(b)}), q_x -> q_x <= ({a}))) END AS BIGINT)")
define("if", 3, 3, lambda a, b, c: f"if({truth(a)}, {b}, {c})")
define("nullif", 2, 2, "nullif({0}, {1})")
define("case", 1, None, lambda *a: "CASE " + " ".join(f"WHEN {truth(a[i])} THEN {a[i + 1]}" for i in range(0, len(a) - 1, 2)) + (f" ELSE {a[-1]}" if len(a) % 2 else "") + " END")
define("and", 2, 2, lambda a, b: flag(f"{truth(a)} AND {truth(b)}"))
define("or", 2, 2, lambda a, b: flag(f"{truth(a)} OR {truth(b)}"))
define("xor", 2, 2, lambda a, b: flag(f"{truth(a)} <> {truth(b)}"))
define("not", 1, 1, lambda a: flag(f"NOT {truth(a)}"))
define("istrue", 1, 1, lambda a: flag(f"coalesce({truth(a)}, false)"))
define("isfalse", 1, 1, lambda a: flag(f"coalesce(NOT {truth(a)}, false)"))
for _name, _sign in (("ge", ">="), ("le", "<="), ("eq", "="), ("ne", "<>"), ("lt", "<"), ("gt", ">"), ("nulleq", "<=>")):
    define(_name, 2, 2, lambda a, b, s=_sign: flag(f"({a}) {s} ({b})"))
define("in", 2, None, lambda a, *b: flag(f"({a}) IN ({', '.join(b)})"))
define("like", 2, 3, lambda a, b, c="'\\\\'": flag(f"({a}) LIKE ({b}) ESCAPE {c}"))
define("regexp", 2, 2, lambda a, b: flag(f"({a}) RLIKE ({b})"))
define("any_value", 1, 1, "{0}")
define("row", 2, None, "struct({*})")
define("name_const", 2, 2, "{1}")
