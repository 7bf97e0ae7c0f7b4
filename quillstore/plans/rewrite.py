"""MySQL text to Spark SQL text.

Clauses pass through as they are; expressions are parsed by precedence and written
again with each operator and call rendered by the function library.  What Spark SQL
shares with MySQL (joins, grouping, windows, set operations, subqueries) needs no
rewriting, so the whole of it is usable.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from ..functions import REGISTRY, info, render

_TOKEN = re.compile(
    r"(?P<space>\s+|--[ \t][^\n]*|\#[^\n]*|/\*.*?\*/)"
    r"|(?P<string>'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\")"
    r"|(?P<quoted>`(?:[^`]|``)*`)"
    r"|(?P<number>0[xX][0-9A-Fa-f]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
    r"|(?P<variable>@@?(?:(?:global|session|local)\.)?[A-Za-z_]\w*)"
    r"|(?P<word>[^\W\d]\w*)"
    r"|(?P<sign><=>|:=|<<|>>|<>|!=|<=|>=|\|\||&&|->>|->|[-+*/%&|^~!=<>().,;?:])",
    re.DOTALL,
)
#: Words that end an expression or stand between expressions.
CLAUSES = frozenset(
    "SELECT DISTINCT ALL FROM WHERE GROUP BY HAVING ORDER LIMIT OFFSET UNION INTERSECT EXCEPT MINUS JOIN INNER LEFT RIGHT FULL OUTER CROSS NATURAL SEMI ANTI ON USING AS ASC DESC NULLS"
    " FIRST LAST WITH WINDOW OVER PARTITION ROWS RANGE PRECEDING FOLLOWING UNBOUNDED CURRENT WHEN THEN ELSE END VALUES SET ROLLUP CUBE GROUPING SETS LATERAL WITHIN SEPARATOR".split()
)
RESERVED_OPERATORS = frozenset("AND OR XOR NOT IN LIKE BETWEEN IS REGEXP RLIKE DIV MOD COLLATE".split())
AGGREGATES = frozenset(
    "count sum avg min max var_pop stddev_pop std stddev bit_and bit_or bit_xor group_concat json_objectagg approx_count_distinct row_number rank dense_rank cume_dist"
    " percent_rank ntile lead lag first_value last_value nth_value grouping first_row any_value".split()
)
#: Binary operators by binding strength.
STRENGTH = {
    "OR": 1, "||": 1, "XOR": 2, "AND": 3, "&&": 3, "=": 5, "<=>": 5, "<>": 5, "!=": 5, "<": 5, ">": 5, "<=": 5, ">=": 5, "LIKE": 5, "REGEXP": 5, "RLIKE": 5, "IN": 5, "BETWEEN": 5, "IS": 5, "NOT": 5,
    "|": 6, "&": 7, "<<": 8, ">>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10, "DIV": 10, "MOD": 10, "^": 11, "->": 13, "->>": 13, "COLLATE": 13,
}
CALLS = {"/": "div", "%": "mod", "DIV": "intdiv", "MOD": "mod", "<<": "leftshift", ">>": "rightshift", "^": "bitxor", "&": "bitand", "|": "bitor"}
CAST_TYPES = {"SIGNED": "BIGINT", "UNSIGNED": "BIGINT", "CHAR": "STRING", "BINARY": "BINARY", "DATE": "DATE", "DATETIME": "TIMESTAMP_NTZ", "TIME": "STRING", "JSON": "STRING", "REAL": "DOUBLE", "DOUBLE": "DOUBLE", "FLOAT": "FLOAT", "YEAR": "INT"}
COLLATIONS = {"utf8mb4_bin": "UTF8_BINARY", "utf8_bin": "UTF8_BINARY", "binary": "UTF8_BINARY", "utf8mb4_general_ci": "UTF8_LCASE", "utf8_general_ci": "UTF8_LCASE", "utf8mb4_unicode_ci": "UNICODE_CI", "utf8_unicode_ci": "UNICODE_CI"}


class SqlError(ValueError):
    pass


def tokens_of(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        match = _TOKEN.match(text, at)
        if not match:
            raise SqlError(f"unexpected text: {text[at : at + 20]!r}")
        at = match.end()
        if match.lastgroup != "space":
            out.append((match.lastgroup, match.group()))
    return out


def string_value(token: str) -> str:
    quote, body = token[0], token[1:-1]
    body = body.replace(quote * 2, quote)
    escapes = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "Z": "\x1a"}
    return re.sub(r"\\(.)", lambda m: "\\" + m[1] if m[1] in "%_" else escapes.get(m[1], m[1]), body, flags=re.DOTALL)


def sql_string(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\0", "\\u0000") + "'"


class Rewriter:
    """One pass over the tokens of a text."""

    def __init__(self, text: str):
        self.tokens = tokens_of(text)
        self.at = 0
        #: What a column name becomes, and VALUES(name); a session sets them where rows have two sides.
        self.column: Callable[[str], str] = str
        self.new_value: Callable[[str], str] | None = None
        self.rows: dict[str, list[str]] = {}  # row constructors met, and their parts

    # -- token access ------------------------------------------------------------------

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")

    def word(self, ahead: int = 0) -> str:
        kind, text = self.peek(ahead)
        return text.upper() if kind == "word" else text if kind == "sign" else ""

    def take(self) -> tuple[str, str]:
        token = self.peek()
        self.at += 1
        return token

    def accept(self, *words: str) -> bool:
        if all(self.word(i) == w for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def expect(self, word: str) -> None:
        if not self.accept(word):
            raise SqlError(f"expected {word}, found {self.peek()[1]!r}")

    # -- statements --------------------------------------------------------------------

    def statement(self, until: str = "") -> str:
        """A query, up to ``until`` at this depth."""
        out: list[str] = []
        clause = ""
        while self.peek()[0] != "end" and not (until and self.word() == until):
            word = self.word()
            if word == ";":
                self.take()
            elif word == "LIMIT":
                self.take()
                first = self.expression()
                if self.accept(","):
                    out.append(f"LIMIT {self.expression()} OFFSET {first}")
                else:
                    out.append(f"LIMIT {first}")
            elif word in ("ROLLUP", "CUBE", "SETS") and self.word(1) == "(":
                self.take()
                out.append(f"{word} {self.grouping()}")
            elif word in ("LEFT", "RIGHT") and self.word(1) == "(":
                out.append(self.expression())
            elif clause == "FROM" and self.peek()[0] in ("word", "quoted") and word not in CLAUSES:
                out.append(self.table())
            elif clause == "FROM" and word == "(":
                self.take()
                out.append("(" + self.statement(")") + ")")
                self.expect(")")
            elif clause == "WITH" and self.peek()[0] in ("word", "quoted") and word not in CLAUSES:
                out.append(self.name())
            elif word in CLAUSES or word == ",":
                self.take()
                if word in ("FROM", "WHERE", "SELECT", "HAVING", "WITH") or word == "BY":
                    clause = word
                elif word in ("ON",):
                    clause = "WHERE"
                elif word in ("JOIN",):
                    clause = "FROM"
                elif word == "USING":
                    out.append("USING " + self.parenthesised_names())
                    continue
                elif word == "AS" and clause == "WITH":
                    self.expect("(")
                    out.append("AS (" + self.statement(")") + ")")
                    self.expect(")")
                    continue
                elif word == "AS":
                    out.append("AS " + self.name())
                    continue
                out.append(word)
            elif word == "(" and clause in ("", "UNION"):
                self.take()
                out.append("(" + self.statement(")") + ")")
                self.expect(")")
            else:
                out.append(self.expression())
                if clause == "SELECT" and self.peek()[0] in ("word", "quoted", "string") and self.word() not in CLAUSES and self.word() != until:
                    out.append("AS " + self.name())
        return " ".join(out)

    def grouping(self) -> str:
        """A parenthesised list of expressions or of such lists."""
        self.expect("(")
        parts = []
        while self.word() != ")":
            parts.append(self.grouping() if self.word() == "(" else self.expression())
            if not self.accept(","):
                break
        self.expect(")")
        return "(" + ", ".join(parts) + ")"

    def name(self) -> str:
        kind, text = self.take()
        if kind == "string":
            return "`" + string_value(text).replace("`", "``") + "`"
        return text

    def table(self) -> str:
        text = self.name()
        while self.accept("."):
            text += "." + self.name()
        if self.accept("AS") or (self.peek()[0] in ("word", "quoted") and self.word() not in CLAUSES):
            text += " AS " + self.name()
        return text

    def parenthesised_names(self) -> str:
        self.expect("(")
        names = [self.name()]
        while self.accept(","):
            names.append(self.name())
        self.expect(")")
        return "(" + ", ".join(names) + ")"

    # -- expressions -------------------------------------------------------------------

    def expression(self, least: int = 0) -> str:
        left = self.prefix(least)
        while True:
            word = self.word()
            strength = STRENGTH.get(word, 0)
            if strength <= least or (word == "NOT" and self.word(1) not in ("IN", "LIKE", "BETWEEN", "REGEXP", "RLIKE")):
                return left
            self.take()
            left = self.infix(left, word, strength)

    def prefix(self, least: int) -> str:
        word = self.word()
        if word == "NOT" and self.peek()[0] == "word":
            self.take()
            return f"(NOT {self.boolean(self.expression(4))})"
        if word in ("-", "+"):
            self.take()
            operand = self.expression(12)
            return operand if word == "+" else f"(-{operand})"
        if word == "!":
            self.take()
            return f"(NOT {self.boolean(self.expression(12))})"
        if word == "~":
            self.take()
            return render("bitneg", self.expression(12))
        return self.primary()

    @staticmethod
    def boolean(text: str) -> str:
        """An operand of a logical operator: comparisons as they are, else whether it is not zero."""
        return text if _is_condition(text) else f"(CAST({text} AS DOUBLE) <> 0)"

    def infix(self, left: str, word: str, strength: int) -> str:
        negated = ""
        if word == "NOT":
            negated, word = "NOT ", self.word()
            self.take()
        if word in ("AND", "OR", "&&", "||"):
            return f"({self.boolean(left)} {'AND' if word in ('AND', '&&') else 'OR'} {self.boolean(self.expression(strength))})"
        if word == "XOR":
            return f"({self.boolean(left)} <> {self.boolean(self.expression(strength))})"
        if word == "BETWEEN":
            low = self.expression(5)
            self.expect("AND")
            return f"({left} {negated}BETWEEN {low} AND {self.expression(5)})"
        if word == "IN":
            self.expect("(")
            parts = None if self.word() in ("SELECT", "WITH") else self.arguments()
            inside = self.statement(")") if parts is None else ", ".join(parts)
            self.expect(")")
            if parts and left in self.rows and all(p in self.rows for p in parts):
                tests = [self.compare_rows(self.rows[left], "=", self.rows[p]) for p in parts]
                while len(tests) > 1:  # a balanced tree: a long list doesn't nest deep
                    tests = [f"({' OR '.join(tests[i : i + 2])})" for i in range(0, len(tests), 2)]
                return f"({negated}{tests[0]})"
            return f"({left} {negated}IN ({inside}))"
        if word == "LIKE":
            right = self.expression(strength)
            escape = ""
            if self.accept("ESCAPE"):
                escape = " ESCAPE " + self.primary()
            return f"({left} {negated}LIKE {right}{escape})"
        if word in ("REGEXP", "RLIKE"):
            return f"({left} {negated}RLIKE {self.expression(strength)})"
        if word == "IS":
            inverse = "NOT " if self.accept("NOT") else ""
            what = self.word()
            self.take()
            if what in ("TRUE", "FALSE"):
                return f"({self.boolean(left)} IS {inverse}{what})"
            return f"({left} IS {inverse}NULL)"
        if word == "COLLATE":
            _, name = self.take()
            return f"({left} COLLATE {COLLATIONS.get(string_value(name) if name[0] in chr(39) + chr(34) else name, name)})"
        if word in ("->", "->>"):
            found = render("json_extract", left, self.primary())
            return render("json_unquote", found) if word == "->>" else found
        right = self.expression(strength)
        if word in ("+", "-"):
            for side, other in ((right, left), (left, right)):
                if side.startswith("\0interval"):
                    _, n, unit = side.split("\0")[1:]
                    return render("date_add" if word == "+" else "date_sub", other, n, unit)
        if word in CALLS:
            return render(CALLS[word], left, right)
        if left in self.rows and right in self.rows:
            return self.compare_rows(self.rows[left], word, self.rows[right])
        return f"({left} {'<>' if word == '!=' else word} {right})"

    def arguments(self) -> list[str]:
        out = []
        while self.word() != ")":
            out.append(self.expression())
            if not self.accept(","):
                break
        return out

    def primary(self) -> str:
        kind, text = self.peek()
        word = self.word()
        if kind == "string":
            self.take()
            value = string_value(text)
            while self.peek()[0] == "string":  # neighbouring strings are one
                value += string_value(self.take()[1])
            return sql_string(value)
        if kind == "number":
            self.take()
            return f"X'{text[2:]}'" if text[:2] in ("0x", "0X") else text + "D" if "e" in text.lower() else text
        if kind == "variable":
            self.take()
            if text.startswith("@@"):
                return variable(text)
            return render("getvar", "'" + text[1:] + "'")
        if word == "(":
            self.take()
            if self.word() in ("SELECT", "WITH"):
                inside = self.statement(")")
                self.expect(")")
                return f"({inside})"
            parts = self.arguments()
            self.expect(")")
            return f"({parts[0]})" if len(parts) == 1 else self.row(parts)
        if word == "VALUES" and self.new_value and self.word(1) == "(":
            self.take()
            return self.new_value(self.parenthesised_names()[1:-1])
        if word == "CASE":
            return self.case()
        if word == "EXISTS":
            self.take()
            self.expect("(")
            inside = self.statement(")")
            self.expect(")")
            return f"(EXISTS ({inside}))"
        if word == "INTERVAL" and self.word(1) != "(":
            self.take()
            n = self.expression()
            return f"\0interval\0{n}\0{self.take()[1].upper()}"
        if word in ("DATE", "TIMESTAMP", "TIME") and self.peek(1)[0] == "string":
            self.take()
            return render({"DATE": "dateliteral", "TIMESTAMP": "timestampliteral", "TIME": "timeliteral"}[word], self.primary())
        if word == "BINARY" and self.word(1) != "(":
            self.take()
            return f"({self.primary()} COLLATE UTF8_BINARY)"
        if word == "*":
            self.take()
            return "*"
        if word in ("?", ":"):
            self.take()
            return "?" if word == "?" else ":" + self.take()[1]
        if kind in ("word", "quoted"):
            if kind == "word" and self.word(1) == "(":
                return self.call()
            if word in ("CURRENT_DATE", "CURRENT_TIME", "CURRENT_TIMESTAMP", "LOCALTIME", "LOCALTIMESTAMP", "UTC_DATE", "UTC_TIME", "UTC_TIMESTAMP", "CURRENT_USER"):
                self.take()
                return render(word.lower())
            self.take()
            while self.word() == ".":
                self.take()
                text += "." + self.take()[1]
            return self.column(text)
        raise SqlError(f"unexpected {text!r}")

    def row(self, parts: list[str]) -> str:
        text = render("row", *parts)
        self.rows[text] = parts
        return text

    def compare_rows(self, left: list[str], sign: str, right: list[str]) -> str:
        """Column by column, so that each pair is compared in its own type."""
        if len(left) != len(right):
            raise SqlError(f"rows of {len(left)} and {len(right)} columns")
        if sign in ("=", "<=>"):
            return "(" + " AND ".join(f"({a} {sign} {b})" for a, b in zip(left, right)) + ")"
        if sign in ("<>", "!="):
            return "(" + " OR ".join(f"({a} <> {b})" for a, b in zip(left, right)) + ")"
        out = f"({left[-1]} {sign} {right[-1]})"
        for a, b in zip(left[-2::-1], right[-2::-1]):
            out = f"(({a} {sign[0]} {b}) OR (({a} = {b}) AND {out}))"
        return out

    def case(self) -> str:
        self.expect("CASE")
        subject = None if self.word() == "WHEN" else self.expression()
        out = "CASE" + (f" {subject}" if subject else "")
        while self.accept("WHEN"):
            test = self.expression()
            self.expect("THEN")
            out += f" WHEN {test if subject else self.boolean(test)} THEN {self.expression()}"
        if self.accept("ELSE"):
            out += f" ELSE {self.expression()}"
        self.expect("END")
        return f"({out} END)"

    def call(self) -> str:
        name = self.take()[1].lower()
        self.expect("(")
        if name in AGGREGATES:
            return self.aggregate(name)
        if name in ("cast", "convert"):
            value = self.expression()
            if name == "convert" and self.accept("USING"):
                self.take()
                self.expect(")")
                return render("convert", value, "''")
            if not self.accept("AS"):
                self.expect(",")
            out = self.cast(value)
            self.expect(")")
            return out
        if name in ("date_add", "date_sub", "adddate", "subdate"):
            value = self.expression()
            self.expect(",")
            step = self.expression()
            self.expect(")")
            n, unit = step.split("\0")[2:] if step.startswith("\0interval") else (step, "DAY")
            return render(name, value, n, unit)
        if name in ("timestampadd", "timestampdiff", "get_format"):
            unit = self.take()[1].upper()
            self.expect(",")
            rest = self.arguments()
            self.expect(")")
            return render(name, unit, *rest)
        if name == "extract":
            unit = self.take()[1].upper()
            self.expect("FROM")
            value = self.expression()
            self.expect(")")
            return render(name, unit, value)
        if name == "trim":
            out = self.trim()
            self.expect(")")
            return out
        if name == "position":
            needle = self.expression(5)
            self.expect("IN")
            hay = self.expression()
            self.expect(")")
            return render("position", needle, hay)
        if name in ("substring", "substr", "mid"):
            args = [self.expression()]
            while self.accept(",") or self.accept("FROM") or self.accept("FOR"):
                args.append(self.expression())
            self.expect(")")
            return render(name, *args)
        if name == "char":
            args = self.arguments()
            if self.accept("USING"):
                self.take()
            self.expect(")")
            return render("char", *args)
        if name in ("nextval", "lastval", "setval"):
            args = self.arguments()
            self.expect(")")
            return render(name, *args)
        args = self.arguments()
        self.expect(")")
        if name == "row":
            return self.row(args)
        if name not in REGISTRY:
            return f"{name}({', '.join(args)})"  # Spark's own
        return render(name, *args)

    def cast(self, value: str) -> str:
        kind = self.take()[1].upper()
        size = ""
        if self.accept("("):
            while self.word() != ")":
                size += self.take()[1]
            self.expect(")")
        if kind in ("SIGNED", "UNSIGNED"):
            self.accept("INTEGER")
            return cast_integer(value)
        if kind == "DECIMAL":
            return f"try_cast({value} AS DECIMAL({size or '10,0'}))"
        if kind == "CHAR" and size:
            return f"left(CAST({value} AS STRING), {size})"
        if kind == "TIME":
            return render("time", value)
        if kind not in CAST_TYPES:
            raise SqlError(f"unknown type {kind}")
        return f"{'' if kind in ('CHAR', 'BINARY', 'JSON') else 'try_'}cast({value} AS {CAST_TYPES[kind]})"

    def trim(self) -> str:
        side = self.word() if self.word() in ("BOTH", "LEADING", "TRAILING") else ""
        if side:
            self.take()
        if side and self.accept("FROM"):
            return f"trim({side} FROM {self.expression()})"
        first = self.expression()
        if self.accept("FROM"):
            return render("trim", self.expression(), first, side or "BOTH")
        return render("trim", first)

    def aggregate(self, name: str) -> str:
        from ..operators.aggregates import aggregate_sql

        distinct = self.accept("DISTINCT")
        args = self.arguments()
        order, separator = [], "','"
        if self.accept("ORDER", "BY"):
            while True:
                key = self.expression()
                key += " DESC" if self.accept("DESC") else " ASC" if self.accept("ASC") else ""
                order.append(key)
                if not self.accept(","):
                    break
        if self.accept("SEPARATOR"):
            separator = self.primary()
        self.expect(")")
        out = aggregate_sql(name, args, distinct=distinct, order=order, separator=separator)
        if self.accept("OVER"):
            if self.word() != "(":
                out += " OVER " + self.name()
            else:
                self.expect("(")
                out += " OVER (" + self.statement(")") + ")"
                self.expect(")")
            if name in ("row_number", "rank", "dense_rank", "ntile"):
                return f"CAST({out} AS BIGINT)"
        return out


def _is_condition(text: str) -> bool:
    """Whether ``text`` is a comparison or logical expression that the rewriter wrote."""
    if not (text.startswith("(") and text.endswith(")")):
        return text.upper() in ("TRUE", "FALSE")
    depth, quoted, plain, i = 0, False, [], 1
    while i < len(text) - 1:
        c = text[i]
        if quoted:
            i += c == "\\"
            quoted = c != "'"
        elif c == "'":
            quoted = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif depth == 0:
            plain.append(c)
        i += 1
    outside = "".join(plain).upper()
    if not outside.strip():
        return _is_condition(text[1:-1].strip())
    return bool(re.search(r"<=>|<>|<=|>=|(?<![<>])=|<(?!<)|>(?!>)|\b(AND|OR|NOT|IN|LIKE|RLIKE|BETWEEN|IS|EXISTS)\b", outside)) and not outside.lstrip().startswith("CASE")


def cast_integer(value: str) -> str:
    """Numbers are rounded; of a string the number it begins with counts, else 0."""
    text = f"CAST({value} AS STRING)"
    return f"CAST(CASE WHEN ({value}) IS NULL THEN NULL ELSE coalesce(round(try_cast({text} AS DECIMAL(38, 6))), try_cast(regexp_extract({text}, '^\\\\s*([+-]?[0-9]+)', 1) AS DECIMAL(38, 0)), 0) END AS BIGINT)"


def variable(token: str) -> str:
    parts = token.lstrip("@").lower().split(".")
    known = info.SYSTEM if parts[0] == "global" else info.scope().system
    return sql_string(str(known.get(parts[-1], "")))


def rewrite(text: str) -> str:
    """A MySQL query as Spark SQL."""
    return Rewriter(text).statement()


def rewrite_expression(text: str) -> str:
    """A MySQL expression as Spark SQL."""
    work = Rewriter(text)
    out = work.expression()
    if work.peek()[0] != "end":
        raise SqlError(f"unexpected {work.peek()[1]!r}")
    return out
