"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule rejects a document by a few measures of its text.  The cascade estimates, on
a bounded sample, what each rule costs and which rows it rejects, orders the rules by
rejections per cost among what those before let pass, and evaluates them in that order.  In
``keep_good`` (the pipeline's stage) a later rule's measures are not computed once an
earlier rule rejects.  ``judge`` (op10) must give the measures of every row, so it
computes them all and the order saves nothing there.  The verdict is the same in every
order, so the sample decides speed, never results.

Defined results: a null text is the empty text: no words, so it fails; repeated rows
are judged each; other columns, whatever their names, are ignored or kept.
"""

from __future__ import annotations

import math
import time
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that the estimate of cost and selectivity takes at most, the longest of them, the share of rows they are drawn from, and how often each is timed; it decides the order of rules only.
SAMPLE_ROWS, SAMPLE_CHARS, SAMPLE_SHARE, SAMPLE_SEED, SAMPLE_TIMES = 256, 100_000, 0.05, 7, 4
LEAST_SECONDS = 2.0**-8
WINDOW = 5


class Rule(NamedTuple):
    name: str
    measures: tuple[str, ...]
    rejects: str  # SQL over the measures


#: The base rules first, then the added ones; thresholds lie well outside what clean prose shows.
RULES = (
    Rule("too_few_words", ("n_words",), "n_words < 10"),
    Rule("repeated_passages", ("n_words", "n_repeat_words"), "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", ("n_words", "n_symbols"), "10 * n_symbols > n_words"),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), "2 * n_dup_lines > n_lines"),
    Rule("word_length", ("n_words", "word_chars"), "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
)
BASE_RULES = ("too_few_words", "repeated_passages")


def _words(text: Column) -> Column:
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def _without(text: Column, characters: str) -> Column:
    """``text`` without some ASCII characters; a pass over its bytes for each is faster than a look-up for each character."""
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def _repeats(have: DataFrame, into: str) -> DataFrame:
    """``have`` with ``into``.r: how many words stand in windows found twice or more.

    Every array that a lambda looks into is a column of its own first, else it would be
    made anew for each element.  A text without repeated windows (their hashes are as
    many as the distinct ones) stops there; else (hash, place) is sorted, the places of
    equal neighbours are kept in order, and what each adds to the last is summed.
    """
    own = lambda name: F.col(f"{into}.{name}")
    more = lambda df, name, column: df.withColumn(into, F.struct(F.col(f"{into}.*"), column.alias(name)))
    size = lambda name: F.size(own(name))

    have = more(have, "wh", F.transform(own("w"), lambda w: F.xxhash64(w)))
    # Windows of 2 and 4 words, then 5: each pass hashes pairs, which is cheaper than looking up five places.
    def joined(a: str, b: str, step: int, width: int) -> Column:
        n = size("wh") - (width - 1)
        return F.when(size("wh") > WINDOW, F.zip_with(F.slice(own(a), F.lit(1), n), F.slice(own(b), F.lit(1 + step), n), lambda x, y: F.xxhash64(x, y)))

    have = more(have, "h2", joined("wh", "wh", 1, 2))
    have = more(have, "h4", joined("h2", "h2", 2, 4))
    have = more(have, "h", joined("h4", "wh", 4, 5))
    keyed = F.sort_array(F.zip_with(own("h"), F.sequence(F.lit(0), size("h") - 1), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    have = more(have, "k", F.when(F.size(F.array_distinct(own("h"))) < size("h"), keyed))
    equal = lambda j, k: (F.get(own("k"), j)["h"] == F.get(own("k"), k)["h"]).eqNullSafe(F.lit(True))
    places = F.transform(F.sequence(F.lit(0), size("k") - 1), lambda j: F.when(equal(j, j - 1) | equal(j, j + 1), F.get(own("k"), j)["i"]))
    have = more(have, "p", F.when(own("k").isNotNull(), F.sort_array(F.filter(places, lambda at: at.isNotNull()))))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    add = lambda acc, at: F.struct((acc["n"] + F.least(F.lit(WINDOW), at - acc["last"])).alias("n"), at.alias("last"))
    return more(have, "r", F.coalesce(F.aggregate(own("p"), start, add, lambda acc: acc["n"]), F.lit(0)).cast("bigint"))


def with_measures(docs: DataFrame, measures: set[str], text: str = "text", into: str = "__m") -> DataFrame:
    """``docs`` with the struct column ``into`` of the wanted measures."""
    have = docs.withColumn(into, F.struct(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")))
    t = F.col(f"{into}.t")
    first: list[Column] = []
    if measures & {"n_words", "n_repeat_words", "word_chars"}:
        first.append(_words(t).alias("w"))
    if measures & {"n_dup_lines", "n_lines"}:
        first.append(_lines(t).alias("l"))
    have = have.withColumn(into, F.struct(t.alias("t"), *first))
    own = lambda name: F.col(f"{into}.{name}")
    out = []
    if "n_words" in measures:
        out.append(F.size(own("w")).cast("bigint").alias("n_words"))
    if "word_chars" in measures:
        out.append(F.char_length(F.array_join(own("w"), "")).cast("bigint").alias("word_chars"))
    if "n_symbols" in measures:
        out.append((F.octet_length(t) - F.octet_length(_without(t, "#*$%&|<>"))).cast("bigint").alias("n_symbols"))
    if "n_dup_lines" in measures:
        out.append((F.size(own("l")) - F.size(F.array_distinct(own("l")))).cast("bigint").alias("n_dup_lines"))
    if "n_lines" in measures:
        out.append(F.size(own("l")).cast("bigint").alias("n_lines"))
    if "n_repeat_words" in measures:
        have = _repeats(have, into)
        out.append(own("r").alias("n_repeat_words"))
    return have.withColumn(into, F.struct(*out))


def _spread_sample(docs: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` texts, one row in some, of as few partitions as hold them; the first ones of a small table.

    They are taken to the driver's JVM and stay there: no Python sees them.
    """
    texts = docs.select(F.col("text").cast("string").alias("text")).where(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS)
    taken = texts.sample(SAMPLE_SHARE, SAMPLE_SEED)._jdf.takeAsList(rows)
    if taken.size() < rows // 4:
        taken = texts._jdf.takeAsList(rows)
    spark = docs.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(taken, texts._jdf.schema()), spark)


def _seconds(df: DataFrame, *columns: Column) -> float:
    """Time of a pass that works out ``columns``; the first run also compiles."""
    best = float("inf")
    for _ in range(2):
        began = time.perf_counter()
        df.agg(F.count("*"), *columns).first()
        best = min(best, time.perf_counter() - began)
    return best


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """``rules``, each next one by rejections per cost among the rows that those before it let pass.

    Both come from a sample of at most ``rows`` whole texts.  A cost is the time of the rule over the sample, taken ``SAMPLE_TIMES``
    times, less that of a pass without a rule, to the next power of two.
    """
    sample = _spread_sample(docs, rows)
    wanted = {m for rule in rules for m in rule.measures}
    hits = [F.expr(f"IF(coalesce({rule.rejects}, false), {1 << i}, 0)") for i, rule in enumerate(rules)]
    judged = with_measures(sample, wanted).select("__m.*").select(sum(hits[1:], hits[0]).alias("hits"))
    counts = {r["hits"]: r["n"] for r in judged.groupBy("hits").agg(F.count("*").alias("n")).collect()}  # a row for each set of rules
    often = sample.select("text", F.explode(F.sequence(F.lit(1), F.lit(SAMPLE_TIMES))).alias("__time"))
    bare = _seconds(often, F.sum(F.length("text") + F.col("__time")))
    cost = []
    for rule in rules:
        spent = _seconds(with_measures(often, set(rule.measures)).select("__m.*"), F.count_if(F.expr(rule.rejects)))
        cost.append(2.0 ** math.ceil(math.log2(max(spent - bare, LEAST_SECONDS))))
    out, left = [], list(range(len(rules)))
    while left:
        gain = {i: sum(n for hit, n in counts.items() if hit >> i & 1 and not any(hit >> j & 1 for j in out)) / cost[i] for i in left}
        out.append(max(left, key=lambda i: (gain[i], -cost[i], -i)))
        left.remove(out[-1])
    return [rules[i] for i in out]


def verdict(rules: list[Rule] | tuple[Rule, ...]) -> str:
    """SQL: false at the first rule that rejects, else true."""
    return "CASE " + " ".join(f"WHEN {rule.rejects} THEN false" for rule in rules) + " ELSE true END"


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the measures, base_failed and kept for each row of ``docs``; one pass without a shuffle.

    Every measure is computed for every row, whatever the order of the rules.
    """
    ordered = order_rules(docs, rules)
    wanted = {"word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_words"} | {m for rule in rules for m in rule.measures}
    rows = with_measures(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), wanted).select("doc_id", "__m.*")
    base = " OR ".join(f"({rule.rejects})" for rule in rules if rule.name in BASE_RULES) or "false"
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.expr(base).alias("base_failed"), F.expr(verdict(ordered)).alias("kept"),
    )


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns.

    Rules are applied one after the other in the cascade's order, so the measures of a
    later rule are computed only for rows that the earlier ones keep.  A row goes on by
    exploding an array of one or no element: a filter would be pushed below the
    measures, which would then be computed again inside it.
    """
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("text").cast("string").alias("text"))
    for rule in order_rules(docs, rules):
        judged = with_measures(boxed, set(rule.measures))
        rejected = judged.select("__row", "text", "__m.*").select("__row", "text", F.expr(f"coalesce({rule.rejects}, false)").alias("__no"))
        boxed = rejected.select("__row", "text", F.explode(F.when(~F.col("__no"), F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))).alias("__on"))
    return boxed.select("__row.*")
