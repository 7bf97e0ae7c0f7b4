"""Writes as plans: the table after the write is a DataFrame of the table before it.

Of several writes to one key the last wins.  Upserts and deletes join on the key, so
both sides are dealt out by it; a delete by range is a filter and moves nothing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keys import KeySet, lower_bound, mark


def last_of_each(changes: DataFrame, key: Sequence[str], order: str | None) -> DataFrame:
    """One row for each key: the greatest ``order``, or any row if there is none."""
    if order is None:
        return changes.dropDuplicates(list(key))
    newest = Window.partitionBy(*key).orderBy(F.col(order).desc())
    return changes.withColumn("q_n", F.row_number().over(newest)).where("q_n = 1").drop("q_n", order)


def _matched(a: str, b: str, key: Sequence[str]) -> Column:
    test = F.lit(True)
    for k in key:
        test = test & F.col(f"{a}.`{k}`").eqNullSafe(F.col(f"{b}.`{k}`"))
    return test


def upsert(table: DataFrame, changes: DataFrame, key: Sequence[str], order: str | None = None) -> DataFrame:
    """Rows of ``changes`` replace those of the same key, column by column; columns they lack keep what they had."""
    new = last_of_each(changes, key, order).withColumn("q_new", F.lit(True))
    both = table.withColumn("q_old", F.lit(True)).alias("o").join(new.alias("n"), _matched("o", "n", key), "full_outer")
    given = {c.lower() for c in new.columns}
    pick = lambda c: F.when(F.col("n.q_new"), F.col(f"n.`{c}`")).otherwise(F.col(f"o.`{c}`")) if c.lower() in given else F.col(f"o.`{c}`")
    return both.select(*[pick(c).cast(t).alias(c) for c, t in table.dtypes])


def insert_only(table: DataFrame, changes: DataFrame, key: Sequence[str], order: str | None = None) -> DataFrame:
    """New keys are added; keys that exist stay as they are."""
    new = last_of_each(changes, key, order)
    fresh = new.alias("n").join(table.select(*key).alias("o"), _matched("o", "n", key), "left_anti")
    return table.unionByName(fresh, allowMissingColumns=True)


def update_only(table: DataFrame, changes: DataFrame, key: Sequence[str], order: str | None = None) -> DataFrame:
    """Keys that exist are changed; new keys are left out."""
    new = last_of_each(changes, key, order).withColumn("q_new", F.lit(True))
    both = table.alias("o").join(new.alias("n"), _matched("o", "n", key), "left")
    given = {c.lower() for c in new.columns}
    pick = lambda c: F.when(F.col("n.q_new"), F.col(f"n.`{c}`")).otherwise(F.col(f"o.`{c}`")) if c.lower() in given else F.col(f"o.`{c}`")
    return both.select(*[pick(c).cast(t).alias(c) for c, t in table.dtypes])


def replace_rows(table: DataFrame, changes: DataFrame, key: Sequence[str], order: str | None = None) -> DataFrame:
    """Rows of ``changes`` take the place of those of the same key; columns they lack become NULL."""
    new = last_of_each(changes, key, order)
    kept = table.alias("o").join(new.select(*key).alias("n"), _matched("o", "n", key), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def delete_keys(table: DataFrame, key: Sequence[str], keys: KeySet) -> DataFrame:
    """Without the rows in ``keys``; a row whose key is NULL where the test can't tell stays."""
    if keys.everything:
        return table.limit(0)
    marked, test, marks = mark(table, key, keys)
    return marked.where(~test).drop(*marks)


def delete_cells(table: DataFrame, key: Sequence[str], keys: KeySet, family: str, qualifiers: Sequence[str] | None = None) -> DataFrame:
    """The family, or some of its qualifiers, taken out of the rows in ``keys``."""
    marked, test, marks = mark(table, key, keys)
    left = F.map_filter(F.col(family), lambda q, _: ~q.isin(*qualifiers)) if qualifiers else F.lit(None).cast(dict(table.dtypes)[family])
    return marked.withColumn(family, F.when(test, left).otherwise(F.col(family))).drop(*marks)


def clear_columns(table: DataFrame, key: Sequence[str], keys: KeySet, columns: Sequence[str]) -> DataFrame:
    """Fixed columns set to NULL in the rows in ``keys``."""
    marked, test, marks = mark(table, key, keys)
    return marked.select(*[F.when(~test, F.col(f"`{c}`")).cast(t).alias(c) if c in columns else F.col(f"`{c}`") for c, t in table.dtypes])


def upsert_cells(table: DataFrame, cells: DataFrame, key: Sequence[str], families: Sequence[str], order: str | None = None) -> DataFrame:
    """Long cells written into the family maps: the last write of (key, family, qualifier) wins."""
    from .families import to_maps

    new = to_maps(last_of_each(cells, [*key, "family", "qualifier"], order), key, families)
    both = table.alias("o").join(new.alias("n"), _matched("o", "n", key), "full_outer")

    def merged(f: str) -> Column:
        old, add = F.col(f"o.`{f}`"), F.col(f"n.`{f}`")
        stay = F.map_filter(old, lambda q, _: ~F.array_contains(F.map_keys(add), q))
        return F.when(add.isNull(), old).when(old.isNull(), add).otherwise(F.map_concat(stay, add))

    names = {f.lower() for f in families}
    out = [merged(c) if c.lower() in names else F.coalesce(F.col(f"n.`{c}`"), F.col(f"o.`{c}`")) if c in key else F.col(f"o.`{c}`") for c in table.columns]
    return both.select(*[x.alias(c) for x, c in zip(out, table.columns)])


def in_rows_of(table: DataFrame, changes: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows of ``table`` whose keys stand in ``changes``: what a write by key can touch."""
    names = [F.col(f"`{k}`") for k in key]
    return table.alias("o").join(changes.select(*names).distinct().alias("n"), _matched("o", "n", key), "left_semi")


def on_duplicate(table: DataFrame, changes: DataFrame, key: Sequence[str], assignments: Mapping[str, str], order: str) -> DataFrame:
    """The rows of ``table`` that ``changes`` (its columns and ``order``) touch, and new ones, after INSERT ... ON DUPLICATE KEY UPDATE.

    A row whose key is not there is added; each further one of its key changes it by
    ``assignments``, Spark SQL over q_s (the row so far) and q_e (the row that came).
    The rows of one key are folded in order, as the statement asks for.
    """
    names = table.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    types = dict(table.dtypes)
    added = changes.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("q_at"), row.alias("q_row")))).alias("q_added"))
    old = in_rows_of(table, changes, key).select(*[F.col(f"`{k}`") for k in key], row.alias("q_old"))
    both = added.alias("a").join(old.alias("o"), _matched("o", "a", key), "left").select("a.q_added", "o.q_old")
    given = {c.lower(): v for c, v in assignments.items()}
    new = ", ".join(f"'{c}', CAST({given.get(c.lower(), f'q_s.`{c}`')} AS {types[c]})" for c in names)
    kind = both.schema["q_old"].dataType.simpleString()
    folded = f"aggregate(transform(q_added, q_e -> q_e.q_row), CAST(q_old AS {kind}), (q_s, q_e) -> CAST(IF(q_s IS NULL, q_e, named_struct({new})) AS {kind}))"
    return both.select(F.expr(folded).alias("r")).select("r.*")


def update_where(table: DataFrame, assignments: Mapping[str, str], where: str | None = None) -> DataFrame:
    """Assignments (Spark SQL) on the rows that meet ``where``; all read the row as it was."""
    given = {c.lower(): v for c, v in assignments.items()}
    test = F.coalesce(F.expr(where).cast("boolean"), F.lit(False)) if where else F.lit(True)
    return table.select(*[F.when(test, F.expr(given[c.lower()])).otherwise(F.col(f"`{c}`")).cast(t).alias(c) if c.lower() in given else F.col(f"`{c}`") for c, t in table.dtypes])


def delete_where(table: DataFrame, where: str | None = None) -> DataFrame:
    return table.where(~F.coalesce(F.expr(where).cast("boolean"), F.lit(False))) if where else table.limit(0)


def at_or_above(key: Sequence[str], bound: tuple) -> Column:
    """Whether a row's key is ``bound`` or comes after it."""
    return F.coalesce(lower_bound(key, bound), F.lit(False))
