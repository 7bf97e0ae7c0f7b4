"""Column families: long cells, maps by qualifier, and rows of cells.

The long form is (key..., family, qualifier, i, d, b), one row for each cell with one
of i, d, b set or none for NULL; they may also come as one struct, ``cell``.  The map form is one row for each key with a map of
qualifier to cell for each flexible family.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL_FIELDS = ("i", "d", "b")


def cell(value: Column, kind: str) -> Column:
    """A cell of kind i, d or b."""
    types = {"i": "bigint", "d": "double", "b": "binary"}
    return F.struct(*[(value if k == kind else F.lit(None)).cast(t).alias(k) for k, t in types.items()])


def to_maps(cells: DataFrame, key: Sequence[str], families: Sequence[str]) -> DataFrame:
    """Long cells to one row for each key, a map for each family (NULL where the row has none of it).

    One shuffle on the key for all families, instead of one join for each.
    """
    own = F.col("cell") if "cell" in cells.columns else F.struct(*CELL_FIELDS)
    entry = F.struct("qualifier", own.alias("cell"))
    maps = [F.collect_list(F.when(F.col("family") == f, entry)).alias(f) for f in families]
    rows = cells.where(F.col("family").isin(*families)).groupBy(*key).agg(*maps)
    return rows.select(*key, *[F.when(F.size(f) > 0, F.map_from_entries(f)).alias(f) for f in families])


def to_cells(rows: DataFrame, key: Sequence[str], families: Sequence[str]) -> DataFrame:
    """Maps to long cells; one pass, no shuffle."""
    part = lambda f: F.transform(F.coalesce(F.map_entries(f), F.array()), lambda e: F.struct(F.lit(f).alias("family"), e["key"].alias("qualifier"), e["value"].alias("cell")))
    parts = [part(f) for f in families]
    return rows.select(*key, F.explode(F.concat(*parts)).alias("c")).select(*key, "c.family", "c.qualifier", "c.cell.*")


def expand(rows: DataFrame, family: str, qualifiers: Sequence[str] | None = None) -> DataFrame:
    """``family.*``: one row for each cell, as _qualifier and _value, beside the fixed columns."""
    wanted = pick(F.col(f"`{family}`"), qualifiers)
    fixed = [c for c, t in rows.dtypes if not t.startswith("map<string,struct<i:bigint")]
    return rows.select(*fixed, F.explode(wanted).alias("_qualifier", "_value"))


def pick(family: Column, qualifiers: Sequence[str] | None) -> Column:
    """The cells of some qualifiers, or all."""
    return family if not qualifiers else F.map_filter(family, lambda q, _: q.isin(*qualifiers))


def sparse_read(rows: DataFrame, key: Sequence[str], wanted: Sequence[tuple[tuple, Sequence[str]]], families: Sequence[str], limit: int | None = None) -> DataFrame:
    """(key..., families) of the wanted keys, each with its own qualifiers (none: all of them); rows without a cell left go."""
    from .keys import BROADCAST_KEYS, KeySet, plain, restrict

    asked: dict[tuple, set[str] | None] = {}  # a key asked for twice gets the qualifiers of both, or all
    for k, q in ((plain(k), q) for k, q in wanted):
        asked[k] = None if not q or asked.get(k, ()) is None else {*asked.get(k, ()), *q}
    out = restrict(rows, key, KeySet(keys=tuple(asked)))
    some = [(k, sorted(q)) for k, q in asked.items() if q]
    if some:
        spark = rows.sparkSession
        types = dict(rows.dtypes)
        schema = ", ".join(f"`{c}` {types[c]}" for c in key) + ", q_wanted array<string>"
        own = spark.createDataFrame([(*k, q) for k, q in some], schema)
        own = F.broadcast(own) if len(some) <= BROADCAST_KEYS else own
        out = out.join(own, list(key), "left")
        keep = lambda f: F.when(F.col("q_wanted").isNull(), F.col(f)).otherwise(F.map_filter(F.col(f), lambda q, _: F.array_contains("q_wanted", q)))
        out = out.select(*key, *[keep(f).alias(f) for f in families])
    return _with_cells(out.select(*key, *families), families, key, limit)


def sparse_scan(rows: DataFrame, key: Sequence[str], keys, families: Sequence[str], qualifiers: Sequence[str] | None = None, limit: int | None = None, reverse: bool = False) -> DataFrame:
    """(key..., families) of the rows in ``keys`` in key order, with the cells of ``qualifiers``."""
    from .keys import restrict

    out = restrict(rows, key, keys).select(*key, *[pick(F.col(f), qualifiers).alias(f) for f in families])
    return _with_cells(out, families, key, limit, reverse)


def _with_cells(rows: DataFrame, families: Sequence[str], key: Sequence[str], limit: int | None, reverse: bool = False) -> DataFrame:
    some = " OR ".join(f"size(coalesce(`{f}`, map())) > 0" for f in families)
    out = rows.where(some).orderBy(*[F.desc(k) if reverse else F.asc(k) for k in key])
    return out if limit is None else out.limit(limit)


def row_cells(rows: DataFrame, key: Sequence[str], fixed: Sequence[str], families: Sequence[str] = (), default_family: str = "default") -> DataFrame:
    """(key, cells): each row as an array of (family, qualifier, value as text), families in order, qualifiers in order."""
    own = F.array(*[F.struct(F.lit(default_family).alias("family"), F.lit(c).alias("qualifier"), F.col(f"`{c}`").cast("string").alias("value")) for c in fixed]) if fixed else F.array()
    text = lambda v: F.coalesce(v["i"].cast("string"), v["d"].cast("string"), v["b"].cast("string"))
    part = lambda f: F.transform(F.array_sort(F.coalesce(F.map_entries(f), F.array())), lambda e: F.struct(F.lit(f).alias("family"), e["key"].alias("qualifier"), text(e["value"]).alias("value")))
    more = [part(f) for f in families]
    return rows.select(F.struct(*key).alias("key"), F.concat(own, *more).alias("cells"))
