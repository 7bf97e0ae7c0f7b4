"""Reads by primary key and index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keys import KeySet, restrict


def scan(
    df: DataFrame, key: Sequence[str], keys: KeySet | None = None, columns: Sequence[str] | None = None, where: str | None = None,
    reverse: bool = False, ordered: bool = True, limit: int | None = None, offset: int = 0,
) -> DataFrame:
    """Rows in ``keys`` that meet ``where`` (Spark SQL), in order of ``key``, then offset and limit.

    ``key`` is the primary key or an index; the limit counts rows after the filter and
    the offset.  With a limit the order is a top-k, not a whole sort.
    """
    out = restrict(df, key, keys or KeySet.all())
    if where:
        out = out.where(where)
    if ordered and key:
        out = out.orderBy(*[F.col(f"`{c}`").desc() if reverse else F.col(f"`{c}`").asc() for c in key])
    if offset:
        out = out.offset(offset)
    if limit is not None:
        out = out.limit(limit)
    return out.select(*columns) if columns else out


def batch_get(df: DataFrame, key: Sequence[str], keys: KeySet, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of a list of keys, in no order."""
    return scan(df, key, keys, columns, ordered=False)


def covers(index: Sequence[str], primary_key: Sequence[str], columns: Sequence[str]) -> bool:
    """Whether the index and the primary key hold all ``columns``."""
    return {c.lower() for c in columns} <= {c.lower() for c in [*index, *primary_key]}


def count_rows(df: DataFrame, where: str | None = None) -> DataFrame:
    """One row, ``n``: partial counts in the tasks, then their sum."""
    return (df.where(where) if where else df).agg(F.count("*").alias("n"))
