"""Joins by order: the last row before a time, and points in intervals.  Equality joins are Spark's own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, columns: Sequence[str], step: str = "1 day") -> DataFrame:
    """``left`` with ``columns`` of the last row of ``right`` of the same keys at or before its ``time``; NULL if there is none.

    Rows are sorted within (keys, ``step`` of time), not within keys, so a hot key is
    many tasks' work; the last row of each step is carried into the next ones by a
    window over steps, of which a key has few.  Of equal times any row counts.
    """
    value = F.struct(*[F.col(f"`{c}`") for c in columns])
    bare = F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType)
    row = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    none = F.lit(None).cast(left.select(row.alias("r")).schema["r"].dataType)
    at = [F.col(f"`{k}`") for k in keys]
    bucket = F.window(F.col(time), step)["start"]
    both = right.select(*at, F.col(time).alias("q_t"), bucket.alias("q_step"), value.alias("q_v"), none.alias("q_row"))
    both = both.union(left.select(*at, F.col(time), bucket, bare, row))
    # NULL values sort first, so at one time right rows (q_side 0) come before left ones.
    side = F.when(F.col("q_row").isNull(), 0).otherwise(1)
    inside = Window.partitionBy(*at, "q_step").orderBy("q_t", side).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("q_last", F.last("q_v", True).over(inside)).where("q_row IS NOT NULL")
    lasts = both.groupBy(*at, "q_step").agg(F.max_by("q_v", F.when(F.col("q_row").isNull(), F.col("q_t"))).alias("q_v"))
    earlier = Window.partitionBy(*at).orderBy("q_step").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(*at, "q_step", F.last("q_v", True).over(earlier).alias("q_before"))
    same = _same("a", "b", [*keys, "q_step"])
    out = seen.alias("a").join(carried.alias("b"), same, "left").select("a.q_row", F.coalesce("a.q_last", "b.q_before").alias("q_v"))
    return out.select("q_row.*", *[F.col("q_v")[c].alias(c) for c in columns])


def range_join(points: DataFrame, intervals: DataFrame, point: str, start: str, end: str, width: float) -> DataFrame:
    """Each pair of a point and an interval ``[start, end)`` that holds it.

    Both sides meet on bins of ``width``: an interval stands in every bin it touches, a
    point in one, so the join is by equality; a width near that of the intervals is best.
    """
    bin_of = lambda c: F.floor(c / F.lit(width)).cast("long")
    some = intervals.where(F.col(end) > F.col(start))
    bins = some.withColumn("q_bin", F.explode(F.sequence(bin_of(F.col(start)), bin_of(F.col(end)))))
    met = points.withColumn("q_bin", bin_of(F.col(point))).join(bins, "q_bin")
    return met.where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))).drop("q_bin")


def _same(a: str, b: str, names: Sequence[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(f"{a}.`{n}`").eqNullSafe(F.col(f"{b}.`{n}`"))
    return out
