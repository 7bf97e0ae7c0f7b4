"""Streaming reads: rows or cells in bounded batches, fetched as the caller goes on."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row

#: Rows that wait for the caller, and cells in one message.
CHANNEL_ROWS, BATCH_CELLS = 32, 1000


def stream_rows(df: DataFrame, limit: int | None = None) -> Iterator[Row]:
    """Rows one after the other; one partition at a time is in the driver, never the whole result."""
    rows = df.toLocalIterator(prefetchPartitions=False)
    return islice(rows, limit) if limit is not None else rows


def stream_batches(df: DataFrame, size: int = CHANNEL_ROWS) -> Iterator[list[Row]]:
    rows = stream_rows(df)
    while batch := list(islice(rows, size)):
        yield batch


def stream_cells(rows: DataFrame, size: int = BATCH_CELLS) -> Iterator[Row]:
    """(key, cells) with at most ``size`` cells in a message; a longer row comes in several, each under its own key."""
    from pyspark.sql import functions as F

    n = F.greatest(F.lit(1), F.ceil(F.size("cells") / F.lit(size)))
    parts = rows.select("key", F.explode(F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: F.slice("cells", i * size + 1, size))).alias("cells"))
    return stream_rows(parts)
