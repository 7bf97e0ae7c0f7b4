"""Best-fit packing of token sequences by large-item matching.

Only the number of pieces of each length decides how they pack, so the plan is made
from a histogram of at most ``capacity`` rows, whatever the corpus.  Lengths above a
third of the capacity meet at most in pairs: from the largest down, each is matched
with the largest that still fits (a matching of greatest size).  Smaller lengths, from
the largest down, go to the fullest sequence with room, else to a new one.  The plan
lists, for each length, ranges of ranks and where they go; pieces get their rank inside
their length from counts of buckets of neighbouring pieces, so a length that holds a
third of all pieces, or a row that is there a million times, is ranked by many tasks.

Defined results: a null or empty text is the end token alone, one piece of length 1; a
text longer than the capacity is cut into pieces of the capacity, the last one shorter;
repeated rows are packed each; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Generations, arrow_batches, materialize
from .token_counts import CHUNKS, WordBpe, chunks_of

#: Pieces that one rank bucket holds at most: neighbours in a partition, whatever their length and ids.
RANK_BUCKET = 1 << 16


class WordIds:
    """Texts to ids as little-endian unsigned 32-bit integers, by way of chunks and pre-tokens met before."""

    def __init__(self, path: str):
        self.bpe = WordBpe(path)
        self._chunks = Generations(self._encode, CHUNKS)

    def _encode(self, chunk: str) -> bytes:
        pieces = self.bpe.pre_tokens(chunk)
        if pieces is None:
            return struct_of(self.bpe.library.encode(chunk, add_special_tokens=False).ids)
        if pieces == [chunk]:
            return struct_of(self.bpe.merge(chunk))
        return b"".join(map(self._chunks.__getitem__, pieces))  # a pre-token is a chunk of itself

    def ids(self, text: str) -> bytes:
        return b"".join(map(self._chunks.__getitem__, chunks_of(text)))


def struct_of(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(length, first rank, first sequence, pieces in each sequence, offset) by length and rank, and the number of sequences.

    The piece of rank r in a row from rank f goes to sequence first + (r - f) // each,
    at offset + (r - f) % each * length.  Groups of like sequences keep the work and the
    rows within a multiple of ``capacity``: a length splits at most one group of them.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    used = {length: 0 for length in histogram}
    left = {length: n for length, n in histogram.items() if n > 0}
    groups: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, how many) of sequences with that gap
    gaps: list[int] = []
    made = 0

    def put(length: int, n_sequences: int, each: int, first: int, offset: int, pieces: int) -> None:
        rows.append((length, used[length], first, each, offset))
        used[length] += pieces
        left[length] -= pieces

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in groups:
                bisect.insort(gaps, gap)
                groups[gap] = []
            groups[gap].append((first, n))

    large = sorted(length for length in left if 3 * length > capacity)
    for length in reversed(large):
        while left[length]:
            fits = bisect.bisect_right(large, capacity - length) - 1
            while fits >= 0 and left[large[fits]] == 0:
                fits -= 1
            mate = large[fits] if fits >= 0 else None
            if mate == length and left[length] == 1:  # none left but itself: the next smaller one
                fits -= 1
                while fits >= 0 and left[large[fits]] == 0:
                    fits -= 1
                mate = large[fits] if fits >= 0 else None
            if mate is None:
                n = left[length]
                put(length, n, 1, made, 0, n)
                leave(capacity - length, made, n)
            elif mate == length:
                n = left[length] // 2
                put(length, n, 2, made, 0, 2 * n)
                leave(capacity - 2 * length, made, n)
            else:
                n = min(left[length], left[mate])
                put(length, n, 1, made, 0, n)
                put(mate, n, 1, made, length, n)
                leave(capacity - length - mate, made, n)
            made += n
    for length in sorted((length for length in left if 3 * length <= capacity), reverse=True):
        while left[length]:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):
                each = min(capacity // length, left[length])
                n = left[length] // each
                put(length, n, each, made, 0, n * each)
                leave(capacity - each * length, made, n)
                made += n
                continue
            gap = gaps[at]
            first, n = groups[gap].pop()
            if not groups[gap]:
                del groups[gap], gaps[at]
            each = min(gap // length, left[length])
            filled = min(n, left[length] // each)
            put(length, filled, each, first, capacity - gap, filled * each)
            leave(gap - each * length, first, filled)
            leave(gap, first + filled, n - filled)
    return sorted(rows), made


def piece_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and ``end_id``, cut only beyond the capacity."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, end = word_ids(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = tool.ids(text or "") + end
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    for column, value in zip(out, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """The pieces of ``docs`` with sequence_id and offset."""
    spark = docs.sparkSession
    # Each piece gets a number, settled once it is written: neighbours in a partition count up by one.
    pieces = materialize(piece_documents(docs, path, capacity, end_id).withColumn("row", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    rows, _ = plan(histogram, capacity)
    table = np.array(rows, dtype=np.int64).reshape(len(rows), 5)
    shared = spark.sparkContext.broadcast(table)  # rows within a multiple of the capacity

    keyed = pieces.withColumn("bucket", F.floor(F.col("row") / F.lit(RANK_BUCKET)))
    inside = keyed.withColumn("inside", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row")) - 1)
    counts = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = inside.join(starts, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("inside"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first_rank, first, each, offset = shared.value.T
        keys = (length << 44) + first_rank  # ranks below 2**44
        for batch in batches:
            own, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(keys, (own << 44) + rank, side="right") - 1
            step = rank - first_rank[at]
            columns = [*batch.columns[:5], pa.array(first[at] + step // each[at]), pa.array(offset[at] + step % each[at] * own)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, schema)
