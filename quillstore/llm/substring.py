"""Removal of word passages that an earlier document holds, by an exchange of windows.

The exchange replaces De Bruijn compaction: there are no nodes of ``K`` - 1 words, no
branching test and no joins that compact paths.  An edge is a window of ``K`` words as a
64-bit key and, beside it, bits of an independent hash: both must agree, so edges are
told apart by 80 bits.  Each packed group of documents sends its distinct edges with
their first place (doc_id, word) through the exchange; equal edges of all groups meet,
and each group gets back the places of those that an earlier document holds.  A very
common passage is one edge of each group, however many documents hold it.

Every word of a repeated edge is removed.  Once that is decided, neighbouring repeated
edges of a document whose source places also are neighbours are reported as one span
(start, end, source document, source word).

Defined results: words are judged on the input, not on what is left; a null or empty
text has no words; equal doc_ids are one document, so repeated rows don't remove each
other; a null doc_id, or one that is no whole number, counts as greater than all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_shuffles, mix, n_bytes_of, packed_groups, powers, unpack_table, word_hashes, words_of
from .exchange import KEY_BYTES, Tree, exchange, pack_columns, requests_of, unpack_columns

K = 13
LAST = np.iinfo(np.int64).max
#: Odd factors of the two hashes, so multiplying loses nothing.
_STEPS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def edge_keys(hashes: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes for each window of ``k`` words: sums of word hashes by powers of a step, from running sums."""
    n = max(0, len(hashes) - k + 1)
    out = []
    for step in _STEPS:
        up, down = powers(step, len(hashes))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up, dtype=np.uint64)])
        out.append(mix((sums[k:] - sums[: len(sums) - k]) * down[:n]) if n else np.empty(0, np.uint64))
    return out[0], out[1]


@dataclass(frozen=True)
class Hashing:
    """Bits of the key that count, and the type of what stands beside it; tests force collisions of keys with fewer bits."""

    k: int = K
    key_bits: int = 64
    check: str = "<u2"

    def edges(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, check = edge_keys(hashes, self.k)
        lost = np.uint64(64 - self.key_bits)
        return (keys >> lost) << lost, check.astype(self.check)


def grouped(keys: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a stable order by both, where in it each distinct pair begins, the place of each entry's pair among them)."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    begins = np.ones(len(keys), bool)
    begins[1:] = ordered[1:] != ordered[:-1]
    beside = check[order]
    if (~begins[1:] & (beside[1:] != beside[:-1])).any():  # keys collide
        order = np.lexsort((check, keys))
        begins[1:] |= check[order[1:]] != check[order[:-1]]
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(begins) - 1
    return order, np.flatnonzero(begins), which


class Edges:
    """The edges of one packed group: of each document in order of doc_id, and the distinct ones with their first place."""

    def __init__(self, table: pa.Table, hashing: Hashing, id_column: str = "doc_id"):
        self.table = table
        ids = table.column(id_column).combine_chunks().fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)
        self.ids = ids
        hashes, bounds = word_hashes(table.column("text").combine_chunks())
        self.n_words = np.diff(bounds)
        keys, check = hashing.edges(hashes)
        by_id = np.argsort(ids, kind="stable")
        counts = np.maximum(self.n_words - hashing.k + 1, 0)[by_id]  # windows inside each document
        self.rows = np.repeat(by_id, counts)
        self.at = np.arange(len(self.rows)) - np.repeat(np.cumsum(counts) - counts, counts)
        place = bounds[self.rows] + self.at
        keys, check = keys[place], check[place]
        order, begins, self.which = grouped(keys, check)
        first = order[begins]
        self.distinct, self.check = keys[first], check[first]
        self.first_id, self.first_at = ids[self.rows[first]], self.at[first]

    def columns(self) -> list[np.ndarray]:
        return [self.distinct, self.check, self.first_id, self.first_at.astype(np.uint32)]


class First:
    """Of equal edges the first place counts; a child hears of those that are earlier than its own."""

    raw = 1
    _reply = (np.dtype(np.uint32), np.dtype(np.int64), np.dtype(np.uint32))

    def __init__(self, hashing: Hashing):
        self.types = (np.dtype(np.uint64), np.dtype(hashing.check), np.dtype(np.int64), np.dtype(np.uint32))

    def merge(self, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        keys, check, ids, at = columns
        order, begins, which = grouped(keys, check)
        least = np.minimum.reduceat(ids[order], begins)
        sizes = np.diff(np.append(begins, len(keys)))
        place = np.minimum.reduceat(np.where(ids[order] == np.repeat(least, sizes), at[order], np.iinfo(np.uint32).max), begins)
        first = order[begins]
        return which, [keys[first], check[first], least, place]

    def patch(self, merged: list[np.ndarray], replies: list[tuple[int, int, bytes]]) -> None:
        for begin, n, data in replies:
            places, ids, at = unpack_columns(data, n, self._reply)
            merged[2][places.astype(np.int64) + begin], merged[3][places.astype(np.int64) + begin] = ids, at

    def answer(self, own: list[np.ndarray], places: np.ndarray, merged: list[np.ndarray], role: int) -> tuple[int, bytes]:
        later = np.flatnonzero(merged[2][places] < own[2])
        return len(later), pack_columns([later.astype(np.uint32), merged[2][places[later]], merged[3][places[later]]])

    def stats(self, merged: list[np.ndarray]) -> list[int]:
        return []


def compact(flags: np.ndarray, source_id: np.ndarray, source_at: np.ndarray, k: int = K) -> list[tuple[int, int, int, int]]:
    """Runs of repeated edges as spans (start, end, source doc_id, source word)."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    go_on = (at[1:] == at[:-1] + 1) & (source_id[at[1:]] == source_id[at[:-1]]) & (source_at[at[1:]] == source_at[at[:-1]] + 1)
    starts = at[np.append(True, ~go_on)]
    ends = at[np.append(~go_on, True)]
    return [(int(a), int(b) + k, int(source_id[a]), int(source_at[a])) for a, b in zip(starts, ends)]


def _solve(edges: Edges, replies: pa.Table, tree: Tree, how: First, k: int) -> list[tuple[np.ndarray, list[tuple[int, int, int, int]]]]:
    """(which words stay, spans) of each document of the group, in the table's order."""
    places = [edges.distinct, edges.check, edges.first_id.copy(), edges.first_at.copy()]
    how.patch(places, tree.ranges(replies, edges.distinct))
    window_id, window_at = places[2][edges.which], places[3][edges.which]
    flags = window_id < edges.ids[edges.rows]
    out: list = [(np.ones(n, bool), []) for n in edges.n_words.tolist()]
    bounds = np.flatnonzero(np.append(True, edges.rows[1:] != edges.rows[:-1])) if len(edges.rows) else np.empty(0, int)
    for a, b in zip(bounds.tolist(), [*bounds[1:].tolist(), len(edges.rows)]):
        if flags[a:b].any():
            stay, spans = out[edges.rows[a]]
            spans += compact(flags[a:b], window_id[a:b], window_at[a:b], k)
            for start, end, _, _ in spans:
                stay[start:end] = False
    return out


def _exchange(docs: DataFrame, id_column: str, hashing: Hashing, **shape: int) -> tuple[DataFrame, DataFrame, Tree, First]:
    groups = packed_groups(docs)
    tree, how = Tree.over(int(n_bytes_of(groups) / KEY_BYTES), **shape), First(hashing)

    def make(data: pa.Buffer, role: int) -> Sequence[np.ndarray]:
        return Edges(unpack_table(data), hashing, id_column).columns()

    replies = exchange(requests_of(groups, make, tree, how.raw), tree, how).where("child >= 0")
    free_shuffles(docs.sparkSession)  # here nothing refers to the requests any more
    return groups.select("gid", "docs"), replies.select(F.col("child").alias("gid"), "node", "n", "data"), tree, how


def _kept(text: str | None, stay: np.ndarray) -> bytes:
    words = words_of(text)
    return b" ".join(words if stay.all() else [w for w, s in zip(words, stay.tolist()) if s])


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("source_id", pa.int64()), ("source_start", pa.int64())]))


def repeated_passages(docs: DataFrame, hashing: Hashing = Hashing(), **shape: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and spans of each row of ``docs``; ``shape``: of the exchange's tree."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    groups, replies, tree, how = _exchange(rows, "doc_id", hashing, **shape)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        made = []
        for packed in left.column("docs"):
            edges = Edges(unpack_table(packed.as_buffer()), hashing)
            solved = _solve(edges, right, tree, how, hashing.k)
            made.append(
                pa.table({
                    "doc_id": edges.table.column("doc_id").combine_chunks(),
                    "n_words": pa.array(edges.n_words, pa.int64()),
                    "n_removed": pa.array([int((~stay).sum()) for stay, _ in solved], pa.int64()),
                    "kept_sha256": pa.array([hashlib.sha256(_kept(t, stay)).hexdigest() for t, (stay, _) in zip(edges.table.column("text").to_pylist(), solved)], pa.string()),
                    "spans": pa.array([[dict(zip(("start", "end", "source_id", "source_start"), s)) for s in spans] for _, spans in solved], SPANS),
                })
            )
        return pa.concat_tables(made)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long,source_id:long,source_start:long>>"
    return groups.groupBy("gid").cogroup(replies.groupBy("gid")).applyInArrow(run, schema)


def without_repeats(docs: DataFrame, hashing: Hashing = Hashing(), **shape: int) -> DataFrame:
    """``docs`` with the repeated words taken out of ``text``; a text that loses none stays as it is.  Any type of doc_id will do."""
    own = "q_id"
    while own in docs.columns:
        own += "_"
    keyed = docs.withColumn(own, F.col("doc_id").try_cast("long"))
    schema = docs.schema
    groups, replies, tree, how = _exchange(keyed, own, hashing, **shape)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        made = []
        for packed in left.column("docs"):
            table = unpack_table(packed.as_buffer())
            solved = _solve(Edges(table, hashing, own), right, tree, how, hashing.k)
            texts = [old if stay.all() else _kept(old, stay).decode("utf-8", "surrogatepass") for old, (stay, _) in zip(table.column("text").to_pylist(), solved)]
            at = table.column_names.index("text")
            made.append(table.set_column(at, table.schema.field(at), pa.array(texts, table.schema.field(at).type)).drop_columns([own]))
        return pa.concat_tables(made)

    return groups.groupBy("gid").cogroup(replies.groupBy("gid")).applyInArrow(run, schema)
