"""An exchange of sorted 64-bit keys between groups, in a tree of fixed fan-out.

Each group of documents is a child that holds distinct keys in order, with values beside
them.  It cuts the key space into ``2 ** bits`` ranges and sends one run to each, so what
it sends is the same number of rows whatever the corpus.  Where one range would hold
more keys than a task should, the node for it is split into blocks of children; a block
merges its runs and sends them on, cut into ``2 ** bits`` finer ranges.  Answers come
back the same way, each in the order of the keys that were sent, so no key is sent back.
Rows and bytes grow with the input, times the number of levels: one up to 8 billion
keys, two up to 10 ** 13.

An operator says how runs merge (``Merge``); see ``substring`` and ``lm``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, remove

#: Bits of the key that one level cuts by, and keys that one node holds at most, about.
BITS, NODE_KEYS = 11, 4_000_000
_BLOCK_BITS = 20
#: Low bytes of a step between keys, which are random and don't compress.
_RANDOM_BYTES = 5

REQUEST = "node long, child long, role int, n int, data binary"
REPLY = "child long, role int, node long, n int, data binary, stats array<long>"
_REQUEST_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
_REPLY_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())]


def _planes(array: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.ascontiguousarray(array).view(np.uint8).reshape(len(array), array.dtype.itemsize).T)


def pack_columns(columns: Sequence[np.ndarray]) -> bytes:
    """Arrays of equal length as byte planes under zstd: planes of equal bytes cost nothing."""
    return pa.compress(b"".join(_planes(c).tobytes() for c in columns), codec="zstd", asbytes=True) if len(columns[0]) else b""


def unpack_columns(data: bytes, n: int, types: Sequence[np.dtype]) -> list[np.ndarray]:
    if not n:
        return [np.empty(0, t) for t in types]
    raw = np.frombuffer(pa.decompress(data, n * sum(t.itemsize for t in types), codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for t in types:
        out.append(np.ascontiguousarray(raw[at : at + n * t.itemsize].reshape(t.itemsize, n).T).view(t).reshape(n))
        at += n * t.itemsize
    return out


def pack_run(columns: Sequence[np.ndarray], raw: int) -> bytes:
    """Sorted keys, ``raw`` columns of random bits, and others.  Keys go as steps; what can't be compressed stays outside zstd."""
    steps = _planes(np.diff(columns[0], prepend=np.uint64(0)))
    plain = [steps[:_RANDOM_BYTES], *(_planes(c) for c in columns[1 : 1 + raw])]
    rest = [steps[_RANDOM_BYTES:], *(_planes(c) for c in columns[1 + raw :])]
    return b"".join(x.tobytes() for x in plain) + pa.compress(b"".join(x.tobytes() for x in rest), codec="zstd", asbytes=True)


def unpack_run(data: bytes | pa.Buffer, n: int, types: Sequence[np.dtype], raw: int) -> list[np.ndarray]:
    outside = n * (_RANDOM_BYTES + sum(t.itemsize for t in types[1 : 1 + raw]))
    rest = pa.decompress(data[outside:], n * sum(t.itemsize for t in types) - outside, codec="zstd", asbytes=True)
    inside = np.frombuffer(rest, np.uint8)
    plain = np.frombuffer(data, np.uint8, outside)
    high = 8 - _RANDOM_BYTES
    steps = np.concatenate([plain[: n * _RANDOM_BYTES], inside[: n * high]]).reshape(8, n)
    out = [np.cumsum(np.ascontiguousarray(steps.T).view(np.uint64).reshape(n), dtype=np.uint64)]
    for part, at, own in ((plain, n * _RANDOM_BYTES, types[1 : 1 + raw]), (inside, n * high, types[1 + raw :])):
        for t in own:
            out.append(np.ascontiguousarray(part[at : at + n * t.itemsize].reshape(t.itemsize, n).T).view(t).reshape(n))
            at += n * t.itemsize
    return out


class Merge(Protocol):
    """How an operator's runs merge; instances go to the workers."""

    types: Sequence[np.dtype]  # of the columns that are sent, the sorted keys first
    raw: int  # how many columns after the keys are random bits

    def merge(self, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """(the place of each entry's key among the merged ones, the merged columns)."""

    def patch(self, merged: list[np.ndarray], replies: list[tuple[int, int, bytes]]) -> None:
        """Put the answers from above, (begin, n, data) of ranges of the merged keys in order, into ``merged``."""

    def answer(self, own: list[np.ndarray], places: np.ndarray, merged: list[np.ndarray], role: int) -> tuple[int, bytes]:
        """(n, data) for a child that sent ``own``; n is 0 if there is nothing to say."""

    def stats(self, merged: list[np.ndarray]) -> list[int]:
        """Numbers of a range, to be added up."""


@dataclass(frozen=True)
class Tree:
    """The shape of an exchange."""

    bits: int
    blocks: tuple[int, ...]  # of each level: into how many blocks a range is split; 1 at the last

    @classmethod
    def over(cls, n_keys: int, bits: int = BITS, node_keys: int = NODE_KEYS) -> Tree:
        blocks: list[int] = []
        while not blocks or blocks[-1] > 1:
            blocks.append(max(1, -(-n_keys // (node_keys << bits * (len(blocks) + 1)))))
        return cls(bits, tuple(blocks))

    def cuts(self, keys: np.ndarray, level: int = 0, prefix: int = 0) -> np.ndarray:
        """Where each range of ``level`` under ``prefix`` begins in the sorted ``keys``, and their end."""
        shift = np.uint64(64 - self.bits * (level + 1))
        bounds = ((np.uint64(prefix) << np.uint64(self.bits)) + np.arange(1, 1 << self.bits, dtype=np.uint64)) << shift
        return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])

    def send(self, child: int, role: int, columns: Sequence[np.ndarray], raw: int, level: int = 0, prefix: int = 0) -> pa.RecordBatch:
        """One run for each range that has keys."""
        cuts = self.cuts(columns[0], level, prefix)
        block = (child * 0x9E3779B97F4A7C15 >> 20) % self.blocks[level]
        rows: list[list] = [[], [], [], [], []]
        for i in np.flatnonzero(np.diff(cuts)).tolist():
            a, b = int(cuts[i]), int(cuts[i + 1])
            node = ((prefix << self.bits | i) << _BLOCK_BITS) | block
            for column, value in zip(rows, (node, child, role, b - a, pack_run([c[a:b] for c in columns], raw))):
                column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, _REQUEST_TYPES)], ["node", "child", "role", "n", "data"])

    def ranges(self, replies: pa.Table, keys: np.ndarray, level: int = 0, prefix: int = 0) -> list[tuple[int, int, bytes]]:
        """(begin, n, data) of the replies to the holder of the sorted ``keys``, in order."""
        cuts = self.cuts(keys, level, prefix)
        low = (1 << self.bits) - 1
        rows = zip(*(replies.column(c).to_pylist() for c in ("node", "n", "data")))
        return sorted((int(cuts[(node >> _BLOCK_BITS) & low]), n, data) for node, n, data in rows)


def _node(table: pa.Table, how: Merge) -> tuple[list[int], list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """(rows' sizes, their columns one after the other, the place of each entry among the merged, the merged columns)."""
    sizes = table.column("n").to_pylist()
    columns = [np.empty(sum(sizes), t) for t in how.types]
    at = 0
    for data, n in zip(table.column("data"), sizes):
        for column, part in zip(columns, unpack_run(data.as_buffer(), n, how.types, how.raw)):
            column[at : at + n] = part
        at += n
    return sizes, columns, *how.merge(columns)


def _replies(table: pa.Table, how: Merge, found: tuple, last: bool) -> pa.Table:
    sizes, columns, places, merged = found
    rows: list[list] = [[], [], [], [], [], []]
    at = 0
    for child, node, role, n in zip(*(table.column(c).to_pylist() for c in ("child", "node", "role")), sizes):
        m, data = how.answer([c[at : at + n] for c in columns], places[at : at + n], merged, role)
        at += n
        if m:
            for column, value in zip(rows, (child, role, node, m, data, None)):
                column.append(value)
    if last:
        for column, value in zip(rows, (-1, -1, table.column("node")[0].as_py(), 0, None, how.stats(merged))):
            column.append(value)
    return pa.table([pa.array(v, t) for v, t in zip(rows, _REPLY_TYPES)], names=["child", "role", "node", "n", "data", "stats"])


#: Bytes of text for each distinct key of a group, of windows or of words and pairs of words, as measured (6.8 to 7.1), less some room.
KEY_BYTES = 6.5


def exchange(requests: DataFrame, tree: Tree, how: Merge, level: int = 0) -> DataFrame:
    """The replies (REPLY) to ``requests`` (REQUEST), as a table of the shared folder; stats in rows of child -1."""
    if level + 1 == len(tree.blocks):

        def settle(table: pa.Table) -> pa.Table:
            return _replies(table, how, _node(table, how), True)

        return materialize(requests.groupBy("node").applyInArrow(settle, REPLY), "replies")
    requests = materialize(requests, "requests")  # read on the way up and on the way down

    def forward(table: pa.Table) -> pa.Table:
        node = table.column("node")[0].as_py()
        _, _, _, merged = _node(table, how)
        return pa.Table.from_batches([tree.send(node, -1, merged, how.raw, level + 1, node >> _BLOCK_BITS)])

    def back(table: pa.Table, replies: pa.Table) -> pa.Table:
        found = _node(table, how)
        node = table.column("node")[0].as_py()
        how.patch(found[3], tree.ranges(replies, found[3][0], level + 1, node >> _BLOCK_BITS))
        return _replies(table, how, found, False)

    above = exchange(requests.groupBy("node").applyInArrow(forward, REQUEST), tree, how, level + 1)
    answers = above.where("child >= 0").groupBy("child")
    below = requests.groupBy("node").cogroup(answers).applyInArrow(back, REPLY)
    out = materialize(below.union(above.where("child = -1")), "replies")
    remove(requests, above)
    return out


def requests_of(groups: DataFrame, make: Callable[[bytes, int], Sequence[np.ndarray]], tree: Tree, raw: int) -> DataFrame:
    """What the packed ``groups`` send; ``make`` gives a group's columns from its documents and role."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gid, role, docs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                yield tree.send(gid, role, make(docs.as_buffer(), role), raw)

    return groups.select("gid", "role", "docs").mapInArrow(run, REQUEST)


def stats_of(replies: DataFrame, names: Sequence[str]) -> dict[str, int]:
    """The sums of all ranges' numbers."""
    sums = [F.coalesce(F.sum(F.get("stats", F.lit(i))), F.lit(0)).alias(name) for i, name in enumerate(names)]
    return replies.where("child = -1").agg(*sums).first().asDict()
