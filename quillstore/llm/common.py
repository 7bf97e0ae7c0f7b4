"""Helpers shared by the operators: scratch tables, word splitting, hashing, packed groups.

Words are ``[^\\x20\\x09-\\x0D]+`` everywhere.  ``bytes.split()`` splits on exactly
those six characters and ``bytes.lower()`` changes exactly A-Z, so texts are
handled as UTF-8 bytes.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_root

#: Bytes of text that one packed group holds (a longer text is a group of its own).
GROUP_BYTES = 4 << 20
#: Entries of one generation of a worker's word cache.
CACHE_ENTRIES = 120_000

_ARROW = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def arrow_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by rows and bytes, so that long texts don't meet in one batch."""
    for key, value in _ARROW.items():
        spark.conf.set(key, value)


#: Folders of scratch tables, by the scopes that are open.
_SCOPES: list[list[str]] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    for scope in _SCOPES:
        scope.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def remove(*tables: DataFrame | str) -> None:
    """Delete scratch tables that nothing reads any more."""
    spark = SparkSession.getActiveSession()
    for table in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(table if isinstance(table, str) else table.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of finished jobs once the driver's JVM collects what refers to them; after a large exchange that is now.

    The session refers to the query it ran last, so another one, of one row, comes first.
    """
    spark.range(1).count()
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def scratch_scope() -> Iterator[list[str]]:
    """The folders that are made inside; what the caller leaves in the list is deleted at the end."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield made
    finally:
        _SCOPES.remove(made)
        remove(*made)


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


class Generations(dict):
    """key -> ``make(key)``, remembered within bounds.

    Two generations of ``entries`` each: a full one becomes the old one, and what is
    asked for again moves to the new one, so frequent keys stay.  Long keys are made
    each time.
    """

    def __init__(self, make: Callable, entries: int = CACHE_ENTRIES, longest: int = 64):
        self._make, self._entries, self._longest, self._old = make, entries, longest, {}

    def __missing__(self, key):
        value = self._old.pop(key, None)
        if value is None:
            value = self._make(key)
            if len(key) > self._longest:
                return value
        if len(self) >= self._entries:
            self._old = dict(self)
            self.clear()
        self[key] = value
        return value


#: The white space between words, and A-Z to a-z.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Odd, so multiplying loses nothing.
_BYTE_STEP = 0xC2B2AE3D27D4EB4F
#: Bytes of text whose words are hashed at once.
_HASH_BYTES = 1 << 20
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(step: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """step ** i and its inverses modulo 2 ** 64, for i below ``n``."""
    made = _POWERS.get(step)
    if made is None or len(made[0]) < n:
        bases = np.empty((2, max(n, 4096)), np.uint64)
        bases[0], bases[1] = step, pow(step, -1, 1 << 64)
        bases[:, 0] = 1
        made = _POWERS[step] = tuple(np.cumprod(bases, axis=1, dtype=np.uint64))
    return made[0][:n], made[1][:n]


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(a 64-bit hash of each word of all ``texts``, where each text's words begin among them, and their end).

    A word's hash is the sum of its bytes by powers of a step, mixed; whole texts are
    worked through in blocks of bytes, without a Python object for each word.
    """
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    cut = np.zeros(len(data) + 1, bool)  # a text begins here, so no word goes on
    cut[offsets] = True
    begins = ~space
    begins[1:] &= space[:-1] | cut[1:-1]
    ends = ~space
    ends[:-1] &= space[1:] | cut[1:-1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(stops, starts[i] + _HASH_BYTES, side="right")))
        low, own = starts[i], starts[i:j] - starts[i]
        part = data[low : stops[j - 1]]
        size = np.diff(np.append(own, len(part)))
        values = (_LOWER[part] if lower else part).astype(np.uint64) + np.uint64(1)
        values *= powers(_BYTE_STEP, int(size.max()))[0][np.arange(len(part)) - np.repeat(own, size)]
        values[space[low : stops[j - 1]]] = 0
        out[i:j] = mix(np.add.reduceat(values, own) ^ ((stops[i:j] - starts[i:j]).astype(np.uint64) << np.uint64(40)))
        i = j
    return out, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.copy()
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def pack_table(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack_table(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(data)).read_all()


PACKED = "gid long, role int, n_docs long, n_bytes long, docs binary"


def packed_groups(docs: DataFrame, role: Callable[[pa.Array], np.ndarray] | None = None, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``docs`` (doc_id, text, any others) as rows that hold groups of whole documents, written to the shared folder.

    Each task fills groups of about ``group_bytes`` from the rows that it reads, so no
    text is shuffled and no group grows with the input.  ``role`` maps doc_ids to small
    integers; a group holds documents of one role.  The group ids are settled once the
    table is written: later passes read them, they don't make them again.
    """
    arrow_batches(docs.sparkSession)
    at_id, at_text = docs.columns.index("doc_id"), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 32, 0
        held: dict[int, tuple[list, list]] = {}

        def flush(kind: int) -> pa.RecordBatch:
            nonlocal made
            parts, sizes = held.pop(kind)
            table = pa.Table.from_batches(parts)
            row = [base + made, kind, table.num_rows, sum(sizes), pack_table(table)]
            made += 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], ["gid", "role", "n_docs", "n_bytes", "docs"])

        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(at_text)), 0).to_numpy(zero_copy_only=False) + 64
            kinds = role(batch.column(at_id)) if role else np.zeros(batch.num_rows, int)
            for kind in np.unique(kinds).tolist():
                rows = np.flatnonzero(kinds == kind)
                part, start = batch.take(pa.array(rows)), 0
                for i, size in enumerate(sizes[rows].tolist()):
                    parts, total = held.setdefault(kind, ([], []))
                    total.append(size)
                    total[:] = [sum(total)]
                    if total[0] >= group_bytes or i + 1 == len(rows):
                        parts.append(part.slice(start, i + 1 - start))
                        start = i + 1
                        if total[0] >= group_bytes:
                            yield flush(kind)
        for kind in list(held):
            yield flush(kind)

    return materialize(docs.mapInArrow(run, PACKED), "groups")


def n_bytes_of(groups: DataFrame) -> int:
    return groups.agg(F.sum("n_bytes").alias("n")).first()["n"] or 0
