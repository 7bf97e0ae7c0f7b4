"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints have 64 bits; two link at ``RADIUS`` or fewer differing bits.  Each bit
place gets a nonzero vector over GF(2) of RADIUS + 1 components; each nonzero vector v
gives a mask of the places whose vector has inner product 1 with v.  For any RADIUS
places there is a v orthogonal to all their vectors, so the mask of v holds none of
them: every pair within the radius agrees on some mask, and no link is lost.

Work is done on distinct fingerprints, each with its smallest doc_id.  A bucket (mask,
masked value) with more than ``BLOCK`` fingerprints is cut into blocks and each pair of
blocks is a task of its own, so no group meets in one task.  A task emits, for its
bucket, the edges of a spanning forest, never all pairs.  Components come from
alternating large-star and small-star rounds over tables in the shared folder.

Defined results: a null or empty text has no words, and a text without words has
fingerprint zero and links like any other; a null doc_id is never a component's id
unless all its documents have none; repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, materialize, remove, words_of

RADIUS, BITS, SHINGLE, SEED = 4, 64, 4, 42
#: Fingerprints that one side of a comparison task holds at most, about.
BLOCK = 4096
#: Buckets up to this size go many to a batch; larger ones are groups of their own.
SMALL = 64


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The covering masks: 2**(radius + 1) - 1 of them, each with about half of the bits."""
    size = 1 << (radius + 1)
    vectors = [1 + place % (size - 1) for place in range(bits)]
    return [sum(1 << place for place, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, size)]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = words_of(text, lower=True)
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*(words[k:] for k in range(shingle)))))
    digest, seed = xxhash.xxh64_intdigest, SEED
    hashes = np.array([digest(g, seed) for g in grams], dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *keys: str) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and the text columns ``keys`` of each row of ``docs``."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *keys])

    schema = ", ".join(["doc_id long, fp long", *(f"{k} string" for k in keys)])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *keys).mapInArrow(run, schema)


def _forest(a: np.ndarray, b: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that span what links within ``radius`` join, among the fingerprints of ``a`` and ``b`` (``b`` may be ``a``)."""
    own = a is b
    every = a if own else np.concatenate([a, b])
    shift = 0 if own else len(a)
    root = list(range(len(every)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    edges = []
    for i in range(len(a)):
        rest = b[i + 1 :] if own else b
        near = np.flatnonzero(np.bitwise_count(rest ^ a[i]) <= radius)
        for j in near.tolist():
            k = j + (i + 1 if own else shift)
            x, y = find(i), find(k)
            if x != y:
                root[max(x, y)] = min(x, y)
                edges.append((int(every[i]), int(every[k])))
    return edges


def links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(a, b): edges between fingerprints of ``distinct`` (fp) that connect just what links of ``radius`` bits connect."""
    tables = [m - (1 << 64) if m >> 63 else m for m in masks(radius)]
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in tables])).alias("mask", "value"))
    sizes = keyed.groupBy("mask", "value").agg(F.count("*").alias("n")).where("n > 1")
    # Spark takes the exploded side for as small as what it is made from, and would send all its rows to the driver to broadcast it.
    shared = keyed.hint("merge").join(sizes, ["mask", "value"]).withColumn("blocks", F.ceil(F.col("n") / F.lit(block)).cast("int"))
    shared = shared.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))

    def compare(group: pa.Table) -> pa.Table:
        fp = group.column("fp").to_numpy().view(np.uint64)
        lo, hi, own = (group.column(c).to_numpy() for c in ("lo", "hi", "own"))
        if lo[0] == hi[0]:
            edges = _forest(fp, fp, radius)
        else:
            edges = _forest(fp[own == lo], fp[own == hi], radius)
        both = np.array(edges, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.table({"a": both[:, 0], "b": both[:, 1]})

    def compare_small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets of two to a few, as arrays: many in a batch."""
        for batch in batches:
            edges = []
            for values in batch.column(0).to_pylist():
                fp = np.array(values, dtype=np.int64).view(np.uint64)
                edges += _forest(fp, fp, radius)
            both = np.array(edges, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    small = shared.where(F.col("n") <= SMALL).groupBy("mask", "value").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(compare_small, "a long, b long")
    # A bucket of n has ceil(n / block) blocks; a fingerprint goes to each pair of blocks that holds its own.
    large = shared.where(F.col("n") > SMALL)
    large = large.select("fp", "mask", "value", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    large = large.select("fp", "mask", "value", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own")
    large = large.groupBy("mask", "value", "lo", "hi").applyInArrow(compare, "a long, b long")
    return small.union(large).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of ``edges`` (a, b).

    Alternating large-star and small-star: both keep the components, and they end in
    stars.  Each round is a table in the shared folder; nothing is collected but counts.
    The joins are left ones, so that Spark may broadcast a row for each node, never the edges.
    """
    current = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a", "left").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = large.where("a <> b").distinct()
        down = stars.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a", "left").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        old, current = current, materialize(small.where("a <> b").distinct(), "edges")
        remove(old)
        now = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if before == (now["n"], now["s"]):
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = (now["n"], now["s"])


def _classes(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, root, component_id) of each distinct fingerprint of ``prints`` (doc_id, fp)."""
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(links(distinct.select("fp"), radius))
    classes = distinct.join(found, distinct.fp == found.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    classes = materialize(classes, "classes")
    # Both sides of the join are read from tables, so that a root with very many fingerprints can be split over tasks.
    heads = materialize(classes.groupBy("root").agg(F.min("first").alias("component_id")), "heads")
    return classes.join(heads, "root", "left").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each row of ``docs``."""
    prints = materialize(fingerprints(docs), "fingerprints")
    labelled = _classes(prints, radius).select("fp", "component_id")
    # A left join: of very many copies the table of fingerprints is a small file, and Spark would broadcast its rows.
    return prints.join(labelled, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Just one row of ``docs`` for each component: its smallest doc_id, null after all others; of those rows the first by text.

    Rows are told apart by a 128-bit key of doc_id and text, so a component has its row
    whatever its doc_ids are.  Equal keys are merged before any join, so no group of
    rows without ids meets in one task.  Texts are compared only where rows tie.
    """
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    key = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(F.concat(F.lit(" "), text), F.lit(""))))
    prints = materialize(fingerprints(docs.withColumn("__key", key), "__key"), "fingerprints")
    labelled = prints.join(_classes(prints, radius), "fp", "left")
    heads = labelled.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("root", F.col("__key").alias("key")).distinct()
    heads = materialize(heads, "heads")
    tied = heads.join(heads.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root"), "root")
    if not tied.isEmpty():
        texts = docs.select(key.alias("key"), text.alias("text")).groupBy("key").agg(F.min("text").alias("text"))
        first = tied.join(texts, "key").groupBy("root").agg(F.min(F.struct("text", "key")).alias("least"))
        heads = heads.join(first, "root", "left").where("least IS NULL OR least.key = key")
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key"))
    return boxed.groupBy("key").agg(F.first("row").alias("row")).join(heads.select("key").hint("merge"), "key", "left_semi").select("row.*")
