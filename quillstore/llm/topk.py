"""Exact top-k search by inner product with multi-resolution segment statistics.

For a segment of length L with means m and deviations s (population), the inner product
of two vectors over it is at most L (m_q m_x + s_q s_x), which is the lower bound of
their distance turned round.  Vectors are first turned by an orthogonal matrix, which
changes no inner product, so that leading components carry most of the energy.  The
coarsest level is one segment; each finer one halves the last segment and resolves the
part before it to single components, whose means are exact.  A pair of query and
candidate goes on to the next level only while its bound reaches the query's k-th best
exact score so far; survivors are scored exactly, in integers, from the vectors as given.

The turn and the first k-th best scores come from a sample of at most ``SAMPLE_ROWS``
rows, spread by a hash of the id: it decides how many pairs are pruned, never a result.
Queries are taken in blocks of bounded size: each is broadcast to a scan over all rows,
its best rows are written, and the broadcast is released before the next.  A task keeps
k rows of each query; a window over (query) ends the search.

Defined results: components become floor(scale * x); vectors that are null, or hold null
or non-finite components, take no part; only vectors of equal length are compared; rows
with the query's own vec_id are not its candidates; a null vec_id takes no part;
repeated rows are candidates each; scores beyond a long are held at its limits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, materialize

#: Queries broadcast at once, and vector components of them at most.
QUERY_BLOCK, QUERY_COMPONENTS = 16_384, 4_000_000
#: Rows of the sample, and components of them at most; wider vectors than this are ordered by energy, not turned.
SAMPLE_ROWS, WIDEST_TURN = 4096, 1024
#: Queries and candidates compared at once.
TILE_QUERIES, TILE_ROWS = 512, 2048
#: Below this share of surviving pairs they are scored one by one, else as a whole tile.
FEW = 0.1


def levels(width: int) -> list[int]:
    """Where the last segment begins at each level, coarse to fine; the finest one has 4 components or more."""
    out = [0]
    while (width - out[-1]) // 2 >= 4:
        out.append(out[-1] + (width - out[-1]) // 2)
    return out


def turn(sample: np.ndarray) -> np.ndarray:
    """An orthogonal matrix that sorts the energy of ``sample`` (rows) to the front."""
    width = sample.shape[1]
    scaled = sample / max(1.0, np.abs(sample).max(initial=0))
    if width > WIDEST_TURN:
        return np.eye(width)[:, np.argsort(-(scaled**2).sum(axis=0), kind="stable")]
    return np.linalg.eigh(scaled.T @ scaled)[1][:, ::-1]


class Side:
    """Vectors of one length with the statistics of their last segments."""

    def __init__(self, x: np.ndarray, matrix: np.ndarray):
        self.x, self.real = x, x.astype(np.float64)
        self.turned = self.real @ matrix
        self.rest = []
        for at in levels(x.shape[1]):
            part = self.turned[:, at:]
            self.rest.append(np.column_stack([part.mean(axis=1), part.std(axis=1)]) * np.sqrt(part.shape[1]))
        self.most = float(np.abs(self.real).max(initial=0))
        self.norm = float(np.sqrt((self.real**2).sum(axis=1)).max(initial=0))


class Tile:
    """Queries of one length, and their best candidates so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, matrix: np.ndarray):
        self.ids, self.k, self.matrix, self.side = ids, k, matrix, Side(x, matrix)
        self.starts = levels(x.shape[1]) if x.shape[1] else []
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]  # (score, -vec_id), best first
        self.least = np.full(len(ids), -np.inf)
        self.pairs = self.scored = 0  # compared, and of those scored exactly

    def seed(self, ids: np.ndarray, x: np.ndarray) -> None:
        """The k-th best score among some candidates is a bound that the k-th best of all reaches."""
        scores = self._exact(Side(x, self.matrix)).astype(np.float64)
        scores[self.ids[:, None] == ids[None, :]] = -np.inf
        if len(ids) >= self.k:
            self.least = np.maximum(self.least, np.partition(scores, -self.k, axis=1)[:, -self.k])

    def _exact(self, other: Side) -> np.ndarray:
        most = self.side.most * other.most * max(other.x.shape[1], 1)
        if most < 2**53:
            return (self.side.real @ other.real.T).astype(np.int64)
        return self._whole(self.side.x, other.x, most)

    @staticmethod
    def _whole(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
        if most < 2**62:
            return a @ b.T
        found = a.astype(object) @ b.astype(object).T
        return np.clip(found, np.iinfo(np.int64).min, np.iinfo(np.int64).max).astype(np.int64)

    def _survivors(self, other: Side) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of each pair whose bounds reach the query's least score at every level."""
        margin = 1 + 1e-9 * self.side.norm * other.norm  # above any rounding
        q, r = np.arange(len(self.ids)), np.arange(len(other.x))
        alive = np.ones((len(q), len(r)), bool)
        partial, done = np.zeros(alive.shape), 0
        for at, own, theirs in zip(self.starts, self.side.rest, other.rest):
            if at > done:
                partial += self.side.turned[q, done:at] @ other.turned[r, done:at].T
                done = at
            alive &= partial + own[q] @ theirs[r].T + margin >= self.least[q, None]
            some_q, some_r = alive.any(axis=1), alive.any(axis=0)
            if not some_r.all() or not some_q.all():
                q, r = q[some_q], r[some_r]
                alive, partial = alive[some_q][:, some_r], partial[some_q][:, some_r]
            if not len(r):
                break
        at_q, at_r = np.nonzero(alive)
        return q[at_q], r[at_r]

    def take(self, ids: np.ndarray, x: np.ndarray) -> None:
        other = Side(x, self.matrix)
        q, r = self._survivors(other) if self.starts else np.nonzero(np.ones((len(self.ids), len(ids)), bool))
        self.pairs += len(self.ids) * len(ids)
        self.scored += len(q)
        if not len(q):
            return
        most = self.side.most * other.most * max(x.shape[1], 1)
        if len(q) > FEW * len(self.ids) * len(ids):
            scores = self._exact(other)[q, r]
        elif most < 2**62:
            scores = np.concatenate([np.einsum("ij,ij->i", self.side.x[q[i : i + 65536]], x[r[i : i + 65536]]) for i in range(0, len(q), 65536)])
        else:
            scores = np.array([self._whole(self.side.x[[a]], x[[b]], most)[0, 0] for a, b in zip(q.tolist(), r.tolist())], np.int64)
        own_ids = ids[r]
        keep = (scores >= self.least[q]) & (own_ids != self.ids[q])
        q, own_ids, scores = q[keep], own_ids[keep], scores[keep]
        order = np.lexsort((own_ids, -scores, q))  # the best first, ties to the smaller id
        q, own_ids, scores = q[order], own_ids[order], scores[order]
        bounds = np.append(np.flatnonzero(np.append(True, q[1:] != q[:-1])), len(q)) if len(q) else [0]
        for a, b in zip(bounds, bounds[1:]):
            at = q[a]
            b = min(b, a + self.k)
            best = sorted(self.best[at] + list(zip(scores[a:b].tolist(), (-own_ids[a:b]).tolist())), reverse=True)
            self.best[at] = best[: self.k]
            if len(best) >= self.k:
                self.least[at] = max(self.least[at], best[self.k - 1][0])


def quantised(vectors: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """(id, v): usable rows with their components as floor(scale * x)."""
    v = F.col(vector_column)
    usable = F.col(id_column).isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(usable).select(F.col(id_column).cast("long").alias("id"), F.transform(v, lambda x: x.cast("double") * F.lit(float(scale))).alias("v"))


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, their components) for each length among the lists of ``column``."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False))
    starts = np.append(0, np.cumsum(lengths))
    out = []
    for width in np.unique(lengths):
        rows = np.flatnonzero(lengths == width)
        values = flat[(starts[rows][:, None] + np.arange(width))]
        big = np.abs(values).max(initial=0) >= 2**62
        out.append((rows, np.clip(values, -(2.0**62), 2.0**62).astype(np.int64) if big else values.astype(np.int64)))
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_column: str = "vec_id", vector_column: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best rows of ``vectors`` for each row of ``queries``."""
    spark = vectors.sparkSession
    arrow_batches(spark)
    rows = quantised(vectors, id_column, vector_column, scale)
    asked = quantised(queries, id_column, vector_column, scale)
    shape = asked.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("w")).first()
    block = max(1, min(block, QUERY_COMPONENTS // max(shape["w"], 1)))
    n_blocks = max(1, -(-2 * shape["n"] // block) if shape["n"] > block else 1)
    spread = rows.orderBy(F.xxhash64("id"), "id").limit(max(1, min(SAMPLE_ROWS, QUERY_COMPONENTS // max(shape["w"], 1))))
    spread = spread.toArrow()
    sample = (spread.column("id").to_numpy(), spread.column("v").combine_chunks())
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = None
    for b in range(n_blocks):
        own = asked if n_blocks == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == b)
        table = own.toArrow()  # at most about a block
        shared = spark.sparkContext.broadcast((table.column("id").to_numpy(), table.column("v").combine_chunks(), *sample))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tiles = tiles_of(*shared.value, k)
            for batch in batches:
                for own_rows, x in _matrix(batch.column(1)):
                    own_ids = batch.column(0).to_numpy()[own_rows]
                    for at in range(0, len(x), TILE_ROWS):
                        for tile in tiles.get(x.shape[1], []):
                            tile.take(own_ids[at : at + TILE_ROWS], x[at : at + TILE_ROWS])
            for tile in (t for some in tiles.values() for t in some):
                out = [(int(q), -i, s) for q, best in zip(tile.ids, tile.best) for s, i in best]
                columns = list(zip(*out)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

        best = rows.mapInArrow(run, "query_id long, vec_id long, score long").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best = materialize(best.select("query_id", "rank", "vec_id", "score"), "best")
        shared.destroy()
        found = best if found is None else found.union(best)
    return found


def tiles_of(ids: np.ndarray, queries: pa.Array, sample_ids: np.ndarray, sample: pa.Array, k: int) -> dict[int, list[Tile]]:
    """Tiles of the queries by their length, with first scores from the sample."""
    whole = lambda column: column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    known = {x.shape[1]: (sample_ids[rows], x) for rows, x in _matrix(whole(sample))}
    tiles: dict[int, list[Tile]] = {}
    for rows, x in _matrix(whole(queries)):
        width = x.shape[1]
        near = known.get(width, (np.empty(0, np.int64), np.empty((0, width), np.int64)))
        matrix = turn(near[1].astype(np.float64)) if width else np.eye(0)
        for at in range(0, len(x), TILE_QUERIES):
            tile = Tile(ids[rows[at : at + TILE_QUERIES]], x[at : at + TILE_QUERIES], k, matrix)
            tile.seed(*near)
            tiles.setdefault(width, []).append(tile)
    return tiles
