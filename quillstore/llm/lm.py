"""Language-model scores by deleted interpolation of word n-grams (unigrams and bigrams).

    p(w | h) = l2(b) c(h, w) / c(h) + l1(b) c(w) / N + l0(b) / (V + 1)

b is the bucket of c(h), by powers of two, and the weights of each bucket are learned by
expectation-maximisation on held-out counts: of the learning documents those with
crc32 mod 5 = 0 are deleted from the counts, and the weights maximise what the counts of
the others give them.  Scores then use the counts of all learning documents.

Counting and looking up is one exchange.  Each packed group of documents sends its
distinct n-grams, as sorted 64-bit keys with counts; equal ones are added up, and the
sums come back, so a very common n-gram is one entry of each group.  The
tables grow with the corpus and are never collected; the weights are learned from a
histogram of (bucket, quantised probabilities), which is bounded by its grid.

Defined results: a null or empty text is one token, the end; a document starts in the
context of an end; a null doc_id counts as the empty text in crc32, so it is learned
from; with nothing learned every score is 0; repeated rows are counted and scored each.
"""

from __future__ import annotations

import zlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_shuffles, mix, n_bytes_of, packed_groups, unpack_table, word_hashes
from .exchange import KEY_BYTES, Tree, exchange, pack_columns, requests_of, stats_of, unpack_columns

FOLDS, HELD_OUT, DELETED = 5, 1, 0
#: Roles of groups.
LEARN, TUNE, TEST = 0, 1, 2
BUCKETS = 48
#: Steps of the histogram's grid in one halving of a probability.
GRID = 4
ROUNDS = 60
END = np.uint64(0x5DEECE66D1CE4E5B)
ODD = np.uint64(1)


def fold(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


def roles(ids: pa.Array) -> np.ndarray:
    return np.array([{HELD_OUT: TEST, DELETED: TUNE}.get(fold(i), LEARN) for i in ids.to_pylist()], int)


class Grams:
    """The n-grams of one packed group; unigram keys are odd, bigram keys even."""

    def __init__(self, table: pa.Table):
        self.ids = table.column("doc_id").to_pylist()
        end = np.array([END], np.uint64)
        words, bounds = word_hashes(table.column("text").combine_chunks(), lower=True)
        tokens = np.insert(words, bounds[1:], END)  # one after each document's words
        self.starts = bounds[:-1] + np.arange(len(self.ids))
        before = np.concatenate([end, tokens[:-1]]) if len(tokens) else tokens  # what precedes a document's first token is an end, too
        unigrams = mix(tokens) | ODD
        bigrams = mix(before * np.uint64(0x9E3779B97F4A7C15) + tokens) & ~ODD
        self.n = len(tokens)
        self.distinct, self.which, self.counts = np.unique(np.concatenate([unigrams, bigrams]), return_inverse=True, return_counts=True)

    def look_up(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """c(w), c(h), c(h, w) of each token, by ``counts`` of the distinct keys."""
        of = counts[self.which]
        word, both = of[: self.n], of[self.n :]
        end = counts[np.searchsorted(self.distinct, mix(np.array([END], np.uint64)) | ODD)]
        return word, np.concatenate([end, word[:-1]]), both


class Counted:
    """Counts of equal keys add up: those of every learning document, and of those that are not deleted."""

    raw = 0
    types = (np.dtype(np.uint64), np.dtype(np.uint64), np.dtype(np.uint64))

    def merge(self, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        distinct, which = np.unique(columns[0], return_inverse=True)
        sums = [np.zeros(len(distinct), np.uint64) for _ in columns[1:]]
        for total, column in zip(sums, columns[1:]):
            np.add.at(total, which, column)
        return which, [distinct, *sums]

    def patch(self, merged: list[np.ndarray], replies: list[tuple[int, int, bytes]]) -> None:
        for begin, n, data in replies:
            merged[1][begin : begin + n], merged[2][begin : begin + n] = unpack_columns(data, n, self.types[1:])

    def answer(self, own: list[np.ndarray], places: np.ndarray, merged: list[np.ndarray], role: int) -> tuple[int, bytes]:
        """Both counts to a node (its role is -1) and to a group of deleted documents, else the first."""
        counts = [c[places] for c in merged[1 : 3 if role in (-1, TUNE) else 2]]
        return len(places), pack_columns(counts)

    def stats(self, merged: list[np.ndarray]) -> list[int]:
        words = (merged[0] & ODD).astype(bool)
        return [int(x) for c in merged[1:] for x in ((c[words] > 0).sum(), c[words].sum())]


STATS = ("vocabulary", "tokens", "vocabulary_learned", "tokens_learned")


def _columns(data: pa.Buffer, role: int) -> list[np.ndarray]:
    """What a group sends: its distinct keys, and their counts where it is learned from."""
    grams = Grams(unpack_table(data))
    counts = grams.counts.astype(np.uint64)
    none = np.zeros_like(counts)
    return [grams.distinct, none if role == TEST else counts, counts if role == LEARN else none]


def _counts(replies: pa.Table, grams: Grams, role: int, column: int, tree: Tree) -> np.ndarray:
    """The replies to one group, put together in the order of its keys."""
    types = Counted.types[1 : 3 if role == TUNE else 2]
    parts = [unpack_columns(data, n, types)[column] for _, n, data in tree.ranges(replies, grams.distinct)]
    out = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    assert len(out) == len(grams.distinct), "a reply is missing"
    return out.astype(np.float64)


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else 1 + the power of two of their count."""
    return np.where(context > 0, np.minimum(1 + np.floor(np.log2(np.maximum(context, 1))), BUCKETS - 1), 0).astype(int)


def probabilities(word: np.ndarray, context: np.ndarray, both: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray]:
    return np.divide(both, context, out=np.zeros_like(both), where=context > 0), word / max(tokens, 1)


HISTOGRAM = "bucket int, q2 int, q1 int, n long, s2 double, s1 double"


def _histogram(word: np.ndarray, context: np.ndarray, both: np.ndarray, tokens: int) -> pa.Table:
    p2, p1 = probabilities(word, context, both, tokens)
    grid = lambda p: np.where(p > 0, np.floor(-GRID * np.log2(np.where(p > 0, p, 1))), -1).astype(np.int64)
    code, which = np.unique((bucket(context) << 40) + (grid(p2) + 1 << 20) + grid(p1) + 1, return_inverse=True)
    sums = [np.bincount(which, x, len(code)) for x in (np.ones_like(p1), p2, p1)]
    return pa.table({
        "bucket": pa.array(code >> 40, pa.int32()), "q2": pa.array((code >> 20) & 0xFFFFF, pa.int32()), "q1": pa.array(code & 0xFFFFF, pa.int32()),
        "n": pa.array(sums[0].astype(np.int64)), "s2": pa.array(sums[1]), "s1": pa.array(sums[2]),
    })


def learn_weights(cells: np.ndarray, vocabulary: int) -> np.ndarray:
    """(BUCKETS, 3) weights l2, l1, l0 from rows (bucket, n, mean p2, mean p1), by expectation-maximisation."""
    weights = np.tile([0.3, 0.6, 0.1], (BUCKETS, 1))
    weights[0] = [0.0, 0.9, 0.1]
    seen = set()
    for b in np.unique(cells[:, 0].astype(int)) if len(cells) else []:
        own = cells[cells[:, 0] == b]
        p = np.column_stack([own[:, 2], own[:, 3], np.full(len(own), 1 / (vocabulary + 1))])
        w = np.full(3, 1 / 3) if b else np.array([0.0, 0.5, 0.5])
        for _ in range(ROUNDS):
            share = w * p
            w = (own[:, 1] @ (share / share.sum(axis=1, keepdims=True))) / own[:, 1].sum()
        w = 0.9999 * w + 0.0001 * np.array([0.0, 0.0, 1.0])  # no token gets probability 0
        weights[b] = w / w.sum()
        seen.add(int(b))
    for b in range(2, BUCKETS):  # a bucket that no held-out token met takes the next lower one's
        if seen and b not in seen:
            weights[b] = weights[b - 1]
    return weights


class Model:
    """The exchange's tables and the weights, ready to score the groups they were made from."""

    def __init__(self, groups: DataFrame, **shape: int):
        self.groups = groups
        self.tree, how = Tree.over(int(n_bytes_of(groups) / KEY_BYTES), **shape), Counted()
        self.replies = exchange(requests_of(groups, _columns, self.tree, how.raw), self.tree, how)
        free_shuffles(groups.sparkSession)  # here nothing refers to the requests any more
        sums = stats_of(self.replies, STATS)
        self.vocabulary, self.tokens, tokens_learned = sums["vocabulary"], sums["tokens"], sums["tokens_learned"]
        self.weights = self._learn(sums["vocabulary_learned"], tokens_learned)

    def _learn(self, vocabulary: int, tokens: int) -> np.ndarray:
        if not self.tokens:
            return np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))
        tree = self.tree

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            made = []
            for packed in left.column("docs"):
                grams = Grams(unpack_table(packed.as_buffer()))
                made.append(_histogram(*grams.look_up(_counts(right, grams, TUNE, 1, tree)), tokens))
            return pa.concat_tables(made)

        own, answers = (df.where(F.col("role") == TUNE) for df in (self.groups, self._answers()))
        cells = own.select("gid", "docs").groupBy("gid").cogroup(answers.groupBy("gid")).applyInArrow(run, HISTOGRAM)
        rows = cells.groupBy("bucket", "q2", "q1").agg(F.sum("n").alias("n"), F.sum("s2").alias("s2"), F.sum("s1").alias("s1")).collect()  # bounded by the grid
        return learn_weights(np.array([[r["bucket"], r["n"], r["s2"] / r["n"], r["s1"] / r["n"]] for r in rows]).reshape(-1, 4), vocabulary)

    def score(self) -> DataFrame:
        """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document."""
        tokens, vocabulary, weights, tree = self.tokens, self.vocabulary, self.weights, self.tree

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            made = []
            for packed, role in zip(left.column("docs"), left.column("role").to_pylist()):
                grams = Grams(unpack_table(packed.as_buffer()))
                word, context, both = grams.look_up(_counts(right, grams, role, 0, tree))
                p2, p1 = probabilities(word, context, both, tokens)
                w = weights[bucket(context)]
                logs = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (vocabulary + 1))
                base = np.log10((word + 0.5) / (tokens + 0.5 * (vocabulary + 1)))
                add = lambda x: np.add.reduceat(x, grams.starts)
                n = len(grams.ids)
                made.append(
                    pa.table({
                        "doc_id": pa.array(grams.ids, pa.int64()), "held_out": pa.array([fold(i) == HELD_OUT for i in grams.ids], pa.bool_()),
                        "n_tokens": pa.array(np.diff(np.append(grams.starts, grams.n))), "n_known": pa.array(add((word > 0).astype(np.int64))),
                        "train_tokens": pa.array(np.full(n, tokens, np.int64)), "base_score": pa.array(add(base)), "score": pa.array(add(logs)),
                    })
                )
            return pa.concat_tables(made)

        schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        return self.groups.select("gid", "role", "docs").groupBy("gid").cogroup(self._answers().groupBy("gid")).applyInArrow(run, schema)

    def _answers(self) -> DataFrame:
        return self.replies.where("child >= 0").select(F.col("child").alias("gid"), "role", "node", "n", "data")


def score_documents(docs: DataFrame) -> DataFrame:
    """Learn from and score ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return Model(packed_groups(rows, roles)).score()
