"""Each operator against a brute-force version, on small tables with the awkward cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillstore.llm import bpe, common, exchange, lm, packing, pii, quality, simhash, substring, token_counts, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def texts():
    rng = random.Random(5)
    vocabulary = ["The", "river", "über", "señal", "ça", "of", "and", "a", "stone", "#x", "42", "don't", "日本", "é", "Łódź"]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    out = [None, "", " \n\t ", "one", "word " * 40, passage, passage + " more", "start " + passage[30:], passage]
    out += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 120))) for _ in range(30)]
    out += ["x" * 5000, "line one\nline one\n\nline one\r\nother", "a\x1cb\x85c d", "<|endoftext|> in <|startoftext|>text", " ".join(str(i) for i in range(3000))]
    out += [rng.choice(out[5:9]) + f" {i}" for i in range(10)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 % 101, t, i) for i, t in enumerate(texts())]
    rows += [rows[5], rows[5], (None, texts()[5], 1), (None, None, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def words(text):
    return WORD.findall(text or "")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_topk(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-2, 2) for _ in range(11)], i) for i in range(400)]
    rows += [(i, rows[7][1], 0) for i in range(400, 500)]  # a common vector
    rows += [(500, None, 0), (501, [1.0, None], 0), (502, [float("nan")] * 11, 0), (503, [float("inf")] * 11, 0), (None, rows[0][1], 0), (504, [], 0), (600, [3.0, 1.0], 0), (601, [1.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").repartition(5)
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = [(i, np.floor(1024 * np.array(v)).astype(int)) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for q, x in good:
        if q % 100 == 0:
            best = sorted((-int(x @ y), i) for i, y in good if i != q and len(x) == len(y))[:10]
            assert got[q] == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert topk.top_k(df.limit(0), df.limit(0)).collect() == []


def test_topk_prunes_pairs(spark, sf):
    """Most pairs of the test vectors, which have no clusters, are told apart by bounds; of clustered ones nearly all."""
    rows = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/embeddings.parquet").collect()
    vectors = [(r.vec_id, r.embedding) for r in rows if r.embedding and all(x is not None and math.isfinite(x) for x in r.embedding)]
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 64))
    clustered = [(i, (centres[i % 40] + rng.normal(0, 0.1, 64)).tolist()) for i in range(2000)]
    for given, least in ((vectors, 0.8), (clustered, 0.95)):
        ids = np.array([i for i, _ in given])
        x = np.floor(1024 * np.array([v for _, v in given])).astype(np.int64)
        column = pa.array(x.astype(float).tolist())
        asked = np.flatnonzero(ids % 100 == 0)
        (tile,) = topk.tiles_of(ids[asked], column.take(pa.array(asked)), ids[::4], column.take(pa.array(np.arange(0, len(ids), 4))), 10)[64]
        for at in range(0, len(x), 300):
            tile.take(ids[at : at + 300], x[at : at + 300])
        assert tile.pairs == len(asked) * len(ids)
        assert 1 - tile.scored / tile.pairs >= least
        for q, best in zip(asked, tile.best):
            scores = x @ x[q]
            want = sorted((-int(scores[j]), int(ids[j])) for j in range(len(ids)) if j != q)[:10]
            assert [(-s, -i) for s, i in best] == want


def test_topk_in_blocks(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, rng.normal(size=9).tolist()) for i in range(300)], "vec_id long, embedding array<double>").repartition(4)
    want = sorted(map(tuple, topk.top_k(df, df.where("vec_id % 5 = 0"), k=4).collect()))
    assert sorted(map(tuple, topk.top_k(df, df.where("vec_id % 5 = 0"), k=4, block=7).collect())) == want


def test_topk_huge_components(spark):
    df = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 1.0]), (2, [-1e30, 0.0])], "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(1, 2**63 - 1), (2, -(2**63))]


def test_bpe(docs, empty):
    library = bpe.encoder(BPE, public_tokenizers.PATTERN)._plain
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_documents(docs, BPE, public_tokenizers.PATTERN).collect())
    want = Counter()
    for d, t in rows_of(docs):
        ids = library.encode_ordinary(t or "")
        want[d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want
    assert bpe.encode_documents(empty, BPE, public_tokenizers.PATTERN).collect() == []


def test_bpe_tree_with_tiny_leaves():
    small = bpe.ByteBpe(BPE, public_tokenizers.PATTERN, leaf_chars=5, leaf_bytes=3)
    rng = random.Random(2)
    for _ in range(1500):
        t = "".join(rng.choice("ab 's\n\t  xé😀1२,.!'re'll　ᰀqwertzu") for _ in range(rng.randint(0, 80)))
        assert small.encode(t) == small._plain.encode_ordinary(t)
        assert small.decode(small.encode(t)) == t.encode()


def test_substring(docs, empty):
    rows = rows_of(docs)
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - 12):
            key = tuple(w[i : i + 13])
            first[key] = min(first.get(key, substring.LAST), substring.LAST if d is None else d)
    want = Counter()
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < (substring.LAST if d is None else d):
                gone.update(range(i, i + 13))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want[d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    out = substring.repeated_passages(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out) == want
    assert sum(r.n_removed for r in out) > 100
    by_id = {d: words(t) for d, t in rows}
    for r in out:
        for s in r.spans:
            assert by_id[r.doc_id][s.start : s.end] == by_id[s.source_id][s.source_start : s.source_start + s.end - s.start]
    assert substring.repeated_passages(empty).collect() == []
    kept = substring.without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert substring.without_repeats(empty).collect() == []


def removed(df):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def test_substring_over_many_groups_and_levels(docs, monkeypatch):
    want = removed(substring.repeated_passages(docs))
    whole = common.packed_groups
    monkeypatch.setattr(substring, "packed_groups", lambda d: whole(d, group_bytes=600))
    assert removed(substring.repeated_passages(docs)) == want
    shape = {"bits": 2, "node_keys": 40}
    assert len(exchange.Tree.over(10_000, **shape).blocks) > 2
    assert removed(substring.repeated_passages(docs, **shape)) == want
    # Keys of a few bits collide all over; the hash beside them tells edges apart, inside a group and across groups.
    assert removed(substring.repeated_passages(docs, substring.Hashing(key_bits=3, check="<u8"), bits=2, node_keys=10**6)) == want
    assert removed(substring.repeated_passages(docs, substring.Hashing(key_bits=9, check="<u8"), **shape)) == want


def test_substring_takes_any_type_of_id(spark, docs):
    want = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in substring.without_repeats(docs).collect())
    for kind in ("int", "string", "decimal(20,0)"):
        out = substring.without_repeats(docs.withColumn("doc_id", F.col("doc_id").cast(kind)))
        assert dict(out.dtypes)["doc_id"] == kind
        assert sorted((r.doc_id is None, int(r.doc_id or 0), r.text or "") for r in out.collect()) == want
    same = " ".join(map(str, range(20)))
    odd = spark.createDataFrame([("x", same, 1), ("7", same, 2), (None, same, 3)], "doc_id string, text string, q_id int")
    assert {(r.doc_id, r.text) for r in substring.without_repeats(odd).collect()} == {("7", same), ("x", ""), (None, "")}


def test_exchange_runs():
    rng = np.random.default_rng(1)
    for n in (1, 2, 700):
        keys = np.sort(rng.integers(0, 2**64, n, dtype=np.uint64))
        columns = [keys, rng.integers(0, 2**16, n).astype("<u2"), rng.integers(-(2**62), 2**62, n), np.arange(n, dtype=np.uint32)]
        back = exchange.unpack_run(exchange.pack_run(columns, 1), n, [c.dtype for c in columns], 1)
        assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(columns, back))
        tree = exchange.Tree(3, (4, 1))
        sent = tree.send(5, 0, columns, 1)
        assert sum(sent.column("n").to_pylist()) == n and sent.num_rows <= 8
        assert [a for a, _, _ in tree.ranges(pa.Table.from_batches([sent]), keys)] == sorted({int(x) for x in np.searchsorted(keys >> np.uint64(61), np.unique(keys >> np.uint64(61)))})
    assert exchange.Tree.over(10**9).blocks == (1,) and exchange.Tree.over(10**13).blocks[1:] == (1,)


def test_windows_by_running_sums():
    rng = random.Random(3)
    w = [str(rng.randint(0, 3)) for _ in range(9000)]
    hashes, _ = common.word_hashes(pa.array([" ".join(w)]))
    keys, check = substring.edge_keys(hashes)
    assert len(keys) == len(check) == len(w) - 12
    again = substring.edge_keys(hashes[4000:4013])
    assert keys[4000] == again[0][0] and check[4000] == again[1][0]
    assert len(set(keys.tolist())) == len(set(check.tolist())) == len({tuple(w[i : i + 13]) for i in range(len(w) - 12)})
    assert [len(x) for x in substring.edge_keys(hashes[:12])] == [0, 0]


def test_word_hashes(monkeypatch):
    rng = random.Random(5)
    found = [t for t in texts() for _ in range(2)] + ["A\x00 b\u00a0c \x1c d", "x" * 70, " ", None, "", "".join(rng.choice("aB \n\t\r\x0b\x0cé") for _ in range(3000))]
    for size in (common._HASH_BYTES, 7):
        monkeypatch.setattr(common, "_HASH_BYTES", size)
        for lower in (False, True):
            hashes, bounds = common.word_hashes(pa.array(found, pa.string())[1:], lower)
            lists = [words(low(t) if lower else t) for t in found[1:]]
            assert np.diff(bounds).tolist() == [len(x) for x in lists]
            by_hash = dict(zip(hashes.tolist(), (x for own in lists for x in own)))
            assert [by_hash[h] for h in hashes.tolist()] == [x for own in lists for x in own]
            assert len(by_hash) == len({x for own in lists for x in own})
    assert [len(x) for x in common.word_hashes(pa.array([], pa.string()))] == [0, 1]


def slow_fingerprint(text):
    w = words(low(text))
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reachable(fps, radius=4):
    """fingerprint -> all in its component."""
    left, out = set(fps), {}
    while left:
        todo = [left.pop()]
        found = set(todo)
        while todo:
            x = todo.pop()
            near = {y for y in left if (x ^ y).bit_count() <= radius}
            left -= near
            found |= near
            todo += near
        for x in found:
            out[x] = found
    return out


def test_simhash(docs, empty):
    rows = [(d, slow_fingerprint(t)) for d, t in rows_of(docs)]
    classes = reachable({f for _, f in rows})
    want = Counter()
    for d, f in rows:
        ids = [e for e, g in rows if g in classes[f] and e is not None]
        want[d, f"{f:016x}", min(ids, default=None)] += 1
    assert Counter(tuple(r) for r in simhash.near_duplicates(docs).collect()) == want
    assert simhash.near_duplicates(empty).collect() == []
    kept = simhash.one_of_each(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in want})
    assert kept.columns == docs.columns


def test_simhash_keeps_one_row_of_each_component(spark):
    rng = random.Random(11)
    alike = " ".join(f"w{rng.randrange(10**6)}" for _ in range(3000))
    a, b, c, d, e, f = (" ".join(f"{x}{rng.randrange(10**6)}" for _ in range(40)) for x in "abcdef")
    rows = [(None, a), (None, b), (None, b), (None, c), (7, d), (7, e), (5, alike), (7, alike + " more"), (None, alike), (None, None), (None, ""), (9, f), (9, f)]
    rows = [(i, t, n) for n, (i, t) in enumerate(rows)]
    given = spark.createDataFrame(rows, "doc_id long, text string, __key int").repartition(3)
    classes = reachable({slow_fingerprint(t) for _, t, _ in rows})
    first = {}
    for i, t, _ in rows:
        group = min(classes[slow_fingerprint(t)])
        first[group] = min(first.get(group, (True, 0, "~")), (i is None, i or 0, t or ""))
    assert len(first) == 8
    kept = simhash.one_of_each(given)
    assert kept.columns == given.columns
    assert Counter((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect()) == Counter(first.values())


def test_masks_cover_every_pair_within_the_radius():
    rng, masks = random.Random(3), simhash.masks()
    assert len(masks) == 31
    for _ in range(5000):
        errors = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(m & errors == 0 for m in masks)


def test_simhash_broadcasts_neither_rows_nor_their_buckets(spark, docs):
    """The driver would hold what is broadcast; Spark takes exploded rows, and rows in small files, for little."""
    plan = simhash.links(spark.range(1000).select(F.col("id").alias("fp")))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [mask" in plan and "BroadcastHashJoin" not in plan
    plan = simhash.near_duplicates(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Join [fp" in plan and "BuildLeft" not in plan


def test_simhash_broadcasts_no_kept_keys(spark, docs):
    plan = simhash.one_of_each(docs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [key" in plan and "BroadcastHashJoin" not in plan


def test_simhash_blocks_and_chains(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL", 8)
    rng, fps = random.Random(4), []
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(60):
            y = x
            for b in rng.sample(range(64), rng.choice([1, 2, 4, 5])):
                y ^= 1 << b
            fps.append(y)
            x = y if rng.random() < 0.5 else x
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    edges = simhash.links(spark.createDataFrame([(s,) for s in set(signed.values())], "fp long"), 4, 20)
    root = {r.node: r.root for r in simhash.components(edges).collect()}
    classes = reachable(set(fps))
    for f in fps:
        assert root.get(signed[f], signed[f]) == min(signed[g] for g in classes[f])


def test_token_counts_and_ids(docs, empty):
    library = Tokenizer.from_file(WORDS)
    want = Counter()
    for d, t in rows_of(docs):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[d, len((t or "").encode()), n, n > 2048] += 1
    assert Counter(tuple(r) for r in token_counts.count_tokens(docs, WORDS).collect()) == want
    assert token_counts.count_tokens(empty, WORDS).collect() == []
    rng = random.Random(6)
    count, ids = token_counts.counter(WORDS), packing.word_ids(WORDS)
    for i in range(1500):
        t = "".join(rng.choice("abS 's\n\t  xéÉ😀1२,.!'re　ᰀ\x1c\x1f\x85́᠎​ İΣς\x00") for _ in range(rng.randint(0, 60))) + "<|endoftext|>" * (i % 5 == 0)
        e = library.encode(t, add_special_tokens=False).ids
        assert count.count(t) == len(e)
        assert np.frombuffer(ids.ids(t), "<u4").tolist() == e


def test_piece_counts():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for t in texts():
        assert token_counts.counter(path).count(t or "") == (len(library.encode(t)) if t else 0)


def test_packing(docs, empty):
    library = Tokenizer.from_file(WORDS)
    out = packing.pack_documents(docs, WORDS, capacity=64).collect()
    want = Counter()
    for d, t in rows_of(docs):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            want[d, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    check_sequences([(r.sequence_id, r.offset, r.length) for r in out], 64)
    assert packing.pack_documents(empty, WORDS).collect() == []


def check_sequences(placed, capacity):
    filled = {}
    for s, offset, length in sorted(placed):
        assert filled.get(s, 0) == offset
        filled[s] = offset + length
        assert filled[s] <= capacity
    return len(filled)


def test_packing_plan():
    rng = random.Random(7)
    for _ in range(200):
        capacity = rng.choice([10, 30, 64])
        histogram = {n: rng.randint(1, 6) for n in rng.sample(range(1, capacity + 1), rng.randint(1, capacity))}
        rows, n = packing.plan(histogram, capacity)
        placed = []
        for length, count in histogram.items():
            own = [r for r in rows if r[0] == length]
            for rank in range(count):
                _, first_rank, first, each, offset = [r for r in own if r[1] <= rank][-1]
                step = rank - first_rank
                placed.append((first + step // each, offset + step % each * length, length))
        assert check_sequences(placed, capacity) == n
        large = sum(c for size, c in histogram.items() if 2 * size > capacity)
        assert n >= max(large, -(-sum(k * v for k, v in histogram.items()) // capacity))
        assert n <= 1.5 * max(large, sum(k * v for k, v in histogram.items()) / capacity) + 1


def slow_pii(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m.group())
        if 16 <= len(digits) <= 19 and pii.luhn(digits):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_pii_spans():
    rng = random.Random(8)
    for _ in range(4000):
        t = "".join(rng.choice("a1.2@-+ (%)9b3٣é45") for _ in range(rng.randint(0, 70)))
        assert [(s.kind, s.start, s.end) for s in pii.find_spans(t) if s.kind in pii.BASE_KINDS] == slow_pii(t)
    kinds = lambda t: [s.kind for s in pii.find_spans(t)]
    assert kinds("pay to GB82 WEST 1234 5698 7654 32 now") == ["iban"]
    assert kinds("pay to GB82 WEST 1234 5698 7654 33 now") == []
    assert kinds("my SSN is 123-45-6789.") == ["id"]
    assert kinds("part 123-45-6789 fits") == []
    assert kinds("card 4539 1488 0343 6467") == ["card"]
    assert pii.redact("write to a.b@c.org or +1 (555) 123-4567!") == "write to [EMAIL] or [PHONE]!"


def test_pii_ibans_beside_other_words():
    def ibans(text):
        return [text[s.start : s.end] for s in pii.find_spans(text) if s.kind == "iban"]

    de, gb = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"
    assert ibans(f"IBAN {de} BIC COBADEFFXXX") == [de]
    assert ibans("DE89370400440532013000 12 May") == ["DE89370400440532013000"]
    assert ibans(f"{de} {gb} OK") == [de, gb]
    assert ibans(f"AB12 ROOM {de} A") == [de]
    assert ibans(f"{de}x") == ibans(f"x{de}") == ibans("DE88 3704 0044 0532 0130 00 BIC") == []
    tail = 98 - int("".join(str(int(c, 36)) for c in "12345678901234567XX00")) % 97
    assert ibans(f"XX{tail:02d} 1234 5678 9012 3456 7 AND MORE") == [f"XX{tail:02d} 1234 5678 9012 3456 7"]  # no country of that name
    assert pii.redact(f"pay {de} BIC") == "pay [IBAN] BIC"


def test_pii_is_linear_in_long_runs():
    pii.find_spans("a" * 300_000 + "1" * 300_000 + "." * 100_000 + "1.1" * 100_000)


def test_pii_documents(docs, empty):
    out = pii.detect(docs).collect()
    assert len(out) == docs.count() and pii.detect(empty).collect() == []
    for r in out:
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (0, 0, 0, 0) or r.spans


def slow_scores(rows):
    """(doc_id, held out, tokens, known, N, base, score) of each row: weights by EM over single tokens, not a histogram."""
    tokens = lambda t: [*words(low(t)), None]
    of = {part: [tokens(t) for d, t in rows if lm.fold(d) in part] for part in ((0, 2, 3, 4), (2, 3, 4), (0,))}
    every, kept, deleted = of.values()

    def counts(texts):
        return Counter(w for t in texts for w in t), Counter(p for t in texts for p in zip([None, *t], t))

    (one, two), (one_kept, two_kept) = counts(every), counts(kept)
    n, n_kept, size, size_kept = sum(one.values()), sum(one_kept.values()), len(one), len(one_kept)
    bucket = lambda c: 0 if not c else 1 + int(math.log2(c))
    seen = {}
    for t in deleted:
        for h, w in zip([None, *t], t):
            c = one_kept[h]
            seen.setdefault(bucket(c), []).append((two_kept[h, w] / c if c else 0.0, one_kept[w] / n_kept if n_kept else 0.0, 1 / (size_kept + 1)))
    weights = {}
    for b in range(lm.BUCKETS):
        if b in seen:
            p, w = np.array(seen[b]), np.array([1 / 3] * 3 if b else [0, 0.5, 0.5])
            for _ in range(lm.ROUNDS):
                share = p * w
                w = (share / share.sum(axis=1, keepdims=True)).mean(axis=0)
            w = 0.9999 * w + np.array([0, 0, 0.0001])
            weights[b] = w / w.sum()
        else:
            weights[b] = weights[b - 1] if b > 1 and seen else np.array([0.3, 0.6, 0.1] if b else [0.0, 0.9, 0.1])
    out = []
    for d, t in rows:
        own = tokens(t)
        base = sum(math.log10((one[w] + 0.5) / (n + 0.5 * (size + 1))) for w in own)
        score = 0.0
        for h, w in zip([None, *own], own):
            l2, l1, l0 = weights[bucket(one[h])]
            score += math.log10(l2 * (two[h, w] / one[h] if one[h] else 0) + l1 * one[w] / n + l0 / (size + 1))
        out.append((d, lm.fold(d) == 1, len(own), sum(one[w] > 0 for w in own), n, base, score))
    return out


def close(got, want):
    """Equal rows, with floats of nine digits; the histogram's cells are means, so scores agree a little less closely."""
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 3))
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert tuple(a[:5]) == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=2e-3, abs=1e-2)


def test_lm(docs, empty, spark):
    rows = rows_of(docs)
    close([tuple(r) for r in lm.score_documents(docs).collect()], slow_scores(rows))
    assert lm.score_documents(empty).collect() == []
    one = spark.createDataFrame([(d, "a b") for d in range(200) if lm.fold(d) == 1][:3], "doc_id long, text string")
    assert [r.score for r in lm.score_documents(one).collect()] == [0, 0, 0]


def test_lm_over_many_groups_and_levels(docs):
    want = Counter((r.doc_id, r.n_known, r.train_tokens, round(r.base_score, 9), round(r.score, 9)) for r in lm.score_documents(docs).collect())
    groups = common.packed_groups(docs.select("doc_id", "text"), lm.roles, group_bytes=800)
    for shape in ({}, {"bits": 2, "node_keys": 50}):
        out = lm.Model(groups, **shape).score().collect()
        assert Counter((r.doc_id, r.n_known, r.train_tokens, round(r.base_score, 9), round(r.score, 9)) for r in out) == want


def test_lm_weights_maximise_the_held_out_likelihood():
    rng = np.random.default_rng(2)
    p = np.column_stack([rng.random(500) ** 4, rng.random(500) ** 8 / 5])
    n = rng.integers(1, 9, 500)
    w = lm.learn_weights(np.column_stack([np.full(500, 3), n, p]), 1000)[3]
    loss = lambda w: float(n @ np.log(w[0] * p[:, 0] + w[1] * p[:, 1] + w[2] / 1001))
    for _ in range(300):
        other = np.abs(w + rng.normal(0, 0.05, 3))
        assert loss(other / other.sum()) <= loss(w) + 0.5


def test_lm_gains_on_held_out_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = lm.Model(common.packed_groups(docs.select("doc_id", "text"), lm.roles))
    assert np.allclose(model.weights.sum(axis=1), 1)
    out = [r for r in model.score().collect() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_lm_is_a_distribution(spark):
    """The probabilities of all words of the vocabulary, and of an unknown one, add up to one."""
    rows = [(d, "the cat sat on the mat") for d in range(30)] + [(100 + d, "a cat ran") for d in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = lm.Model(common.packed_groups(df, lm.roles))
    learn = [t.split() for d, t in rows if lm.fold(d) != 1]
    count = Counter(w for t in learn for w in [*t, None])
    pairs = Counter(p for t in learn for p in zip([None, *t], [*t, None]))
    assert (model.tokens, model.vocabulary) == (sum(count.values()), len(count))
    for h in count:
        w2, w1, w0 = model.weights[lm.bucket(np.array([float(count[h])]))[0]]
        p = {w: w2 * pairs[h, w] / count[h] + w1 * count[w] / model.tokens + w0 / (model.vocabulary + 1) for w in [*count, "unknown"]}
        assert abs(sum(p.values()) - 1) < 1e-9


def slow_quality(t):
    w = words(t)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often, marked = Counter(windows), set()
    for i, x in enumerate(windows):
        if often[x] > 1:
            marked.update(range(i, i + 5))
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(marked)


def test_quality(docs, empty):
    want = Counter((d, *slow_quality(t)) for d, t in rows_of(docs))
    out = quality.judge(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out) == want
    for r in out:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in out if r.kept)
    assert quality.judge(empty).collect() == [] and quality.keep_good(empty).collect() == []


def test_quality_is_native(docs):
    plan = quality.judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_quality_stops_at_the_first_rejection(docs, monkeypatch):
    monkeypatch.setattr(quality, "order_rules", lambda docs, rules=quality.RULES: list(rules))
    bomb = quality.Rule("bomb", ("n_words",), "IF(n_words < 10, CAST(raise_error('a rejected row went on') AS BOOLEAN), false)")
    rules = (quality.RULES[0], bomb)
    want = Counter(d for d, t in rows_of(docs) if slow_quality(t)[0] >= 10)
    assert Counter(r.doc_id for r in quality.keep_good(docs, rules).collect()) == want
    assert Counter(r.doc_id for r in quality.judge(docs, rules).collect() if r.kept) == want
    with pytest.raises(Exception, match="a rejected row went on"):
        quality.keep_good(docs, rules[::-1]).collect()


def test_quality_orders_by_what_is_left_to_reject(spark):
    """After a rule that rejects all that another one does, the other one is worth nothing."""
    rows = [(i, "few words") for i in range(40)] + [(100 + i, "# " * 30 + " ".join(f"word{j}" for j in range(20))) for i in range(10)] + [(200 + i, " ".join(f"word{j}" for j in range(60))) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wide, narrow, other = quality.Rule("wide", ("n_words",), "n_words < 10"), quality.Rule("narrow", ("n_words",), "n_words < 9"), quality.Rule("other", ("n_words", "n_symbols"), "10 * n_symbols > n_words")
    names = [r.name for r in quality.order_rules(docs, (other, narrow, wide))]
    assert sorted(names) == ["narrow", "other", "wide"] and names.index("other") < 2


def test_packing_of_rows_that_are_all_alike(spark):
    docs = spark.createDataFrame([(None, "")] * 9000 + [(7, "one two three")] * 3000, "doc_id long, text string").repartition(3)
    out = packing.pack_documents(docs, WORDS, capacity=64).collect()
    assert len(out) == 12000
    sizes = [(r.sequence_id, r.offset, r.length) for r in out]
    assert check_sequences(sizes, 64) == -(-sum(n for _, _, n in sizes) // 64)


def test_pii_columns(docs):
    """The query's columns worked out from slow spans."""
    rng = random.Random(9)
    extra = ["".join(rng.choice("a1.2@-+ (%)9b3٣é45") for _ in range(60)) for _ in range(40)] + ["4539 1488 0343 6467, 10.0.0.1 and a@b.org, +1 555 123 4567"]
    given = docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame(list(enumerate(extra)), "doc_id long, text string"))
    want = Counter()
    for d, t in rows_of(given):
        spans = slow_pii(t or "")
        counts = [sum(kind == k for kind, _, _ in spans) for k in pii.BASE_KINDS]
        want[d, *counts, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()] += 1
    out = pii.detect(given).collect()
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in out) == want
    for r in out:
        own = [s.split(":") for s in r.spans.split(",") if s]
        base = [s for s in own if s[0] in pii.BASE_KINDS]
        assert hashlib.sha256(",".join(":".join(s) for s in base).encode()).hexdigest() == r.base_sha256
        order = [(pii.KINDS.index(k), int(a)) for k, a, _ in own]
        assert order == sorted(order) and len(r.scores) == len(own)


def test_very_long_texts(spark):
    """A text of megabytes, one word of a megabyte, and a text without a space go through every operator."""
    rng = random.Random(10)
    long = " ".join(rng.choice(["stone", "river", "über", "a1", "日本"]) + str(rng.randint(0, 9999)) for _ in range(200_000))
    rows = [(1, long), (2, long[700_000:900_000]), (3, "x" * 1_000_000), (4, "é" * 100_000), (5, None)]
    docs = spark.createDataFrame([(d, t, d, "k") for d, t in rows], "doc_id long, text string, n_tokens int, score string")
    library = Tokenizer.from_file(WORDS)
    ids = {d: len(library.encode(t or "", add_special_tokens=False).ids) for d, t in rows}
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, WORDS).collect()} == ids
    plain = bpe.encoder(BPE, public_tokenizers.PATTERN)._plain
    assert {r.doc_id: r.n_tokens for r in bpe.encode_documents(docs, BPE, public_tokenizers.PATTERN).collect()} == {d: len(plain.encode_ordinary(t or "")) for d, t in rows}
    assert {r.doc_id: r.fingerprint for r in simhash.near_duplicates(docs).collect()} == {d: f"{slow_fingerprint(t):016x}" for d, t in rows}
    by_id = {r.doc_id: r for r in substring.repeated_passages(docs).collect()}
    assert by_id[1].n_removed == 0 and by_id[2].n_removed >= by_id[2].n_words - 2 > 1000
    assert sum(r.length for r in packing.pack_documents(docs, WORDS).collect()) == sum(ids.values()) + len(rows)
    assert {r.doc_id: r.n_tokens for r in lm.score_documents(docs).collect()} == {d: len(words(t)) + 1 for d, t in rows}
    assert {r.doc_id: r.n_words for r in quality.judge(docs).collect()} == {d: len(words(t)) for d, t in rows}
    assert pii.detect(docs).count() == len(rows)
