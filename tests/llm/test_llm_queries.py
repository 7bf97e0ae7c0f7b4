"""The registered queries of the operators against their SQL, and the pipeline against a brute-force version."""

import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import zlib
from oracle import compare, connect
from test_operators import check_sequences, reachable, slow_fingerprint, slow_quality, words
from tokenizers import Tokenizer

import corpus_pipeline
from quillstore.llm import pii, queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, sf, name):
    assert compare(spark, connect(sf), queries.QUERIES[name], queries.ORACLE[name], sf) is None


def test_ten_operators():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))


def keeps(text):
    n, chars, symbols, twice, repeated = slow_quality(text)
    lines = len([x for x in text.split("\n") if words(x)])
    return not (n < 10 or 100 * repeated > 20 * n or 10 * symbols > n or 2 * twice > lines or chars < 2 * n or chars > 20 * n)


def slow_pipeline(rows):
    rows = [(d, t) for d, t in rows if keeps(t)]
    prints = {d: slow_fingerprint(t) for d, t in rows}
    classes = reachable(set(prints.values()))
    first = {}
    for d, f in prints.items():
        group = min(classes[f])
        first[group] = min(first.get(group, d), d)
    rows = [(d, t) for d, t in rows if first[min(classes[prints[d]])] == d]
    windows = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - 12):
            key = tuple(w[i : i + 13])
            windows[key] = min(windows.get(key, d), d)
    out = []
    for d, t in rows:
        w, gone = words(t), set()
        for i in range(len(w) - 12):
            if windows[tuple(w[i : i + 13])] < d:
                gone.update(range(i, i + 13))
        out.append((d, pii.redact(" ".join(x for i, x in enumerate(w) if i not in gone) if gone else t)))
    return out


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = slow_pipeline([(r.doc_id, r.text) for r in docs.collect()])
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = Counter()
    for d, t in want:
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            pieces[d, piece, at, zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())] += 1
    out = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.ids_crc32) for r in out) == pieces
    check_sequences([(r.sequence_id, r.offset, r.length) for r in out], 4096)


def test_stages_keep_the_columns(spark):
    rows = [(1, "one two three four five six seven eight nine ten eleven me@x.org", "en", 5, None), (2, None, "en", 6, "x"), (None, " ".join("abcdefghijklmn"), None, None, None)]
    docs = spark.createDataFrame(rows + rows, "doc_id long, text string, lang string, n_chars long, __id string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for given in (docs, docs.limit(0)):
            out = stage(spark, given, "")
            assert out.columns == docs.columns, name
            out.collect()
    out = corpus_pipeline.personal_data(spark, docs.where("doc_id = 1"), "").collect()[0]
    assert out.text.endswith("eleven [EMAIL]") and out.n_chars == len(out.text)
