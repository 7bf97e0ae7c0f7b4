"""The corpus pipeline: rules, near-duplicates, repeated passages, personal data, packing.

Each stage takes all rows its predecessor kept; all but the last return the columns of
``documents``, with ``n_chars`` following the text.

Defined results of every stage: a null text is the empty text, which the rules reject; a
null doc_id stays one and comes after all others; of equal rows near_duplicates keeps one,
the other stages treat each; an empty table stays empty; other columns stay as they are,
whatever their names; texts of any length are worked on whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstore.llm import common, packing, pii, quality, simhash, substring

#: SQL can't express fingerprints, exchange or packing; tests hold run() against a brute-force version.
ORACLE_SQL = None


def _with_size(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one of the smallest doc_id.

    Groups are those of op4 (4-word shingles, 4 differing bits); the README gives their
    recall at a similarity of 0.8 on five-word shingles.
    """
    return simhash.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are taken out of the text."""
    return _with_size(substring.without_repeats(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind."""
    common.arrow_batches(spark)
    return _with_size(docs.withColumn("text", pii.redact_column(F.col("text"))))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; what a stage made on the way, and its input, goes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for name, stage in STAGES:
        with common.scratch_scope() as made:
            docs = common.materialize(stage(spark, docs, sf_dir), name)
            made.remove(docs.scratch_path)
            made += before
            before = [docs.scratch_path]
    return docs
