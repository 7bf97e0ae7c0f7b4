"""The table of registered queries and of their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import info, install
from ..plans.rewrite import rewrite
from ..sources.files import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "pages", "benchmark", "conversations", "embeddings")


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLE[fn.__name__] = oracle
        return fn

    return add


def views(spark: SparkSession, sf_dir: str, text: str) -> None:
    """The tables that ``text`` names, as views."""
    install(spark)
    for t in TABLES:
        if t in text:
            table(spark, sf_dir, t).createOrReplaceTempView(t)


def mysql(name: str, text: str, oracle: str | None = None) -> None:
    """A query in MySQL text; without its own SQL the text itself is the oracle's."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, text)
        with info.using(info.Scope()):
            return spark.sql(rewrite(text))

    run.__name__ = name
    QUERIES[name] = run
    ORACLE[name] = oracle or text
