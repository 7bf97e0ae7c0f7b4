"""Readers over Spark's own sources, with schema and pushdown left to Catalyst."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables whose size is fixed by their meaning, so they may always be broadcast.
FIXED_SIZE = ("region", "nation")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """Parquet, ORC, JSON, CSV or text; a schema spares the inference pass."""
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "error", partition_by: tuple[str, ...] = (), **options: str) -> None:
    df.write.format(kind).mode(mode).options(**options).partitionBy(*partition_by).save(path)
