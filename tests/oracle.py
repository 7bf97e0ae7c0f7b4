"""Registered queries against their DuckDB SQL: python tests/oracle.py SF_DIR [NAME...]"""

import datetime
import decimal
import math
import os
import sys

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (bool, int)):
        return int(value)
    if isinstance(value, (float, decimal.Decimal)):
        return float(f"{float(value):.9g}")
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: tuple((x is not None, str(x)) for x in r))


def compare(spark, con, run, sql, sf_dir):
    """None if both give the same columns and rows, else what differs."""
    df = run(spark, sf_dir)
    got = rows(df.columns, df.collect())
    found = con.execute(sql)
    want = rows([c[0] for c in found.description], found.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} and {len(want[1])} rows"
    for a, b in zip(got[1], want[1]):
        if a != b:
            return "; ".join(f"{n}: {x!r} and {y!r}" for n, x, y in zip(got[0], a, b) if x != y)
    return None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con, bad = connect(sys.argv[1]), 0
    queries = entry.queries()
    for name, sql in entry.oracle_sql().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        try:
            said = compare(spark, con, queries[name], sql, sys.argv[1])
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:300]}"
        if said:
            bad += 1
            print(name, said[:700], flush=True)
    print("compared; differing:", bad)
