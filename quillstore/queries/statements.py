"""Queries that go through the store: statements, the data API, row access, indexes and streaming reads.

Each makes a database of its own in the shared folder, loads whole tables into it, writes,
and returns what is read back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..client import Client, Mutation
from ..operators.keys import KeySet
from ..plans.session import Session
from ..rows import CellMutation, RowStore
from ..sources.scratch import scratch_root
from ..sources.store import Store
from .registered import QUERIES, query, views

_T = "(o_orderkey BIGINT PRIMARY KEY, o_custkey BIGINT, o_orderstatus VARCHAR(1), o_totalprice DOUBLE)"
_C = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"


def a_session(spark: SparkSession, sf_dir: str, load: bool = True) -> Session:
    """A session on a new store whose database d has the orders."""
    store = Store(spark, f"{scratch_root(spark)}/store-{uuid.uuid4().hex}")
    store.create_database("d")
    session = Session(spark, store, "d")
    if load:
        views(spark, sf_dir, "orders")
        session.sql(f"CREATE TABLE o {_T}")
        session.sql(f"INSERT INTO o ({_C}) SELECT {_C} FROM orders")
    return session


def _orders(name: str, oracle: str, *texts: str, read: str = f"SELECT {_C} FROM o") -> None:
    """Statements over the orders, then a read."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = a_session(spark, sf_dir)
        for text in texts:
            session.sql(text)
        return session.sql(read)

    run.__name__ = name
    query(oracle)(run)


_orders("sql_insert_values", f"SELECT {_C} FROM orders WHERE o_orderkey <> 1 UNION ALL SELECT 1, 5, 'Z', 2.5 UNION ALL SELECT -7, 6, NULL, 3.5",
        f"INSERT INTO o ({_C}) VALUES (1, 4, 'Y', 1.5), (1, 5, 'Z', 2.5), (-7, 6, DEFAULT, 3.5)")
_orders("sql_insert_select", f"SELECT {_C} FROM orders UNION ALL SELECT o_orderkey + 100000000, o_custkey, 'N', o_totalprice FROM orders WHERE o_custkey < 50",
        f"INSERT INTO o SELECT o_orderkey + 100000000, o_custkey, 'N', o_totalprice FROM o WHERE o_custkey < 50")
_orders("sql_replace", "SELECT o_orderkey, o_custkey, CASE WHEN o_custkey < 50 THEN 'R' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_custkey >= 50 THEN o_totalprice END AS o_totalprice FROM orders",
        "REPLACE INTO o (o_orderkey, o_custkey, o_orderstatus) SELECT o_orderkey, o_custkey, 'R' FROM o WHERE o_custkey < 50")
_orders("sql_insert_ignore", f"SELECT {_C} FROM orders UNION ALL SELECT -1, 2, 'I', 4.0",
        f"INSERT IGNORE INTO o ({_C}) VALUES (-1, 2, 'I', 4.0), (-1, 3, 'J', 5.0)", f"INSERT IGNORE INTO o ({_C}) SELECT o_orderkey, 0, 'X', 0 FROM o")
_orders("sql_on_duplicate", "SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_custkey < 50 THEN o_totalprice * 2 + 1 ELSE o_totalprice END AS o_totalprice FROM orders UNION ALL SELECT -1, 2, 'I', 9.0",
        f"INSERT INTO o ({_C}) SELECT o_orderkey, 0, 'X', 1 FROM o WHERE o_custkey < 50 ON DUPLICATE KEY UPDATE o_totalprice = o_totalprice * 2 + VALUES(o_totalprice)",
        f"INSERT INTO o ({_C}) VALUES (-1, 2, 'I', 4.0), (-1, 3, 'J', 5.0) ON DUPLICATE KEY UPDATE o_totalprice = o_totalprice + VALUES(o_totalprice)")
_orders("sql_update_alias", "SELECT o_orderkey, o_custkey, CASE WHEN o_custkey < 50 THEN lower(o_orderstatus) ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_custkey < 50 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders",
        "UPDATE o AS x SET x.o_totalprice = x.o_totalprice + 1, o_orderstatus = lower(x.o_orderstatus) WHERE x.o_custkey < 50")
_orders("sql_update_key", "SELECT CASE WHEN o_custkey < 50 THEN -o_orderkey - 1 ELSE o_orderkey END AS o_orderkey, o_custkey FROM orders", "UPDATE o SET o_orderkey = -o_orderkey - 1 WHERE o_custkey < 50", read="SELECT o_orderkey, o_custkey FROM o")
_orders("sql_delete_alias", f"SELECT {_C} FROM orders WHERE NOT (o_custkey < 50 OR o_orderkey IN (100, 101, 102, 103))", "DELETE FROM o AS x WHERE x.o_custkey < 50", "DELETE FROM o WHERE o.o_orderkey IN (100, 101, 102, 103)")
_orders("sql_delete_limit", f"SELECT {_C} FROM orders ORDER BY o_orderkey DESC OFFSET 10", "DELETE FROM o ORDER BY o_orderkey DESC LIMIT 10")
_orders("sql_transaction", f"SELECT {_C} FROM orders WHERE o_custkey >= 50", "BEGIN", "DELETE FROM o WHERE o_custkey < 50", "COMMIT", "START TRANSACTION", "DELETE FROM o", "ROLLBACK")
_orders("sql_alter_add", f"SELECT {_C}, CAST(CASE WHEN o_custkey < 50 THEN 2.0 ELSE 1.5 END AS DOUBLE) AS extra FROM orders", "ALTER TABLE o ADD COLUMN extra DOUBLE DEFAULT 1.5", "UPDATE o SET extra = 2 WHERE o_custkey < 50", read=f"SELECT {_C}, extra FROM o")
_orders("sql_alter_drop", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey >= 10", "ALTER TABLE o DROP COLUMN o_orderstatus", "DELETE FROM o WHERE o_orderkey < 10", read="SELECT * FROM o")
_orders("sql_truncate", f"SELECT {_C} FROM orders WHERE o_custkey = 42", "CREATE TABLE p (o_orderkey BIGINT PRIMARY KEY, o_custkey BIGINT, o_orderstatus VARCHAR(1), o_totalprice DOUBLE)", "INSERT INTO p SELECT * FROM o WHERE o_custkey = 42", "TRUNCATE TABLE o", "INSERT INTO o SELECT * FROM p")
_orders("sql_describe", "SELECT 'o_orderkey' AS Field, 'bigint' AS \"Type\", 'NO' AS \"Null\", 'PRI' AS \"Key\" UNION ALL SELECT 'o_custkey', 'bigint', 'YES', 'MUL' UNION ALL SELECT 'o_orderstatus', 'string', 'YES', '' UNION ALL SELECT 'o_totalprice', 'double', 'YES', ''",
        "CREATE INDEX by_customer ON o (o_custkey)", read="DESC o")
_orders("sql_show", "SELECT 'o' AS Tables_in_d", "CREATE DATABASE e", "CREATE TABLE gone (a BIGINT PRIMARY KEY)", "DROP TABLE gone", "DROP DATABASE e", read="SHOW TABLES LIKE '%'")
_orders("sql_variables", "SELECT o_orderkey, 7 AS v, '30' AS m FROM orders WHERE o_custkey < 7", "SET @v = 7, group_concat_max_len = 30", read="SELECT o_orderkey, @v AS v, @@group_concat_max_len AS m FROM o WHERE o_custkey < @v")
_orders("sql_prepared", f"SELECT {_C} FROM orders WHERE o_custkey = 42", "PREPARE q FROM 'SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM o WHERE o_custkey = ?'", "SET @c = 42", read="EXECUTE q USING @c")
_orders("sql_split_by", "SELECT CAST((o_orderkey >= 100)::INTEGER + (o_orderkey >= 1000)::INTEGER AS INTEGER) AS region, count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders GROUP BY 1", read="SPLIT TABLE o BY (100), (1000)")
_orders("sql_split_between", "SELECT CAST((o_orderkey >= 250)::INTEGER + (o_orderkey >= 500)::INTEGER + (o_orderkey >= 750)::INTEGER AS INTEGER) AS region, count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders GROUP BY 1", read="SPLIT TABLE o BETWEEN (0) AND (1000) REGIONS 4")
for _name, _columns in (("sql_describe", ["Field", "Type", "Null", "Key"]), ("sql_split_by", None), ("sql_split_between", None)):
    def _picked(spark: SparkSession, sf_dir: str, whole=QUERIES[_name], columns=_columns) -> DataFrame:
        out = whole(spark, sf_dir)
        return out.select(*columns) if columns else out.select("region", "n", F.col("first_key.o_orderkey").alias("lo"), F.col("last_key.o_orderkey").alias("hi"))

    _picked.__name__ = _name
    QUERIES[_name] = _picked


@query("SELECT row_number() OVER (ORDER BY n_nationkey) AS id, n_name FROM nation")
def sql_auto_increment(spark, sf_dir):
    session = a_session(spark, sf_dir, load=False)
    views(spark, sf_dir, "nation")
    session.sql("CREATE TABLE t (id BIGINT AUTO_INCREMENT PRIMARY KEY, n_name VARCHAR(30))")
    names = [r.n_name for r in spark.table("nation").orderBy("n_nationkey").collect()]  # 25 rows by definition
    session.sql("INSERT INTO t (n_name) VALUES " + ", ".join(f"('{n}')" for n in names))
    return session.sql("SELECT id, n_name FROM t")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 5000 UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def client_read(spark, sf_dir):
    store = a_session(spark, sf_dir).store
    return Client(spark, store).read("d", "o", KeySet.range(100, 5000) | KeySet.of(7), ["o_orderkey", "o_totalprice"])


@query(
    "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey = 1 THEN 'N' WHEN o_orderkey < 5 THEN NULL ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey = 2 THEN NULL WHEN o_orderkey = 3 THEN 0 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey NOT BETWEEN 50 AND 59"
    " UNION ALL SELECT -1, 9, NULL, NULL"
)
def client_mutate(spark, sf_dir):
    store = a_session(spark, sf_dir).store
    client, customers = Client(spark, store), {r.o_orderkey: r.o_custkey for r in store.data(store.meta("d", "o")).where("o_orderkey IN (2)").collect()}
    client.mutate("d", "o", [
        Mutation("delete", ("o_orderstatus",), keys=KeySet.range(None, 5)),
        Mutation("insert_or_update", ("o_orderkey", "o_orderstatus"), ((1, "M"), (1, "N"))),
        Mutation("replace", ("o_orderkey", "o_custkey"), tuple(customers.items())),
        Mutation("update", ("o_orderkey", "o_totalprice"), ((3, 0.0), (-5, 1.0))),
        Mutation("insert", ("o_orderkey", "o_custkey"), ((4, 0), (-1, 9))),
        Mutation("delete", keys=KeySet.range(50, 60)),
    ])
    return client.read("d", "o", KeySet.all(), _C.split(", "))


@query(f"SELECT {_C} FROM orders WHERE o_custkey NOT BETWEEN 50 AND 60")
def client_transaction(spark, sf_dir):
    client = Client(spark, a_session(spark, sf_dir).store)
    client.create_index("d", "o", _index("by_customer", "o_custkey"))
    name = client.create_session("d")
    tx = client.begin()
    keys = [r.o_orderkey for r in client.read("d", "o", KeySet.range(50, 61), ["o_orderkey"], index="by_customer", tx=tx).collect()]  # what the mutation lists
    client.mutate("d", "o", [Mutation("delete", keys=KeySet.of(*keys))], tx)
    tx.commit()
    lost = client.begin()
    client.mutate("d", "o", [Mutation("delete", keys=KeySet.all())], lost)
    lost.rollback()
    client.delete_session(name)
    return client.read("d", "o", KeySet.all(), _C.split(", "))


def _index(name: str, *columns: str):
    from ..sources.store import Index

    return Index(name, list(columns))


def _indexed(spark: SparkSession, sf_dir: str) -> Client:
    """The orders with an index on the customer, and writes made after the index."""
    session = a_session(spark, sf_dir)
    session.sql("CREATE INDEX by_customer ON o (o_custkey)")
    session.sql("UPDATE o SET o_custkey = -1 WHERE o_orderkey < 20")
    session.sql("DELETE FROM o WHERE o_orderkey BETWEEN 20 AND 39")
    return Client(spark, session.store)


_MOVED = "SELECT o_orderkey, CASE WHEN o_orderkey < 20 THEN -1 ELSE o_custkey END AS o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey NOT BETWEEN 20 AND 39"


@query(f"SELECT o_custkey, o_orderkey FROM ({_MOVED}) WHERE o_custkey < 100")
def index_covered_read(spark, sf_dir):
    return _indexed(spark, sf_dir).read("d", "o", KeySet.range(None, 100), ["o_custkey", "o_orderkey"], index="by_customer")


@query(f"SELECT {_C} FROM ({_MOVED}) WHERE o_custkey BETWEEN -1 AND 12")
def index_double_read(spark, sf_dir):
    return _indexed(spark, sf_dir).read("d", "o", KeySet.range(-1, 12, end_closed=True), _C.split(", "), index="by_customer")


@query(f"SELECT o_orderkey, o_totalprice FROM ({_MOVED}) ORDER BY o_custkey DESC, o_orderkey DESC LIMIT 30")
def index_order_limit(spark, sf_dir):
    return _indexed(spark, sf_dir).read("d", "o", KeySet.all(), ["o_orderkey", "o_totalprice"], index="by_customer", limit=30, reverse=True)


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")
def unique_index_insert(spark, sf_dir):
    session = a_session(spark, sf_dir, load=False)
    views(spark, sf_dir, "nation")
    session.sql("CREATE TABLE n (n_nationkey BIGINT PRIMARY KEY, n_name VARCHAR(30), UNIQUE KEY u (n_name))")
    session.sql("INSERT INTO n SELECT n_nationkey, n_name FROM nation")
    session.sql("INSERT IGNORE INTO n SELECT n_nationkey + 100, n_name FROM nation")
    return session.sql("SELECT n_nationkey, n_name FROM n")


def _cells(spark: SparkSession, sf_dir: str) -> tuple[Client, RowStore]:
    """The nations as rows of cells: f:name, and g:region of those in region 1 and 2."""
    store = Store(spark, f"{scratch_root(spark)}/store-{uuid.uuid4().hex}")
    store.create_database("d")
    client = Client(spark, store)
    rows = RowStore(client, "d")
    rows.create_table("n", ["f:", "g:"])
    views(spark, sf_dir, "nation")
    nations = spark.table("nation").collect()  # 25 rows by definition
    rows.mutate_rows("n", [(b"%03d" % r.n_nationkey, [CellMutation("f:name", r.n_name.encode())] + [CellMutation("g:region", b"%d" % r.n_regionkey)] * (r.n_regionkey in (1, 2))) for r in nations])
    return client, rows


def _found(spark: SparkSession, results) -> DataFrame:
    out = [(r.row.decode(), c, v.decode()) for r in results for c, v in r.columns.items()]
    return spark.createDataFrame(out, "row string, cell string, value string")


_ROW = "printf('%03d', n_nationkey)"


@query(f"SELECT {_ROW} AS row, 'f:name' AS cell, n_name AS value FROM nation WHERE n_nationkey IN (1, 3, 20)")
def rows_get(spark, sf_dir):
    _, rows = _cells(spark, sf_dir)
    return _found(spark, rows.get_rows("n", [b"001", b"020", b"003", b"999"], ["f:name"]))


@query(f"SELECT {_ROW} AS row, 'f:name' AS cell, n_name AS value FROM nation WHERE n_nationkey BETWEEN 5 AND 9 AND n_nationkey <> 7 UNION ALL SELECT '007', 'f:new', 'x' UNION ALL SELECT {_ROW}, 'g:region', CAST(n_regionkey AS VARCHAR) FROM nation WHERE n_nationkey BETWEEN 5 AND 9 AND n_regionkey IN (1, 2)")
def rows_scan(spark, sf_dir):
    _, rows = _cells(spark, sf_dir)
    rows.mutate_row("n", b"007", [CellMutation("f:name", is_delete=True), CellMutation("f:new", b"x")])
    return _found(spark, rows.scanner_get_list(rows.scanner_open("n", b"005", None, b"010"), 100))


@query(f"SELECT {_ROW} AS row, 'g:region' AS cell, CAST(n_regionkey AS VARCHAR) AS value FROM nation WHERE n_nationkey BETWEEN 10 AND 19 AND n_regionkey IN (1, 2)")
def rows_scan_prefix(spark, sf_dir):
    _, rows = _cells(spark, sf_dir)
    return _found(spark, rows.scanner_get_list(rows.scanner_open_with_prefix("n", b"01", ["g:"]), 100))


@query(f"SELECT {_ROW} AS row, 'g' AS family, CAST(n_regionkey AS VARCHAR) AS value FROM nation WHERE n_regionkey IN (1, 2)")
def store_sparse_scan(spark, sf_dir):
    client, _ = _cells(spark, sf_dir)
    out = client.sparse_scan("d", "n", "g", KeySet.all())
    return out.select(F.col("row").cast("string").alias("row"), F.lit("g").alias("family"), F.col("g")["region"]["b"].cast("string").alias("value"))


@query(f"SELECT {_ROW} AS row, '_' || n_name AS value FROM nation")
def store_family_star(spark, sf_dir):
    client, _ = _cells(spark, sf_dir)
    return Session(spark, client.store, "d").sql("SELECT CAST(row AS CHAR) AS row, concat('_', CAST(_value.b AS CHAR)) AS value FROM (SELECT row, f.* FROM n) AS x")


def _streamed(name: str, oracle: str, read) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        client, _ = _cells(spark, sf_dir)
        return spark.createDataFrame(read(client), "row string, cells int")

    run.__name__ = name
    query(oracle)(run)


_KEYS = [((bytearray(b"%03d" % i),), []) for i in range(30)]
_streamed("streaming_read", f"SELECT {_ROW} AS row, CAST(CASE WHEN n_regionkey IN (1, 2) THEN 2 ELSE 1 END AS INTEGER) AS cells FROM nation", lambda c: [(r.key.row.decode(), len(r.cells)) for r in c.streaming_read("d", "n", KeySet.all())])
_streamed("streaming_sparse_read", f"SELECT {_ROW} AS row, 1 AS cells FROM nation", lambda c: [(r.row.decode(), len(r.f)) for r in c.streaming_sparse_read("d", "n", "f", _KEYS)])
_streamed("streaming_sparse_scan", f"SELECT {_ROW} AS row, 1 AS cells FROM nation WHERE n_regionkey IN (1, 2)", lambda c: [(r.row.decode(), len(r.g)) for r in c.streaming_sparse_scan("d", "n", "g", KeySet.all())])


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")
def sql_load_data(spark, sf_dir):
    session = a_session(spark, sf_dir, load=False)
    views(spark, sf_dir, "nation")
    path = f"{session.store.root}/nation.csv"
    spark.table("nation").select("n_nationkey", "n_name").write.csv(path, sep="|", header=True)
    session.sql("CREATE TABLE n (n_nationkey BIGINT PRIMARY KEY, n_name VARCHAR(30))")
    session.sql(f"LOAD DATA INFILE '{path}' INTO TABLE n FIELDS TERMINATED BY '|' IGNORE 1 LINES (n_nationkey, n_name)")
    return session.sql("SELECT n_nationkey, n_name FROM n")


def _format(kind: str, **options: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ..sources import files

        orders = files.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
        path = f"{scratch_root(spark)}/files-{uuid.uuid4().hex}"
        files.write(orders, path, kind, **options)
        return files.read(spark, path, kind, "o_orderkey bigint, o_custkey bigint, o_orderstatus string", **options)

    run.__name__ = f"files_{kind}"
    query("SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, o_orderstatus FROM orders")(run)


_format("parquet")
_format("orc")
_format("json")
_format("csv", header="true")


@query(f"SELECT {_ROW} AS row, 'f:name' AS cell, n_name AS value FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT {_ROW}, 'g:region', CAST(n_regionkey AS VARCHAR) FROM nation WHERE n_nationkey NOT IN (3, 1) AND n_regionkey IN (1, 2) UNION ALL SELECT '001', 'f:put', 'x' UNION ALL SELECT '000', 'f:n', '12'")
def rows_admin(spark, sf_dir):
    _, rows = _cells(spark, sf_dir)
    rows.delete_all_row("n", b"003")
    rows.delete_all("n", b"001", "g:")
    rows.atomic_increment("n", b"000", "f:count", 5)
    after = rows.increment_rows("n", [(b"000", "f:count", 9), (b"000", "f:count", -2)])[-1]
    rows.delete_all("n", b"000", "f:count")
    rows.check_and_put("n", b"001", "f:put", None, CellMutation("f:put", b"x"))
    rows.check_and_put("n", b"001", "f:put", b"y", CellMutation("f:put", b"z"))
    rows.mutate_row("n", b"000", [CellMutation("f:n", b"%d" % after)])
    rows.disable_table("n")
    rows.enable_table("n")
    rows.compact("n")
    return _found(spark, rows.scanner_get_list(rows.scanner_open("n"), 100))
