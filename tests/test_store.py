"""Keys, families, writes, the store, SQL statements and the data API."""

import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillstore.client import Client, Mutation
from quillstore.operators import families, mutate
from quillstore.operators.keys import KeyRange, KeySet, restrict
from quillstore.operators.scan import covers, scan
from quillstore.plans.session import Session
from quillstore.sources.store import Column, Index, Store, StoreError, TableMeta
from quillstore.streaming import windows
from quillstore.streaming.reads import stream_batches, stream_cells


@pytest.fixture
def store(spark, tmp_path):
    found = Store(spark, f"file://{tmp_path}/store")
    found.create_database("d")
    return found


@pytest.fixture
def session(spark, store):
    return Session(spark, store, "d")


def order(key):
    return tuple((v is not None, v if v is not None else 0) for v in key)


def in_range(key, r):
    low = order(key[: len(r.start)]) if r.start else None
    high = order(key[: len(r.end)]) if r.end else None
    above = low is None or low > order(r.start) or (low == order(r.start) and r.start_closed)
    below = high is None or high < order(r.end) or (high == order(r.end) and r.end_closed)
    return above and below


def test_ranges_against_a_model(spark):
    values = [None, 1, 2, 3]
    rows = list(itertools.product(values, values))
    df = spark.createDataFrame(rows, "a int, b int").cache()
    rng = random.Random(1)
    for _ in range(25):
        bound = lambda: rng.choice([None, (rng.choice(values),), (rng.choice(values), rng.choice(values))])
        r = KeyRange(bound(), bound(), rng.random() < 0.5, rng.random() < 0.5)
        got = sorted(map(tuple, restrict(df, ["a", "b"], KeySet(ranges=(r,))).collect()), key=order)
        assert got == sorted((k for k in rows if in_range(k, r)), key=order), r


def test_range_reaches_the_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    plan = restrict(df, ["l_orderkey", "l_linenumber"], KeySet.range((10, 2), (20, 1)))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_orderkey,10)" in plan


def test_key_lists_and_unions(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    assert restrict(df, ["k"], KeySet.of(1, 7, 9999)).count() == 2
    assert restrict(df, ["k"], KeySet.of(*range(0, 4000, 2))).count() == 2000
    assert restrict(df, ["k"], KeySet.of(1) | KeySet.range(10, 12) | KeySet.range(4998)).count() == 5
    assert restrict(df, ["k"], KeySet()).count() == 0 and restrict(df, ["k"], KeySet.all()).count() == 5000


def test_scan(spark):
    df = spark.range(100).withColumnRenamed("id", "k").withColumn("v", F.col("k") % 3)
    assert [r.k for r in scan(df, ["k"], KeySet.range(10, 90), ["k"], "v = 0", reverse=True, limit=3, offset=1).collect()] == [84, 81, 78]
    assert covers(["v"], ["k"], ["K", "v"]) and not covers(["v"], ["k"], ["w"])


def test_writes_against_a_model(spark):
    rng = random.Random(2)
    model, df = {}, spark.createDataFrame([], "k int, a int, b int")
    for step in range(6):
        changes = [(rng.randint(0, 9), rng.randint(0, 99), n) for n in range(rng.randint(1, 6))]
        new = spark.createDataFrame(changes, "k int, a int, q_order int")
        kind = rng.choice([mutate.upsert, mutate.insert_only, mutate.update_only, mutate.replace_rows])
        df = spark.createDataFrame(kind(df, new, ["k"], "q_order").collect(), "k int, a int, b int")
        last = {k: a for k, a, _ in changes}
        for k, a in last.items():
            if (kind is mutate.insert_only and k in model) or (kind is mutate.update_only and k not in model):
                continue
            model[k] = (a, None if kind is mutate.replace_rows else model.get(k, (0, None))[1])
        df = mutate.update_where(df, {"b": f"k + {step}"}, "k % 2 = 0")
        model = {k: (a, k + step if k % 2 == 0 else b) for k, (a, b) in model.items()}
        df = mutate.delete_keys(df, ["k"], KeySet.of(step) | KeySet.range(9))
        model = {k: v for k, v in model.items() if k != step and k < 9}
        assert sorted(map(tuple, df.collect())) == sorted((k, *v) for k, v in model.items())


def cells(spark):
    rows = [(1, "stat", "x", None, 1.5, None), (1, "cnt", "y", 3, None, None), (2, "stat", "z", None, None, b"q"), (3, "cnt", "n", None, None, None)]
    return spark.createDataFrame(rows, "pk bigint, family string, qualifier string, i bigint, d double, b binary")


def test_families(spark):
    maps = families.to_maps(cells(spark), ["pk"], ["stat", "cnt"])
    assert sorted(map(tuple, families.to_cells(maps, ["pk"], ["stat", "cnt"]).collect()), key=str) == sorted(map(tuple, cells(spark).collect()), key=str)
    assert [r.pk for r in maps.where("stat IS NULL").collect()] == [3]
    got = families.sparse_read(maps, ["pk"], [((1,), ["x", "no"]), ((2,), []), ((9,), [])], ["stat"]).collect()
    assert [(r.pk, list(r.stat)) for r in got] == [(1, ["x"]), (2, ["z"])]
    got = families.sparse_scan(maps, ["pk"], KeySet.range(1, 3, end_closed=True), ["cnt"], ["n"]).collect()
    assert [(r.pk, r.cnt["n"].i) for r in got] == [(3, None)]
    assert families.expand(maps, "stat").select("pk", "_qualifier").orderBy("pk").collect() == [(1, "x"), (2, "z")]
    rows = families.row_cells(maps, ["pk"], [], ["stat", "cnt"]).orderBy("key").collect()
    assert [tuple(c) for c in rows[0].cells] == [("stat", "x", "1.5"), ("cnt", "y", "3")]


def test_streams(spark):
    df = spark.range(70).withColumn("cells", F.sequence(F.lit(1), F.lit(5))).withColumnRenamed("id", "key")
    assert [len(b) for b in stream_batches(df)] == [32, 32, 6]
    assert [len(r.cells) for r in stream_cells(df.limit(1), 2)] == [2, 2, 1]


def test_windows_as_batch_and_stream(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(start + datetime.timedelta(minutes=3 * i), "ab"[i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "ts timestamp, k string")
    n = F.count("*").alias("n")
    batch = windows.tumbling(df, "ts", "10 minutes", ["k"], n)
    assert sum(r.n for r in batch.collect()) == 40
    assert windows.session(df, "ts", "5 minutes", ["k"], n).count() == 40
    assert sum(r.n for r in windows.sliding(df, "ts", "10 minutes", "5 minutes", [], n).collect()) == 80
    df.write.parquet(f"{tmp_path}/in")
    live = windows.tumbling(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "ts", "10 minutes", ["k"], n, late="1 hour")
    query = live.writeStream.outputMode("complete").format("memory").queryName("live_windows").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("live_windows").collect())) == sorted(map(tuple, batch.collect()))


def test_statements(session):
    run = lambda text: [tuple(r) for r in session.sql(text).collect()]
    run("CREATE TABLE t (c1 BIGINT PRIMARY KEY, c2 BIGINT DEFAULT (7 + 1), name VARCHAR(20) NOT NULL DEFAULT 'x', INDEX test (c2)) ENGINE = txn")
    assert run("INSERT INTO t (c1, c2) VALUES (1, 2), (2, 3), (3, DEFAULT), (1, 20)") == [(4,)]
    assert run("SELECT * FROM t ORDER BY c1") == [(1, 20, "x"), (2, 3, "x"), (3, 8, "x")]
    assert run("SELECT c1 + 1 AS d, upper(name) FROM t WHERE c2 BETWEEN 3 AND 8 AND c1 <> 2") == [(4, "X")]
    assert run("SELECT count(*) FROM t WHERE c2 > 3") == [(2,)]
    assert run("UPDATE t SET name = concat(name, 'y'), c2 = c2 * 2 WHERE c1 >= 2") == [(2,)]
    assert run("SELECT c1, c2, name FROM t WHERE c1 > 1 ORDER BY c1 DESC LIMIT 1, 5") == [(2, 6, "xy")]
    assert run("DELETE FROM t ORDER BY c1 LIMIT 1") == [(1,)]
    assert run("SELECT a.c1 FROM t AS a JOIN d.t b ON a.c1 = b.c1 + 1") == [(3,)]
    run("ALTER TABLE t ADD COLUMN c4 DOUBLE DEFAULT 1.5")
    assert run("SELECT c1, c4 FROM t ORDER BY 1") == [(2, 1.5), (3, 1.5)]
    run("CREATE UNIQUE INDEX u ON t (c1)")
    with pytest.raises(StoreError):
        run("CREATE UNIQUE INDEX v ON t (c4)")
    with pytest.raises(StoreError):
        run("INSERT INTO t (c1, name) VALUES (9, NULL)")
    run("INSERT INTO t (c1) SELECT c1 + 100 FROM t")
    assert run("SELECT count(*), count(DISTINCT c4) FROM t") == [(4, 1)]
    assert run("SHOW TABLES LIKE 't%'") == [("t",)] and run("SHOW DATABASES") == [("d",)]
    assert [r[:4] for r in run("DESC t")][0] == ("c1", "bigint", "NO", "PRI")
    assert run("SHOW COLUMNS FROM t WHERE Field = 'c2'")[0][3] == "MUL"
    assert "PRIMARY KEY (`c1`)" in run("SHOW CREATE TABLE t")[0][1]
    run("SET @x = 5, autocommit = 0")
    assert run("SELECT @x + 1, @@autocommit") == [(6, "0")]
    run("BEGIN")
    run("DELETE FROM t")
    assert run("SELECT count(*) FROM t") == [(0,)]
    run("ROLLBACK")
    assert run("SELECT count(*) FROM t") == [(4,)]
    assert sum(r[3] for r in run("SPLIT TABLE t BETWEEN (0) AND (200) REGIONS 2")) == 4
    assert session.sql("SELECT c1 FROM t WHERE c1 = ?", [2]).collect() == [(2,)]
    run("CREATE DATABASE IF NOT EXISTS e")
    run("USE e")
    run("DROP DATABASE e")
    run("DROP TABLE d.t")
    assert run("SHOW TABLES FROM d") == []


def test_family_star(session, spark, store):
    session.sql("CREATE TABLE f (pk BIGINT, PRIMARY KEY (pk), FAMILY stat)")
    client = Client(spark, store)
    client.mutate("d", "f", [Mutation("insert_or_update", ("a", "b"), (((1,), (1, 2.5)), ((2,), (b"z", None))), family="stat")])
    got = session.sql("SELECT pk, stat.* FROM f WHERE _qualifier = 'a' ORDER BY pk").collect()
    assert [(r.pk, r._qualifier, r._value.i, r._value.b) for r in got] == [(1, "a", 1, None), (2, "a", None, bytearray(b"z"))]


def test_client(spark, store):
    client = Client(spark, store)
    name = client.batch_create_sessions("d", 2)[0]
    assert client.get_session(name)["database"] == "d" and len(client.list_sessions()) == 2
    client.delete_session(name)
    columns = [Column("a", "bigint"), Column("b", "string"), Column("v", "double"), Column("w", "string")]
    client.create_table(TableMeta("d", "t", columns, ["a", "b"], flexible=["x", "y"]))
    client.create_index("d", "t", Index("by_w", ["w"]))
    rows = tuple((i // 3, "pqr"[i % 3], float(i), "k" + str(i % 2)) for i in range(9))
    client.mutate("d", "t", [Mutation("insert_or_update", ("a", "b", "v", "w"), rows), Mutation("insert_or_update", ("q1", "q2"), (((0, "p"), (1, 2.0)), ((2, "r"), (b"b", None))), family="x")])
    assert [tuple(r) for r in client.read("d", "t", KeySet.prefix(1), ["b"]).collect()] == [("p",), ("q",), ("r",)]
    assert client.read("d", "t", KeySet.range((0, "q"), (1, "q")), ["default:v"], limit=10).count() == 3
    assert [r.v for r in client.read("d", "t", KeySet.of("k1"), ["v"], index="by_w", reverse=True).collect()] == [7, 5, 3, 1]
    assert client.read("d", "t", KeySet.all(), limit=4).count() == 4
    assert [sorted(r.x) for r in client.sparse_scan("d", "t", "x", KeySet.all(), limit=5).collect()] == [["q1", "q2"], ["q1", "q2"]]
    assert list(client.streaming_sparse_read("d", "t", "", [((0, "p"), ["q2"])]))[0].x["q2"].d == 2.0
    first = next(client.streaming_read("d", "t", KeySet.of((0, "p"))))
    assert ("x", "q1", "1") in [tuple(c) for c in first.cells]
    tx = client.begin()
    client.mutate("d", "t", [Mutation("delete", keys=KeySet.prefix(1)), Mutation("delete", ("q1",), family="x", keys=KeySet.all()), Mutation("delete", ("v",), keys=KeySet.of((0, "p")))], tx)
    assert client.read("d", "t", KeySet.all()).count() == 9 and client.read("d", "t", KeySet.all(), tx=tx).count() == 6
    tx.commit()
    assert client.read("d", "t", KeySet.all()).count() == 6
    assert [list(r.x) for r in client.sparse_scan("d", "t", "x", KeySet.all()).collect()] == [["q2"], ["q2"]]
    assert client.read("d", "t", KeySet.of((0, "p")), ["v"]).collect()[0].v is None
    client.mutate("d", "t", [Mutation("insert", ("a", "b", "v"), ((0, "q", -1.0), (7, "p", 7.0))), Mutation("update", ("a", "b", "w"), ((7, "p", "new"), (8, "p", "no")))])
    assert client.read("d", "t", KeySet.range(7)).collect() == [(7, "p", 7.0, "new")]
    with pytest.raises(StoreError):
        client.mutate("d", "t", [Mutation("insert_or_update", ("q",), (((0, "p"), ("text",)),), family="x")])
    client.add_columns("d", "t", Column("z", "int"))
    assert "z" in client.read("d", "t", KeySet.all()).columns
    client.drop_table("d", "t")
    assert client.list_tables("d") == []


def test_row_store(spark, store):
    from quillstore.rows import CellMutation, RowStore

    rows = RowStore(Client(spark, store), "d")
    rows.create_table("h", ["f:", "g:"])
    assert rows.get_table_names() == ["h"] and list(rows.get_column_descriptors("h")) == ["f:", "g:"]
    rows.mutate_rows("h", [(b"r%d" % i, [CellMutation("f:a", b"v%d" % i), CellMutation("g:b", b"w")]) for i in range(5)])
    rows.mutate_row("h", b"r1", [CellMutation("f:a", is_delete=True), CellMutation("f:c", b"new"), CellMutation("g:", is_delete=True)])
    assert rows.get("h", b"r0", "f:a") == b"v0" and rows.get("h", b"r1", "f:a") is None
    assert rows.get_row("h", b"r1").columns == {"f:c": b"new"} and rows.get_row("h", b"zz") is None
    assert [r.row for r in rows.get_rows("h", [b"r3", b"no", b"r2"], ["g:"])] == [b"r3", b"r2"]
    scanner = rows.scanner_open("h", b"r1", ["f:a"], b"r4")
    assert [r.row for r in rows.scanner_get_list(scanner, 10)] == [b"r2", b"r3"]
    rows.scanner_close(scanner)
    with pytest.raises(StoreError):
        rows.scanner_get(scanner)
    assert len(rows.scanner_get_list(rows.scanner_open_with_prefix("h", b"r"), 99)) == 5


def rows_in(session, text):
    return [tuple(r) for r in session.sql(text).collect()]


def three(session):
    session.sql("CREATE TABLE t (a BIGINT PRIMARY KEY, v BIGINT, w VARCHAR(9) DEFAULT 'd')")
    session.sql("INSERT INTO t (a, v) VALUES (1, 10), (2, 20), (3, 30)")


def test_aliases_and_qualified_names(session):
    three(session)
    assert rows_in(session, "DELETE FROM t AS x WHERE x.a = 1") == [(1,)]
    assert rows_in(session, "DELETE FROM t WHERE t.a = 2;") == [(1,)]
    assert rows_in(session, "UPDATE t y SET y.v = y.v + 1 WHERE y.a = 3") == [(1,)]
    assert rows_in(session, "SELECT a, v FROM t") == [(3, 31)]


@pytest.mark.parametrize(
    "text",
    [
        "DELETE FROM t WHER a = 1", "DELETE FROM t WHERE a = 1 garbage", "UPDATE t SET v = 0 WHER a = 1", "UPDATE t SET v = 0 WHERE a = 1 2", "INSERT INTO t (a, v) VALUES (9, 9) garbage here",
        "INSERT INTO t (a, v) VALUES (9)", "INSERT INTO t (a, a) VALUES (9, 9)", "DROP TABLE t x", "CREATE INDEX i ON t (v) z", "SHOW TABLES t", "SET @x = 1 2", "USE d e", "COMMIT now", "SPLIT TABLE t REGIONS 2 3",
        "INSERT INTO t (a, v) VALUES (1, 2) ON DUPLICATE KEY UPDATE a = 5", "UPDATE t SET a = 7 WHERE a < 3", "UPDATE t SET a = 3 WHERE a = 1", "DROP VIEW t", "EXECUTE nothing",
    ],
)
def test_statements_that_must_change_nothing(session, text):
    three(session)
    with pytest.raises(ValueError):
        session.sql(text)
    assert rows_in(session, "SELECT a, v FROM t ORDER BY a") == [(1, 10), (2, 20), (3, 30)]


def test_insert_ignore_and_on_duplicate(session):
    three(session)
    assert rows_in(session, "INSERT IGNORE INTO t (a, v) VALUES (1, 99), (4, 40), (4, 41)") == [(1,)]
    assert rows_in(session, "SELECT a, v FROM t WHERE a IN (1, 4) ORDER BY a") == [(1, 10), (4, 40)]
    text = "INSERT INTO t (a, v) VALUES (1, 5), (1, 6), (8, 1), (8, 2) ON DUPLICATE KEY UPDATE v = t.v * 2 + VALUES(v), w = concat(w, 'x')"
    assert rows_in(session, text) == [(7,)]
    assert rows_in(session, "SELECT a, v, w FROM t WHERE a IN (1, 8) ORDER BY a") == [(1, 56, "dxx"), (8, 4, "dx")]
    assert rows_in(session, "INSERT INTO t (a, v) SELECT a, 1 FROM t WHERE a < 3 ON DUPLICATE KEY UPDATE v = 0") == [(4,)]
    assert rows_in(session, "SELECT v FROM t WHERE a < 3") == [(0,), (0,)]
    assert rows_in(session, "UPDATE t SET a = a + 10 WHERE a < 3") == [(2,)]
    assert rows_in(session, "SELECT a FROM t ORDER BY a") == [(3,), (4,), (8,), (11,), (12,)]


def test_unique_indexes_hold(session):
    three(session)
    session.sql("CREATE UNIQUE INDEX u ON t (v)")
    for text in ("INSERT INTO t (a, v) VALUES (4, 10)", "UPDATE t SET v = 10 WHERE a = 2", "INSERT INTO t (a, v) VALUES (5, 50), (6, 50)", "UPDATE t SET v = 1"):
        with pytest.raises(StoreError):
            session.sql(text)
    assert rows_in(session, "INSERT IGNORE INTO t (a, v) VALUES (4, 10), (5, 50), (6, 50), (7, NULL), (8, NULL)") == [(3,)]
    assert rows_in(session, "SELECT a, v FROM t ORDER BY a") == [(1, 10), (2, 20), (3, 30), (5, 50), (7, None), (8, None)]
    session.sql("UPDATE t SET v = v + 10 WHERE a < 4")
    session.sql("DELETE FROM t WHERE a = 5")
    session.sql("INSERT INTO t (a, v) VALUES (6, 50), (9, 10)")
    session.sql("DROP INDEX u ON t")
    session.sql("INSERT INTO t (a, v) VALUES (20, 50)")
    assert rows_in(session, "SELECT count(*), count(DISTINCT v) FROM t") == [(8, 5)]


def test_automatic_ids_and_prepared_statements(session):
    session.sql("CREATE TABLE t (id BIGINT AUTO_INCREMENT PRIMARY KEY, v BIGINT)")
    session.sql("INSERT INTO t (v) VALUES (5), (6)")
    assert rows_in(session, "SELECT last_insert_id()") == [(1,)]
    session.sql("INSERT INTO t (id, v) VALUES (NULL, 7), (50, 8)")
    session.sql("INSERT INTO t (v) VALUES (9)")
    assert rows_in(session, "SELECT id, v FROM t ORDER BY id") == [(1, 5), (2, 6), (3, 7), (50, 8), (51, 9)]
    session.sql("PREPARE q FROM 'SELECT v FROM t WHERE id = ?'")
    session.sql("SET @id = 50")
    assert rows_in(session, "EXECUTE q USING @id") == [(8,)] and session.execute("q", [1]).first().v == 5
    session.sql("DEALLOCATE PREPARE q")
    with pytest.raises(ValueError):
        session.sql("EXECUTE q USING @id")


def test_variables_belong_to_a_session(spark, store, session):
    other = Session(spark, store, "d")
    session.sql("SET @x = 5, group_concat_max_len = 3")
    assert rows_in(session, "SELECT @x, @@group_concat_max_len, group_concat(k SEPARATOR '') FROM (SELECT 'abcd' AS k)") == [(5, "3", "abc")]
    assert rows_in(other, "SELECT @x, @@group_concat_max_len, group_concat(k SEPARATOR '') FROM (SELECT 'abcd' AS k)") == [(None, "1024", "abcd")]
    assert rows_in(session, "SELECT database(), schema()") == [("d", "d")]
    assert rows_in(session, "SELECT connection_id()") != rows_in(other, "SELECT connection_id()")


def test_json_objectagg_takes_the_last_of_equal_keys(session):
    assert rows_in(session, "SELECT json_objectagg(k, v) FROM (SELECT 'a' AS k, 1 AS v UNION ALL SELECT 'b', 2)") == [('{"a":1,"b":2}',)]
    assert rows_in(session, "SELECT json_objectagg(k, v) FROM (SELECT 'a' AS k, 1 AS v UNION ALL SELECT 'a', 1)") == [('{"a":1}',)]


def test_split_bounds(session):
    three(session)
    got = sorted((r.region, r.n) for r in session.sql("SPLIT TABLE t BY (2), (3)").collect())
    assert got == [(0, 1), (1, 1), (2, 1)]
    assert sorted((r.region, r.n) for r in session.sql("SPLIT TABLE t BETWEEN (0) AND (4) REGIONS 2").collect()) == [(0, 1), (1, 2)]


def test_a_write_costs_what_it_changes(spark, store):
    client = Client(spark, store)
    client.create_table(TableMeta("d", "t", [Column("k", "bigint"), Column("v", "string")], ["k"]))
    client.mutate("d", "t", [Mutation("insert_or_update", ("k", "v"), tuple((i, f"text {i * 7919 % 1000003}") for i in range(20000)))])
    before = store.meta("d", "t")
    assert [kind for kind, _ in before.layers] == ["base"]
    client.mutate("d", "t", [Mutation("insert_or_update", ("k", "v"), ((5, "new"), (-1, "first")))])
    after = store.meta("d", "t")
    assert after.layers[0] == before.layers[0] and [kind for kind, _ in after.layers[1:]] == ["put"]
    size = lambda meta, at: store._bytes(store._layer(meta, meta.layers[at][1]))
    assert size(after, 1) < size(after, 0) / 4
    assert [r.v for r in client.read("d", "t", KeySet.range(-5, 6), ["v"]).collect()] == ["first", "text 0", *[f"text {i * 7919 % 1000003}" for i in range(1, 5)], "new"]
    assert store.data(before).where("k = 5").first().v != "new"  # a reader of the old version still has it
    for i in range(12):
        client.mutate("d", "t", [Mutation("delete", keys=KeySet.of(100 + i))])
    assert client.read("d", "t", KeySet.all()).count() == 20001 - 12
    assert len(store.meta("d", "t").layers) <= 10
    plan = client.read("d", "t", KeySet.of(7))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,7)" in plan


def test_two_writers(spark, store):
    client = Client(spark, store)
    client.create_table(TableMeta("d", "t", [Column("k", "bigint"), Column("v", "bigint")], ["k"]))
    put = lambda k, tx=None: client.mutate("d", "t", [Mutation("insert_or_update", ("k", "v"), ((k, k),))], tx)
    one, two = client.begin(), client.begin()
    put(1, one)
    put(2, two)
    one.commit()
    with pytest.raises(StoreError):
        two.commit()
    assert [r.k for r in client.read("d", "t", KeySet.all()).collect()] == [1]
    put(3)
    publish, taken = store.commit, []

    def slow(meta):  # another writer publishes between this one's read and its commit
        if not taken:
            taken.append(1)
            put(4)
        publish(meta)

    store.commit = slow
    put(5)
    assert [r.k for r in client.read("d", "t", KeySet.all()).collect()] == [1, 3, 4, 5]


def test_index_reads(spark, store):
    client = Client(spark, store)
    client.create_table(TableMeta("d", "t", [Column("k", "bigint"), Column("w", "bigint"), Column("v", "string")], ["k"]))
    client.mutate("d", "t", [Mutation("insert_or_update", ("k", "w", "v"), tuple((i, i % 50, f"v{i}") for i in range(5000)))])
    client.create_index("d", "t", Index("by_w", ["w"]))
    client.mutate("d", "t", [Mutation("insert_or_update", ("k", "w"), ((3, 77), (6000, 3))), Mutation("delete", keys=KeySet.of(53))])
    assert [r.k for r in client.read("d", "t", KeySet.of(3), ["k"], index="by_w").collect()] == [*range(103, 5000, 50), 6000]
    assert [(r.k, r.v) for r in client.read("d", "t", KeySet.of(77), index="by_w").collect()] == [(3, "v3")]
    assert [r.k for r in client.read("d", "t", KeySet.range(48), ["v", "k"], index="by_w", limit=3, reverse=True).collect()] == [3, 4999, 4949]
    assert client.read("d", "t", KeySet.range(0, 40), ["v"], index="by_w").count() == 40 * 100 - 2 + 1
    covered = client.read("d", "t", KeySet.of(9), ["k", "w"], index="by_w")._jdf.queryExecution().executedPlan().toString()
    assert "v#" not in covered and "EqualTo(w,9)" in covered
    fetched = client.read("d", "t", KeySet.of(9), ["v"], index="by_w")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(k" in fetched


def test_long_lists_of_all_kinds(spark):
    rows = list(itertools.product([None, *range(60)], [None, *range(30)]))
    df = spark.createDataFrame(rows, "a int, b int").cache()
    rng = random.Random(3)
    for n in (3, 60, 1200):
        keys = [rng.choice(rows) for _ in range(n)] + [(rng.choice(rows)[0],) for _ in range(n // 30)]
        want = sorted((r for r in rows if r in set(keys) or r[:1] in set(keys) or (r[0] is not None and r[0] >= 58)), key=order)
        given = KeySet(keys=tuple(keys)) | KeySet.range(58)
        assert sorted(map(tuple, restrict(df, ["a", "b"], given).collect()), key=order) == want
        left = [tuple(r) for r in mutate.delete_keys(df, ["a", "b"], given).collect()]
        assert sorted(left, key=order) == sorted(set(rows) - set(want), key=order)
    whole = KeySet(keys=tuple((i, 1) for i in range(2000)))
    assert restrict(df, ["a", "b"], whole).count() == 60
    assert mutate.delete_keys(df, ["a", "b"], KeySet(keys=tuple((i,) for i in range(1001)))).count() == 31


def test_row_administration(spark, store):
    from quillstore.rows import CellMutation, RowStore

    rows = RowStore(Client(spark, store), "d")
    rows.create_table("h", ["f:"])
    assert rows.atomic_increment("h", b"r", "f:n", 5) == 5
    assert rows.increment_rows("h", [(b"r", "f:n", 1), (b"r", "f:n", -9), (b"s", "f:n", 2)]) == [6, -3, 2]
    assert rows.check_and_put("h", b"r", "f:a", None, CellMutation("f:a", b"1")) and not rows.check_and_put("h", b"r", "f:a", b"2", CellMutation("f:a", b"3"))
    assert rows.get("h", b"r", "f:a") == b"1"
    rows.delete_all("h", b"r", "f:a")
    rows.delete_all_row("h", b"s")
    assert list(rows.get_row("h", b"r").columns) == ["f:n"] and rows.get_row("h", b"s") is None
    rows.disable_table("h")
    assert not rows.is_table_enabled("h")
    for touch in (lambda: rows.get_row("h", b"r"), lambda: rows.delete_all("h", b"r", "f:n"), lambda: rows.scanner_open("h")):
        with pytest.raises(StoreError):
            touch()
    rows.enable_table("h")
    rows.major_compact("h")
    assert [kind for kind, _ in store.meta("d", "h").layers] == ["base"] and rows.get_table_regions("h") == [b"r"]
    rows.delete_table("h")
    assert rows.get_table_names() == []


def test_asof_and_range_joins_against_a_model(spark):
    from quillstore.operators.joins import asof_join, range_join

    rng, start = random.Random(4), datetime.datetime(2024, 1, 1)
    moment = lambda: start + datetime.timedelta(minutes=rng.randint(0, 9000))
    left = [(rng.choice([None, "a", "b"]), moment(), i) for i in range(300)]
    right = [(k, t, i) for i, (k, t) in enumerate({(rng.choice([None, "a", "c"]), moment()) for _ in range(60)})]
    a, b = spark.createDataFrame(left, "k string, t timestamp, i int"), spark.createDataFrame(right, "k string, t timestamp, v int")
    want = [(i, max(((u, v) for q, u, v in right if q == k and u <= t), default=(None, None))[1]) for k, t, i in left]
    for step in ("10 minutes", "1 day", "52 weeks"):
        assert sorted((r.i, r.v) for r in asof_join(a, b, ["k"], "t", ["v"], step).collect()) == sorted(want)
    points, spans = [rng.uniform(-9, 9) for _ in range(200)], [(x, x + rng.uniform(-1, 4)) for x in (rng.uniform(-9, 9) for _ in range(40))]
    p, s = spark.createDataFrame([(x,) for x in points], "p double"), spark.createDataFrame(spans, "lo double, hi double")
    got = sorted((r.p, r.lo) for r in range_join(p, s, "p", "lo", "hi", 1.5).collect())
    assert got == sorted((x, lo) for x in points for lo, hi in spans if lo <= x < hi)


def test_columns_dropped_and_added_again(session):
    three(session)
    session.sql("ALTER TABLE t DROP COLUMN w")
    session.sql("ALTER TABLE t ADD COLUMN w BIGINT")
    assert rows_in(session, "SELECT w FROM t") == [(None,)] * 3
    session.sql("CREATE INDEX i ON t (v)")
    for text in ("ALTER TABLE t DROP COLUMN a", "ALTER TABLE t DROP COLUMN v"):
        with pytest.raises(StoreError):
            session.sql(text)
    session.sql("TRUNCATE TABLE t")
    assert rows_in(session, "SELECT count(*) FROM t") == [(0,)]
