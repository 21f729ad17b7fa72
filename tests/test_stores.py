"""Statements, key-value commands, documents, chains, detectors, channels and quantiles against literal cases and brute force."""

import datetime as dt
import json
import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from stratiform import functions
from stratiform.operators import audit, documents, keyvalue, points, quantiles, replicas, results, timeseries as ts
from stratiform.plans.builder import Query, Statement
from stratiform.sources import storage
from stratiform.sources.database import Database, split_top
from stratiform.sources.tables import run_sql, sql_over
from stratiform.streaming import channels, detect


@pytest.fixture
def db(spark):
    db = Database(spark)
    db.execute("CREATE TABLE users (id INTEGER PRIMARY KEY, name TEXT NOT NULL, age INTEGER CHECK (age > 0), status TEXT DEFAULT 'active')")
    db.execute("INSERT INTO users (id, name, age) VALUES (1, 'Alice', 30), (2, 'Bob', 25), (3, 'Charlie', 35)")
    return db


def test_statements(db):
    assert [tuple(r) for r in db.execute("SELECT name, status FROM users WHERE age > 28 ORDER BY id").collect()] == [("Alice", "active"), ("Charlie", "active")]
    assert db.execute("SELECT name FROM users WHERE id = :id", {"id": 2}).first().name == "Bob"
    assert db.execute("SELECT name FROM users WHERE id = ?", [99]).count() == 0
    assert db.execute("UPDATE users SET age = age + 1, status = 'a; b WHERE' WHERE name = 'Bob'; SELECT age FROM users WHERE status LIKE '%WHERE'").first().age == 26
    assert db.execute("DELETE FROM users WHERE id = 2").first().n_rows == 2
    assert db.execute("CREATE TABLE copy AS SELECT id, name FROM users; SELECT count(*) AS n FROM copy").first().n == 2
    for wrong in ("INSERT INTO users VALUES (1, 'Twin', 3, 'x')", "INSERT INTO users (id, age) VALUES (9, 3)", "INSERT INTO users (id, name, age) VALUES (9, 'x', -1)", "UPDATE users SET id = 1", "DROP TABLE nothing", "EXPLAIN SELECT 1", "CREATE TABLE users (x INTEGER)", "ALTER TABLE users ADD COLUMN name TEXT", "INSERT INTO users (zip) VALUES (1)", "CREATE TABLE x (a NOTATYPE)"):
        with pytest.raises(ValueError):
            db.execute(wrong)
    assert db.execute("SELECT count(*) AS n FROM users").first().n == 2
    with pytest.raises(AnalysisException):
        db.execute("SELECT no_such_function(name) FROM users")


def test_schema_changes_write_no_data(db, spark):
    def folders():
        return storage.names(spark, f"{db.root}/tables")

    before = folders()
    db.execute("ALTER TABLE users ADD COLUMN zip TEXT DEFAULT '000'; ALTER TABLE users RENAME COLUMN name TO label; ALTER TABLE users DROP COLUMN status; ALTER TABLE users ADD COLUMN status INTEGER; ALTER TABLE users RENAME TO people")
    assert folders() == before
    db.execute("INSERT INTO people (id, label, zip) VALUES (4, 'Dora', '1'), (5, 'Eve', NULL)")
    rows = [tuple(r) for r in db.execute("SELECT id, label, zip, status FROM people ORDER BY id").collect()]
    assert rows == [(1, "Alice", "000", None), (2, "Bob", "000", None), (3, "Charlie", "000", None), (4, "Dora", "1", None), (5, "Eve", None, None)]
    assert [r.name for r in db.describe("people").orderBy("place").collect()] == ["id", "label", "age", "zip", "status"]


def test_foreign_keys_indexes_and_snapshots(db, spark):
    db.execute("CREATE TABLE orders (id INTEGER, user_id INTEGER REFERENCES users (id)); INSERT INTO orders VALUES (1, 1), (2, NULL); ALTER TABLE users RENAME TO people")
    with pytest.raises(ValueError):
        db.execute("INSERT INTO orders VALUES (3, 42)")
    db.execute("CREATE INDEX by_user ON orders (user_id)")
    assert db.indexes() == [("by_user", "orders", ["user_id"], False)]
    with pytest.raises(ValueError):
        db.execute("CREATE INDEX by_user ON orders (id)")
    folder = storage.fresh_dir(spark, "snapshot")
    db.save_snapshot(folder)
    db.execute("DROP INDEX by_user; DROP TABLE orders; CREATE TABLE other (x INTEGER)")
    db.load_snapshot(folder)
    assert {(r.name, r.n_rows) for r in db.tables().collect()} == {("orders", 2), ("people", 3)} and len(db.indexes()) == 1
    with pytest.raises(FileExistsError):  # a writer that began from an older state
        number, state = db._latest()
        db._commit(number, state)
        db._commit(number, state)


def test_views_of_the_user_stay(spark):
    spark.range(3).createOrReplaceTempView("nation")
    out = sql_over(spark, {"nation": lambda: spark.range(7)}, "SELECT count(*) AS n FROM nation")
    assert out.first().n == 7 and spark.table("nation").count() == 3
    spark.catalog.dropTempView("nation")
    assert run_sql(spark, "/nowhere", "SELECT 1 + 1 AS result").first().result == 2
    assert split_top("a(1,2), 'x,\\'y', b", ",") == ["a(1,2)", "'x,\\'y'", "b"]


def test_builders(db, spark):
    q = Query(db.read("users")).where_like("name", "%li%").order_by("id")
    assert [r["name"] for r in q.to_dicts()] == ["Alice", "Charlie"] and len(q.to_dataframe()) == 2
    Statement("update", "users").set(name="O'Hara\\").where("id", "=", 1).run(db)
    assert db.execute("SELECT name FROM users WHERE id = 1").first().name == "O'Hara\\"


def test_kv_by_brute_force(spark):
    rng = random.Random(2)
    log, state, swaps = [], {}, {}
    for i in range(600):
        key, op = rng.choice("abcdefgh"), rng.choice(["put", "delete", "cas", "cas", "increment", "increment"])
        value, expected = rng.choice(["1", "2", "x", None if op == "cas" else "3"]), rng.choice(["1", "2", "3", None])
        log.append((key, i, op, value, expected))
        now = state.get(key)
        if op in ("put", "delete"):
            swaps[key] = 0
            state[key] = value if op == "put" else None
        elif op == "increment":
            state[key] = str(int(now) + 1 if now and now.isdigit() else 1)
        elif now == expected and value is not None:
            state[key] = value
            swaps[key] = swaps.get(key, 0) + 1
    got = {r.key: (r.value, r.n_swapped) for r in keyvalue.state(spark.createDataFrame(log, "key string, seq long, op string, value string, expected string")).collect()}
    assert got == {k: (v, swaps.get(k, 0)) for k, v in state.items() if v is not None}


def test_document_types(spark):
    doc = json.dumps({"name": "Alice", "age": 30, "rate": 1.5, "active": True, "none": None, "tags": ["a", 2], "o": {"id": 7, "s": 'x"id":8,'}, "digits": "30"})
    df = spark.createDataFrame([(1, doc), (2, "no json"), (3, None)], "id long, doc string")
    hit = lambda q: [r.id for r in df.where(documents.condition("doc", q)).collect()] == [1]
    assert hit({"name": {"$regex": "^Al"}}) and not hit({"age": {"$regex": "^3"}}) and hit({"digits": {"$regex": "^3"}})
    assert not hit({"age": {"$contains": "3"}}) and not hit({"digits": 30}) and hit({"age": 30.0}) and not hit({"age": "30"})
    assert hit({"tags": {"$contains": "a"}}) and hit({"tags": {"$contains": 2}}) and not hit({"tags": {"$contains": "2"}})
    assert not hit({"name": {"$regex": "("}}) and hit({"none": None}) and hit({"o.id": {"$gt": 6}}) and not hit({"name": {"$gt": 5}})
    one = df.where("id = 1")
    rules = {"name": {"type": "int"}, "age": {"type": "int", "max": 20}, "rate": {"type": "float", "min": 2}, "none": {"nullable": False}, "zip": {"required": True, "type": "string"}, "tags": {"min_length": 3, "items": "string"}, "active": {"type": "bool"}, "o": {"properties": {"id": {"enum": [8, 9]}, "s": {"pattern": "^y"}}}}
    errors = one.select(documents.errors("doc", rules, additional=False)).first()[0]
    assert errors == ["name: type", "age: max", "rate: min", "none: nullable", "zip: required", "tags: min_length", "tags: items", "o.id: enum", "o.s: pattern", "additional: digits"]
    contains = lambda f, v: one.where(functions.json_contains(F.col("doc"), f, v)).count() == 1
    assert contains("id", 7) and not contains("id", 8) and contains("active", True) and contains("name", "Alice") and not contains("name", "Ali")
    patched = json.loads(one.select(documents.patch("doc", {"age": F.lit(31), "new": F.lit("n")})).first()[0])
    assert patched == json.loads(doc) | {"age": 31, "new": "n"}


def test_full_text(spark):
    texts = [(1, "The cat, the CAT and 2 dogs"), (2, "a dog"), (3, ""), (4, None), (5, "Katze Öl öl")]
    df = spark.createDataFrame(texts, "id long, text string")
    index = documents.inverted_index(df, "text", "id")
    assert {(r.term, r.id, r.n) for r in index.collect()} == {("the", 1, 2), ("cat", 1, 2), ("and", 1, 1), ("dogs", 1, 1), ("dog", 2, 1), ("katze", 5, 1), ("öl", 5, 2)}
    for query, every, want in (("the cat", True, {1}), ("cat dog", False, {1, 2}), ("cat dog", True, set()), (" , a", True, set()), ("ÖL", True, {5})):
        assert {r.id for r in documents.search(df, "text", query, every).collect()} == want
        assert {r.id for r in documents.search_index(index, "id", query, every).collect()} == want


def test_chain(spark, tmp_path):
    entries = list(audit.chain([f"login {i}" for i in range(20)]))
    log = spark.createDataFrame(entries, "seq long, payload string, prev_hash string, hash string")
    audit.write_log(log, str(tmp_path / "log"), lines=6)
    whole = audit.read_log(spark, str(tmp_path / "log"))
    assert whole.count() == 20 and audit.verify(whole, genesis=audit.GENESIS).count() == 0
    faults = lambda df, **k: {(r.seq, r.fault) for r in audit.verify(df, **k).collect()}
    assert faults(whole.withColumn("payload", F.when(F.col("seq") == 5, "forged").otherwise(F.col("payload")))) == {(5, "hash")}
    assert faults(whole.where("seq <> 7")) == {(8, "gap")}
    assert faults(whole.where("seq >= 3")) == set() and faults(whole.where("seq >= 3"), genesis=audit.GENESIS) == {(3, "start")}
    forged = list(audit.chain(["forged"], prev=entries[3][3], first=5))
    assert faults(whole.where("seq <> 5").union(spark.createDataFrame(forged, log.schema))) == {(5, "link"), (6, "link")}


def brute_bursts(rows, threshold, seconds):
    fired, open_ = set(), {}
    for key, event, at in sorted(rows, key=lambda r: (r[2], r[1])):
        now = [t for t in open_.get(key, []) if at - t <= dt.timedelta(seconds=seconds)] + [at]
        if len(now) >= threshold:
            fired.add((key, event))
            now = []
        open_[key] = now
    return fired


def test_bursts_by_brute_force(spark, tmp_path):
    rng = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    rows = [(rng.choice("abc"), i, start + dt.timedelta(seconds=rng.randrange(4000))) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, event_id long, ts timestamp")
    for threshold, seconds in ((3, 30), (5, 100), (2, 1)):
        got = {(r.key, r.event) for r in detect.bursts(df, F.col("key"), threshold, seconds).collect()}
        assert got == brute_bursts(rows, threshold, seconds) and got
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = detect.bursts_stream(stream, 3, 30).writeStream.format("memory").queryName("bursts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.key, r.event_id) for r in spark.table("bursts").collect()} == brute_bursts(rows, 3, 30)


def test_channels(spark):
    root = storage.fresh_dir(spark, "channels")
    rows = [(i, "a" if i % 2 else "b", "s", dt.datetime(2024, 1, 1, 0, 0, i), None) for i in range(10)]
    channels.publish(spark.createDataFrame(rows, channels.EVENT), root, "one", "two")
    assert [r.event_id for r in channels.history(spark, root, "one", 3).collect()] == [9, 8, 7]
    heard = channels.subscribe(spark, root, "one", where=F.col("event_type") == "a")
    for _ in range(2):  # the second run finds nothing new
        channels.publish_stream(heard, root, f"{root}-cp", ["three", "four"]).awaitTermination()
    for name in ("three", "four"):
        assert sorted(r.event_id for r in channels.history(spark, root, name).collect()) == [1, 3, 5, 7, 9]


def test_points(spark):
    root = storage.fresh_dir(spark, "points")
    points.register(spark, root, "cpu", "counter", "s")
    with pytest.raises(ValueError):
        points.register(spark, root, "cpu")
    start = dt.datetime(2024, 1, 1)
    rows = [(m, {"host": h}, start + dt.timedelta(hours=i), float(i)) for m in ("cpu", "mem") for h in "xy" for i in range(72)]
    points.write(spark.createDataFrame(rows, "metric string, tags map<string,string>, ts timestamp_ntz, value double"), root)
    found = points.read(spark, root, "mem", F.lit(start + dt.timedelta(hours=30)).cast("timestamp_ntz"), F.lit(start + dt.timedelta(hours=40)).cast("timestamp_ntz"))
    assert sorted(r.value for r in found.collect()) == sorted([float(i) for i in range(30, 40)] * 2)
    assert {(r.metric, r.kind) for r in points.metrics(spark, root).collect()} == {("cpu", "counter"), ("mem", "gauge")}
    assert points.drop_series(points.read(spark, root), "cpu", {"host": "x"}).count() == 72 * 3


def test_quantiles_by_brute_force(spark):
    rng = random.Random(3)
    data = {"a": [rng.random() for _ in range(5000)], "b": [float(rng.randrange(3)) for _ in range(999)], "c": [7.0], "d": [1.0, 2.0]}
    rows = [(k, v) for k, vs in data.items() for v in vs] + [("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    qs = {"p0": 0.0, "p50": 0.5, "p90": 0.9, "p99": 0.99, "p100": 1.0}
    near = {r.k: tuple(r)[1:] for r in quantiles.nearest_rank(df, ["k"], "v", qs).collect()}
    assert near == {k: tuple(sorted(vs)[min(int(len(vs) * q), len(vs) - 1)] for q in qs.values()) for k, vs in data.items()}
    mid = {r.k: tuple(r)[1:] for r in quantiles.interpolated(df, ["k"], "v", qs).collect()}
    for k, vs in data.items():
        s = sorted(vs)
        for got, q in zip(mid[k], qs.values()):
            at = (len(s) - 1) * q
            want = s[int(at)] + (s[min(int(at) + 1, len(s) - 1)] - s[int(at)]) * (at - int(at))
            assert abs(got - want) < 1e-9


def test_rolling_by_brute_force(spark):
    rng = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    rows = [(rng.choice("xy"), i, start + dt.timedelta(seconds=rng.randrange(3000)), float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "s string, id long, ts timestamp_ntz, value double")
    got = {r.id: r.rolled for r in ts.rolling(df, ["s"], "10 seconds", "sum").collect()}
    assert got == {i: sum(v for s2, _, t2, v in rows if s2 == s and t - dt.timedelta(seconds=10) <= t2 <= t) for s, i, t, _ in rows}


def test_registers_and_sets(spark):
    v = spark.sql("SELECT 1 AS id, v AS value, c AS clock FROM VALUES ('a', map('x', 1)), ('b', map('x', 2)), ('c', map('y', 1)), ('b', map('x', 2)) t(v, c)")
    assert sorted(r.value for r in replicas.multi_value(v).collect()) == ["b", "c"]
    s = spark.createDataFrame([(1, 0, "e", 1, False), (1, 0, "e", 1, True), (1, 1, "e", 1, False), (1, 0, "f", 2, False), (1, 0, "f", 2, True)], "id long, replica long, e string, tag long, removed boolean")
    assert [(r.e, r.tags) for r in replicas.or_set(s).collect()] == [("e", 1)]


def test_results(spark):
    df = spark.createDataFrame([(1, 'a "b", c', None)], "id long, name string, x string")
    assert results.csv_lines(df).first().line.startswith('1,"a ') and results.csv_header(df) == "id,name,x"
    assert json.loads(results.json_lines(df).first().line) == {"id": 1, "name": 'a "b", c', "x": None}
    assert results.text_table(df).count("\n") == 4 and "NULL" in results.text_table(df)
