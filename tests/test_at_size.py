"""Cases that only larger tables met: fractions of seconds, dense series, many versions, many documents."""

import datetime as dt
import random

import duckdb
from pyspark.sql import functions as F

import __spark_entry__
from stratiform.operators import documents, points, replicas, timeseries as ts


def test_history_to_the_microsecond(spark, tmp_path):
    now = dt.datetime(2024, 3, 1, 12, 0, 0, 250_000)
    edges = [now - dt.timedelta(seconds=n) + dt.timedelta(microseconds=us) for n in points.RANGES.values() for us in (-250_000, -1, 0, 1)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*edges, now])], "event_id long, ts timestamp_ntz")
    df.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = {tuple(r) for r in __spark_entry__.queries()["metrics_history"](spark, str(tmp_path)).collect()}
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet/*.parquet'")
        assert got == set(c.execute(__spark_entry__.oracle_sql()["metrics_history"]).fetchall())
    assert {(s, n) for s, n, _ in got} == {(s, 4 * i + 3) for i, s in enumerate(points.RANGES)}


def test_many_versions_of_one_register(spark):
    """A sweep: an id's versions may fill many blocks and batches, and nodes may first come up late."""
    rng = random.Random(6)
    wave = [("wave", i, {"a": i + 1, "b": 3000 - i}) for i in range(3000)] + [("wave", -i, {"a": i, "b": 2999 - i} | ({"z": 1} if i % 10 == 0 else {})) for i in range(1, 2999)]
    some = [(rng.choice("xyz"), rng.randrange(5), {n: rng.randrange(4) for n in "abcde" if rng.random() < 0.6}) for _ in range(400)]
    odd = [("n", 1, None), ("n", 2, {"a": 1}), ("n", 3, {"a": 0}), (None, 4, {"a": 1}), (None, 5, {"a": 2}), ("e", 6, {}), ("e", 6, {"a": 0}), ("e", 7, {})]
    for name, rows in (("one", wave), ("some", some), ("odd", odd)):
        clocks = {(i, v, None if c is None else frozenset((k, n) for k, n in c.items() if n)) for i, v, c in rows}
        of = {}
        for i, _, c in clocks:
            of.setdefault(i, set()).add(c)
        up_to = lambda a, b: all(n <= dict(b).get(k, 0) for k, n in a)
        beaten = {(i, a) for i, cs in of.items() for a in cs for b in cs if i is not None and None not in (a, b) and a != b and up_to(a, b)} if name != "one" else {("wave", c) for i, v, c in clocks if v < 0 and not any(k == "z" for k, _ in c)}
        df = spark.createDataFrame(rows, "id string, value int, clock map<string,int>").repartition(3)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
        got = [(r.id, r.value, None if r.clock is None else frozenset((k, n) for k, n in r.clock.items() if n)) for r in replicas.multi_value(df).collect()]
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert len(got) == len(set(got)) and set(got) == {(i, v, c) for i, v, c in clocks if (i, c) not in beaten}, name


def test_registers_are_not_joined_with_themselves(spark):
    """Pairs of versions of an id are quadratic."""
    df = spark.createDataFrame([("x", 1, {"a": 1})], "id string, value int, clock map<string,int>")
    plan = replicas.multi_value(df)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_rolling_of_dense_series(spark):
    """Every aggregate by brute force, with ties, nulls and gaps; running totals, not one pass for every point."""
    rng = random.Random(7)
    start = dt.datetime(2024, 1, 1)
    rows = [(rng.choice(["x", "y", None]), i, start + dt.timedelta(seconds=rng.randrange(20) * rng.choice((1, 7)), microseconds=rng.choice((0, 1))), rng.choice((None, 1.5, -2.0, float(i)))) for i in range(300)]
    rows += [("x", 1000 + i, None, 3.0) for i in range(3)]
    df = spark.createDataFrame(rows, "s string, id long, ts timestamp_ntz, value double")
    for how, of in (("sum", sum), ("count", len), ("min", min), ("max", max), ("avg", lambda v: sum(v) / len(v))):
        out = ts.rolling(df, ["s"], "10 seconds", how)
        got = {r.id: r.rolled for r in out.collect()}
        assert len(got) == len(rows)
        for s, i, t, _ in rows:
            window = [v for s2, _, t2, v in rows if s2 == s and v is not None and (t2 is None if t is None else t2 is not None and t - dt.timedelta(seconds=10) <= t2 <= t)]
            want = of(window) if window or how == "count" else None
            assert got[i] == want or abs(got[i] - want) < 1e-9, (how, s, i, t)
        assert "RangeFrame, -" not in out._jdf.queryExecution().executedPlan().toString()
    whole = df.select("s", "ts", F.col("value").cast("decimal(10,2)").alias("value"))
    assert ts.rolling(whole, ["s"], "10 seconds", "sum").schema["rolled"].dataType.simpleString() == "decimal(20,2)"
    assert ts.rolling(whole, ["s"], "10 seconds", "avg").schema["rolled"].dataType.simpleString() == "decimal(14,6)"


def test_validation_parses_a_document_once(spark):
    doc = '{"a": "x", "o": {"n": 9, "s": "yy", "l": [1, "b"]}, "z": 1, "big": 1e400}'
    df = spark.createDataFrame([(1, doc), (2, "no json"), (3, None), (4, "{}")], "id long, doc string")
    rules = {"a": {"min_length": 2, "type": "int"}, "o": {"properties": {"n": {"max": 8, "min": 1}, "l": {"items": "string", "max_length": 1}}, "type": "array"}, "big": {"max": 5}, "r": {"required": True}}
    out = df.select("id", documents.errors("doc", rules, additional=False).alias("e"))
    assert {r.id: r.e for r in out.collect()} == {
        1: ["a: min_length", "a: type", "o.n: max", "o.l: items", "o.l: max_length", "o: type", "big: max", "r: required", "additional: z"],
        2: ["r: required"], 3: ["r: required"], 4: ["r: required"],
    }
    assert [r.e for r in df.select(documents.errors("doc", {}).alias("e")).collect()] == [[]] * 4
    assert out._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") + out._jdf.queryExecution().optimizedPlan().toString().lower().count("parse_json") == 1
