"""Literal cases for the operators, and one streaming run."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from stratiform.operators import dml, documents, replicas, timeseries as ts
from stratiform.plans.builder import Query
from stratiform.streaming import pipeline


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame([(1, "Alice", 30), (2, "Bob", 25), (3, "Charlie", 35)], "id long, name string, age long")


def test_every_query_has_sql():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries)
    assert {n for n in queries if not n.startswith("op") and n != "pipeline"} <= set(sql)


def test_builder(users):
    assert Query(users).where("age", ">", 28).count() == 2
    assert Query(users).order_by("age").limit(2).pluck("name") == ["Bob", "Alice"]
    assert not Query(users).where("name", "=", "Nobody").exists()


def test_dml(users):
    changed = dml.update(users, F.col("age") > 28, age=F.col("age") + 1)
    assert sorted(r.age for r in changed.collect()) == [25, 31, 36]
    assert dml.delete(users, F.col("age") > 28).count() == 1
    assert dml.insert(users, users.select("id"), {"name": F.lit("x")}).where("name = 'x' and age is null").count() == 3
    with pytest.raises(ValueError):
        dml.add_column(users, "age", F.lit(1))


def test_timeseries(spark):
    start = dt.datetime(2023, 11, 14, 22, 13, 20)
    points = spark.createDataFrame([("a", start + dt.timedelta(seconds=i), float(i)) for i in range(100)], "s string, ts timestamp_ntz, value double")
    assert ts.downsample(points, ["s"], "10 seconds", "avg").count() == 10
    rolled = ts.rolling(points, ["s"], "3 seconds", "count").agg(F.max("rolled")).first()[0]
    assert rolled == 4
    row = ts.instant(points.where("value < 5"), ["s"], "rate").first()
    assert row.value == 1.0


def test_documents(spark):
    doc = '{"name":"Alice","age":30,"active":true,"none":null}'
    df = spark.createDataFrame([(1, doc)], "id long, doc string")
    hit = lambda q: df.where(documents.condition("doc", q)).count() == 1
    assert hit({"name": "Alice", "age": {"$gte": 30, "$lt": 31}})
    assert hit({"none": {"$exists": True}}) and hit({"zip": {"$exists": False}}) and hit({"zip": {"$ne": 1}})
    assert not hit({"zip": 1}) and hit({"$or": [{"age": 1}, {"active": True}]})


def test_clocks(spark):
    row = spark.sql("SELECT map('a', 1) AS x, map('a', 1, 'b', 2) AS y, map('a', 2) AS z").select(*[replicas.clock_compare(F.col(p), F.col(q)).alias(p + q) for p, q in ("xy", "yx", "yz", "xx")]).first()
    assert list(row) == ["before", "after", "concurrent", "equal"]


def test_stream(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1, 0, 0, i * 7 % 60), "click", float(i)) for i in range(20)]
    spark.createDataFrame(rows, "id long, ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    out = pipeline.tumbling(stream, "10 seconds", F.count("*").alias("n"), lateness="1 minute")
    q = out.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("windows").agg(F.sum("n")).first()[0] == 20


def test_multi_value_registers(spark, tmp_path):
    """Every supplier's non-dominated versions, by brute force."""
    rows = [(s, float(q * 7 % 11), q * s % 9 / 100) for s in (1, 20, 21, 500, 1000) for q in range(12)] + [(21, 3.0, 0.05), (21, 3.0, 0.05)]
    spark.createDataFrame(rows, "l_suppkey long, l_quantity double, l_tax double").write.parquet(str(tmp_path / "lineitem.parquet"))
    want = {(s, q, t) for s, q, t in rows if not any(x == s and a >= q and b >= t and (a > q or b > t) for x, a, b in rows)}
    got = [tuple(r) for r in __spark_entry__.queries()["crdt_mv"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want
