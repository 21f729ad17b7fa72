"""All registered queries and their SQL."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with the SQL that gives the same rows."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query(
    "revenue_by_nation",
    """SELECT n_name, o_orderpriority, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n_lines
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       WHERE l_shipdate >= timestamp '1995-01-01' GROUP BY n_name, o_orderpriority HAVING count(*) >= 2
       ORDER BY revenue DESC, n_name, o_orderpriority LIMIT 100""",
)
def revenue_by_nation(spark, d):
    from pyspark.sql import functions as F

    t = lambda name: spark.read.parquet(f"{d}/{name}.parquet")
    lines = t("lineitem").where("l_shipdate >= timestamp_ntz '1995-01-01'")
    joined = lines.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    out = joined.groupBy("n_name", "o_orderpriority").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n_lines"))
    return out.where("n_lines >= 2").orderBy(F.desc("revenue"), "n_name", "o_orderpriority").limit(100)


from . import models, relational, stores  # noqa: E402,F401  registers their queries
