"""Relational queries. Text that both engines read alike is registered once for both."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions
from ..operators import dml
from ..sources.tables import load, run_sql
from .builder import Query
from .catalog import query

#: name -> SQL that Spark and the oracle share.
SHARED = {
    "scan_table": "SELECT * FROM nation",
    "select_without_from": "SELECT 1 + 1 AS result",
    "index_range_lookup": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 100 AND 400",
    "index_eq_lookup": "SELECT * FROM customer WHERE c_custkey = 42",
    "unique_violations": "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1",
    "fk_violations": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_nationkey < 20)",
    "project_expr": "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) AS net FROM lineitem",
    "select_star": "SELECT * FROM region",
    "select_table_star": "SELECT n.* FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_regionkey = 1",
    "filter_predicate": "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'",
    "arith_ops": "SELECT p_partkey, p_size + 1 AS a, p_size - 1 AS s, p_size * 2 AS m, round(p_retailprice / 2, 4) AS d FROM part",
    "modulo": "SELECT c_custkey, c_custkey % 7 AS m, (0 - c_custkey) % 7 AS neg FROM customer",
    "compare_ops": "SELECT p_partkey, p_size = 5 AS eq, p_size <> 5 AS ne, p_size < 5 AS lt, p_size <= 5 AS le, p_size > 5 AS gt, p_size >= 5 AS ge FROM part",
    "logical_ops": "SELECT p_partkey, p_size > 5 AND p_retailprice > 1000 AS a, p_size > 5 OR p_retailprice > 1000 AS o, NOT p_size > 5 AS n, CAST(NULL AS BOOLEAN) AND FALSE AS k FROM part",
    "unary_ops": "SELECT s_suppkey, -s_acctbal AS neg, +s_acctbal AS pos FROM supplier",
    "concat_op": "SELECT c_custkey, c_name || '-' || c_mktsegment AS tag, c_name || CAST(NULL AS VARCHAR(5)) AS none FROM customer",
    "is_null": "SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000 WHERE o_orderkey IS NULL",
    "in_list": "SELECT n_name FROM nation WHERE n_regionkey IN (1, 3) AND n_nationkey NOT IN (2, 8)",
    "between": "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice NOT BETWEEN 1000 AND 1200",
    "like_pattern": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%e%' AND p_type NOT LIKE 'S%'",
    "like_underscore": "SELECT n_name FROM nation WHERE n_name LIKE '_________'",
    "case_searched": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders",
    "case_simple": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS code FROM orders",
    "in_subquery": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    "not_in_subquery": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 250000)",
    "exists_subquery": "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49)",
    "not_exists_subquery": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)",
    "scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)",
    "correlated_subquery": "SELECT o_orderkey, o_custkey FROM orders o WHERE o_totalprice > (SELECT avg(i.o_totalprice) + 0.001 FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "derived_table": "SELECT k, n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) t WHERE n > 12",
    "row_policy_filter": "SELECT * FROM supplier WHERE s_nationkey = 7",
    "join_inner": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    "join_left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000",
    "join_right": "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_totalprice > 200000",
    "join_full": "SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey AND c_nationkey > 3",
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "join_theta": "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey",
    "join_multiway": "SELECT n_name, r_name, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "join_self": "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey",
    "agg_global": "SELECT count(*) AS n, round(sum(l_quantity), 2) AS q, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem",
    "agg_group_by": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS s FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_group_by_expr": "SELECT o_custkey % 10 AS g, count(*) AS n FROM orders GROUP BY o_custkey % 10",
    "agg_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10",
    "agg_count": "SELECT count(*) AS a, count(o_orderkey) AS b FROM customer LEFT JOIN orders ON c_custkey = o_custkey",
    "agg_sum_avg": "SELECT c_mktsegment, round(sum(c_acctbal), 2) AS s, round(avg(c_acctbal), 4) AS a FROM customer GROUP BY c_mktsegment",
    "agg_min_max": "SELECT p_brand, min(p_name) AS lo, max(p_retailprice) AS hi FROM part GROUP BY p_brand",
    "agg_count_distinct": "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag",
    "agg_expression": "SELECT o_orderstatus, round(CAST(count(*) AS DOUBLE) * 100 / (SELECT count(*) FROM orders), 8) AS share FROM orders GROUP BY o_orderstatus",
    "select_distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "sort_multi": "SELECT c_mktsegment, c_custkey FROM customer ORDER BY c_mktsegment DESC NULLS FIRST, c_custkey ASC NULLS LAST",
    "sort_nulls": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000 ORDER BY o_orderkey ASC NULLS LAST, c_custkey",
    "limit_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25",
    "top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "fn_upper_lower": "SELECT n_nationkey, upper(n_name) AS u, lower(n_name) AS l FROM nation",
    "fn_abs": "SELECT s_suppkey, abs(CAST(s_acctbal AS DOUBLE)) AS a FROM supplier",
    "fn_coalesce": "SELECT c_custkey, coalesce(o_orderkey, -1) AS k FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000",
    "fn_nullif": "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders",
    "fn_trim_concat_substring": "SELECT c_custkey, trim('  x ') AS t, concat(c_name, '!') AS c, substring(c_name, 2, 4) AS s FROM customer",
    "fn_ceil_floor_round": "SELECT s_suppkey, CAST(ceil(s_acctbal) AS BIGINT) AS c, CAST(floor(s_acctbal) AS BIGINT) AS f, round(s_acctbal, 1) AS r FROM supplier",
    "fn_date": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders",
    "insert_select": "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT r_regionkey + 100, r_name FROM region",
    "window_rank": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders",
    "window_functions": "SELECT o_custkey, o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS dr, lag(o_orderkey) OVER w AS prev, lead(o_orderkey) OVER w AS nxt, first_value(o_orderkey) OVER w AS head, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 2) AS two FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "set_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION ALL SELECT r_regionkey + 1000 FROM region",
    "set_except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000",
    "with_cte": "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), top AS (SELECT max(total) AS most FROM big) SELECT o_custkey, round(total, 2) AS total FROM big, top WHERE total > most / 2",
    "fn_now": "SELECT now() > TIMESTAMP '2020-01-01 00:00:00' AS after, current_timestamp >= TIMESTAMP '2020-01-01 00:00:00' AS also, current_date > DATE '2020-01-01' AS today, nullif(1, 1) AS nothing",
    "set_operations": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
}


def _register(name: str, text: str) -> None:
    query(name, text)(lambda spark, d: run_sql(spark, d, text))


for _name, _text in SHARED.items():
    _register(_name, _text)


@query("cast_expr", "SELECT p_partkey, CAST(trunc(p_retailprice) AS INTEGER) AS i, CAST(p_size AS VARCHAR) AS s, p_size <> 0 AS b FROM part")
def cast_expr(spark, d):
    return run_sql(spark, d, "SELECT p_partkey, CAST(p_retailprice AS INT) AS i, CAST(p_size AS STRING) AS s, CAST(p_size AS BOOLEAN) AS b FROM part")


@query("fn_length", "SELECT doc_id, strlen(text) AS bytes, length(text) AS chars FROM documents")
def fn_length(spark, d):
    return load(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.char_length("text").cast("long").alias("chars"))


#: CRC-32 bit by bit, in the oracle.
_CRC = "list_reduce([ord(c) FOR c IN string_split(c_name, '')], lambda acc, b: list_reduce(range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(acc, b)), 4294967295)"


@query("fn_hash_crc", f"SELECT c_custkey, md5(c_name) AS m, xor({_CRC}, 4294967295) AS crc, CAST(('0x' || substr(md5(c_name), 1, 8)) AS BIGINT) % 1024 AS ring FROM customer")
def fn_hash_crc(spark, d):
    name = F.col("c_name")
    return load(spark, d, "customer").select("c_custkey", functions.hash128(name).alias("m"), functions.crc32(name).alias("crc"), functions.ring_hash(name, 1024).alias("ring"))


@query("param_query", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3 AND c_acctbal > 1000")
def param_query(spark, d):
    return run_sql(spark, d, "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = :nation AND c_acctbal > :least", nation=3, least=1000)


@query("update_rows", "SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_acctbal < 0 THEN s_acctbal * 2 ELSE s_acctbal END AS s_acctbal FROM supplier")
def update_rows(spark, d):
    return dml.update(load(spark, d, "supplier"), F.col("s_acctbal") < 0, s_acctbal=F.col("s_acctbal") * 2)


@query("delete_rows", "SELECT * FROM supplier WHERE NOT coalesce(s_acctbal > 5000, false)")
def delete_rows(spark, d):
    return dml.delete(load(spark, d, "supplier"), F.col("s_acctbal") > 5000)


@query("alter_add_column", "SELECT *, 'new' AS status FROM region")
def alter_add_column(spark, d):
    return dml.add_column(load(spark, d, "region"), "status", F.lit("new"))


@query("alter_drop_column", "SELECT n_nationkey, n_name FROM nation")
def alter_drop_column(spark, d):
    return dml.drop_column(load(spark, d, "nation"), "n_regionkey")


@query("alter_rename_column", "SELECT r_regionkey AS id, r_name FROM region")
def alter_rename_column(spark, d):
    return load(spark, d, "region").withColumnRenamed("r_regionkey", "id")


@query("alter_column_type", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region")
def alter_column_type(spark, d):
    return load(spark, d, "region").withColumn("r_regionkey", F.col("r_regionkey").cast("long"))


@query("builder_query", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE (c_acctbal > 1000 OR c_nationkey = 3) AND c_nationkey IN (1, 2, 3, 4) GROUP BY c_mktsegment HAVING count(*) > 5 ORDER BY n DESC, c_mktsegment LIMIT 3")
def builder_query(spark, d):
    q = Query(load(spark, d, "customer")).where("c_acctbal", ">", 1000).or_where("c_nationkey", "=", 3).where_in("c_nationkey", [1, 2, 3, 4])
    return q.select(F.count("*").alias("n")).group_by("c_mktsegment").having(F.col("n") > 5).order_by("n", descending=True).order_by("c_mktsegment").limit(3).build()
