"""Time-series, document, full-text, key-value, graph, stream, replica and audit queries over
the driver's tables: events are points, messages and log entries; nations and their members a graph."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import json_contains
from ..operators import audit, dml, documents, graph, quantiles, replicas, timeseries as ts
from ..sources.tables import load, run_sql
from ..streaming import pipeline
from .catalog import query

#: AGGREGATES of timeseries in the oracle's words; {v} value, {t} time order.
ORACLE = {
    "sum": "sum(value)", "count": "count(value)", "min": "min(value)", "max": "max(value)", "avg": "avg(value)",
    "first": "arg_min(value, row(ts, event_id))", "last": "arg_max(value, row(ts, event_id))", "median": "quantile_cont(value, 0.5)",
    "p90": "quantile_cont(value, 0.9)", "p99": "quantile_cont(value, 0.99)", "stddev": "stddev_pop(value)", "variance": "var_pop(value)",
    "rate": "(arg_max(value, row(ts, event_id)) - arg_min(value, row(ts, event_id))) / nullif(count(value) - 1, 0)",
    "increase": "CASE WHEN count(value) >= 2 THEN arg_max(value, row(ts, event_id)) - arg_min(value, row(ts, event_id)) END",
}


def events(spark, d):
    return load(spark, d, "events")


def _downsample(how: str) -> None:
    @query(f"ts_downsample_{how}", f"SELECT event_type, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS bucket, round({ORACLE[how]}, 8) AS value FROM events GROUP BY ALL")
    def run(spark, d):
        out = ts.downsample(events(spark, d), ["event_type"], "1 hour", how, tie="event_id")
        return out.withColumn("value", F.round("value", 8))


def _instant(how: str) -> None:
    @query(f"ts_instant_{how}", f"SELECT event_type, round({ORACLE[how]}, 8) AS value, max(ts) AS ts FROM events GROUP BY event_type")
    def run(spark, d):
        return ts.instant(events(spark, d), ["event_type"], how, tie="event_id").withColumn("value", F.round("value", 8))


def _rolling(how: str, sql: str) -> None:
    @query(f"ts_rolling_{how}", f"SELECT event_id, round({sql} OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL '1 hour' PRECEDING AND CURRENT ROW), 8) AS rolled FROM events")
    def run(spark, d):
        return ts.rolling(events(spark, d), ["event_type"], "1 hour", how).select("event_id", F.round("rolled", 8).alias("rolled"))


for _how in ORACLE:
    _downsample(_how)
for _how in ("sum", "avg", "min", "max", "count", "last", "rate"):
    _instant(_how)
for _how in ("sum", "avg", "min", "max", "count"):
    _rolling(_how, f"{_how}(value)")


@query("ts_range_query", "SELECT event_id, ts, value FROM events WHERE event_type = 'click' AND ts >= (SELECT min(ts) FROM events) + INTERVAL '1 day' AND ts < (SELECT min(ts) FROM events) + INTERVAL '3 days'")
def ts_range_query(spark, d):
    return run_sql(spark, d, "SELECT event_id, ts, value FROM events WHERE event_type = 'click' AND ts >= (SELECT min(ts) FROM events) + INTERVAL '1' DAY AND ts < (SELECT min(ts) FROM events) + INTERVAL '3' DAY")


@query("ts_limit_per_series", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn <= 5")
def ts_limit_per_series(spark, d):
    return ts.limit_per_series(events(spark, d), ["event_type"], 5, F.col("ts"), F.col("event_id")).select("event_type", "event_id")


def tagged(spark, d):
    return events(spark, d).withColumn("tags", F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("type"), F.col("event_type")))


@query("ts_tag_filter", "SELECT event_id FROM events WHERE event_type = 'view' AND user_id = 7")
def ts_tag_filter(spark, d):
    return tagged(spark, d).where(ts.match_tags("tags", equal={"type": "view", "user": "7"})).select("event_id")


@query("ts_label_matchers", "SELECT event_id FROM events WHERE event_type <> 'view' AND regexp_matches(CAST(user_id AS VARCHAR), '^1') AND NOT regexp_matches(event_type, 'sign')")
def ts_label_matchers(spark, d):
    return tagged(spark, d).where(ts.match_tags("tags", different={"type": "view", "absent": "x"}, like={"user": "^1"}, unlike={"type": "sign"})).select("event_id")


@query("ts_tag_keys", "SELECT unnest(['type', 'user']) AS tag")
def ts_tag_keys(spark, d):
    return tagged(spark, d).select(F.explode(F.map_keys("tags")).alias("tag")).distinct()


@query("ts_tag_values", "SELECT DISTINCT event_type AS v FROM events")
def ts_tag_values(spark, d):
    return tagged(spark, d).select(F.col("tags")["type"].alias("v")).distinct()


@query("ts_series_catalog", "SELECT 'type=' || event_type || ',user=' || user_id AS series, count(*) AS n FROM events GROUP BY ALL")
def ts_series_catalog(spark, d):
    return tagged(spark, d).groupBy(ts.series_key("tags").alias("series")).agg(F.count("*").alias("n"))


@query("ts_instant_lookback", "SELECT event_type, arg_max(value, row(ts, event_id)) AS value FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL '5 hours' AND ts < (SELECT max(ts) FROM events) GROUP BY event_type")
def ts_instant_lookback(spark, d):
    return run_sql(spark, d, "SELECT event_type, max_by(value, struct(ts, event_id)) AS value FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL '5' HOUR AND ts < (SELECT max(ts) FROM events) GROUP BY event_type")


@query("ts_latest", "SELECT event_type, max(ts) AS ts, arg_max(value, row(ts, event_id)) AS value FROM events GROUP BY event_type")
def ts_latest(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.max_by(F.struct("ts", "value"), F.struct("ts", "event_id")).alias("p")).select("event_type", "p.*")


@query("ts_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 8) AS p50, round(quantile_cont(value, 0.9), 8) AS p90, round(quantile_cont(value, 0.99), 8) AS p99 FROM events GROUP BY event_type")
def ts_percentiles(spark, d):
    out = quantiles.interpolated(events(spark, d), ["event_type"], "value", {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    return out.select("event_type", *[F.round(p, 8).alias(p) for p in ("p50", "p90", "p99")])


@query("ts_aggregate", "SELECT round(avg(value), 8) AS value FROM events WHERE event_type = 'purchase'")
def ts_aggregate(spark, d):
    return events(spark, d).where("event_type = 'purchase'").agg(F.round(F.avg("value"), 8).alias("value"))


@query("ts_partition_key", "SELECT event_id, strftime(ts, '%Y%m%d%H') AS hour, strftime(ts, '%Y%m%d') AS day, strftime(ts, '%GW%V') AS week, strftime(ts, '%Y%m') AS month FROM events")
def ts_partition_key(spark, d):
    return events(spark, d).select("event_id", *[ts.partition_key("ts", u).alias(u) for u in ("hour", "day", "week", "month")])


@query("ts_partition_stats", "SELECT strftime(ts, '%Y%m%d') AS day, count(*) AS n, min(ts) AS lo, max(ts) AS hi FROM events GROUP BY ALL")
def ts_partition_stats(spark, d):
    return events(spark, d).groupBy(ts.partition_key("ts", "day").alias("day")).agg(F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))


@query("ts_series_bounds", "SELECT event_type, min(ts) AS lo, max(ts) AS hi, arg_min(value, row(ts, event_id)) AS first FROM events GROUP BY event_type")
def ts_series_bounds(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.min_by("value", F.struct("ts", "event_id")).alias("first"))


@query("ts_retention", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL '7 days'")
def ts_retention(spark, d):
    return run_sql(spark, d, "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL '7' DAY")


@query("ts_retention_tiers", "SELECT event_id, CASE WHEN h <= 24 THEN 'raw' WHEN h <= 168 THEN 'hourly' WHEN h <= 720 THEN 'daily' END AS tier FROM (SELECT event_id, date_diff('second', ts, (SELECT max(ts) FROM events)) / 3600.0 AS h FROM events)")
def ts_retention_tiers(spark, d):
    last = events(spark, d).agg(F.max("ts").alias("last"))
    age = (F.unix_timestamp("last") - F.unix_timestamp("ts")) / 3600
    return events(spark, d).join(F.broadcast(last)).select("event_id", ts.retention_tier(age, [("raw", 24), ("hourly", 168), ("daily", 720)]).alias("tier"))


#: Documents with fields of all types: k a number, t a string, m a number or the same as a string, tags, an object, a null.
_DOC = "concat('{\"k\":', k, ',\"t\":\"', event_type, '\",\"m\":', CASE WHEN event_id % 2 = 0 THEN CAST(k AS STRING) ELSE concat('\"', k, '\"') END, ',\"tags\":[\"', event_type, '\",', k, '],\"o\":{\"n\":', k, ',\"s\":\"x', k, '\"},\"none\":null}')"


def typed(spark, d):
    return events(spark, d).withColumn("k", F.get_json_object("props", "$.k").cast("long")).withColumn("doc", F.expr(_DOC))


DOC = {
    "doc_eq": ({"k": 5}, "k = 5"),
    "doc_eq_types": ({"$or": [{"m": "5"}, {"m": 7}]}, "event_id % 2 = 1 AND k = 5 OR event_id % 2 = 0 AND k = 7"),
    "doc_ne": ({"k": {"$ne": 5}}, "coalesce(k <> 5, true)"),
    "doc_range": ({"k": {"$gte": 10, "$lt": 20}}, "k >= 10 AND k < 20"),
    "doc_range_types": ({"m": {"$gt": 10}, "t": {"$lt": "p"}}, "event_id % 2 = 0 AND k > 10 AND event_type < 'p'"),
    "doc_in_nin": ({"k": {"$in": [1, 2, 3], "$nin": [2]}}, "k IN (1, 3)"),
    "doc_exists": ({"k": {"$exists": True}, "none": {"$exists": True}, "z": {"$exists": False}}, "k IS NOT NULL"),
    "doc_regex": ({"$or": [{"t": {"$regex": "^s.g"}}, {"m": {"$regex": "^1"}}, {"k": {"$regex": "^1"}}]}, "event_type = 'signup' OR event_id % 2 = 1 AND CAST(k AS VARCHAR) LIKE '1%'"),
    "doc_contains": ({"$or": [{"t": {"$contains": "rcha"}}, {"m": {"$contains": "3"}}, {"tags": {"$contains": 9}}, {"k": {"$contains": "4"}}]}, "event_type = 'purchase' OR event_id % 2 = 1 AND CAST(k AS VARCHAR) LIKE '%3%' OR k = 9"),
    "doc_array_member": ({"tags": {"$contains": "view"}}, "event_type = 'view'"),
    "doc_string_match": ({"$or": [{"t": {"$startsWith": "cl", "$endsWith": "ck"}}, {"m": {"$startsWith": "2", "$endsWith": "7"}}]}, "event_type = 'click' OR event_id % 2 = 1 AND CAST(k AS VARCHAR) LIKE '2%' AND CAST(k AS VARCHAR) LIKE '%7'"),
    "doc_nested": ({"o.n": {"$gt": 30}, "o.s": {"$ne": "x33"}, "tags.1": {"$lt": 40}}, "k > 30 AND k <> 33 AND k < 40"),
    "doc_logical": ({"$or": [{"k": 1}, {"$and": [{"k": {"$gt": 40}}, {"$not": {"k": 42}}]}]}, "k = 1 OR (k > 40 AND k <> 42)"),
    "doc_multi_op": ({"k": {"$gt": 3, "$ne": 6, "$lt": 9}}, "k > 3 AND k <> 6 AND k < 9"),
}
_K = "(SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"


def _doc(name: str, q: dict, sql: str) -> None:
    @query(name, f"SELECT event_id FROM {_K} WHERE {sql}")
    def run(spark, d):
        return documents.find(typed(spark, d), "doc", q).select("event_id")


for _name, (_q, _sql) in DOC.items():
    _doc(_name, _q, _sql)


@query("json_path_get", f"SELECT event_id, CAST(k AS VARCHAR) AS k FROM {_K}")
def json_path_get(spark, d):
    return events(spark, d).select("event_id", documents.path("props", "k").alias("k"))


@query("doc_find", f"SELECT event_id FROM {_K} WHERE k > 30 ORDER BY event_id LIMIT 10")
def doc_find(spark, d):
    return documents.find(events(spark, d), "props", {"k": {"$gt": 30}}, sort=[F.col("event_id")], limit=10).select("event_id")


@query("doc_sort_skip_limit", f"SELECT event_id FROM {_K} WHERE k > 30 ORDER BY k DESC, event_id LIMIT 10 OFFSET 5")
def doc_sort_skip_limit(spark, d):
    return documents.find(events(spark, d), "props", {"k": {"$gt": 30}}, sort=[documents.path("props", "k").cast("long").desc(), F.col("event_id")], skip=5, limit=10).select("event_id")


@query("doc_count", f"SELECT count(*) AS n FROM {_K} WHERE k > 30")
def doc_count(spark, d):
    return documents.find(events(spark, d), "props", {"k": {"$gt": 30}}).agg(F.count("*").alias("n"))


@query("doc_project", f"SELECT event_id, CAST(k AS VARCHAR) AS key FROM {_K} WHERE k = 9")
def doc_project(spark, d):
    return documents.find(events(spark, d).select("event_id", "props"), "props", {"k": 9}, project={"key": "k"})


@query("doc_patch", f"SELECT event_id, CAST(k AS VARCHAR) AS k, event_type AS t, 'int' AS kind, 'string' AS t_kind FROM {_K}")
def doc_patch(spark, d):
    p = events(spark, d).select("event_id", documents.patch("props", {"t": F.col("event_type")}).alias("p"))
    kinds = [documents.kind(documents.value("p", f)).alias(n) for f, n in (("k", "kind"), ("t", "t_kind"))]
    return p.select("event_id", documents.path("p", "k").alias("k"), documents.path("p", "t").alias("t"), *kinds)


RULES = {"k": {"required": True, "type": "number", "min": 10, "max": 40}, "name": {"required": True}}


@query("doc_validate", f"SELECT event_id, CASE WHEN k < 10 THEN 'k: min,name: required' WHEN k > 40 THEN 'k: max,name: required' ELSE 'name: required' END AS errors FROM {_K}")
def doc_validate(spark, d):
    return events(spark, d).select("event_id", F.array_join(documents.errors("props", RULES), ",").alias("errors"))


TYPE_RULES = {
    "m": {"type": "int"}, "t": {"type": "string", "min_length": 5, "max_length": 6, "enum": ["click", "error", "signup", "view"]},
    "tags": {"type": "array", "max_length": 2, "items": "string"}, "o": {"type": "object", "properties": {"n": {"max": 40}, "s": {"pattern": "^x[12]"}}},
    "none": {"nullable": False},
}


@query("doc_validate_types", f"""SELECT event_id, concat_ws(',', CASE WHEN event_id % 2 = 1 THEN 'm: type' END, CASE WHEN length(event_type) < 5 THEN 't: min_length' END, CASE WHEN length(event_type) > 6 THEN 't: max_length' END,
  CASE WHEN event_type = 'purchase' THEN 't: enum' END, 'tags: items', CASE WHEN k > 40 THEN 'o.n: max' END, CASE WHEN NOT (CAST(k AS VARCHAR) LIKE '1%' OR CAST(k AS VARCHAR) LIKE '2%') THEN 'o.s: pattern' END, 'none: nullable', 'additional: k') AS errors FROM {_K}""")
def doc_validate_types(spark, d):
    return typed(spark, d).select("event_id", F.array_join(documents.errors("doc", TYPE_RULES, additional=False), ",").alias("errors"))


@query("doc_validate_all", f"SELECT event_id FROM {_K} WHERE k > 40")
def doc_validate_all(spark, d):
    return events(spark, d).where(F.size(documents.errors("props", {"k": {"max": 40}})) > 0).select("event_id")


_TERMS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: strlen(t) >= 2)"


@query("fts_search_all", f"SELECT doc_id FROM (SELECT doc_id, {_TERMS} AS t FROM documents) WHERE list_contains(t, 'the') AND list_contains(t, 'with')")
def fts_search_all(spark, d):
    return documents.search(load(spark, d, "documents"), "text", "The, with!").select("doc_id")


@query("fts_search_any", f"SELECT doc_id FROM (SELECT doc_id, {_TERMS} AS t FROM documents) WHERE list_contains(t, 'der') OR list_contains(t, 'que')")
def fts_search_any(spark, d):
    return documents.search(load(spark, d, "documents"), "text", "der que", every=False).select("doc_id")


@query("fts_term_stats", f"SELECT term, count(DISTINCT doc_id) AS n_docs, count(*) AS n FROM (SELECT doc_id, unnest({_TERMS}) AS term FROM documents) GROUP BY term")
def fts_term_stats(spark, d):
    # terms are counted inside the row, so that one shuffle adds up distinct terms
    each = documents.inverted_index(load(spark, d, "documents"), "text", "doc_id")
    return each.groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n"))


@query("fts_index_search", f"SELECT doc_id FROM (SELECT doc_id, {_TERMS} AS t FROM documents) WHERE list_contains(t, 'the') AND list_contains(t, 'with') UNION ALL SELECT -doc_id FROM (SELECT doc_id, {_TERMS} AS t FROM documents) WHERE list_contains(t, 'der') OR list_contains(t, 'que')")
def fts_index_search(spark, d):
    index = documents.inverted_index(load(spark, d, "documents"), "text", "doc_id")
    either = documents.search_index(index, "doc_id", "der que", every=False).select((-F.col("doc_id")).alias("doc_id"))
    return documents.search_index(index, "doc_id", "The, with!").union(either).union(documents.search_index(index, "doc_id", " - "))


@query("kv_prefix_list", "SELECT c_name AS k, c_acctbal AS v FROM customer WHERE starts_with(c_name, 'Customer#00000001') ORDER BY k LIMIT 10")
def kv_prefix_list(spark, d):
    return load(spark, d, "customer").where(F.col("c_name").startswith("Customer#00000001")).select(F.col("c_name").alias("k"), F.col("c_acctbal").alias("v")).orderBy("k").limit(10)


@query("kv_latest", "SELECT user_id, arg_max(event_type, row(ts, event_id)) AS v FROM events GROUP BY user_id")
def kv_latest(spark, d):
    return replicas.last_writer(events(spark, d), "user_id", "event_type", "ts", "event_id").withColumnRenamed("event_type", "v")


@query("kv_increment", "SELECT user_id, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS n FROM events GROUP BY user_id")
def kv_increment(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).alias("n"))


def nodes(spark, d):
    n = load(spark, d, "nation").select(F.concat(F.lit("nation:"), "n_nationkey").alias("id"), F.lit("Nation").alias("label"))
    return n.union(load(spark, d, "customer").select(F.concat(F.lit("customer:"), "c_custkey"), F.lit("Customer")))


def edges(spark, d):
    return load(spark, d, "customer").select(F.concat(F.lit("customer:"), "c_custkey").alias("source"), F.concat(F.lit("nation:"), "c_nationkey").alias("target"), F.lit("LIVES_IN").alias("relationship"))


@query("graph_find_label", "SELECT 'nation:' || n_nationkey AS id, 'Nation' AS label FROM nation")
def graph_find_label(spark, d):
    return graph.find_label(nodes(spark, d), "NATION")


@query("graph_node_edges", "SELECT 'customer:' || c_custkey AS source, 'nation:3' AS target, 'LIVES_IN' AS relationship FROM customer WHERE c_nationkey = 3")
def graph_node_edges(spark, d):
    return graph.node_edges(edges(spark, d), "nation:3")


@query("graph_degree", "SELECT 'nation:' || n_nationkey AS id, 'Nation' AS label, CAST(0 AS BIGINT) AS n_out, count(c_custkey) AS n_in FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey UNION ALL SELECT 'customer:' || c_custkey, 'Customer', 1, 0 FROM customer")
def graph_degree(spark, d):
    return graph.degree(nodes(spark, d), edges(spark, d))


@query("graph_delete_cascade", "SELECT 'customer:' || c_custkey AS source, 'nation:' || c_nationkey AS target FROM customer WHERE c_nationkey >= 5")
def graph_delete_cascade(spark, d):
    gone = load(spark, d, "nation").where("n_nationkey < 5").select(F.concat(F.lit("nation:"), "n_nationkey").alias("id"))
    return graph.delete_nodes(nodes(spark, d), edges(spark, d), gone)[1].select("source", "target")


def _tumbling(how: str) -> None:
    @query(f"stream_tumbling_{how}", f"SELECT event_type, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS start, round({how}(value), 8) AS value FROM events GROUP BY ALL")
    def run(spark, d):
        out = pipeline.tumbling(events(spark, d), "6 hours", getattr(F, how)("value").alias("value"), keys=("event_type",))
        return out.withColumn("value", F.round("value", 8))


for _how in ("count", "sum", "avg", "min", "max"):
    _tumbling(_how)


@query("stream_filter", "SELECT event_id FROM events WHERE event_type = 'click' AND user_id > 10")
def stream_filter(spark, d):
    return events(spark, d).where(pipeline.event_filter("click") & (F.col("user_id") > 10)).select("event_id")


@query("stream_pipeline", "SELECT event_id, upper(event_type) AS kind, round(value * 2, 8) AS doubled FROM events WHERE value > 10")
def stream_pipeline(spark, d):
    return events(spark, d).where("value > 10").transform(lambda df: df.select("event_id", F.upper("event_type").alias("kind"), F.round(F.col("value") * 2, 8).alias("doubled")))


@query("channel_history", "SELECT event_id FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 20")
def channel_history(spark, d):
    return events(spark, d).where("event_type = 'click'").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id")


@query("channel_history_after", "SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL '1 day'")
def channel_history_after(spark, d):
    return run_sql(spark, d, "SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL '1' DAY")


def changes(spark, d):
    kind = F.when(F.col("event_type") == "signup", "Insert").when(F.col("event_type") == "error", "Delete").otherwise("Update")
    return events(spark, d).select("event_id", "ts", "user_id", kind.alias("change_type"), F.col("value").alias("after"))


_CHANGE = "CASE event_type WHEN 'signup' THEN 'Insert' WHEN 'error' THEN 'Delete' ELSE 'Update' END"


@query("cdc_to_event", f"SELECT event_id, {_CHANGE} AS change_type, 'shop.users' AS source FROM events")
def cdc_to_event(spark, d):
    return changes(spark, d).select("event_id", "change_type", F.lit("shop.users").alias("source"))


@query("cdc_capture_filter", "SELECT event_id, user_id FROM events WHERE event_type IN ('signup', 'error') AND user_id < 50")
def cdc_capture_filter(spark, d):
    return pipeline.capture(changes(spark, d), ["Insert", "Delete"], ["event_id", "user_id"], "user_id < 50")


@query("cdc_replay", f"SELECT user_id, after FROM (SELECT user_id, {_CHANGE} AS c, value AS after, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 AND c <> 'Delete'")
def cdc_replay(spark, d):
    return pipeline.replay(changes(spark, d), "user_id", ["ts", "event_id"])


@query("detect_failed_login", "SELECT event_id, user_id FROM (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1 day' PRECEDING AND CURRENT ROW) AS c FROM events WHERE event_type = 'error') WHERE c >= 2")
def detect_failed_login(spark, d):
    return ts.rolling(events(spark, d).where("event_type = 'error'"), ["user_id"], "1 day", "count").where("rolled >= 2").select("event_id", "user_id")


@query("detect_access_volume", "SELECT event_id, c FROM (SELECT *, count(value) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL '1 hour' PRECEDING AND CURRENT ROW) AS c FROM events) WHERE c >= 5")
def detect_access_volume(spark, d):
    return ts.rolling(events(spark, d), ["event_type"], "1 hour", "count").where("rolled >= 5").select("event_id", F.col("rolled").alias("c"))


@query("detect_mass_access", "SELECT event_id, CASE WHEN value >= 80 THEN 'critical' ELSE 'high' END AS severity FROM events WHERE value >= 50")
def detect_mass_access(spark, d):
    return events(spark, d).where("value >= 50").select("event_id", F.when(F.col("value") >= 80, "critical").otherwise("high").alias("severity"))


@query("incident_stats", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def incident_stats(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


def replica_states(spark, d):
    return load(spark, d, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_linenumber").alias("node"), F.col("l_quantity").cast("long").alias("p"), F.floor(F.col("l_tax") * 100).cast("long").alias("n"))


@query("crdt_gcounter", "SELECT id, CAST(sum(n) AS BIGINT) AS value FROM (SELECT l_suppkey AS id, l_linenumber, max(CAST(trunc(l_quantity) AS BIGINT)) AS n FROM lineitem GROUP BY ALL) GROUP BY id")
def crdt_gcounter(spark, d):
    return replicas.gcounter(replica_states(spark, d).select("id", "node", F.col("p").alias("n")))


@query("crdt_pncounter", "SELECT id, CAST(sum(p) - sum(n) AS BIGINT) AS value FROM (SELECT l_suppkey AS id, l_linenumber, max(CAST(trunc(l_quantity) AS BIGINT)) AS p, max(CAST(floor(l_tax * 100) AS BIGINT)) AS n FROM lineitem GROUP BY ALL) GROUP BY id")
def crdt_pncounter(spark, d):
    return replicas.pncounter(replica_states(spark, d))


@query("crdt_gset", "SELECT DISTINCT l_suppkey AS id, l_returnflag AS e FROM lineitem")
def crdt_gset(spark, d):
    return load(spark, d, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_returnflag").alias("e")).distinct()


@query("crdt_2pset", "SELECT DISTINCT o_custkey AS e FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def crdt_2pset(spark, d):
    o = load(spark, d, "orders")
    return replicas.two_phase_set(o.select(F.col("o_custkey").alias("e")), o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("e")))


@query("crdt_lww", "SELECT user_id, arg_max(value, row(ts, event_id)) AS value FROM events GROUP BY user_id")
def crdt_lww(spark, d):
    return replicas.last_writer(events(spark, d), "user_id", "value", "ts", "event_id")


@query("crdt_orset", """WITH s AS (SELECT l_suppkey AS id, l_linenumber % 2 AS replica, l_returnflag AS e, l_orderkey % 50 AS tag, l_quantity < 25 AS removed FROM lineitem),
h AS (SELECT DISTINCT * FROM s WHERE NOT removed AND NOT EXISTS (SELECT 1 FROM s r WHERE r.removed AND r.id = s.id AND r.replica = s.replica AND r.e = s.e AND r.tag = s.tag))
SELECT id, e, count(DISTINCT tag) AS tags FROM h GROUP BY id, e""")
def crdt_orset(spark, d):
    states = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("id"), (F.col("l_linenumber") % 2).alias("replica"), F.col("l_returnflag").alias("e"), (F.col("l_orderkey") % 50).alias("tag"), (F.col("l_quantity") < 25).alias("removed"))
    return replicas.or_set(states)


@query("crdt_mv", "SELECT id, q, t FROM (SELECT id, q, t, max(t) OVER (PARTITION BY id ORDER BY q DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM (SELECT l_suppkey AS id, l_quantity AS q, max(l_tax) AS t FROM lineitem GROUP BY ALL)) WHERE above IS NULL OR t > above")
def crdt_mv(spark, d):
    # versions under two-node clocks (quantity, tax): greatest tax per quantity, then the running maximum from above
    v = load(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id"), F.col("l_quantity").alias("q")).agg(F.max("l_tax").alias("t"))
    above = F.max("t").over(Window.partitionBy("id").orderBy(F.desc("q")).rowsBetween(Window.unboundedPreceding, -1))
    return v.withColumn("above", above).where("above IS NULL OR t > above").select("id", "q", "t")


@query("vclock_compare", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 25 AND l_tax * 100 > 4 OR l_quantity > 25 AND l_tax * 100 < 4 THEN 'concurrent' WHEN l_quantity < 25 OR l_tax * 100 < 4 THEN 'before' WHEN l_quantity > 25 OR l_tax * 100 > 4 THEN 'after' ELSE 'equal' END AS c FROM lineitem")
def vclock_compare(spark, d):
    a = F.create_map(F.lit("x"), F.col("l_quantity"), F.lit("y"), F.col("l_tax") * 100)
    b = F.create_map(F.lit("x"), F.lit(25.0), F.lit("y"), F.lit(4.0))
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", replicas.clock_compare(a, b).alias("c"))


@query("partition_assign", "SELECT o_orderkey, o_orderkey % 8 AS by_hash, CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT) AS by_day FROM orders")
def partition_assign(spark, d):
    return load(spark, d, "orders").select("o_orderkey", F.pmod("o_orderkey", F.lit(8)).alias("by_hash"), F.floor(F.unix_timestamp("o_orderdate") / 86400).alias("by_day"))


@query("latency_percentiles", "SELECT event_type, s[least(CAST(trunc(n * 0.5) AS INTEGER), n - 1) + 1] AS p50, s[least(CAST(trunc(n * 0.9) AS INTEGER), n - 1) + 1] AS p90, s[least(CAST(trunc(n * 0.99) AS INTEGER), n - 1) + 1] AS p99 FROM (SELECT event_type, list_sort(list(value)) AS s, CAST(count(value) AS INTEGER) AS n FROM events GROUP BY event_type)")
def latency_percentiles(spark, d):
    return quantiles.nearest_rank(events(spark, d), ["event_type"], "value", {"p50": 0.5, "p90": 0.9, "p99": 0.99})


@query("metric_histogram", "SELECT event_type, " + ", ".join(f"CAST(sum(CASE WHEN value <= {b} THEN 1 ELSE 0 END) AS BIGINT) AS le_{b}" for b in (5, 10, 25, 50, 100)) + " FROM events GROUP BY event_type")
def metric_histogram(spark, d):
    return events(spark, d).groupBy("event_type").agg(*[F.sum(F.when(F.col("value") <= b, 1).otherwise(0)).alias(f"le_{b}") for b in (5, 10, 25, 50, 100)])


@query("query_stats", "SELECT count(*) AS n, round(avg(value), 8) AS mean, round(count(*) / (date_diff('second', min(ts), max(ts)) * 1.0), 8) AS per_second FROM events")
def query_stats(spark, d):
    span = F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))
    return events(spark, d).agg(F.count("*").alias("n"), F.round(F.avg("value"), 8).alias("mean"), F.round(F.count("*") / span, 8).alias("per_second"))


_RANK = "s[least(CAST(trunc(len(s) * {q}) AS INTEGER), len(s) - 1) + 1] AS p{n}"


@query("metric_summary", "SELECT event_type, n, total, " + ", ".join(_RANK.format(q=q, n=int(q * 100)) for q in (0.5, 0.9, 0.95, 0.99)) + " FROM (SELECT event_type, count(*) AS n, round(sum(value), 3) AS total, list_sort(list(value) FILTER (rn <= 1000 AND value IS NOT NULL)) AS s FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) GROUP BY event_type)")
def metric_summary(spark, d):
    """All samples count, the last 1000 make the quantiles."""
    every = events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))
    last = ts.limit_per_series(events(spark, d), ["event_type"], 1000, F.desc("ts"), F.desc("event_id"))
    sample = last.groupBy("event_type").agg(F.sort_array(F.collect_list("value")).alias("s"))
    return every.join(sample, "event_type").select("event_type", "n", "total", *[replicas.nearest_rank(F.col("s"), q).alias(f"p{int(q * 100)}") for q in (0.5, 0.9, 0.95, 0.99)])


@query("activity_by_type", "SELECT event_id FROM events WHERE event_type = 'signup' ORDER BY ts DESC, event_id DESC LIMIT 15")
def activity_by_type(spark, d):
    return events(spark, d).where("event_type = 'signup'").orderBy(F.desc("ts"), F.desc("event_id")).limit(15).select("event_id")


#: A chain per user over its events, written whole; then payloads of some entries are changed and other entries taken out.
_LOG = "SELECT user_id, event_id, CAST(event_id AS VARCHAR) || event_type AS payload, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events"


def tampered_log(spark, d):
    rows = run_sql(spark, d, _LOG.replace("VARCHAR", "STRING"))
    entries = rows.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("seq", "payload", "event_id"))).alias("e"))
    none = F.expr("cast(array() as array<struct<seq:int,event_id:bigint,payload:string,prev_hash:string,hash:string>>)")

    def step(acc, x):
        entry = F.struct(x["seq"].alias("seq"), x["event_id"].alias("event_id"), x["payload"].alias("payload"), acc["prev"].alias("prev_hash"), audit.entry_hash(acc["prev"], x["payload"]).alias("hash"))
        return F.struct(entry["hash"].alias("prev"), F.concat(acc["out"], F.array(entry)).alias("out"))

    chained = entries.select("user_id", F.explode(F.aggregate("e", F.struct(F.lit(audit.GENESIS).alias("prev"), none.alias("out")), step)["out"]).alias("x")).select("user_id", "x.*")
    changed = chained.withColumn("payload", F.when(F.col("event_id") % 97 == 0, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    relinked = changed.withColumn("prev_hash", F.when(F.col("event_id") % 89 == 1, "0").otherwise(F.col("prev_hash")))
    return relinked.where("event_id % 101 <> 2")


@query("audit_chain_verify", f"""WITH l AS ({_LOG}), kept AS (SELECT * FROM l WHERE event_id % 101 <> 2),
f AS (SELECT user_id, min(seq) AS first FROM kept GROUP BY user_id)
SELECT user_id, event_id, fault FROM (SELECT k.user_id, k.event_id, CASE WHEN event_id % 97 = 0 OR event_id % 89 = 1 THEN 'hash' WHEN seq = first AND first > 0 THEN 'start' WHEN seq > first AND NOT EXISTS (SELECT 1 FROM kept b WHERE b.user_id = k.user_id AND b.seq = k.seq - 1) THEN 'gap' END AS fault
FROM kept k JOIN f ON k.user_id = f.user_id) WHERE fault IS NOT NULL""")
def audit_chain_verify(spark, d):
    return audit.verify(tampered_log(spark, d), "user_id", audit.GENESIS).select("user_id", "event_id", "fault")


@query("audit_export", "SELECT event_id, user_id FROM events WHERE user_id = 7 ORDER BY event_id LIMIT 10 OFFSET 2")
def audit_export(spark, d):
    return events(spark, d).where("user_id = 7").orderBy("event_id").offset(2).limit(10).select("event_id", "user_id")


_GRANT = "event_type IN ('signup', 'purchase')"


@query("consent_actions", f"SELECT event_id, CASE WHEN g AND p IS NULL THEN 'Grant' WHEN g AND p THEN 'Renew' WHEN g THEN 'Grant' WHEN p THEN 'Withdraw' ELSE 'Deny' END AS action FROM (SELECT event_id, {_GRANT} AS g, lag({_GRANT}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)")
def consent_actions(spark, d):
    g = F.expr(_GRANT)
    p = F.lag(g).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    action = F.when(g & F.coalesce(p, F.lit(False)), "Renew").when(g, "Grant").when(p, "Withdraw").otherwise("Deny")
    return events(spark, d).select("event_id", action.alias("action"))


@query("consent_stats", f"SELECT count(*) AS subjects, CAST(sum(CASE WHEN g THEN 1 ELSE 0 END) AS BIGINT) AS granted FROM (SELECT user_id, arg_max({_GRANT}, row(ts, event_id)) AS g FROM events GROUP BY user_id)")
def consent_stats(spark, d):
    now = events(spark, d).groupBy("user_id").agg(F.max_by(F.expr(_GRANT), F.struct("ts", "event_id")).alias("g"))
    return now.agg(F.count("*").alias("subjects"), F.sum(F.when(F.col("g"), 1).otherwise(0)).alias("granted"))


@query("do_not_sell", "SELECT user_id FROM (SELECT user_id, arg_max(event_type, row(ts, event_id)) AS e FROM events GROUP BY user_id) WHERE e = 'error'")
def do_not_sell(spark, d):
    return replicas.last_writer(events(spark, d), "user_id", "event_type", "ts", "event_id").where("event_type = 'error'").select("user_id")


@query("subject_match", f"SELECT 'events' AS store, CAST(event_id AS VARCHAR) AS id FROM {_K} WHERE user_id = 7 OR k = 7 UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey = 7")
def subject_match(spark, d):
    e = typed(spark, d).where((F.col("user_id") == 7) | json_contains(F.col("doc"), "n", 7)).select(F.lit("events").alias("store"), F.col("event_id").cast("string").alias("id"))
    return e.union(load(spark, d, "customer").where("c_custkey = 7").select(F.lit("customer"), F.col("c_custkey").cast("string")))


@query("subject_erase", f"SELECT 'events' AS store, CAST(event_id AS VARCHAR) AS id FROM {_K} WHERE NOT (user_id = 7 OR k = 7) UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey <> 7")
def subject_erase(spark, d):
    """What is left of both stores after all that belongs to a subject is gone."""
    mine = F.coalesce(F.col("user_id") == 7, F.lit(False)) | json_contains(F.col("doc"), "n", 7)
    e = typed(spark, d).where(~mine).select(F.lit("events").alias("store"), F.col("event_id").cast("string").alias("id"))
    return e.union(dml.delete(load(spark, d, "customer"), F.col("c_custkey") == 7).select(F.lit("customer"), F.col("c_custkey").cast("string")))


@query("subject_export", "SELECT 'events' AS store, event_id AS id, event_type AS kind, NULL AS name FROM events WHERE user_id = 7 UNION ALL SELECT 'customer', c_custkey, NULL, c_name FROM customer WHERE c_custkey = 7")
def subject_export(spark, d):
    e = events(spark, d).where("user_id = 7").select(F.lit("events").alias("store"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"))
    c = load(spark, d, "customer").where("c_custkey = 7").select(F.lit("customer").alias("store"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return e.unionByName(c, allowMissingColumns=True)


@query("export_date_range", "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-06-30'")
def export_date_range(spark, d):
    inside = F.col("o_orderdate").between(F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("1995-06-30").cast("timestamp_ntz"))
    return load(spark, d, "orders").where(F.coalesce(inside, F.lit(True))).select("o_orderkey")
