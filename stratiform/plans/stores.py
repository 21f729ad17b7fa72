"""Queries over what writes: statements and snapshots of a database, key-value commands, document
changes, the point store, channels, results as text, partitioning, detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions
from ..operators import documents, graph, keyvalue, points, replicas, results
from ..sources import storage
from ..sources.database import Database
from ..sources.tables import load
from ..streaming import channels, detect
from .builder import delete_from, insert_into, update
from .catalog import query


def events(spark, d):
    return load(spark, d, "events")


def database(spark, d, *names: str) -> Database:
    """A new database with copies of tables."""
    db = Database(spark)
    for name in names:
        rows = load(spark, d, name)
        columns = ", ".join(f"{f.name} {'TEXT' if f.dataType.simpleString() == 'string' else f.dataType.simpleString()}" for f in rows.schema)
        db.execute(f"CREATE TABLE {name} ({columns})")
        db.insert(name, rows)
    return db


@query("create_insert", "SELECT n_nationkey AS id, n_name AS name, 'active' AS status, CAST(NULL AS VARCHAR) AS note FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 1000, 'Nowhere', 'new', 'x' UNION ALL SELECT 1001, 'It''s', 'active', NULL")
def create_insert(spark, d):
    db = database(spark, d, "nation")
    db.execute("CREATE TABLE IF NOT EXISTS places (id INTEGER PRIMARY KEY, name VARCHAR(50) NOT NULL, status TEXT DEFAULT 'active', note TEXT)")
    db.execute("CREATE TABLE IF NOT EXISTS places (id INTEGER)")
    db.execute("INSERT INTO places (id, name) SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
    db.execute("INSERT INTO places VALUES (1000, 'Nowhere', 'new', 'x'); INSERT INTO places (name, id) VALUES (\"It's\", 1001)")
    return db.execute("SELECT * FROM places")


@query("update_delete_statements", "SELECT s_suppkey, upper(s_name) AS s_name, s_nationkey, CASE WHEN s_acctbal < 0 THEN s_acctbal * 2 + s_nationkey ELSE s_acctbal END AS s_acctbal FROM supplier WHERE NOT (s_nationkey = 3 AND s_acctbal > 1000)")
def update_delete_statements(spark, d):
    db = database(spark, d, "supplier")
    db.execute("UPDATE supplier SET s_name = upper(s_name), s_acctbal = CASE WHEN s_acctbal < 0 THEN s_acctbal * 2 + s_nationkey ELSE s_acctbal END")
    db.execute("DELETE FROM supplier WHERE s_nationkey = 3 AND s_acctbal > 1000")
    return db.execute("SELECT * FROM supplier")


@query("alter_statements", "SELECT CAST(r_regionkey AS BIGINT) AS id, r_name, 'old' AS era, CAST(NULL AS DOUBLE) AS area FROM region UNION ALL SELECT 100, 'Atlantis', 'lost', 1.5")
def alter_statements(spark, d):
    db = database(spark, d, "region")
    db.execute("""ALTER TABLE region ADD COLUMN era TEXT DEFAULT 'old'; ALTER TABLE region ADD extra INTEGER; ALTER TABLE region ADD area DOUBLE;
        ALTER TABLE region DROP COLUMN extra; ALTER TABLE region DROP COLUMN IF EXISTS gone; ALTER TABLE region RENAME COLUMN r_regionkey TO id;
        ALTER TABLE region ALTER COLUMN id TYPE BIGINT; ALTER TABLE region ALTER COLUMN r_name SET NOT NULL; ALTER TABLE region ALTER era SET DEFAULT 'lost';
        ALTER TABLE region RENAME TO lands""")
    db.execute("INSERT INTO lands (id, r_name, area) VALUES (100, 'Atlantis', 1.5)")
    return db.execute("SELECT * FROM lands")


@query("constraint_statements", "SELECT * FROM (VALUES ('second primary key', 'refused'), ('duplicate key', 'refused'), ('null key', 'refused'), ('check', 'refused'), ('orphan', 'refused'), ('unique index', 'refused'), ('good row', 'done'), ('orphan without constraint', 'done')) t(attempt, outcome)")
def constraint_statements(spark, d):
    db = database(spark, d, "nation", "region")
    db.execute("""ALTER TABLE region ADD CONSTRAINT region_key PRIMARY KEY (r_regionkey); ALTER TABLE nation ADD PRIMARY KEY (n_nationkey);
        ALTER TABLE nation ADD CONSTRAINT known FOREIGN KEY (n_regionkey) REFERENCES region (r_regionkey); ALTER TABLE nation ADD CHECK (n_nationkey >= 0)""")
    insert = "INSERT INTO nation VALUES "
    attempts = {
        "second primary key": "ALTER TABLE nation ADD PRIMARY KEY (n_name)",
        "duplicate key": insert + "(3, 'Again', 1)",
        "null key": insert + "(NULL, 'None', 1)",
        "check": insert + "(-1, 'Below', 1)",
        "orphan": insert + "(101, 'Orphan', 77)",
        "unique index": "CREATE UNIQUE INDEX by_region ON nation (n_regionkey)",
        "good row": insert + "(100, 'Good', 1)",
        "orphan without constraint": "ALTER TABLE nation DROP CONSTRAINT known; " + insert + "(102, 'Orphan', 77)",
    }
    rows = []
    for name, text in attempts.items():
        try:
            db.execute(text)
            rows.append((name, "done"))
        except ValueError:
            rows.append((name, "refused"))
    return spark.createDataFrame(rows, "attempt string, outcome string")


@query("list_tables", "SELECT 'nation' AS name, 3 AS n_columns, count(*) AS n_rows FROM nation UNION ALL SELECT 'region', 2, count(*) FROM region")
def list_tables(spark, d):
    db = database(spark, d, "nation", "region", "supplier")
    db.execute("DROP TABLE supplier; DROP TABLE IF EXISTS nothing")
    return db.tables()


@query("table_info", "SELECT * FROM (VALUES (0, 's_suppkey', 'bigint', true), (1, 's_name', 'string', true), (2, 's_nationkey', 'int', false), (3, 's_acctbal', 'double', true)) t(place, name, type, nullable)")
def table_info(spark, d):
    db = database(spark, d, "supplier")
    db.execute("ALTER TABLE supplier ALTER s_nationkey SET NOT NULL")
    return db.describe("supplier").drop("default")


@query("json_snapshot", "SELECT r_regionkey AS k, r_name AS name FROM region UNION ALL SELECT n_nationkey + 1000, n_name FROM nation")
def json_snapshot(spark, d):
    db, other = database(spark, d, "region"), database(spark, d, "nation")
    folder = storage.fresh_dir(spark, "snapshot")
    db.save_snapshot(folder)
    other.execute("CREATE TABLE region (x INTEGER)")
    other.load_snapshot(folder, merge=True)
    return other.execute("SELECT r_regionkey AS k, r_name AS name FROM region UNION ALL SELECT n_nationkey + 1000, n_name FROM nation")


@query("builder_statements", "SELECT r_regionkey, CASE WHEN r_regionkey = 2 THEN 'O''Two' ELSE r_name END AS r_name FROM region WHERE r_regionkey <> 4 UNION ALL SELECT 9, 'Nine'")
def builder_statements(spark, d):
    db = database(spark, d, "region")
    insert_into("region").columns("r_name", "r_regionkey").values("Nine", 9).run(db)
    update("region").set(r_name="O'Two").where("r_regionkey", "=", 2).run(db)
    delete_from("region").where("r_regionkey", "=", 4).where("r_name", "like", "%").run(db)
    return db.execute("SELECT * FROM region")


#: Events as commands on a key per user: a purchase puts, an error deletes, a click increments, a view swaps "1" or "2" for its number.
_LOG = "SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_id, event_type, CAST(event_id % 3 AS VARCHAR) AS v, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(event_id % 4 AS VARCHAR) END AS expected FROM events"


@query("kv_commands", f"""WITH RECURSIVE e AS ({_LOG}),
s AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS value, CAST(0 AS BIGINT) AS swapped FROM e
UNION ALL SELECT e.key, e.i, CASE WHEN event_type = 'purchase' THEN v WHEN event_type = 'error' THEN NULL WHEN event_type = 'view' THEN CASE WHEN s.value IS NOT DISTINCT FROM expected THEN v ELSE s.value END
  WHEN event_type = 'click' THEN CAST(coalesce(TRY_CAST(s.value AS BIGINT), 0) + 1 AS VARCHAR) ELSE s.value END,
  CASE WHEN event_type IN ('purchase', 'error') THEN 0 ELSE swapped + CASE WHEN event_type = 'view' AND s.value IS NOT DISTINCT FROM expected THEN 1 ELSE 0 END END
FROM s JOIN e ON e.key = s.key AND e.i = s.i + 1)
SELECT key, value, swapped AS n_swapped FROM s WHERE value IS NOT NULL AND i = (SELECT max(i) FROM e WHERE e.key = s.key)""")
def kv_commands(spark, d):
    ops = F.create_map(*[F.lit(x) for x in ("purchase", "put", "error", "delete", "click", "increment", "view", "cas")])
    expected = F.when(F.col("event_id") % 4 != 0, (F.col("event_id") % 4).cast("string"))
    log = events(spark, d).select(F.col("user_id").alias("key"), F.struct("ts", "event_id").alias("seq"), ops[F.col("event_type")].alias("op"), (F.col("event_id") % 3).cast("string").alias("value"), expected.alias("expected"))
    # commands are numbered by time, as a log's index would number them
    numbered = log.where("op IS NOT NULL").withColumn("seq", F.unix_micros(F.col("seq.ts").cast("timestamp")) * 1000 + F.pmod(F.col("seq.event_id"), F.lit(1000)))
    return keyvalue.state(numbered)


_ENTRY = "SELECT user_id AS key, event_type, ts, event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id % 5) * 86400 END AS ttl, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events"
_LIVE = f"SELECT key, event_id, ts AS updated_at FROM ({_ENTRY}) WHERE rn = 1 AND event_type <> 'error' AND (ttl IS NULL OR epoch(ts) + ttl > (SELECT epoch(max(ts)) FROM events) - 3600)"


def entries(spark, d):
    ttl = F.when(F.col("event_id") % 5 != 0, (F.col("event_id") % 5) * 86400)
    return events(spark, d).select(F.col("user_id").alias("key"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"), F.col("event_id").alias("value"), ttl.alias("ttl"), F.col("ts").alias("updated_at"), F.col("event_id").alias("seq"))


def live(spark, d):
    now = events(spark, d).agg(F.max("ts")).first()[0]
    return keyvalue.current(entries(spark, d), F.lit(now).cast("timestamp") - F.expr("INTERVAL 1 HOUR"))


@query("kv_ttl", f"SELECT key, event_id AS value, updated_at FROM ({_LIVE})")
def kv_ttl(spark, d):
    return live(spark, d)


@query("kv_count", f"SELECT count(*) AS n FROM ({_LIVE})")
def kv_count(spark, d):
    return live(spark, d).agg(F.count("*").alias("n"))


@query("doc_insert", "SELECT event_id AS id, event_type AS doc, 'kept' AS state FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0 UNION ALL SELECT event_id, upper(event_type), 'refused' FROM events WHERE event_id % 6 = 0")
def doc_insert(spark, d):
    e = events(spark, d)
    new = e.where("event_id % 3 = 0").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("doc"))
    docs, refused = documents.insert(e.where("event_id % 2 = 0").select(F.col("event_id").alias("id"), F.col("event_type").alias("doc")), new, "id")
    return docs.withColumn("state", F.lit("kept")).union(refused.withColumn("state", F.lit("refused")))


@query("doc_update_delete", "SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'new' ELSE event_type END AS doc FROM events WHERE event_id % 2 = 0 AND event_id % 5 <> 0 UNION ALL SELECT -event_id, 'missing' FROM events WHERE event_id % 2 = 1 AND event_id % 3 = 0")
def doc_update_delete(spark, d):
    e = events(spark, d).select(F.col("event_id").alias("id"), F.col("event_type").alias("doc"))
    docs, missing = documents.replace(e.where("id % 2 = 0"), e.where("id % 3 = 0").withColumn("doc", F.lit("new")), "id")
    left, _ = documents.delete(docs, e.where("id % 5 = 0").select("id"), "id")
    return left.union(missing.select(-F.col("id"), F.lit("missing")))


@query("doc_builder", "SELECT event_id FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE k > 20 AND (k < 30 OR k = 40) AND k <> 25 ORDER BY event_id LIMIT 12 OFFSET 3")
def doc_builder(spark, d):
    q = documents.DocQuery().gt("k", 20).any_of(documents.DocQuery().lt("k", 30), documents.DocQuery().eq("k", 40)).none_of(documents.DocQuery().eq("k", 25))
    return q.sort(F.col("event_id")).skip(3).limit(12).run(events(spark, d), "props").select("event_id")


def _points(spark, d):
    return events(spark, d).select(F.col("event_type").alias("metric"), F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("tags"), "ts", "value")


@query("ts_write", "SELECT event_type AS metric, CAST(user_id AS VARCHAR) AS user, ts, value FROM events WHERE event_type = 'view' AND ts >= (SELECT min(ts) FROM events) + INTERVAL '2 days' AND ts < (SELECT min(ts) FROM events) + INTERVAL '5 days'")
def ts_write(spark, d):
    root = storage.fresh_dir(spark, "points")
    points.write(_points(spark, d).where("metric <> 'click'"), root)
    points.write(_points(spark, d).where("metric = 'click'"), root)
    first = F.lit(events(spark, d).agg(F.min("ts")).first()[0])
    found = points.read(spark, root, "view", first + F.expr("INTERVAL 2 DAYS"), first + F.expr("INTERVAL 5 DAYS"))
    return found.select("metric", F.col("tags")["user"].alias("user"), "ts", "value")


@query("ts_metrics", "SELECT DISTINCT event_type AS metric, CASE WHEN event_type = 'click' THEN 'counter' ELSE 'gauge' END AS kind, CASE WHEN event_type = 'click' THEN 'clicks' ELSE '' END AS unit FROM events")
def ts_metrics(spark, d):
    root = storage.fresh_dir(spark, "points")
    points.register(spark, root, "click", "counter", "clicks")
    points.write(_points(spark, d), root)
    return points.metrics(spark, root)


@query("ts_series_count", "SELECT event_type AS metric, count(DISTINCT user_id) AS n_series, count(*) AS n_points FROM events GROUP BY event_type")
def ts_series_count(spark, d):
    per = _points(spark, d).groupBy("metric", F.col("tags")["user"].alias("user")).agg(F.count("*").alias("n"))
    return per.groupBy("metric").agg(F.count("*").alias("n_series"), F.sum("n").alias("n_points"))


@query("ts_drop_series", "SELECT event_type AS metric, count(*) AS n FROM events WHERE event_type <> 'click' AND NOT (event_type = 'view' AND user_id = 7) GROUP BY event_type")
def ts_drop_series(spark, d):
    left = points.drop_series(points.drop_series(_points(spark, d), "click"), "view", {"user": "7"})
    return left.groupBy("metric").agg(F.count("*").alias("n"))


@query("metrics_history", " UNION ALL ".join(f"SELECT '{s}' AS span, count(*) AS n, min(ts) AS first FROM events WHERE epoch(ts) >= (SELECT epoch(max(ts)) FROM events) - {n} HAVING count(*) > 0" for s, n in points.RANGES.items()))
def metrics_history(spark, d):
    now = F.lit(events(spark, d).agg(F.max("ts")).first()[0])
    out = None
    for span in points.RANGES:
        part = points.history(events(spark, d), span, now).agg(F.lit(span).alias("span"), F.count("*").alias("n"), F.min("ts").alias("first"))
        out = part if out is None else out.union(part)
    return out.where("n > 0")


def _messages(spark, d):
    return events(spark, d).select("event_id", "event_type", F.concat(F.lit("shop."), "event_type").alias("source"), F.col("ts").cast("timestamp").alias("ts"), F.col("props").alias("data"))


@query("channel_publish", "SELECT event_id, 'news' AS channel FROM (SELECT event_id FROM events WHERE event_type IN ('click', 'signup') ORDER BY ts DESC, event_id DESC LIMIT 30) UNION ALL SELECT event_id, 'all' FROM events WHERE event_type = 'signup' AND ts > (SELECT max(ts) FROM events) - INTERVAL '5 days'")
def channel_publish(spark, d):
    root, rows = storage.fresh_dir(spark, "channels"), _messages(spark, d)
    channels.publish(rows.where("event_type = 'signup'"), root, "news", "all")
    channels.publish(rows.where("event_type = 'click'"), root, "news")
    last = F.lit(events(spark, d).agg(F.max("ts")).first()[0]).cast("timestamp")
    newest = channels.history(spark, root, "news", 30).select("event_id", F.lit("news").alias("channel"))
    return newest.union(channels.history(spark, root, "all", after=last - F.expr("INTERVAL 5 DAYS")).select("event_id", F.lit("all")))


@query("channel_subscribe", "SELECT event_id, event_type FROM events WHERE event_type = 'signup' AND event_id % 2 = 0")
def channel_subscribe(spark, d):
    """Published, read as a stream with a filter, published to another channel, and read from there."""
    root = storage.fresh_dir(spark, "channels")
    channels.publish(_messages(spark, d), root, "all")
    heard = channels.subscribe(spark, root, "all", where=(F.col("event_type") == "signup") & (F.col("event_id") % 2 == 0))
    channels.publish_stream(heard, root, f"{root}-checkpoint", ["even"]).awaitTermination()
    return channels.history(spark, root, "even").select("event_id", "event_type")


@query("publish_change", "SELECT event_id, CASE event_type WHEN 'signup' THEN 'insert' ELSE 'update' END AS event_type, 'shop.users' AS source, '{\"user_id\":' || user_id || '}' AS data FROM events WHERE event_type IN ('signup', 'view')")
def publish_change(spark, d):
    root = storage.fresh_dir(spark, "channels")
    rows = events(spark, d).where("event_type IN ('signup', 'view')").select("event_id", "ts", F.when(F.col("event_type") == "signup", "Insert").otherwise("Update").alias("change_type"), "user_id")
    channels.publish(channels.change_events(rows, "shop", "users"), root, "changes")
    return channels.history(spark, root, "changes").select("event_id", "event_type", "source", "data")


@query("stream_retained", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def stream_retained(spark, d):
    return channels.retained(events(spark, d), 100, F.col("ts"), F.col("event_id")).select("event_id")


@query("result_csv", "SELECT n_nationkey || ',' || n_name || ',' || n_regionkey AS line FROM nation")
def result_csv(spark, d):
    return results.csv_lines(load(spark, d, "nation"))


@query("result_json", "SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"none\":null}' AS line FROM nation")
def result_json(spark, d):
    return results.json_lines(load(spark, d, "nation").select("n_nationkey", "n_name", F.lit(None).cast("string").alias("none")))


@query("subject_export_csv", "SELECT 'events,' || event_id || ',,' || event_type AS line FROM events WHERE user_id = 7 UNION ALL SELECT 'customer,' || c_custkey || ',' || c_name || ',' FROM customer WHERE c_custkey = 7")
def subject_export_csv(spark, d):
    e = events(spark, d).where("user_id = 7").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))
    c = load(spark, d, "customer").where("c_custkey = 7").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return results.csv_lines(results.union_of_stores({"events": e, "customer": c}, ["id", "name"]))


@query("partition_strategies", "SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 0 WHEN o_totalprice < 200000 THEN 1 ELSE 2 END AS by_range, CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus IN ('O', 'X') THEN 2 ELSE 0 END AS by_list, CAST(o_orderkey % 7 AS INTEGER) AS round_robin, CAST(floor(epoch(o_orderdate) / 3600) AS BIGINT) AS by_time FROM orders")
def partition_strategies(spark, d):
    by_hash = functions.by_hash(16, F.col("o_orderkey"))
    o = load(spark, d, "orders").where((by_hash >= 0) & (by_hash < 16))
    return o.select("o_orderkey", functions.by_range(F.col("o_totalprice"), [50000, 200000]).alias("by_range"), functions.by_list(F.col("o_orderstatus"), {1: ["F"], 2: ["O", "X"]}).alias("by_list"), functions.round_robin(F.col("o_orderkey"), 7).alias("round_robin"), functions.by_time(F.col("o_orderdate"), 3600).alias("by_time"))


@query("detect_login_bursts", """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type = 'error'),
s AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, CAST([] AS TIMESTAMP[]) AS w, false AS fired FROM e
UNION ALL SELECT user_id, i, event_id, CASE WHEN len(k) >= 3 THEN CAST([] AS TIMESTAMP[]) ELSE k END, len(k) >= 3 FROM (SELECT e.user_id, e.i, e.event_id, list_append(list_filter(s.w, lambda t: t >= e.ts - INTERVAL '7 days'), e.ts) AS k FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1))
SELECT user_id AS key, event_id AS event FROM s WHERE fired""")
def detect_login_bursts(spark, d):
    return detect.bursts(events(spark, d).where("event_type = 'error'"), F.col("user_id"), 3, 7 * 86400).select("key", "event")


@query("detect_rules", "SELECT event_id, CASE WHEN value >= 50 AND user_id % 5 <> 0 AND user_id % 7 > 2 THEN 'mass_operation,untrusted_ip' WHEN value >= 50 THEN 'mass_operation' ELSE 'untrusted_ip' END AS rules FROM events WHERE value >= 50 OR user_id % 5 <> 0 AND user_id % 7 > 2")
def detect_rules(spark, d):
    address = F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("10.0.0."), F.col("user_id") % 7))
    found = detect.rules(F.col("value") * 20, address, ["10.0.0.0", "10.0.0.1", "10.0.0.2"], 1000)
    return events(spark, d).select("event_id", F.array_join(found, ",").alias("rules")).where("rules <> ''")


_SEVERITY = "CASE WHEN value >= 80 THEN 'critical' WHEN value >= 50 THEN 'high' ELSE 'low' END"


@query("incident_list", f"SELECT event_id, {_SEVERITY} AS severity FROM events WHERE value >= 50 ORDER BY ts DESC, event_id DESC LIMIT 25")
def incident_list(spark, d):
    """Open incidents, newest first."""
    return events(spark, d).where("value >= 50").orderBy(F.desc("ts"), F.desc("event_id")).limit(25).select("event_id", F.expr(_SEVERITY).alias("severity"))


@query("incident_counts", f"SELECT severity, count(*) AS n, CAST(sum(CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_open, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS n_error, CAST(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) AS BIGINT) AS n_other FROM (SELECT *, {_SEVERITY} AS severity FROM events) GROUP BY severity")
def incident_counts(spark, d):
    """Counts by severity, status and type."""
    e = events(spark, d).withColumn("severity", F.expr(_SEVERITY))
    add = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    return e.groupBy("severity").agg(F.count("*").alias("n"), add(F.col("user_id") % 2 == 0).alias("n_open"), add(F.col("event_type") == "error").alias("n_error"), add(F.col("event_type") != "error").alias("n_other"))


@query("activity_by_user", "SELECT event_id FROM events WHERE user_id = 7 AND ts >= (SELECT max(ts) FROM events) - INTERVAL '20 days' ORDER BY ts DESC, event_id DESC LIMIT 10")
def activity_by_user(spark, d):
    last = F.lit(events(spark, d).agg(F.max("ts")).first()[0])
    return events(spark, d).where((F.col("user_id") == 7) & (F.col("ts") >= last - F.expr("INTERVAL 20 DAYS"))).orderBy(F.desc("ts"), F.desc("event_id")).limit(10).select("event_id")


@query("activity_recent", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL '1 day' ORDER BY ts DESC, event_id DESC LIMIT 50")
def activity_recent(spark, d):
    last = F.lit(events(spark, d).agg(F.max("ts")).first()[0])
    return events(spark, d).where(F.col("ts") >= last - F.expr("INTERVAL 1 DAY")).orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id")


@query("crdt_mv_clocks", """WITH v AS (SELECT DISTINCT l_partkey AS id, l_quantity AS value, l_linenumber AS a, CAST(l_tax * 100 AS INTEGER) AS b, CAST(l_discount * 100 AS INTEGER) AS c FROM lineitem)
SELECT id, value, a, b, c FROM v WHERE NOT EXISTS (SELECT 1 FROM v w WHERE w.id = v.id AND w.a >= v.a AND w.b >= v.b AND w.c >= v.c AND (w.a > v.a OR w.b > v.b OR w.c > v.c))""")
def crdt_mv_clocks(spark, d):
    """Registers whose versions have clocks of three nodes."""
    parts = [F.col("l_linenumber").cast("int"), F.round(F.col("l_tax") * 100).cast("int"), F.round(F.col("l_discount") * 100).cast("int")]
    clock = F.create_map(*[x for n, c in zip("abc", parts, strict=True) for x in (F.lit(n), c)])
    out = replicas.multi_value(load(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_quantity").alias("value"), clock.alias("clock")))
    return out.select("id", "value", *[F.col("clock")[n].alias(n) for n in "abc"])


def _nodes(spark, d):
    return load(spark, d, "nation").select(F.concat(F.lit("nation:"), "n_nationkey").alias("id"), F.lit("Nation").alias("label"))


@query("graph_create_nodes", "SELECT 'nation:' || n_nationkey AS id, 'Nation' AS label FROM nation UNION ALL SELECT 'nation:' || ((SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY r_name)), 'Nation' FROM region UNION ALL SELECT 'city:' || row_number() OVER (ORDER BY r_name), 'City' FROM region")
def graph_create_nodes(spark, d):
    r = load(spark, d, "region")
    new = r.select(F.lit("Nation").alias("label"), "r_name").union(r.select(F.lit("City"), "r_name"))
    return graph.create_nodes(_nodes(spark, d), new, "r_name")


@query("graph_create_edges", "SELECT 'nation:' || c_nationkey AS source, 'nation:' || (c_nationkey + 5) AS target, c_custkey AS n, CASE WHEN c_nationkey + 5 <= 24 THEN 'made' ELSE 'refused' END AS state FROM customer")
def graph_create_edges(spark, d):
    new = load(spark, d, "customer").select(F.concat(F.lit("nation:"), "c_nationkey").alias("source"), F.concat(F.lit("nation:"), F.col("c_nationkey") + 5).alias("target"), F.col("c_custkey").alias("n"))
    made, refused = graph.create_edges(_nodes(spark, d), new.limit(0), new)
    return made.withColumn("state", F.lit("made")).union(refused.withColumn("state", F.lit("refused")))
