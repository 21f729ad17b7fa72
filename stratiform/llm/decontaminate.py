"""Benchmark decontamination by a hash set of normalised benchmark windows.

Words are runs of ASCII letters and digits and of characters from U+0080 on, A-Z in lower
case. A window is ten consecutive words of an item; an item of fewer words is one window.

A benchmark of at most MAX_TABLE windows (counted first, with the bytes of its words)
becomes a hash table inside the plan, which Spark hands to every executor once: each text's
windows are looked up where the text lies and verified word by word against the items, in
one pass without a shuffle. Above that, hashes of the corpus's windows meet the
benchmark's in a join, salted against common passages, and hits are brought back to
their texts by doc_id and text hash, as a broadcast if their bytes allow it. DataFrame functions only.

Cases: null text has no words; null item text and items without words have no window; an
empty table on either side gives no hits; repeated rows and doc_ids stay rows of their own
(hits belong to a doc_id and its text); a null item_id counts as the empty string; further
columns of the documents are passed through, whatever their names; those that `find_hits`
adds get names that are free.
"""

from __future__ import annotations

import json
import string

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .store import materialize

WINDOW = 10
#: Windows, and bytes of the items' words, of a benchmark that becomes a hash table in the plan.
MAX_TABLE, MAX_TABLE_BYTES = 20_000, 1 << 20
#: Slots of that table for each window.
SPARE = 8
#: Bytes of rows that may be broadcast (what Spark holds of them is a few times as much).
MAX_BYTES = 16 << 20
SALTS = 16
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Normalised words. Without non-ASCII characters lower() changes A-Z alone and is faster."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lower(text))
    return F.array_remove(F.split(low, NOT_WORD), "")


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _hashes(w: Column, size: int) -> Column:
    n = F.size(w)
    return F.when(n >= size, F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.xxhash64(F.slice(w, i, size)))).otherwise(F.array().cast("array<bigint>"))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """hash, size, gram and the ids of the items that hold it, one row per distinct window."""
    w = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(WINDOW))
    w = w.withColumn("size", size)
    each = w.select("item", "size", F.explode(F.expr("transform(sequence(1, size(w) - size + 1), i -> slice(w, i, size))")).alias("g"))
    return each.groupBy(F.xxhash64("g").alias("hash"), "size", F.array_join("g", " ").alias("gram")).agg(F.array_sort(F.collect_set("item")).alias("items"))


def free_name(taken: list[str], name: str) -> str:
    while name.lower() in (c.lower() for c in taken):
        name += "_"
    return name


def window_key(w: Column, i: Column, size: int) -> Column:
    """Hash of the first, middle and last word of the window that begins at place i (from 1); all words are compared after."""
    return F.xxhash64(F.get(w, i - 1), F.get(w, i + (size // 2 - 1)), F.get(w, i + (size - 2)))


def hash_table(benchmark: DataFrame) -> tuple[list[int], Column, Column, Column] | None:
    """Sizes of windows, and as constants the items' words, their ids, and slots of
    [item, place] by the windows' hashes; None if the benchmark is too large."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    items = materialize(items, "items")
    size = F.least(F.size("w"), F.lit(WINDOW))
    count, weight = items.agg(F.sum(F.size("w") - size + 1), F.sum(F.octet_length(F.array_join("w", ",")) + F.octet_length("item") + 16)).first()
    if (count or 0) > MAX_TABLE or (weight or 0) > MAX_TABLE_BYTES:
        return None
    keys = [F.when(size == s, F.transform(F.sequence(F.lit(1), F.size("w") - (s - 1)), lambda i: window_key(F.col("w"), i, s))) for s in range(1, WINDOW + 1)]  # noqa: B023
    rows = items.select("item", "w", size.alias("size"), F.coalesce(*keys).alias("h")).orderBy("item", "w").collect()
    slots: list[list[tuple[int, int]]] = [[] for _ in range(SPARE * max(1, count or 0))]
    for k, row in enumerate(rows):
        for i, h in enumerate(row.h):
            slots[h % len(slots)].append((k, i + 1))
    constant = lambda value, kind: F.from_json(F.lit(json.dumps(value, separators=(",", ":"), ensure_ascii=False)), kind)
    return sorted({r["size"] for r in rows}), constant([r.w for r in rows], "array<array<string>>"), constant([r["item"] for r in rows], "array<string>"), constant(slots, "array<array<array<int>>>")


def hits_in_place(w: Column, sizes: list[int], item_words: Column, item_ids: Column, slots: Column) -> Column:
    """The hits among a text's words."""

    def of_size(size: int) -> Column:
        window = lambda i: F.slice(w, i, size)
        slot = lambda i: F.get(slots, F.pmod(window_key(w, i, size), F.size(slots).cast("long")).cast("int"))
        here = F.when(F.size(w) >= size, F.sequence(F.lit(1), F.size(w) - (size - 1))).otherwise(F.array().cast("array<int>"))
        same = lambda i: lambda x: F.slice(F.get(item_words, x[0]), x[1], size) == window(i)
        # an item of fewer words than WINDOW is met as a whole only
        whole = lambda x: F.lit(True) if size == WINDOW else F.size(F.get(item_words, x[0])) == size
        hit = lambda i: lambda x: F.struct((i - 1).alias("start"), F.lit(size).alias("size"), F.array(F.get(item_ids, x[0])).alias("items"))
        some = F.filter(here, lambda i: F.size(slot(i)) > 0)
        return F.flatten(F.transform(some, lambda i: F.transform(F.filter(slot(i), lambda x: whole(x) & same(i)(x)), hit(i))))

    return F.sort_array(F.concat(*map(of_size, sizes)))


NO_HITS = "array<struct<start:int,size:int,items:array<string>>>"


def find_hits(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, str, str]:
    """The documents' columns and two more, and the names of those: the number of words (long),
    and the hits (array of start, size, items by start; start counts words from 0; null without hits)."""
    n_words, hits_at = free_name(docs.columns, "n_words"), free_name(docs.columns, "hits")
    table = hash_table(benchmark)
    if table is None:
        return _find_by_join(docs, benchmark, n_words, hits_at), n_words, hits_at
    sizes, *constants = table
    made = free_name(docs.columns, "found")
    found = lambda w: F.struct(F.size(w).cast("long").alias("n"), (hits_in_place(w, sizes, *constants) if sizes else F.array().cast(NO_HITS)).alias("hits"))
    out = docs.withColumn(made, _let(words(F.col("text")), found))
    out = out.withColumns({n_words: F.col(made)["n"], hits_at: F.when(F.size(F.col(made)["hits"]) > 0, F.col(made)["hits"])})
    return out.drop(made), n_words, hits_at


def _find_by_join(docs: DataFrame, benchmark: DataFrame, n_words: str, hits_at: str) -> DataFrame:
    own = "_own"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    doc, tie, found_here, cut = (own + x for x in ("doc", "tie", "found", "cut"))
    windows = materialize(benchmark_windows(benchmark), "windows")
    # the join needs one row a hash; grams and items are looked up for the hashes that were met
    hashes = windows.groupBy("hash").agg(F.collect_set("size").alias("sizes"))
    count, sizes = windows.agg(F.countDistinct("hash"), F.collect_set("size")).first()
    base = docs.withColumn(cut, words(F.col("text")))
    base = base.withColumn(n_words, F.size(cut).cast("long")).drop(cut)
    sizes = sorted(sizes or [])
    if not sizes:
        return base.withColumn(hits_at, F.lit(None).cast(NO_HITS))
    key = [F.coalesce(F.col("doc_id"), F.lit(-1)).alias(doc), F.xxhash64("doc_id", "text").alias(tie)]
    # windows of all sizes in one array; a place in it tells size and start
    scan = docs.where(F.col("text").isNotNull()).select(*key, _let(words(F.col("text")), lambda w: F.struct(F.size(w).alias("n"), F.concat(*[_hashes(w, s) for s in sizes]).alias("h"))).alias("s"))
    scan = scan.select(doc, tie, F.col("s.n").alias("n"), F.posexplode("s.h").alias("at", "hash"))
    if count * 32 <= MAX_BYTES:
        met = scan.join(F.broadcast(hashes), "hash")
    else:
        salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        met = scan.withColumn("salt", F.pmod(F.xxhash64(doc, "at"), F.lit(SALTS)).cast("int")).join(hashes.select("*", salt), ["hash", "salt"])
    start, size, before = F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(0)
    for s in sizes:
        here = F.greatest(F.col("n") - (s - 1), F.lit(0))
        inside = (F.col("at") >= before) & (F.col("at") < before + here) & F.array_contains("sizes", s)
        start, size = F.coalesce(start, F.when(inside, F.col("at") - before)), F.coalesce(size, F.when(inside, F.lit(s)))
        before = before + here
    met = met.select(doc, tie, "hash", start.alias("start"), size.alias("size")).where("start IS NOT NULL")
    met = materialize(met.groupBy(doc, tie, "hash", "size").agg(F.collect_set("start").alias("starts")), "met")
    # few windows are met: their grams and items, or all if there are few
    grams = windows.join(met.select("hash").distinct(), "hash", "left_semi")
    weight = F.sum(F.octet_length("gram") + F.aggregate("items", F.lit(0), lambda a, x: a + F.octet_length(x)) + 32)
    grams = materialize(grams, "grams")
    near = (grams.agg(weight).first()[0] or 0) <= MAX_BYTES
    named = met.join(F.broadcast(grams) if near else grams, ["hash", "size"])
    hits = materialize(named.groupBy(doc, tie).agg(F.flatten(F.collect_list(F.transform("starts", lambda x: F.struct(x.alias("start"), F.col("size").alias("size"), F.col("gram").alias("gram"), F.col("items").alias("items"))))).alias(found_here)), "hits")
    each = F.aggregate(found_here, F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x["gram"]) + F.aggregate(x["items"], F.lit(0), lambda b, i: b + F.octet_length(i)) + 64)
    keyed = base.select("*", *key)
    if (hits.agg(F.sum(each + 64)).first()[0] or 0) <= MAX_BYTES:
        joined = keyed.join(F.broadcast(hits), [doc, tie], "left").drop(doc, tie)
    else:
        # repeated rows have one key; the scan's partition spreads them
        salt = own + "salt"
        salted = hits.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn(salt, F.pmod(F.spark_partition_id(), F.lit(SALTS))).join(salted, [doc, tie, salt], "left").drop(doc, tie, salt)
    found = _let(words(F.col("text")), lambda w: F.filter(F.col(found_here), lambda x: F.array_join(F.slice(w, x["start"] + 1, x["size"]), " ") == x["gram"]))
    verified = F.when(F.col(found_here).isNotNull(), F.sort_array(F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["size"].alias("size"), x["items"].alias("items")))))
    out = joined.withColumn(hits_at, verified).drop(found_here)
    return out.withColumn(hits_at, F.when(F.size(hits_at) > 0, F.col(hits_at)))


def hit_words(hits: Column) -> Column:
    """Words inside any hit, each once."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def step(acc: Column, x: Column) -> Column:
        end = F.greatest(acc["end"], (x["start"] + x["size"]).cast("long"))
        return F.struct((acc["n"] + end - F.greatest(acc["end"], F.least(end, x["start"].cast("long")))).alias("n"), end.alias("end"))

    return F.coalesce(F.aggregate(hits, zero, step)["n"], F.lit(0).cast("long"))


def hit_items(hits: Column) -> Column:
    return F.coalesce(F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda x: x["items"])))), F.array().cast("array<string>"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "spans", drop_share: float = 0.5) -> DataFrame:
    """The documents without what the benchmark holds, same columns.

    spans: hit words are cut out (the rest is joined by single spaces between the cut
    places' neighbours; texts without hits stay as they are), and a document that loses
    drop_share of its words or more goes; documents: every document with a hit goes.
    """
    found, n_words, hits = find_hits(docs, benchmark)
    if mode == "documents":
        return found.where(F.col(hits).isNull()).select(*docs.columns)
    share = hit_words(F.col(hits)) / F.greatest(F.col(n_words), F.lit(1))
    found = found.where(F.col(hits).isNull() | (share < drop_share))
    # original word pieces with what follows them, so that kept words keep their form
    piece = F.regexp_extract_all(F.col("text"), F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)"), F.lit(1))
    head = F.regexp_extract(F.col("text"), r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    kept = F.filter(piece, lambda p, i: ~F.exists(F.col(hits), lambda x: (i >= x["start"]) & (i < x["start"] + x["size"])))
    text = F.when(F.col(hits).isNull(), F.col("text")).otherwise(F.concat(head, F.array_join(kept, "")))
    return found.withColumn("text", text).select(*docs.columns)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found, n_words, hits = find_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    out = found.select("doc_id", F.col(n_words).alias("n_words"), hit_words(F.col(hits)).alias("n_hit"), hit_items(F.col(hits)).alias("items"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i+n-1], ' ') AS gram FROM bi),
s AS (SELECT DISTINCT n FROM bw),
di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, s WHERE len(w) >= n),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS gram FROM di),
h AS (SELECT doc_id, item, n, i FROM dw JOIN bw USING (gram, n)),
p AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
