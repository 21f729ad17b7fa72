"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document; the ledger keeps the measurements and one long
whose bit k says that rule k failed. Policies are versioned masks of rules: a document is
kept under a policy if no bit of the mask is set, so applying or changing a policy, and
computing what each rule alone costs, reads bits and never texts. Expressions only, no
shuffle: repeated 8-word windows are found inside the row from hashes of the windows.

Cases: null text is an empty text (all counts 0, base_failed); texts of any length are
measured whole; an empty table gives no rows; repeated rows and repeated or null doc_ids
stay rows of their own; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .store import materialize

WINDOW = 8
SPACE = r"[\x20\x09-\x0D]+"
#: rule: it fails where the SQL condition over the measurements holds. Bit k is the k-th rule.
RULES = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
    "symbols": "5 * n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "few_letters": "100 * n_letters < 60 * word_chars",
    "shouting": "100 * n_upper > 60 * n_letters",
}
BASE = ("few_words", "repeated_words")
#: Versioned policies: the rules that reject.
POLICIES = {"v1": ("few_words", "repeated_words", "word_length", "symbols"), "v2": tuple(RULES)}


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(policy: str) -> int:
    return sum(bit(r) for r in POLICIES[policy])


def _let(value: Column, body) -> Column:
    """body over a value that is evaluated once."""
    return F.transform(F.array(value), body)[0]


def _covered(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more; hashes by window start."""

    def over(s: Column) -> Column:
        twin = lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
        starts = F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

        def step(acc: Column, i: Column) -> Column:
            end = i.cast("long") + WINDOW
            return F.struct((acc["n"] + end - F.greatest(acc["end"], i.cast("long"))).alias("n"), end.alias("end"))

        return F.aggregate(starts, zero, step)["n"]

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _let(pairs, over)


def measure(text: Column) -> Column:
    """All measurements of a text as one struct."""
    text = F.coalesce(text, F.lit(""))

    def words(w: Column) -> Column:
        n = F.size(w)
        hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
        repeat = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_covered(h)))
        return F.struct(n.cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), repeat.alias("n_repeat_words"))

    def lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    with_word = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    return F.struct(
        _let(F.array_remove(F.split(text, SPACE), ""), words).alias("words"),
        _let(with_word, lines).alias("lines"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        count(r"\p{L}").alias("n_letters"),
        count(r"\p{Lu}").alias("n_upper"),
    )


def build_ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and fail_bits."""
    m = docs.select(F.col("doc_id"), measure(F.col("text")).alias("m"))
    m = m.select("doc_id", "m.words.*", "m.lines.*", "m.n_symbols", "m.n_letters", "m.n_upper")
    bits = " | ".join(f"(CASE WHEN {rule} THEN {bit(name)}L ELSE 0L END)" for name, rule in RULES.items())
    return m.withColumn("fail_bits", F.expr(bits))


def apply_policy(ledger: DataFrame, policy: str = "v2") -> DataFrame:
    """base_failed and kept from the bits alone."""
    base = sum(bit(r) for r in BASE)
    failed = lambda m: F.col("fail_bits").bitwiseAND(F.lit(m)) != 0
    return ledger.withColumn("base_failed", failed(base)).withColumn("kept", ~failed(mask(policy) | base))


def ablations(ledger: DataFrame, policy: str = "v2") -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail it alone, and that are kept without it.

    The ledger is first added up by its bit patterns (few, whatever the corpus), so the
    rules are tried on pattern counts.
    """
    patterns = ledger.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).cast("long").alias("bit")) for r in POLICIES[policy]])).alias("r")
    each = patterns.select("bits", "n", rules).select("bits", "n", "r.*")
    add = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(add(hit).alias("n_failed"), add(F.col("bits") == F.col("bit")).alias("n_failed_alone"), add(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0).alias("n_kept_without"))


def stored_ledger(docs: DataFrame) -> DataFrame:
    """The ledger as a table in shared storage: texts are read once, policies and ablations read bits."""
    return materialize(build_ledger(docs), "ledger")


def op1_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policy v2 over the stored ledger; kept_v1 is the older version's verdict."""
    ledger = stored_ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    older = apply_policy(ledger, "v1").withColumnRenamed("kept", "kept_v1").drop("base_failed")
    out = apply_policy(older, "v2")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits", "kept_v1")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of policy v2 costs, from the stored ledger."""
    return ablations(stored_ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))


_MEASURED = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM w WHERE len(w) >= 8),
h AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS gram FROM g),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM h) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, (SELECT unnest(range(0, 8)) AS j) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
        len(regexp_extract_all(text, '\p{L}')) AS n_letters, len(regexp_extract_all(text, '\p{Lu}')) AS n_upper
      FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
b AS (SELECT *, CAST(@BITS@ AS BIGINT) AS fail_bits FROM m)
""".replace("@BITS@", " + ".join(f"(CASE WHEN {rule} THEN {1 << k} ELSE 0 END)" for k, rule in enumerate(RULES.values())))
OP1_SQL = f"{_MEASURED} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, (fail_bits & {mask('v2')}) = 0 AS kept, fail_bits, (fail_bits & {mask('v1')}) = 0 AS kept_v1 FROM b"
ABLATIONS_SQL = _MEASURED + " UNION ALL ".join(
    f"SELECT '{rule}' AS rule, CAST(count(*) FILTER (fail_bits & {bit(rule)} <> 0) AS BIGINT) AS n_failed, CAST(count(*) FILTER (fail_bits & {mask('v2')} = {bit(rule)}) AS BIGINT) AS n_failed_alone, CAST(count(*) FILTER (fail_bits & {mask('v2') & ~bit(rule)} = 0) AS BIGINT) AS n_kept_without FROM b"
    for rule in POLICIES["v2"]
)
