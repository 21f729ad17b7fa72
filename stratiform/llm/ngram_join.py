"""Exact n-gram Jaccard join over vertical partitions, and its connected components.

The global order of n-grams is the order of their hashes; it is cut into fragments, and a
document's set falls into one segment per fragment.

Candidates: two sets of similarity t or more differ in at most D n-grams, so of any D + 1
segments of one set, one is untouched by the differences and equal in the other. Each
document therefore emits its D + 1 largest segments (by size, then fragment), D being the
most that its size allows; equal segments meet. The rule that picks segments is one order for
all documents, so whichever of two documents is stricter, the other emits the same segment
too. Fragments are fixed by size classes; a document near the upper bound of its class also
emits in the next one. Documents with too few non-empty segments also emit their prefix
n-grams, by which two such documents meet. No link is lost.

Verification: sets of documents that met somebody are cut into FRAGMENTS pieces of the global
order; each piece of a pair is intersected on its own, and the partial overlaps are summed
per pair.

Work does not grow with the square of a group: equal sets are one class from the start; the
first rounds verify only members of a meeting point against one hub of it; what these links
connect is one component. What is left, sets that met one of another component, is joined
once more by the prefixes of the n-gram order by frequency, rare ones first; there the pairs
of different components are compared whose n-grams that others have at all suffice for a link.

Cases: null, empty and white-space texts have no n-grams and link with nothing; documents of
fewer than k words have their word sequence as one n-gram; a null doc_id takes part, and is
the component's id only if no member has another; repeated rows are one class and keep their
rows; an empty table gives no rows; further columns are ignored, or passed through by `one_of_each`.

Sets are told apart by two 64-bit hashes and their sizes, n-grams by one 64-bit hash of their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import ship_package
from .files import let_go
from .store import broadcast_if_small, materialize, release
from .textops import U, combine, mix, portions, shingle_sets

FRAGMENTS = 8
SALTS = 16
ROUNDS = 3
FIRST_CLASS = 8
#: Rows of keys or n-grams that a task counts or joins at once, on average; more are dealt with in passes, as many as MOST_PASSES.
PASS_ROWS, MOST_PASSES = 200_000, 16


def most_differences(n: int, percent: int) -> int:
    """Differences from a set of n n-grams to any set of at least this similarity."""
    return (100 - percent) * n // percent


def set_identity(grams: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set, as signed numbers."""
    with np.errstate(over="ignore"):
        both = mix(np.array([mix(grams).sum(dtype=U) + U(len(grams)), mix(grams ^ U(0x5851F42D4C957F2D)).sum(dtype=U)], U))
    one, two = both.view(np.int64).tolist()
    return one, two


def _segments(grams: np.ndarray, top: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fragments, sizes and content hashes of the non-empty segments, for the class of sizes up to top."""
    count = U(most_differences(top, percent) * 21 // 20 + 3)
    frag = (grams >> U(32)) * count >> U(32)
    begin = np.flatnonzero(np.concatenate([[True], frag[1:] != frag[:-1]]))
    size = np.diff(np.append(begin, len(grams)))
    return frag[begin], size, np.add.reduceat(mix(grams), begin)


def signatures(grams: np.ndarray, percent: int) -> np.ndarray:
    """Keys by which similar sets meet."""
    n = len(grams)
    d = most_differences(n, percent)
    if d == 0:  # similar sets are equal
        return np.zeros(0, U)
    top = FIRST_CLASS
    while top < n:
        top *= 2
    tops = [top] if percent * top > 100 * n else [top, 2 * top]
    out = []
    for t in tops:
        frag, size, content = _segments(grams, t, percent)
        if len(frag) <= d:
            # the other set's size may be in a class where it, too, has too few: meet by prefix n-grams
            out.append(mix(grams[: n - (percent * n + 99) // 100 + 1] ^ U(0x2545F4914F6CDD1D)))
        pick = np.lexsort((frag, -size))[: d + 1]
        out.append(combine([np.full(len(pick), U(t)), frag[pick], content[pick]]))
    return np.unique(np.concatenate(out))


def passes(spark: SparkSession, rows: int | None) -> int:
    """Passes over so many rows that meet by key, each key in one of them: they keep a task's
    hash tables and sorts small and let the shuffle files of one pass go before the next."""
    return min(MOST_PASSES, max(1, -(-(rows or 0) // (PASS_ROWS * int(spark.conf.get("spark.sql.shuffle.partitions"))))))


def tie(text: str = "text") -> Column:
    """Tells rows of one doc_id and different texts apart."""
    return F.xxhash64(F.col(text))


def describe(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, tie, n (set size), cls and cls2 (set hashes), keys (signatures) of every document."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for part in portions(batch, 2):
                n, a, b, keys = [], [], [], []
                for _, grams in shingle_sets(part.column(2), k):
                    one, two = set_identity(grams)
                    n.append(len(grams))
                    a.append(one)
                    b.append(two)
                    keys.append(signatures(grams, percent).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "tie", "n", "cls", "cls2", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), tie().alias("tie"), "text").mapInArrow(run, "doc_id long, tie long, n long, cls long, cls2 long, keys array<long>")


def fragment_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(id, frag, grams): the sets of the rows that wanted (id, doc_id, tie, cls) names, in pieces of the global order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tie().alias("tie"), "text").where(F.col("text").isNotNull())
    same = rows["doc_id"].eqNullSafe(wanted["doc_id"]) & (rows["tie"] == wanted["tie"])
    rows = rows.join(wanted, same).select("id", "cls", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 2, 256):
                ids, frag, sets = [], [], []
                for one, cls, (_, grams) in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), shingle_sets(part.column(2), k), strict=True):
                    if set_identity(grams)[0] != cls:
                        continue
                    cut = np.searchsorted(grams, np.arange(FRAGMENTS + 1, dtype=U)[:-1] << U(61))
                    for f, x in enumerate(np.split(grams, cut[1:])):
                        if len(x):
                            ids.append(one)
                            frag.append(f)
                            sets.append(x.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(frag, pa.int32()), pa.array(sets, pa.binary())], ["id", "frag", "grams"])

    return rows.mapInArrow(run, "id long, frag int, grams binary").groupBy("id", "frag").agg(F.first("grams").alias("grams"))


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, na, nb, common): partial overlaps per fragment, summed per pair."""
    left = sets.select(F.col("id").alias("a"), "frag", F.col("grams").alias("ga"))
    right = sets.select(F.col("id").alias("b"), "frag", F.col("grams").alias("gb"))
    both = pairs.join(left, "a").join(right, ["b", "frag"]).select("a", "b", "na", "nb", "ga", "gb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common = [len(np.intersect1d(np.frombuffer(x, U), np.frombuffer(y, U), assume_unique=True)) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(common, pa.int64())], ["a", "b", "na", "nb", "part"])

    parts = both.mapInArrow(run, "a long, b long, na long, nb long, part long")
    return parts.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("common"))


def grams_of(sets: DataFrame, members: DataFrame) -> DataFrame:
    """(id, gram) of the members."""
    rows = sets.join(members.select("id"), "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                grams = [np.frombuffer(x, np.int64) for x in part.column(1).to_pylist()]
                ids = np.repeat(part.column(0).to_numpy(), [len(g) for g in grams])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(grams), pa.int64())], ["id", "gram"])

    return rows.select("id", "grams").mapInArrow(run, "id long, gram long")


def unique_grams(sets: DataFrame, members: DataFrame) -> DataFrame:
    """(id, alone): n-grams of each member (id, n) that no other member has."""
    spark = sets.sparkSession
    # an n-gram lies in one fragment
    many = min(FRAGMENTS, passes(spark, members.agg(F.sum("n")).first()[0]))
    out = None
    for i in range(many):
        alone = grams_of(sets.where(F.col("frag") % many == i), members).groupBy("gram").agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n = 1")
        part = materialize(alone.groupBy("id").agg(F.count("*").alias("alone")), "alone")
        del alone
        release(spark)
        out = part if out is None else out.union(part)
    return out.groupBy("id").agg(F.sum("alone").alias("alone"))


def meeting(keyed: DataFrame, keys: int | None) -> list[DataFrame]:
    """(id, key) of the keys that several rows of keyed (id, keys) have, as stored tables; keys: how many there are in all."""
    spark = keyed.sparkSession
    many = passes(spark, keys)
    out = []
    for i in range(many):
        # the large tables hold keys and numbers alone; a key is in a class once, so counts tell what meets
        posts = keyed.select("id", F.explode("keys").alias("key")).where(F.pmod("key", F.lit(many)) == i)
        met = posts.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
        out.append(materialize(posts.join(met, "key"), "posts"))
        del posts, met
        release(spark)
    return out


def prefix_pairs(sets: DataFrame, members: DataFrame, percent: int, possible: Column) -> DataFrame:
    """Pairs (a, b, na, nb) of members (id, n, most, label) that share an n-gram within both
    prefixes of the order by frequency among the members. A link of two sets of sizes na and nb
    needs o n-grams in common, so one of them is among the first na - o + 1 and nb - o + 1."""
    grams = grams_of(sets, members)
    counts = grams.groupBy("gram").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "gram")) - 1
    ranked = grams.join(counts.where("df > 1"), "gram", "left").select("id", "gram", F.coalesce("df", F.lit(1)).alias("df")).withColumn("at", place)
    ranked = ranked.where("df > 1").join(members, "id").where(f"100 * (n - at) >= {percent} * n")
    ranked = materialize(ranked, "prefixes")
    # stored by itself, so that the joins read their sides as they come and a common n-gram can be split
    mixed = materialize(ranked.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("gram"), "prefixes")
    ranked = materialize(ranked.join(mixed, "gram"), "prefixes")

    def side(x: str) -> DataFrame:
        return ranked.select(F.col("gram").alias(f"g{x}"), F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("most").alias(f"m{x}"), F.col("label").alias(f"l{x}"), F.col("at").alias(f"at{x}"))

    reach = lambda x: F.expr(f"{100 + percent} * (n{x} - at{x}) >= {percent} * (na + nb)")
    met = side("a").join(side("b"), (F.col("ga") == F.col("gb")) & F.expr("a < b") & possible & reach("a") & reach("b"))
    return met.select("a", "b", "na", "nb")


def connected(links: DataFrame) -> DataFrame:
    """(v, label): the smallest vertex reachable, for every vertex of links (a, b).

    Labels fall to the neighbours' minimum and then to their label's label, until nothing
    changes; every step is a stored table.
    """
    edges = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = materialize(edges.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("label")), "labels")
    while True:
        seen = edges.join(labels, edges["b"] == labels["v"]).groupBy("a").agg(F.min("label").alias("m"))
        low = labels.join(seen, labels["v"] == seen["a"]).select("v", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("v").alias("w"), F.col("label").alias("far"))
        new = materialize(low.join(jump, low["label"] == jump["w"], "left").select("v", "old", F.least("label", "far").alias("label")), "labels")
        if new.where("label <> old").isEmpty():
            return new.select("v", "label")
        labels = new.select("v", "label")


def assigned(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, tie, n (set size) of every row, and the representative (`rep`: nameless, doc_id,
    tie) of its component: the smallest doc_id, rows without one last, then the smallest tie;
    null for rows of a set that no other row has or is linked with."""
    spark = docs.sparkSession
    signed = materialize(describe(docs, k, percent), "signatures")
    described = materialize(signed.drop("keys"), "sets")
    # equal sets are one class; the class gets a number, the wide key stays behind
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "tie")
    classes = signed.where("n > 0").groupBy("cls", "cls2", "n").agg(F.min(row).alias("first"), F.count("*").alias("copies"), F.first("keys").alias("keys"))
    keyed = materialize(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    classes = materialize(keyed.select("*", F.size("keys").alias("m")).drop("keys"), "classes")
    release(spark, signed)
    parts = meeting(keyed, classes.agg(F.sum("m")).first()[0])
    posts = reduce(DataFrame.union, parts)
    release(spark, keyed)
    some = materialize(classes.join(posts.select("id").distinct(), "id", "left_semi").select("id", "n"), "members")
    wanted = materialize(classes.join(some, "id", "left_semi").select("id", "cls", F.col("first.doc_id").alias("doc_id"), F.col("first.tie").alias("tie")), "wanted")
    sets = materialize(fragment_sets(docs, broadcast_if_small(wanted, 64), k), "fragments")
    release(spark)
    # a set has at most in common with another what it does not have alone; without enough of that it has no link
    sizes = some.join(unique_grams(sets, some), "id", "left")
    sizes = sizes.select("id", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("most")).where(f"100 * most >= {percent} * n")
    posts = materialize(posts.join(sizes, "id").select("key", "id", "n", "most"), "linkable")
    release(spark, *parts, some)
    possible = F.expr(f"a <> b AND la <> lb AND 100 * least(na, nb) >= {percent} * greatest(na, nb) AND (100 + {percent}) * least(ma, mb) >= {percent} * (na + nb)")
    link = F.expr(f"100 * common >= {percent} * (na + nb - common)")

    def side(rows: DataFrame, x: str) -> list:
        return [F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("most").alias(f"m{x}"), F.col("label").alias(f"l{x}")]

    checked = links = labels = None
    for step in range(ROUNDS + 1):
        if labels is None:
            rows = posts.withColumn("label", F.col("id"))
        else:
            rows = materialize(posts.join(labels, posts["id"] == labels["v"], "left").select(*posts.columns, F.coalesce("label", "id").alias("label")), "posts")
        # the hub of a meeting point: a set with little of its own, another one each round
        order = F.struct(((F.col("n") - F.col("most")) / F.lit(3 * step + 1)).cast("long"), F.xxhash64("id", F.lit(step)))
        mixed = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min_by(F.struct(*side(rows, "a")), order).alias("hub")).where("lo <> hi").select("key", "hub.*")
        if step < ROUNDS:
            # stored by itself, so that the join reads its sides as they come and a common key can be split
            mixed = materialize(mixed, "hubs")
            met = mixed.join(rows.select(F.col("key").alias("key2"), *side(rows, "b")), (F.col("key") == F.col("key2")) & possible)
            swap = F.col("a") > F.col("b")
            pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(swap, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(swap, F.col("na")).otherwise(F.col("nb")).alias("nb"))
        else:
            left = materialize(rows.join(mixed.select("key"), "key", "left_semi").select("id", "n", "most", "label").distinct(), "members")
            pairs = prefix_pairs(sets, left, percent, possible)
        pairs = pairs.distinct()
        if checked is not None:
            pairs = pairs.join(checked, ["a", "b"], "left_anti")
        found = materialize(overlaps(pairs, sets), "overlaps")
        checked = found.select("a", "b") if checked is None else checked.union(found.select("a", "b"))
        new = found.where(link).select("a", "b")
        links = new if links is None else links.union(new)
        if labels is None or not new.isEmpty():
            labels = connected(links)

    grouped = classes.join(labels, classes["id"] == labels["v"], "left")
    linked = grouped.where("label is not null").groupBy("label").agg(F.min("first").alias("least"))
    reps = grouped.where("copies > 1 or label is not null").join(linked, "label", "left")
    reps = reps.select("cls", "cls2", "n", F.coalesce("least", "first").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = described.withColumn("salt", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(SALTS)).cast("int"))
    return salted.join(reps, ["cls", "cls2", "n", "salt"], "left").select("doc_id", "tie", "n", "rep")


def components(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    found = assigned(docs, k, percent)
    own = F.when(F.col("rep").isNotNull(), F.col("rep.doc_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows, all columns, with one row of each component: that of the smallest doc_id
    (rows without one come last; of one doc_id's texts, the smallest hash). Decisions are
    by row, not by doc_id. Of rows equal in doc_id and text one stays, any of them where
    further columns differ. Rows without words stay, repeated or not."""
    found = materialize(assigned(docs.select("doc_id", "text"), k, percent).where("n > 0"), "decisions")
    mine = "tie"
    while mine in (c.lower() for c in docs.columns):
        mine += "_"
    rows = docs.withColumn(mine, tie())
    same = lambda some: rows["doc_id"].cast("long").eqNullSafe(some["doc_id"]) & (rows[mine] == some["tie"])
    stays = F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("tie") == F.col("rep.tie"))
    gone = materialize(found.where(F.col("rep").isNotNull() & ~stays).select("doc_id", "tie").distinct(), "gone")
    repeated = found.where(F.col("rep").isNotNull() & stays).groupBy("doc_id", "tie").agg(F.count("*").alias("n")).where("n > 1")
    repeated = materialize(repeated.select("doc_id", "tie"), "repeated")
    gone, repeated = broadcast_if_small(gone, 48), broadcast_if_small(repeated, 48)
    kept = rows.join(gone, same(gone), "left_anti")
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    one = rows.join(repeated, same(repeated), "left_semi").dropDuplicates(["doc_id", mine])
    return kept.join(repeated, same(repeated), "left_anti").unionByName(one).select(*docs.columns)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') AS gram FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc, reach) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc, e.b FROM r JOIN e ON r.reach = e.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(min(r.reach), w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN r ON r.doc = w.doc_id GROUP BY w.doc_id, n.n
"""
