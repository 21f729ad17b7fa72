"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other; the model of a category sees the text's
features and the probabilities of the categories before it. In training those are
out-of-fold predictions, so a model never sees an earlier model's answer on a row that
model was fitted to. Features are words and their first 4, 5 and 6 letters, hashed: that one
occurs at all, in certain numbers, and in certain shares of the text; each model keeps those whose counts in the two classes differ beyond
chance. Models are fitted on a bounded sample of labelled rows (parameter sample_rows, in
expectation). Features are counted by class and fold on the executors; the driver gets the counts of those
that may be chosen, at most MOST_CANDIDATES, and the rows' features among these. Predictions cover every row and whole texts.

Cases: a null or empty text has no features and gets the models' intercepts; without
labelled rows every probability is 0; a label that is null is left out of that category's
training (a category with one class only predicts its share); repeated label rows count
as rows; repeated documents stay rows of their own; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import ship_package
from .files import distribute_object, held, load_object
from .store import materialize
from .textops import PieceIds, Words, portions, slices

BITS = 20
EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")
WORDS_KEPT = 300_000
FOLDS = 3
MOST_FEATURES = 4000
#: Features that the driver fits on, at most: those of the greatest deviation from chance.
MOST_CANDIDATES = 40_000
#: Features that fewer texts of the sample have are left out.
RAREST = 3
#: Standard deviations between a feature's count in a class and what chance gives.
BEYOND_CHANCE = 4.0
#: Occurrences in a text, and occurrences in 1000 bytes, from which a key's further features hold.
COUNTS = (2, 4)
RATES = (0.5, 1.0, 2.0, 4.0)
LEVELS = 1 + len(COUNTS) + len(RATES)
#: Categories in the order of the chain: name and condition over the labels table's columns.
CHAIN = (("low_quality", "1 - quality"), ("toxic", "toxic"))


def keys(token: str) -> list[int]:
    """Hashed keys of a token: the word and its beginnings."""
    w = EDGE.sub("", token.lower())
    if not w:
        return []
    return sorted({zlib.crc32(k.encode()) & ((1 << BITS) - 1) for k in ["=" + w, *(w[:n] for n in (4, 5, 6) if len(w) >= n)]})


class Features:
    """Features of texts: key * LEVELS + level. With `kept`, keys are places in that sorted
    array, and others are left out."""

    def __init__(self, kept: np.ndarray | None = None):
        place = None if kept is None else {int(k): i for i, k in enumerate(kept)}

        def learn(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            found = [keys(w.decode("utf-8", "replace")) for w in words]
            if place is not None:
                found = [[place[k] for k in ks if k in place] for ks in found]
            return np.array([k for ks in found for k in ks], np.uint32), np.array([len(ks) for ks in found], np.int64)

        self.table = PieceIds(learn, WORDS_KEPT, Words)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Features of all texts, document by document, and how many each has."""
        out, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _, data, off in slices(texts):
            ids, n = self.table.encode(data, off)
            n_docs = len(off) - 1
            at, count = np.unique(np.repeat(np.arange(n_docs, dtype=np.int64), n) << 32 | ids, return_counts=True)
            doc, key = at >> 32, at & 0xFFFFFFFF
            rate = count * 1000 / np.diff(off)[doc]
            levels = np.column_stack([np.ones(len(at), bool), *(count >= c for c in COUNTS), *(rate >= r for r in RATES)])
            row, level = np.nonzero(levels)
            out.append(key[row] * LEVELS + level)
            sizes.append(np.bincount(doc[row], minlength=n_docs))
        return np.concatenate(out), np.concatenate(sizes)


class Linear:
    """Logistic regression on selected hashed features and a few dense ones."""

    def fit(self, at: np.ndarray, doc: np.ndarray, n_features: int, dense: np.ndarray, y: np.ndarray) -> "Linear":
        """at: features below n_features, doc: the row of each, y: the row's class, 0 or 1."""
        n1 = float(y.sum())
        share = n1 / max(len(y), 1)
        self.n_features = n_features
        self.ids = np.zeros(0, np.int64)
        self.w = np.zeros(0)
        self.dense = np.zeros(dense.shape[1])
        self.bias = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        if n1 == 0 or n1 == len(y):
            return self
        total = np.bincount(at, minlength=n_features)
        ones = np.bincount(at[y[doc] > 0], minlength=n_features)
        expect = total * share
        z = (ones - expect) / np.sqrt(expect * (1 - share) + 0.5)
        order = np.argsort(-np.abs(z))[:MOST_FEATURES]
        self.ids = np.sort(order[(np.abs(z[order]) > BEYOND_CHANCE) & (total[order] >= RAREST)])
        place = self._places()
        at = place[at]
        doc = doc[at >= 0]
        at = at[at >= 0]
        weight = np.where(y > 0, (1 - share) / share, 1.0) ** 0.5
        weight /= weight.sum()
        params = [np.zeros(len(self.ids)), self.dense, np.array([self.bias])]
        first = [np.zeros_like(p) for p in params]
        second = [np.zeros_like(p) for p in params]
        for step in range(1, 301):
            s = np.bincount(doc, params[0][at], minlength=len(y)) + dense @ params[1] + params[2][0]
            e = weight * (1 / (1 + np.exp(-np.clip(s, -30, 30))) - y)
            grads = [np.bincount(at, e[doc], minlength=len(self.ids)) + 1e-5 * params[0], dense.T @ e + 1e-4 * params[1], np.array([e.sum()])]
            for p, g, a, b in zip(params, grads, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= 0.1 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        self.w, self.dense, self.bias = params[0], params[1], float(params[2][0])
        return self

    def _places(self) -> np.ndarray:
        place = np.full(self.n_features, -1, np.int32)
        place[self.ids] = np.arange(len(self.ids))
        return place

    def predict(self, at: np.ndarray, doc: np.ndarray, dense: np.ndarray) -> np.ndarray:
        at = self._places()[at]
        s = np.bincount(doc[at >= 0], self.w[at[at >= 0]], minlength=len(dense)) + dense @ self.dense + self.bias
        return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def logit(p: np.ndarray) -> np.ndarray:
    return np.log((p + 1e-4) / (1 - p + 1e-4))


class Chain:
    """One model a category; earlier categories' log-odds are dense inputs of later ones."""

    def fit(self, at: np.ndarray, sizes: np.ndarray, labels: np.ndarray, folds: np.ndarray, common: np.ndarray) -> "Chain":
        """at, sizes: each text's features, as places in the sorted array common; labels: one
        column a category, NaN where unknown; folds: numbers below FOLDS."""
        n = len(sizes)
        doc = np.repeat(np.arange(n, dtype=np.int32), sizes)

        def rows_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            some = mask[doc]
            return at[some], (np.cumsum(mask, dtype=np.int32) - 1)[doc[some]]

        self.models: list[Linear] = []
        dense = np.zeros((n, 0))
        for c in range(labels.shape[1]):
            known = ~np.isnan(labels[:, c])

            def part(mask: np.ndarray) -> Linear:
                mask = mask & known
                return Linear().fit(*rows_of(mask), len(common), dense[mask], labels[mask, c])

            self.models.append(part(np.ones(n, bool)))
            out_of_fold = np.zeros(n)
            for f in range(FOLDS):
                mask = folds == f
                if mask.any():
                    out_of_fold[mask] = part(~mask).predict(*rows_of(mask), dense[mask])
            dense = np.column_stack([dense, logit(out_of_fold)])
        for m in self.models:
            m.ids = common[m.ids]
        ids = np.unique(np.concatenate([m.ids for m in self.models]))
        self.keep = np.unique(ids // LEVELS)
        self.weights = np.zeros((len(self.keep) * LEVELS, len(self.models)))
        for c, m in enumerate(self.models):
            self.weights[np.searchsorted(self.keep, m.ids // LEVELS) * LEVELS + m.ids % LEVELS, c] = m.w
        return self

    def scores(self, texts: pa.Array, features: Features) -> np.ndarray:
        """Probabilities along the chain, one row a text; features must be those of `keep`."""
        at, sizes = features.of(texts)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        out = np.zeros((len(sizes), len(self.models)))
        for c, m in enumerate(self.models):
            s = np.bincount(doc, self.weights[at, c], minlength=len(sizes)) + m.bias + logit(out[:, :c]) @ m.dense
            out[:, c] = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
        return out


def train(docs: DataFrame, labels: DataFrame, chain=CHAIN, sample_rows: int = 12_000) -> Chain | None:
    """Fit on labelled documents; the fold of a row is a hash of its doc_id."""
    spark = docs.sparkSession
    ship_package(spark)
    total = labels.count()
    if not total:
        return None
    share = min(1.0, sample_rows / total)
    picked = labels.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(1_000_000)) < F.lit(share * 1_000_000)).limit(2 * sample_rows)
    picked = picked.select("doc_id", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(6)), F.lit(FOLDS)).cast("int").alias("fold"), *[F.expr(f"cast({cond} as double)").alias(name) for name, cond in chain])
    names = [name for name, _ in chain]
    schema = "fold int, " + ", ".join(f"{n} double" for n in names) + ", ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Features()
        for batch in batches:
            for part in portions(batch, batch.num_columns - 1, 256):
                ids, sizes = found.of(part.column(batch.num_columns - 1))
                ids = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids], ["fold", *names, "ids"])

    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("fold", *names, "text").mapInArrow(run, schema)
    rows = materialize(rows, "labelled")
    kept = candidates(rows, names)
    if not kept:
        kept = [0]
    wanted = distribute_object(spark, np.array(kept, np.int64))

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = held(("candidates", wanted), lambda: load_object(wanted))
        for batch in batches:
            ids = batch.column(batch.num_columns - 1)
            flat = ids.flatten().to_numpy()
            place = np.minimum(np.searchsorted(keep, flat), len(keep) - 1)
            mine = keep[place] == flat
            total = np.concatenate([[0], np.cumsum(mine)])
            ends = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())])
            few = pa.ListArray.from_arrays(total[ends].astype(np.int32), pa.array(place[mine], pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], few], ["fold", *names, "ids"])

    rows = rows.mapInArrow(narrow, schema).toArrow()
    if not rows.num_rows:
        return None
    ids = rows.column("ids").combine_chunks()
    y = np.column_stack([rows.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names])
    return Chain().fit(ids.flatten().to_numpy(), ids.value_lengths().to_numpy(), y, rows.column("fold").to_numpy(), np.array(kept, np.int64))


def candidates(rows: DataFrame, names: list[str]) -> list[int]:
    """Features, in rising order, that are common enough and whose counts in the classes of some
    category differ beyond chance, over all rows or without one fold."""
    known = [F.sum(F.when(F.col(n).isNotNull() & (F.col("fold") == f), value).otherwise(0)).alias(f"{kind}_{n}_{f}") for n in names for f in range(FOLDS) for kind, value in (("n", F.lit(1.0)), ("p", (F.col(n) > 0).cast("double")))]
    sums = rows.agg(*known).first().asDict()
    counts = rows.select("fold", *names, F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n"), *known).where(F.col("n") >= RAREST)
    best = F.lit(0.0)
    for n in names:
        for out in (None, *range(FOLDS)):
            folds = [f for f in range(FOLDS) if f != out]
            size, ones = (sum(sums[f"{kind}_{n}_{f}"] or 0 for f in folds) for kind in "np")
            if not 0 < ones < size:
                continue
            share = ones / size
            total, seen = (sum((F.col(f"{kind}_{n}_{f}") for f in folds), F.lit(0.0)) for kind in "np")
            z = F.abs(seen - total * share) / F.sqrt(total * (share * (1 - share)) + 0.5)
            best = F.greatest(best, z)
    chosen = counts.select("id", best.alias("z")).where(F.col("z") > BEYOND_CHANCE).orderBy(F.desc("z"), "id").limit(MOST_CANDIDATES)
    return sorted(r[0] for r in chosen.select("id").collect())


def predict(docs: DataFrame, chain: Chain | None, names: tuple[str, ...] = tuple(n for n, _ in CHAIN)) -> DataFrame:
    """doc_id and p_<category> for every row."""
    spark = docs.sparkSession
    ship_package(spark)
    name = distribute_object(spark, chain)
    columns = [f"p_{n}" for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, found = held(("toxicity", name), lambda: (made := load_object(name), made and Features(made.keep)))
        for batch in batches:
            for part in portions(batch, 1, 256):
                p = chain.scores(part.column(1), found) if chain else np.zeros((part.num_rows, len(names)))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in p.T)], ["doc_id", *columns])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} double" for c in columns))


def is_toxic(threshold: float = 0.5) -> Column:
    return F.col("p_toxic") >= threshold


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chain = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return predict(docs, chain).withColumn("toxic", is_toxic())
