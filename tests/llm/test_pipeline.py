"""The pipeline's stages on small tables with nulls, repeated rows and clashing names, and the whole of it by brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratiform.llm import secrets
from stratiform.llm.files import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, hits long, tie long, hash long, key long, ids long"
WORDS = {
    "en": "the of and people water house government read about morning with coffee there is river stone light under tree".split(),
    "de": "der die und das nicht wasser haus regierung lesen über morgen mit kaffee es gibt fluss stein licht unter baum".split(),
}
KEY = "q7Xw9ZpL2mVt8RbK4nYc6HdJ1sFg"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Clean texts, and among them one of each kind that a stage must deal with."""
    rng = random.Random(11)
    text = lambda lang, n: " ".join(rng.choice(WORDS[lang]) for _ in range(n))
    item = " ".join(f"bench{i}" for i in range(12)) + " " + text("en", 8)
    rows = [(i, text(lang, 60), lang) for i, lang in enumerate(["en", "de"] * 60)]
    long = text("en", 200)
    rows += [
        (1000, rows[0][1], "en"),  # a copy
        (1001, rows[1][1].rsplit(" ", 1)[0] + " zug", "de"),  # a near copy
        (1002, long + " " + item + " " + text("en", 200), "en"),  # holds a benchmark item
        (1003, item, "en"),  # is one
        (1004, text("en", 40) + f" token = {KEY} " + text("en", 40), "en"),
        (1005, None, "en"), (1006, "", None), (1007, "1234 !!", "en"),
        (1008, "Съешь ещё этих мягких французских булок да выпей чаю, пока за окном идёт дождь", None),
        (None, text("en", 50), "en"), (None, text("de", 50), None),
        (1009, text("en", 50), "en"),
    ]
    rows.append(rows[-1])  # a repeated row
    rows.append((1009, text("de", 50), "de"))  # another text of the same id
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(*r, "s", len(r[1] or ""), 1, 2, 3, 4, 5) for r in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, item


def test_stages(spark, tables):
    folder, rows, item = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, folder)
        if name != "bpe_encoding":
            assert docs.schema == before.schema
            assert docs.select("hits", "tie", "hash", "key", "ids").distinct().collect() == [(1, 2, 3, 4, 5)]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen[name] = [(r.doc_id, r.text if "text" in r else r.ids) for r in docs.collect()]
    ids = {name: [d for d, _ in kept] for name, kept in seen.items()}
    every = [d for d, _, _ in rows]
    gone = {1005, 1006, 1007, 1008}
    assert sorted(map(str, ids["language_id"])) == sorted(str(d) for d in every if d not in gone)
    gone |= {1000, 1001}
    kept = [d for d in every if d not in gone]
    kept.remove(1009)
    assert sorted(map(str, ids["ngram_jaccard_join"])) == sorted(map(str, kept))
    kept.remove(1003)
    assert sorted(map(str, ids["benchmark_decontamination"])) == sorted(map(str, kept))
    texts = dict(seen["benchmark_decontamination"])
    assert "bench" not in texts[1002] and len(texts[1002].split()) >= 380
    clean = {d: t for d, t, _ in rows if d is not None and d < 1000}
    assert {d: t for d, t in seen["secret_scan"] if d in clean} == {d: clean[d] for d in ids["secret_scan"] if d in clean} and set(clean) <= set(ids["secret_scan"])
    assert KEY not in dict(seen["secret_scan"])[1004]
    assert all(t == secrets.redact(t, secrets.base_spans(t)) for _, t in seen["secret_scan"])


def test_run_ends_in_the_librarys_ids(spark, tables):
    from tokenizers import Tokenizer

    folder, rows, _ = tables
    out = corpus_pipeline.run(spark, folder).collect()
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    clean = {d: t for d, t, _ in rows if d is not None and d < 1000}
    got = {r.doc_id: r.ids for r in out if r.doc_id in clean}
    assert got == {d: library.encode(t, add_special_tokens=False).ids for d, t in clean.items()}
    assert all(r.n_tokens == len(r.ids) for r in out)
    assert len(out) == len(rows) - 4 - 2 - 1 - 1


def test_empty_tables_and_fewer_columns(spark, tables, tmp_path):
    folder, rows, item = tables
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("text", "doc_id", "lang")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs, folder).columns == docs.columns
    found = corpus_pipeline.benchmark_decontamination(spark, docs, str(tmp_path))
    assert found.count() == docs.count()
    assert re.search("bench3", item) and found.where(F.col("text").contains("bench3")).count() == 2
