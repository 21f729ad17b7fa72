"""Documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but
the last return the columns of documents. `run` writes each stage's rows to shared storage
and reads them again for the next.

Cases: a null or empty text and one without a letter goes in the first stage; rows without a
doc_id take part like any others; repeated rows meet in the second stage, where one stays;
empty tables go through all stages; further columns, whatever their names, are carried
through the first four. `n_chars`, where documents have it, follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratiform.llm import bpe, decontaminate, langid, ngram_join, secrets
from stratiform.llm.files import tokenizer_path
from stratiform.llm.store import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is not recognised (see `langid.accept`)."""
    return langid.accept(docs, langid.train(docs, tokenizer_path("piece_bpe_32k.model"), with_levels=True))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of smallest id of each group of near-duplicates (five words, 0.8)."""
    return ngram_join.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out benchmark passages; documents that are half benchmark go."""
    out = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.withColumn("n_chars", F.char_length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark."""
    return secrets.redact_documents(docs, length_column="n_chars" if "n_chars" in docs.columns else None)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: doc_id, n_tokens, ids."""
    tokenizer = tokenizer_path("word_bpe_49k.json")
    encoded = bpe.encode_documents(docs, tokenizer, bpe.compile_lexicon(docs, tokenizer))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("bpe_encoding", bpe_encoding),
]

#: SQL cannot express language models, entropy spans and byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
