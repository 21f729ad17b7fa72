"""BPE encoding and decoding through a transducer lexicon of frequent words.

Text is normalised and cut into words as the tokenizer file states (NFC, white space,
lower case; the split pattern; added tokens first). Words that are frequent in the corpus
are in the lexicon with their ids; any other word is merged exactly, pair of lowest rank
first and leftmost of equals. Decoding joins the ids' token strings by one space, which is
what the file's missing decoder means.

Cases: null text is an empty text with no ids (the digests are those of empty strings);
an empty table gives no rows; repeated rows and repeated or null doc_ids stay rows of
their own; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ship_package
from .files import distribute, held, local_path, tokenizer_path
from .lexicon import MAX_WORD, Lexicon, build, save
from .store import materialize, scratch_dir
from .textops import PieceCounts, PieceIds, portions, slices

#: Characters below this are NFC-stable, lower-case one to one, and classed alike by every Unicode version.
PLAIN = "İ"
NONE = 1 << 62
#: Distinct pieces whose counts a task holds before it hands them on.
CACHE = 500_000


def byte_symbols() -> list[str]:
    """The visible character that byte-level vocabularies use for each byte."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return [chr(b) if b in keep else chr(256 + rest.index(b)) for b in range(256)]


class Merges:
    """The tokenizer file's vocabulary and merges, and exact merging of one word."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.spec = spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.tokens = [""] * (1 + max(max(vocab.values()), *(t["id"] for t in spec["added_tokens"])))
        for token, i in vocab.items():
            self.tokens[i] = token
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.added.items():
            self.tokens[i] = token
        end = model["end_of_word_suffix"]
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.final = [vocab[s + end] for s in symbols]
        self.pairs = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs.setdefault(vocab[a] << 17 | vocab[b], rank << 17 | vocab[a + b])
        self.pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]

    def word(self, word: bytes) -> list[int]:
        ids = [self.inner[b] for b in word[:-1]]
        ids.append(self.final[word[-1]])
        if len(ids) > 64:
            return self._long(ids)
        get = self.pairs.get
        while len(ids) > 1:
            found = [get(a << 17 | b, NONE) for a, b in zip(ids, ids[1:])]
            best = min(found)
            if best == NONE:
                break
            i = found.index(best)
            ids[i : i + 2] = [best & 0x1FFFF]
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list, for words of any length."""
        n = len(ids)
        right, left = [*range(1, n), -1], [-1, *range(n - 1)]
        heap: list[tuple[int, int, int, int]] = []

        def push(i: int) -> None:
            if i >= 0 and (j := right[i]) >= 0 and (m := self.pairs.get(ids[i] << 17 | ids[j])) is not None:
                heapq.heappush(heap, (m >> 17, i, ids[i], ids[j]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self.pairs[a << 17 | b] & 0x1FFFF, -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            right[j] = -1
            push(left[i])
            push(i)
        return [x for x in ids if x >= 0]


class Splitter:
    """Words of a piece of text without ASCII white space."""

    def __init__(self, merges: Merges):
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(json.dumps(merges.spec))
        self.normalize, self.pre = t.normalizer.normalize_str, t.pre_tokenizer.pre_tokenize_str
        self.added = merges.added
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in self.added) + ")") if self.added else None
        #: White space below PLAIN, written out, in place of \s
        self.find = regex.compile(merges.pattern.replace(r"\s", r"\x09-\x0D\x20\x85\xA0")).findall
        self.back = {s: b for b, s in enumerate(byte_symbols())}

    def words(self, piece: str) -> list[bytes | int]:
        """Words in UTF-8; an added token is its id."""
        if self.cut and "<|" in piece:
            out: list[bytes | int] = []
            for part in self.cut.split(piece):
                out += [self.added[part]] if part in self.added else self._plain(part) if part else []
            return out
        return self._plain(piece)

    def _plain(self, piece: str) -> list[bytes]:
        if piece.isascii() or max(piece) < PLAIN:
            return [w.encode() for w in self.find(piece.lower())]
        # the library's own normaliser and splitter where Unicode tables matter
        return [bytes(self.back[c] for c in word) for word, _ in self.pre(self.normalize(piece))]


class Encoder:
    """Encodes and decodes with a memory-mapped lexicon; keeps the ids of common pieces."""

    def __init__(self, tokenizer: str, lexicon: str):
        self.merges = Merges(tokenizer)
        self.splitter = Splitter(self.merges)
        self.lexicon = Lexicon(lexicon)
        self.ids = PieceIds(self.learn)
        self.decimal = [str(i) for i in range(len(self.merges.tokens))]

    def learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one after another, and each one's number of ids: words of the
        lexicon through the transducer, others by merging."""
        split = [self.splitter.words(p.decode()) for p in pieces]
        words = list({w for ws in split for w in ws if type(w) is bytes})
        begin, flat = self.lexicon.arrays["out_begin"], self.lexicon.arrays["out_ids"]
        ids = {}
        for w, k in zip(words, self.lexicon.lookup(words).tolist(), strict=True):
            ids[w] = flat[begin[k] : begin[k + 1]].tolist() if k >= 0 else self.merges.word(w)
        out = [ids[ws[0]] if len(ws) == 1 and type(ws[0]) is bytes else [i for w in ws for i in ((w,) if type(w) is int else ids[w])] for ws in split]
        return np.array([i for x in out for i in x], np.uint32), np.array([len(x) for x in out], np.int64)

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of every text of an Arrow column."""
        for _, data, off in slices(texts):
            ids, n = self.ids.encode(data, off)
            yield from np.split(ids, np.cumsum(n)[:-1])

    def decode(self, ids: list[int]) -> str:
        tokens = self.merges.tokens
        return " ".join([tokens[i] for i in ids])


def word_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(word, n) over every word of every text; tasks add up their own counts first."""
    ship_package(docs.sparkSession)
    name = distribute(docs.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, count = held(("splitter", name), lambda: Splitter(Merges(local_path(name)))), PieceCounts()

        def flush() -> pa.RecordBatch:
            nonlocal count
            words: Counter = Counter()
            for piece, n in zip(count.pieces, count.count.tolist(), strict=False):
                for w in splitter.words(piece.decode()):
                    if type(w) is bytes and len(w) <= MAX_WORD:
                        words[w] += n
            count = PieceCounts()
            return pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.binary()), pa.array(words.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for _, data, off in slices(batch.column(0)):
                count.add(data, off)
                if len(count.pieces) > CACHE:
                    yield flush()
        yield flush()

    texts = docs.where(F.col("text").isNotNull()).select("text")
    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(docs: DataFrame, tokenizer: str, max_words: int = 100_000) -> str:
    """Write the lexicon of the words that make up at least 1/max_words of all words each
    (so there are at most max_words, at any input size) to a driver-side file."""
    counts = materialize(word_counts(docs, tokenizer), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.where((F.col("n") >= 2) & (F.col("n") * max_words >= total)).select("word").collect()
    words = sorted(bytes(r[0]) for r in rows)
    merges = Merges(tokenizer)
    arrays = build(words)
    out = [merges.word(w) for w in words]
    arrays["out_begin"] = np.cumsum([0] + [len(x) for x in out])
    arrays["out_ids"] = np.array([i for x in out for i in x], np.int32)
    path = os.path.join(scratch_dir(), f"lexicon-{uuid.uuid4().hex}.lex")
    save(path, arrays, {"words": len(words), "of": int(total)})
    return path


def encode_documents(docs: DataFrame, tokenizer: str, lexicon: str, digests: bool = False) -> DataFrame:
    """doc_id and ids (array<int>), or the digests of ids and decoded text."""
    spark = docs.sparkSession
    ship_package(spark)
    names = distribute(spark, tokenizer), distribute(spark, lexicon)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = held(("bpe", *names), lambda: Encoder(*map(local_path, names)))
        for batch in batches:
            for part in portions(batch, 1, 256):
                if digests:
                    n, a, b = [], [], []
                    for ids in enc.encode(part.column(1)):
                        ids = ids.tolist()
                        n.append(len(ids))
                        a.append(hashlib.sha256(" ".join([enc.decimal[i] for i in ids]).encode()).hexdigest())
                        b.append(hashlib.sha256(enc.decode(ids).encode()).hexdigest())
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.astype(np.int32) for x in enc.encode(part.column(1))], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and text of doc_id, ids; a null id list gives a null text."""
    spark = encoded.sparkSession
    ship_package(spark)
    name = distribute(spark, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = held(("tokens", name), lambda: Merges(local_path(name)).tokens)
        for batch in batches:
            texts = [None if ids is None else " ".join([tokens[i] for i in ids]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op3_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tokenizer = tokenizer or tokenizer_path("word_bpe_49k.json")
    return encode_documents(docs, tokenizer, compile_lexicon(docs, tokenizer), digests=True)
