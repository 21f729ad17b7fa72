"""Token ids in Re-Pair compressed shards with random-access decoding.

A shard holds whole documents. Adjacent id pairs are counted exactly; the most frequent ones
are replaced by nonterminals, again and again, until none occurs `least` times. A pair never
crosses a document's end, so each document expands on its own. The shard stores the rules,
the expansion length of every rule, and for each document its first symbol: document k is
decoded from its own symbols, which `ShardFile` reads by a seek, and token j of it is found
by summing expansion lengths and going down one path of the rules.

Cases: null text is an empty text (its ids are the end id alone); an empty table writes
no shard and returns no row; repeated doc_ids and repeated rows are kept as rows of their
own, ordered by doc_id (null first, kept null) and then by the text's hash; rows equal in
both go to one task, which writes shards of bounded size one after the other; further columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ship_package
from .files import distribute, held, local_path, tokenizer_path
from .store import filesystem, fresh_dir, materialize, read_bytes, write_atomic
from .textops import SLICE, PieceIds, slices

MAGIC = b"RPR2"
#: Pairs that occur at least 1/SPREAD times as often as the most frequent one are replaced in one pass.
SPREAD = 32
#: Bits of the table of counts that tells pairs that are rare for sure.
SLOTS = 19
#: Expansions up to this many tokens are written out when a whole shard is decoded.
FLAT = 256
U = np.uint64


def _pair_counts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    every = np.sort(key)
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    return every[first], np.diff(np.append(first, len(every)))


def _places(key: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose pair is chosen, and which one it is. Chosen pairs stand in rising order of
    frequency; of two that share a slot of the table the more frequent is found, the other waits."""
    bits = max(16, len(chosen).bit_length() + 3)
    slot_of = lambda k: (k * U(0x9E3779B97F4A7C15) >> U(64 - bits)).astype(np.int32)
    slot = slot_of(chosen)
    table, rank = np.full(1 << bits, U(0xFFFFFFFFFFFFFFFF)), np.zeros(1 << bits, np.int32)
    rank[slot] = np.arange(len(chosen), dtype=np.int32)
    table[slot] = chosen[rank[slot]]
    slot = slot_of(key)
    where = np.flatnonzero(table[slot] == key)
    return where, rank[slot[where]]


def compress(ids: np.ndarray, ends: np.ndarray, least: int = 8):
    """(symbols, ends of the documents in them, rules, expansion lengths of the rules, first nonterminal).

    ids: all documents' ids; ends: index after the last id of each document, which has one id at least.
    """
    base = int(ids.max(initial=0)) + 1
    seq = ids.astype(np.uint32)
    last = np.zeros(len(seq), bool)
    last[ends[ends > 0] - 1] = True
    live = ~last  # places whose pair may still be frequent: a pair that is rare once stays so
    rules, length = [np.zeros((0, 2), np.uint32)], np.zeros(0, np.uint32)
    while True:
        inside = np.flatnonzero(live)
        key = (seq[inside].astype(U) << U(32)) | seq[inside + 1]
        # a pair is rare if all pairs of its slot together are
        slot = (key * U(0x9E3779B97F4A7C15) >> U(64 - SLOTS)).astype(np.int32)
        some = np.flatnonzero((np.bincount(slot, minlength=1 << SLOTS) >= least)[slot])
        if not len(some):
            break
        rare = np.ones(len(inside), bool)
        rare[some] = False
        live[inside[rare]] = False
        inside, key = inside[some], key[some]
        pair, count = _pair_counts(key)
        chosen = np.flatnonzero(count >= max(least, int(count.max()) // SPREAD))
        if not len(chosen):
            break
        chosen = chosen[np.argsort(count[chosen], kind="stable")]
        pair = pair[chosen]
        at, rank = _places(key, pair)
        where = inside[at]
        # of overlapping occurrences of one pair every second one is taken, from the left
        same = (np.diff(where, prepend=-2) == 1) & (np.diff(rank, prepend=-1) == 0)
        if same.any():
            begin = np.flatnonzero(~same)
            odd = (np.arange(len(where)) - np.repeat(begin, np.diff(np.append(begin, len(where))))) % 2 == 1
            where, rank = where[~odd], rank[~odd]
        # of overlapping occurrences of two pairs the more frequent pair's
        near = np.diff(where) == 1
        lose = np.zeros(len(where), bool)
        lose[1:] |= near & (rank[:-1] > rank[1:])
        lose[:-1] |= near & (rank[1:] > rank[:-1])
        where, rank = where[~lose], rank[~lose]
        # a pair that lost most of its occurrences waits; the most frequent one never does
        good = np.bincount(rank, minlength=len(pair)) * 2 >= least
        where, rank = where[good[rank]], rank[good[rank]]
        number = np.cumsum(good) - 1 + base + len(length)
        a, b = (pair[good] >> U(32)).astype(np.int64), (pair[good] & U(0xFFFFFFFF)).astype(np.int64)
        every = np.concatenate([np.ones(base, np.uint32), length])
        rules.append(np.stack([a, b], 1).astype(np.uint32))
        length = np.concatenate([length, every[a] + every[b]])
        seq[where] = number[rank]
        last[where] = last[where + 1]
        live[where] = ~last[where]
        before = where[where > 0] - 1
        live[before] = ~last[before]
        keep = np.ones(len(seq), bool)
        keep[where + 1] = False
        seq, last, live = seq[keep], last[keep], live[keep]
    return seq, np.flatnonzero(last) + 1, np.concatenate(rules), length, base


class Grammar:
    """Rules with their expansion lengths; symbols below base stand for themselves."""

    def __init__(self, rules: np.ndarray, length: np.ndarray, base: int):
        self.rules, self.base = rules, base
        self.length = np.concatenate([np.ones(base, np.int64), length.astype(np.int64)])

    def _unfold(self, symbols: np.ndarray, longest: int) -> np.ndarray:
        """Symbols of longer expansions replaced by their pairs until none is left."""
        symbols = symbols.astype(np.int64)
        while len(deep := np.flatnonzero(self.length[symbols] > longest)):
            size = np.ones(len(symbols), np.int64)
            size[deep] = 2
            at = np.cumsum(size) - size
            out = np.empty(len(symbols) + len(deep), np.int64)
            out[at] = symbols
            pairs = self.rules[symbols[deep] - self.base]
            out[at[deep]], out[at[deep] + 1] = pairs[:, 0], pairs[:, 1]
            symbols = out
        return symbols

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        return self._unfold(symbols, 1).astype(np.uint32)

    def expand_many(self, symbols: np.ndarray) -> np.ndarray:
        """The same for a whole shard: short expansions are written out once and copied."""
        short = np.flatnonzero(self.length <= FLAT)
        flat = self._unfold(short, 1)
        begin = np.zeros(len(self.length), np.int64)
        begin[short] = np.cumsum(self.length[short]) - self.length[short]
        symbols = self._unfold(symbols, FLAT)
        size = self.length[symbols]
        total = np.cumsum(size)
        return flat[np.repeat(begin[symbols] - total + size, size) + np.arange(total[-1] if len(total) else 0)].astype(np.uint32)

    def token(self, symbols: np.ndarray, j: int) -> int:
        """Token j of what the symbols stand for, down one path of the rules."""
        ends = np.cumsum(self.length[symbols])
        i = int(np.searchsorted(ends, j, "right"))
        j -= int(ends[i - 1]) if i else 0
        s = int(symbols[i])
        while s >= self.base:
            a, b = self.rules[s - self.base].tolist()
            s, j = (a, j) if j < self.length[a] else (b, j - int(self.length[a]))
        return s


def pack(doc_ids: np.ndarray, known: np.ndarray, ids: np.ndarray, ends: np.ndarray, start: int) -> list[bytes]:
    """The bytes of a shard; known: false where a doc_id is null; start: ids of this partition before it."""
    symbols, stops, rules, length, base = compress(ids, ends)
    width = 4 if len(rules) + base > 0xFFFF else 2
    head = {"docs": len(doc_ids), "symbols": len(symbols), "rules": len(rules), "base": base, "start": start, "width": width}
    text = json.dumps(head).encode()
    parts = [np.packbits(known), doc_ids.astype("<i8"), stops.astype("<i8"), rules.astype("<u4"), length.astype("<u4"), symbols.astype(f"<u{width}")]
    return [MAGIC, struct.pack("<I", len(text)), text, *(x.tobytes() for x in parts)]


class ShardFile:
    """Random access to a shard: reads the list of documents and the rules once, and of the
    symbols only those of the document that is asked for."""

    def __init__(self, file):
        self.file = file
        magic, n = struct.unpack("<4sI", file.read(8))
        if magic != MAGIC:
            raise ValueError("not a Re-Pair shard")
        self.head = h = json.loads(file.read(n))
        take = lambda kind, count: np.frombuffer(file.read(np.dtype(kind).itemsize * count), kind)
        self.known = np.unpackbits(take("u1", -(-h["docs"] // 8)), count=h["docs"]).astype(bool)
        self.doc_ids, self.stops = take("<i8", h["docs"]), take("<i8", h["docs"])
        rules = take("<u4", 2 * h["rules"]).reshape(-1, 2)
        self.grammar = Grammar(rules, take("<u4", h["rules"]), h["base"])
        self.kind, self.begin = f"<u{h['width']}", file.tell()

    def symbols(self, k: int) -> np.ndarray:
        """The symbols of document k."""
        first, size = (int(self.stops[k - 1]) if k else 0), np.dtype(self.kind).itemsize
        self.file.seek(self.begin + first * size)
        return np.frombuffer(self.file.read((int(self.stops[k]) - first) * size), self.kind)

    def ids(self, k: int) -> np.ndarray:
        return self.grammar.expand(self.symbols(k))

    def token(self, k: int, j: int) -> int:
        return self.grammar.token(self.symbols(k), j)

    def find(self, doc_id: int | None) -> list[int]:
        """The documents of that id."""
        return np.flatnonzero((self.doc_ids == doc_id) & self.known if doc_id is not None else ~self.known).tolist()

    def all_ids(self) -> tuple[np.ndarray, np.ndarray]:
        """All documents' ids, one after another, and how many each has (by the stored lengths)."""
        self.file.seek(self.begin)
        symbols = np.frombuffer(self.file.read(), self.kind, self.head["symbols"])
        total = np.concatenate([[0], np.cumsum(self.grammar.length[symbols])])
        return self.grammar.expand_many(symbols), np.diff(total[self.stops], prepend=0)


def read_document(manifest: DataFrame, doc_id: int) -> list[np.ndarray]:
    """The ids of the documents of that id, read by seeks."""
    found = []
    for row in manifest.where((F.col("first") <= doc_id) & (F.col("last") >= doc_id)).orderBy("part", "seq").collect():
        fs, path = filesystem(row.path)
        with fs.open_input_file(path) as f:
            shard = ShardFile(f)
            found += [shard.ids(k) for k in shard.find(doc_id)]
    return found


def library_encoder(path: str):
    """A function from pieces of UTF-8 text to their ids, one after another, and their numbers of ids.

    No token of this tokenizer spans white space, so pieces can be encoded alone. Pieces of
    letters that every Unicode version treats alike are one word each: many go to the library
    as one text, and the ids that end a word tell them apart.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    last = np.zeros(t.get_vocab_size(), bool)
    last[[i for token, i in t.get_vocab().items() if token.endswith("</w>")]] = True

    def learn(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [p.decode() for p in pieces]
        sizes = np.zeros(len(texts), np.int64)
        simple = np.array([x.isalpha() and (x.isascii() or max(x) < "\u0130") for x in texts], bool)
        found: list[np.ndarray] = []
        one, rest = np.flatnonzero(simple), np.flatnonzero(~simple)
        for lo in range(0, len(one), 2048):
            part = one[lo : lo + 2048]
            ids = np.array(t.encode(" ".join([texts[i] for i in part]), add_special_tokens=False).ids, np.uint32)
            stops = np.flatnonzero(last[ids]) + 1
            if len(stops) != len(part):
                raise ValueError("a word of letters was cut")
            sizes[part] = np.diff(stops, prepend=0)
            found.append(ids)
        for i in range(0, len(rest), 2048):
            part = rest[i : i + 2048]
            for k, e in zip(part.tolist(), t.encode_batch_fast([texts[j] for j in part], add_special_tokens=False), strict=True):
                sizes[k] = len(e.ids)
                found.append(np.array(e.ids, np.uint32))
        ids = np.concatenate(found) if found else np.zeros(0, np.uint32)
        order = np.concatenate([one, rest])
        if len(rest):  # back to the order of the pieces
            begin = np.zeros(len(texts), np.int64)
            begin[order] = np.cumsum(sizes[order]) - sizes[order]
            total = np.cumsum(sizes)
            ids = ids[np.repeat(begin - (total - sizes), sizes) + np.arange(len(ids))]
        return ids, sizes

    return learn


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 1, shard_tokens: int = 2_000_000) -> DataFrame:
    """Encode doc_id, text in ascending doc_id order into shards; returns the stored manifest
    (part, seq, path, first and last doc_id, start, n_docs, n_tokens), start counted within the part.

    The order is a range partitioning (equal ids are told apart by the text's hash, so one
    hot id is spread as far as its texts differ); each task writes its own shards.
    """
    spark = docs.sparkSession
    ship_package(spark)
    name, folder = distribute(spark, tokenizer), fresh_dir(spark, "repair")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    schema = "part long, seq int, path string, first long, last long, start long, n_docs long, n_tokens long"
    kinds = [pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder = held(("repair", name), lambda: PieceIds(library_encoder(local_path(name))))
        docs, known, parts, counts, size, start, out = [], [], [], [], 0, 0, []

        def flush() -> None:
            nonlocal docs, known, parts, counts, size, start
            ids, n, names, real = (np.concatenate(x) for x in (parts, counts, docs, known))
            path = f"{folder}/part-{part:06d}-{len(out):05d}.rpr"
            write_atomic(path, pack(names, real, ids, np.cumsum(n), start))
            some = names[real]
            out.append((part, len(out), path, int(some.min()) if len(some) else None, int(some.max()) if len(some) else None, start, len(n), len(ids)))
            start += len(ids)
            docs, known, parts, counts, size = [], [], [], [], 0

        for batch in batches:
            names, real = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for i, data, off in slices(batch.column(1), min(SLICE, 4 * shard_tokens)):
                ids, n = encoder.encode(data, off)
                parts.append(np.insert(ids, np.cumsum(n), np.uint32(end_id)))
                counts.append(n + 1)
                docs.append(names[i : i + len(n)])
                known.append(real[i : i + len(n)])
                size += len(parts[-1])
                if size >= shard_tokens:
                    flush()
        if size:
            flush()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["part", "seq", "path", "first", "last", "start", "n_docs", "n_tokens"])

    return materialize(rows.mapInArrow(run, schema), "repair-manifest")


def read_shards(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """One row per stored document: doc_id, start, n_tokens, ids_crc32, and its symbols in the shard.

    Offsets of the parts come from one small sum per part, not from the documents.
    """
    from pyspark.sql import Window

    ship_package(spark)
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("before"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    todo = manifest.join(parts, "part").select("path", (F.col("before") + F.col("start")).alias("offset")).repartition(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, offset in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = ShardFile(pa.BufferReader(read_bytes(path)))
                ids, counts = shard.all_ids()
                raw = memoryview(ids.astype("<u4").tobytes())
                at = np.concatenate([[0], np.cumsum(counts)])
                crc = [zlib.crc32(raw[a:b]) for a, b in zip((at[:-1] * 4).tolist(), (at[1:] * 4).tolist(), strict=True)]
                columns = [pa.array(shard.doc_ids, pa.int64(), mask=~shard.known), offset + at[:-1], counts, crc, np.diff(shard.stops, prepend=0)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32", "n_symbols"])

    return todo.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, n_symbols long")


def op2_repair(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_shards(spark, write_shards(docs, tokenizer or tokenizer_path("word_bpe_49k.json")))
