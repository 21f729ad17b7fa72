"""Vectorised text primitives over Arrow string columns, shared by the operators.

A batch is cut into slices of whole documents of about SLICE bytes; a longer document
is a slice of its own. Nulls are empty texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 19
U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits (finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first document, bytes, offsets) of consecutive slices of whole documents."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        kind = np.int32
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, off, data = texts.buffers()
    off = np.frombuffer(off, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_bounds(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each document the index of its first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    m = is_word[data]
    before = np.zeros(n, bool)
    before[1:] = m[:-1]
    after = np.zeros(n, bool)
    after[:-1] = m[1:]
    first = off[:-1][off[:-1] < n]
    before[first] = False
    after[first[first > 0] - 1] = False
    starts = np.flatnonzero(m & ~before)
    ends = np.flatnonzero(m & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


#: Longer words than this many bytes are hashed and compared one by one.
LONG = 64
_LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at every place of an array of bytes, as one number each; zeros follow the end."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.as_strided(padded[:8].view(U), (len(data) + 9,), (1,))


def heads(view: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first eight bytes of byte ranges, with zeros after shorter ones."""
    return view[starts] & _LANE[np.minimum(size, 8)]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, mixed eight bytes at a time (a bijection of the bytes for
    ranges of one length up to eight); of more than LONG bytes, a cryptographic hash."""
    size = ends - starts
    view = lanes(data)
    h = mix(size.astype(U) + U(0x9E3779B97F4A7C15))
    h = mix(h ^ (view[starts] & _LANE[np.minimum(size, 8)]))
    live = np.flatnonzero(size > 8)
    for j in range(8, LONG, 8):
        if not len(live):
            return h
        left = size[live] - j
        h[live] = mix(h[live] * U(0xD6E8FEB86659FD93) ^ (view[starts[live] + j] & _LANE[np.minimum(left, 8)]))
        live = live[left > 8]
    for i in live.tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """An ordered hash of several hashes."""
    out = np.full(len(parts[0]), U(len(parts)))
    for x in parts:
        out = mix(out * U(0xD6E8FEB86659FD93) + x)
    return out


NOT_SPACE = ~SPACE


def portions(batch: pa.RecordBatch, column: int, rows: int = 512, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most so many rows and, but for a longer row alone, bytes of text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    i, n = 0, batch.num_rows
    while i < n:
        before = ends[i - 1] if i else 0
        j = min(i + rows, max(i + 1, int(np.searchsorted(ends, before + size, "right"))))
        yield batch.slice(i, j - i)
        i = j


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(document index, sorted distinct hashes of its k-word shingles) for every document.

    Words are runs of non-white-space in the text with A-Z lower-cased. A document of
    fewer than k words has its whole word sequence as one shingle; one without words, none.
    """
    for i, data, off in slices(texts):
        data = LOWER[data]
        starts, ends, first = word_bounds(data, off, NOT_SPACE)
        h = word_hashes(data, starts, ends)
        grams = combine([h[j : len(h) - k + 1 + j] for j in range(k)]) if len(h) >= k else np.zeros(0, U)
        for d in range(len(off) - 1):
            a, b = first[d], first[d + 1]
            if b - a >= k:
                yield i + d, np.unique(grams[a : b - k + 1])
            elif b > a:
                yield i + d, combine([h[j : j + 1] for j in range(a, b)])
            else:
                yield i + d, np.zeros(0, U)


#: Byte classes for cutting text into pieces: white space, ASCII letters, ASCII marks but the apostrophe, the rest.
KIND = np.full(256, 3, np.uint8)
KIND[SPACE] = 0
KIND[65:91] = KIND[97:123] = 1
KIND[[c for c in range(33, 127) if not chr(c).isalnum() and c != 39]] = 2


def piece_bounds(data: np.ndarray, off: np.ndarray, cut_marks: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As word_bounds, over runs without ASCII white space; with cut_marks such runs are
    also cut between an ASCII letter and an ASCII mark (never at an apostrophe)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    kind = KIND[data]
    edge = np.ones(n + 1, bool)  # edge[i]: a boundary before byte i
    a, b = kind[:-1], kind[1:]
    edge[1:-1] = (a == 0) | (b == 0)
    if cut_marks:
        edge[1:-1] |= (a + b == 3) & (a != 0) & (b != 0)
    edge[off] = True
    word = kind != 0
    starts = np.flatnonzero(edge[:-1] & word)
    ends = np.flatnonzero(edge[1:] & word) + 1
    return starts, ends, np.searchsorted(starts, off)


class WordTable:
    """Open addressing from 64-bit hashes to numbers, a whole batch at a time."""

    def __init__(self, bits: int = 16):
        self.bits, self.n = bits, 0
        self.keys = np.zeros(1 << bits, U)
        self.number = np.zeros(1 << bits, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the hashes, or -1."""
        out = np.full(len(h), -1, np.int32)
        last = (1 << self.bits) - 1
        slot = (h >> U(64 - self.bits)).astype(np.int64)
        k = self.keys[slot]
        hit = k == h
        out[hit] = self.number[slot[hit]]
        todo = np.flatnonzero(~hit & (k != 0))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & last
            k = self.keys[slot]
            hit = k == h[todo]
            out[todo[hit]] = self.number[slot[hit]]
            more = ~hit & (k != 0)
            todo, slot = todo[more], slot[more]
        return out

    def put(self, h: np.ndarray, number: np.ndarray) -> None:
        """Distinct hashes, none of them 0 or in the table, and their numbers."""
        while (self.n + len(h)) * 2 > len(self.keys):
            old, num = self.keys, self.number
            self.bits += 2
            self.keys, self.number = np.zeros(1 << self.bits, U), np.zeros(1 << self.bits, np.int32)
            self._put(old[old != 0], num[old != 0])
        self._put(h, number)
        self.n += len(h)

    def _put(self, h: np.ndarray, number: np.ndarray) -> None:
        last = (1 << self.bits) - 1
        slot = (h >> U(64 - self.bits)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[todo[free]]
            won = self.keys[slot] == h[todo]
            self.number[slot[won]] = number[todo[won]]
            todo, slot = todo[~won], (slot[~won] + 1) & last


class Numbering:
    """Consecutive numbers of distinct pieces over many slices. A hit in the table of hashes
    counts only if the bytes are equal; pieces whose hash belongs to other bytes are kept apart."""

    def __init__(self):
        self.table, self.apart, self.n = WordTable(), {}, 0
        self.text, self.begin = np.zeros(1 << 16, np.uint8), np.zeros(1 << 12, np.int64)
        self.head, self.size = np.zeros(1 << 12, U), np.zeros(1 << 12, np.int32)

    def number(self, pieces: "Pieces", fresh) -> np.ndarray:
        """Each piece's number; fresh gets the bytes of new pieces, in the order of their numbers."""
        found = self._find(pieces, None)
        missing = np.flatnonzero(found == -1)
        if len(missing):
            _, at = np.unique(pieces.hashes[missing], return_index=True)
            new = missing[at]
            places = np.arange(self.n, self.n + len(new), dtype=np.int32)
            self._keep(raw := pieces.raw(new))
            self.table.put(pieces.hashes[new], places)
            fresh(raw)
            found[missing] = self._find(pieces, missing)
        for i in np.flatnonzero(found == -2).tolist():
            (piece,) = pieces.raw(np.array([i]))
            if piece not in self.apart:
                self.apart[piece] = self.n
                self._keep([piece])
                fresh([piece])
            found[i] = self.apart[piece]
        return found

    def _keep(self, raw: list[bytes]) -> None:
        sizes = np.array([len(x) for x in raw], np.int64)
        used = int(self.begin[self.n])
        while used + int(sizes.sum()) + 16 > len(self.text):
            self.text = np.concatenate([self.text, np.zeros_like(self.text)])
        while self.n + len(raw) + 1 > len(self.begin):
            self.begin, self.head, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.head, self.size))
        self.head[self.n : self.n + len(raw)] = np.frombuffer(b"".join([x[:8].ljust(8, b"\0") for x in raw]), U)
        self.size[self.n : self.n + len(raw)] = sizes
        self.text[used : used + int(sizes.sum())] = np.frombuffer(b"".join(raw), np.uint8)
        self.begin[self.n + 1 : self.n + 1 + len(raw)] = used + np.cumsum(sizes)
        self.n += len(raw)

    def _find(self, pieces: "Pieces", at: np.ndarray | None) -> np.ndarray:
        """Numbers of the pieces (all, or those at some places); -1 where the hash is not there, -2 where it belongs to other bytes."""
        of = lambda x: x if at is None else x[at]
        number = self.table.find(of(pieces.hashes))
        start, size = of(pieces.starts), of(pieces.size)
        k = np.maximum(number, 0)
        wrong = (number >= 0) & ((self.size[k] != size) | (self.head[k] != of(pieces.head)))
        live = np.flatnonzero((number >= 0) & ~wrong & (size > 8))
        # the place after the last byte and eight more are within the array
        kept = np.lib.stride_tricks.as_strided(self.text[:8].view(U), (len(self.text) - 7,), (1,))
        start, mine = start[live], self.begin[k[live]]
        left = size[live] - 8
        for j in range(8, LONG, 8):
            if not len(live):
                break
            bad = (pieces.lanes[start + j] ^ kept[mine + j]) & _LANE[np.minimum(left, 8)] != 0
            wrong[live[bad]] = True
            on = ~bad & (left > 8)
            live, start, mine, left = live[on], start[on], mine[on], left[on] - 8
        for i, a, b in zip(live.tolist(), start.tolist(), mine.tolist(), strict=True):
            wrong[i] = not np.array_equal(pieces.data[a : a + size[i]], self.text[b : b + size[i]])
        number[wrong] = -2
        return number


class PieceIds:
    """Ids of pieces of text; `learn` encodes the pieces that are new.

    `cut` cuts a slice of texts into pieces. At most `most` pieces are kept; the table
    starts anew beyond that.
    """

    def __init__(self, learn, most: int = 1_000_000, cut=None):
        self.learn, self.most, self.cut = learn, most, cut or Pieces
        self.reset()

    def reset(self) -> None:
        self.numbering = Numbering()
        self.begin, self.flat, self.used, self.n = np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32), 0, 0

    def _store(self, raw: list[bytes]) -> None:
        ids, sizes = self.learn(raw)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(sizes) + 1 > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin[self.n + 1 : self.n + 1 + len(sizes)] = self.used + np.cumsum(sizes)
        self.used += len(ids)
        self.n += len(sizes)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a slice of texts, and how many each document has."""
        if self.n > self.most:
            self.reset()
        pieces = self.cut(data, off)
        number = self.numbering.number(pieces, self._store)
        size = self.begin[number + 1] - self.begin[number]
        total = np.concatenate([[0], np.cumsum(size)])
        out = self.flat[np.repeat(self.begin[number] - total[:-1], size) + np.arange(total[-1])]
        return out, np.diff(total[pieces.first])


class Pieces:
    """The pieces of a slice of texts and their hashes. Letters are lower-cased and marks cut
    off unless an added token may be there, where case and marks matter."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        plain = b"<|" not in data.tobytes()
        self.data = LOWER[data] if plain else data
        self._index(*piece_bounds(self.data, off, plain))

    def _index(self, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> None:
        self.starts, self.ends, self.first = starts, ends, first
        self.size = ends - starts
        self.lanes = lanes(self.data)
        self.head = heads(self.lanes, starts, self.size)
        self.hashes = word_hashes(self.data, starts, ends)
        self.hashes[self.hashes == 0] = U(1)

    def raw(self, at: np.ndarray) -> list[bytes]:
        raw = memoryview(self.data)
        return [bytes(raw[a:b]) for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist(), strict=True)]


class Words(Pieces):
    """Words, A-Z lower-cased, instead of pieces."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data = LOWER[data]
        self._index(*word_bounds(self.data, off, NOT_SPACE))


class PieceCounts:
    """Counts of distinct pieces over many slices."""

    def __init__(self):
        self.numbering, self.pieces, self.count = Numbering(), [], np.zeros(1 << 16, np.int64)

    def add(self, data: np.ndarray, off: np.ndarray) -> None:
        n = np.bincount(self.numbering.number(Pieces(data, off), self.pieces.extend))
        while len(n) > len(self.count):
            self.count = np.concatenate([self.count, np.zeros_like(self.count)])
        self.count[: len(n)] += n
