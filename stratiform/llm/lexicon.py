"""Minimal acyclic transducer over frequent words with their token ids as output.

Words in byte order become a minimal automaton (states with equal right languages are
one state, so suffixes are shared). Every arc carries the number of words that sort
before those behind it; the sum along an accepting path is the word's number, which
selects its ids. The arrays are written to one file that workers memory-map.
"""

from __future__ import annotations

import json
import mmap
import struct

import numpy as np

MAGIC = b"LEX1"
MAX_WORD = 48


def build(words: list[bytes]) -> dict[str, np.ndarray]:
    """Arrays of the automaton of sorted distinct words (Daciuk's incremental minimisation)."""
    register: dict[tuple, int] = {}
    frozen: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    class Node:
        __slots__ = ("arcs", "final")

        def __init__(self):
            self.final, self.arcs = False, []

    def freeze(node: Node) -> int:
        key = (node.final, tuple(node.arcs))
        if (i := register.get(key)) is None:
            i = register[key] = len(frozen)
            frozen.append(key)
        return i

    path, prev = [Node()], b""
    for word in words:
        common = 0
        while common < min(len(word), len(prev)) and word[common] == prev[common]:
            common += 1
        while len(path) - 1 > common:
            child = freeze(path.pop())
            path[-1].arcs.append((prev[len(path) - 1], child))
        for _ in word[common:]:
            path.append(Node())
        path[-1].final = True
        prev = word
    while len(path) > 1:
        child = freeze(path.pop())
        path[-1].arcs.append((prev[len(path) - 1], child))
    root = freeze(path[0])
    reach = np.zeros(len(frozen), np.int64)
    keys, target, skip = [], [], []
    for i, (final, arcs) in enumerate(frozen):  # children are frozen before their parents
        n = int(final)
        for label, child in arcs:
            keys.append(i << 8 | label)
            target.append(child)
            skip.append(n)
            n += int(reach[child])
        reach[i] = n
    return {"keys": np.array(keys, np.int64), "target": np.array(target, np.int32), "skip": np.array(skip, np.int32), "final": np.array([f for f, _ in frozen], np.uint8), "root": np.array([root], np.int32)}


def save(path: str, arrays: dict[str, np.ndarray], meta: dict) -> None:
    """One file: a JSON head with each array's place, then the arrays, 8-byte aligned."""
    place, at, body = {}, 0, []
    for name, a in arrays.items():
        raw = a.tobytes()
        place[name] = (a.dtype.str, len(a), at)
        body.append(raw + bytes(-len(raw) % 8))
        at += len(body[-1])
    head = json.dumps({"place": place, "meta": meta}).encode()
    head += b" " * (-(len(head) + 8) % 8)
    with open(path, "wb") as f:
        f.write(MAGIC + struct.pack("<I", len(head)) + head + b"".join(body))


class Lexicon:
    """The memory-mapped arrays; `lookup` walks many words at once."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        if self.map[:4] != MAGIC:
            raise ValueError("not a lexicon")
        (n,) = struct.unpack_from("<I", self.map, 4)
        head = json.loads(self.map[8 : 8 + n])
        self.meta = head["meta"]
        self.arrays = {k: np.frombuffer(self.map, t, c, 8 + n + at) for k, (t, c, at) in head["place"].items()}

    def lookup(self, words: list[bytes]) -> np.ndarray:
        """Number of each word, or -1."""
        a = self.arrays
        out = np.full(len(words), -1, np.int64)
        if not words or not len(a["keys"]):
            return out
        size = np.array([len(w) for w in words])
        live = np.flatnonzero((size > 0) & (size <= MAX_WORD))
        buf = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(size) - size
        state = np.full(len(words), a["root"][0], np.int64)
        total = np.zeros(len(words), np.int64)
        step = 0
        while len(live):
            key = state[live] << 8 | buf[begin[live] + step]
            at = np.minimum(np.searchsorted(a["keys"], key), len(a["keys"]) - 1)
            hit = a["keys"][at] == key
            live, at = live[hit], at[hit]
            state[live] = a["target"][at]
            total[live] += a["skip"][at]
            step += 1
            done = size[live] == step
            end = live[done]
            end = end[a["final"][state[end]] == 1]
            out[end] = total[end]
            live = live[~done]
        return out

    def ids(self, number: int) -> np.ndarray:
        b = self.arrays["out_begin"]
        return self.arrays["out_ids"][b[number] : b[number + 1]]
