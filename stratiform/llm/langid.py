"""Language identification with segmentation-marginalised unigram models.

A language gives every piece of a fixed public vocabulary a probability. The likelihood of
a word is the sum over all its segmentations into pieces, by the forward algorithm; pieces
do not cross words, so a text's likelihood is the product over its words. Words are whole
runs of letters, of any length, with the vocabulary's word mark before them; text and
vocabulary are read without case. Pieces with other characters than letters and a leading
mark cannot occur in a word; every other piece is used, whatever its length. Characters that
neither the vocabulary nor the sample has get a small fixed probability.

Probabilities are learned by expectation maximisation over a sample of labelled documents
that is bounded by the parameters sample_docs (documents a language, in expectation),
sample_chars (characters of a document used; longer ones only where a language has no
others, and then their first words) and most_languages (languages by number of documents);
words of more than TRAIN_LETTERS letters are not learned from. Everything else covers every
row and whole texts.

The score is the posterior of the best language by the text's mean word, so mixed or
ambiguous text scores low however long it is.

Cases: a null text and a text without a letter are `und` with score 0; so is every text
when nothing labelled can be learned from; a null doc_id is never learned from and counts
as held out; ties go to the first language in order; repeated rows stay rows of their own;
further columns are ignored by `predict` and passed through by `accept`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import ship_package
from .files import distribute_object, held, load_object, tokenizer_path
from .textops import Numbering, heads, lanes, portions, word_hashes

MARK = "▁"
FLOOR = 1e-7
TRAIN_LETTERS = 32
#: Longer words are scored one by one.
ONE_BY_ONE = 256
U = np.uint64
MULT, SLOT = U(0xD1342543DE82EF95), U(0x9E3779B97F4A7C15)
BITS = 20


def _hash(cp: np.ndarray) -> np.ndarray:
    return (cp.astype(U) + U(0x1F3)) * U(0xA24BAED4963EE407)


class Pieces:
    """The vocabulary as an open-addressing table over rolling hashes of code points."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        key = np.zeros(len(pieces), U)
        for i, p in enumerate(pieces):
            h = U(0)
            with np.errstate(over="ignore"):
                for c in _hash(np.frombuffer(p.encode("utf-32-le"), np.uint32)):
                    h = h * MULT + c
            key[i] = h
        self.key = np.zeros(1 << BITS, U)
        self.id = np.full(1 << BITS, -1, np.int32)
        self.probes = 1
        for i, k in enumerate(key.tolist()):
            slot, n = (k * int(SLOT) & (1 << 64) - 1) >> 64 - BITS, 1
            while self.id[slot] >= 0:
                slot, n = (slot + 1) % (1 << BITS), n + 1
            self.key[slot], self.id[slot] = k, i
            self.probes = max(self.probes, n)

    def find(self, h: np.ndarray) -> np.ndarray:
        slot = (h * SLOT >> U(64 - BITS)).astype(np.int64)
        got = self.id[slot]
        out = np.where((got >= 0) & (self.key[slot] == h), got, -1)
        todo = np.flatnonzero((got >= 0) & (out < 0))
        for _ in range(self.probes - 1):
            if not len(todo):
                break
            slot[todo] = (slot[todo] + 1) % (1 << BITS)
            got = self.id[slot[todo]]
            same = (got >= 0) & (self.key[slot[todo]] == h[todo])
            out[todo[same]] = got[same]
            todo = todo[(got >= 0) & ~same]
        return out

    def lattice(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the words with their marks, their starts in one array of code points, and
        the piece that begins at each place by length (-1: none)."""
        size = np.array([len(w) + 1 for w in words], np.int64)
        cp = np.frombuffer("".join([MARK + w for w in words]).encode("utf-32-le"), np.uint32)
        begin = np.cumsum(size) - size
        left = np.repeat(begin + size, size) - np.arange(len(cp))
        c = _hash(cp)
        h, at = c.copy(), np.full((min(self.longest, int(size.max(initial=1))), len(cp)), -1, np.int32)
        fits = np.arange(len(cp))
        for n in range(1, len(at) + 1):
            if n > 1:
                fits = fits[left[fits] >= n]
                h[fits] = h[fits] * MULT + c[fits + n - 1]
            at[n - 1][fits] = self.find(h[fits])
        return size, begin, at


class Model:
    """p has one row a piece and one column a language, and a last row for uncovered characters."""

    def __init__(self, languages: list[str], table: Pieces, p: np.ndarray):
        self.languages, self.table, self.p = languages, table, p
        #: by language: what texts of it score in it by `typical`, its variance a letter within a text, and between texts
        self.levels: dict[str, tuple[float, float, float]] = {}


def word_logs(model: Model, words: list[str]) -> np.ndarray:
    """Log-likelihood of every word (rows) in every language, all segmentations summed."""
    out = np.empty((len(words), len(model.languages)))
    order = sorted(range(len(words)), key=lambda i: -len(words[i]))
    long = next((k for k, i in enumerate(order) if len(words[i]) <= ONE_BY_ONE), len(order))
    for i in order[:long]:
        out[i] = _long_log(model, words[i])
    for lo in range(long, len(order), 10_000):
        part = order[lo : lo + 10_000]
        out[part] = _forward(model, [words[i] for i in part])
    return out


def _forward(model: Model, words: list[str]) -> np.ndarray:
    """The forward algorithm over words of falling length. What lies behind the longest piece
    is forgotten, and likelihoods are brought back to 1 as they shrink, so length has no bound."""
    size, begin, at = model.table.lattice(words)
    p, unknown = model.p, len(model.p) - 1
    depth = len(at) + 1
    ring = np.zeros((depth, len(words), p.shape[1]))
    ring[0] = 1.0
    shift = np.zeros(ring.shape[1:])
    out = np.empty(ring.shape[1:])
    sizes = -size
    m = len(words)
    for t in range(1, int(size.max(initial=0)) + 1):
        here = ring[t % depth]
        here[:m] = 0.0
        for n in range(1, min(len(at), t) + 1):
            piece = at[n - 1][begin[:m] + t - n]
            if n == 1:
                here[:m] += ring[(t - 1) % depth][:m] * p[np.where(piece < 0, unknown, piece)]
                continue
            w = np.flatnonzero(piece >= 0)
            here[w] += ring[(t - n) % depth][w] * p[piece[w]]
        left = int(np.searchsorted(sizes, -t, "left"))  # words of more than t places
        out[left:m] = np.log(here[left:m]) + shift[left:m]
        m = left
        if t % 8 == 0 and m:
            top = ring[:, :m].max(0)
            ring[:, :m] /= top
            shift[:m] += np.log(top)
    return out


def _long_log(model: Model, word: str) -> np.ndarray:
    """The same for one long word, all lengths of a place at once."""
    _, _, at = model.table.lattice([word])
    first = np.where(at[0] < 0, len(model.p) - 1, at[0])
    p = np.vstack([model.p, np.zeros((1, model.p.shape[1]))])  # place -1: no piece
    n, depth = at.shape[1], len(at)
    alpha = np.zeros((depth, model.p.shape[1]))  # of the places before, the nearest first
    alpha[0] = 1.0
    shift, reach = np.zeros(model.p.shape[1]), np.arange(1, depth)
    for t in range(1, n + 1):
        back = t - 1 - reach
        ids = np.concatenate([first[t - 1 : t], np.where(back >= 0, at[reach, back], -1)])
        new = (alpha * p[ids]).sum(0)
        alpha[1:] = alpha[:-1]
        alpha[0] = new
        if t % 8 == 0:
            top = alpha.max(0)
            alpha /= top
            shift += np.log(top)
    return np.log(alpha[0]) + shift


def expected_counts(size, begin, at, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in the words, words weighted by their counts in each language."""
    K, unknown, longest = p.shape[1], len(p) - 1, len(at)
    row = begin + np.arange(len(size))
    alpha = np.zeros((int(size.sum()) + len(size), K))
    alpha[row] = 1.0
    beta = np.zeros_like(alpha)
    beta[row + size] = 1.0
    piece_at = lambda n, place: np.where(at[0][place] < 0, unknown, at[0][place]) if n == 1 else at[n - 1][place]
    for t in range(1, int(size.max(initial=0)) + 1):
        live = np.flatnonzero(size >= t)
        for n in range(1, min(longest, t) + 1):
            piece = piece_at(n, begin[live] + t - n)
            w, ids = live[piece >= 0], piece[piece >= 0]
            alpha[row[w] + t] += alpha[row[w] + t - n] * p[ids]
    scale = weight / np.maximum(alpha[row + size], 1e-300)
    out = np.zeros_like(p)
    for left in range(1, int(size.max(initial=0)) + 1):
        live = np.flatnonzero(size >= left)
        place = begin[live] + size[live] - left
        for n in range(1, min(longest, left) + 1):
            piece = piece_at(n, place)
            ok = piece >= 0
            w, pos, ids = live[ok], place[ok], piece[ok]
            here = row[w] + (pos - begin[w])
            tail = p[ids] * beta[here + n]
            beta[here] += tail
            gain = alpha[here] * tail * scale[w]
            for k in range(K):
                out[:, k] += np.bincount(ids, gain[:, k], minlength=len(p))
    return out


split_words = regex.compile(r"\p{L}+").findall


def vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece file that are letters with or without the word mark before them, in lower case."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {sp.id_to_piece(i).lower(): None for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    return [p for p in found if regex.fullmatch(rf"{MARK}\p{{L}}*|\p{{L}}+", p)]


def fit(texts: list[tuple[str, str]], vocab: list[str], iterations: int = 3, smooth: float = 0.05) -> Model | None:
    """Learn from (language, text) pairs; the characters of the sample are pieces too."""
    languages = sorted({lang for lang, _ in texts})
    counts = {lang: Counter() for lang in languages}
    for lang, text in texts:
        counts[lang].update(split_words(text.lower()))
    words = sorted({w for c in counts.values() for w in c if len(w) <= TRAIN_LETTERS})
    if not words:
        return None
    have = set(vocab)
    pieces = vocab + sorted({c for w in words for c in w + MARK} - have)
    table = Pieces(pieces)
    weight = np.array([[counts[lang][w] for lang in languages] for w in words], float)
    p = np.array([[10.0 ** -min(len(x), 9)] * len(languages) for x in pieces] + [[FLOOR] * len(languages)])
    p /= p.sum(0)
    for _ in range(iterations):
        out = np.zeros_like(p)
        for lo in range(0, len(words), 10_000):
            out += expected_counts(*table.lattice(words[lo : lo + 10_000]), p, weight[lo : lo + 10_000])
        p = out + smooth
        p /= p.sum(0)
        p[-1] = FLOOR
    return Model(languages, table, p)


def typical(logs: np.ndarray, size: np.ndarray) -> float:
    """Log-likelihood a letter of the word in the middle, words weighted by their letters: pieces of keys and links among the words do not move it."""
    rate = logs / size
    order = np.argsort(rate)
    return float(rate[order[np.searchsorted(np.cumsum(size[order]), size.sum() / 2)]])


def levels(texts: list[tuple[str, str]], vocab: list[str]) -> dict[str, tuple[float, float, float]]:
    """What texts of each language score in it (see Model.levels). Each half of the texts is
    judged by a model of the other half; a language's only text by a model of itself."""
    by: dict[str, list[str]] = {}
    for lang, text in texts:
        by.setdefault(lang, []).append(text)
    seen: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for half in (0, 1):
        model = fit([(lang, t) for lang, own in by.items() for t in (own[1 - half :: 2] or own)], vocab)
        if model:
            table = WordLogs(model)
            for k, lang in enumerate(model.languages):
                for logs, size, _ in table.of(by[lang][half::2]):
                    if len(size):
                        seen.setdefault(lang, []).append((logs[:, k], size))
    out = {}
    for lang, own in seen.items():
        size = np.array([n.sum() for _, n in own])
        rate = np.array([typical(*x) for x in own])
        mean = np.median(rate)
        within = sum(((logs - mean * n) ** 2).sum() for logs, n in own) / size.sum()
        out[lang] = float(mean), float(within), float(max(0.0, ((rate - mean) ** 2 - within / size).mean()))
    return out


def evidence(size: np.ndarray, number: np.ndarray) -> int:
    """Letters of the distinct words of a text: a repeated word tells nothing new."""
    _, at = np.unique(number, return_index=True)
    return int(size[at].sum())


#: Distinct words whose likelihoods a worker keeps.
CACHE = 200_000
#: Standard deviations below a language's level at which a text is no longer taken for it.
WIDE = 8.0
LETTER = np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


class Runs:
    """The letter runs of texts joined by a character that is no letter, as code points."""

    def __init__(self, texts: list[str]):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.cp = cp = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
        inside = np.zeros(len(cp) + 2, bool)
        inside[1:-1] = LETTER[cp]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.begin, self.end = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.begin, np.concatenate([[0], np.cumsum(sizes + 1)]))
        # as bytes, for the table of words
        self.data = cp.view(np.uint8)
        self.starts, self.ends = self.begin * 4, self.end * 4
        self.size = self.ends - self.starts
        self.lanes = lanes(self.data)
        self.head = heads(self.lanes, self.starts, self.size)
        self.hashes = word_hashes(self.data, self.starts, self.ends)
        self.hashes[self.hashes == 0] = U(1)

    def raw(self, at: np.ndarray) -> list[bytes]:
        return [self.data[a:b].tobytes() for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist(), strict=True)]


class WordLogs:
    """Likelihoods of the words of texts; those of common words are kept."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.numbering, self.logs = Numbering(), np.empty((1 << 14, len(self.model.languages)))

    def _learn(self, raw: list[bytes]) -> None:
        n = self.numbering.n - len(raw)
        while self.numbering.n > len(self.logs):
            self.logs = np.concatenate([self.logs, np.empty_like(self.logs)])
        self.logs[n : self.numbering.n] = word_logs(self.model, [x.decode("utf-32-le") for x in raw])

    def of(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For every text its words' log-likelihoods (a column a language), letters, and numbers that tell words apart."""
        if self.numbering.n > CACHE:
            self.clear()
        runs = Runs([t.lower() if t else "" for t in texts])
        logs, size = self.logs, runs.end - runs.begin
        number = size
        if len(size):
            number = self.numbering.number(runs, self._learn)
            logs = self.logs[number]
        for a, b in zip(runs.first[:-1].tolist(), runs.first[1:].tolist(), strict=True):
            yield logs[a:b], size[a:b], number[a:b]


def judge(table: WordLogs | None, texts: list[str | None]) -> Iterator[tuple[str, float, bool]]:
    """Language, score, and whether the text is as likely in it as texts of that language are."""
    if table is None:
        yield from (("und", 0.0, False) for _ in texts)
        return
    model = table.model
    for logs, size, number in table.of(texts):
        if not len(size):
            yield "und", 0.0, False
            continue
        total = logs.sum(0)
        k = int(np.argmax(total))
        x = np.exp((total - total[k]) / len(size))
        likely = True
        if model.levels:
            mean, within, between = model.levels.get(model.languages[k], (-np.inf, 0.0, 0.0))
            likely = bool(typical(logs[:, k], size) >= mean - WIDE * np.sqrt(between + within / evidence(size, number)))
        yield model.languages[k], float(1 / x.sum()), likely


def classify(model: Model | None, texts: list[str | None]) -> Iterator[tuple[str, float]]:
    return ((lang, score) for lang, score, _ in judge(model and WordLogs(model), texts))


def _table(name: str) -> WordLogs | None:
    return held(("langid", name), lambda: (model := load_object(name)) and WordLogs(model))


def held_out() -> Column:
    """True where crc32 of the id as text leaves 2 on division by 4; a null id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(True))


def train(docs: DataFrame, vocab_path: str, sample_docs: int = 400, sample_chars: int = 20_000, most_languages: int = 200, with_levels: bool = False) -> Model | None:
    """Learn from documents that are not held out and have a language; with_levels: also the levels that `accept` needs."""
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    short = F.length("text") <= sample_chars
    sizes = rows.groupBy("lang").agg(F.sum(F.when(short, 1).otherwise(0)).alias("short"), F.count("*").alias("n"))
    sizes = sizes.orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    if not sizes:
        return None
    # a language without short documents learns from the beginnings of its long ones
    plan = [(r.lang, r.short == 0, min(1.0, sample_docs / (r.short or r.n))) for r in sizes]
    among = F.create_map(*[F.lit(x) for lang, long, _ in plan for x in (lang, long)])
    share = F.create_map(*[F.lit(x) for lang, _, part in plan for x in (lang, part)])
    pick = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000
    sample = rows.where(pick & (short | among[F.col("lang")])).select("lang", F.substring("text", 1, sample_chars))
    texts = [(r[0], r[1]) for r in sample.limit(2 * sample_docs * len(sizes)).collect()]
    vocab = vocabulary(vocab_path)
    model = fit(texts, vocab)
    if model and with_levels:
        model.levels = levels(texts, vocab)
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    spark = docs.sparkSession
    ship_package(spark)
    name = distribute_object(spark, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(name)
        for batch in batches:
            for part in portions(batch, 2):
                lang, score, _ = zip(*judge(table, part.column(2).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def accept(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """The rows, all columns, whose language is recognised: not `und`, score at least `least`
    (by the mean word the language is likelier than all others together), and a typical
    log-likelihood a letter not far below what the sample's texts have in that language. The
    score is a share among the learned languages and says nothing about other ones. A
    model without levels is refused. In a text of a few letters hardly anything is far below."""
    if model and not model.levels:
        raise ValueError("the model has no levels")
    spark = docs.sparkSession
    ship_package(spark)
    name = distribute_object(spark, model)

    @F.arrow_udf("boolean")
    def recognised(texts: pa.Array) -> pa.Array:
        table, keep = _table(name), []
        for part in portions(pa.record_batch([texts], ["text"]), 0):
            keep += [lang != "und" and score >= least and likely for lang, score, likely in judge(table, part.column(0).to_pylist())]
        return pa.array(keep, pa.bool_())

    # only the text goes to Python and only the answer comes back
    return docs.where(recognised("text"))


def op10_langid(spark: SparkSession, sf_dir: str, vocab: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, train(docs, vocab or tokenizer_path("piece_bpe_32k.model")))
