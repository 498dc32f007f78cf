"""Language identification: averaged hashed subword embeddings with a linear softmax.

A word's subwords are itself and its character n-grams with edge marks, hashed into buckets. A text is the average of
its subwords' embeddings; a linear layer and a softmax give languages. Training is stochastic gradient descent in
numpy on a bounded sample of labelled rows. A temperature is calibrated on a part of the sample held back, and with
it a score below which a prediction is rejected. Subwords of many words are hashed at once, over one array of code points.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import char_ranges, held, text_rows, with_fields

BUCKETS, DIMENSION = 1 << 16, 16
#: Lengths of character n-grams.
GRAMS = (2, 3, 4)
#: Most labelled rows that training sees of one language (expected; rows are picked by hash of their id), and longest text of such a row.
SAMPLE, SAMPLE_CHARS = 600, 20_000
#: Most languages that a model learns: the most frequent ones. A parameter of sample().
LANGUAGES = 200
#: Share of right predictions above the rejection score.
PRECISION = 0.99
#: Longer texts are read in pieces of so many words.
LONG, PIECE = 1 << 20, 50_000
#: Numbers that a worker's table of words holds: 32 MB, whatever the number of languages.
NUMBERS = 4_000_000
_U = np.uint64


class Letters:
    """Words of a text in small letters: runs of Unicode letters and the marks on them."""

    ASCII = re.compile(r"[a-z]+")
    PLAIN = re.compile(r"[^\W\d_]+")

    def __init__(self) -> None:
        #: what PLAIN takes for letters and isn't, and marks, at which it would part a word
        self.odd = re.compile(f"[{char_ranges(lambda c: unicodedata.category(c) in ('No', 'Nl') or unicodedata.category(c)[0] == 'M')}]")
        self.exact = None

    def pattern(self, small: str) -> re.Pattern:
        if small.isascii():
            return self.ASCII
        if not self.odd.search(small):
            return self.PLAIN
        if self.exact is None:
            letter, mark = (char_ranges(lambda c, k=k: unicodedata.category(c)[0] == k) for k in "LM")
            self.exact = re.compile(f"[{letter}][{letter}{mark}]*")
        return self.exact

    def pieces(self, text: str) -> Iterator[list[str]]:
        small = text.lower()
        found = self.pattern(small)
        if len(small) <= LONG:
            yield found.findall(small)
            return
        each = (m[0] for m in found.finditer(small))
        while some := list(islice(each, PIECE)):
            yield some


def letters() -> Letters:
    if not _LETTERS:
        _LETTERS.append(Letters())
    return _LETTERS[0]


_LETTERS: list[Letters] = []


def _mixed(h: np.ndarray) -> np.ndarray:
    """Bucket of a hash: splitmix64's finaliser, upper bits."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return (h >> _U(40)).astype(np.int64) & (BUCKETS - 1)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, number of its word) of all subwords: <word> itself, and its n-grams that aren't longer than it.

    An n-gram is hashed as a polynomial of its code points and its length, a whole word likewise with length zero.
    """
    marked = "".join(f"<{w}>" for w in words)
    c = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U) + _U(1)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    starts = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(words)), sizes)
    with np.errstate(over="ignore"):
        base = _U(0x9E3779B97F4A7C15)
        power = np.ones(int(sizes.max(initial=1)), _U)
        power[1:] = base
        power = np.cumprod(power)
        whole = np.add.reduceat(c * power[np.arange(len(c)) - starts[of]], starts) if len(words) else c
        buckets, owners = [_mixed(whole)], [np.arange(len(words))]
        h = c.copy()
        for n in range(2, max(GRAMS) + 1):
            h = h[:-1] + c[n - 1 :] * power[n - 1] if len(power) >= n else h[:0]
            if n in GRAMS:
                inside = of[: len(h)] == of[n - 1 : n - 1 + len(h)]
                buckets.append(_mixed(h[inside] ^ _U(n * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF)))
                owners.append(of[: len(h)][inside])
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # (BUCKETS, languages): embeddings times the linear layer, which is the same for an average
    bias: np.ndarray
    temperature: float = 1.0
    reject: float = 0.0
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def predict(self, word_sums: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of subword logits and numbers of subwords -> (language number, score)."""
        z = (word_sums / np.maximum(n, 1)[:, None] + self.bias) / self.temperature
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        return p.argmax(axis=1), p.max(axis=1)


class WordSums(dict):
    """word -> row of its subwords' summed logits and, last, their number. New words are numbered as they are met and
    their rows made at once; emptied when large."""

    def __init__(self, model: Model, numbers: int = NUMBERS) -> None:
        super().__init__()
        self.model = model
        most = max(64, numbers // (len(model.languages) + 1))
        self.piece = min(PIECE, most // 8)
        self.most = most - 2 * self.piece
        self.table = np.zeros((most, len(model.languages) + 1))
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        i = self[word] = len(self)
        self.new.append(word)
        return i

    def rows(self, words: list[str]) -> np.ndarray:
        """Numbers of at most two pieces of words."""
        if len(self) > self.most:
            self.clear()
        got = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            first = len(self) - len(self.new)
            for lo in range(0, len(self.new), 20_000):
                some = self.new[lo : lo + 20_000]
                buckets, of = subwords(some)
                part = self.table[first + lo : first + lo + len(some)]
                for k in range(part.shape[1] - 1):
                    part[:, k] = np.bincount(of, self.model.logits[buckets, k], len(some))
                part[:, -1] = np.bincount(of, minlength=len(some))
            self.new = []
        return got

    def of(self, texts: list[str]) -> np.ndarray:
        """A row of sums for each text, over the whole text; words of several texts are looked up together."""
        total = np.zeros((len(texts), self.table.shape[1]))
        held_: list[tuple[int, list[str]]] = []
        size = 0

        def flush() -> None:
            nonlocal held_, size
            if size:
                rows = self.rows(list(chain.from_iterable(w for _, w in held_)))
                lens = np.fromiter((len(w) for _, w in held_), np.int64, len(held_))
                total_of = np.add.reduceat(self.table[rows], np.cumsum(lens) - lens, axis=0)
                np.add.at(total, [i for i, _ in held_], total_of)
            held_, size = [], 0

        find = letters().pieces
        for i, text in enumerate(texts):
            for words in find(text):
                for at in range(0, len(words), self.piece):
                    some = words[at : at + self.piece]
                    held_.append((i, some))
                    size += len(some)
                    if size > self.piece:
                        flush()
        flush()
        return total


def _features(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """(buckets, counts) of a training text, packed; None without a letter."""
    words: Counter = Counter()
    for some in letters().pieces(text):
        words.update(some)
    if not words:
        return None
    buckets, of = subwords(list(words))
    n = np.fromiter(words.values(), np.float64, len(words))
    ids, at = np.unique(buckets, return_inverse=True)
    return ids.astype(np.int32), np.bincount(at, weights=n[of]).astype(np.float32)


def train(rows: list[tuple[str, str]], epochs: int = 4, rate: float = 0.5, seed: int = 1) -> Model | None:
    """(text, language) -> model; None without any row. Every tenth row is held back for calibration. Rows are put in an
    order of their own first, so the model doesn't hang on how they came."""
    rows = [(ids, lang) for text, lang in sorted(rows, key=lambda r: (r[1], r[0])) if (ids := _features(text)) is not None]
    if not rows:
        return None
    langs = sorted({x for _, x in rows})
    number = {x: i for i, x in enumerate(langs)}
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1, 1, (BUCKETS, DIMENSION)) / DIMENSION
    out, bias = np.zeros((DIMENSION, len(langs))), np.zeros(len(langs))
    order = rng.permutation(len(rows))
    held_back = [rows[i] for i in order[::10]] if len(rows) >= 50 else rows
    fitted = [rows[i] for k, i in enumerate(order) if k % 10] if len(rows) >= 50 else rows
    packed = [ids for ids, _ in fitted]
    steps, total = 0, epochs * len(fitted)
    for _ in range(epochs):
        for i in rng.permutation(len(fitted)):
            ids, n = packed[i]
            share = (n / n.sum())[:, None]
            x = (emb[ids] * share).sum(axis=0)
            z = x @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[number[fitted[i][1]]] -= 1
            lr = rate * (1 - steps / total)
            grad = out @ p
            out -= lr * np.outer(x, p)
            bias -= 0.1 * lr * p
            emb[ids] -= lr * 20 * share * grad  # a row's share is small; its step is scaled up alike for all rows
            steps += 1
    model = Model(langs, emb @ out, bias)
    sums = np.array([count @ model.logits[ids] for (ids, count), _ in held_back])
    n = np.array([count.sum() for (_, count), _ in held_back])
    want = np.array([number[x] for _, x in held_back])
    loss = []
    for t in np.geomspace(0.05, 5, 25):  # the temperature of the least log loss
        z = (sums / n[:, None] + bias) / t
        z -= z.max(axis=1, keepdims=True)
        loss.append((-(z[np.arange(len(z)), want] - np.log(np.exp(z).sum(axis=1))).mean(), t))
    model.temperature = min(loss)[1]
    got, score = model.predict(sums, n)
    ranked = np.argsort(-score, kind="stable")
    right = np.cumsum((got == want)[ranked]) / np.arange(1, len(ranked) + 1)
    enough = np.flatnonzero(right >= PRECISION)
    model.reject = float(score[ranked[enough[-1]]]) if len(enough) else 1.0
    return model


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, most: int = SAMPLE, languages: int = LANGUAGES) -> list[tuple[str, str]]:
    """At most about `most` labelled rows, with whole texts of up to SAMPLE_CHARS characters, of each of the `languages`
    most frequent languages, picked by hash of the id; rows of one id are picked together, in the order of their hash and
    text, so the same table gives the same rows however it is dealt."""
    rows = docs.where(F.col(lang_col).isNotNull() & (F.length(text_col) <= SAMPLE_CHARS))
    n = {r[0]: r[1] for r in rows.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(languages).collect()}
    if not n:
        return []
    h = F.xxhash64(F.col(id_col).cast("string"), F.lit("sample"))
    part = F.pmod(h, F.lit(1 << 20)) / float(1 << 20)
    keep = F.create_map(*(F.lit(x) for k, v in n.items() for x in (k, most / v)))
    some = rows.where(part < F.coalesce(F.try_element_at(keep, F.col(lang_col)), F.lit(0.0)))
    return [(r[0], r[1]) for r in some.select(text_col, F.col(lang_col).cast("string").alias("__lang"), h.alias("__h")).orderBy("__h", text_col, "__lang").limit(2 * most * len(n)).collect()]


def predict(docs: DataFrame, model: Model | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep, lang_pred, score, rejected for every row, from the text alone and all of it.

    A null text, or one without a Unicode letter, is "und" with score 0, and so is any text without a model. Of languages
    that tie the first by name is given. rejected: the score is below the calibrated one. Repeated rows and null ids are
    predicted each for itself; an empty table gives no row.
    """
    rows = text_rows(docs, text_col, *keep)
    schema = with_fields(rows.select(*keep), "lang_pred string, score double, rejected boolean")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers: bounded by parameters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        words = held(("langid", m.name), lambda: WordSums(m)) if m else None
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                if m:
                    sums = words.of(b.column("__text").to_pylist())
                    got, score = m.predict(sums[:, :-1], sums[:, -1])
                    some = sums[:, -1] > 0
                    lang = [m.languages[i] if ok else "und" for i, ok in zip(got, some)]
                    score = np.where(some, score, 0.0)
                    reject = (score < m.reject) | ~some
                else:
                    lang, score, reject = ["und"] * b.num_rows, np.zeros(b.num_rows), np.ones(b.num_rows, bool)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(reject)], [f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)


def op10(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row. A null doc_id is not held out; labels are read of rows
    that aren't held out, and for training only. Cases: see predict() and sample()."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    rows = docs.select("doc_id", "text", "lang", held_out.alias("held_out"))
    model = train(sample(rows.where("not held_out"), "doc_id", "text", "lang"))
    return predict(rows, model, ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score", "rejected")
