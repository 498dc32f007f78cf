"""Benchmark decontamination by template canonicalisation.

Words become template tokens: a word with a digit <NUM>, a unit <UNIT>, a capitalised word inside a sentence <NAME>,
any other word itself, folded and without punctuation. A capitalised word that starts a sentence may be either, so windows
come in two forms: with such words as they are, and with them as names. Windows of WINDOW template tokens are hashed;
windows of documents meet windows of benchmark items by an equality join on the hash. For a window that meets, the slots
are checked: between an item and a document one slot value must map to one slot value throughout, so that
"7 apples ... 7" may turn into "9 apples ... 9" and not into "9 ... 4".

Windows on one diagonal are one copy. Diagonals that lie close together are one copy with words put in or left out. An item
of fewer than WINDOW tokens is one window of its own length. An item without a window of enough literals (numbers alone, say)
is looked for word by word, without placeholders.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import cut, release, text_rows, with_fields

WINDOW = 8
#: Fewest tokens of an item; a shorter one says too little.
SHORTEST = 4
#: Least literal (not placeholder) tokens of a window; of a window shorter than WINDOW all but one, at most these.
LITERALS = 4
#: Least share of an item's windows that a document must hold consistently.
SHARE = 0.5
#: Neighbouring diagonals at most so far apart are one copy.
GAP = 4
#: Benchmarks of up to so many windows are sent to every task as sorted hashes (8 MB); larger ones are joined by shuffle.
SENT = 1_000_000
#: Benchmarks of up to so many windows are met in the tasks, with their slots (some 200 bytes each).
MET = 20_000
#: A window's rows are dealt over so many tasks where they are shuffled.
SALTS = 16
#: Words of a worker's table.
WORDS = 400_000
#: Units.
UNITS = frozenset("mm cm dm m km in ft yd mi inch inches foot feet yards miles metres meters mg g kg t lb lbs oz grams ml l litres liters s sec seconds min minutes h hours days weeks months years mph kmh kph hz khz mhz ghz w kw v kb mb gb tb usd eur gbp dollars euros pounds cents percent degrees".split())
NUM, NAME, UNIT = (np.uint64(xxhash.xxh64_intdigest(x, 3)) for x in ("<NUM>", "<NAME>", "<UNIT>"))
#: Forms of a window: sentence-initial words as they are, as names, and all words as they are.
PLAIN, NAMED, EXACT = range(3)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STRIP = re.compile(r"^\W+|\W+$")
_DIGIT = re.compile(r"\d")
_U = np.uint64


def bare(word: str) -> str:
    return _STRIP.sub("", word).casefold()


class Template(dict):
    """Word -> number of its row; rows hold the token's hash at a sentence's start and inside it, the word's own hash, whether
    it ends a sentence and whether it may be a name. Filled as words come, emptied when large."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes = np.zeros((WORDS + (1 << 18), 3), _U)
        self.flags = np.zeros((WORDS + (1 << 18), 2), bool)

    def __missing__(self, word: str) -> int:
        i = self[word] = len(self)
        b = bare(word)
        ends = word[-1] in ".!?:;\"')»”" and word.rstrip("\"')»”")[-1:] in (".", "!", "?", ":", ";", "")
        own = xxhash.xxh64_intdigest(b, 3) if b else 0
        if not b:
            first = inside = 0
        elif _DIGIT.search(b):
            first = inside = int(NUM)
        elif b in UNITS:
            first = inside = int(UNIT)
        else:
            first = inside = own
            if _STRIP.sub("", word)[:1].isupper() and not (word.isupper() and len(b) > 1):
                inside = int(NAME)
        self.hashes[i] = first, inside, own
        self.flags[i] = ends, inside == int(NAME)
        return i

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self) > WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


class Tokens:
    """Texts as one row of tokens: of each its text, its word, and its hash in each form. Words of punctuation are none."""

    def __init__(self, texts: list[str], known: Template) -> None:
        split = [t.split() for t in texts]
        self.words = list(chain.from_iterable(split))
        lens = np.fromiter(map(len, split), np.int64, len(split))
        hashes, flags = np.zeros((len(self.words), 3), _U), np.zeros((len(self.words), 2), bool)
        for at in range(0, len(self.words), 1 << 17):
            rows = known.rows(self.words[at : at + (1 << 17)])
            hashes[at : at + len(rows)], flags[at : at + len(rows)] = known.hashes[rows], known.flags[rows]
        starts = np.ones(len(self.words), bool)
        starts[1:] = flags[:-1, 0]
        starts[(np.cumsum(lens) - lens)[lens > 0]] = True
        plain = np.where(starts, hashes[:, 0], hashes[:, 1])
        self.word = np.flatnonzero(hashes[:, 2])  # offsets of words that are tokens
        self.text = np.repeat(np.arange(len(split)), lens)[self.word]
        named = np.where(starts & flags[:, 1], NAME, plain)
        self.forms = [x[self.word] for x in (plain, named, hashes[:, 2])]
        self.first = np.searchsorted(self.text, np.arange(len(split)))  # each text's first token

    def counts(self) -> np.ndarray:
        return np.bincount(self.text, minlength=len(self.first))

    def windows(self, size: int, form: int) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, hashes) of the windows that lie in one text and have enough literals."""
        t, n = self.forms[form], len(self.word) - size + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, _U)
        h = np.full(n, size * 4 + (form == EXACT), _U)
        for i in range(size):
            h *= _BASE
            h += t[i : i + n]
        ok = self.text[:n] == self.text[size - 1 :]
        if form != EXACT:
            slot = np.concatenate([[0], np.cumsum(self.is_slot(t))])
            ok &= size - (slot[size:] - slot[:-size]) >= min(LITERALS, size - 1)
        at = np.flatnonzero(ok)
        return at, (h ^ (h >> _U(29)))[at]

    @staticmethod
    def is_slot(t: np.ndarray) -> np.ndarray:
        return (t == NUM) | (t == NAME) | (t == UNIT)

    def slots(self, at: int, size: int, form: int) -> list[str]:
        """Values in the slots of a window: the word, folded, at placeholders, and empty at literals."""
        filled = self.is_slot(self.forms[form][at : at + size]) if form != EXACT else np.zeros(size, bool)
        return [bare(self.words[w]) if f else "" for w, f in zip(self.word[at : at + size], filled)]


#: (size, form) of windows.
Shape = tuple[int, int]


def _item_shapes(tokens: Tokens) -> list[list[tuple[int, int, int, int]]]:
    """For each text (offset, hash, size, form) of its windows as a benchmark item."""
    counts = tokens.counts()
    out: list[list] = [[] for _ in counts]
    for size in sorted({min(WINDOW, int(n)) for n in counts if n >= SHORTEST}):
        for form in (PLAIN, NAMED, EXACT):
            for at, h in zip(*tokens.windows(size, form)):
                i = tokens.text[at]
                if min(WINDOW, counts[i]) != size or form == EXACT and out[i] and out[i][0][3] != EXACT:
                    continue
                out[i].append((int(at), int(h), size, form))
    return out


def _windows(df: DataFrame, id_cols: list[str], text_col: str, shapes: list[Shape] | None, only: np.ndarray | None = None) -> DataFrame:
    """id columns, n (places of windows of the text), at, h, size, form, slots: one row for each window.

    shapes: those to make of documents; None: of benchmark items, each has its own. only: sorted hashes; windows with
    another hash are left out where they arise, before any shuffle.
    """
    rows = text_rows(df, text_col, *id_cols)
    schema = with_fields(rows.select(*id_cols), "n int, at int, h long, size int, form int, slots array<string>")
    sent = df.sparkSession.sparkContext.broadcast(only) if only is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        known = Template()
        want = sent.value if sent is not None else None
        for whole in batches:
            for b in _parts(whole):
                tokens = Tokens(b.column("__text").to_pylist(), known)
                found: list[tuple[int, int, int, int, int]] = []  # text, offset, hash, size, form
                n = np.zeros(b.num_rows, np.int64)
                if shapes is None:
                    for i, own in enumerate(_item_shapes(tokens)):
                        n[i] = len({x[0] for x in own})
                        found += [(i, *x) for x in own]
                else:
                    for size, form in shapes:
                        at, h = tokens.windows(size, form)
                        if form == NAMED:  # where it differs from the plain one
                            p = np.flatnonzero(tokens.forms[PLAIN] != tokens.forms[NAMED])
                            near = np.searchsorted(p, at + size) > np.searchsorted(p, at)
                            at, h = at[near], h[near]
                        if want is not None:
                            hit = want[np.minimum(np.searchsorted(want, h), len(want) - 1)] == h if len(want) else np.zeros(len(h), bool)
                            at, h = at[hit], h[hit]
                        found += zip(tokens.text[at].tolist(), at.tolist(), h.tolist(), [size] * len(at), [form] * len(at))
                t, at, h, size, form = (np.array(x, k) for x, k in zip(zip(*found) if found else [()] * 5, (np.int64, np.int64, _U, np.int32, np.int32)))
                slots = [tokens.slots(a, s, f) for _, a, _, s, f in found]
                take = pa.array(t)
                cols = [pa.array(n[t].astype(np.int32)), pa.array((at - tokens.first[t]).astype(np.int32)), pa.array(h.view(np.int64)), pa.array(size), pa.array(form), pa.array(slots, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in id_cols), *cols], [*id_cols, "n", "at", "h", "size", "form", "slots"])

    return rows.mapInArrow(run, schema)


def _parts(whole: pa.RecordBatch, rows: int = 512, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of at most `rows` rows and, but for a longer text, `size` bytes of text."""
    ends = np.cumsum([0, *(len(x.as_buffer()) for x in whole.column("__text"))])
    at = 0
    while at < whole.num_rows:
        end = max(at + 1, min(at + rows, int(np.searchsorted(ends, ends[at] + size, side="right")) - 1))
        yield whole.slice(at, end - at)
        at = end


def _joined(mine: DataFrame, items: DataFrame, n: int, met: int) -> DataFrame:
    """Equal windows. Items are sent to the tasks up to `met` of them, else both sides are dealt by hash and salt, so that a
    passage that a third of all documents hold lies in many tasks."""
    if n <= met:
        return mine.join(F.broadcast(items), "h")
    salted = items.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return mine.withColumn("__s", F.pmod(F.xxhash64(*(c for c in mine.columns if c.startswith("__i")), "at"), F.lit(SALTS)).cast("int")).join(salted, ["h", "__s"]).drop("__s")


def _with(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    """a's rows with b's other columns where cols are equal, nulls included; b has a row at most for each."""
    b = b.withColumnsRenamed({c: f"__r{c}" for c in cols})
    return a.join(b, reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"__r{c}")) for c in cols)), "left").drop(*(f"__r{c}" for c in cols))


def _consistent(met: DataFrame, by: list[str]) -> DataFrame:
    """by, matched, windows of the groups in which no slot value of the item has two counterparts."""
    pairs = met.select(*by, F.explode(F.arrays_zip("b_slots", "slots")).alias("p")).where("p.b_slots <> ''")
    values = pairs.groupBy(*by, F.col("p.b_slots").alias("x")).agg(F.min("p.slots").alias("lo"), F.max("p.slots").alias("hi"))
    clash = values.groupBy(*by).agg(F.max(F.col("lo") != F.col("hi")).alias("clash"))
    runs = met.groupBy(*by).agg(F.count_distinct("b_at").alias("matched"), F.max("windows").alias("windows"))
    return _with(runs, clash, by).where(~F.coalesce("clash", F.lit(False))).select(*by, "matched", "windows")


def matches(docs: DataFrame, benchmark: DataFrame, id_cols: list[str], item_col: str = "item_id", text_col: str = "text", sent: int = SENT, met: int = MET) -> DataFrame:
    """id columns, item_id, matched, windows, share: documents that hold a benchmark item's windows, slots consistent.

    Null texts and those shorter than an item match nothing; repeated documents match each for itself (rows of one id are
    one document); an item that is given twice under one id is one item; items with a null id or of fewer than SHORTEST
    tokens aren't looked for. An empty benchmark or table matches nothing. Columns not named aren't read.
    """
    own = _windows(benchmark.where(F.col(item_col).isNotNull()), [item_col], text_col, None)
    items = cut(own.withColumnsRenamed({item_col: "item_id", "n": "windows", "at": "b_at", "slots": "b_slots"}).dropDuplicates(["item_id", "b_at", "form"]))
    # a benchmark's windows grow with the benchmark only; their number is known before any is sent
    shapes = [(r["size"], r["form"]) for r in items.select("size", "form").distinct().collect()]  # at most 24
    n = items.count()
    only = np.unique(items.select("h").toArrow().column(0).to_numpy().view(_U)) if n <= sent else None
    renamed = {c: f"__i{i}" for i, c in enumerate(id_cols)}
    keys = list(renamed.values())
    mine = _windows(docs.select(*id_cols, text_col).withColumnsRenamed(renamed), keys, text_col, sorted(shapes), only).drop("n", "size", "form")
    # what has met is small and used several times; the texts are read once
    found = cut(_joined(mine, items.drop("size"), n, met).withColumn("diag", F.col("at") - F.col("b_at")))
    # diagonals of one copy, in order, with a new number after each gap
    diags = found.select(*keys, "item_id", "diag").distinct()
    before = Window.partitionBy(*keys, "item_id").orderBy("diag")
    apart = F.coalesce((F.col("diag") - F.lag("diag").over(before) > GAP).cast("int"), F.lit(0))
    copies = diags.withColumn("__new", apart).withColumn("copy", F.sum("__new").over(before)).drop("__new")
    part = [*keys, "item_id"]
    wide = _with(found, copies, [*part, "diag"])
    # a common word that starts sentences may have changed in one place: that is no clash for the item's plain windows alone
    groups = [_consistent(x.where(which), [*part, by]).drop(by) for x, by in ((found, "diag"), (wide, "copy")) for which in (F.lit(True), F.col("form") != NAMED)]
    good = reduce(DataFrame.union, groups)
    best = good.groupBy(*part).agg(F.max("matched").alias("matched"), F.max("windows").alias("windows"))
    return best.withColumn("share", F.col("matched") / F.col("windows")).withColumnsRenamed({v: k for k, v in renamed.items()})


def contaminated(docs: DataFrame, benchmark: DataFrame, id_cols: list[str], share: float = SHARE, **kw) -> DataFrame:
    return matches(docs, benchmark, id_cols, **kw).where(F.col("share") >= share)


def op3(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, matched, windows of every contaminated pair. Cases are those of matches()."""
    found = contaminated(docs.select("doc_id", "text"), benchmark.select("item_id", "text"), ["doc_id"])
    return found.select("doc_id", "item_id", F.col("matched").cast("bigint").alias("matched"), F.col("windows").cast("bigint").alias("windows"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without those that hold an item. Rows are told apart by id and text hash, so that a null id is no wildcard."""
    rows = docs.withColumn("__h", F.xxhash64("text"))
    bad = contaminated(rows, benchmark, [id_col, "__h"]).select(F.col(id_col).alias("__i"), F.col("__h").alias("__k")).distinct()
    return rows.join(bad, rows[id_col].eqNullSafe(bad["__i"]) & (rows["__h"] == bad["__k"]), "left_anti").drop("__h")
