"""SentencePiece encoding and decoding by a max-plus scan.

The model at hand is a BPE model. Its encoding of a text is the one segmentation in pieces in which every adjacent
pair (a, b) is stable: encoding a + b alone gives a, b again. That is a best path in the max-plus semiring: an edge
weighs 0 if the pair is stable, else minus infinity, and exactly one path weighs 0. Piece scores can't be summed
instead: the sum's best path is a unigram model's result and not this model's.

Words start where a blank follows a non-blank. No piece holds a blank behind another character, so every path passes
there: the transfer matrix of a word is one by one, and words are solved once and kept in a bounded table. Long documents
are split there into chunks, which are rows that any task may take; their matrices are one by one too, so that combining
them is putting their paths one after the other. A word
longer than LONG (a text without blanks) is split into chunks at any position. The states at a boundary are the
pieces that end at it or span it. Each chunk gives a matrix from left to right states; matrices are combined
associatively, then every chunk traces its own path back between its two states.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import CHUNK, by_chunks, held, with_fields
from brindle.llm.merging import Merging

BLANK = "▁"
#: Words of more characters than this are split.
LONG = 512
#: Most words held at once.
WORDS = 900_000
_WORD = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")

_START = re.compile(f"(?<=[^{BLANK}]){BLANK}")

State = tuple[int, int]  # start and end of the piece that spans a boundary


class PieceModel:
    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.byte = {int(names[i][1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id = {names[i]: i for i in plain}
        self.score = {names[i]: sp.get_score(i) for i in plain}
        self.longest = max(map(len, self.id))
        if any(BLANK in p.lstrip(BLANK) for p in self.id):
            raise ValueError("a piece has a blank behind another character: words are no boundaries of this model")
        self.text: list[bytes] = [b""] * n
        for i in plain:
            self.text[i] = names[i].replace(BLANK, " ").encode()
        for b, i in self.byte.items():
            self.text[i] = bytes([b])
        self.spell = Merging(self._rank, self.id)
        self.words = Words(self)

    def _rank(self, a: str, b: str) -> float | None:
        """Best score first."""
        x = self.score.get(a + b)
        return None if x is None else -x

    def is_stable(self, a: str, b: str) -> bool:
        return self.spell.stable(a, b)

    def starts(self, s: str, end: int, least: int) -> Iterator[int]:
        """Starts, from least on, of the pieces of s that end at `end`; the longest first."""
        for j in range(max(least, end - self.longest), end):
            if end - j == 1 or self.spell.whole(s[j:end]):
                yield j

    def forward(self, s: str, begin: State | None, until: int) -> dict[int, int]:
        """end -> start of the piece that ends there on the path of weight 0 from begin (None: the start of s)."""
        origin = 0 if begin is None else begin[1]
        last = {} if begin is None else {begin[1]: begin[0]}
        for i in range(origin + 1, until + 1):
            for j in self.starts(s, i, origin):
                if (j == 0 and begin is None) or (j in last and self.is_stable(s[last[j] : j], s[j:i])):
                    last[i] = j
                    break
        return last

    def boundary(self, s: str, at: int) -> list[State]:
        """Pieces that start before `at` and end there or later."""
        return [(j, e) for e in range(at, min(len(s), at + self.longest - 1) + 1) for j in self.starts(s, e, max(0, e - self.longest)) if j < at]

    def transfer(self, s: str, left: list[State | None], at: int) -> tuple[dict, dict]:
        """Matrix of a chunk that ends at `at`: {left: {right}} of the entries that weigh 0; and the paths of each left state."""
        right = self.boundary(s, at)
        matrix, paths = {}, {}
        for x in left:
            if x is not None and x[1] >= at:  # the piece spans the whole chunk
                matrix[x], paths[x] = {x} & set(right), {}
                continue
            last = paths[x] = self.forward(s, x, at)
            matrix[x] = {(j, e) for j, e in right if (x is None and j == 0) or (j in last and self.is_stable(s[last[j] : j], s[j:e]))}
        return matrix, paths

    @staticmethod
    def product(a: dict, b: dict) -> dict:
        """Max-plus product where weights are 0 and minus infinity. Associative."""
        return {x: set().union(*(b.get(y, ()) for y in ys)) for x, ys in a.items()}

    def split_long(self, s: str, chunk: int = LONG) -> list[str]:
        """Pieces of a long word by chunks."""
        cuts = [*range(chunk, len(s), chunk), len(s)]
        states: list[list[State | None]] = [[None], *(self.boundary(s, c) for c in cuts)]
        made = [self.transfer(s, states[i], c) for i, c in enumerate(cuts)]
        prefix = [made[0][0]]
        for m, _ in made[1:]:
            prefix.append(self.product(prefix[-1], m))
        (end,) = [x for x in prefix[-1][None] if x[1] == len(s)]
        at: list[State | None] = [end]
        for i in range(len(cuts) - 1, 0, -1):  # states at the boundaries, from the right
            (x,) = [y for y in prefix[i - 1][None] if at[-1] in made[i][0][y]]
            at.append(x)
        at.append(None)
        at.reverse()
        out: list[tuple[int, int]] = []
        for i in range(len(cuts)):  # each chunk for itself: back from its right state to its left one
            left, right, path = at[i], at[i + 1], made[i][1][at[i]]
            if left == right:
                continue
            back, j, origin = [right], right[0], 0 if left is None else left[1]
            while j > origin:
                back.append((path[j], j))
                j = path[j]
            out += reversed(back)
        return [s[j:e] for j, e in out]

    def split(self, word: str) -> list[str]:
        if len(word) > LONG:
            return self.split_long(word)
        return self.spell.path(word)

    def word(self, word: str) -> tuple[int, ...]:
        ids: list[int] = []
        for p in self.split(word):
            i = self.id.get(p)
            ids += [i] if i is not None else [self.byte[b] for b in p.encode("utf-8")]
        return tuple(ids)

    @staticmethod
    def normal(text: str) -> str:
        """The text as the model reads it."""
        return BLANK + text.replace(" ", BLANK) if text else ""

    def spelled(self, s: str) -> list[int]:
        """Ids of a normal text that starts at a word."""
        return list(chain.from_iterable(map(self.words.__getitem__, _WORD.findall(s))))

    def encode(self, text: str) -> list[int]:
        return self.spelled(self.normal(text))

    @staticmethod
    def split_text(text: str, size: int) -> list[str]:
        """The normal text in chunks of at least size characters, but for the last, each from a word's start: the transfer
        matrix of such a chunk is one by one, and the chunk's path is traced back without its neighbours."""
        s, out, at = PieceModel.normal(text), [], 0
        while at < len(s):
            m = _START.search(s, at + size) if at + size < len(s) else None
            end = m.start() if m else len(s)
            out.append(s[at:end])
            at = end
        return out

    def raw(self, ids: list[int]) -> str:
        return b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        """The text; a leading blank is the model's own and goes. U+2581 comes back as a blank, as the library has it."""
        s = self.raw(ids)
        return s[1:] if s.startswith(" ") else s


class Words(dict):
    """word -> ids, filled on demand and emptied when large."""

    def __init__(self, model: PieceModel) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= WORDS:
            self.clear()
        ids = self.model.word(word)
        if len(word) <= LONG:
            self[word] = ids
        return ids


def model(path: str) -> PieceModel:
    return held(("pieces", path), lambda: PieceModel(path))


def encode(docs: DataFrame, path: str, keep: list[str], text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """keep (the text itself may be among them), ids array<int>. A null or empty text has no ids; repeated rows and null ids
    are encoded each for itself; an empty table gives no row. A column ids among keep is replaced."""
    keep = [c for c in keep if c != "ids"]

    def lists(got: list[list[int]]) -> list[pa.Array]:
        off = np.cumsum([0, *map(len, got)]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(off), pa.array(np.fromiter(chain.from_iterable(got), np.int32, off[-1])))]

    def part(chunks: list[str]) -> list[bytes]:
        return [np.array(model(path).spelled(x), np.int32).tobytes() for x in chunks]

    return by_chunks(docs, keep, text_col, "ids array<int>", lambda texts: lists([model(path).encode(t) for t in texts]), PieceModel.split_text, part, lambda parts: (np.frombuffer(b"".join(parts), np.int32),), chunk)


def decode(encoded: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """keep, text: from ids; null ids give an empty text."""
    rows = encoded.select(*keep, F.coalesce("ids", F.array().cast("array<int>")).alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = model(path)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([m.decode(x) for x in b.column("__ids").to_pylist()], pa.string())], [*keep, "text"])

    return rows.mapInArrow(run, with_fields(rows.select(*keep), "text string"))


def digests(docs: DataFrame, path: str, keep: list[str], text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """keep, n_ids, ids_sha256 (of the ids as little-endian int32), round_trip: whether decoding gives the text back."""

    def whole(texts: list[str]) -> list[pa.Array]:
        m = model(path)
        got = [m.encode(t) for t in texts]
        sha = [hashlib.sha256(np.array(x, "<i4").tobytes()).hexdigest() for x in got]
        same = [m.decode(x) == t.replace(BLANK, " ") for x, t in zip(got, texts)]
        return [pa.array(list(map(len, got)), pa.int64()), pa.array(sha), pa.array(same)]

    def part(chunks: list[str]) -> list[bytes]:
        m = model(path)
        got = [m.spelled(x) for x in chunks]
        return [bytes([m.raw(ids) == x.replace(BLANK, " ")]) + np.array(ids, "<i4").tobytes() for ids, x in zip(got, chunks)]

    def joined(parts: list[bytes]) -> tuple:
        sha = hashlib.sha256()
        for p in parts:
            sha.update(memoryview(p)[1:])
        return sum(len(p) // 4 for p in parts), sha.hexdigest(), all(p[0] for p in parts)

    return by_chunks(docs, keep, text_col, "n_ids long, ids_sha256 string, round_trip boolean", whole, PieceModel.split_text, part, joined, chunk)


def _path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op5(docs: DataFrame) -> DataFrame:
    """doc_id, n_ids, ids_sha256, round_trip of every text. A null text is an empty one, of no ids; cases as in encode()."""
    return digests(docs.select("doc_id", "text"), _path(), ["doc_id"])


def encode_documents(docs: DataFrame) -> DataFrame:
    """docs with ids and n_ids, the last stage of the pipeline. Cases as in encode(); ids and n_ids are replaced."""
    out = encode(docs, _path(), docs.columns)
    return out.withColumn("n_ids", F.size("ids").cast("bigint"))
