"""Token counts by a compiled finite-state transducer.

A byte-level BPE tokenizer is two machines in a row. The first cuts a text into pretokens; it is finite-state with a
look-ahead of one character. The second spells a pretoken in merged tokens; from its start state a pretoken is one
compound transition, annotated with the number of tokens that it emits. Transitions are compiled when first met and
kept in a bounded table.

Before a white space that follows another character every run of the machine stands in the start state, whatever came
before. Long texts are split there into chunks, which are rows of their own: the map of such a chunk takes the start state to
the start state and emits a fixed count, so maps compose by adding, in any order and in any task. A run of characters without
white space is never split; it lies in one chunk, however long.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame

from brindle.llm.common import CHUNK, by_chunks, char_ranges, held
from brindle.llm.merging import Merging

#: Most compound transitions held at once.
TRANSITIONS = 900_000
#: Fixed value: White_Space.
SPACE = "\\t-\\r \x85\xa0  -     　"


class Cutter:
    """The first machine: pretokens of the byte-level pattern. Python's classes serve where they mean the same."""

    PLAIN = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")

    def __init__(self) -> None:
        other = char_ranges(lambda c: unicodedata.category(c) in ("No", "Nl"))
        self.odd = re.compile(f"[\x1c-\x1f{other}]")
        self.exact = None

    def __call__(self, text: str) -> list[str]:
        if text.isascii() and not self.odd.search(text) or not self.odd.search(text):
            return self.PLAIN.findall(text)
        if self.exact is None:
            letter = char_ranges(lambda c: unicodedata.category(c)[0] == "L")
            number = char_ranges(lambda c: unicodedata.category(c)[0] == "N")
            self.exact = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{SPACE}{letter}{number}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
        return self.exact.findall(text)


class CountTransducer(dict):
    """pretoken -> tokens emitted, compiled on demand from a byte-level BPE vocabulary file (.json)."""

    SYNC = re.compile(f"(?<=[^{SPACE}])[{SPACE}]")

    def __init__(self, path: str) -> None:
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # the vocabulary file writes a byte as a printable character; here it is the character of the same number
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): chr(b) for b in shown} | {chr(256 + i): chr(b) for i, b in enumerate(b for b in range(256) if b not in shown)}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.rank = {("".join(map(byte.get, a)), "".join(map(byte.get, b))): i for i, (a, b) in enumerate(pairs)}
        self.spell = Merging(lambda a, b: self.rank.get((a, b)), {a + b for a, b in self.rank} | {chr(b) for b in range(256)})
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.cutter = Cutter()

    def __missing__(self, pretoken: str) -> int:
        if len(self) >= TRANSITIONS:
            self.clear()
        n = self.compile(pretoken)
        if len(pretoken) <= 256:
            self[pretoken] = n
        return n

    def compile(self, pretoken: str) -> int:
        """Tokens of one pretoken, by the second machine; long ones by merging in a heap, which leaves no states."""
        s = pretoken if pretoken.isascii() else pretoken.encode("utf-8").decode("latin-1")
        return len(self.spell.path(s)) if len(s) <= 64 else self._compile_long(list(s))

    def _compile_long(self, s: list[str]) -> int:
        import heapq

        n = len(s)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, s[i], s[i + 1]) for i in range(n - 1) if (r := self.rank.get((s[i], s[i + 1]))) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        left = n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if not alive[i] or j >= n or s[i] != a or s[j] != b:
                continue
            s[i] = a + b
            alive[j] = False
            left -= 1
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            for x, y in ((prv[i], i), (i, nxt[i])):
                if x >= 0 and y < n and (r := self.rank.get((s[x], s[y]))) is not None:
                    heapq.heappush(heap, (r, x, s[x], s[y]))
        return left

    def emitted(self, text: str) -> int:
        """Tokens of a text that starts and ends at cuts. A special string is one token, as by the library's default."""
        if self.split and any(x in text for x in self.special):
            parts = self.split.split(text)
            return len(parts) - 1 + sum(self.emitted(p) for p in parts)
        get = self.__getitem__
        return sum(map(get, self.cutter(text)))

    def chunks(self, text: str, size: int) -> list[str]:
        """Chunks of at least size characters, but for the last, cut where the machine stands in its start state."""
        out, at = [], 0
        while at < len(text):
            m = self.SYNC.search(text, at + size) if at + size < len(text) else None
            end = m.start() if m else len(text)
            out.append(text[at:end])
            at = end
        return out

    def count(self, text: str, size: int = 1 << 15) -> int:
        """The count of one text, chunk by chunk."""
        return sum(map(self.emitted, self.chunks(text, size)))


def transducer(path: str) -> CountTransducer:
    """One for each Python worker."""
    return held(("transducer", path), lambda: CountTransducer(path))


def token_counts(docs: DataFrame, vocabulary: str, keep: list[str], text_col: str = "text", limit: int = 1024, chunk: int = CHUNK) -> DataFrame:
    """keep, n_bytes, n_tokens, over_limit for every row. A null text is an empty one, of no bytes and no tokens.

    Repeated rows and null ids are counted each for itself, an empty table gives no row, columns not kept aren't read.
    """

    def columns(bytes_: list[int], tokens: list[int]) -> list[pa.Array]:
        return [pa.array(bytes_, pa.int64()), pa.array(tokens, pa.int64()), pa.array([x > limit for x in tokens])]

    def whole(texts: list[str]) -> list[pa.Array]:
        return columns([len(x.encode("utf-8")) for x in texts], list(map(transducer(vocabulary).emitted, texts)))

    def part(chunks: list[str]) -> list[bytes]:
        t = transducer(vocabulary)
        return [struct.pack("<qq", len(x.encode("utf-8")), t.emitted(x)) for x in chunks]

    def joined(parts: list[bytes]) -> tuple:
        size, n = map(sum, zip(*(struct.unpack("<qq", p) for p in parts)))
        return size, n, n > limit

    split = lambda text, size: transducer(vocabulary).chunks(text, size)
    return by_chunks(docs, keep, text_col, "n_bytes long, n_tokens long, over_limit boolean", whole, split, part, joined, chunk)


def op4(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every text. Cases are those of token_counts()."""
    import public_tokenizers

    return token_counts(docs.select("doc_id", "text"), str(public_tokenizers.path("byte_bpe_50k.json")), ["doc_id"])
