"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with offsets, and the sorted spans of its assistant turns are met with
the sorted token spans by binary search. The template's control strings are special tokens of the tokenizer, so no
token straddles a turn's edge. Control strings inside texts and roles are escaped reversibly: the first character of
each becomes a backslash code, and a backslash two.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import with_fields

OPEN, MIDDLE, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that some chat template or tokenizer reads as control; longer ones first.
CONTROL = ("<|", "|>", "[/INST]", "[INST]", "<<SYS>>", "<</SYS>>", "</s>", "<s>", "<pad>", "<unk>")
_ESCAPE = re.compile("|".join([r"\\", *map(re.escape, sorted(CONTROL, key=len, reverse=True))]))
_CODE = {"\\": "\\", "<": "l", "[": "b", "|": "p"}
_BACK = {v: k for k, v in _CODE.items()}
_TURN = re.compile(f"{re.escape(OPEN)}(.*?){re.escape(MIDDLE)}(.*?){re.escape(CLOSE)}", re.S)

#: Characters encoded at once; the library needs some 100 bytes a token meanwhile.
BATCH = 1 << 18

Turn = tuple[str, str]


def escape(s: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + _CODE[m[0][0]] + m[0][1:], s)


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK.get(m[1], m[0]), s, flags=re.S)


def render(turns: list[Turn]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation's text and the spans of its assistant turns' texts."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = OPEN + escape(role) + MIDDLE, escape(text)
        if role == "assistant" and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), spans


def read(formatted: str) -> list[Turn]:
    """The turns of a rendered conversation."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


_TOKENIZERS: dict = {}


def _tokenizer(path: str):
    if path not in _TOKENIZERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for each core
        from tokenizers import AddedToken, Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = False
        t.add_special_tokens([AddedToken(x, normalized=False, special=True) for x in (OPEN, MIDDLE, CLOSE)])
        _TOKENIZERS[path] = t
    return _TOKENIZERS[path]


def mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Whether each token (start, end) meets one of the sorted spans: the first span that ends after its start begins before its end."""
    if not spans or not len(offsets):
        return np.zeros(len(offsets), bool)
    s = np.array(spans)
    i = np.searchsorted(s[:, 1], offsets[:, 0], side="right")
    return (i < len(s)) & (s[np.minimum(i, len(s) - 1), 0] < offsets[:, 1])


def covered(offsets: np.ndarray, on: np.ndarray) -> list[tuple[int, int]]:
    """Merged character spans under a token mask. Tokens of one character's bytes share its offsets."""
    out: list[list[int]] = []
    for s, e in offsets[on].tolist():
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def formatted(conversations: DataFrame, vocabulary: str, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """id, formatted, and of each token its id, start, end and loss: one row for each conversation.

    Turns are in the order of turn, then role and text where turns tie; a null turn comes first; a null role or text is
    empty; a null id is a conversation of its own; repeated rows are repeated turns; no rows give no rows. Rows are
    dealt by id and sorted in the partition, so a task holds one conversation at a time.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col(id_col).alias("__id"), F.col(turn_col).alias("__turn"), empty(role_col).alias("__role"), empty(text_col).alias("__text"))
    rows = rows.repartition("__id").sortWithinPartitions("__id", "__turn", "__role", "__text")
    schema = with_fields(rows.select(F.col("__id").alias(id_col)), "formatted string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(vocabulary)

        def out(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            made = [render(turns) for _, turns in done]
            codes = t.encode_batch([text for text, _ in made], add_special_tokens=False)
            offsets = [np.array(c.offsets, np.int32).reshape(-1, 2) for c in codes]
            loss = [mask(o, spans) for o, (_, spans) in zip(offsets, made)]
            ints, flags = pa.list_(pa.int32()), pa.list_(pa.bool_())
            cols = [pa.array([text for text, _ in made]), pa.array([c.ids for c in codes], ints), pa.array([o[:, 0] for o in offsets], ints), pa.array([o[:, 1] for o in offsets], ints), pa.array(loss, flags)]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], kind), *cols], [id_col, "formatted", "ids", "starts", "ends", "loss"])

        done: list[tuple] = []
        size, kind = 0, pa.int64()
        for b in batches:
            kind = b.column("__id").type
            for k, role, text in zip(b.column("__id").to_pylist(), b.column("__role").to_pylist(), b.column("__text").to_pylist()):
                if not done or done[-1][0] != k:
                    if size > BATCH:
                        yield out(done, kind)
                        done, size = [], 0
                    done.append((k, []))
                done[-1][1].append((role, text))
                size += len(text)
        if done:
            yield out(done, kind)

    return rows.mapInArrow(run, schema)


def read_back(made: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Digests of what formatted() wrote, from its texts, ids and masks alone: turns, text under the mask, length."""
    schema = with_fields(made.select(id_col), "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, starts, ends, on in zip(*(b.column(c) for c in ("formatted", "starts", "ends", "loss"))):
                text = text.as_py()
                turns = read(text)
                offsets = np.stack([starts.values.to_numpy(), ends.values.to_numpy()], axis=1)
                under = "".join(unescape(text[s:e]) for s, e in covered(offsets, on.values.to_numpy(zero_copy_only=False)))
                sha = hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
                rows.append((len(turns), sha, len(under), hashlib.sha256(under.encode()).hexdigest(), len(text)))
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(id_col), *(pa.array(c, t) for c, t in zip(cols, kinds))], [id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return made.select(id_col, "formatted", "starts", "ends", "loss").mapInArrow(run, schema)


def op7(conversations: DataFrame) -> DataFrame:
    import public_tokenizers

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    said = "</s>[INST] ok [/INST]"
    probe = conversations.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return read_back(formatted(rows.union(probe), path))
