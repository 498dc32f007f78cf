"""SimHash near-dedup by deletion-variant signatures.

A fingerprint is cut into so few segments that, for fingerprints to be linked, one segment differs by at most one
bit. Every segment is indexed under its one-wildcard variants (segment, wildcard bit, value without that bit): two
segments that differ by at most one bit share a variant. Equal variants meet in one sorted run; pairs in a run are
verified on the fingerprints.

No run is expanded into all its pairs in the output: all bits are compared in the run, and what a task has found leaves
it as a spanning forest of stars. A run of more than HOT 64-bit fingerprints isn't compared pair by pair. Its members are
indexed once more under all two-wildcard variants of the bits that the run leaves open. Members that share such a variant
differ by at most two bits, so a star is exact, and any size of run needs the memory of one row.

Wide fingerprints travel whole. So that few rows do, a segment is dealt by its halves: of segments that differ by at most
one bit, one half is equal. The wildcard variants of the other half are made in the task, group by group. A group of more than
BLOCK rows is dealt in blocks: first each block by itself, then, between blocks, what isn't yet connected with the group's
largest component. No pair is left out but those that are connected already.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import cut, release, text_rows
from brindle.llm.components import components, forest

#: Longest run that is verified pair by pair (half a million popcounts); longer ones are settled by _two_wildcards or _spread.
HOT = 1024
#: Most rows of equal halves that a task settles at once (some 10 MB); more are dealt in blocks of about so many.
BLOCK = 1 << 16
#: A component's members are dealt over so many tasks when it is named.
PARTS = 64
_U = np.uint64


@dataclass(frozen=True)
class Scheme:
    """shingle: words. bits: width of the fingerprint. segments: it is cut into so many. distance: most
    differing bits of a link. distinct: a shingle counts once, however often it stands in the text."""

    shingle: int = 3
    bits: int = 64
    segments: int = 2
    distance: int = 2
    distinct: bool = False
    seed: int = 42

    @property
    def width(self) -> int:
        return self.bits // self.segments

    @property
    def lanes(self) -> int:
        return (self.bits + 63) // 64


#: Exact for two bits: of two segments, one differs by at most one bit.
TWO_BITS = Scheme()
#: For distinct five-word shingles of 0.8 or more Jaccard similarity, at which 15 % of the bits differ (48 of 320, deviation
#: 6). A segment of 20 bits differs by at most one with chance 0.17 at 0.8, 0.25 at 0.85 and 0.37 at 0.9, so 16 segments
#: find 0.95, 0.99 and 0.999 of the pairs themselves; a group is found if its links connect it. A variant holds a
#: 2^-19 share of unrelated documents; beyond some 10^8 documents take wider segments and more of them.
FIVE_WORDS = Scheme(shingle=5, bits=320, segments=16, distance=62, distinct=True)


def _mix(h: np.ndarray, lane: int) -> np.ndarray:
    """Lane 0 is the shingle's XXH64; the other lanes are rehashed from it (splitmix64's finaliser)."""
    if lane == 0:
        return h
    z = h + _U((lane * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


def shingle_hashes(text: bytes, scheme: Scheme) -> list[int]:
    w = text.lower().split()
    if not w:
        return []
    k = scheme.shingle
    if len(w) <= k:
        return [xxhash.xxh64_intdigest(b" ".join(w), scheme.seed)]
    return list(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(w[i:] for i in range(k)))), repeat(scheme.seed)))


def fingerprints(texts: list[bytes], scheme: Scheme = TWO_BITS) -> np.ndarray:
    """(len(texts), lanes) uint64. A bit is 1 if set in over half of the shingles' hashes; no word: zero."""
    sums = np.zeros((len(texts), scheme.lanes, 64), np.int64)
    total = np.zeros(len(texts), np.int64)
    held: list[tuple[int, np.ndarray]] = []
    n = 0

    def flush() -> None:
        """Bits are added as bytes, eight to a word, in pieces of at most 255 rows."""
        nonlocal n
        if not held:
            return
        starts, owner, at = [], [], 0
        for doc, h in held:
            for i in range(0, len(h), 255):
                starts.append(at + i)
                owner.append(doc)
            at += len(h)
        every = np.concatenate([h for _, h in held])
        for lane in range(scheme.lanes):
            bits = np.unpackbits(_mix(every, lane).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            part = np.add.reduceat(bits.view(_U), starts, axis=0).view(np.uint8)
            np.add.at(sums[:, lane], owner, part.astype(np.int64))
        held.clear()
        n = 0

    for doc, text in enumerate(texts):
        h = np.array(shingle_hashes(text, scheme), dtype=_U)
        if scheme.distinct:
            h = np.unique(h)
        total[doc] = len(h)
        for i in range(0, len(h), 1 << 16):
            held.append((doc, h[i : i + (1 << 16)]))
            n += len(held[-1][1])
            if n >= 1 << 16:
                flush()
    flush()
    bits = (sums * 2 > total[:, None, None]).astype(np.uint8)
    out = np.packbits(bits, axis=2, bitorder="little").view(_U)[:, :, 0]
    if scheme.bits % 64:
        out[:, -1] &= _U((1 << (scheme.bits % 64)) - 1)
    return out


def _segments(fp: np.ndarray, scheme: Scheme) -> np.ndarray:
    """(n, segments) values of scheme.width bits."""
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(len(fp), -1), axis=1, bitorder="little")[:, : scheme.width * scheme.segments]
    weight = (_U(1) << np.arange(scheme.width, dtype=_U))
    return (bits.reshape(len(fp), scheme.segments, scheme.width).astype(_U) * weight).sum(axis=2, dtype=_U)


def variant_keys(fp: np.ndarray, scheme: Scheme) -> np.ndarray:
    """(n, segments * width): segment << 48 | wildcard << 40 | value with that bit cleared."""
    v = _segments(fp, scheme)
    i = np.arange(scheme.width, dtype=_U)
    s = np.arange(scheme.segments, dtype=_U)
    keys = (v[:, :, None] & ~(_U(1) << i)) | (i << _U(40)) | (s[None, :, None] << _U(48))
    return keys.reshape(len(fp), -1)


def _stars_of(x: np.ndarray, y: np.ndarray, bits: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return *forest(x, y), bits[:0]


def _near(run_key: np.ndarray, node: np.ndarray, check: np.ndarray, distance: int, thin: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of equal key whose checks differ by at most distance bits, thinned to a spanning forest. Pairs are held as
    offsets of rows: a node stands once in a run, so an offset names a node in its run."""
    none = np.empty(0, np.int64)
    held = [(none, none, np.empty(0, np.uint8))]
    at = np.flatnonzero(run_key[1:] == run_key[:-1])
    d = 1
    while len(at):
        bits = np.bitwise_count(check[at] ^ check[at + d])
        near = (bits <= distance) & (node[at] != node[at + d])
        held.append((at[near], at[near] + d, bits[near]))
        if d % 64 == 0:  # keep what is held small within a long run
            held = [thin(*map(np.concatenate, zip(*held)), node)]
        d += 1
        at = at[at + d < len(run_key)]
        at = at[run_key[at] == run_key[at + d]]
    x, y, _ = thin(*map(np.concatenate, zip(*held)), node)
    u, v = node[x], node[y]
    return np.maximum(u, v), np.minimum(u, v)


def _runs(batches: Iterator[pa.RecordBatch], distance: int, cap: int, thin: Callable) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key -> verified edges (hot null), and the members of runs longer than cap (hot: their key)."""

    def out(u: np.ndarray, v: np.ndarray, hot: np.ndarray | None) -> pa.RecordBatch:
        n = len(u)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64)), pa.nulls(n, pa.int64()) if hot is None else pa.array(hot.view(np.int64))], ["u", "v", "hot"])

    release()
    carry = [np.empty(0, _U)] * 3
    hot_key = None
    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False).view(_U) for c in ("key", "node", "check")]
        if hot_key is not None:
            same = int(np.searchsorted(cols[0] != hot_key, True))
            if same:
                yield out(cols[1][:same], cols[2][:same], cols[0][:same])
                cols = [c[same:] for c in cols]
            if len(cols[0]):
                hot_key = None
        key, node, check = (np.concatenate([x, y]) for x, y in zip(carry, cols))
        if not len(key):
            continue
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        big = np.repeat(sizes > cap, sizes)
        if big.any():
            yield out(node[big], check[big], key[big])
        if sizes[-1] > cap:
            hot_key = key[-1]
            done = len(key)
        else:
            done = starts[-1]
        carry = [key[done:], node[done:], check[done:]]
        use = ~big[:done]
        u, v = _near(key[:done][use], node[:done][use], check[:done][use], distance, thin)
        if len(u):
            yield out(u, v, None)
    key, node, check = carry
    u, v = _near(key, node, check, distance, thin)
    if len(u):
        yield out(u, v, None)


def _two_wildcards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of long runs of 64-bit fingerprints in two segments -> all two-wildcard variants of the 33 open bits."""
    pairs = [(i, j) for i in range(33) for j in range(i)]
    for batch in batches:
        key = batch.column("hot").to_numpy(zero_copy_only=False).view(_U)
        node = batch.column("u").to_numpy(zero_copy_only=False).view(_U)
        for at in range(0, len(key), 256):
            k, x = key[at : at + 256], node[at : at + 256]
            seg, bit = (k >> _U(48)) & _U(1), (k >> _U(40)) & _U(63)
            other = (x >> (_U(32) * (_U(1) - seg))) & _U(0xFFFFFFFF)
            own = (x >> (_U(32) * seg + bit)) & _U(1)
            rest = other | (own << _U(32))
            for n, (i, j) in enumerate(pairs):
                v = (rest & ~(_U(1) << _U(i)) & ~(_U(1) << _U(j))) | _U(n << 34)
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(v.view(np.int64)), pa.array(x.view(np.int64))], ["key", "key2", "node"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, key2) -> each member with the first of its run."""
    last, first = None, None
    for batch in batches:
        k, k2, x = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "key2", "node"))
        new = np.concatenate([[last != (k[0], k2[0]) if len(k) else True], (k[1:] != k[:-1]) | (k2[1:] != k2[:-1])])[: len(k)]
        if not len(k):
            continue
        head = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
        centre = np.where(head >= 0, x[head], x[0] if first is None else first)
        last, first = (k[-1], k2[-1]), centre[-1]
        u, v = forest(x[x != centre].view(_U), centre[x != centre].view(_U))
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])


def document_fingerprints(docs: DataFrame, scheme: Scheme, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep, node bigint, check bigint, fp binary: fp the fingerprint, check its first 64 bits.

    node names the fingerprint: itself where it has 64 bits, else a 64-bit hash of it. A null text counts as empty.
    """
    rows = text_rows(docs, text_col, *keep, binary=True)
    schema = rows.select(*keep).schema.add("node", "long").add("check", "long").add("fp", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                fp = fingerprints(b.column("__text").to_pylist(), scheme)
                raw = [r.tobytes() for r in fp]
                node = fp[:, 0] if scheme.lanes == 1 else np.array([xxhash.xxh64_intdigest(r, 1) for r in raw], dtype=_U)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(node.view(np.int64)), pa.array(np.ascontiguousarray(fp[:, 0]).view(np.int64)), pa.array(raw, pa.binary())], [*keep, "node", "check", "fp"])

    return rows.mapInArrow(run, schema)


def half_keys(fp: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """(n, segments * 2) keys, segment << 48 | half << 40 | value of the half, and as many values of the other half."""
    v, low = _segments(fp, scheme), scheme.width // 2
    parts = np.stack([v & _U((1 << low) - 1), v >> _U(low)], axis=2)
    tag = (np.arange(scheme.segments, dtype=_U)[:, None] << _U(48)) | (np.arange(2, dtype=_U) << _U(40))
    return (parts | tag).reshape(len(fp), -1), parts[:, :, ::-1].reshape(len(fp), -1)


def _half_sizes(batches: Iterator[pa.RecordBatch], scheme: Scheme) -> Iterator[pa.RecordBatch]:
    """Fingerprints -> (key, n): how many of them have each half. A scheme has so many halves, however many rows there are."""
    release()
    high = scheme.width - scheme.width // 2
    sizes = np.zeros(scheme.segments * 2 << high, np.int64)
    for b in batches:
        fp = np.frombuffer(b"".join(b.column("fp").to_pylist()), dtype=_U).reshape(b.num_rows, -1)
        keys, _ = half_keys(fp, scheme)
        tag = ((keys >> _U(48)) << _U(1)) | ((keys >> _U(40)) & _U(1))
        sizes += np.bincount(((tag << _U(high)) | (keys & _U((1 << high) - 1))).ravel().astype(np.int64), minlength=len(sizes))
    own = np.flatnonzero(sizes)
    tag, value = own >> high, own & ((1 << high) - 1)
    yield pa.RecordBatch.from_arrays([pa.array(((tag >> 1) << 48) | ((tag & 1) << 40) | value), pa.array(sizes[own])], ["key", "n"])


def _linked(group: np.ndarray, other: np.ndarray, fp: np.ndarray, scheme: Scheme, label: np.ndarray | None = None) -> np.ndarray:
    """Label of each row (the offset of its tree's first row): rows of one group whose other halves differ by at most one
    bit, and whose fingerprints differ by at most scheme.distance, are connected. All such pairs are compared but those
    that are connected already, from the start by label."""
    label = np.arange(len(group)) if label is None else label
    if not len(group):
        return label
    for wild in range(scheme.width - scheme.width // 2):
        key = other & ~(_U(1) << _U(wild))
        order = np.lexsort((key, group))
        g, k = group[order], key[order]
        starts = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (k[1:] != k[:-1])]))
        sizes = np.diff(np.append(starts, len(g)))
        of = label[order]
        open_ = np.minimum.reduceat(of, starts) != np.maximum.reduceat(of, starts)
        order, run = order[np.repeat(open_, sizes)], np.repeat(np.flatnonzero(open_), sizes[open_])
        found = []
        ends = np.cumsum(sizes[open_])
        short = np.ones(len(run), bool)
        for i in np.flatnonzero(sizes[open_] > HOT):
            own = slice(ends[i] - sizes[open_][i], ends[i])
            short[own] = False
            label = _joined(label, [_spread(order[own], label, fp, scheme.distance)])
        order, run = order[short], run[short]
        at, d = np.flatnonzero(run[1:] == run[:-1]), 1
        while len(at):
            for lo in range(0, len(at), 1 << 16):
                x, y = order[at[lo : lo + (1 << 16)]], order[at[lo : lo + (1 << 16)] + d]
                apart = label[x] != label[y]
                x, y = x[apart], y[apart]
                near = np.bitwise_count(fp[x] ^ fp[y]).sum(axis=1) <= scheme.distance
                found.append((x[near], y[near]))
            if d % 8 == 0:
                label, found = _joined(label, found), []
            d += 1
            at = at[at + d < len(run)]
            at = at[run[at] == run[at + d]]
        label = _joined(label, found)
    return label


def _spread(rows: np.ndarray, label: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect what is connected among the rows, label given: trees grow from the middle of the rows outward.

    Every row is compared once with all rows that no tree has reached yet, so no pair of two trees is left out. Rows that
    are near the middle reach most others at once, so copies cost little more than their number; rows that are all far
    from each other cost its square in time, and in memory always their number.
    """
    ones = sum(np.unpackbits(fp[rows[i : i + 4096]].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for i in range(0, len(rows), 4096))
    middle = np.packbits(2 * ones > len(rows), bitorder="little").view(_U)
    rows = rows[np.argsort(np.bitwise_count(fp[rows] ^ middle).sum(axis=1), kind="stable")]
    xs, ys = [rows[:0]], [rows[:0]]
    while len(rows):
        reached = label[rows] == label[rows[0]]
        open_, rows = rows[reached], rows[~reached]
        while len(open_) and len(rows):
            n = max(1, (1 << 18) // len(rows))  # so many at once
            some, open_ = open_[:n], open_[n:]
            bits = np.zeros((len(some), len(rows)), np.uint16)
            for lane in range(fp.shape[1]):
                bits += np.bitwise_count(fp[some, lane][:, None] ^ fp[rows, lane])
            near = bits <= distance
            hit = np.flatnonzero(near.any(axis=0))
            xs.append(some[near[:, hit].argmax(axis=0)])
            ys.append(rows[hit])
            reached = np.isin(label[rows], label[rows[hit]])  # with a row come those that it is connected with
            open_, rows = np.concatenate([open_, rows[reached]]), rows[~reached]
    return np.concatenate(xs), np.concatenate(ys)


def _joined(label: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """label after the rows of each pair are connected."""
    if not sum(len(x) for x, _ in pairs):
        return label
    x, y = map(np.concatenate, zip(*pairs))
    own, root = forest(label[x], label[y])
    to = np.arange(len(label))
    to[own] = root
    return to[label]


def _wide_runs(batches: Iterator[pa.RecordBatch], scheme: Scheme) -> Iterator[pa.RecordBatch]:
    """Rows (key, other, node, fp, root) sorted by key -> verified edges: stars of what is connected within a group. Rows of
    one root are connected already."""
    release()

    def settle(key: np.ndarray, other: np.ndarray, node: np.ndarray, root: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((root, key))
        new = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (root[order][1:] != root[order][:-1])])
        start = np.empty(len(key), np.int64)
        start[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        label = _linked(key, other, fp, scheme, start)
        own = np.flatnonzero(label != start)
        u, v = node[own], node[label[own]]
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v).view(np.int64)), pa.array(np.minimum(u, v).view(np.int64))], ["u", "v"])

    held: list[list[np.ndarray]] = []
    for b in batches:
        cols = [b.column(c).to_numpy(zero_copy_only=False).view(_U) for c in ("key", "other", "node", "root")]
        if not len(cols[0]):
            continue
        cols.append(np.frombuffer(b"".join(b.column("fp").to_pylist()), dtype=_U).reshape(b.num_rows, -1))
        if held and held[-1][0][-1] == cols[0][-1]:  # the group goes on
            held.append(cols)
            continue
        last = int(np.searchsorted(cols[0], cols[0][-1]))
        yield settle(*map(np.concatenate, zip(*held, [c[:last] for c in cols])))
        held = [[c[last:].copy() for c in cols]]
    if held:
        yield settle(*map(np.concatenate, zip(*held)))


def _wide_links(rows: DataFrame, many: DataFrame, scheme: Scheme, block: int) -> DataFrame:
    """Rows (key, other, node, fp) -> verified links (u, v). many: (key, n) of the groups of more than `block` rows; there are
    at most as many as a scheme has halves, so they may be sent to all tasks.

    A node lies in other blocks under another half, so that the blocks of one large group of copies are mostly connected
    after the first pass. In the second a block meets only blocks of the rows that lie outside the largest component.
    """

    def settled(x: DataFrame) -> DataFrame:
        x = x.select("key", "other", "node", "root", "fp")
        return x.repartition("key").sortWithinPartitions("key", "node").mapInArrow(lambda it: _wide_runs(it, scheme), "u long, v long")

    if many.isEmpty():
        return settled(rows.withColumn("root", F.col("node")))
    blocks = lambda n: F.ceil(n / F.lit(block))
    place = lambda n: F.pmod(F.xxhash64("node", "key"), n)
    name = lambda *c: F.shiftrightunsigned(F.xxhash64(*c), 1)  # noqa: E731  (keys aren't negative: tasks see them sorted as unsigned)
    dealt = rows.join(F.broadcast(many), "key", "left").withColumn("root", F.col("node"))
    alone = F.when(F.col("n").isNull(), F.col("key")).otherwise(name("key", place(blocks(F.col("n")))))
    first = cut(settled(dealt.withColumn("key", alone)))
    held = rows.join(F.broadcast(many.select("key")), "key").join(components(first), "node", "left")
    held = cut(held.withColumn("root", F.coalesce("root", "node")))
    size = held.groupBy("key", "root").agg(F.count("*").alias("m"))
    largest = size.groupBy("key").agg(F.max(F.struct("m", "root")).alias("most"), F.sum("m").alias("n"))
    largest = largest.select("key", F.col("most.root").alias("top"), blocks(F.col("n")).alias("a"), blocks(F.col("n") - F.col("most.m")).alias("b")).where("b > 0")
    held = held.join(F.broadcast(largest), "key")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    whole = held.withColumn("i", place(F.col("a"))).withColumn("j", every("b"))
    rest = held.where("root <> top").withColumn("j", place(F.col("b"))).withColumn("i", every("a"))
    return first.union(settled(whole.unionByName(rest).withColumn("key", name("key", "i", "j"))))


def links(nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """Distinct nodes (node, check, fp) -> verified links (u, v) that connect what is to be connected."""
    full = scheme.lanes == 1 and scheme.segments == 2 and scheme.distance == 2

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                fp = np.frombuffer(b"".join(b.column("fp").to_pylist()), dtype=_U).reshape(b.num_rows, -1)
                if full:
                    keys = variant_keys(fp, scheme)
                    rep = [np.repeat(b.column(c).to_numpy(zero_copy_only=False), keys.shape[1]) for c in ("node", "check")]
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), *map(pa.array, rep)], ["key", "node", "check"])
                    continue
                keys, others = half_keys(fp, scheme)
                i = pa.array(np.repeat(np.arange(b.num_rows), keys.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(others.ravel().view(np.int64)), b.column("node").take(i), b.column("fp").take(i)], ["key", "other", "node", "fp"])

    if not full:
        sizes = nodes.select("fp").mapInArrow(lambda it: _half_sizes(it, scheme), "key long, n long")
        many = cut(sizes.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > BLOCK))
        rows = nodes.select("node", "fp").mapInArrow(emit, "key long, other long, node long, fp binary")
        return _wide_links(rows, many, scheme, BLOCK).distinct()
    limit, cap = scheme.distance, HOT
    variants = nodes.select("node", "check", "fp").mapInArrow(emit, "key long, node long, check long")
    found = variants.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _runs(it, limit, cap, _stars_of), "u long, v long, hot long")
    found = cut(found)
    edges = found.where("hot is null").select("u", "v")
    again = found.where("hot is not null").mapInArrow(_two_wildcards, "key long, key2 long, node long")
    return edges.union(again.repartition("key", "key2").sortWithinPartitions("key", "key2").mapInArrow(_stars, "u long, v long"))


def cluster(docs: DataFrame, scheme: Scheme = TWO_BITS, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per row of docs: id_col, other kept columns, node, fp, root (the component's least node), component_id
    (smallest id reachable, itself included).

    A null text is an empty one; texts without a word have fingerprint zero and are linked like any other; a null id
    takes part but is never a component's name unless its component has no other; repeated rows each give a row; an
    empty table gives an empty one. Columns not named are not read. Ids must order as numbers or strings.
    """
    keep = [id_col, *(keep or [])]
    rows = cut(document_fingerprints(docs, scheme, keep, text_col))
    distinct = cut(rows.groupBy("node", "check", "fp").agg(F.min(id_col).alias("least")))
    comp = components(links(distinct, scheme))
    placed = distinct.select("node", "least").join(comp, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    # a large component is dealt over PARTS parts: each part's least id, then the least of at most PARTS rows, then back
    placed = placed.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(PARTS)))
    parts = placed.groupBy("root", "part").agg(F.min("least").alias("least"))
    parts = parts.select("root", "part", F.min("least").over(Window.partitionBy("root")).alias("component_id"))
    named = placed.join(parts, ["root", "part"]).select(F.col("node").alias("of"), "root", "component_id")
    return rows.join(named, rows["node"] == named["of"], "left").drop("of", "check")


def op1(docs: DataFrame) -> DataFrame:
    c = cluster(docs.select("doc_id", "text"))
    return c.select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, scheme: Scheme = FIVE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group: that with the smallest id, all columns as they were.

    Of rows that repeat id and text one stays. In a group, of texts with the same id the one with the smallest hash stays,
    and a null id only where there is no other; texts in different groups don't touch each other, whatever their ids.
    """
    key = F.xxhash64(text_col)
    own = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t"), key.alias("__h"))
    c = cluster(own, scheme, "__id", "__t", ["__h"])
    # ids needn't be unique: a group is told by its root, and its row by id and text; nulls come last
    texts = c.groupBy("root", "__id", "__h").agg(F.count("*").alias("n"))
    first = texts.groupBy("root").agg(F.min(F.struct(F.col("__id").isNull().alias("null"), "__id", "__h", "n")).alias("f")).select("f.*")
    first = cut(first)
    repeated = first.where("n > 1").limit(1).count() > 0
    stays = first.select("__id", F.col("__h").alias("__k"))
    kept = docs.withColumn("__h", key)
    kept = kept.join(stays, kept[id_col].eqNullSafe(stays["__id"]) & (kept["__h"] == stays["__k"]), "left_semi")
    if repeated:
        kept = kept.dropDuplicates([id_col, "__h"])
    return kept.drop("__h")
