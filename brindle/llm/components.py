"""Connected components of an edge table.

Large edge tables are settled by alternating large-star and small-star steps. A table of at most LOCAL edges (16 MB,
counted before) is settled by one task in one pass, which spares the rounds' many small jobs; results are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import cut

#: A node's neighbours are dealt over so many tasks, so that the centre of a large component is no hot key.
SALTS = 16
#: Most edges that one task settles.
LOCAL = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges as a spanning forest: each node but the least of its tree, with the least."""
    if len(a) == 0:
        return a, b
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[own], nodes[label[own]]


def least_tree(a: np.ndarray, b: np.ndarray, *by: np.ndarray) -> np.ndarray:
    """Offsets of the edges of a minimum spanning forest in the order `by` (first key first), found by rounds in which
    every tree takes its first open edge."""
    if len(a) == 0:
        return np.empty(0, np.int64)
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    order = np.lexsort(by[::-1])
    x, y = x[order], y[order]
    label, open_, taken = np.arange(len(nodes)), np.arange(len(a)), []
    while len(open_):
        lx, ly = label[x[open_]], label[y[open_]]
        apart = lx != ly
        open_, lx, ly = open_[apart], lx[apart], ly[apart]
        if not len(open_):
            break
        first = np.full(len(nodes), len(open_))
        np.minimum.at(first, lx, np.arange(len(open_)))
        np.minimum.at(first, ly, np.arange(len(open_)))
        pick = np.unique(first[first < len(open_)])
        taken.append(open_[pick])
        own, root = forest(lx[pick], ly[pick])
        to = np.arange(len(nodes))
        to[own] = root
        label = to[label]
    return order[np.concatenate(taken)] if taken else order[:0]


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges of a bounded table -> (node, root). Nodes compare as bigint."""
    parts = [(b.column("u").to_numpy(zero_copy_only=False), b.column("v").to_numpy(zero_copy_only=False)) for b in batches]
    if parts:
        node, root = forest(np.concatenate([x for x, _ in parts]), np.concatenate([y for _, y in parts]))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "root"])


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges (u, v) with m, the least of u's neighbourhood; both sides salted by v."""
    left = edges.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    right = least.select("u", "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s")).withColumn("s", F.col("s").cast("bigint"))
    return left.join(right, ["u", "s"])


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = _with_least(down, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60, local: int = LOCAL) -> DataFrame:
    """edges (u bigint, v bigint) -> (node, root): root is the least node reachable. Nodes without edges are absent.

    Nulls and loops are ignored, repeated edges count once, an empty table gives an empty table. Each round is
    checkpointed; what reaches the driver is one row of two sums.
    """
    e = cut(edges.where("u is not null and v is not null and u <> v").select("u", "v").distinct())
    if e.count() <= local:
        return e.coalesce(1).mapInArrow(_settle, "node long, root long")
    seen = None
    for _ in range(most_rounds):
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now[0] == 0 or now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
        e = cut(_small_star(_large_star(e)))
    raise RuntimeError(f"components: not settled after {most_rounds} rounds")
