"""Connected components of an edge table by hashed contraction; neither edges nor components meet in one place."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.llm.common import Scratch

#: Nodes that a task's forest holds before it is flushed.
FOREST_NODES = 500_000
#: Edges up to which a round writes few files.
FEW_EDGES = 100_000
ROUNDS = 60


class Forest:
    """Union-find over integers."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (nxt := up.setdefault(top, top)) != top:
            top = nxt
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest, a, b = Forest(), [], []

    def out():
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if x != y and forest.join(x, y):
                a.append(x)
                b.append(y)
        if len(forest.up) > FOREST_NODES:
            yield out()
            forest, a, b = Forest(), [], []
    yield out()


def thin(edges: DataFrame) -> DataFrame:
    """Edges (a, b) without those that a task's own spanning forest makes needless; components stay the same."""
    return edges.select("a", "b").mapInArrow(_forest, "a long, b long")


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of an edge table (a long, b long): root is one node of its component.

    Each round, every node hooks onto the neighbour, or itself, with the smallest hash of that round, and edges are
    relabelled; the expected number of nodes falls by a constant share, so rounds grow with the log of the nodes.
    Self loops and repeated edges are allowed; null ends are left out.
    """
    nodes = edges.where("a is not null and b is not null")
    left = scratch.save(thin(nodes))
    hooks: list[DataFrame] = []
    files = None
    first = left
    for r in range(ROUNDS):
        n = left.count()
        if not n:
            break
        files = 8 if n <= FEW_EDGES else None
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(r), c).alias("h"), c.alias("v"))  # noqa: E731, B023
        hook = both.groupBy("a").agg(F.min(F.least(rank(F.col("a")), rank(F.col("b")))).alias("m"))
        hook = scratch.save(hook.select(F.col("a").alias("node"), F.col("m.v").alias("up")), files)
        hooks.append(hook)
        x, y = (hook.select(F.col("node").alias(c), F.col("up").alias(f"u{c}")) for c in "ab")
        moved = left.join(x, "a").join(y, "b").where("ua != ub").select(F.col("ua").alias("a"), F.col("ub").alias("b"))
        nxt = scratch.save(thin(moved.distinct()), files)
        if left is not first:
            scratch.drop(left)
        left = nxt
    else:
        raise RuntimeError("components did not settle")
    if not hooks:
        return first.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = hooks[0].select("node", F.col("up").alias("root"))
    for h in hooks[1:]:
        h = h.select(F.col("node").alias("root"), F.col("up").alias("nxt"))
        out = out.join(h, "root", "left").select("node", F.coalesce("nxt", "root").alias("root"))
    return scratch.save(out, files)
