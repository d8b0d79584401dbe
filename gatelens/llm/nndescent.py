"""Embedding near-duplicates by NN-descent.

Equal vectors share one node. A neighbour graph starts from blocks of random-projection trees, then neighbours of
neighbours are joined, round by round: a node's neighbours, those whose neighbour it is, and itself meet at it, all
pairs of them are compared, and each keeps its nearest. Lists that are full of links double, up to MAX_LIST. Links are
verified in double precision and joined to components. A list that ended full may hide links of its node: links out of
its component are searched exactly, and inside each component links are counted exactly, by blocks of vectors against
each other; only edges between components and counts leave a block.

Recall is audited against brute force on a hashed sample of nodes, node by node; below MIN_RECALL the graph is refined from more
trees, and where that doesn't help all nodes are searched exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatelens.llm.common import Scratch, join_checked, over_batches, over_runs
from gatelens.llm.components import connected_components

COSINE = 0.95
LIST = 8
MAX_LIST = 64
#: Below all cosines: a list takes any neighbours until it is full, so that every node enters the rounds.
FLOOR = -1.5
#: Least trees, and the share of pairs at the threshold that are to share a leaf: trees grow with the planes, so with the nodes.
TREES, MEET = 4, 0.99
#: Nodes of a tree's block, and of a block in which links are counted.
LEAF, COUNT_BLOCK = 64, 1024
ROUNDS = 4
#: A round that changes less than this share of the lists' entries is the last.
SETTLED = 0.005
AUDIT, MIN_RECALL, RETRIES = 200, 0.95, 2
#: Half-precision cosines within this of the threshold are verified.
SLACK = 4e-3


def _prepare(batch: pa.RecordBatch) -> pa.RecordBatch:
    ids, k1, k2, wide, short = [], [], [], [], []
    for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        if i is None or not v or any(x is None for x in v):
            continue
        x = np.array(v, np.float64)
        norm = math.sqrt(float(x @ x)) if np.isfinite(x).all() else 0.0
        if not 0 < norm < math.inf:
            scale = np.abs(x).max() if np.isfinite(x).all() else 0.0  # squares may overflow or vanish
            if not scale:
                continue
            x = x / scale
            norm = math.sqrt(float(x @ x))
        raw = (x / norm).tobytes()
        a, b = np.frombuffer(xxhash.xxh3_128_digest(raw), np.int64).tolist()
        ids.append(i)
        k1.append(a)
        k2.append(b)
        wide.append(raw)
        short.append((x / norm).astype(np.float16).tobytes())
    cols = [pa.array(ids, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(wide, pa.binary()), pa.array(short, pa.binary())]
    return pa.RecordBatch.from_arrays(cols, ["vec_id", "k1", "k2", "v", "h"])


def rows_of(column: pa.Array, dtype) -> np.ndarray:
    return np.stack([np.frombuffer(x, dtype) for x in column.to_pylist()]).astype(np.float64 if dtype == np.float64 else np.float32)


def _sizes(column: pa.Array) -> np.ndarray:
    return np.array([len(x) for x in column.to_pylist()])


def planes_of(n: int) -> int:
    return min(48, max(1, math.ceil(math.log2(max(2, n / (LEAF // 2))))))


def trees_of(n: int) -> int:
    """Trees in which a pair at the threshold shares a side of all planes at least once, but for 1 - MEET of pairs."""
    together = (1 - math.acos(COSINE) / math.pi) ** planes_of(n)
    return max(TREES, math.ceil(math.log(1 - MEET) / math.log(1 - together)))


def _trees(nodes: DataFrame, n: int, trees: range) -> DataFrame:
    """(tree, code, leaf, id, h): sides of random planes that each node lies on; a last tree deals all nodes at random."""
    bits = planes_of(n)

    def codes(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, h, size = b.column(0).to_numpy(), b.column(1), _sizes(b.column(1))
        out: list[tuple] = []
        for d in np.unique(size).tolist():
            own = np.flatnonzero(size == d)
            x = rows_of(h.take(pa.array(own)), np.float16)
            out.append((np.full(len(own), -1 - trees.start), np.full(len(own), d << 50), ids[own], h.take(pa.array(own))))
            for t in trees:
                planes = np.random.default_rng([t, d]).standard_normal((x.shape[1], bits))
                code = ((x @ planes > 0) @ (1 << np.arange(bits))).astype(np.int64) ^ (d << 50)
                out.append((np.full(len(own), t), code, ids[own], h.take(pa.array(own))))
        cols = [np.concatenate([o[i] for o in out]) for i in range(3)] if out else [np.zeros(0, np.int64)] * 3
        data = pa.concat_arrays([o[3] for o in out]) if out else pa.array([], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(cols[0].astype(np.int32)), pa.array(cols[1]), pa.array(cols[2]), data], ["tree", "code", "id", "h"])

    at = over_batches(nodes.select("id", "h"), codes, "tree int, code long, id long, h binary")
    size = at.groupBy("tree", "code").count().where(F.col("count") > LEAF)
    size = size.select("tree", "code", F.ceil(F.col("count") / LEAF).alias("leaves"))
    # a crowded leaf is dealt at random into several
    at = join_checked(at, size, ["tree", "code"], "left")
    return at.withColumn("leaf", F.coalesce(F.pmod(F.xxhash64("id", "tree"), F.col("leaves")), F.lit(0)))


def _nearest(ids: np.ndarray, x: np.ndarray, least: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row, its `most` nearest others above its own `least` cosine: (from, to, cosine)."""
    s = x @ x.T
    np.fill_diagonal(s, -2)
    if len(ids) > most:
        cut = -np.partition(-s, most - 1, axis=1)[:, most - 1]
        least = np.maximum(least, cut)
    a, b = np.nonzero(s >= least[:, None])
    keep = ids[a] != ids[b]
    return ids[a[keep]], ids[b[keep]], s[a[keep], b[keep]].astype(np.float32)


EDGE = "u long, w long, s float"


def _edges(u, w, s) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(w, pa.int64()), pa.array(s, pa.float32())], ["u", "w", "s"])


def _leaf_edges(g: pa.RecordBatch) -> pa.RecordBatch | None:
    if g.num_rows < 2:
        return None
    ids = g.column(g.schema.get_field_index("id")).to_numpy()
    return _edges(*_nearest(ids, rows_of(g.column(g.schema.get_field_index("h")), np.float16), np.full(len(ids), FLOOR, np.float32), LIST))


def _local_join(g: pa.RecordBatch) -> pa.RecordBatch | None:
    """Pairs of those that meet at a node."""
    if g.num_rows < 3:
        return None
    ids, size = g.column(1).to_numpy(), _sizes(g.column(2))
    own = np.flatnonzero(size == size[0])
    least = np.maximum(g.column(3).to_numpy()[own], np.float32(FLOOR))
    return _edges(*_nearest(ids[own], rows_of(g.column(2).take(pa.array(own)), np.float16), least, MAX_LIST))


def _top(edges: DataFrame, sizes: DataFrame | None) -> DataFrame:
    """Each node's nearest, as many as its list holds."""
    best = edges.groupBy("u", "w").agg(F.max("s").alias("s"))
    if sizes is not None:
        best = best.join(sizes, "u", "left")
    size = F.coalesce(F.col("size"), F.lit(LIST)) if sizes is not None else F.lit(LIST)
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "w"))
    return best.withColumn("r", rank).where(F.col("r") <= size).select("u", "w", "s")


def neighbour_graph(nodes: DataFrame, n: int, scratch: Scratch, trees: range, given: DataFrame | None = None) -> DataFrame:
    """(u, w, s): directed lists of nearest nodes; nodes (id, h)."""
    leaves = _trees(nodes, n, trees).select("tree", "code", "leaf", "id", "h")
    start = over_runs(leaves, ["tree", "code", "leaf"], _leaf_edges, EDGE)
    graph, sizes = scratch.save(_top(start.union(given) if given is not None else start, None)), None
    for _ in range(ROUNDS):
        lists = graph.groupBy("u").agg(F.count("*").alias("n"), F.min("s").alias("last"))
        if sizes is not None:
            lists = lists.join(sizes, "u", "left")
        size = F.coalesce(F.col("size"), F.lit(LIST)) if sizes is not None else F.lit(LIST)
        full = F.col("n") >= size
        saturated = full & (F.col("last") >= COSINE - SLACK) & (size < MAX_LIST)
        lists = lists.select("u", F.when(saturated, size * 2).otherwise(size).alias("size"), F.when(full & ~saturated, F.col("last")).otherwise(F.lit(FLOOR)).cast("float").alias("least"))
        lists = scratch.save(lists)
        sizes = lists.select("u", "size")
        # those whose neighbour a node is, the nearest of them, as many as its own list holds
        back = _top(graph.select(F.col("w").alias("u"), F.col("u").alias("w"), "s"), sizes)
        meet = graph.select("u", "w").union(back.select("u", "w")).union(sizes.select("u", F.col("u").alias("w"))).distinct()
        known = nodes.select(F.col("id").alias("w"), "h").join(lists.select(F.col("u").alias("w"), "least"), "w", "left")
        met = meet.join(known, "w").select("u", "w", "h", F.coalesce("least", F.lit(FLOOR).cast("float")).alias("least"))
        found = over_runs(met, ["u"], _local_join, EDGE)
        nxt = scratch.save(_top(graph.union(found), sizes))
        changed = nxt.join(graph.select("u", "w"), ["u", "w"], "left_anti").count()
        before = nxt.count()
        scratch.drop(graph)
        graph = nxt
        if changed <= SETTLED * before:
            break
    return graph


def _verify(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (u, w) whose cosine in double precision reaches the threshold, as edges (a, b)."""
    x = nodes.select(F.col("id").alias("u"), F.col("v").alias("x"))
    y = nodes.select(F.col("id").alias("w"), F.col("v").alias("y"))

    def exact(b: pa.RecordBatch) -> pa.RecordBatch:
        cos = [float(np.frombuffer(p) @ np.frombuffer(q)) if len(p) == len(q) else -2.0 for p, q in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        return b.filter(pa.array(np.array(cos) >= COSINE)).select([0, 1]).rename_columns(["a", "b"])

    both = pairs.join(x, "u").join(y, "w").select("u", "w", "x", "y")
    return over_batches(both, exact, "a long, b long")


def _count_links(g: pa.RecordBatch) -> pa.RecordBatch:
    """Linked vectors of each node of two blocks of a component (or of one against itself)."""
    col = lambda name: g.column(g.schema.get_field_index(name))
    ids, mine, mult, x = col("id").to_numpy(), col("mine").to_numpy(), col("n").to_numpy().astype(np.int64), rows_of(col("v"), np.float64)
    lo, hi = col("lo").to_numpy()[0], col("hi").to_numpy()[0]
    out = np.zeros(len(ids), np.int64)
    a, b = (np.arange(len(ids)),) * 2 if lo == hi else (np.flatnonzero(mine == lo), np.flatnonzero(mine == hi))
    for i in range(0, len(a), 256):
        own = a[i : i + 256]
        linked = x[own] @ x[b].T >= COSINE
        if lo == hi:
            linked[np.arange(len(own)), own] = False
        out[own] += linked @ mult[b]
        if lo != hi:
            out[b] += mult[own] @ linked
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(out)], ["id", "links"])


def count_links(nodes: DataFrame, comp: DataFrame) -> DataFrame:
    """(id, links): for each node in a component of several, the vectors of other nodes in it that it links with."""
    sizes = comp.groupBy("root").agg(F.ceil(F.count("*") / COUNT_BLOCK).cast("int").alias("blocks"))
    at = nodes.join(comp, nodes.id == comp.node).join(sizes, "root").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    at = at.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    at = at.select("root", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "id", "mine", "n", "v")
    return over_runs(at, ["root", "lo", "hi"], _count_links, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def exact_edges(asked: DataFrame, nodes: DataFrame, comp: DataFrame) -> DataFrame:
    """Edges (a, b) that join different components, of the links of asked (id) with all nodes (id, v), block by block."""
    wide = 4 * COUNT_BLOCK
    rows, cols = (max(1, math.ceil(x.count() / size)) for x, size in ((asked, COUNT_BLOCK), (nodes, wide)))
    known = comp.select(F.col("node").alias("id"), "root")
    at = nodes.select("id", "v").join(known, "id", "left").select("id", "v", F.coalesce("root", "id").alias("root"))
    own, every = F.pmod(F.xxhash64("id"), F.lit(rows)), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(cols))
    left = at.join(asked.select("id"), "id", "left_semi").select(own.alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cols - 1).cast("long"))).alias("j"), "id", "v", "root", F.lit(1).alias("side"))
    right = at.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows - 1).cast("long"))).alias("i"), every.alias("j"), "id", "v", "root", F.lit(0).alias("side"))

    def run(g: pa.RecordBatch) -> pa.RecordBatch:
        ids, v, root, side = g.column(2).to_numpy(), g.column(3), g.column(4).to_numpy(), g.column(5).to_numpy()
        size, a, b = _sizes(v), [], []
        for d in np.unique(size[side == 1]).tolist():
            i, j = np.flatnonzero((side == 1) & (size == d)), np.flatnonzero((side == 0) & (size == d))
            if len(j):
                y = rows_of(v.take(pa.array(j)), np.float64)
                for k in range(0, len(i), 256):
                    q = i[k : k + 256]
                    p, o = np.nonzero((rows_of(v.take(pa.array(q)), np.float64) @ y.T >= COSINE) & (root[q][:, None] != root[j]))
                    a.append(ids[q[p]])
                    b.append(ids[j[o]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (a, b)], ["a", "b"])

    return over_runs(left.union(right), ["i", "j"], run, "a long, b long")


def audit(nodes: DataFrame, links: DataFrame, sample: int = AUDIT) -> float:
    """Of a hashed sample of nodes, the mean share of a node's links, counted by brute force, that were found.

    The lesser of that of all and that of nodes with few links, so that a large group doesn't hide what pairs lose.
    """
    spark = nodes.sparkSession
    asked = nodes.select("id", "v").orderBy(F.xxhash64("id", F.lit(7))).limit(sample).collect()
    if not asked:
        return 1.0
    got = spark.sparkContext.broadcast([(r.id, bytes(r.v)) for r in asked])

    def brute(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, raw, mult = b.column(0).to_numpy(), b.column(1).to_pylist(), b.column(2).to_numpy()
        q, n = [], []
        for d in {len(v) for v in raw}:
            own = np.array([i for i, v in enumerate(raw) if len(v) == d])
            x = np.stack([np.frombuffer(raw[i]) for i in own])
            for i, v in got.value:
                if len(v) == d:
                    hit = (x @ np.frombuffer(v) >= COSINE) & (ids[own] != i)
                    if hit.any():
                        q.append(i)
                        n.append(int(mult[own][hit].sum()))
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(n, pa.int64())], ["id", "true"])

    true = over_batches(nodes.select("id", "v", "n"), brute, "id long, true long").groupBy("id").agg(F.sum("true").alias("true"))
    share = F.least("true", F.coalesce("links", F.lit(0))) / F.col("true")
    r = true.join(links, "id", "left").agg(F.avg(share).alias("all"), F.avg(F.when(F.col("true") <= LIST, share)).alias("few")).first()
    return min(1.0 if x is None else x for x in (r["all"], r["few"]))


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of vectors (vec_id, embedding, any other columns).

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and so do rows without
    vec_id (their component and kept are null). Vectors of different lengths don't link. Repeated rows of a vec_id with
    one vector are one vector, and come back as often as they are given. No rows, no result.
    """
    scratch = Scratch(vectors.sparkSession)
    given = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    ready = scratch.save(over_batches(given, _prepare, "vec_id long, k1 long, k2 long, v binary, h binary"))
    ids = ready.select("vec_id", "k1", "k2").distinct()
    nodes = ready.groupBy("k1", "k2").agg(F.min("vec_id").alias("id"), F.countDistinct("vec_id").alias("n"), F.first("v").alias("v"), F.first("h").alias("h"))
    # a vec_id that has several vectors could be the name of two nodes: the pair of hash and id names it
    nodes = scratch.save(nodes.select("k1", "k2", F.col("id").alias("least"), F.xxhash64("k1", "k2", "id").alias("id"), "n", "v", "h"))
    n, graph, links, comp = nodes.count(), None, None, None
    trees, slim = trees_of(n), nodes.select("id", "n", "v")
    for attempt in range(RETRIES + 1):
        graph = neighbour_graph(nodes.select("id", "h"), n, scratch, range(attempt * trees, (attempt + 1) * trees), graph)
        near = graph.where(F.col("s") >= COSINE - SLACK).select(F.least("u", "w").alias("u"), F.greatest("u", "w").alias("w")).distinct()
        edges = scratch.save(_verify(near, nodes))
        comp = connected_components(edges, scratch)
        # a list of nothing but links may have lost one to another component: such nodes, and those without a list, are held against all
        lists = graph.groupBy("u").agg(F.min("s").alias("last")).where(F.col("last") < COSINE - SLACK)
        hidden = scratch.save(nodes.select("id").join(lists, nodes.id == lists.u, "left_anti"))
        edges = scratch.save(edges.union(exact_edges(hidden, slim, comp)))
        comp = connected_components(edges, scratch)
        links = scratch.save(count_links(slim, comp))
        if audit(nodes, links) >= MIN_RECALL:
            break
    else:  # what rounds don't find is searched exactly
        comp = connected_components(edges.union(exact_edges(slim, slim, comp)), scratch)
        links = scratch.save(count_links(slim, comp))
    of = nodes.join(comp, nodes.id == comp.node, "left").join(links, "id", "left")
    of = of.select("k1", "k2", "least", F.coalesce("root", "id").alias("root"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    found = of.join(least, "root").select("k1", "k2", "n_links", "component_id").join(ids, ["k1", "k2"])
    found = found.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = given.select("vec_id").join(scratch.save(found), "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
