"""Near vectors whose link is not among a node's nearest, or whose node meets no near one at the start."""

import numpy as np

from gatelens.llm import nndescent
from gatelens.llm.common import Scratch


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def test_every_node_has_a_full_list(spark):
    x = unit(np.random.default_rng(1).standard_normal((300, 64)))  # all far apart
    rows = [(i, v.astype(np.float16).tobytes()) for i, v in enumerate(x)]
    graph = nndescent.neighbour_graph(spark.createDataFrame(rows, "id long, h binary"), len(rows), Scratch(spark), range(4))
    got = {r.u: r["count"] for r in graph.groupBy("u").count().collect()}
    assert len(got) == len(rows) and min(got.values()) == nndescent.LIST
    assert nndescent.trees_of(10_000_000) > nndescent.trees_of(10_000) > nndescent.TREES


def test_link_between_two_dense_groups(spark):
    rng = np.random.default_rng(3)
    a = np.zeros(64)
    a[0] = 1
    b = np.zeros(64)
    b[:2] = 0.8, 0.6
    # each group is dense at its own centre; only the two bridges, each with over 64 nearer ones, link across
    away = np.array([a + 0.0 * a] * 90), np.array([b] * 90)
    turn = lambda t: np.concatenate([[np.cos(t), np.sin(t)], np.zeros(62)])
    end = np.arccos(0.8)
    groups = [unit(g + 0.004 * rng.standard_normal(g.shape)) for g in away]
    bridges = np.array([turn(end / 2 - 0.155), turn(end / 2 + 0.155)])
    x = np.concatenate([*groups, bridges])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    linked = x @ x.T >= nndescent.COSINE
    assert linked[180, 181] and linked[:90, 180].all() and linked[90:180, 181].all() and not linked[:90, 90:180].any() and not linked[:90, 181].any() and not linked[90:180, 180].any()
    nearer = (x @ x[180] > x[180] @ x[181]).sum() - 1
    assert nearer > nndescent.MAX_LIST
    out = nndescent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.component_id for r in out} == {0}
    assert all(r.n_links == linked[r.vec_id].sum() - 1 for r in out)
