"""The fingerprints of the pipeline's near-duplicate stage: links that they give against a plain loop, and links they cannot."""

import itertools

import numpy as np
import xxhash

import corpus_pipeline
from gatelens.llm import shingles, simhash
from gatelens.llm.common import Scratch
from gatelens.llm.components import connected_components


def plain(text):
    """The set of five-word shingles and the majority of the bits of their hashes."""
    w = text.lower().split()
    grams = {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return grams, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def corpus(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(12):
        base = list(rng.choice(vocabulary, int(rng.integers(150, 900))))
        out.append(" ".join(base))
        for changes in (1, 1, 2, 6):
            w = list(base)
            for at in rng.choice(len(w), changes, replace=False):
                w[at] = f"changed{rng.integers(1000)}"
            out.append(" ".join(w))
    return out, spark.createDataFrame(list(enumerate(out)), "doc_id long, text string")


def test_near_fingerprints_link(spark, monkeypatch):
    texts, docs = corpus(spark)
    known = [plain(t) for t in texts]
    scratch = Scratch(spark)
    rows = scratch.save(shingles.keyed(docs.selectExpr("doc_id AS id", "struct(*) AS row"), 5))
    of = {r.id: (r._key, r._fp) for r in rows.collect()}
    assert [of[i][1] % 2**64 for i in range(len(texts))] == [f for _, f in known]
    for hot in (512, 0):  # with every anchor split as well
        monkeypatch.setattr(simhash.links, "__defaults__", (hot, 2))
        edges = simhash.near_classes(rows, 3, scratch)
        comp = {r.node: r.root for r in connected_components(edges, scratch).collect()}
        found, three = 0, 0
        for i, j in itertools.combinations(range(len(texts)), 2):
            f, g = known[i][1], known[j][1]
            if (f ^ g).bit_count() <= 3:
                a, b = of[i][0], of[j][0]
                assert comp.get(a, a) == comp.get(b, b)
                found, three = found + 1, three + ((f ^ g).bit_count() == 3)
        assert found > 10 and three > 0
        key = {k: i for i, (k, _) in of.items()}
        for r in edges.collect():
            assert (known[key[r.a]][1] ^ known[key[r.b]][1]).bit_count() <= 3


def test_stage_takes_fingerprints_and_loses_no_link(spark, monkeypatch):
    texts, docs = corpus(spark)
    known = [plain(t) for t in texts]
    asked, linked = [], simhash.links

    def seen(fps, scratch, *args, **named):
        asked.append((sorted(r.fp % 2**64 for r in fps.collect()), named))
        return linked(fps, scratch, *args, **named)

    monkeypatch.setattr(simhash, "links", seen)
    got = {r.doc_id for r in corpus_pipeline.keep_one_copy(spark, docs, "").collect()}
    assert asked == [(sorted({f for _, f in known}), {"bits": 3})]
    near = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if 10 * len(known[i][0] & known[j][0]) >= 8 * len(known[i][0] | known[j][0])]
    assert max((known[i][1] ^ known[j][1]).bit_count() for i, j in near) > 3  # no anchor covers these
    up = list(range(len(texts)))
    for _ in texts:
        for i, j in near:
            up[i] = up[j] = min(up[i], up[j])
    assert got == set(up)
