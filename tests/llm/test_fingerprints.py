"""Fingerprints and components of the SimHash query against a plain loop."""

import itertools
import re

import numpy as np
import xxhash

from gatelens.llm import simhash


def plain(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_query_is_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(50)] + ["ÉÀ", "Big", "x y"]
    texts = ["", None, " \t\n", "one", "one Two", "ONE two", " ", "a b c"]
    for _ in range(25):
        w = list(rng.choice(words, int(rng.integers(3, 400))))
        texts += [" ".join(w), "\n".join(w), " ".join([*w[:-1], "other"]), " ".join(w).upper()]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "one"), (None, "one"), (900, "q " * 5000)]
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp")).collect()
    assert len(out) == len(rows)
    fp = {i: plain(t) for i, t in rows if i is not None}
    up = {i: i for i in fp}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(fp), 2):
        if (fp[a] ^ fp[b]).bit_count() <= 2:
            up[max(root(a), root(b))] = min(root(a), root(b))
    for r in out:
        if r.doc_id is not None:
            assert r.fp % 2**64 == fp[r.doc_id] and r.component_id == root(r.doc_id)
        else:
            assert r.component_id == root(3)
