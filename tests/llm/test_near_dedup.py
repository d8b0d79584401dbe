"""The pipeline's near-duplicate stage against brute force over all pairs."""

import itertools

import numpy as np
import pytest

import corpus_pipeline
from gatelens.llm import shingles, simhash


def by_hand(rows):
    """Texts of the rows that stay, of five-word shingle sets with a Jaccard similarity of at least 0.8."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        s, t = sets[a], sets[b]
        if s == t or (s and t and 10 * len(s & t) >= 8 * len(s | t)):
            up[root(a)] = root(b)
    out = []
    for c in {root(i) for i in range(len(rows))}:
        own = [i for i in range(len(rows)) if root(i) == c]
        ids = [rows[i][0] for i in own if rows[i][0] is not None]
        out += [(min(ids), c)] if ids else [(None, c)] * len(own)
    return sorted(out, key=repr), root


@pytest.mark.parametrize("hubs", [4, 1])
def test_stage_is_brute_force(spark, monkeypatch, hubs):
    monkeypatch.setattr(shingles, "HUBS", hubs)
    monkeypatch.setattr(shingles, "BLOCK", 16)
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for k in range(25):
        base = list(rng.choice(vocabulary, int(rng.integers(20, 200))))
        rows.append((len(rows), " ".join(base)))
        for _ in range(5):
            w = list(base)
            for at in rng.choice(len(w), max(1, int(len(w) * rng.uniform(0, 0.04))), replace=False):
                w[at] = "changed" + str(rng.integers(1000))
            rows.append((len(rows), " ".join(w)))
    opening = "the same opening words of a letter to you all " * 2
    rows += [(len(rows) + k, opening + " ".join(rng.choice(vocabulary, 12))) for k in range(12)]
    rows += [(900, ""), (901, None), (902, "short one"), (903, "Short  one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS key", "1 AS n", "2 AS _key", "3 AS _id", "4 AS row", "5 AS id", "6 AS root")
    want, _ = by_hand(rows)
    got = corpus_pipeline.keep_one_copy(spark, df, "")
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i, _ in want)
    assert len(want) < len(rows) - 50
    assert corpus_pipeline.keep_one_copy(spark, df.where("false"), "").count() == 0


@pytest.mark.parametrize("similarity", [None, 0.8])
def test_rows_without_id_and_repeated_ids(spark, similarity):
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(40)) for k in "abcd")
    rows = [(None, a), (None, a), (1, b), (None, b), (2, c), (2, d), (2, d), (5, d)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, simhash.keep_one(df, 5, similarity).collect()), key=repr)
    assert got == sorted([(None, a), (None, a), (1, b), (2, c), (2, d)], key=repr)
