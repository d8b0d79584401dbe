"""Crowded buckets against plain counts, and how many rows are dealt to find them."""

import numpy as np
from gatelens.llm import imagedesc
from gatelens.llm.common import Scratch


def test_crowded_buckets(spark, monkeypatch):
    monkeypatch.setattr(imagedesc, "SMALL", 20)
    rng = np.random.default_rng(4)
    rows = [(int(k), int(c)) for k, c in zip(rng.integers(0, 5000, 3000), rng.integers(0, 50, 3000), strict=True)]
    rows += [(7000, int(c)) for c in rng.integers(0, 50, 60)] + [(7001, 3)] * 40 + [(7002, int(c)) for c in range(20)] + [(7003, int(c)) for c in range(21)]
    held = spark.createDataFrame(rows, "key long, comp long")
    want = {k: len({c for x, c in rows if x == k}) > 1 for k in {k for k, _ in rows} if sum(x == k for x, _ in rows) > 20}
    assert len(want) >= 3
    for bins in (1 << 16, 3):  # with bins that many buckets share too
        monkeypatch.setattr(imagedesc, "BINS", bins)
        assert {r.key: r.mixed for r in imagedesc.crowded_buckets(held, Scratch(spark)).collect()} == want


def test_shuffles_of_finished_steps_are_released(spark, monkeypatch):
    from gatelens.llm import media

    done = []
    monkeypatch.setattr(Scratch, "release", lambda self: done.append(self.n))
    rng = np.random.default_rng(1)
    vectors = spark.createDataFrame([(i, rng.standard_normal(16).tolist()) for i in range(12)], "vec_id long, embedding array<double>")
    assert imagedesc.image_copies(media.drawn(vectors)).count() == 12
    assert len(done) >= 4  # after each exact check, and before and after buckets are compared
