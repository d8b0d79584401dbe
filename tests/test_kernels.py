"""Vector operators against direct numpy: embeddings, covariances, ridge members, axes."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

from gatelens.operators import kernels, ridge, signals
from gatelens.sources import embedders


def test_hashing(spark):
    texts = ["A a b Ünï", "", None, "the the the"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(signals.hash_embed_768("t")).collect()]
    for t, v in zip(texts, got, strict=True):
        want = np.zeros(768)
        for w, n in Counter(re.findall(r"\w+", (t or "").lower())).items():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            want[h % 768] += (1.0 if h < 2**63 else -1.0) * (1 + math.log(n))
        assert np.allclose(v, want)
    e = embedders.make("hash", dim=100)
    assert e.name == "hash:100" and e.encode(["x"]).shape == (1, 100) and embedders.make("auto", "m").name.startswith(("hash", "sentence"))
    out = embedders.embed(spark.createDataFrame([(1, "a b"), (2, None)], "id long, t string"), {"v": "t"}, e, "id").collect()
    assert np.linalg.norm(out[0].v) == pytest.approx(1) and not any(out[1].v)


def test_mahalanobis_is_direct():
    rng = np.random.default_rng(0)
    for k, p in ((20, 6), (10, 30), (3, 4)):
        near, point, w = rng.standard_normal((k, p)), rng.standard_normal(p), rng.random(k) + 0.1
        for weights in (None, w):
            mean = np.average(near, axis=0, weights=weights)
            c = kernels.shrunk_covariance(near - mean, weights) + 1e-6 * np.eye(p)
            want = math.sqrt((point - mean) @ np.linalg.inv(c) @ (point - mean))
            assert kernels.mahalanobis(near, point, weights) == pytest.approx(want, rel=1e-6)
    assert kernels.mahalanobis(np.array([[0.0, 0.0], [2.0, 2.0]]), np.array([1.0, 1.0])) == pytest.approx(0)


def test_ridge_kernels():
    rng = np.random.default_rng(0)
    x, w = rng.standard_normal((200, 4)), rng.random(200)
    b = rng.standard_normal((4, 3))
    y = x @ b + 2 + 0.01 * rng.standard_normal((200, 3))
    coef, bias = kernels.weighted_ridge(x, y, 1e-6, w)
    assert np.allclose(coef, b, atol=0.01) and np.allclose(bias, 2, atol=0.01)
    assert np.linalg.matrix_rank(kernels.low_rank(coef, 2)) == 2
    k = kernels.rbf(x[:5], x[:5], 0.3)
    assert np.allclose(k, [[math.exp(-0.3 * ((a - c) ** 2).sum()) for c in x[:5]] for a in x[:5]])
    root = kernels.nystroem(x[:50], 0.3)
    f = kernels.rbf(x[:50], x[:50], 0.3) @ root
    assert np.allclose(f @ f.T, kernels.rbf(x[:50], x[:50], 0.3), atol=1e-3)
    d = ((x[:, None] - x[None]) ** 2).sum(2)[np.triu_indices(200, 1)]
    assert kernels.gamma_of(x) == pytest.approx(1 / (2 * np.median(d)), rel=1e-9)
    s = np.array([[1.0, 5.0], [2.0, 0.0]])
    assert np.allclose(kernels.fuse(s, np.ones(2), np.array([1.0, 1.0]), "max"), np.maximum((s - 1) / 1.4826, 0).max(0))
    assert kernels.projection(4, 8, 1) is None and kernels.projection(8, 4, 1).shape == (8, 4)
    assert list(kernels.cosine_residual(np.array([[1.0, 0], [0, 0], [1, 0]]), np.array([[1.0, 0], [0, 0], [0, 1]]))) == [0, 0, 1]


@pytest.mark.parametrize("n", [60, 400])
def test_ensemble_sees_what_lines_don_t(spark, n):
    """Offsets follow a bent function of the input; rows that break it score highest."""
    rng = np.random.default_rng(2)
    x = rng.uniform(-2, 2, (n, 3))
    y = np.column_stack([np.sin(2 * x[:, 0]), np.cos(x[:, 1] * 2), x[:, 2]]) + 0.05 * rng.standard_normal((n, 3))
    odd = list(range(0, n, n // 6))
    y[odd] = -y[odd]
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, d array<double>")
    got = {r.id: r.delta_ridge for r in ridge.ensemble_signal(df, "id", "x", "d").collect()}
    assert len(got) == n and min(got.values()) >= 0
    if n > 100:
        assert np.median([got[i] for i in odd]) > 2 * np.median(list(got.values()))
    assert ridge.ensemble_signal(df.where("false"), "id", "x", "d").count() == 0


def test_axes(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 12)) * np.array([9, 7, 5, 3, 1, 1, 0.5, 0.5, 0.1, 0.1, 0.1, 0.1])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = np.array([r.coordinates for r in signals.pca(df, "id", "v", 2).orderBy("id").collect()])
    c = x - x.mean(0)
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2]), atol=1e-6)
    few = signals.reduced(df, "id", "v", 0.9, 2, 64).first().coordinates
    share = np.cumsum(s**2) / (s**2).sum()
    assert len(few) == int(np.searchsorted(share, 0.9) + 1)
