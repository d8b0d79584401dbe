"""Threshold policies against plain numpy versions, group by group."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatelens.operators import signals, thresholds, windows


def groups(seed=3):
    rng = np.random.default_rng(seed)
    out = {}
    for k in range(4):
        x = rng.gamma(2.0, 10.0, 400) if k else np.concatenate([rng.normal(10, 1, 380), rng.uniform(20, 60, 20)])
        out[f"g{k}"] = x
    out["tied"] = np.repeat([1.0, 2.0, 3.0], 40)
    out["few"] = np.array([1.0, 2.0, 3.0])
    out["zeros"] = np.zeros(60)
    return out


@pytest.fixture(scope="module")
def data(spark):
    g = groups()
    rows = [(k, i, float(v)) for k, x in g.items() for i, v in enumerate(x)] + [("g0", 900, None), ("g1", 901, float("nan")), ("g2", 902, float("inf"))]
    return g, spark.createDataFrame(rows, "g string, id long, value double")


def sigma(v):
    m = np.median(v)
    for s in (1.4826 * np.median(abs(v - m)), (np.quantile(v, 0.75) - np.quantile(v, 0.25)) / 1.349, 0.7413 * (np.quantile(v, 0.9) - np.quantile(v, 0.1))):
        if s > 1e-12:
            return s
    return None


def curve(v, low, high, points):
    grid = low + np.arange(points) * ((high - low) / (points - 1))
    share = np.array([(v >= g).mean() for g in grid])
    smooth = np.convolve(np.log(np.maximum(share, 1e-12)), np.array([1, 2, 3, 2, 1]) / 9, mode="same")
    d1 = np.gradient(smooth)
    return grid, share, d1, np.gradient(d1)


def exceptional(v, start):
    tail = np.sort(v[v >= start])
    q = np.quantile(tail, 0.90)
    if len(tail) < 24:
        out = min(max(start + 0.05 * max(tail[-1] - start, 1e-12), q), tail[-1])
        return out if out > start + 1e-12 else None
    high = np.quantile(tail, 0.999)
    high = high if high > start + 1e-12 else tail[-1]
    if high <= start + 1e-12:
        return None
    grid, share, d1, d2 = curve(tail, start, high, 140)
    ok = (share > 1 / len(tail)) & (share < 0.8)
    ok = ok if ok.sum() >= 8 else np.ones_like(ok)
    s = []
    for d in (d1, d2):
        mad = 1.4826 * np.median(abs(d[ok] - np.median(d[ok])))
        s.append(mad if mad > 1e-12 else d[ok].std())
    if min(s) <= 1e-12:
        return None
    flat = (abs(d1) <= s[0]) & (abs(d2) <= s[1]) & (grid >= start + 0.05 * (high - start))
    for i in range(len(flat) - 3):
        if flat[i : i + 4].all():
            return grid[i] if grid[i] > start + 1e-12 else None
    out = min(max(start + 0.05 * (high - start), q), high)
    return out if out > start + 1e-12 else None


def test_exceptional(data):
    g, df = data
    tails = thresholds.quantile_tail_policy(df, ["g"], "value", 0.2)
    got = {r.g: r.exceptional for r in thresholds.exceptional(df, ["g"], "value", tails).collect()}
    for k, x in g.items():
        want = exceptional(x, np.quantile(x, 0.8))
        assert (got[k] is None) == (want is None) and (want is None or got[k] == pytest.approx(want, abs=1e-9)), k


def test_gaps_and_bends(data):
    g, df = data
    jumps = {r.g: r for r in windows.gap_jump(df, ["g"], "value", "id").collect()}
    bends = {r.g: r.knee for r in windows.tail_start(df, ["g"], "value").collect()}
    for k, x in g.items():
        z = np.sort(x)
        gap, n = np.diff(z), len(z)
        s = (n - np.arange(1, n)) / n
        top = min(0.95, max(0.30, (z > 0).mean() + 0.05))
        ok = (gap > 0) & (s >= 0.005) & (s <= top)
        ok = ok if ok.sum() >= 5 else (gap > 0) & (s >= 0.0025) & (s <= min(0.98, top + 0.1))
        if n < 40 or ok.sum() < 5 or sigma(gap[ok]) is None:
            assert k not in jumps
        else:
            gz = (gap - np.median(gap[ok])) / sigma(gap[ok])
            strong = np.flatnonzero(ok & (gz >= 4))
            i = strong[0] if len(strong) else np.flatnonzero(ok)[gz[ok].argmax()]
            want = z[i + 1] if gz[i] >= 2.5 else None
            assert jumps[k].jump == (want if want is None else pytest.approx(want)) and jumps[k].gap_z == pytest.approx(gz[i])
        if n < 40 or np.quantile(z, 0.995) <= 0:
            assert k not in bends
            continue
        grid, share, _, d2 = curve(z, 0.0, np.quantile(z, 0.995), 160)
        near = (share >= 0.005) & (share <= 0.30) & (grid >= 0.5)
        near = near if near.sum() >= 5 else (share >= 0.0025) & (share <= 0.5) & (grid >= 0.5)
        if near.sum() >= 5:
            at = min(np.flatnonzero(near), key=lambda i: (round(d2[i], 12), i))
            assert bends[k] == pytest.approx(grid[at])
        else:
            assert bends.get(k) is None


def test_hybrid_states(data):
    g, df = data
    th = {r.g: r for r in thresholds.hybrid(df, ["g"], "value", "id").collect()}
    states = thresholds.apply_states(df, thresholds.hybrid(df, ["g"], "value", "id"), ["g"], "value").collect()
    assert th["few"].source == "insufficient_support" and th["few"].fail is None
    assert th["zeros"].fail > 0  # zeros don't fail
    for r in states:
        t = th[r.g]
        if r.value is None or not np.isfinite(r.value) or t.fail is None:
            assert r.state == "na"
            continue
        want = "hard_fail" if r.value >= t.hard else "fail" if r.value >= t.fail else "warn" if r.value > t.warn or r.value < t.warn_low else "pass"
        assert r.state == want
    for k in ("g0", "g1"):
        assert th[k].warn <= th[k].fail <= th[k].hard
    by_jump = thresholds.hybrid(df.withColumn("f", F.col("value") % 7), ["g"], "value", "id", features=["f"]).collect()
    assert {r.source for r in by_jump} <= {"tail_start", "stability_jump", "quantile_guard", "insufficient_support"}


def test_ordered_spans_ranges(spark):
    rng = np.random.default_rng(5)
    rows = [(None if i % 5 == 0 else i % 2, float(rng.integers(0, 40)), i, float(rng.random())) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, v double, id long, w double")
    got = windows.ordered(df, ["g"], "v", "id", "w").collect()
    assert len(got) == len(rows)
    for k in (None, 0, 1):
        own = sorted((r for r in got if r.g == k), key=lambda r: (r.v, r.id))
        run = np.cumsum([r.w for r in own])
        for i, r in enumerate(own):
            assert r._i == i + 1 and r._n == len(own) and r._next == (own[i + 1].v if i + 1 < len(own) else None) and r._run == pytest.approx(run[i]) and r._total == pytest.approx(run[-1])


def test_aux_residual(spark):
    rng = np.random.default_rng(1)
    rows = [(k, i, *map(float, rng.random(3))) for k in ("a", "b") for i in range(50)] + [("c", i, 1.0 * i, 0.5, 0.2) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, id long, s double, direction_signal double, length_signal double")
    for poly in (False, True):
        got = {(r.g, r.id): r.s for r in signals.aux_residual(df, "id", ["g"], "s", poly=poly).collect()}
        for k in ("a", "b"):
            own = [r for r in rows if r[0] == k]
            x = np.array([[1, d, e] + ([d * d, e * e, d * e] if poly else []) for _, _, _, d, e in own])
            y = np.array([r[2] for r in own])
            res = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
            m = np.median(res)
            z = (res - m) / (1.4826 * np.median(abs(res - m)) + 1e-6)
            for r, w in zip(own, y + 0.1 * np.maximum(z, 0), strict=True):
                assert got[r[0], r[1]] == pytest.approx(w, abs=1e-7)
        assert all(got["c", i] == i for i in range(5))
