"""Threshold policies and calibration on long signal tables: one pass over any number of groups and rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelens.functions.scalar import finite, tail_trigger
from gatelens.operators import stats, windows
from gatelens.sources.scratch import saved, with_group

ROBUST_K, MAX_K, FLOOR_K = 3.5, 8.0, 0.5


def robust_z_policy(df: DataFrame, by: list[str], value: str, k: float = ROBUST_K) -> DataFrame:
    """by, median, sigma, source, threshold: median + k sigma by the scale ladder; null for a flat signal."""
    s = stats.scale_ladder(df, by, value)
    return s.withColumn("threshold", F.when(F.col("sigma") > 0, F.col("median") + k * F.col("sigma")))


def quantile_tail_policy(df: DataFrame, by: list[str], value: str, q: float = 0.005) -> DataFrame:
    x = df.withColumn("_x", finite(value)).where("_x is not null")
    return x.groupBy(*by).agg(F.count("*").alias("n"), F.percentile("_x", F.lit(1 - q)).alias("threshold"))


def tail_start_policy(df: DataFrame, by: list[str], value: str, order: str, k: float = ROBUST_K, floor: float = FLOOR_K, most: float | None = MAX_K) -> DataFrame:
    """by, median, sigma, knee, jump, gap_z, k, threshold: a strong gap, else the larger of bend and gap, within bounds; else k.

    The bend's window of survival reaches to the share of positive z and 0.05, as the gap's does. Flat groups have no threshold.
    """
    s = saved(stats.scale_ladder(df, by, value).select(*by, "median", "sigma"))
    z = with_group(df.select(*by, value, order), s, by, "inner").withColumn("_zz", (finite(value) - F.col("median")) / F.col("sigma")).where("sigma > 0")
    z = saved(z.select(*by, "_zz", order).where("_zz >= 0"))
    gap = windows.gap_jump(z, by, "_zz", order).select(*by, "jump", "gap_z", "kind")
    knee = windows.tail_start(z, by, "_zz", raise_most=True).select(*by, "knee")
    out = with_group(with_group(s, gap, by), knee, by)
    pick = F.when(F.col("kind") == "strong_first", F.col("jump")).otherwise(F.greatest("knee", "jump"))
    bounded = F.greatest(F.lit(floor), pick) if most is None else F.least(F.lit(most), F.greatest(F.lit(floor), pick))
    out = out.withColumn("k", F.coalesce(F.when(pick.isNotNull(), bounded), F.lit(k)))
    return out.withColumn("threshold", F.when(F.col("sigma") > 0, F.col("median") + F.col("k") * F.col("sigma"))).drop("kind")


def core_thresholds(df: DataFrame, by: list[str], value: str, tails: DataFrame, kappa: float = 1.0, q: float = 0.85, least: int = 12) -> DataFrame:
    """by, core_median, core: of values up to the tail's start, median + kappa robust deviations; a quantile for few or flat ones."""
    x = df.join(tails.select(*by, F.col("threshold").alias("_t")), by).withColumn("_x", finite(value)).where("_x <= _t")
    m = x.groupBy(*by, "_t").agg(F.count("*").alias("_n"), F.median("_x").alias("core_median"), F.percentile("_x", F.lit(q)).alias("_q"))
    d = x.join(m.drop("_t"), by).groupBy(*by, "_t", "_n", "core_median", "_q").agg(F.median(F.abs(F.col("_x") - F.col("core_median"))).alias("_d"))
    s = 1.4826 * F.col("_d")
    core = F.when((F.col("_n") >= least) & (s > 1e-9), F.col("core_median") + kappa * s).otherwise(F.col("_q"))
    return d.select(*by, "core_median", F.least(core, F.col("_t")).alias("core"), s.alias("core_sigma"))


def exceptional(df: DataFrame, by: list[str], value: str, tails: DataFrame, least: int = 24, points: int = 140, q: float = 0.90, delta: float = 0.05, eps: float = 1e-12) -> DataFrame:
    """by, tail_rows, exceptional: where the log-survival of the tail has become flat; a quantile of the tail without such a run.

    Flat: first and second differences within a robust deviation of those of the grid points held by more than one row and
    less than 0.8 of them; all points count where fewer than eight are. Null where the tail has no extent.
    """
    x = with_group(df, tails.select(*by, F.col("threshold").alias("_t")), by, "inner").withColumn("_x", finite(value)).where("_x >= _t").select(*by, "_x", "_t")
    ends = x.groupBy(*by).agg(F.count("*").alias("_rows"), F.min("_t").alias("_low"), F.max("_x").alias("_max"), F.percentile("_x", F.array(F.lit(q), F.lit(0.999))).alias("_qs"))
    ends = saved(ends.withColumn("_high", F.when(F.col("_qs")[1] > F.col("_low") + eps, F.col("_qs")[1]).otherwise(F.col("_max"))))
    big = with_group(x.select(*by, "_x"), ends, by, "inner").where((F.col("_rows") >= max(8, least)) & (F.col("_high") > F.col("_low") + eps))
    g = with_group(windows.log_survival(big, by, "_x", points, F.min("_low"), F.max("_high")), ends, by)
    g = saved(g.withColumn("_in", (F.col("survival") > 1 / F.col("_rows")) & (F.col("survival") < 0.8)))
    some = g.groupBy(*by).agg((F.count_if("_in") >= 8).alias("_own"))
    valid = with_group(g, some, by).where(F.col("_in") | ~F.col("_own"))
    spread = None
    for d in ("d1", "d2"):
        m = valid.groupBy(*by).agg(F.median(d).alias("_m"), F.stddev_pop(d).alias("_sd"))
        s = with_group(valid, m, by).groupBy(*by).agg(F.median(F.abs(F.col(d) - F.col("_m"))).alias("_mad"), F.max("_sd").alias("_sd"))
        s = s.select(*by, F.when(1.4826 * F.col("_mad") > eps, 1.4826 * F.col("_mad")).otherwise(F.col("_sd")).alias(f"_{d}"))
        spread = s if spread is None else with_group(spread, s, by)
    g = with_group(g, spread, by)
    span = F.greatest(F.col("_high") - F.col("_low"), F.lit(eps))
    flat = (F.abs("d1") <= F.col("_d1")) & (F.abs("d2") <= F.col("_d2")) & (F.col("x") >= F.col("_low") + delta * span) & (F.col("_d1") > eps) & (F.col("_d2") > eps)
    run = windows.first_flat_run(g, by, flat).select(*by, F.col("x").alias("_run"))
    far = F.when(F.col("_rows") >= max(8, least), F.col("_high")).otherwise(F.col("_max"))
    fallback = F.least(F.greatest(F.col("_low") + delta * F.greatest(far - F.col("_low"), F.lit(eps)), F.col("_qs")[0]), far)
    out = with_group(with_group(ends, run, by), spread, by)
    broken = (F.col("_rows") >= max(8, least)) & ~F.coalesce((F.col("_d1") > eps) & (F.col("_d2") > eps), F.lit(False))
    value_ = F.when(broken, None).otherwise(F.coalesce("_run", fallback))
    return out.select(*by, F.col("_rows").alias("tail_rows"), F.when(value_ > F.col("_low") + eps, value_).alias("exceptional"))


def stability_cuts(df: DataFrame, by: list[str], value: str, features: list[str], shares: list[float]) -> DataFrame:
    """by, share, cut, flagged and the variance of each feature among rows at or above the cut of each share."""
    x = df.withColumn("_x", finite(value)).where("_x is not null")
    cuts = x.groupBy(*by).agg(F.percentile("_x", F.array(*[F.lit(1 - s) for s in shares])).alias("_c"))
    cuts = cuts.select(*by, F.posexplode("_c").alias("_i", "cut")).withColumn("share", F.element_at(F.array(*map(F.lit, shares)), F.col("_i") + 1)).drop("_i")
    j = with_group(x, cuts, by, "inner").where(F.col("_x") >= F.col("cut"))
    return j.groupBy(*by, "share", "cut").agg(F.count("*").alias("flagged"), *[F.var_pop(f).alias(f"var_{f}") for f in features])


def stability_jump_policy(df: DataFrame, by: list[str], value: str, features: list[str], shares: list[float]) -> DataFrame:
    """by, share, threshold: the cut before the largest jump of the mean of scaled variances."""
    c = stability_cuts(df, by, value, features, shares)
    w = Window.partitionBy(*by)
    parts = []
    for f in features:
        v = F.col(f"var_{f}")
        lo, hi = F.min(v).over(w), F.max(v).over(w)
        parts.append(F.coalesce(F.when(hi > lo, (v - lo) / (hi - lo)).otherwise(0.5), F.lit(1.0)))
    index = parts[0]
    for p in parts[1:]:
        index = index + p
    o = w.orderBy("share")
    c = c.withColumn("_index", index / len(parts))
    c = c.withColumn("_s", F.avg("_index").over(o.rowsBetween(-1, 1)))
    c = c.withColumn("_d", F.round(F.coalesce(F.col("_s") - F.lag("_s").over(o), F.lit(0.0)), 9)).withColumn("_p", F.row_number().over(o))
    best = c.groupBy(*by).agg((-F.max(F.struct("_d", (-F.col("_p")).alias("m")))["m"]).alias("_at"))
    at = F.greatest(F.lit(1), F.col("_at") - 1)
    return c.join(best, by).where(F.col("_p") == at).select(*by, "share", F.col("cut").alias("threshold"))


def directed(df: DataFrame, by: list[str], value: str, direction: str) -> DataFrame:
    """df's finite rows with _v, to be judged from above: the value, its negative, or its distance from the median; _mid."""
    x = df.withColumn("_x", finite(value)).where("_x is not null")
    if direction != "two_sided":
        return x.withColumn("_mid", F.lit(0.0)).withColumn("_v", -F.col("_x") if direction == "lower" else F.col("_x"))
    x = with_group(x, x.groupBy(*by).agg(F.median("_x").alias("_mid")), by)
    return x.withColumn("_v", F.abs(F.col("_x") - F.col("_mid")))


def _ends(t: Column, direction: str) -> list[Column]:
    """threshold, low and high of a limit on _v."""
    none = F.lit(None).cast("double")
    if direction == "two_sided":
        return [(F.col("_mid") + t).alias("threshold"), (F.col("_mid") - t).alias("low"), (F.col("_mid") + t).alias("high")]
    return [(-t if direction == "lower" else t).alias("threshold"), (-t if direction == "lower" else none).alias("low"), (none if direction == "lower" else t).alias("high")]


Policy = Callable[..., DataFrame]
POLICIES: dict[str, Policy] = {
    "robust_z": lambda x, by, v, order, **kw: robust_z_policy(x, by, v, kw.get("k", ROBUST_K)),
    "robust_z_tail_start": lambda x, by, v, order, **kw: tail_start_policy(x, by, v, order, kw.get("k", ROBUST_K), kw.get("floor", FLOOR_K), kw.get("most", MAX_K)),
    "quantile_tail": lambda x, by, v, order, **kw: quantile_tail_policy(x, by, v, kw.get("q", 0.005)),
    "dist_stability_jump": lambda x, by, v, order, **kw: stability_jump_policy(x, by, v, kw["features"], kw.get("shares", [i / 100 for i in range(1, 31)])),
}


def choose(df: DataFrame, by: list[str], value: str, order: str, policy: str, direction: str = "upper", rule: str = "", fallback: float = 0.995, **kw) -> DataFrame:
    """by, threshold, low, high, policy of a policy by name, on the upper, the lower or both tails; an unknown name is a quantile.

    The rule named output has no largest k. Both tails are judged by the distance from the median, the floor of k being 1.
    """
    x = saved(directed(df, by, value, direction).select(*by, "_v", "_mid", order, *kw.get("features", [])))
    if policy == "robust_z_tail_start":
        if rule.strip().lower() == "output":
            kw["most"] = None
        if direction == "two_sided":
            kw.setdefault("floor", 1.0)
    f = POLICIES.get(policy)
    t = f(x, by, "_v", order, **kw) if f else quantile_tail_policy(x, by, "_v", 1 - fallback)
    t = with_group(t.select(*by, F.col("threshold").alias("_t")), x.groupBy(*by).agg(F.max("_mid").alias("_mid")), by)
    return t.select(*by, *_ends(F.col("_t"), direction), F.lit(policy if f else "quantile_fallback").alias("policy"))


def tri_thresholds(df: DataFrame, by: list[str], value: str, fails: DataFrame, direction: str = "upper", kappa: float = 1.0, hard_ratio: float = 1.2) -> DataFrame:
    """by, warn, warn_low, warn_high, fail, hard, and for both tails fail_low and hard_low: the core's edge, the tail's start, and where it is exceptional, in order.

    fails (by, threshold, low, high) as of choose. Without an exceptional point, hard lies hard_ratio as far from the middle as fail.
    """
    x = saved(directed(df, by, value, direction).select(*by, "_v", "_mid", "_x"))
    mid = x.groupBy(*by).agg(F.max("_mid").alias("_mid"), F.median("_v").alias("_m"))
    limit = {"lower": -F.col("threshold"), "upper": F.col("threshold"), "two_sided": F.greatest(F.abs(F.col("_mid") - F.col("low")), F.abs(F.col("high") - F.col("_mid")))}[direction]
    t = saved(with_group(fails.select(*by, "threshold", "low", "high"), mid, by).withColumn("_t", limit).where("_t is not null").select(*by, F.col("_t").alias("threshold"), "_mid", "_m"))
    c, e = core_thresholds(x, by, "_v", t, kappa), exceptional(x, by, "_v", t).select(*by, "exceptional")
    out = with_group(with_group(t, c, by), e, by)
    below = F.col("threshold") - F.greatest(F.abs("threshold") * 1e-15, F.lit(1e-15))
    warn = F.least("core", below)
    high = F.least(F.coalesce(F.when(F.col("core_sigma") > 1e-9, F.col("core_median") + abs(kappa) * F.col("core_sigma")), F.col("core")), below)
    low = F.when(F.col("core_sigma") > 1e-9, F.col("core_median") - abs(kappa) * F.col("core_sigma")).otherwise(F.col("_least"))
    out = with_group(out, x.groupBy(*by).agg(F.min("_v").alias("_least")), by)
    centre = F.lit(0.0) if direction == "two_sided" else F.col("_m")
    far = centre + hard_ratio * F.abs(F.col("threshold") - centre)
    hard = F.greatest(F.coalesce("exceptional", far), F.col("threshold"))
    if direction == "two_sided":
        m = F.col("_mid")
        return out.select(*by, (m + warn).alias("warn"), (m - warn).alias("warn_low"), (m + warn).alias("warn_high"), (m + F.col("threshold")).alias("fail"), (m - F.col("threshold")).alias("fail_low"), (m + hard).alias("hard"), (m - hard).alias("hard_low"))
    sign = -1 if direction == "lower" else 1
    band = [(sign * low).alias("warn_low"), (sign * high).alias("warn_high")] if sign > 0 else [(-high).alias("warn_low"), (-low).alias("warn_high")]
    none = F.lit(None).cast("double")
    return out.select(*by, (sign * warn).alias("warn"), *band, (sign * F.col("threshold")).alias("fail"), none.alias("fail_low"), (sign * hard).alias("hard"), none.alias("hard_low"))


def hybrid(df: DataFrame, by: list[str], value: str, order: str, least: int = 8, quantile: float = 0.995, features: list[str] | None = None) -> DataFrame:
    """by, warn_low, warn, fail, hard, source: tail start; where it gives none, the jump of stability, if features are given; else a quantile.

    Core and exceptional values lie around it, in order. A threshold of zero moves to the next value above. Groups of too few
    rows have no thresholds.
    """
    t = tail_start_policy(df, by, value, order)
    n = df.withColumn("_x", finite(value)).where("_x is not null").groupBy(*by).agg(F.count("*").alias("_n"), F.percentile("_x", F.lit(quantile)).alias("_q"))
    t = with_group(t, n, by, "inner")
    ok = (F.col("_n") >= least) & F.col("threshold").isNotNull() & F.coalesce("knee", "jump").isNotNull()
    jump = F.lit(None).cast("double")
    if features:
        t = with_group(t, stability_jump_policy(df, by, value, features, [i / 100 for i in range(1, 31)]).select(*by, F.col("threshold").alias("_j")), by)
        jump = F.when(F.col("_n") >= least, F.col("_j"))
    t = t.withColumn("source", F.when(ok, "tail_start").when(jump.isNotNull(), "stability_jump").otherwise("quantile_guard"))
    t = t.withColumn("threshold", F.when(ok, F.col("threshold")).otherwise(F.coalesce(jump, F.col("_q"))))
    up = windows.neighbour_of_zero(df, by, value).select(*by, "next_up")
    t = with_group(t, up, by).withColumn("threshold", F.when(F.abs("threshold") <= 1e-12, F.coalesce("next_up", F.lit(1e-9))).otherwise(F.col("threshold")))
    few = F.col("_n") < least
    t = t.withColumn("threshold", F.when(~few, F.col("threshold"))).withColumn("source", F.when(few, "insufficient_support").otherwise(F.col("source")))
    t = saved(t.select(*by, "threshold", "source"))  # a row per group, read by what builds on the tail
    core, exc = core_thresholds(df, by, value, t), exceptional(df, by, value, t)
    out = with_group(with_group(t, core, by), exc.select(*by, "exceptional"), by)
    far = F.col("threshold") + 1.2 * F.abs(F.col("threshold") - F.col("core_median"))
    return out.select(
        *by, (F.col("core_median") - F.col("core_sigma")).alias("warn_low"), F.least("core", "threshold").alias("warn"),
        F.col("threshold").alias("fail"), F.greatest(F.coalesce("exceptional", far), F.col("threshold")).alias("hard"), "source",
    )


def ratio_tristate(df: DataFrame, by: list[str], value: str, fails: DataFrame, direction: str = "upper", warn: float = 0.8, hard: float = 1.2) -> DataFrame:
    """by, warn, fail, hard: at shares of the distance of the failure threshold from the median; fails (by, threshold)."""
    m = df.withColumn("_x", finite(value)).where("_x is not null").groupBy(*by).agg(F.median("_x").alias("_m"))
    x = with_group(fails.select(*by, "threshold"), m, by, "inner")
    sign = -1 if direction == "lower" else 1
    d = F.greatest(F.lit(1e-12), sign * (F.col("threshold") - F.col("_m")))
    return x.select(*by, (F.col("_m") + sign * warn * d).alias("warn"), F.col("threshold").alias("fail"), (F.col("_m") + sign * hard * d).alias("hard"))


def k_thresholds(stats_: DataFrame, by: list[str], soft: float = ROBUST_K, hard: float = 8.0, warn: float = 0.8) -> DataFrame:
    """by, warn, fail, hard at multiples of sigma above the median; stats_ (by, median, sigma)."""
    at = lambda k: F.when(F.col("sigma") > 0, F.col("median") + k * F.col("sigma"))
    return stats_.select(*by, at(warn * soft).alias("warn"), at(soft).alias("fail"), at(hard).alias("hard"))


def apply_states(df: DataFrame, thresholds: DataFrame, by: list[str], value: str, base: Column | None = None) -> DataFrame:
    """df with state by hybrid thresholds; warn is outside the core band on either side, na without a value or a threshold."""
    x = finite(value)
    ok = x.isNotNull() if base is None else base & x.isNotNull()
    j = with_group(df, thresholds, by)
    state = F.when(~ok | F.col("fail").isNull(), "na").when(x >= F.col("hard"), "hard_fail").when(x >= F.col("fail"), "fail").when((x > F.col("warn")) | (x < F.col("warn_low")), "warn").otherwise("pass")
    return j.withColumn("state", state).drop("warn_low", "warn", "fail", "hard", "source")


def grid_calibration(df: DataFrame, group: str, value: str, bad: str, fold: str, qs: list[float], precision: float = 0.95) -> DataFrame:
    """q, tp, fp, fn, tn, precision, recall, f1, chosen: cross-validated quantile cuts, group's own; best f1 among the precise enough.

    Percentiles are computed once per fold, group and quantile, and rows meet them by fold and group."""
    x = df.withColumn("_x", finite(value)).where(F.col("_x").isNotNull() & F.col(bad).isNotNull())
    held = df.select(F.col(fold).alias("_h")).distinct()
    train = x.crossJoin(F.broadcast(held)).where(F.col(fold) != F.col("_h"))  # a row per fold
    th = train.groupBy("_h", group).agg(F.percentile("_x", F.array(*map(F.lit, qs))).alias("_t"))
    test = x.join(th, (x[fold] == th["_h"]) & (x[group] == th[group])).select(x["_x"], F.col(bad).alias("_y"), F.posexplode("_t").alias("_i", "_c"))
    p = test.withColumn("_p", F.col("_x") > F.col("_c"))
    m = stats.confusion(p, "_y", "_p", ["_i"]).withColumn("q", F.element_at(F.array(*map(F.lit, qs)), F.col("_i") + 1)).drop("_i", "fpr", "bad_rate")
    any_ok = F.max((F.col("precision") >= precision).cast("int")).over(Window.partitionBy())  # a row per candidate
    m = m.withColumn("_ok", (F.col("precision") >= precision) | (any_ok == 0))
    rank = F.row_number().over(Window.orderBy(F.desc("_ok"), F.desc(F.round("f1", 9)), "fp", F.desc(F.round("recall", 9)), "q"))
    return m.withColumn("chosen", rank == 1).drop("_ok")


def tristate(df: DataFrame, group: str, value: str, q_warn: float, q_fail: float, available: Column | None = None) -> DataFrame:
    """df with state pass, warn, fail (strictly above) or na, by the group's own quantiles."""
    q_warn = q_warn if q_warn < q_fail else q_fail - 0.01
    x = finite(value) if available is None else F.when(available, finite(value))
    t = df.withColumn("_x", x).where("_x is not null").groupBy(group).agg(F.percentile("_x", F.array(F.lit(q_warn), F.lit(q_fail))).alias("_t"))
    j = df.join(t, group, "left")
    return j.withColumn("state", F.when(x.isNull(), "na").when(x > F.col("_t")[1], "fail").when(x > F.col("_t")[0], "warn").otherwise("pass")).drop("_t")


def trigger(df: DataFrame, value: str, direction: str, **kw) -> DataFrame:
    return df.withColumn("triggered", tail_trigger(value, direction, **kw))


def targets_met(states: DataFrame, by: list[str], bad: str) -> DataFrame:
    """by, precision of hard and fail, share of good rows among warnings, and whether they meet 1.00, 0.88 and 0.30."""
    s, y = F.col("state"), F.col(bad)
    g = states.groupBy(*by).agg(
        F.try_divide(F.count_if((s == "hard_fail") & y), F.count_if(s == "hard_fail")).alias("hard_precision"),
        F.try_divide(F.count_if(s.isin("fail", "hard_fail") & y), F.count_if(s.isin("fail", "hard_fail"))).alias("fail_precision"),
        F.try_divide(F.count_if((s == "warn") & ~y), F.count_if(s == "warn")).alias("warn_good"),
    )
    met = lambda c: F.coalesce(c, F.lit(True))
    return g.withColumn("met", met(F.col("hard_precision") >= 1.0) & met(F.col("fail_precision") >= 0.88) & met(F.col("warn_good") < 0.30))
