"""Bundle scores from long signal tables (group, rule, row, signal, available) and the ranking of rows to review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.functions.scalar import clip, finite, hard_tail_penalty, noisy_or, quality_from_risk, risk_from_scale, score, sigmoid, softplus
from gatelens.operators import stats
from gatelens.sources.scratch import saved, with_group

W_CORE, W_RATE, W_MASS = 0.15, 0.55, 0.30


def soft_rates(df: DataFrame, by: list[str], signal: str) -> DataFrame:
    """df's finite rows with zp, p_fail and p_hard: positive robust z and its soft rates."""
    z = stats.robust_z(df.withColumn("_x", finite(signal)).where("_x is not null"), by, "_x")
    z = z.withColumn("zp", F.greatest(F.lit(0.0), F.col("z")))
    return z.withColumn("p_fail", sigmoid((F.col("zp") - 2) / 0.6)).withColumn("p_hard", sigmoid((F.col("zp") - 3.5) / 0.6)).drop("_x", "z")


def axis_profile(df: DataFrame, by: list[str], signal: str) -> DataFrame:
    """by, n, p_fail, p_hard, r_rate, r_mass, r_core, risk, quality of a signal."""
    x = soft_rates(df, by, signal).select(*by, "zp", "p_fail", "p_hard")
    x = with_group(x, x.groupBy(*by).agg(F.percentile("zp", F.lit(0.70)).alias("_q")), by).withColumn("_core", F.col("zp") <= F.col("_q"))
    g = x.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("p_fail").alias("p_fail"), F.avg("p_hard").alias("p_hard"),
        (F.avg(softplus((F.col("zp") - 2) / 0.8)) + 3 * F.avg(softplus((F.col("zp") - 3.5) / 0.8))).alias("_mass"), F.median(F.when(F.col("_core"), F.col("zp"))).alias("_cm"),
    )
    mad = with_group(x.where("_core").select(*by, "zp"), g.select(*by, "_cm"), by).groupBy(*by).agg(F.median(F.abs(F.col("zp") - F.col("_cm"))).alias("_mad"))
    g = with_group(g, mad, by)
    g = g.withColumn("r_rate", clip(F.col("p_fail") + 8 * F.col("p_hard"))).withColumn("r_mass", risk_from_scale("_mass", 0.5)).withColumn("r_core", risk_from_scale("_mad", 0.5))
    base = noisy_or([(F.col("r_core"), W_CORE), (F.col("r_rate"), W_RATE), (F.col("r_mass"), W_MASS)])
    g = g.withColumn("risk", clip(base + hard_tail_penalty("p_hard", "r_mass")))
    return g.withColumn("quality", quality_from_risk("risk")).drop("_mass", "_mad", "_cm")


def tail_metrics(df: DataFrame, by: list[str], z: str, k_fail: float, k_hard: float, eta: float = 3.0, cap: float = 12.0) -> DataFrame:
    """by, n, p_fail, p_hard, mass: shares past the limits, and mean excess plus eta times the hard excess, capped."""
    x = df.withColumn("_z", finite(z)).where("_z is not null")
    over = lambda k: F.avg(F.greatest(F.lit(0.0), F.col("_z") - k))
    return x.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg((F.col("_z") >= k_fail).cast("double")).alias("p_fail"), F.avg((F.col("_z") >= max(k_hard, k_fail)).cast("double")).alias("p_hard"),
        F.least(F.lit(cap), over(k_fail) + eta * over(max(k_hard, k_fail))).alias("mass"),
    )


def state_rates(df: DataFrame, by: list[str], state: str = "state") -> DataFrame:
    ok = df.where(F.col(state) != "na")
    return ok.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg((F.col(state) == s).cast("double")).alias(f"{s}_rate") for s in ("pass", "warn", "fail", "hard_fail")])


def diagnostic_quadrants(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """by, q00, q10, q01, q11: mean joint soft rates of two signals, and the risks made of them."""
    x = soft_rates(df, by, a).withColumnRenamed("p_fail", "_a").drop("zp", "p_hard")
    x = soft_rates(x, by, b).withColumnRenamed("p_fail", "_b").drop("zp", "p_hard")
    p, q = F.col("_a"), F.col("_b")
    g = x.groupBy(*by).agg(F.avg((1 - p) * (1 - q)).alias("q00"), F.avg(p * (1 - q)).alias("q10"), F.avg((1 - p) * q).alias("q01"), F.avg(p * q).alias("q11"))
    g = g.withColumn("rate", clip(F.col("q10") + F.col("q01") + F.col("q11"))).withColumn("mass", clip(F.col("q11") + 0.5 * F.least("q10", "q01")))
    return g.withColumn("risk", noisy_or([(F.col("rate"), W_RATE / 0.85), (F.col("mass"), W_MASS / 0.85)]))


def confidence(df: DataFrame, by: list[str], signal: str, available: str, support: int = 8, method: str | None = None, source: str | None = None, flat: str | None = None, operation: float = 1.0) -> DataFrame:
    """by, n_valid, conf_data, conf_calc, conf_th, confidence 0 to 5: the least of the parts, times the operational share.

    Data: valid rows over the support, held to 1, and 0 below eight; calculation: the lesser of the finite and the available
    share; threshold: 1 if every rule names a method and a source (columns) and none has a flat scale.
    """
    ok = finite(signal).isNotNull()
    named = lambda c: ~F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))).isin("", "missing", "na")
    parts = [named(c) for c in (method, source) if c] + ([~F.coalesce(F.col(flat), F.lit(False))] if flat else [])
    sound = F.lit(True)
    for p in parts:
        sound = sound & p
    g = df.groupBy(*by).agg(
        F.count_if(ok & F.col(available)).alias("n_valid"), F.avg(ok.cast("double")).alias("_f"), F.avg(F.col(available).cast("double")).alias("_a"), F.bool_and(sound).cast("double").alias("conf_th"),
    )
    g = g.withColumn("conf_data", F.when(F.col("n_valid") < 8, 0.0).otherwise(clip(F.col("n_valid") / max(1, support)))).withColumn("conf_calc", clip(F.least("_f", "_a")))
    return g.select(*by, "n_valid", "conf_data", "conf_calc", "conf_th", (5 * clip(F.least("conf_data", "conf_calc", "conf_th") * clip(F.lit(operation)))).alias("confidence"))


def coverage(df: DataFrame, by: list[str], gate: str, signals: list[str]) -> DataFrame:
    """by, coverage 0 to 5: share of rows that pass the gate and have all signals."""
    ok = F.coalesce(F.col(gate), F.lit(False))
    for s in signals:
        ok = ok & finite(s).isNotNull()
    return df.groupBy(*by).agg((5 * F.avg(ok.cast("double"))).alias("coverage"))


def bundles(axes: DataFrame, quadrants: DataFrame, cover: DataFrame, conf: DataFrame, by: list[str]) -> DataFrame:
    """by, bundle, raw, score: COV, OUT, RID, DIAG, CONF. axes has a rule of 'output' or 'diff_residual'; a missing axis is a neutral 3."""
    q = axes.groupBy(*by).agg(*[F.max(F.when(F.col("rule") == r, F.col("quality"))).alias(k) for k, r in (("OUT", "output"), ("RID", "diff_residual"))])
    g = cover.withColumnRenamed("coverage", "COV").join(q, by, "left").join(quadrants.select(*by, quality_from_risk("risk").alias("DIAG")), by, "left").join(conf.withColumnRenamed("confidence", "CONF"), by, "left")
    kinds = ("COV", "OUT", "RID", "DIAG", "CONF")
    long = g.select(*by, F.explode(F.array(*[F.struct(F.lit(k).alias("bundle"), F.coalesce(F.col(k), F.lit(3.0)).alias("raw")) for k in kinds])).alias("_b"))
    return long.select(*by, "_b.bundle", "_b.raw", score("_b.raw").alias("score"))


def row_risk(df: DataFrame, by: list[str], signal: str) -> DataFrame:
    """df's rows with risk: noisy-or of their soft rate and mass, plus the hard-tail penalty."""
    x = soft_rates(df, by, signal)
    mass = risk_from_scale(softplus((F.col("zp") - 2) / 0.8) + 3 * softplus((F.col("zp") - 3.5) / 0.8), 0.5)
    rate = clip(F.col("p_fail") + 8 * F.col("p_hard"))
    return x.withColumn("risk", clip(noisy_or([(rate, W_RATE), (mass, W_MASS)]) + hard_tail_penalty("p_hard", mass))).drop("zp", "p_fail", "p_hard")


def triage(df: DataFrame, key: str, order: str, risk: str, fails: str, hards: str, rules: int, detail: str | None = None, k: int = 20) -> DataFrame:
    """The k rows to review: hard, or with at least three fails, or failed in detail; once per key; with severity, rank score and tags."""
    d = F.col(detail) if detail else F.lit(False)
    sev = clip((8 * F.col(hards) + (F.col(fails) - F.col(hards))) / (8.0 * rules))
    x = df.withColumn("severity", sev).withColumn("rank_score", clip(0.7 * F.col(risk) + 0.3 * F.col("severity") + F.when(d, 0.2).otherwise(0.0)))
    x = x.where((F.col(hards) > 0) | (F.col(fails) >= 3) | d)
    tags = F.array_compact(F.array(F.when(F.col(hards) > 0, "HARD"), F.when(F.col(fails) >= 3, "MULTI"), F.when(d, "DETAIL")))
    from gatelens.operators.relational import top_risks

    return top_risks(x.withColumn("tags", F.array_join(tags, "|")), key, [F.desc(F.round("rank_score", 9)), F.desc(hards), F.desc(fails), F.col(order)], k)


def hard_gate_score(df: DataFrame, by: list[str], gate: str) -> DataFrame:
    from gatelens.functions.scalar import HARD_GATE, bucket

    g = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.coalesce(F.col(gate), F.lit(False)).cast("double")).alias("pass_rate"))
    return g.withColumn("score", bucket("pass_rate", HARD_GATE))


# rule statistics and fallbacks ----------------------------------------------------------------------------------------
EPS = 1e-12


def rule_stats(df: DataFrame, thresholds: DataFrame, by: list[str], signal: str, valid: str, eta: float = 3.0, z_cap: float = 12.0, raw_cap: float = 6.0, trigger: float = 1e6) -> DataFrame:
    """by, n, center, sigma, flat, k_fail, k_hard, p_fail, p_hard, tail_mass, mass_mode, core_mad of the valid rows' signals against fail and hard thresholds.

    k: thresholds in robust deviations. The mass is the mean excess over k_fail plus eta times that over k_hard, each capped;
    on a flat scale, or from a k beyond the trigger, excesses are logs of raw ones over the widest known span.
    """
    x = df.where(F.coalesce(F.col(valid), F.lit(False))).withColumn("_x", finite(signal)).where("_x is not null")
    c = stats.center(x, by, "_x")
    t = with_group(c, thresholds.select(*by, "fail", "hard"), by)
    t = t.withColumn("k_fail", (F.col("fail") - F.col("median")) / (F.col("sigma") + EPS)).withColumn("k_hard", F.greatest((F.col("hard") - F.col("median")) / (F.col("sigma") + EPS), F.col("k_fail")))
    raw = (F.col("flat") | (F.abs("k_fail") >= trigger)) & F.col("fail").isNotNull()
    span = F.greatest(F.lit(1.0), F.abs("fail"), F.abs(F.col("fail") - F.col("median")), F.when(F.col("hard") > F.col("fail"), F.col("hard") - F.col("fail")))
    t = t.withColumn("_raw", F.coalesce(raw, F.lit(False))).withColumn("_span", span)
    x = with_group(x.select(*by, "_x"), t, by).withColumn("_z", (F.col("_x") - F.col("median")) / (F.col("sigma") + EPS))
    cap = F.when(F.col("_raw"), raw_cap).otherwise(z_cap)

    def excess(k: str, limit: str):
        return F.least(cap, F.when(F.col("_raw"), F.log1p(F.greatest(F.lit(0.0), F.col("_x") - F.col(limit)) / (F.col("_span") + EPS))).otherwise(F.greatest(F.lit(0.0), F.col("_z") - F.col(k))))

    g = x.groupBy(*by, "n", "median", "sigma", "flat", "fail", "hard", "k_fail", "k_hard", "_raw").agg(
        F.avg((F.col("_z") >= F.col("k_fail")).cast("double")).alias("p_fail"), F.avg(F.coalesce(F.col("_z") >= F.col("k_hard"), F.lit(False)).cast("double")).alias("p_hard"),
        (F.avg(excess("k_fail", "fail")) + eta * F.coalesce(F.avg(excess("k_hard", "hard")), F.lit(0.0))).alias("tail_mass"),
        F.median(F.when(F.col("_z") < F.col("k_fail"), F.col("_z"))).alias("_cm"),
    )
    mad = with_group(x.where(F.col("_z") < F.col("k_fail")).select(*by, "_z"), g.select(*by, "_cm"), by).groupBy(*by).agg(F.median(F.abs(F.col("_z") - F.col("_cm"))).alias("core_mad"))
    out = with_group(g, mad, by).withColumnRenamed("median", "center")
    known = F.col("k_fail").isNotNull()
    mode = F.when(~known, "na").when(F.col("_raw"), "raw_log_ratio_capped").otherwise("z_excess_capped")
    return out.select(*by, "n", "center", "sigma", "flat", "k_fail", "k_hard", *[F.when(known, F.col(c_)).alias(c_) for c_ in ("p_fail", "p_hard", "tail_mass")], mode.alias("mass_mode"), "core_mad")


def threshold_profile(stats_: DataFrame, by: list[str], s_core: float = 0.5, s_mass: float = 0.5, lam: float = 8.0, hard_cut: float = 0.0) -> DataFrame:
    """by, r_rate, r_mass, r_core, their qualities and band (core, tail or exceptional) from rates past thresholds; stats_ as of rule_stats."""
    x = stats_.withColumn("r_rate", clip(F.col("p_fail") + lam * F.col("p_hard"))).withColumn("r_mass", risk_from_scale("tail_mass", s_mass)).withColumn("r_core", risk_from_scale("core_mad", s_core))
    band = F.when(F.col("p_hard") > hard_cut, "exceptional").when(F.col("p_fail") > 0, "tail").otherwise("core")
    return x.select(*by, *[F.col(f"r_{a}") for a in ("rate", "mass", "core")], *[quality_from_risk(f"r_{a}").alias(f"q_{a}") for a in ("rate", "mass", "core")], band.alias("band"))


def group_risk(df: DataFrame, by: list[str], z: str, k_fail: float, k_hard: float) -> DataFrame:
    """by, risk: rate past the first limit, three times that past the second, and half the mass."""
    g = tail_metrics(df, by, z, k_fail, k_hard)
    return g.select(*by, (F.col("p_fail") + 3 * F.col("p_hard") + 0.5 * F.col("mass")).alias("risk"))


def explain(df: DataFrame, by: list[str], z: str, state: str, k_fail: str, k_hard: str) -> DataFrame:
    """by, n_valid, rate and mean excess past either limit of the positive z, and shares of states."""
    zp = F.greatest(F.lit(0.0), finite(z))
    x = df.where(finite(z).isNotNull())
    rate = lambda k: F.avg((zp >= F.col(k)).cast("double"))
    over = lambda k: F.avg(F.greatest(F.lit(0.0), zp - F.col(k)))
    shares = [F.avg((F.col(state) == s).cast("double")).alias(f"state_{n}_rate") for s, n in (("pass", "pass"), ("warn", "warn"), ("fail", "fail"), ("hard_fail", "hard"))]
    return x.groupBy(*by).agg(F.count("*").alias("n_valid"), rate(k_fail).alias("rate_fail"), rate(k_hard).alias("rate_hard"), over(k_fail).alias("excess_fail"), over(k_hard).alias("excess_hard"), *shares)


def zero_threshold_fallback(df: DataFrame, fail: str = "fail", hard: str = "hard", eps: float = 1e-12, floor: float = 4.0, softness: float = 1.0) -> DataFrame:
    """df (r_rate, r_mass, p_fail, p_hard) where thresholds of zero say that nearly all values are equal: a hard threshold of zero scores 5.

    A failure threshold of zero alone scores between the floor and 5, the less the further the hard one lies. Adds fallback,
    the reason, and density_score.
    """
    gap = F.greatest(F.lit(0.0), F.abs(F.col(hard) - F.col(fail)))
    by_gap = floor + (5 - floor) / (1 + F.log1p(gap / max(EPS, softness)))
    dense, near = F.abs(finite(hard)) <= eps, (F.abs(finite(fail)) <= eps) & finite(hard).isNotNull()
    reason = F.when(dense, "hard_fail_threshold_zero_dense").when(near, "fail_threshold_zero_dense").otherwise("not_applicable")
    out = df.withColumn("fallback", reason).withColumn("density_score", F.when(dense, 5.0).when(near, by_gap))
    risk = clip(1 - F.col("density_score") / 5)
    used = F.col("density_score").isNotNull()
    return out.withColumns({c: F.when(used, risk).otherwise(F.col(c)) for c in ("r_rate", "r_mass", "p_fail")} | {"p_hard": F.when(used, 0.0).otherwise(F.col("p_hard"))})


def k_fail_fallback(df: DataFrame, k_fail: str = "k_fail", fail_rate: str = "state_fail_rate", hard_rate: str = "state_hard_rate", cutoff: float = 20.0, lam: float = 8.0, eta: float = 3.0) -> DataFrame:
    """df (r_rate, r_mass, p_fail, p_hard, fallback) with shares of states in place of soft rates where the failure limit lies beyond the cutoff."""
    far = (F.abs(finite(k_fail)) >= cutoff) & (F.col("fallback") == "not_applicable")
    known = finite(fail_rate).isNotNull() | finite(hard_rate).isNotNull()
    sf, sh = (F.coalesce(clip(finite(c)), F.lit(0.0)) for c in (fail_rate, hard_rate))
    use = F.coalesce(far & known, F.lit(False))
    to = {"r_rate": clip(sf + lam * sh), "r_mass": clip(sf + max(0.0, eta) * sh), "p_fail": sf, "p_hard": sh}
    reason = F.when(use, "k_fail_cutoff_exceeded").when(F.coalesce(far, F.lit(False)), "k_fail_cutoff_exceeded_but_state_nan").when(F.col("fallback") == "not_applicable", "below_cutoff").otherwise(F.col("fallback"))
    return df.withColumns({c: F.when(use, v).otherwise(F.col(c)) for c, v in to.items()} | {"fallback": reason})


def fallbacks(df: DataFrame, states: bool = True, **kw) -> DataFrame:
    """Zero thresholds first, then far ones."""
    out = zero_threshold_fallback(df)
    return k_fail_fallback(out, **kw) if states else out


NEUTRAL = 3.0


def axis_risk(core: str = "r_core", rate: str = "r_rate", mass: str = "r_mass", hard: str = "p_hard"):
    """Noisy-OR of the three axes, and the hard tail's penalty."""
    return clip(noisy_or([(F.col(core), W_CORE), (F.col(rate), W_RATE), (F.col(mass), W_MASS)]) + hard_tail_penalty(hard, mass))


def bundle_scores(rows: DataFrame, by: list[str], rules: dict[str, str], gate: str, thresholds: DataFrame | None = None, failed: str | None = None, detail_alpha: float = 0.35, zero_share: float = 0.9) -> DataFrame:
    """by, bundle, raw, score of COV, OUT, RID, DIAG, SEM and CONF; raw and score of SEM are null where it says nothing.

    rules: columns of the signals output, diff_residual, delta_ridge_ens, and, if there are any, discourse_instability and
    contradiction. thresholds (by, rule, fail, hard, and k_fail, state_fail_rate, state_hard_rate if known) serve fallbacks
    alone. failed: a column that tells rows with a failed leaf. A missing axis is neutral.
    """
    ok = F.coalesce(F.col(gate), F.lit(False))
    long = rows.where(ok).select(*by, F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), finite(c).alias("signal")) for k, c in rules.items()])).alias("_s")).select(*by, "_s.*").where("signal is not null")
    axes = saved(axis_profile(long, [*by, "rule"], "signal").select(*by, "rule", "n", "r_core", "r_rate", "r_mass", "p_fail", "p_hard"))
    none = F.lit(None).cast("double")
    if thresholds is not None:
        axes = with_group(axes, thresholds, [*by, "rule"])
    for c in ("fail", "hard", "k_fail", "state_fail_rate", "state_hard_rate"):
        if c not in axes.columns:
            axes = axes.withColumn(c, none)
    axes = saved(fallbacks(axes))
    everyone = rows.select(*by).distinct() if by else rows.agg(F.lit(1).alias("_one"))
    of = lambda name: axes.where(F.col("rule") == name)
    single = axes.withColumn("_q", quality_from_risk(axis_risk())).groupBy(*by).agg(*[F.max(F.when(F.col("rule") == k, F.col("_q"))).alias(n) for n, k in (("OUT", "output"), ("RID", "diff_residual"))])
    out = with_group(everyone, single, by)
    if failed:
        detail = rows.where(ok).groupBy(*by).agg(F.avg(F.coalesce(F.col(failed), F.lit(False)).cast("double")).alias("_d"))
        out = with_group(out, detail, by).withColumn("OUT", quality_from_risk(clip(1 - F.col("OUT") / 5 + detail_alpha * F.coalesce("_d", F.lit(0.0)))))
        out = out.drop("_d")
    cover = ok
    for k in ("output", "diff_residual", "delta_ridge_ens"):
        cover = cover & finite(rules[k]).isNotNull() if k in rules else F.lit(False)
    out = with_group(out, rows.groupBy(*by).agg((5 * F.avg(cover.cast("double"))).alias("COV"), F.avg(ok.cast("double")).alias("_a"), F.count_if(cover).alias("_n")), by)
    out = out.withColumn("CONF", 5 * F.least(F.when(F.col("_n") < 8, 0.0).otherwise(1.0), F.col("COV") / 5, F.col("_a"))).drop("_a", "_n")
    if {"diff_residual", "delta_ridge_ens"} <= set(rules):
        both = rows.where(ok & finite(rules["diff_residual"]).isNotNull() & finite(rules["delta_ridge_ens"]).isNotNull())
        d = diagnostic_quadrants(both, by, rules["diff_residual"], rules["delta_ridge_ens"])
        hard = axes.where(F.col("rule").isin("diff_residual", "delta_ridge_ens")).groupBy(*by).agg(F.avg("p_hard").alias("_h"))
        d = with_group(d, hard, by).select(*by, quality_from_risk(clip(F.col("risk") + hard_tail_penalty("_h", "mass"))).alias("DIAG"))
        out = with_group(out, d, by)
    else:
        out = out.withColumn("DIAG", none)
    sem = [k for k in ("discourse_instability", "contradiction") if k in rules]
    if sem:
        zeros = rows.where(ok).groupBy(*by).agg(*[F.avg(F.when(finite(rules[k]).isNotNull(), (F.abs(finite(rules[k])) <= EPS).cast("double"))).alias(f"_z{i}") for i, k in enumerate(sem)])
        q = axes.where(F.col("rule").isin(*sem)).groupBy(*by).agg(*[F.avg(quality_from_risk(f"r_{a}")).alias(f"_{a}") for a in ("core", "rate", "mass")], F.max(F.col("fallback").isin("hard_fail_threshold_zero_dense", "fail_threshold_zero_dense")).alias("_told"))
        risk = noisy_or([(1 - F.col("_core") / 5, W_CORE), (1 - F.col("_rate") / 5, W_RATE), (1 - F.col("_mass") / 5, W_MASS)])
        q = with_group(q, zeros, by)
        empty = F.lit(True)
        for i in range(len(sem)):
            empty = empty & (F.coalesce(f"_z{i}", F.lit(1.0)) >= zero_share)
        out = with_group(out, q.select(*by, F.when(~empty, quality_from_risk(risk)).alias("SEM")), by)
    else:
        out = out.withColumn("SEM", none)
    pairs = [F.struct(F.lit(k).alias("bundle"), (F.col(k) if k == "SEM" else F.coalesce(F.col(k), F.lit(NEUTRAL))).alias("raw")) for k in ("COV", "OUT", "RID", "DIAG", "SEM", "CONF")]
    long = out.select(*by, F.explode(F.array(*pairs)).alias("_b")).select(*by, "_b.*")
    return long.withColumn("score", score("raw"))


def bundle_slice(scores: DataFrame, bundle: str) -> DataFrame:
    return scores.where(F.col("bundle") == bundle)


def interpretation(scores: DataFrame, details: DataFrame, by: list[str]) -> DataFrame:
    """details (by, bundle, submetric, value) with their bundle's score, and its band in words."""
    band = F.when(F.col("raw").isNull(), "not available").when(F.col("raw") >= 4, "stable").when(F.col("raw") >= 2.5, "watch").otherwise("act")
    return with_group(details, scores.withColumn("band", band), [*by, "bundle"])


def input_distance(df: DataFrame, x: str | None, y: str | None, text: str):
    """df with input_distance: the radius of two coordinates, or the text's length without them."""
    r = F.sqrt(finite(x) * finite(x) + finite(y) * finite(y)) if x and y else F.lit(None).cast("double")
    return df.withColumn("input_distance", F.coalesce(r, F.length(F.coalesce(F.col(text), F.lit(""))).cast("double")))


def inverse_risk(df: DataFrame, by: list[str], value: str, log: bool = True, q: float = 0.95) -> DataFrame:
    """df with risk 0 to 1: positive robust z of a value (of its log), over a quantile of them."""
    raw = F.greatest(F.lit(0.0), finite(value))
    x = df.withColumn("_x", F.log1p(raw) if log else raw)
    c = stats.center(x.where("_x is not null"), by, "_x").select(*by, "median", "sigma", "flat")
    sd = x.groupBy(*by).agg(F.stddev_pop("_x").alias("_sd"))
    x = with_group(with_group(x, c, by), sd, by)
    s = F.when(~F.col("flat"), F.col("sigma")).otherwise(F.when(F.col("_sd") > EPS, F.col("_sd")).otherwise(1.0))
    x = x.withColumn("_z", F.greatest(F.lit(0.0), (F.col("_x") - F.col("median")) / (s + EPS))).drop("median", "sigma", "flat", "_sd")
    top = x.groupBy(*by).agg(F.percentile("_z", F.lit(min(1.0, max(0.5, q)))).alias("_c"), F.max("_z").alias("_m"))
    x = with_group(x, top, by)
    cap = F.when(F.col("_c") > EPS, F.col("_c")).when(F.col("_m") > EPS, F.col("_m")).otherwise(1.0)
    return x.withColumn("risk", clip(F.least(F.col("_z"), cap) / (cap + EPS))).drop("_x", "_z", "_c", "_m")
