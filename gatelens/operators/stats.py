"""Robust statistics as grouped aggregates; group and global values by GROUPING SETS."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelens.functions.scalar import finite
from gatelens.sources.scratch import saved, with_group

MAD_SCALE = 1.4826
EPS = 1e-9


def quantile(c, q) -> Column:
    """Exact, linearly interpolated."""
    return F.percentile(c, F.lit(q))


def center(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n, median, mad, sigma, flat: one row per group; finite values only."""
    x = df.withColumn("_x", finite(value)).where("_x is not null")
    med = x.groupBy(*by).agg(F.count("*").alias("n"), F.median("_x").alias("median"))
    med = saved(med)
    dev = x.join(med, by) if by else x.crossJoin(F.broadcast(med))
    mad = dev.groupBy(*by, "n", "median").agg(F.median(F.abs(F.col("_x") - F.col("median"))).alias("mad"))
    sigma = MAD_SCALE * F.col("mad")
    return mad.withColumn("sigma", F.greatest(sigma, F.lit(EPS))).withColumn("flat", sigma <= EPS)


def robust_z(df: DataFrame, by: list[str], value: str, reference: Column | None = None) -> DataFrame:
    """df with z of value against the median and MAD of its group's reference rows, or of all if none are."""
    x = finite(value)
    ref = F.lit(True) if reference is None else reference
    med = df.groupBy(*by).agg(F.coalesce(F.median(F.when(ref, x)), F.median(x)).alias("_med"))
    # what is saved has a known size: rows meet a few groups by a broadcast, not in as many tasks as there are groups
    out = with_group(df, saved(med), by)
    dev = F.abs(x - F.col("_med"))
    mad = out.groupBy(*by).agg(F.coalesce(F.median(F.when(ref, dev)), F.median(dev)).alias("_mad"))
    return with_group(out, saved(mad), by).withColumn("z", (x - F.col("_med")) / (MAD_SCALE * F.col("_mad") + EPS)).drop("_med", "_mad")


def robust_sigma(df: DataFrame, by: list[str], value: str, eps: float = 1e-12) -> DataFrame:
    """by, median, sigma: MAD, IQR, or the 10-90 span, the first that is positive; null if none is."""
    x = df.withColumn("_x", finite(value)).where("_x is not null")
    q = x.groupBy(*by).agg(F.percentile("_x", F.array(*[F.lit(p) for p in (0.1, 0.25, 0.5, 0.75, 0.9)])).alias("_q"))
    d = with_group(x.select(*by, "_x"), saved(q), by).groupBy(*by, "_q").agg(F.median(F.abs(F.col("_x") - F.col("_q")[2])).alias("_mad"))
    steps = (MAD_SCALE * F.col("_mad"), (F.col("_q")[3] - F.col("_q")[1]) / 1.349, 0.7413 * (F.col("_q")[4] - F.col("_q")[0]))
    return d.select(*by, F.col("_q")[2].alias("median"), F.coalesce(*[F.when(s > eps, s) for s in steps]).alias("sigma"))


def scale_ladder(df: DataFrame, by: list[str], value: str, eps: float = 1e-12) -> DataFrame:
    """by, n, median, sigma, source: MAD, upper-half MAD, upper-half IQR, IQR, or the 10-90 span, the first that is positive."""
    x = df.withColumn("_x", finite(value)).where("_x is not null")
    q = x.groupBy(*by).agg(F.count("*").alias("n"), F.percentile("_x", F.array(*[F.lit(p) for p in (0.1, 0.25, 0.5, 0.75, 0.9)])).alias("_q"))
    q = saved(q.withColumn("median", F.col("_q")[2]))
    d = x.join(q, by)
    up = F.col("_x") >= F.col("median")
    s = d.groupBy(*by, "n", "median", "_q").agg(
        F.median(F.abs(F.col("_x") - F.col("median"))).alias("_mad"),
        F.median(F.when(up, F.col("_x") - F.col("median"))).alias("_umad"),
        F.count(F.when(up, 1)).alias("_un"),
        F.percentile(F.when(up, F.col("_x")), F.array(F.lit(0.25), F.lit(0.75))).alias("_uq"),
    )
    steps = [
        ("mad", MAD_SCALE * F.col("_mad"), F.lit(True)),
        ("upper_mad", MAD_SCALE * F.col("_umad"), F.lit(True)),
        ("upper_iqr", (F.col("_uq")[1] - F.col("_uq")[0]) / 1.349, F.col("_un") >= 20),
        ("iqr", (F.col("_q")[3] - F.col("_q")[1]) / 1.349, F.lit(True)),
        ("span", 0.7413 * (F.col("_q")[4] - F.col("_q")[0]), F.lit(True)),
    ]
    sigma, source = F.when(F.lit(False), 0.0), F.when(F.lit(False), "")
    for name, value_, ok in steps:
        sigma, source = sigma.when(ok & (value_ > eps), value_), source.when(ok & (value_ > eps), name)
    return s.select(*by, "n", "median", sigma.otherwise(0.0).alias("sigma"), source.otherwise("flat").alias("source"))


def weighted_quantile(df: DataFrame, by: list[str], value: str, weight: str, qs: list[float], order: str) -> DataFrame:
    """by, q, value: interpolated on the midpoint CDF (cumulated weight less half its own, over all), held at the ends."""
    from gatelens.operators.windows import ordered

    x = df.withColumn("_x", finite(value)).withColumn("_w", finite(weight)).where("_x is not null and _w > 0")
    x = ordered(x.select(*by, "_x", "_w", order), by, "_x", order, "_w")
    x = x.withColumn("_c", (F.col("_run") - F.col("_w") / 2) / F.col("_total")).withColumn("q", F.explode(F.array(*map(F.lit, qs))))
    at = F.struct("_c", "_x")
    g = x.groupBy(*by, "q").agg(F.max(F.when(F.col("_c") <= F.col("q"), at)).alias("lo"), F.min(F.when(F.col("_c") >= F.col("q"), at)).alias("hi"))
    span = F.col("hi._c") - F.col("lo._c")
    between = F.col("lo._x") + (F.col("hi._x") - F.col("lo._x")) * F.when(span > 0, (F.col("q") - F.col("lo._c")) / span).otherwise(0.0)
    return g.select(*by, "q", F.coalesce(between, "lo._x", "hi._x").alias("value"))


def sum_in_order(df: DataFrame, by: list[str], value: str, order: str, name: str) -> DataFrame:
    """by, name: sums taken row after row in an order, so that their last digits don't hang on how rows are dealt."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.select(*by, order, F.sum(value).over(w).alias("_run")).groupBy(*by).agg(F.max_by("_run", order).alias(name))


def boxplot(df: DataFrame, by: list[str], value: str) -> DataFrame:
    x = df.withColumn("_x", finite(value)).where("_x is not null")
    q = x.groupBy(*by).agg(F.count("*").alias("n"), F.min("_x").alias("low"), F.percentile("_x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"), F.max("_x").alias("high"))
    q = q.select(*by, "n", "low", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("med"), F.col("_q")[2].alias("q3"), "high").withColumn("iqr", F.col("q3") - F.col("q1"))
    lo, hi = F.col("q1") - 1.5 * F.col("iqr"), F.col("q3") + 1.5 * F.col("iqr")
    inside = (F.col("_x") >= lo) & (F.col("_x") <= hi)
    return x.join(q, by).groupBy(*by, "n", "low", "q1", "med", "q3", "high", "iqr").agg(
        F.min(F.when(inside, F.col("_x"))).alias("whisker_low"), F.max(F.when(inside, F.col("_x"))).alias("whisker_high"), F.count(F.when(~inside, 1)).alias("outliers")
    )


def histogram(df: DataFrame, value: str, bins: int, mark: Column | None = None) -> DataFrame:
    """bin, left_edge, right_edge, n, n_marked for equal-width bins, empty ones too; the largest value is in the last."""
    x = df.withColumn("_x", finite(value)).withColumn("_m", mark if mark is not None else F.lit(False)).where("_x is not null")
    ends = x.agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_x") - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(0)
    counts = x.crossJoin(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.count(F.when(F.col("_m"), 1)).alias("n_marked"))
    every = ends.select("_lo", width.alias("_w"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = every.join(counts, "bin", "left")
    left = F.col("_lo") + F.col("bin") * F.col("_w")
    return out.select("bin", left.alias("left_edge"), (left + F.col("_w")).alias("right_edge"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_marked", F.lit(0)).alias("n_marked"))


def _over(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, truth: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """tp, fp, tn, fn, precision, recall, f1, fpr, bad_rate of bad rows; unknown truths are left out; 0 for nothing over nothing."""
    y, p = F.col(truth), F.col(predicted)
    c = df.where(y.isNotNull()).groupBy(*(by or [])).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"))
    tp, fp, tn, fn = (F.col(k) for k in ("tp", "fp", "tn", "fn"))
    c = c.withColumn("precision", _over(tp, tp + fp)).withColumn("recall", _over(tp, tp + fn))
    c = c.withColumn("f1", _over(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return c.withColumn("fpr", _over(fp, fp + tn)).withColumn("bad_rate", _over(tp + fp, tp + fp + tn + fn))


def tristate_quality(df: DataFrame, bad: str, state: str) -> DataFrame:
    y, s = F.col(bad), F.col(state)
    c = df.where(s != "na").agg(
        F.count("*").alias("n"), F.count_if(y).alias("n_bad"),
        *[F.count_if(s == k).alias(f"n_{k}") for k in ("pass", "warn", "fail")], *[F.count_if((s == k) & y).alias(f"bad_{k}") for k in ("pass", "warn", "fail")],
    )
    g = {k: F.col(k) for k in c.columns}
    c = c.withColumn("fail_precision", _over(g["bad_fail"], g["n_fail"])).withColumn("fail_recall", _over(g["bad_fail"], g["n_bad"]))
    c = c.withColumn("warn_bad_rate", _over(g["bad_warn"], g["n_warn"])).withColumn("pass_bad_rate", _over(g["bad_pass"], g["n_pass"]))
    return c.withColumn("warn_lift", F.col("warn_bad_rate") - F.col("pass_bad_rate")).withColumn("warn_coverage", _over(g["n_warn"], g["n"]))


def group_and_global(df: DataFrame, group: str, value: str, qs: list[float]) -> DataFrame:
    """group (null for all), quantiles q0, q1, ...: one pass by GROUPING SETS."""
    x = df.withColumn("_x", finite(value)).where("_x is not null")
    agg = F.percentile("_x", F.array(*map(F.lit, qs))).alias("_q")
    g = x.groupingSets([[F.col(group)], []], F.col(group)).agg(F.count("*").alias("n"), F.grouping_id().alias("_g"), agg)
    return g.select(F.when(F.col("_g") == 0, F.col(group)).alias(group), (F.col("_g") != 0).alias("is_global"), "n", *[F.col("_q")[i].alias(f"q{i}") for i in range(len(qs))])


def with_group_threshold(df: DataFrame, thresholds: DataFrame, group: str, min_rows: int) -> DataFrame:
    """df with threshold: its group's if that has enough rows, else the global one. thresholds: from group_and_global, bounded by groups."""
    own = thresholds.where(~F.col("is_global") & (F.col("n") >= min_rows)).select(group, F.col("q0").alias("_own"))
    whole = thresholds.where("is_global").select(F.col("q0").alias("_all"))
    return df.join(own, group, "left").crossJoin(F.broadcast(whole)).withColumn("threshold", F.coalesce("_own", "_all")).drop("_own", "_all")


def entropy(df: DataFrame, by: list[str], kind: str) -> DataFrame:
    """Shannon entropy of kinds within groups over the log of their number; 0 for one kind."""
    c = df.groupBy(*by, kind).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by)
    p = F.col("_n") / F.sum("_n").over(w)
    c = c.withColumn("_p", p)
    return c.groupBy(*by).agg(F.count("*").alias("kinds"), (-F.sum(F.col("_p") * F.ln("_p"))).alias("_h")).select(*by, "kinds", F.when(F.col("kinds") > 1, F.col("_h") / F.ln("kinds")).otherwise(0.0).alias("entropy"))


def duplicate_rate(df: DataFrame, text: str) -> DataFrame:
    """n, distinct texts (white space made one space), share of repeats."""
    key = F.sha2(F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[ \t\n\r]+", " ")), 256)
    c = df.groupBy(key.alias("k")).count()
    return c.agg(F.sum("count").alias("n"), F.count("*").alias("n_distinct")).withColumn("repeat_rate", 1 - F.col("n_distinct") / F.col("n"))


def top_repeats(df: DataFrame, text: str, k: int = 10) -> DataFrame:
    key = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    return df.groupBy(key.alias("text_sha256")).agg(F.count("*").alias("n")).where("n >= 2").orderBy(F.desc("n"), "text_sha256").limit(k)


def weighted_center(df: DataFrame, by: list[str], value: str, weight: str, order: str) -> DataFrame:
    """by, median, mad: weighted median, and weighted median of the distances from it."""
    med = weighted_quantile(df, by, value, weight, [0.5], order).select(*by, F.col("value").alias("median"))
    med = saved(med)
    x = with_group(df, med, by).withColumn("_dev", F.abs(finite(value) - F.col("median")))
    mad = weighted_quantile(x.where("_dev is not null"), by, "_dev", weight, [0.5], order).select(*by, F.col("value").alias("mad"))
    return with_group(med, mad, by)


def weighted_z(df: DataFrame, by: list[str], value: str, weight: str, order: str, reference: str | None = None) -> DataFrame:
    """df with z against the weighted median and MAD of the reference rows of its group, or of all of a group without any."""
    ref = F.col(reference) if reference else F.lit(True)
    some = df.groupBy(*by).agg(F.bool_or(ref & finite(value).isNotNull()).alias("_some"))
    x = with_group(df, some, by)
    c = weighted_center(x.where(ref | ~F.col("_some")), by, value, weight, order)
    return with_group(x, c, by).withColumn("z", (finite(value) - F.col("median")) / (MAD_SCALE * F.col("mad") + EPS)).drop("_some", "median", "mad")


def masked_quantile(df: DataFrame, by: list[str], value: str, reference: str, q: float) -> DataFrame:
    """by, value: a quantile of the reference rows, or of all where there is none."""
    x = finite(value)
    return df.groupBy(*by).agg(F.coalesce(F.percentile(F.when(F.col(reference), x), F.lit(q)), F.percentile(x, F.lit(q))).alias("value"))


def quantile_cuts(df: DataFrame, by: list[str], value: str, qs: tuple[float, ...] = (0.5, 0.75, 0.9, 0.95, 0.99), fallback: tuple[float, ...] = (0.02, 0.05, 0.1, 0.2, 0.4)) -> DataFrame:
    """by, cuts: quantiles that never fall; fixed ones for a group without values."""
    g = df.groupBy(*by).agg(F.percentile(finite(value), F.array(*map(F.lit, qs))).alias("_q"))
    rising = F.transform("_q", lambda x, i: F.array_max(F.slice("_q", 1, i + 1)))
    return g.select(*by, F.when(F.col("_q").isNull(), F.array(*map(F.lit, fallback))).otherwise(rising).alias("cuts"))


def sensitivity(edges: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """rows, sensitivity: the median over rows of how far outputs of neighbours lie over how far their inputs do.

    edges (key, neighbour, distance) of inputs; rows (key, y).
    """
    from gatelens.functions.vectors import norm, subtract

    e = edges.join(rows.select(key, F.col("y").alias("_a")), key).join(rows.select(F.col(key).alias("neighbour"), F.col("y").alias("_b")), "neighbour")
    g = e.groupBy(key).agg(F.median(norm(subtract("_a", "_b"))).alias("_dy"), F.median(F.col("distance").cast("double")).alias("_dx"))
    return g.where("_dx > 1e-12").agg(F.count("*").alias("rows"), F.median(F.col("_dy") / F.col("_dx")).alias("sensitivity"))
