"""Leaves of nested outputs: hits against thresholds, roll-ups to rows, frequencies, distributions, and their effect on states.

A hit is one leaf of one row under one rule: (row, group, leaf, rule, signal, available, pass).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelens.functions.scalar import finite, sanitize_path
from gatelens.sources.scratch import saved, with_group

MOST_PATHS = 8
FALLBACK_LEAF = "__group__"


def hits(leaves: DataFrame, thresholds: DataFrame, by: list[str], signal: str, threshold: str = "threshold") -> DataFrame:
    """Leaf rows with their thresholds and pass: at most the threshold, or without a signal or a threshold of their own."""
    out = with_group(leaves, thresholds.select(*by, threshold), by)
    ok = F.coalesce(finite(signal) <= F.col(threshold), F.lit(True))
    return out.withColumn("available", finite(signal).isNotNull() & F.col(threshold).isNotNull()).withColumn("pass", ok)


def to_rows(hits_: DataFrame, key: str, rule: str, signal: str = "signal") -> DataFrame:
    """key, rule, pass, signal, available, leaves: all available leaves pass, the largest signal, any available; a row per row and rule."""
    ok = F.bool_and(F.when(F.col("available"), F.col("pass")))
    return hits_.groupBy(key, rule).agg(F.coalesce(ok, F.lit(True)).alias("pass"), F.max(F.when(F.col("available"), finite(signal))).alias("signal"), F.bool_or("available").alias("available"), F.count("*").alias("leaves"))


def row_metrics(hits_: DataFrame, key: str, leaf: str, rule: str, most: int = MOST_PATHS) -> DataFrame:
    """key, evaluated, failed, failed_paths: leaves evaluated and failed, and the paths that fail most rules, most first, at most `most`."""
    bad = F.col("available") & ~F.col("pass")
    per = hits_.groupBy(key, leaf).agg(F.bool_or("available").alias("_e"), F.count_if(bad).alias("_f"))
    order = F.array_sort(F.collect_list(F.when(F.col("_f") > 0, F.struct((-F.col("_f")).alias("o"), F.col(leaf).alias("p")))))
    out = per.groupBy(key).agg(F.count_if("_e").alias("evaluated"), F.count_if(F.col("_f") > 0).alias("failed"), order.alias("_o"))
    return out.select(key, "evaluated", "failed", F.array_join(F.transform(F.slice("_o", 1, most), lambda s: s["p"]), "|").alias("failed_paths"))


def scatter(rows: DataFrame, part: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """rows with the columns of part, and defaults where part has no row or no value."""
    out = rows.join(part.select(key, *defaults), key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """df with the columns it lacks."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def require(df: DataFrame, names: list[str]) -> DataFrame:
    """df, if it has all the columns."""
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def signal_column(df: DataFrame, rule: str, mode: str = "nomask") -> str | None:
    """The column of a rule's signal, by its present or its former name."""
    return next((c for c in (f"{rule}_signal_{mode}", f"{rule}_score_{mode}") if c in df.columns), None)


def availability(df: DataFrame, rule: str, siblings: tuple[str, ...] = (), mode: str = "nomask") -> Column:
    """Whether a rule's signal is available: its own column, else a sibling's, else always."""
    names = [f"{r}_available_{mode}" for r in (rule, *siblings)]
    found = next((c for c in names if c in df.columns), None)
    return F.coalesce(F.col(found).cast("boolean"), F.lit(False)) if found else F.lit(True)


def override(df: DataFrame, state: str, failed: str) -> DataFrame:
    """df with state_before and state: rows with a failed leaf that pass or warn fail; hard failures stay."""
    flips = F.coalesce(F.col(failed) > 0, F.lit(False)) & F.col(state).isin("pass", "warn")
    return df.withColumn("state_before", F.col(state)).withColumn(state, F.when(flips, "fail").otherwise(F.col(state)))


def override_rates(df: DataFrame, state: str = "state") -> DataFrame:
    """One row: rows, rows flipped, fail rates before and after."""
    bad = lambda c: F.avg(F.col(c).isin("fail", "hard_fail").cast("double"))
    return df.agg(F.count("*").alias("n"), F.count_if(F.col(state) != F.col("state_before")).alias("flipped"), bad("state_before").alias("rate_before"), bad(state).alias("rate_after"))


def frequency(rows: DataFrame, key: str, paths: str, failed: str, top: int = 5, concentrated: float = 0.60) -> DataFrame:
    """leaf, rank, rows, share, mean_failed, concentrated: the leaves that most rows fail, over rows that fail any; paths are joined by pipes."""
    bad = rows.where(F.col(paths) != "").select(key, failed, F.explode(F.array_distinct(F.split(paths, r"\|"))).alias("leaf"))
    n = bad.agg(F.count_distinct(key).alias("_n"))
    g = bad.groupBy("leaf").agg(F.count_distinct(key).alias("rows"), F.avg(F.col(failed).cast("double")).alias("mean_failed")).orderBy(F.desc("rows"), "leaf").limit(top).crossJoin(F.broadcast(n))  # one row
    g = g.withColumn("share", F.col("rows") / F.col("_n")).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("rows"), "leaf")))  # `top` rows
    return g.select("leaf", "rank", "rows", "share", "mean_failed", (F.col("share") >= concentrated).alias("concentrated"))


def tables(hits_: DataFrame, key: str, leaf: str, rule: str, top: int = 3) -> tuple[DataFrame, DataFrame]:
    """Per leaf: hits, failed, fail_rate, rows, the rules that fail most; per rule: hits, failed, fail_rate, leaves."""
    bad = F.col("available") & ~F.col("pass")
    per = hits_.groupBy(leaf, rule).agg(F.count_if("available").alias("_n"), F.count_if(bad).alias("_f"))
    order = F.array_sort(F.collect_list(F.when(F.col("_f") > 0, F.struct((-F.col("_f")).alias("o"), F.col(rule).alias("r")))))
    by_leaf = per.groupBy(leaf).agg(F.sum("_n").alias("hits"), F.sum("_f").alias("failed"), order.alias("_o"))
    names = F.array_join(F.transform(F.slice("_o", 1, top), lambda s: F.concat(s["r"], F.lit(":"), (-s["o"]).cast("string"))), "|")
    rows = hits_.where(bad).groupBy(leaf).agg(F.count_distinct(key).alias("rows"))
    by_leaf = by_leaf.join(rows, leaf, "left").select(leaf, "hits", "failed", F.try_divide(F.col("failed"), F.col("hits")).alias("fail_rate"), F.coalesce("rows", F.lit(0)).alias("rows"), names.alias("top_rules"))
    by_rule = per.groupBy(rule).agg(F.sum("_n").alias("hits"), F.sum("_f").alias("failed"), F.count_if(F.col("_f") > 0).alias("leaves"))
    return by_leaf, by_rule.withColumn("fail_rate", F.try_divide(F.col("failed"), F.col("hits")))


def distribution(hits_: DataFrame, by: list[str], signal: str = "signal") -> DataFrame:
    """by, support, mean, std, quantiles and fail_rate of the available signals of each leaf."""
    x = hits_.withColumn("_x", finite(signal)).where(F.col("available") & F.col("_x").isNotNull())
    q = F.percentile("_x", F.array(*[F.lit(p) for p in (0.5, 0.9, 0.95, 0.99)]))
    g = x.groupBy(*by).agg(F.count("*").alias("support"), F.avg("_x").alias("mean"), F.stddev_pop("_x").alias("std"), F.min("_x").alias("low"), F.max("_x").alias("high"), q.alias("_q"), F.avg((~F.col("pass")).cast("double")).alias("fail_rate"))
    return g.select(*by, "support", "mean", "std", "low", *[F.col("_q")[i].alias(n) for i, n in enumerate(("q50", "q90", "q95", "q99"))], "high", "fail_rate")


def histograms(hits_: DataFrame, by: list[str], signal: str = "signal", bins: int = 20) -> DataFrame:
    """by, bin, left_edge, right_edge, n, n_failed: equal-width bins of each leaf's signals, empty ones too."""
    x = hits_.withColumn("_x", finite(signal)).where(F.col("available") & F.col("_x").isNotNull())
    ends = x.groupBy(*by).agg(F.min("_x").alias("_lo"), ((F.max("_x") - F.min("_x")) / bins).alias("_w"))
    at = F.when(F.col("_w") > 0, F.least(F.floor((F.col("_x") - F.col("_lo")) / F.col("_w")), F.lit(bins - 1))).otherwise(0).cast("int")
    counts = with_group(x, ends, by).groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"), F.count_if(~F.col("pass")).alias("n_failed"))
    every = ends.select(*by, "_lo", "_w", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    left = F.col("_lo") + F.col("bin") * F.col("_w")
    return with_group(every, counts, [*by, "bin"]).select(*by, "bin", left.alias("left_edge"), (left + F.col("_w")).alias("right_edge"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_failed", F.lit(0)).alias("n_failed"))


def path_support(leaves: DataFrame, key: str, path: str = "path", leaf: str = "leaf") -> DataFrame:
    """path, rows, filled, distinct: rows that have a path, those with text there, and how many texts."""
    text = F.trim(F.coalesce(F.col(leaf), F.lit("")))
    g = leaves.groupBy(path).agg(F.count_distinct(key).alias("rows"), F.count_distinct(F.when(text != "", F.col(key))).alias("filled"), F.count_distinct(F.when(text != "", text)).alias("distinct_texts"))
    return g.withColumn("column", F.concat(F.lit("leaf_"), sanitize_path(path)))


def group_summary(rows: DataFrame, by: list[str], gate: str, state: str, rules: DataFrame, key: str, rule: str = "rule") -> DataFrame:
    """by, size, gate_rate, pass_rate, fail_rate and a map of each rule's outlier rate; rules as of to_rows. Largest pass rate first for equal keys."""
    ok = F.coalesce(F.col(gate), F.lit(False))
    g = rows.groupBy(*by).agg(
        F.count("*").alias("size"), F.avg(ok.cast("double")).alias("gate_rate"), F.avg((F.col(state) == "pass").cast("double")).alias("pass_rate"), F.avg(F.col(state).isin("fail", "hard_fail").cast("double")).alias("fail_rate")
    )
    per = rows.select(key, *by).join(rules, key).groupBy(*by, rule).agg(F.avg(F.when(F.col("available"), (~F.col("pass")).cast("double"))).alias("_o"))
    per = per.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(rule, "_o")))).alias("outliers"))
    return with_group(g, per, by)


def run_summary(df: DataFrame, by: list[str], used_k: str, weight: str, available: str) -> DataFrame:
    """by, n, neighbours used (least, median, most), weights (quantiles, share below one), available_rate."""
    q = lambda c, *p: F.percentile(c, F.array(*map(F.lit, p)))
    g = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.min(used_k).alias("k_least"), F.median(used_k).alias("k_median"), F.max(used_k).alias("k_most"), q(weight, 0.05, 0.5, 0.95).alias("_w"),
        F.avg((F.col(weight) < 1).cast("double")).alias("weighted_down"), F.avg(F.col(available).cast("double")).alias("available_rate"),
    )
    return g.select(*by, "n", "k_least", "k_median", "k_most", *[F.col("_w")[i].alias(n) for i, n in enumerate(("w05", "w50", "w95"))], "weighted_down", "available_rate")


def operational_summary(rows: DataFrame, gate: str, state: str, final: str) -> DataFrame:
    """One row: rows, gate and evaluation rates, shares of states among evaluated rows, final pass rate."""
    ok, s = F.coalesce(F.col(gate), F.lit(False)), F.col(state)
    evaluated = ok & (s != "na")
    shares = [F.avg(F.when(evaluated, (s == k).cast("double"))).alias(f"{k}_rate") for k in ("pass", "warn", "fail", "hard_fail")]
    return rows.agg(F.count("*").alias("n"), F.avg(ok.cast("double")).alias("gate_rate"), F.avg(evaluated.cast("double")).alias("evaluated_rate"), *shares, F.avg((F.col(final) == "pass").cast("double")).alias("final_pass_rate"))


def edge_stats(df: DataFrame, states: list[str]) -> DataFrame:
    """rule, n, warns, fails, hards and rates of input-side rules, one state column each."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).alias("s")) for c in states])).alias("x")).select("x.*").where("s <> 'na'")
    g = long.groupBy("rule").agg(F.count("*").alias("n"), *[F.count_if(F.col("s") == k).alias(n) for k, n in (("warn", "warns"), ("fail", "fails"), ("hard_fail", "hards"))])
    return g.withColumn("bad_rate", (F.col("fails") + F.col("hards")) / F.col("n"))


def edge_cases(df: DataFrame, key: str, states: list[str], k: int = 20) -> DataFrame:
    """The k rows of the highest severity (8 a hard failure, 1 a failure, 0.25 a warning): of those that fail hard if any do, else that fail, else that warn."""
    count = lambda s: reduce(lambda a, b: a + b, [F.when(F.col(c) == s, 1).otherwise(0) for c in states])
    x = df.withColumn("_h", count("hard_fail")).withColumn("_f", count("fail")).withColumn("_w", count("warn"))
    x = x.withColumn("severity", 8.0 * F.col("_h") + F.col("_f") + 0.25 * F.col("_w"))
    best = x.agg(F.max(F.when(F.col("_h") > 0, 3).when(F.col("_f") > 0, 2).when(F.col("_w") > 0, 1).otherwise(0)).alias("_best"))
    x = x.crossJoin(F.broadcast(best))  # one row
    tier = F.when(F.col("_best") == 3, F.col("_h") > 0).when(F.col("_best") == 2, F.col("_f") > 0).otherwise(F.col("_w") > 0)
    top = x.where(tier).orderBy(F.desc("severity"), key).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("severity"), key))).drop("_h", "_f", "_w", "_best")  # k rows


def leaf_groups(leaves: DataFrame, group: str, path: str, leaf: str, least: int = 30) -> DataFrame:
    """Leaf rows of (group, path) with enough rows that aren't blank: what signals are run on, leaf by leaf."""
    x = leaves.where(F.trim(F.coalesce(F.col(leaf), F.lit(""))) != "")
    big = x.groupBy(group, path).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")
    return with_group(x, big.withColumn("_big", F.lit(True)), [group, path], "inner").drop("_big")


def leaf_density(leaves: DataFrame, key: str, group: str, path: str, vector: str, k: int = 10, q: float = 0.995) -> DataFrame:
    """key, group, path, density, threshold, pass: mean distance to the nearest leaves of the same group and path, against a quantile of them."""
    from gatelens.operators.signals import knn

    x = leaves.withColumn("_leaf", F.concat_ws("\x1f", group, path))
    near = knn(x.withColumn("_id", F.concat_ws("\x1f", "_leaf", key)), "_id", vector, k, "euclidean", "_leaf")
    d = near.groupBy("_id").agg(F.avg(F.col("distance").cast("double")).alias("density"))
    x = x.withColumn("_id", F.concat_ws("\x1f", "_leaf", key)).join(d, "_id").select(key, group, path, "density")
    x = saved(x)
    return with_group(x, x.groupBy(group, path).agg(F.percentile("density", F.lit(q)).alias("threshold")), [group, path]).withColumn("pass", F.col("density") <= F.col("threshold"))


def with_fallback(evaluated: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """Leaf results, and for rows without any the group's own, under a leaf of that name."""
    rest = fallback.join(evaluated.select(key).distinct(), key, "left_anti")
    return evaluated.unionByName(rest, allowMissingColumns=True)


def leaf_thresholds(leaf: DataFrame, group: str, rule: str, threshold: str = "threshold") -> DataFrame:
    """group, rule, threshold: the median of its leaves' thresholds."""
    return leaf.groupBy(group, rule).agg(F.median(threshold).alias("threshold"), F.count("*").alias("leaves"))


def triplets(hits_: DataFrame, leaf: str, rule: str, most: int = 8) -> DataFrame:
    """leaf, rule, risk, quality: bundle axes of the leaves with most hits."""
    from gatelens.operators.scoring import axis_profile

    top = hits_.where("available").groupBy(leaf).count().orderBy(F.desc("count"), leaf).limit(most).select(leaf)
    return axis_profile(hits_.where("available").join(F.broadcast(top), leaf), [leaf, rule], "signal")  # `most` rows
