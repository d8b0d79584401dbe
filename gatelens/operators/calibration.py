"""Calibration of quantile thresholds by cross-validation, and their application; thresholds of all candidates come from one pass.

A row of a held-out fold counts how many of its training folds' quantiles it exceeds, rule by rule. Counts of rows by these
numbers, which are at most as many as the grid has cells, are all that the driver needs to judge every candidate.
"""

from __future__ import annotations

import itertools
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelens.functions.scalar import finite
from gatelens.operators import stats
from gatelens.sources.scratch import saved, with_group


def group_quantiles(df: DataFrame, by: list[str], group: str, value: str, qs: list[float]) -> DataFrame:
    """by, group, _t, and rows of a null group and _all = true for the whole: quantiles of the finite values."""
    x = df.withColumn("_x", finite(value)).where("_x is not null")
    agg = F.percentile("_x", F.array(*map(F.lit, qs))).alias("_t")
    own = x.groupBy(*by, group).agg(agg).withColumn("_all", F.lit(False))
    return own.unionByName(x.groupBy(*by).agg(agg).withColumn("_all", F.lit(True)), allowMissingColumns=True)


def with_quantiles(df: DataFrame, quantiles: DataFrame, by: list[str], group: str) -> DataFrame:
    """df with _t: the quantiles of its group, or of the whole where the group has none."""
    own = quantiles.where("not _all").select(*by, group, F.col("_t").alias("_own"))
    whole = quantiles.where("_all").select(*by, F.col("_t").alias("_whole"))
    return with_group(with_group(df, own, [*by, group]), whole, by).withColumn("_t", F.coalesce("_own", "_whole")).drop("_own", "_whole")


def exceeded(df: DataFrame, group: str, value: str, fold: str, qs: list[float], name: str) -> DataFrame:
    """df with how many of the other folds' quantiles a row's value exceeds; 0 for no value."""
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())  # a handful
    train = df.select(group, value, fold, F.explode(F.array(*map(F.lit, folds))).alias("_held")).where(F.col(fold) != F.col("_held"))
    t = group_quantiles(train, ["_held"], group, value, qs).withColumnRenamed("_held", fold)
    x = with_quantiles(df, saved(t), [fold], group)
    n = F.size(F.filter("_t", lambda c: F.col(value) > c))
    return x.withColumn(name, F.when(finite(value).isNull(), 0).otherwise(F.coalesce(n, F.lit(0)))).drop("_t")


def _metrics(tp, fp, fn):
    p = np.divide(tp, tp + fp, out=np.zeros_like(tp), where=tp + fp > 0)
    r = np.divide(tp, tp + fn, out=np.zeros_like(tp), where=tp + fn > 0)
    return p, r, np.divide(2 * p * r, p + r, out=np.zeros_like(p), where=p + r > 0)


def fit_distance(df: DataFrame, group: str, bad: str, fold: str, quantiles: dict[str, list[float]], precision: float = 0.95) -> DataFrame:
    """A row per candidate: its quantile of each rule (a column), mean precision, recall, f1 and fp over folds, met, chosen.

    A row is flagged if any rule's value exceeds its threshold: its group's in the other folds, or that of all groups. Of the
    candidates of enough precision, or of all if none is, the one of the best f1, least fp, best recall and precision counts.
    """
    rules = list(quantiles)
    x = df.where(F.col(bad).isNotNull())
    for i, r in enumerate(rules):
        x = exceeded(x, group, r, fold, quantiles[r], f"_k{i}")
    counts = x.groupBy(fold, F.col(bad).alias("_y"), *[f"_k{i}" for i in range(len(rules))]).count().collect()  # at most the grid's cells by fold and label
    folds = sorted({r[0] for r in counts})
    shape = tuple(len(quantiles[r]) + 1 for r in rules)
    cells = np.zeros((len(folds), 2, *shape))
    for r in counts:
        cells[(folds.index(r[0]), int(r["_y"]), *(r[f"_k{i}"] for i in range(len(rules))))] += r["count"]
    held = cells
    for axis in range(2, held.ndim):
        held = held.cumsum(axis=axis)  # rows that exceed at most so many quantiles of each rule
    kept = held[(slice(None), slice(None), *(slice(0, n - 1) for n in shape))]
    total = cells.sum(axis=tuple(range(2, cells.ndim)))
    rest = (slice(None), *(None,) * len(rules))
    fn, tn = kept[:, 1], kept[:, 0]
    tp, fp = total[:, 1][rest] - fn, total[:, 0][rest] - tn
    p, r, f = (m.mean(axis=0) for m in _metrics(tp, fp, fn))
    rows = []
    for at in itertools.product(*(range(n - 1) for n in shape)):
        rows.append((*(float(quantiles[k][i]) for k, i in zip(rules, at, strict=True)), float(p[at]), float(r[at]), float(f[at]), float(fp.mean(axis=0)[at])))
    return _chosen(df.sparkSession, [f"q_{k}" for k in rules] + ["mean_precision", "mean_recall", "mean_f1", "mean_fp"], rows, "mean_precision", precision, ("-mean_f1", "mean_fp", "-mean_recall", "-mean_precision"))


def _chosen(spark, names: list[str], rows: list[tuple], held: str, least: float, order: tuple[str, ...]) -> DataFrame:
    """The candidates with met (whether any reaches the least) and chosen."""
    at = names.index(held)
    ok = [r for r in rows if r[at] >= least]
    key = lambda r: (*((-1 if o[0] == "-" else 1) * round(r[names.index(o.lstrip("-"))], 9) for o in order), r)
    best = min(ok or rows, key=key, default=None)
    return spark.createDataFrame([(*r, bool(ok), r == best) for r in rows], ", ".join(f"`{n}` double" for n in names) + ", met boolean, chosen boolean")


def selected(candidates: DataFrame) -> dict[str, float]:
    """The chosen candidate's quantiles by rule."""
    row = candidates.where("chosen").first()
    return {c.removeprefix("q_"): row[c] for c in candidates.columns if c.startswith("q_")}


def distance_thresholds(df: DataFrame, group: str, chosen: dict[str, float]) -> DataFrame:
    """group (null with is_global for all), rule, threshold: each rule's quantile of the rows given."""
    parts = []
    for rule, q in chosen.items():
        t = group_quantiles(df, [], group, rule, [q])
        parts.append(t.select(group, F.col("_all").alias("is_global"), F.lit(rule).alias("rule"), F.col("_t")[0].alias("threshold")))
    return reduce(DataFrame.unionByName, parts)


def predict(df: DataFrame, group: str, thresholds: DataFrame, rules: list[str]) -> DataFrame:
    """df with flagged_by (rules whose value exceeds its threshold) and flagged; thresholds as of distance_thresholds."""
    hit = []
    for i, rule in enumerate(rules):
        t = thresholds.where(F.col("rule") == rule)
        df = with_group(df, t.where("not is_global").select(group, F.col("threshold").alias(f"_o{i}")), [group])
        df = df.crossJoin(F.broadcast(t.where("is_global").select(F.col("threshold").alias(f"_w{i}"))))  # one row
        hit.append(F.when(finite(rule) > F.coalesce(f"_o{i}", f"_w{i}"), F.lit(rule)))
    df = df.withColumn("flagged_by", F.array_compact(F.array(*hit))).drop(*[f"_{k}{i}" for i in range(len(rules)) for k in "ow"])
    return df.withColumn("flagged", F.size("flagged_by") > 0)


def apply_distance(df: DataFrame, group: str, chosen: dict[str, float], gate: str, eligible: Column | None = None) -> DataFrame:
    """df with flagged, distribution_pass and final_pass by thresholds at the chosen quantiles of the eligible rows; rows that fail the gate aren't judged."""
    base = df.where(F.col(gate) if eligible is None else F.col(gate) & eligible)
    out = predict(df, group, saved(distance_thresholds(base, group, chosen)), list(chosen))
    judged = F.coalesce(F.col(gate), F.lit(False))
    return out.withColumn("distribution_pass", ~judged | ~F.col("flagged")).withColumn("final_pass", judged & ~F.col("flagged"))


def calibrated_summary(df: DataFrame, group: str, gate: str) -> DataFrame:
    """group, n, gate_rate, flag_rate, final_rate of rows as of apply_distance."""
    return df.groupBy(group).agg(
        F.count("*").alias("n"), F.avg(F.col(gate).cast("double")).alias("gate_rate"), F.avg(F.when(F.col(gate), F.col("flagged").cast("double"))).alias("flag_rate"), F.avg(F.col("final_pass").cast("double")).alias("final_rate")
    )


def fit_tristate(df: DataFrame, group: str, value: str, bad: str, fold: str, warn: list[float], fail: list[float], precision: float = 0.95) -> DataFrame:
    """A row per pair of quantiles warn < fail: mean precision, recall, f1 and fp of failures, mean lift and coverage of warnings over folds, met, chosen.

    Of the pairs of enough precision, or of all if none is, the one of the best f1, lift, least fp and best recall counts.
    """
    qs = sorted({*warn, *fail})
    x = exceeded(df.where(F.col(bad).isNotNull() & finite(value).isNotNull()), group, value, fold, qs, "_k")
    counts = x.groupBy(fold, F.col(bad).alias("_y"), "_k").count().collect()  # a number per fold, label and quantile
    folds = sorted({r[0] for r in counts})
    cells = np.zeros((len(folds), 2, len(qs) + 1))
    for r in counts:
        cells[folds.index(r[0]), int(r["_y"]), r["_k"]] += r["count"]
    above = cells[:, :, ::-1].cumsum(axis=2)[:, :, ::-1]  # rows that exceed at least so many
    n, rows = cells.sum(axis=(1, 2)), []
    share = lambda a, b: np.divide(a, b, out=np.zeros_like(a), where=b > 0)
    for f in sorted(set(fail)):
        for w in sorted(set(warn)):
            if w >= f:
                continue
            i, j = qs.index(w) + 1, qs.index(f) + 1
            tp, fp = above[:, 1, j], above[:, 0, j]
            p, r, f1 = _metrics(tp, fp, above[:, 1, 0] - tp)
            warned, passed = above[:, :, i] - above[:, :, j], above[:, :, 0] - above[:, :, i]
            lift = share(warned[:, 1], warned.sum(axis=1)) - share(passed[:, 1], passed.sum(axis=1))
            rows.append((w, f, *(float(m.mean()) for m in (p, r, f1, fp, lift, share(warned.sum(axis=1), n)))))
    names = ["q_warn", "q_fail", "mean_fail_precision", "mean_fail_recall", "mean_fail_f1", "mean_fail_fp", "mean_warn_lift", "mean_warn_coverage"]
    return _chosen(df.sparkSession, names, rows, "mean_fail_precision", precision, ("-mean_fail_f1", "-mean_warn_lift", "mean_fail_fp", "-mean_fail_recall"))


def apply_tristate(df: DataFrame, group: str, value: str, q_warn: float, q_fail: float, available: Column | None = None, semantic: bool = False) -> DataFrame:
    """df with state by its group's quantiles of the available rows, or all groups' where it has none; na without a value.

    semantic: rows that aren't available warn, and block nothing.
    """
    q_warn = q_warn if q_warn < q_fail else max(0.0001, q_fail - 0.01)
    x = finite(value) if available is None else F.when(available, finite(value))
    t = group_quantiles(df.withColumn("_a", x), [], group, "_a", [q_warn, q_fail])
    out = with_quantiles(df, saved(t), [], group)
    warn, fail = F.least(F.col("_t")[0], F.col("_t")[1]), F.col("_t")[1]
    return out.withColumn("state", F.when(x.isNull(), "warn" if semantic else "na").when(x > fail, "fail").when(x > warn, "warn").otherwise("pass")).drop("_t")


def refine_reference(df: DataFrame, by: list[str], values: list[str], q: float, reference: str, rounds: int = 2, least: int = 40) -> DataFrame:
    """df with reference rows narrowed: those whose values are all within their group's quantile, round by round, while a group keeps enough."""
    for _ in range(rounds):
        t = df.where(F.col(reference)).groupBy(*by).agg(*[F.percentile(finite(v), F.lit(q)).alias(f"_t{i}") for i, v in enumerate(values)])
        x = with_group(df, t, by)
        ok = reduce(lambda a, b: a & b, [F.coalesce(finite(v) <= F.col(f"_t{i}"), F.lit(True)) for i, v in enumerate(values)])
        x = x.withColumn("_stay", F.col(reference) & ok)
        n = x.groupBy(*by).agg((F.count_if("_stay") >= least).alias("_enough"))
        df = saved(with_group(x, n, by).withColumn(reference, F.when(F.col("_enough"), F.col("_stay")).otherwise(F.col(reference))).drop("_stay", "_enough", *[f"_t{i}" for i in range(len(values))]))
    return df


def best_candidates(df: DataFrame, order: list[Column], held: Column | None = None) -> DataFrame:
    """df, a small table of candidates, ranked: those that hold first."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*([F.desc(held)] if held is not None else []), *order)))


def lambda_stability(runs: DataFrame, value: str = "f1") -> DataFrame:
    """lambda, n, mean, median, std, least and tenth percentile of the gain over lambda zero, wins, ties and losses, rank.

    runs (dataset, lambda, a value). Fewest losses first, then the largest least gain, the smallest spread, the largest mean.
    """
    base = runs.where("lambda = 0").groupBy("dataset").agg(F.max(value).alias("_base"))
    x = runs.where("lambda > 0").join(base, "dataset").withColumn("_d", F.col(value) - F.col("_base"))
    g = x.groupBy("lambda").agg(
        F.count("*").alias("n"), F.avg("_d").alias("mean"), F.median("_d").alias("median"), F.stddev_pop("_d").alias("std"), F.min("_d").alias("least"), F.percentile("_d", F.lit(0.1)).alias("p10"),
        F.count_if(F.col("_d") > 1e-9).alias("wins"), F.count_if(F.abs("_d") <= 1e-9).alias("ties"), F.count_if(F.col("_d") < -1e-9).alias("losses"),
    )
    k = [F.col("losses"), F.desc(F.round("least", 9)), F.round("std", 9), F.desc(F.round("mean", 9)), F.col("lambda")]
    return best_candidates(g, k)


def variant_metrics(rows: DataFrame, by: list[str], bad: str, predicted: str) -> DataFrame:
    """by, metric, value: confusion metrics of each variant, long."""
    c = stats.confusion(rows, bad, predicted, by)
    names = ("precision", "recall", "f1", "fpr", "bad_rate")
    return c.select(*by, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])).alias("m")).select(*by, "m.*")
