"""Window and sequence operators of the threshold policies. Ties break on an id, so results don't hang on row order."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelens.functions.scalar import clip, finite
from gatelens.operators.stats import robust_sigma
from gatelens.sources.scratch import saved, with_group


#: Rows of a range at most, whatever the table; rows below which a range isn't split for the sake of idle cores.
RANGE, SMALL = 250_000, 20_000


def ordered(df: DataFrame, by: list[str], value: str, order: str, weight: str | None = None) -> DataFrame:
    """df with _i (place in its group in the order of value and order, from 1), _n (rows of the group) and _next (the next value).

    With a weight, also _run (weights up to the row) and _total. Rows are dealt by ranges, so a group spreads over tasks; the
    ranges meet through their counts and first values alone.
    """
    keys = [*by, value, order]
    df = saved(df)
    n, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    parts = max(math.ceil(n / RANGE), min(cores, math.ceil(n / SMALL)), 1)  # told, or partitions would be as large as their packed bytes allow
    x = saved(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_p", F.spark_partition_id()))
    w = Window.partitionBy("_p", *by).orderBy(value, order)
    sums = [F.sum(weight).alias("_w")] if weight else []
    edges = x.groupBy("_p", *by).agg(F.count("*").alias("_c"), F.min(value).alias("_first"), *sums)
    g, before = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row per range and group
    cols = [F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_ahead"), F.sum("_c").over(g).alias("_n"), F.lead("_first").over(g.orderBy("_p")).alias("_after")]
    if weight:
        cols += [F.coalesce(F.sum("_w").over(before), F.lit(0.0)).alias("_w_ahead"), F.sum("_w").over(g).alias("_total")]
    x = x.repartition(parts, "_p", *by)
    x = with_group(x.withColumn("_i", F.row_number().over(w)).withColumn("_next", F.lead(value).over(w)), saved(edges.select("_p", *by, *cols)), ["_p", *by])
    x = x.withColumn("_i", F.col("_i") + F.col("_ahead")).withColumn("_next", F.coalesce("_next", "_after"))
    if weight:
        x = x.withColumn("_run", F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_w_ahead")).drop("_w_ahead")
    return x.drop("_p", "_ahead", "_after")


def rank_share(df: DataFrame, by: list[str], value: str, order: str, name: str = "rank") -> DataFrame:
    return ordered(df, by, value, order).withColumn(name, F.col("_i") / F.col("_n")).drop("_i", "_n", "_next")


def soft_weights(df: DataFrame, by: list[str], risk: str, order: str, start: float = 0.90, alpha: float = 6.0, least: float = 0.05) -> DataFrame:
    """weight = exp(-alpha * max(0, rank - start)), at least `least`."""
    out = rank_share(df, by, risk, order, "_rank")
    return out.withColumn("weight", clip(F.exp(-alpha * F.greatest(F.col("_rank") - start, F.lit(0.0))), least, 1.0)).drop("_rank")


def gap_jump(df: DataFrame, by: list[str], z: str, order: str, least: float = 0.005, most: float = 0.30, strong: float = 4.0, weak: float = 2.5, rows: int = 40, eps: float = 1e-12, raised: bool = True) -> DataFrame:
    """by, jump, gap_z, kind: the first gap of the sorted z >= 0, in a window of survival, whose robust z is strong; else the largest weak one.

    raised: the window reaches to the share of positive z and 0.05, at most 0.95. One without five gaps is widened once.
    Null without five gaps, or with flat ones.
    """
    x = ordered(df.withColumn("_z", finite(z)).where("_z >= 0").select(*by, "_z", order), by, "_z", order).where(F.col("_n") >= rows)
    positive = x.groupBy(*by).agg(F.avg((F.col("_z") > 0).cast("double")).alias("_mass"))
    x = x.withColumn("_gap", F.col("_next") - F.col("_z")).withColumn("_s", (F.col("_n") - F.col("_i")) / F.col("_n")).where("_gap > 0")
    x = with_group(x, positive, by)
    to = F.least(F.lit(0.95), F.greatest(F.lit(most), F.col("_mass") + 0.05)) if raised else F.lit(min(0.95, most))
    x = saved(x.withColumn("_in", F.col("_s").between(least, to)).withColumn("_near", F.col("_s").between(max(1e-5, least / 2), F.least(F.lit(0.98), to + 0.1))))
    enough = x.groupBy(*by).agg((F.count_if("_in") >= 5).alias("_first"), (F.count_if("_near") >= 5).alias("_second"))
    x = with_group(x, enough, by).where((F.col("_first") & F.col("_in")) | (~F.col("_first") & F.col("_second") & F.col("_near")))
    x = with_group(x, robust_sigma(x, by, "_gap", eps), by).where("sigma is not null").withColumn("gz", (F.col("_gap") - F.col("median")) / F.col("sigma"))
    pick, top = F.struct("_i", "_next", "gz"), F.struct("gz", (-F.col("_i")).alias("_o"), "_next")
    r = x.groupBy(*by).agg(F.min(F.when(F.col("gz") >= strong, pick)).alias("s"), F.max(top).alias("t"))
    some = F.col("t.gz") >= weak
    kind = F.when(F.col("s").isNotNull(), "strong_first").when(some, "weak_max").otherwise("none")
    return r.select(*by, F.coalesce("s._next", F.when(some, F.col("t._next"))).alias("jump"), F.coalesce("s.gz", "t.gz").alias("gap_z"), kind.alias("kind"))


def log_survival(df: DataFrame, by: list[str], value: str, points: int, low: Column, high: Column) -> DataFrame:
    """by, i, x, survival, smooth, d1, d2 on an even grid: log of the share of values at or above, smoothed by 1 2 3 2 1, differences."""
    x = df.withColumn("_v", finite(value)).where("_v is not null")
    ends = x.groupBy(*by).agg(low.alias("_lo"), high.alias("_hi"), F.count("*").alias("_n"))
    ends = ends.withColumn("_step", (F.col("_hi") - F.col("_lo")) / (points - 1))
    grid = ends.select(*by, "_lo", "_n", "_step", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    # counts per grid cell, summed from the right: no row meets more than one grid point; a value counts at points 0 to its cell
    at = lambda k: F.col("_lo") + k * F.col("_step")
    cell = F.when(F.col("_step") > 0, F.floor((F.col("_v") - F.col("_lo")) / F.col("_step"))).otherwise(points - 1)
    x = with_group(x, ends, by, "inner").withColumn("_k", cell)
    exact = F.when(at(F.col("_k")) > F.col("_v"), F.col("_k") - 1).when(at(F.col("_k") + 1) <= F.col("_v"), F.col("_k") + 1).otherwise(F.col("_k"))
    counts = x.where(F.col("_v") >= F.col("_lo")).groupBy(*by, F.least(exact, F.lit(points - 1)).cast("int").alias("i")).agg(F.count("*").alias("_c"))
    g = with_group(grid, counts, [*by, "i"])
    w = Window.partitionBy(*by).orderBy("i")  # a row per group and grid point
    s = F.coalesce(F.sum("_c").over(w.rowsBetween(0, Window.unboundedFollowing)), F.lit(0)) / F.col("_n")
    g = g.withColumn("survival", s).withColumn("_l", F.log(F.greatest(F.col("survival"), F.lit(1e-12))))
    near = lambda c, k: F.coalesce(F.lag(c, -k).over(w), F.lit(0.0))
    g = g.withColumn("smooth", (near("_l", -2) + 2 * near("_l", -1) + 3 * F.col("_l") + 2 * near("_l", 1) + near("_l", 2)) / 9)

    def gradient(c: str) -> Column:
        before, after = F.lag(c).over(w), F.lead(c).over(w)
        return F.when(before.isNull(), after - F.col(c)).when(after.isNull(), F.col(c) - before).otherwise((after - before) / 2)

    g = g.withColumn("d1", gradient("smooth"))
    return g.withColumn("d2", gradient("d1")).select(*by, "i", (F.col("_lo") + F.col("i") * F.col("_step")).alias("x"), "survival", "smooth", "d1", "d2")


def tail_start(df: DataFrame, by: list[str], z: str, least: float = 0.005, most: float = 0.30, floor: float = 0.5, points: int = 160, rows: int = 40, raise_most: bool = False) -> DataFrame:
    """by, points, knee: the grid point of sharpest bend of the log-survival curve of z >= 0 in a window of survival.

    raise_most: the window reaches to the share of positive z and 0.05, at most 0.95. One of fewer than five points is widened once. Groups of fewer than `rows` such z, or without a positive one, have none.
    """
    x = df.withColumn("_z", finite(z)).where("_z >= 0").select(*by, "_z")
    mass = F.avg((F.col("_z") > 0).cast("double"))
    to = F.least(F.lit(0.95), F.greatest(F.lit(most), mass + 0.05)) if raise_most else F.lit(most)
    enough = saved(x.groupBy(*by).agg(F.count("*").alias("_rows"), F.percentile("_z", F.lit(0.995)).alias("_top"), to.alias("_to")))
    x = with_group(x, enough, by, "inner").where((F.col("_rows") >= rows) & (F.col("_top") > 0))
    g = with_group(log_survival(x, by, "_z", points, F.lit(0.0), F.max("_top")).where(F.col("x") >= floor), enough.select(*by, "_to"), by)
    g = g.withColumn("_in", F.col("survival").between(F.lit(least), F.col("_to"))).withColumn("_near", F.col("survival").between(F.lit(max(1e-5, least / 2)), F.least(F.lit(0.95), F.greatest(F.col("_to"), F.lit(0.5)))))
    m = F.struct(F.round("d2", 12).alias("d2"), "i", "x")
    r = g.groupBy(*by).agg(F.count_if("_in").alias("_a"), F.count_if("_near").alias("_b"), F.min(F.when(F.col("_in"), m)).alias("_m"), F.min(F.when(F.col("_near"), m)).alias("_k"))
    own = F.col("_a") >= 5
    return r.select(*by, F.when(own, F.col("_a")).otherwise(F.col("_b")).alias("points"), F.when(own, F.col("_m.x")).when(F.col("_b") >= 5, F.col("_k.x")).alias("knee"))


def first_flat_run(g: DataFrame, by: list[str], flat: Column, length: int = 4) -> DataFrame:
    """by, start, x: the first run of so many grid points for which flat holds."""
    w = Window.partitionBy(*by).orderBy("i")
    run = F.sum(flat.cast("int")).over(w.rowsBetween(0, length - 1)) == length
    return g.withColumn("_run", run).where("_run").groupBy(*by).agg(F.min(F.struct("i", "x")).alias("m")).select(*by, F.col("m.i").alias("start"), F.col("m.x").alias("x"))


def rolling_jump(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """by, at: the order of the largest rise of the centred mean of three."""
    w = Window.partitionBy(*by).orderBy(order)
    s = df.withColumn("_s", F.avg(value).over(w.rowsBetween(-1, 1)))
    s = s.withColumn("_d", F.coalesce(F.col("_s") - F.lag("_s").over(w), F.lit(0.0)))
    return s.groupBy(*by).agg(F.max(F.struct(F.round("_d", 9).alias("d"), (-F.col(order)).alias("o"))).alias("m")).select(*by, (-F.col("m.o")).alias("at"), F.col("m.d").alias("rise"))


def neighbour_of_zero(df: DataFrame, by: list[str], value: str) -> DataFrame:
    x = finite(value)
    return df.groupBy(*by).agg(F.min(F.when(x > 0, x)).alias("next_up"), F.max(F.when(x < 0, x)).alias("next_down"))


def folds(df: DataFrame, label: str, order: str, k: int = 5) -> DataFrame:
    """df with a fold, dealt in turn within each label, in the order of a hash of the id."""
    x = ordered(df.withColumn("_h", F.md5(F.col(order).cast("string"))), [label], "_h", order)
    return x.withColumn("fold", (F.col("_i") - 1) % k).drop("_h", "_i", "_n", "_next")


def group_ids(df: DataFrame, group: str, order: str) -> DataFrame:
    """df with group_id g0000, g0001, ... by first appearance; null groups are one."""
    key = F.coalesce(F.col(group).cast("string"), F.lit("__MISSING__"))
    first = df.groupBy(key.alias("_k")).agg(F.min(order).alias("_first"), F.count("*").alias("group_size"))
    ids = ordered(first.withColumn("_all", F.lit(0)), ["_all"], "_first", "_k")
    ids = ids.select("_k", "group_size", F.format_string("g%04d", F.col("_i") - 1).alias("group_id"))
    return df.withColumn("_k", key).join(ids, "_k").drop("_k")


def strong_gap(df: DataFrame, by: list[str], z: str, order: str, least: float = 0.005, most: float = 0.30, strong: float = 4.0) -> DataFrame:
    """by, jump, gap_z: the first strong gap of z >= 0 in a window of survival that the share of positive z doesn't raise."""
    g = gap_jump(df, by, z, order, least, most, strong, weak=float("inf"), raised=False)
    return g.select(*by, "jump", "gap_z")


def tail_split(df: DataFrame, by: list[str], z: str, order: str, starts: DataFrame, strong: float = 4.0, tail_rows: int = 40, keep: int = 8, skip: float = 0.0, delta: float = 0.5, eps: float = 1e-12) -> DataFrame:
    """by, k, gap_z: within the tail from starts (by, k) on, the first strong gap that lies delta beyond it and leaves enough rows above."""
    x = with_group(df.withColumn("_z", finite(z)).where("_z >= 0"), starts.select(*by, F.col("k").alias("_k")), by, "inner").where("_z >= _k")
    x = ordered(x.select(*by, "_z", "_k", order), by, "_z", order).where(F.col("_n") >= tail_rows)
    x = x.withColumn("_gap", F.col("_next") - F.col("_z")).where("_gap > 0").where(F.col("_i") - 1 >= F.floor(skip * F.greatest(F.col("_n") - 2, F.lit(1))))
    x = saved(x)
    some = x.groupBy(*by).agg((F.count("*") >= 5).alias("_some"))
    x = with_group(with_group(x, some, by), robust_sigma(x, by, "_gap", eps), by).where("_some and sigma is not null")
    x = x.withColumn("gz", (F.col("_gap") - F.col("median")) / F.col("sigma"))
    ok = (F.col("gz") >= strong) & (F.col("_next") - F.col("_k") >= delta) & (F.col("_n") - F.col("_i") >= keep)
    r = x.groupBy(*by).agg(F.min(F.when(ok, F.struct("_i", "_next", "gz"))).alias("s"), F.max("gz").alias("_g"))
    return r.select(*by, F.col("s._next").alias("k"), F.coalesce("s.gz", "_g").alias("gap_z"))
