"""Joins, top-k and de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelens.functions.scalar import normal_id


def label_lookup(rows: DataFrame, labels: DataFrame, row_id: str, label_id: str, label: str, order: str) -> DataFrame:
    """rows with the label of their id; of an id's labels the last by order counts."""
    last = labels.groupBy(normal_id(label_id).alias("_id")).agg(F.max_by(label, order).alias("label"))
    return rows.join(last, normal_id(row_id) == F.col("_id"), "left").drop("_id")


def top_per_group(df: DataFrame, by: list[str], value: str, order: str, k: int) -> DataFrame:
    """df's k largest per group with their rank; ties by order."""
    w = Window.partitionBy(*by).orderBy(F.desc(value), F.col(order))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_risks(df: DataFrame, key: str, sort: list[Column], k: int) -> DataFrame:
    """The first row of each key under sort, then the k first of them, ranked."""
    one = df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*sort))).where("_r = 1").drop("_r")
    top = one.orderBy(*sort).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*sort)))  # k rows


def not_evaluated(rows: DataFrame, evaluated: DataFrame, key: str) -> DataFrame:
    return rows.join(evaluated.select(key).distinct(), key, "left_anti")


def evaluated_only(rows: DataFrame, evaluated: DataFrame, key: str) -> DataFrame:
    return rows.join(evaluated.select(key).distinct(), key, "left_semi")


def sample_exact(df: DataFrame, key: str, n: int, seed: str = "42") -> DataFrame:
    """n rows, the same every time: those with the smallest hashes."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), key).limit(n)


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def priority_sample(df: DataFrame, key: str, first: str, n: int, seed: str = "42") -> DataFrame:
    """n rows: those marked first, then others, in the order of a hash of the key."""
    return df.orderBy(F.desc(F.coalesce(F.col(first), F.lit(False))), F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), key).limit(n)


def distinct_first(df: DataFrame, value: str, order: str) -> DataFrame:
    """The first row of each value."""
    return df.groupBy(value).agg(F.min(F.struct(order, *[c for c in df.columns if c not in (order, value)])).alias("_r")).select(value, "_r.*")
