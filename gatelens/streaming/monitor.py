"""Streams of signals: states against stored thresholds, windows with late rows, and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.operators.thresholds import apply_states


def scored(stream: DataFrame, thresholds: DataFrame, by: list[str], value: str) -> DataFrame:
    """States of streaming rows; a join with a small static table, without state."""
    return apply_states(stream, thresholds, by, value)


def window_rates(rows: DataFrame, ts: str, by: list[str], width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """window start, by, n, fail_rate of rows with a state; works on streams and tables."""
    g = rows.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *by)
    return g.agg(F.count("*").alias("n"), F.avg(F.col("state").isin("fail", "hard_fail").cast("double")).alias("fail_rate")).select(F.col("w.start").alias("start"), *by, "n", "fail_rate")


def sessions(rows: DataFrame, ts: str, by: list[str], gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    g = rows.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("s"), *by)
    return g.agg(F.count("*").alias("n")).select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), *by, "n")
