"""Means and covariances of vector columns, summed by partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.functions.vectors import sanitize


def covariance(df: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population covariance; the driver gets d * (d + 1) + 1 numbers, whatever the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = np.array(b.column(0).to_pylist(), float)
                s = np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
                total = s if total is None else total + s
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])

    got = df.select(sanitize(vector).alias("v")).mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    if not got:
        return np.zeros(0), np.zeros((0, 0))
    s = np.array([r.v for r in got])
    n, d = s[0], int((-1 + np.sqrt(1 + 4 * (len(s) - 1))) / 2)
    mean = s[1 : d + 1] / n
    return mean, s[d + 1 :].reshape(d, d) / n - np.outer(mean, mean)
