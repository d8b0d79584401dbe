"""Distributed sums over feature tables, and linear models fitted by Newton steps on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RIDGE = 1e-3
STEPS = (1.0, 0.5, 0.2, 0.05)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list<float> column."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def sums(df: DataFrame, stats: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """Sum over all batches of a vector of statistics; the driver gets one number per statistic, whatever the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                s = stats(b)
                total = s if total is None else total + s
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total.astype(np.float64))], ["i", "v"])

    got = df.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(max((r.i for r in got), default=-1) + 1)
    for r in got:
        out[r.i] = r.v
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def soft_logistic(table: DataFrame, width: int, rounds: int = 12) -> np.ndarray:
    """Weights of logistic regression on soft labels: table (x array<float>, y double, n double as the row's weight)."""
    table = table.select("x", "y", "n")
    w = np.zeros(width)
    for _ in range(rounds):

        def stats(b: pa.RecordBatch, w=w) -> np.ndarray:
            x = matrix(b.column(0), width)
            y, n = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            p = sigmoid(x @ w)
            return np.concatenate(([n.sum()], x.T @ (n * (p - y)), ((x * (n * p * (1 - p))[:, None]).T @ x).ravel()))

        s = sums(table, stats)
        if not len(s) or s[0] == 0:
            break
        grad, hess = s[1 : width + 1] / s[0] + RIDGE * w, s[width + 1 :].reshape(width, width) / s[0]
        step = np.linalg.solve(hess + RIDGE * np.eye(width), grad)
        w = w - step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-3:
            break
    return w
