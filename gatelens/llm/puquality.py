"""Positive-unlabelled quality classifier.

Trusted positives are labelled documents of good quality; the unlabelled set is all documents. The class prior is
estimated by the best-bin rule: under the score of a first classifier, the share of all documents in a top region over
the share of the positives there bounds the prior from above, and the region with the lowest confidence bound gives it.
A linear model then minimises the non-negative unbiased risk
    prior * E_pos[l(z)] + max(0, E_all[l(-z)] - prior * E_pos[l(-z)]),   l(z) = log(1 + exp(-z)),
by Newton steps with a line search on that risk. Every pass sums over all documents' features; the driver gets the sums.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.llm.common import Scratch, fold_column, over_batches, texts
from gatelens.llm.linear import RIDGE, STEPS, matrix, sigmoid, softplus, sums

FOLDS = 5
HELD_OUT = 0
THRESHOLD = 0.3
#: Labelled positives that are used at most, by a hash of their id.
LABELLED_ROWS = 1_000_000
BINS = 400
SYMBOLS = b"#$%&*@^~<>{}[]\\_=+"
LINE = re.compile(r"[^\n]+")

_CODE = np.arange(256)
_GROUPS = np.stack([
    (_CODE >= 65) & (_CODE <= 90), (_CODE >= 97) & (_CODE <= 122), (_CODE >= 48) & (_CODE <= 57), _CODE >= 128,
    np.isin(_CODE, list(SYMBOLS)), _CODE == ord("|"), _CODE == ord("!"), _CODE == ord("?"), np.isin(_CODE, list(b".,;:")),
    np.isin(_CODE, list(b"\"'()-/")), _CODE == 10,
]).astype(np.float64)
#: Features of a text: a constant, and shares that say how much of it is symbols, shouting, tables, repeats and the like.
WIDTH = 20


def features(text: str) -> list[float]:
    raw = text.encode("utf-8", "surrogatepass")
    upper, lower, digit, high, symbol, pipe, bang, ask, stop, quote, _ = _GROUPS @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, words = max(len(raw), 1), text.split()
    k = len(words)
    m = max(k, 1)
    distinct = len(set(words))
    same = sum(map(str.__eq__, words, words[1:]))
    lines = LINE.findall(text)
    again = 1 - len(set(lines)) / len(lines) if lines else 0.0
    full = lambda rate, at: 1 - np.exp(-rate / at)
    return [
        1.0, k == 0, full(k, 5), full(k, 50), full(k, 1000), full(upper / max(upper + lower, 1), 0.2), full(digit / n, 0.1),
        high / n, full(symbol / n, 0.02), full(symbol / m, 0.3), full(pipe / m, 0.1), full(bang / m, 0.1), full(ask / m, 0.1),
        full(stop / m, 0.1), full(quote / m, 0.1), full(same / m, 0.05), full(same / m, 0.4), (1 - distinct / m) ** 2,
        full(again, 0.2), full(abs(n / m - 7), 5),
    ]


def _features(batch: pa.RecordBatch) -> pa.RecordBatch:
    x = np.array([features(t) for t in texts(batch)], np.float32).reshape(-1)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * WIDTH), pa.array(x))
    return pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "x"])


def feature_table(docs: DataFrame) -> DataFrame:
    return over_batches(docs.select(F.col("doc_id").cast("long"), "text"), _features, "doc_id long, x array<float>")


def trusted(labels: DataFrame, limit: int = LABELLED_ROWS) -> DataFrame:
    """Ids of the positives that may be learned from, each once."""
    ids = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long")).where(fold_column(k=FOLDS) != HELD_OUT).distinct()
    n = ids.count()
    return ids if n <= limit else ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < limit)


def _both(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    x = matrix(b.column(0), WIDTH)
    return x, x[b.column(1).to_numpy(zero_copy_only=False).astype(bool)]


def minimise(table: DataFrame, prior: float, rounds: int = 12) -> np.ndarray:
    """Weights of least non-negative risk over table (x, pos)."""
    head = sums(table, lambda b: np.concatenate((lambda x, p: ([len(x), len(p)], p.sum(axis=0)))(*_both(b))))
    if not len(head) or not head[1]:
        return np.zeros(WIDTH)
    n_all, n_pos, mean_pos = head[0], head[1], head[2:] / head[1]
    w = np.zeros(WIDTH)
    for _ in range(rounds):

        def slope(b: pa.RecordBatch, w=w) -> np.ndarray:
            x, _ = _both(b)
            p = sigmoid(x @ w)
            return np.concatenate((x.T @ p, ((x * (p * (1 - p))[:, None]).T @ x).ravel()))

        s = sums(table, slope) / n_all
        grad = s[:WIDTH] - prior * mean_pos + RIDGE * w
        step = np.linalg.solve(s[WIDTH:].reshape(WIDTH, WIDTH) + RIDGE * np.eye(WIDTH), grad)
        step *= min(1.0, 5 / max(np.abs(step).max(), 1e-12))

        def losses(b: pa.RecordBatch, w=w, step=step) -> np.ndarray:
            x, p = _both(b)
            z = [(x @ v, p @ v) for v in (w - t * step for t in (0.0, *STEPS))]
            return np.array([f for a, q in z for f in (softplus(a).sum(), softplus(q).sum(), softplus(-q).sum())])

        every, pos_wrong, pos_right = sums(table, losses).reshape(-1, 3).T
        risk = prior * pos_right / n_pos + np.maximum(0, every / n_all - prior * pos_wrong / n_pos)
        risk = risk + RIDGE / 2 * np.array([((w - t * step) ** 2).sum() for t in (0.0, *STEPS)])
        best = int(np.argmin(risk))
        if best == 0:
            break
        moved = STEPS[best - 1] * step
        w = w - moved
        if np.abs(moved).max() < 5e-3:
            break
    return w


def estimate_prior(table: DataFrame, w: np.ndarray) -> float:
    """Best-bin estimate under the score of w, from histograms of all documents and of the positives."""

    def bins(b: pa.RecordBatch) -> np.ndarray:
        x, p = _both(b)
        return np.concatenate([np.bincount((sigmoid(v @ w) * (BINS - 1e-9)).astype(int), minlength=BINS) for v in (x, p)])

    s = sums(table, bins)
    if not len(s):
        return 0.5
    (n_all, n_pos), (top, top_pos) = s.reshape(2, BINS).sum(axis=1), np.cumsum(s.reshape(2, BINS)[:, ::-1], axis=1)
    if not n_pos:
        return 0.5
    q, q_pos = top / n_all, top_pos / n_pos
    slack = np.sqrt(np.log(40) / (2 * n_all)) + np.sqrt(np.log(40) / (2 * n_pos))
    ok = q_pos > 2 * slack
    if not ok.any():
        return 0.5
    at = np.flatnonzero(ok)[np.argmin((q[ok] + slack) / q_pos[ok])]
    return float(np.clip(q[at] / q_pos[at], 0.01, 0.99))


class QualityModel:
    def __init__(self, w: np.ndarray, prior: float):
        self.w, self.prior = w, prior

    @classmethod
    def fit(cls, table: DataFrame, labels: DataFrame, scratch: Scratch) -> QualityModel:
        """table (doc_id, x) of all documents; labels (doc_id, quality). Without positives every score is 0.5."""
        pos = trusted(labels).withColumnRenamed("doc_id", "_id").withColumn("pos", F.lit(True))
        table = table.join(pos, table.doc_id == F.col("_id"), "left").select("x", F.coalesce("pos", F.lit(False)).alias("pos"))
        table = scratch.save(table)
        prior = estimate_prior(table, minimise(table, 0.5, 6))
        out = cls(minimise(table, prior), prior)
        scratch.drop(table)
        return out

    def add_scores(self, df: DataFrame) -> DataFrame:
        """df (x, any other columns) with a score, a plain expression."""
        terms = [F.col("x")[i].cast("double") * F.lit(float(v)) for i, v in enumerate(self.w)]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        return df.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-total))).drop("x")


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs (doc_id, text, any other columns).

    A null text reads as empty; empty texts are scored like any other. A row without doc_id is scored and is never
    learned from. Repeated rows come back as often as they are given. No rows, no result.
    """
    scratch = Scratch(docs.sparkSession)
    table = scratch.save(feature_table(docs))
    out = QualityModel.fit(table, labels, scratch).add_scores(table)
    return out.select("doc_id", (fold_column(k=FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold, every column kept."""
    scratch = Scratch(docs.sparkSession)
    model = QualityModel.fit(scratch.save(feature_table(docs)), labels, scratch)
    w, names = model.w, docs.columns

    def good(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([features(t) for t in texts(batch)], np.float64).reshape(-1, WIDTH)
        return batch.filter(pa.array(sigmoid(x @ w) >= threshold))

    return over_batches(docs, good, docs.schema).select(names)
