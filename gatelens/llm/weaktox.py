"""Toxicity by weak supervision.

Voters are word stems and whole words that labelled toxic documents hold far more often than others, a small built-in
lexicon, and patterns (several hits, dense hits, shouting, none at all in a long text). A generative label model
estimates, by expectation-maximisation over the vote patterns of all documents, the class prior and how each voter
votes under either class, and from the same posteriors the correlations between voters; a voter's evidence is divided
by the weight of those it repeats. A linear classifier is then trained on the posterior labels of all documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.llm.common import Scratch, fold_column, over_batches, text_batches, texts
from gatelens.llm.linear import matrix, sigmoid, soft_logistic, sums

FOLDS = 3
HELD_OUT = 1
THRESHOLD = 0.7
#: Labelled rows that the voters are mined from at most, by a hash of their id.
LABELLED_ROWS = 60_000
#: Voters mined at most; a stem's length; the share of toxic documents that must hold it; how much likelier it must be there.
VOTERS = 96
STEMS = (4, 5, 6, 7)
SUPPORT = 0.004
LIFT = 6.0
#: Standard errors by which its shares in toxic and clean documents must differ, as many terms are tried.
SURE = 5.0
BUILT_IN = ("idiot", "moron", "stupid", "imbecile", "dumbass", "scumbag", "bastard", "arschloch", "dummkopf", "trottel", "connard", "abruti", "crétin", "gilipollas", "imbécil", "estúpido")
WORD = re.compile(r"[^\W\d_]+")
#: After the hits of each voter: a constant, log of all hits, hits a word, kinds of hits, shouting, log of words.
EXTRA = 6
EM_ROUNDS = 15
#: Vote patterns of a task of a pass.
TASK_PATTERNS = 20_000


def terms(text: str) -> set[str]:
    """Words of a text, and their stems with a star."""
    words = set(WORD.findall(text.lower()))
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) >= k}


def _counts(rows: DataFrame, wanted) -> DataFrame:
    """(term, n): documents of rows (text) that hold a term; wanted: a broadcast set of terms, or None for all."""
    text_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only, n = wanted and wanted.value, Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["term", "n"])

        for b in batches:
            for t in texts(b):
                n.update(terms(t) & only if only else terms(t))
            if len(n) > 300_000:
                yield out()
                n.clear()
        yield out()

    return rows.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def mine_voters(docs: DataFrame, labels: DataFrame, limit: int = LABELLED_ROWS, voters: int = VOTERS) -> list[str]:
    """Terms that tell toxic documents, stems with a star; general stems before the words they cover."""
    spark = docs.sparkSession
    known = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("_id"), "toxic")
    known = known.where(fold_column("_id", FOLDS) != HELD_OUT).groupBy("_id").agg(F.max("toxic").alias("_toxic"))
    n = known.count()
    if n > limit:
        known = known.where(F.pmod(F.xxhash64("_id"), F.lit(n)) < limit)
    sizes = dict(known.groupBy("_toxic").count().collect())
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic:
        return list(BUILT_IN)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_id"))  # at most `limit` rows
    least = max(3, SUPPORT * toxic)
    bad = {r.term: r.n for r in _counts(rows.where("_toxic = 1"), None).where(F.col("n") >= least).collect()}  # bounded: terms a document over SUPPORT
    wanted = spark.sparkContext.broadcast(set(bad))
    good = {r.term: r.n for r in _counts(rows.where("_toxic = 0"), wanted).collect()}
    lift = lambda t: (bad[t] + 0.5) / (toxic + 1) / ((good.get(t, 0) + 0.5) / (clean + 1))

    def sure(t: str) -> bool:
        a, b = bad[t], good.get(t, 0)
        share = (a + b) / (toxic + clean)
        gap = (a / toxic - b / max(clean, 1)) / np.sqrt(max(share * (1 - share), 1e-12) * (1 / toxic + 1 / max(clean, 1)))
        return a >= 2 * b and lift(t) >= LIFT and gap >= SURE

    chosen: list[str] = []
    # a stem is worth having if it says more than the words it covers; among equals, the longest
    for t in sorted(filter(sure, bad), key=lambda t: (-bad[t] + 5 * good.get(t, 0), -len(t), t)):
        stem = t.rstrip("*")
        if not any(stem.startswith(c.rstrip("*")) if c.endswith("*") else stem == c for c in chosen):
            chosen = [c for c in chosen if not (t.endswith("*") and c.startswith(stem))] + [t]
        if len(chosen) >= voters:
            break
    return chosen + [w for w in BUILT_IN if not any(w == c or c.endswith("*") and w.startswith(c[:-1]) for c in chosen)]


class Voters:
    def __init__(self, chosen: list[str]):
        self.chosen = chosen
        self.width = len(chosen) + EXTRA

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        by: dict[str, list[tuple[int, bool]]] = {}
        for i, t in enumerate(self.chosen):
            by.setdefault(t.rstrip("*"), []).append((i, t.endswith("*")))
        for stem, own in by.items():
            a.add_word(stem, (len(stem), own))
        a.make_automaton()
        return a

    def hits(self, automaton, text: str) -> np.ndarray:
        """Features of a text."""
        low = text.lower()
        x, n = np.zeros(self.width, np.float32), len(low)
        for end, (size, own) in automaton.iter(low):
            at = end - size
            if at >= 0 and low[at].isalpha():
                continue
            whole = end + 1 >= n or not low[end + 1].isalpha()
            for i, stem in own:
                if stem or whole:
                    x[i] += 1
        k = len(self.chosen)
        words = text.count(" ") + text.count("\n") + 1
        total, kinds = x[:k].sum(), np.count_nonzero(x[:k])
        np.log1p(x[:k], out=x[:k])
        x[k:] = (1, np.log1p(total), 1 - np.exp(-20 * total / words), np.log1p(kinds), 1 - np.exp(-text.count("!") / words / 0.1), np.log1p(words) / 10)
        return x

    def votes(self, x: np.ndarray) -> np.ndarray:
        """Votes (1 toxic, 0 none, -1 clean) of rows of features; four pattern voters follow the terms."""
        k = len(self.chosen)
        hits = x[:, :k] > 0
        kinds, dense, shout, words = np.expm1(x[:, k + 3]), x[:, k + 2], x[:, k + 4], np.expm1(10 * x[:, k + 5])
        several = np.where(kinds >= 2, 1, 0)
        thick = np.where(dense > 0.2, 1, 0)
        loud = np.where((shout > 0.6) & (kinds > 0), 1, 0)
        none = np.where((kinds == 0) & (words >= 8), -1, 0)
        return np.column_stack([hits.astype(int), several, thick, loud, none]).astype(np.int8)


def feature_table(docs: DataFrame, voters: Voters) -> DataFrame:
    """(doc_id, x, votes): votes as text, a character each."""
    text_batches(docs.sparkSession)
    width = voters.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = voters.automaton()
        for b in batches:
            x = np.array([voters.hits(automaton, t) for t in texts(b)], np.float32).reshape(-1, width)
            votes = ["".join("-0+"[v + 1] for v in row) for row in voters.votes(x).tolist()]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * width), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(votes, pa.string())], ["doc_id", "x", "votes"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, x array<float>, votes string")


def _read_votes(b: pa.RecordBatch, m: int) -> tuple[np.ndarray, np.ndarray]:
    v = np.frombuffer("".join(b.column(0).to_pylist()).encode(), np.uint8).reshape(-1, m)
    return np.where(v == ord("+"), 1, np.where(v == ord("-"), -1, 0)), b.column(1).to_numpy(zero_copy_only=False).astype(float)


class LabelModel:
    """Class prior, each voter's distribution of votes under either class, and the weight of its evidence."""

    def __init__(self, m: int):
        self.m, self.prior = m, 0.1
        plus = np.column_stack([np.full(m, 0.02), np.full(m, 0.002)])
        minus = np.column_stack([np.full(m, 0.0005), np.full(m, 0.001)])
        plus[-4:] = [[0.5, 0.005], [0.4, 0.005], [0.05, 0.002], [0.0005, 0.0005]]
        minus[-1] = [0.05, 0.9]
        self.p = np.stack([minus, 1 - plus - minus, plus])  # vote, voter, class
        self.weight = np.ones(m)

    def posterior(self, v: np.ndarray) -> np.ndarray:
        ratio = np.log(self.p[:, :, 0] / self.p[:, :, 1])  # class 0 here is toxic
        z = np.log(self.prior / (1 - self.prior)) + (ratio[v + 1, np.arange(self.m)] * self.weight).sum(axis=1)
        return sigmoid(z)

    def fit(self, patterns: DataFrame, rounds: int = EM_ROUNDS) -> LabelModel:
        """patterns (votes, n)."""
        m = self.m
        for r in range(rounds):
            last = r == rounds - 1 or r == rounds // 2  # correlations are estimated half way, and used from then on

            def stats(b: pa.RecordBatch, last=last) -> np.ndarray:
                v, n = _read_votes(b, m)
                post = self.posterior(v)
                out = [[n.sum(), (n * post).sum()]]
                for w in (n * post, n * (1 - post)):
                    out += [w @ (v > 0), w @ (v < 0)]
                if last:
                    for w in (n * post, n * (1 - post)):
                        out.append((((v != 0) * w[:, None]).T @ (v != 0)).ravel())
                return np.concatenate(out)

            s = sums(patterns, stats)
            if not len(s) or s[0] == 0:
                return self
            before, self.prior = self.prior, float(np.clip(s[1] / s[0], 1e-4, 0.9))
            for c, (mass, at) in enumerate(((s[1], 2), (s[0] - s[1], 2 + 2 * m))):
                # pseudo-counts keep a voter that never votes from counting as evidence
                plus, minus = (s[at + m * j : at + m * (j + 1)] for j in (0, 1))
                self.p[2, :, c], self.p[0, :, c] = (plus + 0.1 + 0.002 * self.p[2, :, c] * s[0]) / (mass + 1 + 0.002 * s[0]), (minus + 0.1) / (mass + 1)
                self.p[1, :, c] = np.maximum(1e-6, 1 - self.p[2, :, c] - self.p[0, :, c])
            if last:
                self._correlate(s, m)
            if abs(before - self.prior) < 1e-6 and r > rounds // 2:
                break
        return self

    def _correlate(self, s: np.ndarray, m: int) -> None:
        pairs = s[2 + 4 * m :].reshape(2, m, m)
        worst = np.zeros((m, m))
        for mass, both in zip((s[1], s[0] - s[1]), pairs, strict=True):
            rate = np.diag(both) / max(mass, 1e-9)
            sd = np.sqrt(np.maximum(rate * (1 - rate), 1e-9))
            worst = np.maximum(worst, np.clip((both / max(mass, 1e-9) - np.outer(rate, rate)) / np.outer(sd, sd), 0, 1) * (np.diag(both) > 5)[:, None])
        self.correlation = worst
        np.fill_diagonal(worst, 0)
        self.weight = 1 / (1 + np.where(worst > 0.2, worst, 0).sum(axis=1))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs (doc_id, text, any other columns).

    labels (doc_id, toxic) serve to mine voters only, and only where crc32(doc_id) mod 3 is not 1. A null text reads as
    empty; empty texts are scored like any other. Rows without doc_id are scored and never learned from; repeated rows
    come back as often as they are given. No rows, no result.
    """
    scratch = Scratch(docs.sparkSession)
    voters = Voters(mine_voters(docs, labels))
    table = scratch.save(feature_table(docs, voters))
    patterns = scratch.save(table.groupBy("votes").agg(F.count("*").alias("n")))
    patterns = scratch.save(patterns, files=1 + patterns.count() // TASK_PATTERNS)
    m = len(voters.chosen) + 4
    model = LabelModel(m).fit(patterns)
    width = voters.width

    def posterior(b: pa.RecordBatch) -> pa.RecordBatch:
        v, n = _read_votes(b.select(["votes", "n"]), m)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(model.posterior(v)), pa.array(n)], ["x", "y", "n"])

    # rows with the same features share one; what the model says of their votes needs no table
    same = table.groupBy("x").agg(F.first("votes").alias("votes"), F.count("*").alias("n"))
    soft = scratch.save(over_batches(same, posterior, "x array<float>, y double, n double"))
    w = soft_logistic(soft, width)

    def score(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(sigmoid(matrix(b.column(1), width) @ w))], ["doc_id", "score"])

    out = over_batches(table.select("doc_id", "x"), score, "doc_id long, score double")
    return out.select("doc_id", (fold_column(k=FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
