"""Semantic signals of structured outputs: which keys hold a verdict and its evidence, classes of verdicts, and how evidence fits them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelens.functions.scalar import clip, segments, token_count
from gatelens.functions.vectors import doubles
from gatelens.operators import signals
from gatelens.operators.signals import rows_of
from gatelens.sources.scratch import saved

# Keys that may hold a verdict or its evidence, in order of preference.
VERDICT_KEYS = ("is_correct", "decision", "label", "result", "verdict", "score", "rating")
EVIDENCE_KEYS = ("feedback", "explanation", "rationale", "reason", "analysis", "comment")


def value_of(json: Column, key: str) -> Column:
    """A key's value as text; null for objects and lists."""
    v = F.get_json_object(json, f"$.{key}")
    return F.when(~F.substring(F.ltrim(v), 1, 1).isin("{", "["), v)


def _entropy(counts: DataFrame, by: list[str]) -> DataFrame:
    """by, _h: the entropy of counts n over the log of their number; 0 for one."""
    w = Window.partitionBy(*by)
    p = F.col("n") / F.sum("n").over(w)
    h = counts.withColumn("_p", p).groupBy(*by).agg((-F.sum(F.col("_p") * F.ln("_p"))).alias("_s"), F.count("*").alias("_k"))
    return h.select(*by, F.when(F.col("_k") > 1, F.col("_s") / F.ln(F.col("_k").cast("double"))).otherwise(0.0).alias("_h"), "_k")


def key_scores(df: DataFrame, json: str, keys: tuple[str, ...], kind: str, min_tokens: int = 2) -> DataFrame:
    """key, place, support, info, score of candidate keys: share of rows that hold it, how much it tells, their mix. kind: scalar or text.

    Scalars tell by the entropy of their quarters (numbers) or their values, less a penalty for near-unique ones; texts by their length.
    """
    n = df.agg(F.count("*").alias("_rows"))
    long = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(i).alias("place"), value_of(F.col(json), k).alias("v")) for i, k in enumerate(keys)])).alias("e")).select("e.*")
    long = long.withColumn("v", F.trim("v")).where("v <> ''")
    if kind == "text":
        long = long.withColumn("_t", token_count("v")).where(F.col("_t") >= min_tokens)
        g = long.groupBy("key", "place").agg(F.count("*").alias("_n"), F.median("_t").alias("_m"))
        g = g.withColumn("info", clip((F.col("_m") - min_tokens) / 12))
    else:
        x = long.withColumn("v", F.lower("v")).withColumn("_x", F.expr("try_cast(v AS double)"))
        x = saved(x.withColumn("_x", F.when(~F.isnan("_x") & (F.abs("_x") < float("inf")), F.col("_x"))))
        g = x.groupBy("key", "place").agg(F.count("*").alias("_n"), F.count("_x").alias("_f"), F.percentile("_x", F.array(*[F.lit(p) for p in (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)])).alias("_q"))
        g = saved(g)
        edges = g.select("key", F.array_distinct(F.array(*[F.col("_q")[i] for i in (0, 2, 3, 4, 6)])).alias("_e"))
        bins = x.where("_x is not null").join(edges, "key").withColumn("n", F.size(F.filter(F.slice("_e", 2, F.greatest(F.size("_e") - 2, F.lit(0))), lambda e: F.col("_x") >= e)))
        numeric = _entropy(bins.groupBy("key", F.col("n").alias("_b")).agg(F.count("*").alias("n")), ["key"]).select("key", F.col("_h").alias("_hn"))
        values = _entropy(x.groupBy("key", "v").agg(F.count("*").alias("n")), ["key"]).select("key", F.col("_h").alias("_hv"), "_k")
        g = g.join(edges, "key").join(numeric, "key", "left").join(values, "key")
        number = F.when((F.col("_f") < 3) | (F.size("_e") < 3), 0.0).otherwise(clip(0.8 * F.col("_hn") + 0.2 * clip(F.col("_q")[5] - F.col("_q")[1])))
        other = clip(F.col("_hv") - 0.35 * clip((F.col("_k") / F.col("_n") - 0.70) / 0.30))
        g = g.withColumn("info", F.when(F.col("_f") / F.col("_n") >= 0.8, number).otherwise(other))
    out = g.crossJoin(F.broadcast(n)).withColumn("support", F.col("_n") / F.col("_rows"))  # one row
    return out.select("key", "place", "support", "info", (F.col("support") + 0.20 * F.col("info")).alias("score"))


def best_key(scores: DataFrame, support: float = 0.60) -> str | None:
    """The key of the best score among those of enough support; the first of equals."""
    row = scores.where(F.col("support") >= support).orderBy(F.desc(F.round("score", 12)), "place").first()
    return row and row["key"]


def verdicts(df: DataFrame, value: str, max_classes: int = 8, bins: int = 3) -> DataFrame:
    """df with class (an integer, null without one) and class_name: quantile bins where at least 0.8 of the values are numbers, else the most frequent values."""
    x = df.withColumn("_v", F.lower(F.trim(F.col(value)))).withColumn("_x", F.expr("try_cast(_v AS double)"))
    n = max(2, min(bins, max_classes))
    s = x.where("_v <> ''").agg(F.count("*").alias("n"), F.count("_x").alias("f"), F.percentile("_x", F.array(*[F.lit(i / n) for i in range(n + 1)])).alias("q"), F.count_distinct(F.round("_x", 8)).alias("d")).first()
    edges = sorted(set(s["q"] or [])) if s and s["n"] and s["f"] / s["n"] >= 0.8 and s["d"] >= 2 else []
    if len(edges) >= 3:
        at = sum((F.when(F.col("_x") >= e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
        out = x.withColumn("class", F.when(F.col("_x").isNotNull() & (F.col("_v") != ""), at))
        return out.withColumn("class_name", F.when(F.col("class").isNotNull(), F.concat(F.lit("bin_"), F.col("class").cast("string")))).drop("_v", "_x")
    top = x.where("_v <> ''").groupBy("_v").count().orderBy(F.desc("count"), "_v").limit(max_classes)
    top = top.withColumn("class", (F.row_number().over(Window.orderBy(F.desc("count"), "_v")) - 1).cast("int")).drop("count")  # max_classes rows
    return x.join(F.broadcast(top), "_v", "left").withColumn("class_name", F.when(F.col("class").isNotNull(), F.col("_v"))).drop("_v", "_x")


@dataclass(frozen=True)
class Context:
    """What the semantic signals share; without two classes there is a reason, and no tables."""

    verdict_key: str | None
    evidence_key: str | None
    rows: DataFrame | None = None
    sims: DataFrame | None = None
    centroids: DataFrame | None = None
    reason: str = ""


def context(df: DataFrame, key: str, json: str, embed, verdict_keys=VERDICT_KEYS, evidence_keys=EVIDENCE_KEYS, support: float = 0.60, least: int = 20, max_classes: int = 8, bins: int = 3, min_tokens: int = 2) -> Context:
    """Keys of verdict and evidence, rows (key, class, evidence, v), centroids of classes of enough rows, and similarities to them; embed: text to vector."""
    verdict = best_key(key_scores(df, json, verdict_keys, "scalar"), support)
    evidence = best_key(key_scores(df, json, evidence_keys, "text", min_tokens), support)
    if not verdict or not evidence:
        return Context(verdict, evidence, reason="no verdict key" if not verdict else "no evidence key")
    x = df.select(key, value_of(F.col(json), verdict).alias("verdict"), F.trim(value_of(F.col(json), evidence)).alias("evidence"))
    x = verdicts(x, "verdict", max_classes, bins).where("class is not null").where(token_count("evidence") >= min_tokens)
    x = x.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)  # texts are small, their vectors aren't: a small file is no reason for one task
    x = saved(x.select(key, "class", "evidence", signals.unit_rows(embed(F.col("evidence"))).alias("v")))
    cents = saved(signals.centroids(x, "class", "v", least))
    if cents.count() < 2:
        return Context(verdict, evidence, reason="too few classes")
    return Context(verdict, evidence, x, signals.class_similarities(x, cents, key, "class", "v"), cents)


def self_contradiction(sims: DataFrame, parts: DataFrame, cents: DataFrame, key: str, label: str, vector: str = "v") -> DataFrame:
    """key, self_contradiction: margin of the best other class, spread of the segments, and the share of segments nearer to another class.

    sims as of class_similarities; parts (key, place, a vector): segments, which count for rows with at least two of them.
    """
    places, table = signals.class_table(cents, label)
    p = parts.join(sims.select(key, label), key).groupBy(key, label).agg(F.collect_list(doubles(vector)).alias("_parts")).where(F.size("_parts") >= 2)  # a few segments a row
    kind = p.schema[key].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            many, mine = b.column(2).value_lengths().to_numpy(), [places[c] for c in b.column(1).to_pylist()]
            v = rows_of(b.column(2).flatten())
            v = np.where(np.isfinite(v), v, 0.0)
            n = np.sqrt((v * v).sum(1, keepdims=True))
            v = v / np.where(n <= 1e-12, 1.0, n)
            s, out, end = v @ table.T, np.zeros((b.num_rows, 2)), np.cumsum(many)
            for i, (m, c) in enumerate(zip(many, mine, strict=True)):
                own = slice(end[i] - m, end[i])
                among = v[own] @ v[own].T
                others = np.delete(s[own], c, axis=1)
                out[i] = max(0.0, 1 - among[np.triu_indices(m, 1)].mean()), ((others.max(1) if others.shape[1] else -1.0) > s[own, c]).mean()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[:, 0]), pa.array(out[:, 1])], ["_k", "_spread", "_flip"])

    made = p.mapInArrow(compare, f"_k {kind}, _spread double, _flip double").withColumnRenamed("_k", key)
    x = sims.select(key, "margin").join(made, key, "left").fillna(0.0, ["_spread", "_flip"])
    x = saved(x)
    for c_, name in (("margin", "_a"), ("_spread", "_b"), ("_flip", "_c")):
        x = signals.clipped_z(x, c_, name)
    return x.select(key, ((F.col("_a") + 0.30 * F.col("_b") + 0.15 * F.col("_c")) / 1.45).alias("self_contradiction"))


def evidence_segments(rows: DataFrame, key: str, text: str, embed, min_tokens: int = 2, most: int = 4) -> DataFrame:
    """key, place, v: vectors of the segments of a text."""
    x = rows.select(key, F.posexplode(segments(text, max(1, min_tokens), max(2, most))).alias("place", "_s"))
    return x.select(key, "place", doubles(embed(F.col("_s"))).alias("v"))


def consistency(df: DataFrame, key: str) -> DataFrame:
    """key, consistency: a signal that is defined and always 0."""
    return df.select(key, F.lit(0.0).alias("consistency"))


def pack(df: DataFrame, key: str, json: str, embed, enabled: tuple[str, ...] = ("discourse", "contradiction", "self_contradiction"), **kw) -> tuple[DataFrame, dict[str, str]]:
    """df's keys with the semantic signals, 0 and not available where there is none; and why signals are missing, by name."""
    c = context(df, key, json, embed, **kw) if enabled else Context(None, None, reason="disabled")
    missing = {s: "disabled" if s not in enabled else c.reason for s in ("discourse", "contradiction", "self_contradiction") if s not in enabled or c.reason}
    out = df.select(key)
    made = {}
    if not c.reason and c.rows is not None:
        sims = saved(c.sims)
        if "discourse" in enabled:
            made["discourse"] = signals.discourse_instability(sims, key, "class")
        if "contradiction" in enabled:
            made["contradiction"] = signals.contradiction(sims, key)
        if "self_contradiction" in enabled:
            made["self_contradiction"] = self_contradiction(sims, evidence_segments(c.rows, key, "evidence", embed), c.centroids, key, "class")
    for s in ("discourse", "contradiction", "self_contradiction"):
        if s in made:
            out = out.join(made[s].withColumnRenamed(s, f"_{s}"), key, "left")
            out = out.withColumn(f"{s}_available", F.col(f"_{s}").isNotNull()).withColumn(s, F.coalesce(f"_{s}", F.lit(0.0))).drop(f"_{s}")
        else:
            out = out.withColumn(f"{s}_available", F.lit(False)).withColumn(s, F.lit(0.0))
    return out.join(consistency(df, key), key), missing
