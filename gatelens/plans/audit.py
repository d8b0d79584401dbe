"""The whole audit as one plan: gates, signals per prompt group, thresholds, states, leaves, bundle scores, rows to review.

What more than one step reads is written once; steps are DataFrame plans, and no step gathers the rows of a group.
"""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, fields, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens.functions.scalar import is_bad, token_count
from gatelens.functions.specs import rule_list
from gatelens.operators import calibration, gates, leaves, relational, ridge, schemas, scoring, semantics, signals, stats, thresholds
from gatelens.operators.signals import float_lists
from gatelens.operators.windows import folds, group_ids
from gatelens.sources import artifacts, embedders, tables
from gatelens.sources.scratch import saved, with_group

RULES = ("output", "length", "direction", "diff_residual", "delta_ridge_ens", "similar_input_conflict")
SEMANTIC = ("discourse_instability", "contradiction", "self_contradiction")
#: Rules that a row's final state hangs on; the others are told only.
DECIDING = ("output", "direction", "length", "diff_residual", "delta_ridge_ens", "similar_input_conflict")


@dataclass(frozen=True)
class AuditConfig:
    """rows: id, prompt, input, output, and eval where labels are known."""

    instructions: tuple = ()
    schema: dict | None = None
    schema_path: str = ""
    schema_json: str = ""
    strict_keys: bool = True
    extra_keys: bool = False
    text_length: bool = True
    text_length_ratio: float = 0.30
    text_length_support: float = 0.20
    neighbours: int = 80
    similar_neighbours: int = 30
    similarity: float = 0.90
    rules: tuple = DECIDING
    semantic: bool = True
    leaves: bool = False
    leaf_rows: int = 30
    calibrate: bool = False
    precision: float = 0.95
    bad_label: str = "incorrect"
    max_rows: int = 0
    review: int = 20
    embedder: str = "hash"
    model: str = ""
    dim: int = 768
    aux_lambda: float = 0.1

    @classmethod
    def read(cls, given: dict | None = None, env: dict | None = None, prefix: str = "GATELENS_") -> AuditConfig:
        """Defaults, then the environment's, then what is given; texts become numbers, flags and lists by the kind of the default."""
        env = os.environ if env is None else env
        out = cls()
        known = {f.name for f in fields(cls)}
        unknown = set(given or ()) - known
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        for source in ({k: env[prefix + k.upper()] for k in known if prefix + k.upper() in env}, {k: v for k, v in (given or {}).items() if v is not None}):
            out = replace(out, **{k: _cast(v, getattr(out, k), k) for k, v in source.items()})
        return out


def _cast(value, default, name: str):
    if not isinstance(value, str):
        return value
    if isinstance(default, bool):
        if value.strip().lower() not in ("1", "0", "true", "false", "yes", "no"):
            raise ValueError(f"{name}: not a flag: {value}")
        return value.strip().lower() in ("1", "true", "yes")
    if isinstance(default, (int, float)):
        return type(default)(value)
    if name == "rules":
        long = {"diff_resid": "diff_residual", "sim_conflict": "similar_input_conflict"}
        return tuple(long.get(k, k) for k in rule_list(value))
    if isinstance(default, tuple) or name == "schema":
        got = json.loads(value)
        return tuple(map(tuple, got)) if isinstance(default, tuple) else got
    return value


@dataclass(frozen=True)
class Audit:
    rows: DataFrame
    thresholds: DataFrame
    bundles: DataFrame
    review: DataFrame
    summary: DataFrame
    groups: DataFrame
    top: DataFrame
    leaves: DataFrame | None = None
    candidates: DataFrame | None = None
    notes: dict | None = None


def gated(rows: DataFrame, config: AuditConfig) -> tuple[DataFrame, dict]:
    """rows with ifeval_pass, schema_pass, textlen_pass and hard_gate_pass; and where the schema is from."""
    g = gates.instruction_gate(rows, "output", [tuple(i) for i in config.instructions])
    spec, source = schemas.resolve(rows, "output", config.schema_path or None, config.schema_json or None, config.schema)
    g = schemas.validated(g, "output", spec, config.strict_keys, config.extra_keys) if spec else g.withColumn("schema_parsed", F.lit(None).cast("boolean")).withColumn("schema_problems", F.array().cast("array<string>")).withColumn("schema_pass", F.lit(True))
    g = saved(g)
    if config.text_length:
        parts = gates.leaves(g, ["id"], "output")
        parts = parts.unionByName(g.where(F.size(gates.json_leaves(F.col("output"))) == 0).select("id", F.lit("_raw_text").alias("path"), F.coalesce("output", F.lit("")).alias("leaf")))
        parts = saved(parts)
        limits = saved(gates.length_thresholds(parts, g.count(), config.text_length_ratio, config.text_length_support))
        held = gates.length_gate(parts, limits, "id").select("id", "textlen_failed", F.col("textlen_pass").alias("_t"))
        g = g.join(held, "id", "left").withColumn("textlen_pass", F.coalesce("_t", F.lit(True))).drop("_t")
    else:
        g = g.withColumn("textlen_pass", F.lit(True)).withColumn("textlen_failed", F.array().cast("array<string>"))
    filled = F.trim(F.coalesce("output", F.lit(""))) != ""
    return g.withColumn("hard_gate_pass", F.col("ifeval_pass") & F.col("schema_pass") & F.col("textlen_pass") & filled), {"schema": source}


def signal_table(vectors: DataFrame, config: AuditConfig) -> DataFrame:
    """id, group_id, used_k and a column per rule; vectors (id, group_id, x, y). Neighbours are searched within groups."""
    v = saved(vectors)
    k = config.neighbours
    near = signals.knn(v, "id", "x", k, "cosine", "group_id")
    sizes = v.groupBy("group_id").agg(F.count("*").alias("_n"))
    base = F.greatest(F.lit(15), F.least(F.lit(80), F.rint(F.sqrt(F.greatest(F.lit(2), F.col("_n"))))))
    used = signals.adaptive_k(near, "id", 80).join(v.select("id", "group_id"), "id")
    used = with_group(used, sizes, ["group_id"]).select("id", F.least("used_k", F.when(F.col("used_k") < 80, F.col("used_k")).otherwise(base)).cast("int").alias("used_k"))
    used = saved(used)
    local = near.join(used, "id").where("rank <= used_k").drop("used_k")
    d = saved(signals.deltas(v, "id", "x", "y").join(v.select("id", "group_id"), "id"))
    s = signals.local_signals(local.drop("group_id"), d, "id").join(d.select("id", "group_id", "tau"), "id")
    s = with_group(s, d.groupBy("group_id").agg(F.median("tau").alias("_m")), ["group_id"])
    scale = F.sqrt(F.least(F.greatest(F.col("tau") / (F.when(F.col("_m") <= 0, 1.0).otherwise(F.col("_m")) + 1e-9), F.lit(0.25)), F.lit(4.0)))
    s = saved(s.withColumn("direction_signal", F.col("direction_signal") * scale).drop("_m", "tau"))
    if config.aux_lambda > 0:
        s = signals.aux_residual(s, "id", ["group_id"], "diff_residual", lam=config.aux_lambda)
    ks = (15, 23, 30)
    out_near = signals.knn(v, "id", "y", max(ks), "euclidean", "group_id")
    density = signals.density_of(out_near, "id", list(ks), "group_id").withColumnRenamed("density", "output")
    close = near.where(F.col("rank") <= config.similar_neighbours).where(1 - F.col("distance") >= config.similarity)
    enough = close.groupBy("id").count().where(F.col("count") >= 3).select("id")
    conflict = signals.local_signals(close.join(enough, "id").drop("group_id"), d, "id").select("id", (F.col("direction_signal") + F.col("length_signal")).alias("_c"))
    team = ridge.ensemble_signal(v.join(d.select("id", "d"), "id"), "id", "x", "d").withColumnRenamed("delta_ridge", "delta_ridge_ens")
    table = v.select("id", "group_id").join(used, "id", "left").join(s.drop("group_id").withColumnsRenamed({"length_signal": "length", "direction_signal": "direction"}), "id", "left").join(density, "id", "left").join(team, "id", "left")
    return table.join(conflict, "id", "left").withColumn("similar_input_conflict", F.coalesce("_c", F.lit(0.0))).drop("_c")


def soft_thresholds(table: DataFrame, rules: tuple, q: float = 0.99) -> tuple[DataFrame, DataFrame]:
    """table with weight, falling with the risk that four core rules show; and group_id, rule, threshold: weighted quantiles of each rule."""
    from gatelens.operators.windows import soft_weights

    core = [r for r in ("output", "direction", "length", "diff_residual") if r in table.columns]
    cuts = table.groupBy("group_id").agg(*[F.percentile(r, F.lit(0.90)).alias(f"_{r}") for r in core])
    x = with_group(table, cuts, ["group_id"])
    over = [F.coalesce(F.greatest(F.lit(0.0), (F.col(r) - F.col(f"_{r}")) / F.greatest(F.abs(f"_{r}"), F.lit(1e-6))), F.lit(0.0)) for r in core]
    x = x.withColumn("_risk", sum(over, F.lit(0.0)) / len(core)).drop(*[f"_{r}" for r in core])
    w = soft_weights(x.select("id", "group_id", "_risk"), ["group_id"], "_risk", "id").select("id", "weight")
    x = saved(x.drop("_risk").join(w, "id"))
    long = x.select("id", "group_id", "weight", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).cast("double").alias("signal")) for r in rules])).alias("s")).select("id", "group_id", "weight", "s.*")
    t = stats.weighted_quantile(long, ["group_id", "rule"], "signal", "weight", [q], "id").select("group_id", "rule", F.col("value").alias("threshold"))
    return x, t


def leaf_part(g: DataFrame, config: AuditConfig, embedder) -> DataFrame | None:
    """Leaf results (id, group_id, leaf, rule, signal, threshold, available, pass): all signals of the leaves that enough rows of a group hold.

    A leaf of a group is a group of its own, its text the output; thresholds are weighted quantiles, as of whole outputs.
    """
    parts = saved(gates.leaves(g.where("hard_gate_pass"), ["id", "group_id", "input"], "output"))
    big = leaves.leaf_groups(parts, "group_id", "path", "leaf", config.leaf_rows).where(token_count("leaf") > 0)
    if big.isEmpty():
        return None
    # a row may hold many leaves: each has an id of its own
    big = saved(big.withColumn("_id", F.concat_ws("\x1f", F.col("id").cast("string"), "path")))
    v = embedders.embed(big, {"x": "input", "y": "leaf"}, embedder, "_id")
    named = big.select(F.col("_id").alias("id"), F.concat_ws("\x1f", "group_id", "path").alias("group_id"))
    table, limits = soft_thresholds(saved(signal_table(v.withColumnRenamed("_id", "id").join(named, "id"), config)), RULES)
    long = table.select("id", "group_id", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).cast("double").alias("signal")) for r in RULES])).alias("s")).select("id", "group_id", "s.*")
    x = with_group(long, saved(limits), ["group_id", "rule"]).withColumn("available", F.col("signal").isNotNull()).withColumn("pass", F.coalesce(F.col("signal") <= F.col("threshold"), F.lit(True)))
    back = big.select(F.col("_id").alias("_lid"), F.col("id").alias("_row"), F.col("group_id").alias("_group"), F.col("path").alias("leaf"))
    x = x.join(back, F.col("id") == F.col("_lid"))
    return saved(x.select(F.col("_row").alias("id"), F.col("_group").alias("group_id"), "leaf", "rule", "signal", "threshold", "available", "pass"))


def run(rows: DataFrame, config: AuditConfig = AuditConfig(), embed=None) -> Audit:  # noqa: B008
    """rows (id, prompt, input, output, and eval if known); embed(rows) -> id, x, y in place of the configured embedder."""
    embedder = embedders.make(config.embedder, config.model, config.dim)
    if config.max_rows:
        rows = relational.sample_exact(rows, "id", config.max_rows)
    g, notes = gated(group_ids(rows, "prompt", "id"), config)
    g = saved(g)
    good = g.where("hard_gate_pass")
    made = embed(good) if embed else embedders.embed(good, {"x": "input", "y": "output"}, embedder, "id")
    table = saved(signal_table(made.join(good.select("id", "group_id"), "id"), config))
    rules = tuple(RULES)
    if config.semantic:
        names = {"discourse": "discourse_instability", "contradiction": "contradiction", "self_contradiction": "self_contradiction"}
        dim = embedder

        @F.arrow_udf("array<float>")
        def vector(texts: pa.Array) -> pa.Array:
            return float_lists(dim.encode([t or "" for t in texts.to_pylist()]))

        s, missing = semantics.pack(good.select("id", "output"), "id", "output", vector)
        notes["semantic"] = missing
        s = s.select("id", *[F.when(F.col(f"{k}_available"), F.col(k)).alias(v) for k, v in names.items()])
        table = saved(table.join(s, "id", "left"))
        rules += SEMANTIC
    table, limits = soft_thresholds(table, rules)
    limits = saved(limits)
    long = saved(table.select("id", "group_id", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).cast("double").alias("signal")) for r in rules])).alias("s")).select("id", "group_id", "s.*"))
    th = saved(thresholds.hybrid(long.where("signal is not null"), ["group_id", "rule"], "signal", "id"))
    states = thresholds.apply_states(long, th, ["group_id", "rule"], "signal")
    states = with_group(states, limits, ["group_id", "rule"]).withColumn("pass", F.coalesce(F.col("signal") <= F.col("threshold"), F.lit(True))).drop("threshold")
    states = saved(states)
    deciding = F.col("rule").isin(*[r for r in config.rules if r in rules])
    per = states.groupBy("id").agg(
        F.count_if(deciding & F.col("state").isin("fail", "hard_fail")).alias("fails"), F.count_if(deciding & (F.col("state") == "hard_fail")).alias("hards"), F.count_if(F.col("state") == "warn").alias("warns"),
        F.bool_and(F.when(deciding, F.col("pass"))).alias("distribution_pass"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule", "state")))).alias("states"),
    )
    risk = scoring.row_risk(long.where("signal is not null"), ["group_id", "rule"], "signal").groupBy("id").agg(F.avg("risk").alias("risk"))
    named = table.drop("group_id").withColumnsRenamed({r: f"{r}_signal" for r in rules})
    out = g.join(named, "id", "left").join(per, "id", "left").join(risk, "id", "left")
    hits = leaf_part(g, config, embedder) if config.leaves else None
    if hits is not None:
        out = leaves.scatter(out, leaves.row_metrics(hits, "id", "leaf", "rule"), "id", {"evaluated": 0, "failed": 0, "failed_paths": ""})
    else:
        out = out.withColumn("failed", F.lit(0)).withColumn("failed_paths", F.lit(""))
    state = F.when(~F.col("hard_gate_pass"), "na").when(F.col("hards") > 0, "hard_fail").when(F.col("fails") > 0, "fail").when(F.col("warns") > 0, "warn").otherwise("pass")
    out = leaves.override(out.withColumn("distribution_state", state), "distribution_state", "failed").drop("state_before")
    out = out.withColumn("final_state", F.when(~F.col("hard_gate_pass"), "hard_gate_fail").otherwise(F.col("distribution_state")))
    candidates = None
    if config.calibrate and "eval" in rows.columns:
        known = folds(out.where("hard_gate_pass and eval is not null").withColumn("bad", is_bad("eval", config.bad_label)), "bad", "id")
        grid = {f"{r}_signal": [0.90, 0.95, 0.99] if r == "output" else [0.95, 0.99] for r in DECIDING[:4]}
        candidates = calibration.fit_distance(known.select("group_id", "bad", "fold", *grid), "group_id", "bad", "fold", grid, config.precision)
        out = calibration.apply_distance(out.drop("distribution_pass"), "group_id", calibration.selected(candidates), "hard_gate_pass")
    out = saved(out)
    axes = {r: f"{r}_signal" for r in ("output", "diff_residual", "delta_ridge_ens", *(SEMANTIC[:2] if config.semantic else ()))}
    shares = scoring.state_rates(states, ["group_id", "rule"]).select("group_id", "rule", F.col("fail_rate").alias("state_fail_rate"), F.col("hard_fail_rate").alias("state_hard_rate"))
    mid = stats.center(long.where("signal is not null"), ["group_id", "rule"], "signal").select("group_id", "rule", "median", "sigma")
    told = with_group(with_group(th.select("group_id", "rule", "fail", "hard"), shares, ["group_id", "rule"]), mid, ["group_id", "rule"]).withColumn("k_fail", (F.col("fail") - F.col("median")) / F.col("sigma")).drop("median", "sigma")
    bundles = scoring.bundle_scores(out.withColumn("_failed", F.col("failed") > 0), ["group_id"], axes, "hard_gate_pass", saved(told), "_failed")
    review = scoring.triage(out.where("risk is not null").withColumn("_detail", F.col("failed") > 0), "id", "id", "risk", "fails", "hards", len(DECIDING), "_detail", config.review)
    summary = leaves.operational_summary(out, "hard_gate_pass", "distribution_state", "final_state")
    per_rule = states.select("id", "rule", "pass", "signal", F.col("signal").isNotNull().alias("available"))
    groups = leaves.group_summary(out, ["group_id"], "hard_gate_pass", "distribution_state", per_rule, "id")
    top = relational.top_per_group(long.where("signal is not null"), ["group_id", "rule"], "signal", "id", 30)
    return Audit(out, th, bundles, review, summary, groups, top, hits, candidates, notes)


def write(audit: Audit, folder: str, config: AuditConfig, tag: str = "audit") -> dict[str, str]:
    """The tables of a run under a folder, and its configuration; where each lies."""
    out = {}
    for f in fields(Audit):
        t = getattr(audit, f.name)
        if isinstance(t, DataFrame):
            out[f.name] = f"{folder}/{tag}_{f.name}"
            tables.write_rows(t, out[f.name], "parquet")
    spark = audit.rows.sparkSession
    out["run_config"] = f"{folder}/{tag}_run_config"
    spark.createDataFrame([(json.dumps(asdict(config) | {"notes": audit.notes}, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(out["run_config"])
    return out


def source_rows(spark: SparkSession, path: str, columns: dict[str, str] | None = None) -> DataFrame:
    """id, prompt, input, output, eval of a source table (CSV or Parquet) with the columns id, Prompt, input, expectedOutput, eval, or as named."""
    names = {"id": "id", "prompt": "Prompt", "input": "input", "output": "expectedOutput", "eval": "eval"} | (columns or {})
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else tables.read_csv(spark, path)[0]
    leaves.require(df, [names[k] for k in ("id", "input", "output")])
    df = leaves.with_defaults(df, {names["prompt"]: None, names["eval"]: None})
    return df.select(*[F.col(names[k]).cast("string").alias(k) for k in ("id", "prompt", "input", "output", "eval")])


def states_from(rows: DataFrame, rule_columns: dict[str, str], by: list[str], key: str) -> DataFrame:
    """Thresholds and states of signals that are there already: the stage after the signals alone. rule_columns: {rule: column}."""
    long = saved(rows.select(key, *by, F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(c).cast("double").alias("signal")) for r, c in rule_columns.items()])).alias("s")).select(key, *by, "s.*"))
    th = thresholds.hybrid(long.where("signal is not null"), [*by, "rule"], "signal", key)
    return thresholds.apply_states(long, saved(th), [*by, "rule"], "signal")


def latest_gate_score(spark: SparkSession, root: str) -> DataFrame:
    """Score of the hard gate in the newest summary under a folder."""
    return artifacts.hard_gate_summary(spark, artifacts.latest_summary(root))
