"""Command line: python -m gatelens.cli audit | signals | states | traces | gate-score | fixture | bench | suite."""

from __future__ import annotations

import argparse
import json
import time
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens.plans import audit
from gatelens.sources import embedders, fixtures, tables


def session(name: str = "gatelens") -> SparkSession:
    return SparkSession.builder.appName(name).getOrCreate()


def settings(parser: argparse.ArgumentParser) -> None:
    """An option for every setting of an audit."""
    for f in fields(audit.AuditConfig):
        parser.add_argument(f"--{f.name.replace('_', '-')}", dest=f"set_{f.name}", default=None, help=f"default: {f.default}")
    parser.add_argument("--set", action="append", default=[], metavar="NAME=VALUE", help="any setting")


def config_of(args: argparse.Namespace) -> audit.AuditConfig:
    given = {f.name: getattr(args, f"set_{f.name}", None) for f in fields(audit.AuditConfig)}
    for pair in getattr(args, "set", []):
        name, _, value = pair.partition("=")
        given[name.strip().replace("-", "_")] = value
    return audit.AuditConfig.read(given)


def run(config: audit.AuditConfig, source: str, folder: str, tag: str = "audit", spark: SparkSession | None = None, columns: dict[str, str] | None = None) -> dict[str, str]:
    """The full audit of a source table, its tables and pages under a folder; where each lies."""
    from gatelens.reports import pages

    spark = spark or session()
    rows = audit.source_rows(spark, source, columns)
    done = audit.run(rows, config)
    out = audit.write(done, folder, config, tag)
    saved = spark.read.parquet(out["rows"])
    names = [c.removesuffix("_signal") for c in saved.columns if c.endswith("_signal")]
    long = saved.select("id", F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"{n}_signal").cast("double").alias("signal"), F.col("states")[n].alias("state")) for n in names])).alias("s")).select("id", "s.*")
    page, rules = pages.diagnostics_page(long.where("signal is not null"), "rule", "signal", "state", hits=done.leaves)
    out["diagnostics"] = f"{folder}/{tag}_diagnostics.html"
    pages.write_page(spark, page, out["diagnostics"])
    out["diagnostics_table"] = f"{folder}/{tag}_diagnostics"
    tables.write_rows(rules, out["diagnostics_table"], "csv")
    return out


def run_default(source: str, folder: str) -> dict[str, str]:
    """The full audit under default settings, tagged by the time of day."""
    return run(audit.AuditConfig.read(), source, folder, time.strftime("run_%Y%m%d_%H%M%S"))


def run_signals(config: audit.AuditConfig, rows: DataFrame) -> DataFrame:
    """The stage of the signals alone: rows that pass the gates, with a column per rule."""
    from gatelens.operators.windows import group_ids

    g, _ = audit.gated(group_ids(rows, "prompt", "id"), config)
    good = g.where("hard_gate_pass")
    v = embedders.embed(good, {"x": "input", "y": "output"}, embedders.make(config.embedder, config.model, config.dim), "id")
    return audit.signal_table(v.join(good.select("id", "group_id"), "id"), config)


SIGNALS = {"density": "output", "length": "length", "direction": "direction", "residual": "diff_residual", "ridge": "delta_ridge_ens", "conflict": "similar_input_conflict"}


def scorer(config: audit.AuditConfig, names: list[str] | None = None):
    """A function from vectors (id, group_id, x, y) to the signals asked for."""
    wanted = names or list(SIGNALS)
    unknown = [n for n in wanted if n not in SIGNALS]
    if unknown:
        raise ValueError(f"unknown signals: {', '.join(unknown)}")
    return lambda vectors: audit.signal_table(vectors, config).select("id", "group_id", *[SIGNALS[n] for n in wanted])


def bench(spark: SparkSession, sizes: list[int], config: audit.AuditConfig, seed: int = 42) -> list[dict]:
    """Seconds, rows a second and quality of audits of made-up benchmarks."""
    from gatelens.operators import stats

    out = []
    for n in sizes:
        rows = fixtures.benchmark(spark, n - n // 4, n // 4, seed).select("id", F.col("Prompt").alias("prompt"), "input", F.col("expectedOutput").alias("output"), "eval")
        t = time.time()
        done = audit.run(rows, config)
        x = done.rows.select((F.col("eval") == config.bad_label).alias("bad"), F.col("final_state").isin("fail", "hard_fail", "hard_gate_fail").alias("flagged"))
        m = stats.confusion(x, "bad", "flagged").first().asDict()
        took = time.time() - t
        out.append({"rows": n, "seconds": round(took, 2), "rows_per_second": round(n / took, 2), **{k: round(m[k], 4) for k in ("precision", "recall", "f1", "fpr")}})
    return out


def suite(spark: SparkSession, rows: int, config: audit.AuditConfig, datasets: int = 20) -> DataFrame:
    """The outcome of audits of so many made-up benchmarks, one row each: seed, rows, seconds, and how bad rows were told."""
    out = [{"seed": 100 + i, **bench(spark, [rows], config, 100 + i)[0]} for i in range(datasets)]
    return spark.createDataFrame([tuple(r.values()) for r in out], "seed int, rows int, seconds double, rows_per_second double, precision double, recall double, f1 double, fpr double")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="gatelens", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("audit", "signals"):
        p = sub.add_parser(name)
        p.add_argument("source")
        p.add_argument("folder")
        p.add_argument("--tag", default="audit")
        p.add_argument("--columns", default="{}", help="names of id, prompt, input, output, eval as JSON")
        settings(p)
    p = sub.add_parser("states")
    p.add_argument("rows")
    p.add_argument("folder")
    p.add_argument("--rules", required=True, help="rules and their columns as JSON")
    p.add_argument("--by", default="group_id")
    p.add_argument("--key", default="id")
    p = sub.add_parser("traces")
    p.add_argument("source")
    p.add_argument("target")
    p.add_argument("--default-eval", default="correct")
    p.add_argument("--max-rows", type=int, default=0)
    p = sub.add_parser("gate-score")
    p.add_argument("root")
    p = sub.add_parser("fixture")
    p.add_argument("target")
    p.add_argument("--good", type=int, default=1275)
    p.add_argument("--bad", type=int, default=425)
    p.add_argument("--nested", action="store_true")
    p = sub.add_parser("bench")
    p.add_argument("--sizes", default="1000")
    settings(p)
    p = sub.add_parser("suite")
    p.add_argument("target")
    p.add_argument("--rows", type=int, default=200)
    p.add_argument("--datasets", type=int, default=20)
    settings(p)
    args = parser.parse_args(argv)
    spark = session()
    if args.command == "audit":
        print(json.dumps(run(config_of(args), args.source, args.folder, args.tag, spark, json.loads(args.columns))))
    elif args.command == "signals":
        tables.write_rows(run_signals(config_of(args), audit.source_rows(spark, args.source, json.loads(args.columns))), f"{args.folder}/{args.tag}_signals")
    elif args.command == "states":
        x = audit.states_from(spark.read.parquet(args.rows), json.loads(args.rules), [args.by], args.key)
        tables.write_rows(x, f"{args.folder}/states")
    elif args.command == "traces":
        df = tables.read_csv(spark, args.source)[0]
        rows = tables.trace_rows(df.limit(args.max_rows) if args.max_rows else df, args.default_eval)
        tables.write_rows(rows, args.target, "csv")
    elif args.command == "gate-score":
        print(json.dumps(audit.latest_gate_score(spark, args.root).first().asDict()))
    elif args.command == "fixture":
        made = fixtures.nested_benchmark if args.nested else fixtures.benchmark
        tables.write_rows(made(spark, args.good, args.bad), args.target, "csv")
    elif args.command == "bench":
        print(json.dumps(bench(spark, [int(n) for n in args.sizes.split(",")], config_of(args))))
    elif args.command == "suite":
        tables.write_rows(suite(spark, args.rows, config_of(args), args.datasets), args.target, "csv")


if __name__ == "__main__":
    main()
