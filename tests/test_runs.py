"""Schemas, templates, bundles, pages, streams, settings and whole runs."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from gatelens import cli
from gatelens.functions import specs
from gatelens.operators import gates, schemas, scoring, semantics, templates
from gatelens.plans import audit
from gatelens.reports import pages
from gatelens.sources import fixtures
from gatelens.streaming import monitor


def test_json_schema_words():
    ok = lambda v, s: not schemas.violations(v, s)
    good = [
        ({"a": 1}, {"type": "object", "required": ["a"]}), (1.0, {"type": "integer"}), ([1, 2], {"items": {"type": "integer"}, "uniqueItems": True, "minItems": 2}), ("ab", {"pattern": "^a", "maxLength": 2}),
        (3, {"oneOf": [{"minimum": 5}, {"multipleOf": 3}]}), (None, {"type": ["null", "string"]}), ({"x": {"y": 1}}, {"properties": {"x": {"$ref": "#/$defs/p"}}, "$defs": {"p": {"required": ["y"]}}}),
        ({"kind": "a", "n": 1}, {"if": {"properties": {"kind": {"const": "a"}}}, "then": {"required": ["n"]}}), ([1, "x"], {"prefixItems": [{"type": "integer"}, {"type": "string"}], "items": False}), ({"p_1": 2}, {"patternProperties": {"^p_": {"type": "integer"}}, "additionalProperties": False}),
        (5, {"unknownWord": 1}), ([1, 5], {"contains": {"const": 5}}),
    ]
    bad = [
        (True, {"type": "integer"}), (1, {"enum": [True]}), ({}, {"required": ["a"]}), ({"b": 1}, {"additionalProperties": False}), ("x", {"not": {"type": "string"}}), (6, {"anyOf": [{"maximum": 5}, {"const": 7}]}), (15, {"oneOf": [{"minimum": 5}, {"multipleOf": 3}]}),
        ([1, 1.0], {"uniqueItems": True}), ({"x": {}}, {"properties": {"x": {"$ref": "#/$defs/p"}}, "$defs": {"p": {"required": ["y"]}}}), ({"kind": "a"}, {"if": {"properties": {"kind": {"const": "a"}}}, "then": {"required": ["n"]}}), (5, {"exclusiveMaximum": 5}), ({"a": 1}, {"propertyNames": {"minLength": 2}}), ({"a": 1}, {"dependentRequired": {"a": ["b"]}}),
    ]
    assert all(ok(*c) for c in good) and not any(ok(*c) for c in bad)
    assert schemas.is_json_schema({"type": "object"}) and not schemas.is_json_schema({"a": "text"})
    assert [schemas.type_name(s) for s in (["a"], "int", "float", "bool", {}, "?", "text")] == ["categorical", "integer", "number", "boolean", "nested", "any", "text"]
    c = schemas.closed({"a": {"b"}, "c": set()})
    assert c == {"a": {"a", "b"}, "b": {"a", "b"}, "c": {"c"}}


def test_light_schema_column_is_python(spark):
    spec = {"a": {"s": ["F", "O"], "n": "number"}, "t": "text", "b": "boolean", "i": "integer", "any": "what"}
    texts = ['{"a": {"s": "F", "n": 1.5}, "t": " ", "b": true, "i": 3, "any": [1]}', '{"a": {"s": "X", "n": 1}, "t": "x", "b": true, "i": 3, "any": 1}', '{"a": 1, "t": "x", "b": true, "i": 3, "any": 1}', '{"a": {"s": "F", "n": 1}, "t": "", "b": true, "i": 3, "any": 1}', '{"a": {"s": "F", "n": 1}, "t": "x", "b": 1, "i": 3, "any": 1}', '{"a": {"s": "F", "n": 1}, "t": "x", "b": false, "i": true, "any": 1}', "[]", "no"]
    df = schemas.validated(spark.createDataFrame([(t,) for t in texts], "t string"), "t", spec).withColumn("c", schemas.light_column(F.col("t"), spec))
    assert [(r.c, r.schema_pass) for r in df.collect()] == [(True, True)] + [(False, False)] * 7


def test_conflicting_instructions_are_registered():
    assert set(schemas.CONFLICTS) | {k for v in schemas.CONFLICTS.values() for k in v} <= set(gates.INSTRUCTIONS)


def test_sentences(spark):
    cases = {
        "Dr. Smith met Mr. Lee at 3.5 p.m. today. They talked! Did they? Yes...": 4, "See www.a.com or e.g. b. Fine.": 2, "J. K. Rowling wrote it. I did not. So did I. End": 4, '"Stop." He said so.': 2, "": 0, "no end": 1, "一。二！三": 3, "?!": 0, "He lives in the U.S. and works.": 1,
    }
    for t, n in cases.items():
        assert len(gates.sentences(t)) == n, (t, gates.sentences(t))
    df = spark.createDataFrame([(t, n) for t, n in cases.items()] + [(None, 0)], "t string, n int")
    assert df.where(gates.sentence_count("t") != F.col("n")).count() == 0


def test_masking(spark):
    rows = [(i, 1, f"Dear reader of page {i}: thank you for your note today") for i in range(6)] + [(9, 2, "alone here and now"), (10, 3, ""), (11, 3, None), (12, 3, "x")]
    df = spark.createDataFrame(rows, "id long, g long, t string")
    grams = {r.gram for r in templates.structural(df, ["g"], "id", "t").where("g = 1").collect()}
    words = [t.lower().replace(":", "").split() for _, g, t in rows if g == 1]
    held = {}
    for w in words:
        first = {}
        for n in range(3, 8):
            for i in range(len(w) - n + 1):
                first.setdefault(" ".join(w[i : i + n]), i / len(w))
        for g, at in first.items():
            held.setdefault(g, []).append(at)
    assert grams == {g for g, a in held.items() if len(a) >= 4}  # places are equal, as the lengths are
    got = {r.id: r for r in templates.masked(df, ["g"], "id", "t").collect()}
    assert got[3].masked == "<TPL> 3:" and got[3].coverage == pytest.approx(10 / 11, abs=1e-4) and got[3].is_template
    assert got[9].masked == "alone here and now" and not got[9].is_template and got[11].masked == ""
    assert templates.collapse("a <TPL>  b <TPL> , c") == "a <TPL> b, c"


def bundle_rows(spark, **signals_):
    names = ("output", "diff_residual", "delta_ridge_ens", "discourse_instability", "contradiction")
    rows = [tuple(float(signals_.get(n, lambda i, k=k: 0.1 * (i % 7) + 0.01 * k)(i)) if signals_.get(n, 0) is not None else None for k, n in enumerate(names)) for i in range(24)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).withColumn("gate", F.lit(True)).withColumn("g", F.lit(1))
    return df, {n: n for n in names}


def limits(spark, **over):
    return spark.createDataFrame([(1, n, *over.get(n, (1.0, 2.0))) for n in ("output", "diff_residual", "delta_ridge_ens", "discourse_instability", "contradiction")], "g int, rule string, fail double, hard double")


def test_bundle_fallbacks(spark):
    score = lambda df, rules, th: {r.bundle: r.raw for r in scoring.bundle_scores(df, ["g"], rules, "gate", th).collect()}
    df, rules = bundle_rows(spark, diff_residual=lambda i: 0.0)
    assert score(df, rules, limits(spark, diff_residual=(0.0, 0.0)))["RID"] == pytest.approx(5)
    df, rules = bundle_rows(spark, discourse_instability=lambda i: 0.0)
    assert 4 < score(df, rules, limits(spark, discourse_instability=(0.0, 3.0)))["SEM"] <= 5
    df, rules = bundle_rows(spark, diff_residual=lambda i: 0.1 if i < 18 else 3.5 + 0.2 * (i - 18))
    assert score(df, rules, None)["RID"] != pytest.approx(3)
    df, rules = bundle_rows(spark, diff_residual=None)
    assert score(df, rules, None)["RID"] == pytest.approx(3)
    df, rules = bundle_rows(spark, discourse_instability=lambda i: 0.0, contradiction=lambda i: 0.0)
    out = scoring.bundle_scores(df, ["g"], rules, "gate").where("bundle = 'SEM'").first()
    assert out.raw is None and out.score is None


def test_pages(spark, tmp_path):
    df = spark.createDataFrame([(f"r{i % 2}", float(i), "fail" if i > 90 else "pass", i % 3 == 0) for i in range(100)], "rule string, signal double, state string, bad boolean")
    page, table = pages.diagnostics_page(df, "rule", "signal", "state", "bad")
    assert page.count("<svg") == 3 and table.count() == 2 and "<script" not in page
    plain, _ = pages.diagnostics_page(df, "rule", "signal", "state", drawings=False)
    assert "<svg" not in plain and "<table" in plain
    assert pages.signal_page(df, "rule", "signal", {"r0": 50.0}).count("<svg") == 2
    hits = df.withColumnRenamed("rule", "leaf").withColumn("available", F.lit(True)).withColumn("pass", F.col("state") == "pass")
    assert "r1" in pages.leaf_page(hits)
    points = df.withColumn("id", F.monotonically_increasing_id()).selectExpr("id", "signal AS ix", "signal * 2 AS iy", "signal AS ox", "-signal AS oy", "bad AS a", "state = 'fail' AS c")
    arrows = pages.arrows(points, "id", "a", "c")
    assert pages.arrow_page(arrows, "id", 30).count("<line") == 30 and "conflict" in {r.kind for r in arrows.collect()}
    assert "<circle" in pages.geometry_page(points, "id", "a")
    ring = [(i % 10 * 0.1, i // 10 * 0.1) for i in range(50)] + [(100 + i % 10 * 0.1, i // 10 * 0.1) for i in range(30)]
    assert [c[3] for c in pages.clusters(ring, 8, 1.0)] == [50, 30]
    pages.write_page(spark, page, str(tmp_path / "p.html"))
    assert (tmp_path / "p.html").read_text() == page


def test_streams(spark, tmp_path):
    """A stream of rows is scored against stored thresholds, and its windows and sessions close behind the watermark."""
    rows = [(i, "a" if i % 2 else "b", float(i), f"2024-01-01 {i // 60:02d}:{i % 60:02d}:00") for i in range(600)]
    df = spark.createDataFrame(rows, "id long, k string, v double, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    late = spark.createDataFrame([(9000, "a", 0.0, "2024-01-03 00:00:00")], "id long, k string, v double, ts string").withColumn("ts", F.to_timestamp("ts"))
    th = spark.createDataFrame([("a", 0.0, 200.0, 400.0, 500.0, "x"), ("b", 0.0, 200.0, 400.0, 500.0, "x")], "k string, warn_low double, warn double, fail double, hard double, source string")

    def drain(stream, name, mode="append"):
        q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return q

    source = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    drain(monitor.scored(source(), th, ["k"], "v"), "scored")
    got = {r.state: r.n for r in spark.table("scored").groupBy("state").agg(F.count("*").alias("n")).collect()}
    assert got == {"pass": 201, "warn": 199, "fail": 100, "hard_fail": 100}
    time.sleep(1.1)  # files are taken in the order they were written
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    one = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    # the late row moves the watermark past all windows and sessions before it
    drain(monitor.window_rates(monitor.scored(one(), th, ["k"], "v"), "ts", ["k"], "1 hour"), "windows")
    want = {(r.start, r.k): (r.n, r.fail_rate) for r in monitor.window_rates(monitor.scored(df, th, ["k"], "v"), "ts", ["k"], "1 hour").collect()}
    assert {(r.start, r.k): (r.n, r.fail_rate) for r in spark.table("windows").collect()} == want
    drain(monitor.sessions(one(), "ts", ["k"], "30 minutes"), "sessions")
    assert sorted((r.k, r.n) for r in spark.table("sessions").collect()) == [("a", 300), ("b", 300)]


def test_specs():
    assert specs.quantile_range("0.70~0.72(step 0.01)") == [0.70, 0.71, 0.72]
    for bad in ("0.7-0.8", "0.8~0.7(step 0.1)", "0.5~1.2(step 0.1)"):
        with pytest.raises(ValueError):
            specs.quantile_range(bad)
    with pytest.raises(ValueError):
        specs.quantile_list(" , ")
    with pytest.raises(ValueError):
        specs.rule_list("nothing")
    assert specs.rule_list("", ["output"]) == ["output"]


def test_settings():
    c = audit.AuditConfig.read({"review": "5", "semantic": "no", "instructions": '[["punctuation:no_comma", {}]]'}, {"GATELENS_REVIEW": "9", "GATELENS_SIMILARITY": "0.5"})
    assert (c.review, c.semantic, c.similarity, c.instructions) == (5, False, 0.5, (("punctuation:no_comma", {}),))
    assert audit.AuditConfig.read({"rules": "diff-residual,output"}).rules == ("diff_residual", "output")
    for bad in ({"nothing": 1}, {"semantic": "perhaps"}):
        with pytest.raises(ValueError):
            audit.AuditConfig.read(bad)


def test_semantic_context(spark):
    rows = [(i, json.dumps({"verdict": "good" if i % 2 else "bad", "reason": ("clear and right answer" if i % 2 else "wrong and missing facts") + f" number {i % 3}. It is so.", "score": i})) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, j string")
    from gatelens.operators.signals import hash_embed_768

    c = semantics.context(df, "id", "j", hash_embed_768)
    assert c.evidence_key == "reason" and c.verdict_key in ("verdict", "score") and not c.reason
    out, missing = semantics.pack(df, "id", "j", hash_embed_768)
    assert not missing and out.where("discourse_available and contradiction_available and self_contradiction_available").count() == 80
    none, why = semantics.pack(df.withColumn("j", F.lit("{}")), "id", "j", hash_embed_768)
    assert set(why.values()) == {"no verdict key"} and none.where("discourse <> 0").count() == 0


def test_whole_run(spark, tmp_path):
    rows = fixtures.benchmark(spark, 90, 30)
    rows.write.parquet(str(tmp_path / "s.parquet"))
    config = audit.AuditConfig(schema_json='{"is_correct": ["correct", "incorrect"], "feedback": "text"}', dim=128, leaves=True, leaf_rows=20, calibrate=True, review=5)
    out = cli.run(config, str(tmp_path / "s.parquet"), str(tmp_path / "out"), "t", spark)
    x = spark.read.parquet(out["rows"])
    assert x.count() == 120
    broken = {r.id for r in rows.where("kind IN ('broken_json', 'missing_key', 'extra_key')").collect()}
    assert broken <= {r.id for r in x.where("not schema_pass and final_state = 'hard_gate_fail'").collect()}
    b = {r.bundle for r in spark.read.parquet(out["bundles"]).collect()}
    assert b == {"COV", "OUT", "RID", "DIAG", "SEM", "CONF"}
    assert spark.read.parquet(out["review"]).count() <= 5 and spark.read.parquet(out["candidates"]).where("chosen").count() == 1
    assert os.path.getsize(out["diagnostics"]) > 1000
    assert json.loads(spark.read.text(out["run_config"]).first()[0])["dim"] == 128
    again = audit.states_from(x.where("output_signal is not null"), {"output": "output_signal"}, ["group_id"], "id")
    assert set(r.state for r in again.select("state").distinct().collect()) <= {"pass", "warn", "fail", "hard_fail", "na"}
    with pytest.raises(ValueError):
        cli.scorer(config, ["nothing"])
