"""Queries of schemas, sources, made-up benchmarks, tables of reports, and of the whole audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatelens.operators import leaves, schemas, signals
from gatelens.plans import audit
from gatelens.plans.catalog import T, emb, query, r, z_events
from gatelens.plans.catalog_leaves import HITS, hits
from gatelens.plans.oracles import ORACLES, Z
from gatelens.plans.oracles import r as q
from gatelens.reports import pages
from gatelens.sources import artifacts, fixtures, tables

E = ["event_type"]
SCHEMA = {"type": "object", "properties": {"k": {"type": "integer", "minimum": 10, "exclusiveMaximum": 50}}, "required": ["k"], "additionalProperties": False}


@query
def json_schema_gate(spark, d):
    x = T(spark, d, "events").withColumn("j", F.when(F.pmod("event_id", F.lit(9)) == 0, F.lit('{"k": "1"}')).when(F.pmod("event_id", F.lit(10)) == 0, F.lit("{}")).when(F.pmod("event_id", F.lit(11)) == 0, F.lit('{"k": 11, "z": 1}')).when(F.pmod("event_id", F.lit(13)) == 0, F.lit("no")).otherwise(F.col("props")))
    return schemas.validated(x, "j", SCHEMA).select("event_id", "schema_parsed", "schema_pass", F.array_join("schema_problems", "|").alias("problems"))


ORACLES["json_schema_gate"] = """WITH x AS (SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events),
y AS (SELECT event_id, NOT (event_id % 13 = 0 AND event_id % 9 <> 0 AND event_id % 10 <> 0 AND event_id % 11 <> 0) AS p, CASE WHEN event_id % 9 = 0 THEN '$.k: type' WHEN event_id % 10 = 0 THEN '$: required k' WHEN event_id % 11 = 0 THEN '$.z: additionalProperties' WHEN event_id % 13 = 0 THEN '$: not JSON' WHEN k < 10 THEN '$.k: minimum' WHEN k >= 50 THEN '$.k: exclusiveMaximum' ELSE '' END AS problems FROM x)
SELECT event_id, p AS schema_parsed, problems = '' AS schema_pass, problems FROM y"""


@query
def json_schema_summary(spark, d):
    return schemas.summary(schemas.validated(T(spark, d, "events"), "props", SCHEMA)).select("n", r("parse_rate"), r("valid_rate"), "invalid", "problems")


ORACLES["json_schema_summary"] = f"""WITH x AS (SELECT json_extract_string(props, '$.k')::INT AS k FROM events), p AS (SELECT CASE WHEN k < 10 THEN '$.k: minimum' ELSE '$.k: exclusiveMaximum' END AS p, count(*) AS c FROM x WHERE k < 10 OR k >= 50 GROUP BY 1)
SELECT count(*) AS n, 1.0::DOUBLE AS parse_rate, {q('avg((k >= 10 AND k < 50)::INT)', 'valid_rate')}, count(*) FILTER (k < 10 OR k >= 50) AS invalid, (SELECT string_agg(p || ' x' || c, '; ' ORDER BY c DESC, p) FROM p) AS problems FROM x"""


@query
def light_schema_column(spark, d):
    """A light schema without Python: nested objects, choices and types."""
    j = F.to_json(F.struct(F.struct(F.col("o_orderstatus").alias("s"), F.col("o_custkey").alias("c")).alias("a"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("p")))
    spec = {"a": {"s": ["F", "O"], "c": "integer"}, "p": "text"}
    return T(spark, d, "orders").select("o_orderkey", schemas.light_column(j, spec).alias("strict"), schemas.light_column(j, spec, False).alias("lenient"))


ORACLES["light_schema_column"] = "SELECT o_orderkey, o_orderstatus IN ('F', 'O') AND o_orderkey % 3 > 0 AS strict, o_orderstatus IN ('F', 'O') AS lenient FROM orders"


@query
def schema_inference(spark, d):
    """Keys that nearly all objects hold: few values are choices, one is a constant, the rest is text."""
    o = T(spark, d, "orders").select(F.to_json(F.struct(F.struct(F.col("o_orderstatus").alias("s")).alias("a"), F.lit("v1").alias("version"), F.col("o_custkey").alias("c"), F.when(F.col("o_orderkey") % 2 == 0, F.lit(1)).alias("half"))).alias("j"))
    spec, _ = schemas.infer(o, "j")
    flat = [(k, schemas.type_name(v), "|".join(v) if isinstance(v, list) else "") for k, v in spec.items() if not isinstance(v, dict)] + [(f"{k}.{i}", schemas.type_name(w), "|".join(w) if isinstance(w, list) else "") for k, v in spec.items() if isinstance(v, dict) for i, w in v.items()]
    return spark.createDataFrame(flat, "key string, kind string, choices string")


ORACLES["schema_inference"] = "SELECT 'a.s' AS key, 'categorical' AS kind, string_agg(DISTINCT o_orderstatus, '|' ORDER BY o_orderstatus) AS choices FROM orders UNION ALL SELECT 'version', 'categorical', 'v1' UNION ALL SELECT 'c', 'text', ''"


@query
def schema_sources(spark, d):
    e = T(spark, d, "events")
    rows = [("inline", schemas.resolve(e, "props", inline='{"k": "integer"}')[1]), ("default", schemas.resolve(e, "props", default={"k": "text"})[1]), ("outputs", schemas.resolve(e, "props")[1]), ("none", schemas.resolve(e, "event_type")[1])]
    return spark.createDataFrame(rows, "given string, source string")


ORACLES["schema_sources"] = "SELECT * FROM (VALUES ('inline', 'inline'), ('default', 'default'), ('outputs', 'inferred'), ('none', 'none (0.00 of the outputs are objects)')) t(given, source)"


@query
def conflict_closure(spark, d):
    return spark.createDataFrame([(a, b) for a, v in schemas.closed(schemas.CONFLICTS).items() for b in v], "a string, b string")


ORACLES["conflict_closure"] = "WITH c AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, v in schemas.CONFLICTS.items() for b in sorted(v)) + ") t(a, b)) SELECT a, b FROM c UNION SELECT b, a FROM c UNION SELECT a, a FROM c UNION SELECT b, b FROM c"


@query
def json_columns(spark, d):
    x = T(spark, d, "events").withColumn("j", F.when(F.pmod("event_id", F.lit(8)) > 0, F.col("props")).otherwise(F.lit("{")))
    return tables.json_columns(x.select("event_id", "j"), "j").select("event_id", F.col("`j.k`").alias("k"), F.col("_parse_error").alias("broken"))


ORACLES["json_columns"] = "SELECT event_id, CASE WHEN event_id % 8 > 0 THEN json_extract_string(props, '$.k') END AS k, event_id % 8 = 0 AS broken FROM events"
ORACLES["text_previews"] = """WITH s AS (SELECT conv_id, turn, len(list_filter(string_split_regex(coalesce(text, ''), '[.!?;:\\n。！？；：]+|\\s-\\s'), lambda p: len(regexp_extract_all(p, '[\\p{L}\\p{N}_]+')) >= 2)) AS k FROM conversations)
SELECT c.conv_id, c.turn, CASE WHEN length(replace(text, chr(10), ' ')) > 40 THEN left(replace(text, chr(10), ' '), 40) || '...' ELSE replace(text, chr(10), ' ') END AS preview, left(regexp_replace(text, '[^A-Za-z0-9._-]+', '_', 'g'), 20) AS path, least(k, 4)::INT AS n_segments FROM conversations c JOIN s USING (conv_id, turn)"""


@query
def source_union(spark, d):
    c = T(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("idx"), F.col("c_name").alias("user_input"), F.lit(None).cast("string").alias("user_prompt"))
    s = T(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("idx"), F.lit(None).cast("string").alias("user_input"), F.col("s_name").alias("user_prompt"))
    return artifacts.union_sources([c, s], {"idx": "id", "user_input": "input"}, ["correct", "incorrect"], {"user_input": "user_prompt"}).select("id", "input", "eval")


ORACLES["source_union"] = "SELECT c_custkey::VARCHAR AS id, c_name AS input, 'correct' AS eval FROM customer UNION ALL SELECT s_suppkey::VARCHAR, s_name, 'incorrect' FROM supplier"


@query
def benchmark_fixture(spark, d):
    return fixtures.benchmark(spark, 900, 300).groupBy("eval", "family", "kind").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


ORACLES["benchmark_fixture"] = "WITH k AS (SELECT unnest([" + ", ".join(f"{{'f': '{f}', 'k': '{k}'}}" for f, k in fixtures.KINDS) + "]) AS u) SELECT 'incorrect' AS eval, u.f AS family, u.k AS kind, 25::BIGINT AS n, 25::BIGINT AS ids FROM k UNION ALL SELECT 'correct', NULL, NULL, 900, 900"


@query
def nested_fixture(spark, d):
    """How deep the outputs of the nested benchmark lie, and how many are whole."""
    x = fixtures.nested_benchmark(spark, 120, 60)
    return x.groupBy("eval").agg(F.count("*").alias("n"), F.count_if(F.get_json_object("expectedOutput", "$.level_1.level_2.level_3.feedback").isNotNull()).alias("whole"))


ORACLES["nested_fixture"] = "SELECT 'correct' AS eval, 120::BIGINT AS n, 120::BIGINT AS whole UNION ALL SELECT 'incorrect', 60, 55"


@query
def report_signal_bins(spark, d):
    x = pages.signal_bins(T(spark, d, "events").withColumn("bad", F.pmod("user_id", F.lit(4)) == 0), E, "value", "bad", 30)
    return x.select("event_type", "bin", r("left_edge"), "n", "n_bad", r("bad_ratio"))


ORACLES["report_signal_bins"] = f"""WITH e AS (SELECT event_type, min(value) AS lo, (max(value) - min(value)) / 30 AS w FROM events GROUP BY 1), c AS (SELECT event_type, least(floor((value - lo) / w), 29)::INT AS bin, count(*) AS n, count(*) FILTER (user_id % 4 = 0) AS b FROM events JOIN e USING (event_type) GROUP BY 1, 2),
g AS (SELECT event_type, lo, w, i::INT AS bin FROM e, range(30) t(i)) SELECT event_type, bin, {q('lo + bin * w', 'left_edge')}, coalesce(n, 0) AS n, coalesce(b, 0) AS n_bad, {q('b / n', 'bad_ratio')} FROM g LEFT JOIN c USING (event_type, bin)"""


def stated(spark, d):
    return z_events(spark, d).withColumn("state", F.when(F.col("z") >= 4, "hard_fail").when(F.col("z") >= 2, "fail").when(F.col("z") >= 1, "warn").otherwise("pass")).withColumn("bad", F.pmod("user_id", F.lit(3)) == 0)


@query
def report_diagnostics(spark, d):
    x = pages.diagnostics(stated(spark, d), E, "value", "state", "bad")
    return x.select("event_type", "n", r("q1"), r("med"), r("q3"), "outliers", *[r(f"{k}_rate") for k in ("pass", "warn", "fail", "hard_fail")], r("bad_precision"))


ORACLES["report_diagnostics"] = f"""WITH {Z}, s AS (SELECT *, CASE WHEN z >= 4 THEN 'hard_fail' WHEN z >= 2 THEN 'fail' WHEN z >= 1 THEN 'warn' ELSE 'pass' END AS s FROM zs), b AS (SELECT event_type, count(*) AS n, quantile_cont(value, [0.25, 0.5, 0.75]) AS q FROM zs GROUP BY 1),
o AS (SELECT event_type, count(*) FILTER (value < q[1] - 1.5 * (q[3] - q[1]) OR value > q[3] + 1.5 * (q[3] - q[1])) AS outliers FROM zs JOIN b USING (event_type) GROUP BY 1),
g AS (SELECT event_type, avg((s = 'pass')::INT) AS p, avg((s = 'warn')::INT) AS w, avg((s = 'fail')::INT) AS f, avg((s = 'hard_fail')::INT) AS h, avg((user_id % 3 = 0)::INT) FILTER (s IN ('fail', 'hard_fail')) AS y FROM s GROUP BY 1)
SELECT event_type, n, {q('q[1]', 'q1')}, {q('q[2]', 'med')}, {q('q[3]', 'q3')}, outliers, {q('p', 'pass_rate')}, {q('w', 'warn_rate')}, {q('f', 'fail_rate')}, {q('h', 'hard_fail_rate')}, {q('y', 'bad_precision')} FROM b JOIN o USING (event_type) JOIN g USING (event_type)"""


@query
def report_arrows(spark, d):
    e = emb(spark, d).select("vec_id", *[F.col("v")[i].alias(n) for i, n in enumerate(("ix", "iy", "ox", "oy"))], (F.pmod("vec_id", F.lit(5)) == 0).alias("a"), (F.pmod("vec_id", F.lit(7)) == 0).alias("c"), F.when(F.pmod("vec_id", F.lit(3)) > 0, F.pmod("vec_id", F.lit(2)) == 0).alias("bad"), (F.pmod("vec_id", F.lit(4)) > 0).alias("ok"))
    x = pages.arrows(e, "vec_id", "a", "c", "bad", "ok")
    return x.select("vec_id", r("x0"), r("y1"), "kind", "outcome")


ORACLES["report_arrows"] = f"SELECT vec_id, {q('embedding[1]', 'x0')}, {q('embedding[4]', 'y1')}, CASE WHEN vec_id % 7 = 0 THEN 'conflict' WHEN vec_id % 5 = 0 THEN 'anomaly' ELSE 'normal' END AS kind, CASE WHEN vec_id % 3 = 0 THEN NULL WHEN vec_id % 4 = 0 THEN CASE WHEN vec_id % 2 = 0 THEN 'TP' ELSE 'FP' END WHEN vec_id % 2 = 0 THEN 'FN' ELSE 'TN' END AS outcome FROM embeddings"


@query
def cluster_compactness(spark, d):
    e = emb(spark, d).select("label", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"), (F.pmod("vec_id", F.lit(3)) == 0).alias("f"))
    return signals.compactness(e, ["label"], "x", "y", "f").select("label", "flagged", r("compactness"))


ORACLES["cluster_compactness"] = f"""WITH f AS (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings WHERE vec_id % 3 = 0), c AS (SELECT label, avg(x) AS cx, avg(y) AS cy, count(*) AS n FROM f GROUP BY 1)
SELECT label, n AS flagged, {q('CASE WHEN n >= 3 THEN median(sqrt((x - cx) ** 2 + (y - cy) ** 2)) END', 'compactness')} FROM f JOIN c USING (label) GROUP BY label, n"""


@query
def member_spread(spark, d):
    e = T(spark, d, "events").select("event_id", F.col("value").alias("a"), F.when(F.pmod("event_id", F.lit(3)) > 0, F.col("user_id").cast("double")).alias("b"), F.when(F.pmod("event_id", F.lit(6)) > 0, F.sqrt("value")).alias("c"))
    return e.select("event_id", r(signals.spread_of(["a", "b", "c"]), "spread"))


ORACLES["member_spread"] = f"WITH x AS (SELECT event_id, unnest([value, CASE WHEN event_id % 3 > 0 THEN user_id::DOUBLE END, CASE WHEN event_id % 6 > 0 THEN sqrt(value) END]) AS v FROM events) SELECT event_id, {q('CASE WHEN count(v) >= 2 THEN stddev_pop(v) END', 'spread')} FROM x GROUP BY 1"
ADAPT = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT a.vec_id, b.vec_id AS neighbour, list_distance(a.v, b.v)::FLOAT AS x FROM e a JOIN e b ON a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x, neighbour) AS r FROM n QUALIFY r <= 20), j AS (SELECT vec_id, r, lead(x) OVER (PARTITION BY vec_id ORDER BY r) / (x + 1e-9) AS g FROM k)"""
ORACLES["adaptive_k"] = f"{ADAPT} SELECT vec_id, coalesce(min(r) FILTER (g >= 1.03 AND r >= 4), 8)::INT AS used_k FROM j GROUP BY 1"


@query
def local_context(spark, d):
    e = signals.knn(emb(spark, d), "vec_id", "v", 20)
    return signals.local_context(e, "vec_id", 64, 4, 80, 1.03).groupBy("vec_id").agg(F.count("*").alias("n"), F.max("rank").alias("last"))


ORACLES["local_context"] = f"{ADAPT} SELECT vec_id, coalesce(min(r) FILTER (g >= 1.03 AND r >= 4), 8)::BIGINT AS n, coalesce(min(r) FILTER (g >= 1.03 AND r >= 4), 8)::INT AS last FROM j GROUP BY 1"


@query
def reduced_vectors(spark, d):
    """Vectors on the axes that hold nine tenths of the variance: how many, and how much they hold."""
    x = signals.reduced(emb(spark, d), "vec_id", "v")
    return x.agg(F.max(F.size("coordinates")).alias("dims"), F.count("*").alias("n"))


@query
def leaf_report_order(spark, d):
    x = leaves.distribution(hits(spark, d), ["event_type"])
    return pages.ranked(x, [F.desc("support"), F.col("event_type")], 3).select("place", "event_type", "support")


ORACLES["leaf_report_order"] = f"WITH {HITS}, g AS (SELECT event_type, count(*) AS support FROM hits WHERE available GROUP BY 1) SELECT (row_number() OVER (ORDER BY support DESC, event_type))::INT AS place, event_type, support FROM g QUALIFY place <= 3"


# the whole audit ------------------------------------------------------------------------------------------------------
def pairs(spark, d):
    return tables.conversation_pairs(T(spark, d, "conversations")).withColumn("id", F.col("conv_id") * 1000 + F.col("turn")).select("id", "prompt", "input", "output")


def audited(spark, d):
    return audit.run(pairs(spark, d), audit.AuditConfig(instructions=(("length_constraints:number_words", {"num_words": 3}),)))


@query
def audit_rows(spark, d):
    return audited(spark, d).rows.select("id", "group_id", "ifeval_pass", "hard_gate_pass", "fails", "hards", r("risk"), "final_state")


@query
def audit_bundles(spark, d):
    return audited(spark, d).bundles.select("group_id", "bundle", r("raw"), "score")


@query
def audit_gates(spark, d):
    """The gates of the audit alone."""
    from gatelens.operators.windows import group_ids

    g, _ = audit.gated(group_ids(pairs(spark, d), "prompt", "id"), audit.AuditConfig(instructions=(("length_constraints:number_words", {"num_words": 3}),)))
    return g.select("id", "group_id", "ifeval_pass", "schema_pass", "textlen_pass", "hard_gate_pass")


ORACLES["audit_gates"] = """WITH x AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS nr, lead(text) OVER w AS output, max(text) FILTER (role = 'system') OVER (PARTITION BY conv_id) AS p FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
c AS (SELECT conv_id * 1000 + turn AS id, coalesce(p, '__all__') AS prompt, text AS input, coalesce(output, '') AS output FROM x WHERE role = 'user' AND nr = 'assistant'), f AS (SELECT prompt, printf('g%04d', row_number() OVER (ORDER BY min(id), prompt) - 1) AS group_id FROM c GROUP BY 1),
l AS (SELECT c.*, group_id, trim(output) <> '' AS filled, length(trim(output)) AS n FROM c JOIN f USING (prompt)), t AS (SELECT CASE WHEN count(*) FILTER (filled) >= greatest(3, ceil(count(*) * 0.2)) THEN median(n) FILTER (filled) * 0.3 END AS t FROM l)
SELECT id, group_id, filled AND len(regexp_extract_all(output, '[\\p{L}\\p{N}_]+')) >= 3 AS ifeval_pass, true AS schema_pass, coalesce(NOT (filled AND n <= t), true) AS textlen_pass, filled AND len(regexp_extract_all(output, '[\\p{L}\\p{N}_]+')) >= 3 AND coalesce(NOT (filled AND n <= t), true) AS hard_gate_pass FROM l, t"""
