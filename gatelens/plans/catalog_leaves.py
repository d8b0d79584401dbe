"""Queries of leaves: the events of a user are the leaves of a row, their type is the path, and user blocks are groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatelens.functions import scalar as S
from gatelens.operators import leaves, relational
from gatelens.plans.catalog import T, query, r, z_events
from gatelens.plans.oracles import ORACLES, Z
from gatelens.plans.oracles import r as q

PASS, BAD, SIZE, LATE = "'pass'", "('fail', 'hard_fail')", "'size'", "'late'"
STATES = {"s1": ("value", 150, 200, 300), "s2": ("event_id % 1000", 900, 980, 997), "s3": ("user_id % 40", 37, 38, 39)}


def hits(spark, d):
    """(user_id, g, event_type, rule, signal, available, pass, threshold): two rules, one with gaps."""
    e = T(spark, d, "events").withColumn("g", F.pmod("user_id", F.lit(3)))
    rules = F.array(F.struct(F.lit("size").alias("rule"), F.col("value").alias("signal")), F.struct(F.lit("late").alias("rule"), F.when(F.pmod("event_id", F.lit(11)) != 0, F.pmod("event_id", F.lit(101)).cast("double")).alias("signal")))
    x = e.select("event_id", "user_id", "g", "event_type", F.explode(rules).alias("s")).select("event_id", "user_id", "g", "event_type", "s.*")
    th = x.groupBy("g", "event_type", "rule").agg(F.percentile("signal", F.lit(0.95)).alias("threshold"))
    return leaves.hits(x, th, ["g", "event_type", "rule"], "signal")


HITS = """e AS (SELECT event_id, user_id, user_id % 3 AS g, event_type, value FROM events),
x AS (SELECT event_id, user_id, g, event_type, 'size' AS rule, value AS signal FROM e UNION ALL SELECT event_id, user_id, g, event_type, 'late', CASE WHEN event_id % 11 <> 0 THEN (event_id % 101)::DOUBLE END FROM e),
th AS (SELECT g, event_type, rule, quantile_cont(signal, 0.95) AS threshold FROM x GROUP BY 1, 2, 3),
hits AS (SELECT x.*, threshold, signal IS NOT NULL AND threshold IS NOT NULL AS available, coalesce(signal <= threshold, true) AS pass FROM x LEFT JOIN th USING (g, event_type, rule))"""
ROWS = """rows_ AS (SELECT user_id, rule, coalesce(bool_and(pass) FILTER (available), true) AS pass, max(signal) FILTER (available) AS signal, bool_or(available) AS available, count(*) AS leaves FROM hits GROUP BY 1, 2)"""
METRICS = """per AS (SELECT user_id, event_type, bool_or(available) AS e, count(*) FILTER (available AND NOT pass) AS f FROM hits GROUP BY 1, 2),
met AS (SELECT user_id, count(*) FILTER (e) AS evaluated, count(*) FILTER (f > 0) AS failed, coalesce(array_to_string(list(event_type ORDER BY f DESC, event_type) FILTER (f > 0), '|'), '') AS failed_paths FROM per GROUP BY 1)"""


@query
def leaf_hits(spark, d):
    x = hits(spark, d)
    return x.groupBy("g", "event_type", "rule").agg(r(F.max("threshold"), "threshold"), F.count_if("available").alias("available"), F.count_if(~F.col("pass")).alias("failed"))


ORACLES["leaf_hits"] = f"WITH {HITS} SELECT g, event_type, rule, {q('max(threshold)', 'threshold')}, count(*) FILTER (available) AS available, count(*) FILTER (NOT pass) AS failed FROM hits GROUP BY 1, 2, 3"


@query
def leaf_gate_rows(spark, d):
    return leaves.to_rows(hits(spark, d), "user_id", "rule").select("user_id", "rule", "pass", r("signal"), "available", "leaves")


ORACLES["leaf_gate_rows"] = f"WITH {HITS}, {ROWS} SELECT user_id, rule, pass, {q('signal', 'signal')}, available, leaves FROM rows_"


@query
def leaf_row_metrics(spark, d):
    return leaves.row_metrics(hits(spark, d), "user_id", "event_type", "rule")


ORACLES["leaf_row_metrics"] = f"WITH {HITS}, {METRICS} SELECT * FROM met"


@query
def scatter_metrics(spark, d):
    c = T(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return leaves.scatter(c, leaves.row_metrics(hits(spark, d), "user_id", "event_type", "rule"), "user_id", {"evaluated": 0, "failed": 0, "failed_paths": "none"})


ORACLES["scatter_metrics"] = f"WITH {HITS}, {METRICS} SELECT c_custkey AS user_id, c_mktsegment, coalesce(evaluated, 0) AS evaluated, coalesce(failed, 0) AS failed, coalesce(failed_paths, 'none') AS failed_paths FROM customer LEFT JOIN met ON user_id = c_custkey"


@query
def row_defaults(spark, d):
    x = leaves.with_defaults(leaves.require(T(spark, d, "customer"), ["c_custkey", "c_acctbal"]), {"hard_gate_pass": True, "c_acctbal": -1.0, "pca_x": 0.0, "group_id": "g0000"})
    return x.select("c_custkey", r("c_acctbal"), "hard_gate_pass", "pca_x", "group_id")


ORACLES["row_defaults"] = f"SELECT c_custkey, {q('c_acctbal', 'c_acctbal')}, true AS hard_gate_pass, 0.0::DOUBLE AS pca_x, 'g0000' AS group_id FROM customer"


@query
def signal_columns(spark, d):
    """The present name of a rule's column counts before its former one; availability falls back to a sibling's, then to all."""
    e = T(spark, d, "events").select("event_id", F.col("value").alias("output_score_nomask"), (F.col("value") * 2).alias("length_signal_nomask"), F.col("value").alias("length_score_nomask"), (F.col("value") > 5).alias("contradiction_available_nomask"))
    return e.select("event_id", r(leaves.signal_column(e, "output"), "output"), r(leaves.signal_column(e, "length"), "length"), leaves.availability(e, "self_contradiction", ("contradiction",)).alias("sibling"), leaves.availability(e, "output").alias("always"))


ORACLES["signal_columns"] = f"SELECT event_id, {q('value', 'output')}, {q('value * 2', 'length')}, value > 5 AS sibling, true AS always FROM events"


def overridden(spark, d):
    z = z_events(spark, d).withColumn("st", S.z_state("z", F.lit(2.0), F.lit(4.0)))
    g = z.groupBy("user_id").agg(F.max("st").alias("m"), F.count("*").alias("n")).withColumn("state", F.when(F.col("n") < 20, "na").when(F.col("m") == 2, "hard_fail").when(F.col("m") == 1, "fail").when(F.pmod("user_id", F.lit(5)) == 0, "warn").otherwise("pass"))
    return leaves.override(g.join(leaves.row_metrics(hits(spark, d), "user_id", "event_type", "rule"), "user_id"), "state", "failed")


OVERRIDDEN = f"""{Z}, st AS (SELECT user_id, max(CASE WHEN z >= 4 THEN 2 WHEN z >= 2 THEN 1 ELSE 0 END) AS m, count(*) AS n FROM zs GROUP BY 1),
base AS (SELECT user_id, CASE WHEN n < 20 THEN 'na' WHEN m = 2 THEN 'hard_fail' WHEN m = 1 THEN 'fail' WHEN user_id % 5 = 0 THEN 'warn' ELSE 'pass' END AS state FROM st), {HITS}, {METRICS},
ov AS (SELECT user_id, state AS state_before, CASE WHEN failed > 0 AND state IN ('pass', 'warn') THEN 'fail' ELSE state END AS state FROM base JOIN met USING (user_id))"""


@query
def detail_override(spark, d):
    return overridden(spark, d).select("user_id", "state_before", "state")


ORACLES["detail_override"] = f"WITH {OVERRIDDEN} SELECT * FROM ov"


@query
def detail_override_rates(spark, d):
    return leaves.override_rates(overridden(spark, d)).select("n", "flipped", r("rate_before"), r("rate_after"))


ORACLES["detail_override_rates"] = f"WITH {OVERRIDDEN} SELECT count(*) AS n, count(*) FILTER (state <> state_before) AS flipped, {q(f'avg((state_before IN {BAD})::INT)', 'rate_before')}, {q(f'avg((state IN {BAD})::INT)', 'rate_after')} FROM ov"


@query
def leaf_frequency(spark, d):
    m = leaves.row_metrics(hits(spark, d), "user_id", "event_type", "rule")
    return leaves.frequency(m, "user_id", "failed_paths", "failed").select("leaf", "rank", "rows", r("share"), r("mean_failed"), "concentrated")


ORACLES["leaf_frequency"] = f"""WITH {HITS}, {METRICS}, b AS (SELECT user_id, failed, unnest(string_split(failed_paths, '|')) AS leaf FROM met WHERE failed_paths <> ''), n AS (SELECT count(DISTINCT user_id) AS n FROM b),
g AS (SELECT leaf, count(DISTINCT user_id) AS rows, avg(failed) AS mean_failed FROM b GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)
SELECT leaf, (row_number() OVER (ORDER BY rows DESC, leaf))::INT AS rank, rows, {q('rows / n', 'share')}, {q('mean_failed', 'mean_failed')}, rows / n >= 0.60 AS concentrated FROM g, n"""


@query
def leaf_gate_table(spark, d):
    return leaves.tables(hits(spark, d), "user_id", "event_type", "rule")[0].select("event_type", "hits", "failed", r("fail_rate"), "rows", "top_rules")


ORACLES["leaf_gate_table"] = f"""WITH {HITS}, p AS (SELECT event_type, rule, count(*) FILTER (available) AS n, count(*) FILTER (available AND NOT pass) AS f FROM hits GROUP BY 1, 2),
u AS (SELECT event_type, count(DISTINCT user_id) AS rows FROM hits WHERE available AND NOT pass GROUP BY 1)
SELECT event_type, sum(n)::BIGINT AS hits, sum(f)::BIGINT AS failed, {q('sum(f) / sum(n)', 'fail_rate')}, any_value(rows) AS rows, array_to_string(list(rule || ':' || f ORDER BY f DESC, rule) FILTER (f > 0), '|') AS top_rules FROM p LEFT JOIN u USING (event_type) GROUP BY 1"""


@query
def leaf_rule_table(spark, d):
    return leaves.tables(hits(spark, d), "user_id", "event_type", "rule")[1].select("rule", "hits", "failed", "leaves", r("fail_rate"))


ORACLES["leaf_rule_table"] = f"""WITH {HITS}, p AS (SELECT event_type, rule, count(*) FILTER (available) AS n, count(*) FILTER (available AND NOT pass) AS f FROM hits GROUP BY 1, 2)
SELECT rule, sum(n)::BIGINT AS hits, sum(f)::BIGINT AS failed, count(*) FILTER (f > 0) AS leaves, {q('sum(f) / sum(n)', 'fail_rate')} FROM p GROUP BY 1"""


@query
def leaf_distribution(spark, d):
    x = leaves.distribution(hits(spark, d), ["event_type", "rule"])
    return x.select("event_type", "rule", "support", *[r(c) for c in ("mean", "std", "low", "q50", "q90", "q95", "q99", "high", "fail_rate")])


ORACLES["leaf_distribution"] = f"""WITH {HITS}, g AS (SELECT event_type, rule, count(*) AS support, avg(signal) AS m, stddev_pop(signal) AS s, min(signal) AS lo, max(signal) AS hi, quantile_cont(signal, [0.5, 0.9, 0.95, 0.99]) AS q, avg((NOT pass)::INT) AS f FROM hits WHERE available GROUP BY 1, 2)
SELECT event_type, rule, support, {q('m', 'mean')}, {q('s', 'std')}, {q('lo', 'low')}, {q('q[1]', 'q50')}, {q('q[2]', 'q90')}, {q('q[3]', 'q95')}, {q('q[4]', 'q99')}, {q('hi', 'high')}, {q('f', 'fail_rate')} FROM g"""


@query
def leaf_histograms(spark, d):
    x = leaves.histograms(hits(spark, d).where("rule = 'size'"), ["event_type"])
    return x.select("event_type", "bin", r("left_edge"), r("right_edge"), "n", "n_failed")


ORACLES["leaf_histograms"] = f"""WITH {HITS}, s AS (SELECT * FROM hits WHERE rule = 'size' AND available), e2 AS (SELECT event_type, min(signal) AS lo, (max(signal) - min(signal)) / 20 AS w FROM s GROUP BY 1),
c AS (SELECT event_type, least(floor((signal - lo) / w), 19)::INT AS bin, count(*) AS n, count(*) FILTER (NOT pass) AS f FROM s JOIN e2 USING (event_type) GROUP BY 1, 2),
b AS (SELECT event_type, lo, w, i::INT AS bin FROM e2, range(20) t(i))
SELECT event_type, bin, {q('lo + bin * w', 'left_edge')}, {q('lo + bin * w + w', 'right_edge')}, coalesce(n, 0) AS n, coalesce(f, 0) AS n_failed FROM b LEFT JOIN c USING (event_type, bin)"""


@query
def path_support(spark, d):
    x = T(spark, d, "conversations").select("conv_id", F.concat(F.lit("turn."), F.col("role")).alias("path"), F.col("text").alias("leaf"))
    return leaves.path_support(x, "conv_id")


ORACLES["path_support"] = "SELECT 'turn.' || role AS path, count(DISTINCT conv_id) AS rows, count(DISTINCT conv_id) FILTER (trim(coalesce(text, '')) <> '') AS filled, count(DISTINCT trim(text)) FILTER (trim(coalesce(text, '')) <> '') AS distinct_texts, 'leaf_turn.' || role AS column FROM conversations GROUP BY role"


@query
def leaf_group_summary(spark, d):
    rows = overridden(spark, d).withColumn("g", F.pmod("user_id", F.lit(3))).withColumn("gate", F.pmod("user_id", F.lit(7)) != 0)
    x = leaves.group_summary(rows, ["g"], "gate", "state", leaves.to_rows(hits(spark, d), "user_id", "rule"), "user_id")
    return x.select("g", "size", r("gate_rate"), r("pass_rate"), r("fail_rate"), r(F.col("outliers")["size"], "size_outliers"), r(F.col("outliers")["late"], "late_outliers"))


ORACLES["leaf_group_summary"] = f"""WITH {OVERRIDDEN}, {ROWS}, o AS (SELECT user_id % 3 AS g, rule, avg((NOT r.pass)::INT) FILTER (r.available) AS o FROM ov JOIN rows_ r USING (user_id) GROUP BY 1, 2),
s AS (SELECT user_id % 3 AS g, count(*) AS size, avg((user_id % 7 <> 0)::INT) AS gate, avg((state = 'pass')::INT) AS p, avg((state IN ('fail', 'hard_fail'))::INT) AS f FROM ov GROUP BY 1)
SELECT g, size, {q('gate', 'gate_rate')}, {q('p', 'pass_rate')}, {q('f', 'fail_rate')}, {q(f'max(o) FILTER (rule = {SIZE})', 'size_outliers')}, {q(f'max(o) FILTER (rule = {LATE})', 'late_outliers')} FROM s JOIN o USING (g) GROUP BY g, size, gate, p, f"""


@query
def group_run_summary(spark, d):
    e = T(spark, d, "events").withColumn("k", F.pmod("event_id", F.lit(66)) + 15).withColumn("w", F.least(F.lit(1.0), F.try_divide(F.lit(20.0), "value"))).withColumn("a", F.pmod("event_id", F.lit(9)) != 0)
    x = leaves.run_summary(e, ["event_type"], "k", "w", "a")
    return x.select("event_type", "n", "k_least", r("k_median"), "k_most", r("w05"), r("w50"), r("w95"), r("weighted_down"), r("available_rate"))


ORACLES["group_run_summary"] = f"""WITH x AS (SELECT event_type, event_id % 66 + 15 AS k, least(1.0, 20 / value) AS w, event_id % 9 <> 0 AS a FROM events), g AS (SELECT event_type, count(*) AS n, min(k) AS a, median(k) AS b, max(k) AS c, quantile_cont(w, [0.05, 0.5, 0.95]) AS w, avg((w < 1)::INT) AS d, avg(a::INT) AS e FROM x GROUP BY 1)
SELECT event_type, n, a AS k_least, {q('b', 'k_median')}, c AS k_most, {q('w[1]', 'w05')}, {q('w[2]', 'w50')}, {q('w[3]', 'w95')}, {q('d', 'weighted_down')}, {q('e', 'available_rate')} FROM g"""


@query
def operational_summary(spark, d):
    rows = overridden(spark, d).withColumn("gate", F.pmod("user_id", F.lit(7)) != 0).withColumn("final", F.when(~F.col("gate"), "hard_gate_fail").otherwise(F.col("state")))
    x = leaves.operational_summary(rows, "gate", "state", "final")
    return x.select("n", *[r(c) for c in ("gate_rate", "evaluated_rate", "pass_rate", "warn_rate", "fail_rate", "hard_fail_rate", "final_pass_rate")])


ORACLES["operational_summary"] = f"""WITH {OVERRIDDEN}, os AS (SELECT *, user_id % 7 <> 0 AS gate, user_id % 7 <> 0 AND state <> 'na' AS ev FROM ov)
SELECT count(*) AS n, {q('avg(gate::INT)', 'gate_rate')}, {q('avg(ev::INT)', 'evaluated_rate')}, """ + ", ".join(q(f"avg((state = '{k}')::INT) FILTER (ev)", f"{k}_rate") for k in ("pass", "warn", "fail", "hard_fail")) + f", {q(f'avg((gate AND state = {PASS})::INT)', 'final_pass_rate')} FROM os"


def edges(spark, d):
    e = T(spark, d, "events")
    of = lambda c, w, f, h: F.when(F.pmod("event_id", F.lit(13)) == 0, "na").when(c >= h, "hard_fail").when(c >= f, "fail").when(c >= w, "warn").otherwise("pass")
    cols = {"s1": F.col("value"), "s2": F.pmod("event_id", F.lit(1000)), "s3": F.pmod("user_id", F.lit(40))}
    return e.select("event_id", *[of(cols[k], *STATES[k][1:]).alias(k) for k in STATES])


EDGES = "ed AS (SELECT event_id, " + ", ".join(f"CASE WHEN event_id % 13 = 0 THEN 'na' WHEN {c} >= {h} THEN 'hard_fail' WHEN {c} >= {f} THEN 'fail' WHEN {c} >= {w} THEN 'warn' ELSE 'pass' END AS {k}" for k, (c, w, f, h) in STATES.items()) + " FROM events)"


@query
def edge_input_stats(spark, d):
    return leaves.edge_stats(edges(spark, d), list(STATES)).select("rule", "n", "warns", "fails", "hards", r("bad_rate"))


ORACLES["edge_input_stats"] = f"WITH {EDGES}, l AS (" + " UNION ALL ".join(f"SELECT '{k}' AS rule, {k} AS s FROM ed" for k in STATES) + f") SELECT rule, count(*) AS n, count(*) FILTER (s = 'warn') AS warns, count(*) FILTER (s = 'fail') AS fails, count(*) FILTER (s = 'hard_fail') AS hards, {q(f'avg((s IN {BAD})::INT)', 'bad_rate')} FROM l WHERE s <> 'na' GROUP BY 1"


@query
def edge_input_cases(spark, d):
    return leaves.edge_cases(edges(spark, d), "event_id", list(STATES)).select("rank", "event_id", r("severity"), *STATES)


ORACLES["edge_input_cases"] = f"""WITH {EDGES}, x AS (SELECT *, (s1 = 'hard_fail')::INT + (s2 = 'hard_fail')::INT + (s3 = 'hard_fail')::INT AS h, (s1 = 'fail')::INT + (s2 = 'fail')::INT + (s3 = 'fail')::INT AS f, (s1 = 'warn')::INT + (s2 = 'warn')::INT + (s3 = 'warn')::INT AS w FROM ed),
y AS (SELECT *, 8 * h + f + 0.25 * w AS severity, row_number() OVER (ORDER BY 8 * h + f + 0.25 * w DESC, event_id) AS rank FROM x WHERE h > 0)
SELECT rank::INT AS rank, event_id, {q('severity', 'severity')}, s1, s2, s3 FROM y WHERE rank <= 20"""


@query
def leaf_groups(spark, d):
    x = T(spark, d, "events").withColumn("g", F.pmod("user_id", F.lit(40))).withColumn("leaf", F.when(F.pmod("event_id", F.lit(5)) > 0, F.col("props")).otherwise(" "))
    return leaves.leaf_groups(x, "g", "event_type", "leaf", 40).groupBy("g", "event_type").agg(F.count("*").alias("n"))


ORACLES["leaf_groups"] = "SELECT user_id % 40 AS g, event_type, count(*) AS n FROM events WHERE event_id % 5 > 0 AND trim(props) <> '' GROUP BY 1, 2 HAVING count(*) >= 40"


@query
def leaf_density(spark, d):
    e = T(spark, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("g"), F.when(F.col("vec_id") % 2 == 0, "a").otherwise("b").alias("path"), F.col("embedding").cast("array<double>").alias("v"))
    return leaves.leaf_density(e, "vec_id", "g", "path", "v", 3).select("vec_id", "g", "path", F.round("density", 4).alias("density"), "pass")


ORACLES["leaf_density"] = """WITH e AS (SELECT vec_id, label::VARCHAR AS g, CASE WHEN vec_id % 2 = 0 THEN 'a' ELSE 'b' END AS path, embedding::DOUBLE[] AS v FROM embeddings),
n AS (SELECT a.vec_id, a.g, a.path, list_distance(a.v, b.v)::FLOAT AS x FROM e a JOIN e b ON a.g = b.g AND a.path = b.path AND a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY x, b.vec_id::VARCHAR) <= 3),
m AS (SELECT vec_id, g, path, avg(x::DOUBLE) AS density FROM n GROUP BY 1, 2, 3), t AS (SELECT g, path, quantile_cont(density, 0.995) AS t FROM m GROUP BY 1, 2)
SELECT vec_id, g, path, round(density, 4) AS density, density <= t AS pass FROM m JOIN t USING (g, path)"""


@query
def leaf_fallback(spark, d):
    h = hits(spark, d).where("available").select("user_id", F.col("event_type").alias("leaf"), "signal").where("signal > 150")
    own = T(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.lit(leaves.FALLBACK_LEAF).alias("leaf"), F.col("c_acctbal").alias("signal"))
    return leaves.with_fallback(h, own, "user_id").groupBy("leaf").agg(F.count("*").alias("n"), r(F.sum("signal"), "total"))


ORACLES["leaf_fallback"] = f"""WITH {HITS}, h AS (SELECT user_id, event_type AS leaf, signal FROM hits WHERE available AND signal > 150),
u AS (SELECT * FROM h UNION ALL SELECT c_custkey, '__group__', c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM h)) SELECT leaf, count(*) AS n, {q('sum(signal)', 'total')} FROM u GROUP BY 1"""


@query
def leaf_median_thresholds(spark, d):
    th = hits(spark, d).select("g", "event_type", "rule", "threshold").distinct()
    return leaves.leaf_thresholds(th, "g", "rule").select("g", "rule", r("threshold"), "leaves")


ORACLES["leaf_median_thresholds"] = f"WITH {HITS} SELECT g, rule, {q('median(threshold)', 'threshold')}, count(*) AS leaves FROM th GROUP BY 1, 2"


@query
def leaf_triplets(spark, d):
    x = leaves.triplets(hits(spark, d), "event_type", "rule", 3)
    return x.select("event_type", "rule", "n", *[r(c) for c in ("r_core", "r_rate", "r_mass", "risk", "quality")])


def axis(rows: str, by: str, signal: str) -> str:
    """CTEs up to axes (by, n, p_fail, p_hard, r_rate, r_mass, r_core, risk): the continuous profile of a signal."""
    noisy = "1 - (1 - 0.15 * r_core) * (1 - 0.55 * r_rate) * (1 - 0.30 * r_mass)"
    return f"""am AS (SELECT {by}, median({signal}) AS m FROM {rows} GROUP BY ALL), ad AS (SELECT {by}, m, median(abs({signal} - m)) AS s FROM {rows} JOIN am USING ({by}) GROUP BY ALL),
az AS (SELECT {by}, greatest(0.0, ({signal} - m) / (1.4826 * s + 1e-9)) AS z FROM {rows} JOIN ad USING ({by})), aq AS (SELECT {by}, quantile_cont(z, 0.7) AS q FROM az GROUP BY ALL),
ac AS (SELECT {by}, median(z) AS c FROM az JOIN aq USING ({by}) WHERE z <= q GROUP BY ALL), ak AS (SELECT {by}, median(abs(z - c)) AS mad FROM az JOIN aq USING ({by}) JOIN ac USING ({by}) WHERE z <= q GROUP BY ALL),
ap AS (SELECT {by}, count(*) AS n, avg(1 / (1 + exp(-least(60, greatest(-60, (z - 2) / 0.6))))) AS p_fail, avg(1 / (1 + exp(-least(60, greatest(-60, (z - 3.5) / 0.6))))) AS p_hard,
  avg(ln(1 + exp(least(60, (z - 2) / 0.8)))) + 3 * avg(ln(1 + exp(least(60, (z - 3.5) / 0.8)))) AS mass FROM az GROUP BY ALL),
ar AS (SELECT *, least(1.0, greatest(0.0, p_fail + 8 * p_hard)) AS r_rate, mass / (mass + 0.5) AS r_mass, mad / (mad + 0.5) AS r_core FROM ap JOIN ak USING ({by})),
axes AS (SELECT *, least(1.0, {noisy} + 0.25 * p_hard * (0.5 + 0.5 * r_mass)) AS risk FROM ar)"""


ORACLES["leaf_triplets"] = f"""WITH {HITS}, tp AS (SELECT event_type FROM hits WHERE available GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3), hx AS (SELECT event_type, rule, signal FROM hits WHERE available AND event_type IN (FROM tp)), {axis('hx', 'event_type, rule', 'signal')}
SELECT event_type, rule, n, {q('r_core', 'r_core')}, {q('r_rate', 'r_rate')}, {q('r_mass', 'r_mass')}, {q('risk', 'risk')}, {q('5 * (1 - risk)', 'quality')} FROM axes"""


@query
def template_group_meta(spark, d):
    """Statistics of groups joined to what is known of the groups, none lost."""
    stats_ = T(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    meta = T(spark, d, "customer").where("c_custkey % 4 > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return leaves.with_group(stats_, meta, ["o_custkey"])


ORACLES["template_group_meta"] = "SELECT o_custkey, count(*) AS n, any_value(c_mktsegment) AS c_mktsegment FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 4 > 0 GROUP BY 1"


@query
def benchmark_eval(spark, d):
    """Predictions joined to the labels of their items, and how they agree."""
    p = T(spark, d, "documents").select("doc_id", (F.length("text") > 600).alias("pred"))
    x = relational.label_lookup(p, T(spark, d, "labels"), "doc_id", "doc_id", "quality", "doc_id")
    return x.groupBy("pred", "label").agg(F.count("*").alias("n"))


ORACLES["benchmark_eval"] = "SELECT length(text) > 600 AS pred, quality AS label, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2"


@query
def ordered_tables(spark, d):
    """Rows of a table in a stable order: fail rate, then support, then name."""
    x = leaves.tables(hits(spark, d), "user_id", "event_type", "rule")[0].orderBy(F.desc("fail_rate"), F.desc("hits"), "event_type")
    return x.withColumn("rank", F.row_number().over(leaves.Window.orderBy(F.desc("fail_rate"), F.desc("hits"), "event_type"))).select("rank", "event_type", r("fail_rate"))  # a row per leaf


ORACLES["ordered_tables"] = f"""WITH {HITS}, p AS (SELECT event_type, count(*) FILTER (available) AS n, count(*) FILTER (available AND NOT pass) AS f FROM hits GROUP BY 1) SELECT (row_number() OVER (ORDER BY f / n DESC, n DESC, event_type))::INT AS rank, event_type, {q('f / n', 'fail_rate')} FROM p"""


@query
def priority_sample(spark, d):
    return relational.priority_sample(T(spark, d, "events").withColumn("odd", F.col("value") > 300), "event_id", "odd", 200).select("event_id", "odd")


ORACLES["priority_sample"] = "SELECT event_id, value > 300 AS odd FROM events ORDER BY value > 300 DESC, md5(event_id::VARCHAR || '42'), event_id LIMIT 200"


@query
def first_occurrences(spark, d):
    return relational.distinct_first(T(spark, d, "events"), "user_id", "event_id").select("user_id", "event_id")


ORACLES["first_occurrences"] = "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1"
