"""Queries of score maps, rule statistics, fallbacks and the six bundles."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatelens.functions import scalar as S
from gatelens.operators import scoring, signals, stats
from gatelens.plans.catalog import T, emb, query, r, z_events
from gatelens.plans.catalog_leaves import axis
from gatelens.plans.oracles import ORACLES, Z
from gatelens.plans.oracles import r as q

E = ["event_type"]


@query
def guard_maps(spark, d):
    """Buckets by cuts, floors, hard events and catastrophic cases."""
    v, p = F.col("value"), F.pmod("event_id", F.lit(97)) / 97
    cuts = [F.lit(float(c)) for c in (20, 60, 120, 200, 400)]
    bad = F.pmod("user_id", F.lit(3)) == 0
    return T(spark, d, "events").select(
        "event_id", S.good_bucket(v, cuts).alias("good"), S.risk_bucket(v, cuts).alias("risk"), S.relaxed_risk_bucket(v, cuts, 2, 500.0, bad).alias("relaxed"), r(S.or_risk([p * 5, F.when(v > 100, v / 100)], [0.7, 0.3]), "or_risk"),
        S.floor_unless(F.floor(p * 6), 2, bad).alias("floored"), S.hard_events(p, F.col("user_id"), 0.2, 10).alias("hard"), S.catastrophic(p, F.col("user_id"), v / 100, 0.2, 10, 1.0).alias("catastrophic"),
        S.bool_or_default(F.when(F.col("event_type") != "click", F.col("event_type") == "view"), True).alias("flag"),
    )


ORACLES["guard_maps"] = f"""WITH x AS (SELECT *, (event_id % 97) / 97 AS p, (value >= 20)::INT + (value >= 60)::INT + (value >= 120)::INT + (value >= 200)::INT + (value >= 400)::INT AS g, 5 - (value > 20)::INT - (value > 60)::INT - (value > 120)::INT - (value > 200)::INT - (value > 400)::INT AS k, user_id % 3 = 0 AS bad FROM events)
SELECT event_id, g AS good, k AS risk, CASE WHEN k > 0 THEN k WHEN bad AND value >= 500 THEN 0 ELSE 2 END AS relaxed,
  {q('1 - greatest(0, least(1, 1 - CASE WHEN value > 100 THEN 0.7 ELSE 1 END * (1 - p))) * CASE WHEN value > 100 THEN greatest(0, least(1, 1 - 0.3 * greatest(0, least(1, 1 - value / 500)))) ELSE 1 END', 'or_risk')},
  CASE WHEN bad THEN least(5, floor(p * 6)::INT) ELSE greatest(2, least(5, floor(p * 6)::INT)) END AS floored, p >= 0.2 AND p * user_id >= 10 AS hard, p > 0.2 AND p * user_id >= 10 AND value / 100 > 1 AS catastrophic, CASE WHEN event_type = 'click' THEN true ELSE event_type = 'view' END AS flag FROM x"""


@query
def missing_labels(spark, d):
    src = F.when(F.pmod("event_id", F.lit(5)) == 0, "na").when(F.pmod("event_id", F.lit(5)) == 1, "na_neutral").otherwise("bucket")
    why = F.when(F.pmod("event_id", F.lit(15)) == 0, "required_axis_na").when(F.pmod("event_id", F.lit(10)) == 0, " ")
    na, label, reasons = S.na_label(src, F.when(F.pmod("event_id", F.lit(7)) > 0, F.col("value")), F.lit(3.0), None, (why,))
    return T(spark, d, "events").select("event_id", na.alias("na"), label.alias("label"), reasons.alias("reasons"))


ORACLES["missing_labels"] = """WITH x AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'na' WHEN 1 THEN 'na_neutral' ELSE 'bucket' END AS s, CASE WHEN event_id % 15 = 0 THEN 'required_axis_na' END AS w, event_id % 7 = 0 AS no FROM events), y AS (SELECT *, s <> 'bucket' OR no AS na FROM x)
SELECT event_id, na, CASE WHEN NOT na THEN '' WHEN w IS NOT NULL THEN 'NA (a required axis is missing)' WHEN s = 'na_neutral' THEN 'NA (neutral)' ELSE 'NA (not computed)' END AS label, CASE WHEN na THEN concat_ws(';', s, w) ELSE '' END AS reasons FROM y"""


@query
def lower_keys(spark, d):
    j = F.concat(F.lit('{" A ": "'), F.col("event_type"), F.lit('", "a": "'), F.col("user_id").cast("string"), F.lit('", "B": 1}'))
    m = S.lower_keys(j)
    return T(spark, d, "events").select("event_id", m["a"].alias("a"), m["b"].alias("b"), F.size(m).alias("n"))


ORACLES["lower_keys"] = "SELECT event_id, user_id::VARCHAR AS a, '1' AS b, 2 AS n FROM events"


@query
def canonical_text(spark, d):
    j = F.when(F.pmod("event_id", F.lit(2)) == 0, F.concat(F.lit('{ "b" : '), F.col("user_id").cast("string"), F.lit(' ,  "a":[1, "'), F.col("event_type"), F.lit('"]}'))).otherwise(F.concat(F.lit("  plain \n"), F.col("event_type"), F.lit("\t text ")))
    return T(spark, d, "events").select("event_id", S.canonical(j).alias("text"))


ORACLES["canonical_text"] = """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{"a":[1,"' || event_type || '"],"b":' || user_id || '}' ELSE 'plain ' || event_type || ' text' END AS text FROM events"""


@query
def normal_texts(spark, d):
    t = F.concat(F.lit("“A” —— "), F.col("event_type"), F.lit("!!! … x‌　 Y --- ‘z’ "))
    return T(spark, d, "events").select("event_id", S.normal_text(t).alias("text"))


ORACLES["normal_texts"] = """SELECT event_id, '"a" - ' || lower(event_type) || '! . x y - ''z''' AS text FROM events"""


@query
def quantile_cuts(spark, d):
    return stats.quantile_cuts(T(spark, d, "events"), E, "value").select("event_type", *[r(F.col("cuts")[i], f"c{i}") for i in range(5)])


ORACLES["quantile_cuts"] = "WITH t AS (SELECT event_type, quantile_cont(value, [0.5, 0.75, 0.9, 0.95, 0.99]) AS q FROM events GROUP BY 1) SELECT event_type, " + ", ".join(q(f"q[{i + 1}]", f"c{i}") for i in range(5)) + " FROM t"


@query
def weighted_centers(spark, d):
    x = T(spark, d, "lineitem").withColumn("k", F.col("l_orderkey") * 100 + F.col("l_linenumber"))
    return stats.weighted_center(x, ["l_returnflag"], "l_extendedprice", "l_quantity", "k").select("l_returnflag", r("median"), r("mad"))


def midpoint(rows: str, by: str, v: str, w: str, order: str, name: str) -> str:
    """CTEs up to name (by, x): the weighted median of a column on the midpoint CDF."""
    return f"""{name}c AS (SELECT {by}, {v} AS v, (sum({w}) OVER (PARTITION BY {by} ORDER BY {v}, {order} ROWS UNBOUNDED PRECEDING) - {w} / 2) / sum({w}) OVER (PARTITION BY {by}) AS c FROM {rows}),
{name}g AS (SELECT {by}, max(c) FILTER (c <= 0.5) AS a, arg_max(v, c) FILTER (c <= 0.5) AS va, min(c) FILTER (c >= 0.5) AS b, arg_min(v, c) FILTER (c >= 0.5) AS vb FROM {name}c GROUP BY 1),
{name} AS (SELECT {by}, CASE WHEN a IS NULL THEN vb WHEN b IS NULL THEN va WHEN b > a THEN va + (vb - va) * (0.5 - a) / (b - a) ELSE va END AS x FROM {name}g)"""


ORACLES["weighted_centers"] = f"""WITH {midpoint('lineitem', 'l_returnflag', 'l_extendedprice', 'l_quantity', 'l_orderkey * 100 + l_linenumber', 'm')},
dv AS (SELECT l.*, abs(l_extendedprice - x) AS dev FROM lineitem l JOIN m USING (l_returnflag)), {midpoint('dv', 'l_returnflag', 'dev', 'l_quantity', 'l_orderkey * 100 + l_linenumber', 's')}
SELECT l_returnflag, {q('m.x', 'median')}, {q('s.x', 'mad')} FROM m JOIN s USING (l_returnflag)"""


@query
def weighted_z(spark, d):
    x = T(spark, d, "events").withColumn("w", F.pmod("user_id", F.lit(9)) + 1.0).withColumn("ref", F.pmod("event_id", F.lit(4)) > 0)
    return stats.weighted_z(x, E, "value", "w", "event_id", "ref").select("event_id", r("z"))


ORACLES["weighted_z"] = f"""WITH e AS (SELECT event_id, event_type, value, user_id % 9 + 1.0 AS w FROM events WHERE event_id % 4 > 0), {midpoint('e', 'event_type', 'value', 'w', 'event_id', 'm')},
dv AS (SELECT e.*, abs(value - x) AS dev FROM e JOIN m USING (event_type)), {midpoint('dv', 'event_type', 'dev', 'w', 'event_id', 's')}
SELECT event_id, {q('(value - m.x) / (1.4826 * s.x + 1e-9)', 'z')} FROM events JOIN m USING (event_type) JOIN s USING (event_type)"""


@query
def reference_z(spark, d):
    """Robust z against other rows' center and scale."""
    x = stats.robust_z(T(spark, d, "events"), E, "value", F.pmod("user_id", F.lit(5)) > 0)
    return x.select("event_id", r("z"))


ORACLES["reference_z"] = f"""WITH m AS (SELECT event_type, median(value) AS m FROM events WHERE user_id % 5 > 0 GROUP BY 1), s AS (SELECT event_type, m, median(abs(value - m)) AS s FROM events JOIN m USING (event_type) WHERE user_id % 5 > 0 GROUP BY 1, 2)
SELECT event_id, {q('(value - m) / (1.4826 * s + 1e-9)', 'z')} FROM events JOIN s USING (event_type)"""


@query
def masked_quantiles(spark, d):
    x = T(spark, d, "events").withColumn("ref", (F.col("event_type") != "click") & (F.pmod("user_id", F.lit(2)) == 0))
    return stats.masked_quantile(x, E, "value", "ref", 0.9).select("event_type", r("value"))


ORACLES["masked_quantiles"] = f"SELECT event_type, {q('coalesce(quantile_cont(value, 0.9) FILTER (event_type <> ' + repr('click') + ' AND user_id % 2 = 0), quantile_cont(value, 0.9))', 'value')} FROM events GROUP BY 1"


@query
def robust_sigmas(spark, d):
    x = T(spark, d, "lineitem").withColumn("v", F.when(F.col("l_linenumber") <= 5, 0.0).otherwise(F.col("l_quantity")))
    a, b = stats.robust_sigma(x, ["l_linestatus"], "v"), stats.robust_sigma(x, ["l_linestatus"], "l_quantity")
    return a.select("l_linestatus", r("median"), r("sigma")).withColumn("kind", F.lit("zeros")).union(b.select("l_linestatus", r("median"), r("sigma")).withColumn("kind", F.lit("quantity")))


def _sigma(v: str, kind: str) -> str:
    return f"""SELECT l_linestatus, {q('m', 'median')}, {q('CASE WHEN 1.4826 * mad > 1e-12 THEN 1.4826 * mad WHEN (q[3] - q[2]) / 1.349 > 1e-12 THEN (q[3] - q[2]) / 1.349 WHEN 0.7413 * (q[4] - q[1]) > 1e-12 THEN 0.7413 * (q[4] - q[1]) END', 'sigma')}, '{kind}' AS kind
FROM (SELECT l_linestatus, any_value(m) AS m, any_value(q) AS q, median(abs(v - m)) AS mad FROM (SELECT l_linestatus, {v} AS v, median({v}) OVER (PARTITION BY l_linestatus) AS m FROM lineitem) JOIN (SELECT l_linestatus, quantile_cont({v}, [0.1, 0.25, 0.75, 0.9]) AS q FROM lineitem GROUP BY 1) USING (l_linestatus) GROUP BY 1)"""


ORACLES["robust_sigmas"] = _sigma("CASE WHEN l_linenumber <= 5 THEN 0 ELSE l_quantity END", "zeros") + " UNION ALL " + _sigma("l_quantity", "quantity")


@query
def io_sensitivity(spark, d):
    e = emb(spark, d)
    near = signals.knn(e, "vec_id", "v", 5)
    return stats.sensitivity(near, e.select("vec_id", F.slice("v", 1, 8).alias("y")), "vec_id").select("rows", F.round("sensitivity", 4).alias("sensitivity"))


ORACLES["io_sensitivity"] = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), k AS (SELECT a.vec_id, list_distance(a.v, b.v)::FLOAT AS x, list_distance(a.v[1:8], b.v[1:8]) AS y FROM e a JOIN e b ON a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY x, b.vec_id) <= 5),
g AS (SELECT vec_id, median(y) AS y, median(x::DOUBLE) AS x FROM k GROUP BY 1) SELECT count(*) AS rows, round(median(y / x), 4) AS sensitivity FROM g WHERE x > 1e-12"""


def limits(spark, d):
    t = T(spark, d, "events").groupBy("event_type").agg(F.percentile("value", F.lit(0.9)).alias("fail"), F.percentile("value", F.lit(0.99)).alias("hard"))
    return t.withColumn("hard", F.when(F.col("event_type") == "click", 0.0).otherwise(F.col("hard"))).withColumn("fail", F.when(F.col("event_type").isin("view", "click"), 0.0).otherwise(F.col("fail")))


LIMITS = "lim AS (SELECT event_type, CASE WHEN event_type IN ('view', 'click') THEN 0 ELSE quantile_cont(value, 0.9) END AS fail, CASE WHEN event_type = 'click' THEN 0 ELSE quantile_cont(value, 0.99) END AS hard FROM events GROUP BY 1)"


@query
def rule_statistics(spark, d):
    x = T(spark, d, "events").withColumn("ok", F.pmod("user_id", F.lit(7)) > 0).withColumn("v", F.when(F.col("event_type") == "error", F.floor(F.col("value") / 500) * 400.0).otherwise(F.col("value")))
    x = scoring.rule_stats(x, limits(spark, d), E, "v", "ok")
    return x.select("event_type", "n", r("center"), "flat", F.round("k_fail", 3).alias("k_fail"), r("p_fail"), r("p_hard"), r("tail_mass"), "mass_mode", r("core_mad"))


RULES = f"""{LIMITS}, rv AS (SELECT event_type, CASE WHEN event_type = 'error' THEN floor(value / 500) * 400 ELSE value END AS v FROM events WHERE user_id % 7 > 0), rm AS (SELECT event_type, median(v) AS m FROM rv GROUP BY 1),
rs AS (SELECT event_type, any_value(m) AS m, count(*) AS n, greatest(1.4826 * median(abs(v - m)), 1e-9) AS s, 1.4826 * median(abs(v - m)) <= 1e-9 AS flat FROM rv JOIN rm USING (event_type) GROUP BY 1),
rk AS (SELECT *, (fail - m) / (s + 1e-12) AS kf, greatest((hard - m) / (s + 1e-12), (fail - m) / (s + 1e-12)) AS kh, greatest(1, abs(fail), abs(fail - m), CASE WHEN hard > fail THEN hard - fail ELSE 0 END) AS span FROM rs JOIN lim USING (event_type)),
rz AS (SELECT rk.*, v, (v - m) / (s + 1e-12) AS z, flat OR abs(kf) >= 1e6 AS raw FROM rv JOIN rk USING (event_type)),
rc AS (SELECT event_type, median(z) AS cm FROM rz WHERE z < kf GROUP BY 1), rd AS (SELECT event_type, median(abs(z - cm)) AS core FROM rz JOIN rc USING (event_type) WHERE z < kf GROUP BY 1),
ra AS (SELECT event_type, any_value(n) AS n, any_value(m) AS center, any_value(flat) AS flat, any_value(kf) AS kf, any_value(raw) AS raw, avg((z >= kf)::INT) AS pf, avg((z >= kh)::INT) AS ph,
  avg(least(CASE WHEN raw THEN 6 ELSE 12 END, CASE WHEN raw THEN ln(1 + greatest(0, v - fail) / (span + 1e-12)) ELSE greatest(0, z - kf) END)) + 3 * avg(least(CASE WHEN raw THEN 6 ELSE 12 END, CASE WHEN raw THEN ln(1 + greatest(0, v - hard) / (span + 1e-12)) ELSE greatest(0, z - kh) END)) AS mass FROM rz GROUP BY 1)"""
ORACLES["rule_statistics"] = f"WITH {RULES} SELECT event_type, n, {q('center', 'center')}, flat, round(kf, 3) AS k_fail, {q('pf', 'p_fail')}, {q('ph', 'p_hard')}, {q('mass', 'tail_mass')}, CASE WHEN raw THEN 'raw_log_ratio_capped' ELSE 'z_excess_capped' END AS mass_mode, {q('core', 'core_mad')} FROM ra LEFT JOIN rd USING (event_type)"


@query
def threshold_profile(spark, d):
    x = T(spark, d, "events").withColumn("ok", F.pmod("user_id", F.lit(7)) > 0).withColumn("v", F.when(F.col("event_type") == "error", F.floor(F.col("value") / 500) * 400.0).otherwise(F.col("value")))
    x = scoring.threshold_profile(scoring.rule_stats(x, limits(spark, d), E, "v", "ok"), E)
    return x.select("event_type", *[r(c) for c in ("r_rate", "r_mass", "r_core", "q_rate", "q_mass", "q_core")], "band")


ORACLES["threshold_profile"] = f"""WITH {RULES}, p AS (SELECT event_type, least(1, pf + 8 * ph) AS a, mass / (mass + 0.5) AS b, core / (core + 0.5) AS c, pf, ph FROM ra LEFT JOIN rd USING (event_type))
SELECT event_type, {q('a', 'r_rate')}, {q('b', 'r_mass')}, {q('c', 'r_core')}, {q('5 * (1 - a)', 'q_rate')}, {q('5 * (1 - b)', 'q_mass')}, {q('5 * (1 - c)', 'q_core')}, CASE WHEN ph > 0 THEN 'exceptional' WHEN pf > 0 THEN 'tail' ELSE 'core' END AS band FROM p"""


@query
def group_risk(spark, d):
    return scoring.group_risk(z_events(spark, d), E, "z", 2.0, 3.5).select("event_type", r("risk"))


ORACLES["group_risk"] = f"WITH {Z} SELECT event_type, {q('avg((z >= 2)::INT) + 3 * avg((z >= 3.5)::INT) + 0.5 * least(12, avg(greatest(0, z - 2)) + 3 * avg(greatest(0, z - 3.5)))', 'risk')} FROM zs GROUP BY 1"


def explained(spark, d):
    z = z_events(spark, d).withColumn("state", F.when(F.col("z") >= 4, "hard_fail").when(F.col("z") >= 2, "fail").when(F.col("z") >= 1, "warn").otherwise("pass")).withColumn("kf", F.lit(2.0)).withColumn("kh", F.lit(4.0))
    return scoring.explain(z, E, "z", "state", "kf", "kh")


@query
def threshold_explainer(spark, d):
    x = explained(spark, d)
    return x.select("event_type", "n_valid", *[r(c) for c in x.columns[2:]])


EXPLAIN = f"""{Z}, ex AS (SELECT event_type, count(*) AS n_valid, avg((z >= 2)::INT) AS rf, avg((z >= 4)::INT) AS rh, avg(greatest(0, greatest(0, z) - 2)) AS ef, avg(greatest(0, greatest(0, z) - 4)) AS eh, avg((z < 1)::INT) AS sp, avg((z >= 1 AND z < 2)::INT) AS sw, avg((z >= 2 AND z < 4)::INT) AS sf, avg((z >= 4)::INT) AS sh FROM zs GROUP BY 1)"""
ORACLES["threshold_explainer"] = f"WITH {EXPLAIN} SELECT event_type, n_valid, {q('rf', 'rate_fail')}, {q('rh', 'rate_hard')}, {q('ef', 'excess_fail')}, {q('eh', 'excess_hard')}, {q('sp', 'state_pass_rate')}, {q('sw', 'state_warn_rate')}, {q('sf', 'state_fail_rate')}, {q('sh', 'state_hard_rate')} FROM ex"


@query
def score_fallbacks(spark, d):
    """Types of dense zeros, of far thresholds with states, and of neither."""
    a = scoring.axis_profile(T(spark, d, "events"), E, "value").join(limits(spark, d), "event_type").join(explained(spark, d), "event_type").withColumn("k_fail", F.when(F.col("event_type") == "error", 25.0).otherwise(2.0))
    x = scoring.fallbacks(a)
    return x.select("event_type", "fallback", r("density_score"), *[r(c) for c in ("r_rate", "r_mass", "p_fail", "p_hard")])


ORACLES["score_fallbacks"] = f"""WITH {LIMITS}, {EXPLAIN}, ev AS (SELECT event_type, value FROM events), {axis('ev', 'event_type', 'value')},
f AS (SELECT *, event_type = 'click' AS a, event_type = 'view' AS b, event_type = 'error' AS c, CASE event_type WHEN 'click' THEN 5.0 WHEN 'view' THEN 4 + 1 / (1 + ln(1 + hard)) END AS ds FROM axes JOIN lim USING (event_type) JOIN ex USING (event_type))
SELECT event_type, CASE WHEN a THEN 'hard_fail_threshold_zero_dense' WHEN b THEN 'fail_threshold_zero_dense' WHEN c THEN 'k_fail_cutoff_exceeded' ELSE 'below_cutoff' END AS fallback, {q('ds', 'density_score')}, {q('CASE WHEN a OR b THEN 1 - ds / 5 WHEN c THEN least(1, sf + 8 * sh) ELSE r_rate END', 'r_rate')},
  {q('CASE WHEN a OR b THEN 1 - ds / 5 WHEN c THEN least(1, sf + 3 * sh) ELSE r_mass END', 'r_mass')}, {q('CASE WHEN a OR b THEN 1 - ds / 5 WHEN c THEN sf ELSE p_fail END', 'p_fail')}, {q('CASE WHEN a OR b THEN 0 WHEN c THEN sh ELSE p_hard END', 'p_hard')} FROM f"""
SIGNALS = {"output": "value", "diff_residual": "sqrt(value)", "delta_ridge_ens": "value % 50", "discourse_instability": "(event_id % 89)::DOUBLE", "contradiction": "CASE WHEN event_id % 10 = 0 THEN 1.0 ELSE 0.0 END"}


def bundled(spark, d):
    e = T(spark, d, "events").withColumn("gate", F.pmod("user_id", F.lit(7)) > 0).withColumn("failed", F.pmod("event_id", F.lit(20)) == 0)
    e = e.withColumns({"s_out": F.col("value"), "s_res": F.sqrt("value"), "s_ridge": F.col("value") % 50, "s_dis": F.pmod("event_id", F.lit(89)).cast("double"), "s_con": F.when(F.pmod("event_id", F.lit(10)) == 0, 1.0).otherwise(0.0)})
    rules = dict(zip(SIGNALS, ("s_out", "s_res", "s_ridge", "s_dis", "s_con"), strict=True))
    return scoring.bundle_scores(e, E, rules, "gate", failed="failed")


BUNDLES = f"""ev AS (SELECT event_id, event_type, """ + ", ".join(f"{v} AS {k}" for k, v in SIGNALS.items()) + f""" FROM events WHERE user_id % 7 > 0),
lg AS (""" + " UNION ALL ".join(f"SELECT event_type, '{k}' AS rule, {k}::DOUBLE AS signal FROM ev" for k in SIGNALS) + f"""), {axis('lg', 'event_type, rule', 'signal')},
cv AS (SELECT event_type, 5 * avg((user_id % 7 > 0)::INT) AS cov FROM events GROUP BY 1), dt AS (SELECT event_type, avg((event_id % 20 = 0)::INT) AS df FROM ev GROUP BY 1),
sq AS (SELECT event_type, avg(1 - r_core) AS qc, avg(1 - r_rate) AS qr, avg(1 - r_mass) AS qm FROM axes WHERE rule IN ('discourse_instability', 'contradiction') GROUP BY 1),
sz AS (SELECT event_type, avg((abs(discourse_instability) <= 1e-12)::INT) >= 0.9 AND avg((abs(contradiction) <= 1e-12)::INT) >= 0.9 AS e FROM ev GROUP BY 1),
bu AS (SELECT event_type, 'COV' AS bundle, cov AS raw FROM cv UNION ALL SELECT event_type, 'CONF', cov FROM cv
  UNION ALL SELECT event_type, 'OUT', 5 * (1 - least(1, risk + 0.35 * df)) FROM axes JOIN dt USING (event_type) WHERE rule = 'output' UNION ALL SELECT event_type, 'RID', 5 * (1 - risk) FROM axes WHERE rule = 'diff_residual'
  UNION ALL SELECT event_type, 'SEM', CASE WHEN NOT e THEN 5 * (1 - 0.15 * (1 - qc)) * (1 - 0.55 * (1 - qr)) * (1 - 0.30 * (1 - qm)) END FROM sq JOIN sz USING (event_type))"""


@query
def bundle_scores(spark, d):
    return bundled(spark, d).where("bundle <> 'DIAG'").select("event_type", "bundle", r("raw"), "score")


ORACLES["bundle_scores"] = f"WITH {BUNDLES} SELECT event_type, bundle, {q('raw', 'raw')}, least(5, greatest(0, round_even(raw, 0)))::INT AS score FROM bu"


@query
def bundle_slices(spark, d):
    return scoring.bundle_slice(bundled(spark, d), "RID").select("event_type", "bundle", r("raw"))


ORACLES["bundle_slices"] = f"WITH {BUNDLES} SELECT event_type, bundle, {q('raw', 'raw')} FROM bu WHERE bundle = 'RID'"


@query
def bundle_interpretation(spark, d):
    details = T(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("value"))
    details = details.withColumn("bundle", F.explode(F.array(F.lit("OUT"), F.lit("SEM")))).withColumn("submetric", F.lit("mean"))
    x = scoring.interpretation(bundled(spark, d), details, ["event_type"])
    return x.select("event_type", "bundle", "submetric", r("value"), r("raw"), "band")


ORACLES["bundle_interpretation"] = f"WITH {BUNDLES}, d AS (SELECT event_type, avg(value) AS v FROM events GROUP BY 1) SELECT event_type, bundle, 'mean' AS submetric, {q('v', 'value')}, {q('raw', 'raw')}, CASE WHEN raw IS NULL THEN 'not available' WHEN raw >= 4 THEN 'stable' WHEN raw >= 2.5 THEN 'watch' ELSE 'act' END AS band FROM d JOIN bu USING (event_type) WHERE bundle IN ('OUT', 'SEM')"


@query
def input_distances(spark, d):
    x = T(spark, d, "events").withColumn("px", F.when(F.pmod("event_id", F.lit(3)) > 0, F.col("value"))).withColumn("py", F.col("user_id").cast("double"))
    return scoring.input_distance(x, "px", "py", "props").select("event_id", r("input_distance"))


ORACLES["input_distances"] = f"SELECT event_id, {q('CASE WHEN event_id % 3 > 0 THEN sqrt(value * value + user_id * user_id) ELSE length(props) END', 'input_distance')} FROM events"


@query
def inverse_risks(spark, d):
    return scoring.inverse_risk(T(spark, d, "events"), E, "value").select("event_id", r("risk"))


ORACLES["inverse_risks"] = f"""WITH x AS (SELECT event_id, event_type, ln(1 + greatest(0, value)) AS x FROM events), m AS (SELECT event_type, median(x) AS m FROM x GROUP BY 1), s AS (SELECT event_type, m, 1.4826 * median(abs(x - m)) AS s FROM x JOIN m USING (event_type) GROUP BY 1, 2),
z AS (SELECT event_id, event_type, greatest(0, (x - m) / (s + 1e-12)) AS z FROM x JOIN s USING (event_type)), c AS (SELECT event_type, quantile_cont(z, 0.95) AS c FROM z GROUP BY 1)
SELECT event_id, {q('least(1, least(z, c) / (c + 1e-12))', 'risk')} FROM z JOIN c USING (event_type)"""
