"""Queries of threshold policies on all tails, and of calibration by cross-validation and its application."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatelens.functions import specs
from gatelens.operators import calibration, stats, thresholds, windows
from gatelens.plans.catalog import T, labelled, query, r, z_events
from gatelens.plans.oracles import LABELLED, LADDER_OUT, ORACLES, Z, ladder
from gatelens.plans.oracles import r as q

E = ["event_type"]


@query
def quantile_specs(spark, d):
    rows = [("range", x) for x in specs.quantile_range("0.90~0.95(step 0.01)")] + [("list", x) for x in specs.quantile_list("0.5, 0.99 ,0.5")]
    return spark.createDataFrame(rows, "kind string, quantile double")


ORACLES["quantile_specs"] = "SELECT 'range' AS kind, round(0.90 + i * 0.01, 6)::DOUBLE AS quantile FROM range(6) t(i) UNION ALL SELECT 'list', unnest([0.5, 0.99])::DOUBLE"


@query
def rule_specs(spark, d):
    fail = specs.rule_quantiles(specs.RULES, '{"length": 0.9}')
    warn = specs.warn_quantiles(fail, specs.RULES, '{"delta-ridge": 0.97}')
    rules = specs.rule_list("length, Delta-Ridge,self contradiction, output,length")
    return spark.createDataFrame([(i, k, fail[k], warn[k]) for i, k in enumerate(rules)] + [(9, k, fail[k], warn[k]) for k in specs.rule_list("", ["diff_resid"])], "place int, rule string, fail_quantile double, warn_quantile double")


ORACLES["rule_specs"] = "SELECT * FROM (VALUES (0, 'length', 0.9::DOUBLE, 0.89::DOUBLE), (1, 'delta_ridge_ens', 0.99, 0.97), (2, 'self_contradiction', 0.95, 0.94), (3, 'output', 0.99, 0.95), (9, 'diff_resid', 0.99, 0.95)) t(place, rule, fail_quantile, warn_quantile)"


def tails(spark, d, policy, direction, **kw):
    return thresholds.choose(T(spark, d, "events"), E, "value", "event_id", policy, direction, **kw).select("event_type", r("threshold"), r("low"), r("high"), "policy")


@query
def policy_quantile_lower(spark, d):
    return tails(spark, d, "quantile_tail", "lower", q=0.05)


ORACLES["policy_quantile_lower"] = f"SELECT event_type, {q('quantile_cont(value, 0.05)', 'threshold')}, {q('quantile_cont(value, 0.05)', 'low')}, NULL::DOUBLE AS high, 'quantile_tail' AS policy FROM events GROUP BY 1"


@query
def policy_quantile_two_sided(spark, d):
    return tails(spark, d, "quantile_tail", "two_sided", q=0.05)


TWO = "md AS (SELECT event_type, median(value) AS mid FROM events GROUP BY 1), ab AS (SELECT event_type, event_id, mid, abs(value - mid) AS v FROM events JOIN md USING (event_type))"
ORACLES["policy_quantile_two_sided"] = f"WITH {TWO}, t AS (SELECT event_type, any_value(mid) AS mid, quantile_cont(v, 0.95) AS t FROM ab GROUP BY 1) SELECT event_type, {q('mid + t', 'threshold')}, {q('mid - t', 'low')}, {q('mid + t', 'high')}, 'quantile_tail' AS policy FROM t"


@query
def policy_robust_z_two_sided(spark, d):
    return tails(spark, d, "robust_z", "two_sided")


ORACLES["policy_robust_z_two_sided"] = f"WITH {TWO}, lad AS ({ladder('ab', 'event_type', 'v')} SELECT event_type, q[3] + 3.5 * ({LADDER_OUT}) AS t FROM l) SELECT event_type, {q('mid + t', 'threshold')}, {q('mid - t', 'low')}, {q('mid + t', 'high')}, 'robust_z' AS policy FROM lad JOIN md USING (event_type)"


@query
def policy_unknown(spark, d):
    return tails(spark, d, "no such policy", "upper")


ORACLES["policy_unknown"] = f"SELECT event_type, {q('quantile_cont(value, 0.995)', 'threshold')}, NULL::DOUBLE AS low, {q('quantile_cont(value, 0.995)', 'high')}, 'quantile_fallback' AS policy FROM events GROUP BY 1"


@query
def policy_output_uncapped(spark, d):
    """The rule named output has no largest k: its start may lie further out than that of other rules."""
    e = T(spark, d, "events")
    a = thresholds.choose(e, E, "value", "event_id", "robust_z_tail_start", rule="output").select("event_type", F.col("threshold").alias("a"))
    b = thresholds.choose(e, E, "value", "event_id", "robust_z_tail_start").select("event_type", F.col("threshold").alias("b"))
    return a.join(b, "event_type").select("event_type", (F.col("a") >= F.col("b")).alias("at_least"))


ORACLES["policy_output_uncapped"] = "SELECT DISTINCT event_type, true AS at_least FROM events"


@query
def policy_stability_jump(spark, d):
    e = T(spark, d, "events").withColumn("f1", F.pmod("user_id", F.lit(17)).cast("double")).withColumn("f2", F.sqrt("value"))
    return thresholds.choose(e, E, "value", "event_id", "dist_stability_jump", features=["f1", "f2"]).select("event_type", r("threshold"), "policy")


JUMP = """js AS (SELECT event_type, value, (user_id % 17)::DOUBLE AS f1, sqrt(value) AS f2 FROM events), jq AS (SELECT event_type, quantile_cont(value, [""" + ", ".join(str(1 - i / 100) for i in range(1, 31)) + """]) AS qs FROM js GROUP BY 1), jc AS (SELECT event_type, i, qs[i] AS cut FROM jq, range(1, 31) t(i)),
jv AS (SELECT c.event_type, i, cut, var_pop(f1) AS v1, var_pop(f2) AS v2 FROM jc c JOIN js s ON s.event_type = c.event_type AND value >= cut GROUP BY 1, 2, 3),
jm AS (SELECT *, (coalesce(CASE WHEN max(v1) OVER w > min(v1) OVER w THEN (v1 - min(v1) OVER w) / (max(v1) OVER w - min(v1) OVER w) ELSE 0.5 END, 1) + coalesce(CASE WHEN max(v2) OVER w > min(v2) OVER w THEN (v2 - min(v2) OVER w) / (max(v2) OVER w - min(v2) OVER w) ELSE 0.5 END, 1)) / 2 AS x FROM jv WINDOW w AS (PARTITION BY event_type)),
ja AS (SELECT *, avg(x) OVER (PARTITION BY event_type ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM jm), jd AS (SELECT *, round(coalesce(s - lag(s) OVER (PARTITION BY event_type ORDER BY i), 0), 9) AS dd FROM ja),
jb AS (SELECT event_type, min(i) AS pos FROM jd WHERE dd = (SELECT max(dd) FROM jd k WHERE k.event_type = jd.event_type) GROUP BY 1)"""
ORACLES["policy_stability_jump"] = f"WITH {JUMP} SELECT jd.event_type, {q('cut', 'threshold')}, 'dist_stability_jump' AS policy FROM jd JOIN jb ON jb.event_type = jd.event_type AND i = greatest(1, pos - 1)"
ORACLES["stability_jump"] = f"WITH {JUMP} SELECT jd.event_type, i / 100 AS share, {q('cut', 'threshold')} FROM jd JOIN jb ON jb.event_type = jd.event_type AND i = greatest(1, pos - 1)"


def core_sql(rows: str, fail: str) -> str:
    """CTEs up to core (event_type, t, med, s, core): rows (event_type, v), fail (event_type, t)."""
    return f"""cx AS (SELECT event_type, v, t FROM {rows} JOIN {fail} USING (event_type) WHERE v <= t), cm AS (SELECT event_type, t, count(*) AS n, median(v) AS med, quantile_cont(v, 0.85) AS q FROM cx GROUP BY 1, 2),
cd AS (SELECT event_type, any_value(cm.t) AS t, any_value(n) AS n, any_value(med) AS med, any_value(q) AS q, 1.4826 * median(abs(v - med)) AS s FROM cx JOIN cm USING (event_type) GROUP BY 1),
core AS (SELECT event_type, t, med, s, least(CASE WHEN n >= 12 AND s > 1e-9 THEN med + s ELSE q END, t) AS core FROM cd)"""


@query
def tri_thresholds_lower(spark, d):
    """Warnings and failures of the lower tail; hard failures lie beyond them."""
    e = T(spark, d, "events")
    x = thresholds.tri_thresholds(e, E, "value", thresholds.choose(e, E, "value", "event_id", "quantile_tail", "lower", q=0.1), "lower")
    return x.select("event_type", r("warn"), r("warn_low"), r("warn_high"), r("fail"), (F.col("hard") <= F.col("fail")).alias("ordered"))


ORACLES["tri_thresholds_lower"] = f"""WITH lv AS (SELECT event_type, -value AS v FROM events), lf AS (SELECT event_type, quantile_cont(v, 0.9) AS t FROM lv GROUP BY 1), {core_sql('lv', 'lf')}
SELECT event_type, {q('-core', 'warn')}, {q('-least(med + s, t)', 'warn_low')}, {q('-(med - s)', 'warn_high')}, {q('-t', 'fail')}, true AS ordered FROM core"""


@query
def tri_thresholds_two_sided(spark, d):
    e = T(spark, d, "events")
    x = thresholds.tri_thresholds(e, E, "value", thresholds.choose(e, E, "value", "event_id", "quantile_tail", "two_sided", q=0.1), "two_sided")
    return x.select("event_type", r("warn"), r("warn_low"), r("fail"), r("fail_low"), ((F.col("hard") >= F.col("fail")) & (F.col("hard_low") <= F.col("fail_low"))).alias("ordered"))


ORACLES["tri_thresholds_two_sided"] = f"""WITH {TWO}, tf AS (SELECT event_type, quantile_cont(v, 0.9) AS t FROM ab GROUP BY 1), {core_sql('ab', 'tf')}
SELECT event_type, {q('mid + core', 'warn')}, {q('mid - core', 'warn_low')}, {q('mid + t', 'fail')}, {q('mid - t', 'fail_low')}, true AS ordered FROM core JOIN md USING (event_type)"""


@query
def ratio_tristate(spark, d):
    e = T(spark, d, "events")
    x = thresholds.ratio_tristate(e, E, "value", thresholds.quantile_tail_policy(e, E, "value", 0.1))
    return x.select("event_type", r("warn"), r("fail"), r("hard"))


ORACLES["ratio_tristate"] = f"WITH t AS (SELECT event_type, median(value) AS m, quantile_cont(value, 0.9) AS f FROM events GROUP BY 1) SELECT event_type, {q('m + 0.8 * (f - m)', 'warn')}, {q('f', 'fail')}, {q('m + 1.2 * (f - m)', 'hard')} FROM t"


@query
def k_thresholds(spark, d):
    x = thresholds.k_thresholds(stats.scale_ladder(T(spark, d, "events"), E, "value"), E)
    return x.select("event_type", r("warn"), r("fail"), r("hard"))


ORACLES["k_thresholds"] = f"WITH lad AS ({ladder('events', 'event_type', 'value')} SELECT event_type, q[3] AS m, {LADDER_OUT} AS s FROM l) SELECT event_type, {q('m + 2.8 * s', 'warn')}, {q('m + 3.5 * s', 'fail')}, {q('m + 8 * s', 'hard')} FROM lad"


@query
def strong_gap(spark, d):
    return windows.strong_gap(z_events(spark, d), E, "z", "event_id").select("event_type", r("jump"), r("gap_z"))


def _gaps_flat() -> str:
    from gatelens.plans.oracles import gaps

    return gaps("zs", "z", "event_id").replace("least(0.95, greatest(0.30, mass + 0.05)) AS hi", "0.30 AS hi").replace("wg >= 2.5", "false")


ORACLES["strong_gap"] = f"WITH {Z}, {_gaps_flat()} SELECT event_type, {q('jump', 'jump')}, {q('gap_z', 'gap_z')} FROM jumps"


@query
def tail_split(spark, d):
    z = z_events(spark, d)
    starts = z.groupBy("event_type").agg(F.percentile("z", F.lit(0.9)).alias("k"))
    return windows.tail_split(z, E, "z", "event_id", starts).select("event_type", r("k"), r("gap_z"))


ORACLES["tail_split"] = f"""WITH {Z}, k AS (SELECT event_type, quantile_cont(z, 0.9) AS k FROM zs GROUP BY 1),
t AS (SELECT event_type, z, k, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER o AS i, lead(z) OVER o AS nx FROM zs JOIN k USING (event_type) WHERE z >= 0 AND z >= k WINDOW o AS (PARTITION BY event_type ORDER BY z, event_id)),
g AS (SELECT *, nx - z AS gap FROM t WHERE n >= 40 AND nx > z), m AS (SELECT event_type, count(*) AS c, median(gap) AS m, quantile_cont(gap, [0.1, 0.25, 0.75, 0.9]) AS q FROM g GROUP BY 1),
s AS (SELECT event_type, any_value(m) AS m, any_value(q) AS q, any_value(c) AS c, 1.4826 * median(abs(gap - m)) AS mad FROM g JOIN m USING (event_type) GROUP BY 1),
z2 AS (SELECT g.*, (gap - m) / CASE WHEN mad > 1e-12 THEN mad WHEN (q[3] - q[2]) / 1.349 > 1e-12 THEN (q[3] - q[2]) / 1.349 ELSE 0.7413 * (q[4] - q[1]) END AS gz FROM g JOIN s USING (event_type) WHERE c >= 5),
r AS (SELECT event_type, arg_min(nx, i) FILTER (gz >= 4 AND nx - k >= 0.5 AND n - i >= 8) AS k, arg_min(gz, i) FILTER (gz >= 4 AND nx - k >= 0.5 AND n - i >= 8) AS a, max(gz) AS b FROM z2 GROUP BY 1)
SELECT event_type, {q('k', 'k')}, {q('coalesce(a, b)', 'gap_z')} FROM r"""


# calibration ----------------------------------------------------------------------------------------------------------
GRID = {"size": [0.5, 0.8, 0.9], "marks": [0.7, 0.95]}


def calibrated(spark, d):
    x = labelled(spark, d).where("bad is not null").withColumn("size", F.col("n_chars").cast("double")).withColumn("marks", F.pmod(F.col("doc_id") * 7919, F.lit(1009)).cast("double"))
    return windows.folds(x, "bad", "doc_id", 3).select("doc_id", "lang", "bad", "fold", "size", "marks")


CAL = f"{LABELLED}, cal AS (SELECT doc_id, lang, bad, n_chars::DOUBLE AS size, (doc_id * 7919 % 1009)::DOUBLE AS marks, (row_number() OVER (PARTITION BY bad ORDER BY md5(doc_id::VARCHAR), doc_id) - 1) % 3 AS fold FROM lab WHERE bad IS NOT NULL)"


def own_or_all(value: str, qs: str, name: str) -> str:
    """CTEs: thresholds of a column by held-out fold and group, and of all groups; then name (doc_id, fold, t)."""
    return f"""{name}g AS (SELECT h.fold, c.lang, quantile_cont({value}, {qs}) AS t FROM cal c JOIN (SELECT DISTINCT fold FROM cal) h ON c.fold <> h.fold GROUP BY 1, 2),
{name}a AS (SELECT h.fold, quantile_cont({value}, {qs}) AS t FROM cal c JOIN (SELECT DISTINCT fold FROM cal) h ON c.fold <> h.fold GROUP BY 1),
{name} AS (SELECT c.doc_id, c.fold, coalesce(g.t, a.t) AS t FROM cal c LEFT JOIN {name}g g ON g.fold = c.fold AND g.lang IS NOT DISTINCT FROM c.lang JOIN {name}a a ON a.fold = c.fold)"""


def confusion_means(rows: str, by: str) -> str:
    """CTEs up to means (by, p, r, f, fp): of rows (by, fold, bad, hit)."""
    return f"""cc AS (SELECT {by}, fold, count(*) FILTER (bad AND hit) AS tp, count(*) FILTER (NOT bad AND hit) AS fp, count(*) FILTER (bad AND NOT hit) AS fn FROM {rows} GROUP BY ALL),
cp AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM cc),
means AS (SELECT {by}, avg(p) AS p, avg(r) AS r, avg(coalesce(2 * p * r / nullif(p + r, 0), 0)) AS f, avg(fp) AS fp FROM cp GROUP BY ALL)"""


@query
def calibrate_distance(spark, d):
    x = calibration.fit_distance(calibrated(spark, d), "lang", "bad", "fold", GRID, 0.3)
    return x.select("q_size", "q_marks", r("mean_precision"), r("mean_recall"), r("mean_f1"), r("mean_fp"), "met", "chosen")


ORACLES["calibrate_distance"] = f"""WITH {CAL}, {own_or_all('size', '[0.5, 0.8, 0.9]', 'ta')}, {own_or_all('marks', '[0.7, 0.95]', 'tb')},
cand AS (SELECT a.i AS i, b.j AS j FROM range(1, 4) a(i), range(1, 3) b(j)),
h AS (SELECT i, j, cal.fold, bad, size > ta.t[i] OR marks > tb.t[j] AS hit FROM cal JOIN ta USING (doc_id) JOIN tb USING (doc_id), cand), {confusion_means('h', 'i, j')},
k AS (SELECT *, row_number() OVER (ORDER BY (p >= 0.3) DESC, round(f, 9) DESC, round(fp, 9), round(r, 9) DESC, round(p, 9) DESC, i, j) AS k, bool_or(p >= 0.3) OVER () AS met FROM means)
SELECT [0.5, 0.8, 0.9][i]::DOUBLE AS q_size, [0.7, 0.95][j]::DOUBLE AS q_marks, {q('p', 'mean_precision')}, {q('r', 'mean_recall')}, {q('f', 'mean_f1')}, {q('fp', 'mean_fp')}, met, k = 1 AS chosen FROM k"""
CHOSEN = {"size": 0.9, "marks": 0.95}


@query
def calibrated_thresholds(spark, d):
    return calibration.distance_thresholds(calibrated(spark, d), "lang", CHOSEN).select("lang", "is_global", "rule", r("threshold"))


THS = "th AS (" + " UNION ALL ".join(f"SELECT lang, false AS is_global, '{k}' AS rule, quantile_cont({k}, {v}) AS threshold FROM cal GROUP BY 1 UNION ALL SELECT NULL, true, '{k}', quantile_cont({k}, {v}) FROM cal" for k, v in CHOSEN.items()) + ")"
ORACLES["calibrated_thresholds"] = f"WITH {CAL}, {THS} SELECT lang, is_global, rule, {q('threshold', 'threshold')} FROM th"


@query
def calibrated_rows(spark, d):
    x = calibrated(spark, d).withColumn("gate", F.pmod("doc_id", F.lit(9)) != 0)
    return calibration.apply_distance(x, "lang", CHOSEN, "gate").select("doc_id", F.array_join("flagged_by", "|").alias("flagged_by"), "distribution_pass", "final_pass")


GATED = CAL.replace("cal AS (", "call AS (") + f""", calg AS (SELECT *, doc_id % 9 <> 0 AS gate FROM call), cal AS (SELECT * FROM calg WHERE gate), {THS},
fl AS (SELECT c.*, size > coalesce(a.threshold, x.threshold) AS s, marks > coalesce(b.threshold, y.threshold) AS m FROM calg c LEFT JOIN th a ON a.lang IS NOT DISTINCT FROM c.lang AND a.rule = 'size' AND NOT a.is_global
  LEFT JOIN th b ON b.lang IS NOT DISTINCT FROM c.lang AND b.rule = 'marks' AND NOT b.is_global JOIN th x ON x.is_global AND x.rule = 'size' JOIN th y ON y.is_global AND y.rule = 'marks')"""
ORACLES["calibrated_rows"] = f"WITH {GATED} SELECT doc_id, concat_ws('|', CASE WHEN s THEN 'size' END, CASE WHEN m THEN 'marks' END) AS flagged_by, NOT gate OR NOT (s OR m) AS distribution_pass, gate AND NOT (s OR m) AS final_pass FROM fl"


@query
def calibrated_summary(spark, d):
    x = calibration.apply_distance(calibrated(spark, d).withColumn("gate", F.pmod("doc_id", F.lit(9)) != 0), "lang", CHOSEN, "gate")
    return calibration.calibrated_summary(x, "lang", "gate").select("lang", "n", r("gate_rate"), r("flag_rate"), r("final_rate"))


ORACLES["calibrated_summary"] = f"WITH {GATED} SELECT lang, count(*) AS n, {q('avg(gate::INT)', 'gate_rate')}, {q('avg((s OR m)::INT) FILTER (gate)', 'flag_rate')}, {q('avg((gate AND NOT (s OR m))::INT)', 'final_rate')} FROM fl GROUP BY 1"


@query
def calibrate_tristate(spark, d):
    x = calibration.fit_tristate(calibrated(spark, d), "lang", "size", "bad", "fold", [0.6, 0.8], [0.7, 0.9], 0.3)
    return x.select("q_warn", "q_fail", *[r(c) for c in ("mean_fail_precision", "mean_fail_recall", "mean_fail_f1", "mean_fail_fp", "mean_warn_lift", "mean_warn_coverage")], "met", "chosen")


ORACLES["calibrate_tristate"] = f"""WITH {CAL}, {own_or_all('size', '[0.6, 0.7, 0.8, 0.9]', 'ta')}, cand AS (SELECT * FROM (VALUES (1, 2), (1, 4), (3, 4)) t(w, f)),
s AS (SELECT w, f, cal.fold, bad, size > t[f] AS hit, size > t[w] AND NOT size > t[f] AS warned FROM cal JOIN ta USING (doc_id), cand), {confusion_means('s', 'w, f')},
l AS (SELECT w, f, fold, coalesce(avg(bad::INT) FILTER (warned), 0) - coalesce(avg(bad::INT) FILTER (NOT warned AND NOT hit), 0) AS lift, avg(warned::INT) AS cover FROM s GROUP BY 1, 2, 3), lm AS (SELECT w, f AS ff, avg(lift) AS lift, avg(cover) AS cover FROM l GROUP BY 1, 2),
m AS (SELECT * FROM (SELECT w, f AS ff, p, r, fp, f_ FROM (SELECT w, f, p, r, fp, f1 AS f_ FROM (SELECT cp.w, cp.f, avg(p) AS p, avg(r) AS r, avg(fp) AS fp, avg(coalesce(2 * p * r / nullif(p + r, 0), 0)) AS f1 FROM cp GROUP BY 1, 2))) JOIN lm USING (w, ff)),
k AS (SELECT *, row_number() OVER (ORDER BY (p >= 0.3) DESC, round(f_, 9) DESC, round(lift, 9) DESC, round(fp, 9), round(r, 9) DESC, w, ff) AS k, bool_or(p >= 0.3) OVER () AS met FROM m)
SELECT [0.6, 0.7, 0.8, 0.9][w]::DOUBLE AS q_warn, [0.6, 0.7, 0.8, 0.9][ff]::DOUBLE AS q_fail, {q('p', 'mean_fail_precision')}, {q('r', 'mean_fail_recall')}, {q('f_', 'mean_fail_f1')}, {q('fp', 'mean_fail_fp')}, {q('lift', 'mean_warn_lift')}, {q('cover', 'mean_warn_coverage')}, met, k = 1 AS chosen FROM k"""


@query
def tristate_states(spark, d):
    a = F.pmod("user_id", F.lit(11)) != 0
    x = calibration.apply_tristate(T(spark, d, "events"), "event_type", "value", 0.99, 0.95, a, semantic=True)
    return x.groupBy("event_type", "state").agg(F.count("*").alias("n"))


ORACLES["tristate_states"] = "WITH t AS (SELECT event_type, quantile_cont(value, 0.94) AS w, quantile_cont(value, 0.95) AS f FROM events WHERE user_id % 11 <> 0 GROUP BY 1) SELECT event_type, CASE WHEN user_id % 11 = 0 THEN 'warn' WHEN value > f THEN 'fail' WHEN value > w THEN 'warn' ELSE 'pass' END AS state, count(*) AS n FROM events JOIN t USING (event_type) GROUP BY 1, 2"


@query
def refined_reference(spark, d):
    e = T(spark, d, "events").withColumn("ref", F.pmod("event_id", F.lit(3)) > 0).withColumn("w", F.pmod("event_id", F.lit(997)).cast("double"))
    x = calibration.refine_reference(e, E, ["value", "w"], 0.9, "ref")
    return x.groupBy("event_type").agg(F.count_if("ref").alias("kept"), F.count("*").alias("n"))


ORACLES["refined_reference"] = """WITH e AS (SELECT event_type, value, event_id % 997 AS w, event_id % 3 > 0 AS ref FROM events), t1 AS (SELECT event_type, quantile_cont(value, 0.9) AS a, quantile_cont(w::DOUBLE, 0.9) AS b FROM e WHERE ref GROUP BY 1),
r1 AS (SELECT e.*, ref AND value <= a AND w <= b AS r FROM e JOIN t1 USING (event_type)), t2 AS (SELECT event_type, quantile_cont(value, 0.9) AS a, quantile_cont(w::DOUBLE, 0.9) AS b FROM r1 WHERE r GROUP BY 1)
SELECT event_type, count(*) FILTER (r AND value <= a AND w <= b) AS kept, count(*) AS n FROM r1 JOIN t2 USING (event_type) GROUP BY 1"""


@query
def lambda_stability(spark, d):
    x = T(spark, d, "events").select(F.pmod("user_id", F.lit(7)).alias("dataset"), (F.pmod("event_id", F.lit(4)) * 0.1).alias("lambda"), "value").groupBy("dataset", "lambda").agg(F.round(F.avg("value") / 100, 3).alias("f1"))
    x = calibration.lambda_stability(x)
    return x.select(r("lambda"), "n", *[r(c) for c in ("mean", "median", "std", "least", "p10")], "wins", "ties", "losses", "rank")


ORACLES["lambda_stability"] = f"""WITH x AS (SELECT user_id % 7 AS dataset, (event_id % 4) * 0.1::DOUBLE AS l, round(avg(value) / 100, 3) AS f1 FROM events GROUP BY 1, 2), g AS (SELECT x.l, x.f1 - b.f1 AS d FROM x JOIN x b ON b.dataset = x.dataset AND b.l = 0 WHERE x.l > 0),
s AS (SELECT l, count(*) AS n, avg(d) AS a, median(d) AS b, stddev_pop(d) AS c, min(d) AS e, quantile_cont(d, 0.1) AS f, count(*) FILTER (d > 1e-9) AS wins, count(*) FILTER (abs(d) <= 1e-9) AS ties, count(*) FILTER (d < -1e-9) AS losses FROM g GROUP BY 1)
SELECT {q('l', 'lambda')}, n, {q('a', 'mean')}, {q('b', 'median')}, {q('c', 'std')}, {q('e', 'least')}, {q('f', 'p10')}, wins, ties, losses, (row_number() OVER (ORDER BY losses, round(e, 9) DESC, round(c, 9), round(a, 9) DESC, l))::INT AS rank FROM s"""


@query
def variant_metrics(spark, d):
    return calibration.variant_metrics(labelled(spark, d), ["lang"], "bad", "pred").select("lang", "metric", r("value"))


ORACLES["variant_metrics"] = f"""WITH {LABELLED}, c AS (SELECT lang, count(*) FILTER (bad AND pred) AS tp, count(*) FILTER (NOT bad AND pred) AS fp, count(*) FILTER (NOT bad AND NOT pred) AS tn, count(*) FILTER (bad AND NOT pred) AS fn FROM lab WHERE bad IS NOT NULL GROUP BY 1),
p AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM c), m AS (SELECT lang, unnest([{{'metric': 'precision', 'v': p}}, {{'metric': 'recall', 'v': r}}, {{'metric': 'f1', 'v': coalesce(2 * p * r / nullif(p + r, 0), 0)}}, {{'metric': 'fpr', 'v': coalesce(fp / nullif(fp + tn, 0), 0)}}, {{'metric': 'bad_rate', 'v': (tp + fp) / (tp + fp + tn + fn)}}]) AS m FROM p)
SELECT lang, m.metric AS metric, {q('m.v', 'value')} FROM m"""


@query
def targets_by_dataset(spark, d):
    """The targets of each mock dataset and rule, long."""
    z = z_events(spark, d).withColumn("state", F.when(F.col("z") >= 4, "hard_fail").when(F.col("z") >= 2, "fail").when(F.col("z") >= 1, "warn").otherwise("pass")).withColumn("bad", F.pmod("user_id", F.lit(3)) == 0).withColumn("dataset", F.pmod("user_id", F.lit(20)))
    return thresholds.targets_met(z, ["dataset", "event_type"], "bad").select("dataset", "event_type", r("hard_precision"), r("fail_precision"), r("warn_good"), "met")


ORACLES["targets_by_dataset"] = f"""WITH {Z}, s AS (SELECT user_id % 20 AS dataset, event_type, CASE WHEN z >= 4 THEN 'hard_fail' WHEN z >= 2 THEN 'fail' WHEN z >= 1 THEN 'warn' ELSE 'pass' END AS s, user_id % 3 = 0 AS y FROM zs),
g AS (SELECT dataset, event_type, count(*) FILTER (s = 'hard_fail' AND y) / nullif(count(*) FILTER (s = 'hard_fail'), 0) AS h, count(*) FILTER (s IN ('fail', 'hard_fail') AND y) / nullif(count(*) FILTER (s IN ('fail', 'hard_fail')), 0) AS f, count(*) FILTER (s = 'warn' AND NOT y) / nullif(count(*) FILTER (s = 'warn'), 0) AS w FROM s GROUP BY 1, 2)
SELECT dataset, event_type, {q('h', 'hard_precision')}, {q('f', 'fail_precision')}, {q('w', 'warn_good')}, coalesce(h >= 1, true) AND coalesce(f >= 0.88, true) AND coalesce(w < 0.3, true) AS met FROM g"""
