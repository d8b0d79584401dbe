"""DuckDB SQL for the queries of the catalogue, written from the operators' definitions."""

from __future__ import annotations


def r(x: str, name: str, digits: int = 6) -> str:
    return f"round(({x})::DOUBLE, {digits}) + 0.0 AS {name}"


Z = """zs AS (
  WITH m AS (SELECT event_type, median(value) AS med FROM events GROUP BY 1),
       s AS (SELECT event_type, med, median(abs(value - med)) AS mad FROM events JOIN m USING (event_type) GROUP BY 1, 2)
  SELECT e.event_id, e.user_id, e.event_type, e.value, e.ts, (e.value - s.med) / (1.4826 * s.mad + 1e-9) AS z FROM events e JOIN s USING (event_type))"""
STATE = "CASE WHEN z >= 2 AND z >= 4 THEN 'hard_fail' WHEN z >= 2 THEN 'fail' WHEN z >= 1 THEN 'warn' ELSE 'pass' END"
LABELLED = "lab AS (SELECT d.doc_id, d.lang, d.n_chars, l.quality = 0 AS bad, coalesce(l.toxic = 1, false) AS pred FROM documents d LEFT JOIN labels l USING (doc_id))"


def confusion(by: str = "") -> str:
    g, h = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""WITH {LABELLED}, c AS (
  SELECT {g}count(*) FILTER (bad AND pred) AS tp, count(*) FILTER (NOT bad AND pred) AS fp, count(*) FILTER (NOT bad AND NOT pred) AS tn, count(*) FILTER (bad AND NOT pred) AS fn FROM lab WHERE bad IS NOT NULL {h}),
p AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS q FROM c)
SELECT {g}tp, fp, tn, fn, {r('p', 'precision')}, {r('q', 'recall')}, {r('coalesce(2 * p * q / nullif(p + q, 0), 0)', 'f1')}, {r('coalesce(fp / nullif(fp + tn, 0), 0)', 'fpr')}, {r('coalesce((tp + fp) / nullif(tp + fp + tn + fn, 0), 0)', 'bad_rate')} FROM p"""


def ladder(table: str, by: str, v: str) -> str:
    return f"""WITH x AS (SELECT {by}, {v} AS v FROM {table}),
q AS (SELECT {by}, count(*) AS n, quantile_cont(v, [0.1, 0.25, 0.5, 0.75, 0.9]) AS q FROM x GROUP BY 1),
s AS (SELECT x.{by}, any_value(n) AS n, any_value(q) AS q, median(abs(v - q[3])) AS mad, median(v - q[3]) FILTER (v >= q[3]) AS umad, count(*) FILTER (v >= q[3]) AS un,
      quantile_cont(v, [0.25, 0.75]) FILTER (v >= q[3]) AS uq FROM x JOIN q USING ({by}) GROUP BY 1),
l AS (SELECT *, 1.4826 * mad AS a, 1.4826 * umad AS b, CASE WHEN un >= 20 THEN (uq[2] - uq[1]) / 1.349 END AS c, (q[4] - q[2]) / 1.349 AS d, 0.7413 * (q[5] - q[1]) AS e FROM s)"""


LADDER_OUT = """CASE WHEN a > 1e-12 THEN a WHEN b > 1e-12 THEN b WHEN c > 1e-12 THEN c WHEN d > 1e-12 THEN d WHEN e > 1e-12 THEN e ELSE 0 END"""
LADDER_SOURCE = """CASE WHEN a > 1e-12 THEN 'mad' WHEN b > 1e-12 THEN 'upper_mad' WHEN c > 1e-12 THEN 'upper_iqr' WHEN d > 1e-12 THEN 'iqr' WHEN e > 1e-12 THEN 'span' ELSE 'flat' END"""

def pair_signals(cut: str = "true", least: int = 1) -> str:
    """Pairs of vectors, their ten nearest inputs with cut, and per pair: tau, mid and spread of the neighbours' tau, angle and its median."""
    return f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.vec_id // 2 AS id, a.v AS x, b.v AS y FROM e a JOIN e b ON a.vec_id % 2 = 0 AND b.vec_id = a.vec_id + 1),
near AS (SELECT a.id, b.id AS neighbour, (1 - list_dot_product(a.x, b.x))::FLOAT AS distance FROM p a JOIN p b ON a.id <> b.id),
ten AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) <= 10),
k AS (SELECT * FROM ten WHERE {cut} QUALIFY count(*) OVER (PARTITION BY id) >= {least}),
c AS (SELECT id, unnest(x) AS x, unnest(y) AS y, generate_subscripts(x, 1) AS i FROM p),
l AS (SELECT id, sqrt(sum(x * x)) AS nx, sqrt(sum(y * y)) AS ny FROM c GROUP BY 1),
d AS (SELECT id, i, y / ny - x / nx AS d FROM c JOIN l USING (id)),
tau AS (SELECT id, sqrt(sum(d * d)) AS tau FROM d GROUP BY 1),
u AS (SELECT id, i, d / tau AS u FROM d JOIN tau USING (id)),
mid AS (SELECT k.id, median(tau) AS m FROM k JOIN tau ON tau.id = k.neighbour GROUP BY 1),
spread AS (SELECT k.id, m, median(abs(tau - m)) AS s FROM k JOIN tau ON tau.id = k.neighbour JOIN mid ON mid.id = k.id GROUP BY 1, 2),
mu AS (SELECT k.id, i, avg(u) AS mu FROM k JOIN u ON u.id = k.neighbour GROUP BY 1, 2),
far AS (SELECT mu.id, u.id AS other, acos(greatest(-1.0, least(1.0, sum(u * mu) / (sqrt(sum(u * u)) * sqrt(sum(mu * mu)))))) AS angle
        FROM mu JOIN (SELECT id, neighbour FROM k UNION ALL SELECT DISTINCT id, id FROM k) o ON o.id = mu.id JOIN u ON u.id = o.neighbour AND u.i = mu.i GROUP BY 1, 2),
turn AS (SELECT id, max(angle) FILTER (other = id) AS own, median(angle) FILTER (other <> id) AS usual FROM far GROUP BY 1),
scale AS (SELECT id, tau, sqrt(least(greatest(tau / (median(tau) OVER () + 1e-9), 0.25), 4.0)) AS scale FROM tau),
signals AS (SELECT id, abs(tau - m) / (1.4826 * s + 1e-6) AS length, own / (usual + 1e-6) AS direction, scale FROM scale JOIN spread USING (id) JOIN turn USING (id))"""


def gaps(table: str, z: str, key: str) -> str:
    """CTEs up to jumps (event_type, jump, gap_z, kind): gaps of the sorted z >= 0 in a window of survival, and the one that counts."""
    return f"""gp AS (SELECT event_type, {z} AS z, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER o AS i, lead({z}) OVER o AS nx FROM {table} WHERE {z} >= 0 WINDOW o AS (PARTITION BY event_type ORDER BY {z}, {key})),
gm AS (SELECT event_type, avg((z > 0)::INT) AS mass FROM gp GROUP BY 1),
gg AS (SELECT gp.*, nx - z AS gap, (n - i) / n AS s, least(0.95, greatest(0.30, mass + 0.05)) AS hi FROM gp JOIN gm USING (event_type) WHERE n >= 40 AND nx > z),
gc AS (SELECT event_type, count(*) FILTER (s BETWEEN 0.005 AND hi) AS a, count(*) FILTER (s BETWEEN 0.0025 AND least(0.98, hi + 0.1)) AS b FROM gg GROUP BY 1),
gv AS (SELECT gg.* FROM gg JOIN gc USING (event_type) WHERE (a >= 5 AND s BETWEEN 0.005 AND hi) OR (a < 5 AND b >= 5 AND s BETWEEN 0.0025 AND least(0.98, hi + 0.1))),
gq AS (SELECT event_type, median(gap) AS m, quantile_cont(gap, [0.1, 0.25, 0.75, 0.9]) AS q FROM gv GROUP BY 1),
gs AS (SELECT event_type, any_value(m) AS m, any_value(q) AS q, 1.4826 * median(abs(gap - m)) AS mad FROM gv JOIN gq USING (event_type) GROUP BY 1),
gz AS (SELECT gv.event_type, i, nx, (gap - m) / CASE WHEN mad > 1e-12 THEN mad WHEN (q[3] - q[2]) / 1.349 > 1e-12 THEN (q[3] - q[2]) / 1.349 WHEN 0.7413 * (q[4] - q[1]) > 1e-12 THEN 0.7413 * (q[4] - q[1]) END AS gz FROM gv JOIN gs USING (event_type)),
ga AS (SELECT event_type, arg_min(nx, i) FILTER (gz >= 4) AS sj, arg_min(gz, i) FILTER (gz >= 4) AS sg, arg_max(nx, gz) AS wj, max(gz) AS wg FROM gz WHERE gz IS NOT NULL GROUP BY 1),
jumps AS (SELECT event_type, coalesce(sj, CASE WHEN wg >= 2.5 THEN wj END) AS jump, coalesce(sg, wg) AS gap_z, CASE WHEN sj IS NOT NULL THEN 'strong_first' WHEN wg >= 2.5 THEN 'weak_max' ELSE 'none' END AS kind FROM ga)"""


def survival(table: str, v: str, points: int, low: str, high: str, prefix: str = "") -> str:
    """CTEs up to curve (event_type, i, x, survival, smooth, d1, d2) of a column over an even grid."""
    c = prefix
    return f"""{c}sv AS (SELECT event_type, {v} AS v FROM {table}), {c}se AS (SELECT event_type, {low} AS lo, {high} AS hi, count(*) AS n FROM {c}sv GROUP BY 1),
{c}sg AS (SELECT event_type, i::INT AS i, lo + i * ((hi - lo) / {points - 1}) AS x, n FROM {c}se, range({points}) t(i)),
{c}sc AS (SELECT g.event_type, g.i, any_value(x) AS x, any_value(n) AS n, count(s.v) AS k FROM {c}sg g LEFT JOIN {c}sv s ON s.event_type = g.event_type AND s.v >= g.x GROUP BY 1, 2),
{c}sl AS (SELECT *, k / n AS survival, ln(greatest(k / n, 1e-12)) AS l FROM {c}sc),
{c}sm AS (SELECT *, (coalesce(lag(l, 2) OVER w, 0) + 2 * coalesce(lag(l) OVER w, 0) + 3 * l + 2 * coalesce(lead(l) OVER w, 0) + coalesce(lead(l, 2) OVER w, 0)) / 9 AS smooth FROM {c}sl WINDOW w AS (PARTITION BY event_type ORDER BY i)),
{c}s1 AS (SELECT *, CASE WHEN lag(i) OVER w IS NULL THEN lead(smooth) OVER w - smooth WHEN lead(i) OVER w IS NULL THEN smooth - lag(smooth) OVER w ELSE (lead(smooth) OVER w - lag(smooth) OVER w) / 2 END AS d1 FROM {c}sm WINDOW w AS (PARTITION BY event_type ORDER BY i)),
{c}curve AS (SELECT *, CASE WHEN lag(i) OVER w IS NULL THEN lead(d1) OVER w - d1 WHEN lead(i) OVER w IS NULL THEN d1 - lag(d1) OVER w ELSE (lead(d1) OVER w - lag(d1) OVER w) / 2 END AS d2 FROM {c}s1 WINDOW w AS (PARTITION BY event_type ORDER BY i))"""


def bends(table: str, z: str, most: str) -> str:
    """CTEs up to bends (event_type, points, knee): the sharpest bend of the log-survival of z >= 0 in a window of survival."""
    return f"""bz AS (SELECT event_type, {z} AS z FROM {table} WHERE {z} >= 0), be AS (SELECT event_type, count(*) AS rows_, quantile_cont(z, 0.995) AS top, avg((z > 0)::INT) AS mass FROM bz GROUP BY 1),
bk AS (SELECT event_type, z, top FROM bz JOIN be USING (event_type) WHERE rows_ >= 40 AND top > 0), bt AS (SELECT event_type, {most} AS hi FROM be),
{survival('(SELECT event_type, {top: top, z: z} AS z FROM bk)', 'z', 160, '0.0', 'max(v.top)', 'b').replace('s.v >= g.x', 's.v.z >= g.x').replace('count(s.v)', 'count(s.v.z)')},
bp AS (SELECT c.*, survival BETWEEN 0.005 AND hi AS a, survival BETWEEN 0.0025 AND least(0.95, greatest(hi, 0.5)) AS b FROM bcurve c JOIN bt USING (event_type) WHERE x >= 0.5),
bends AS (SELECT event_type, CASE WHEN count(*) FILTER (a) >= 5 THEN count(*) FILTER (a) ELSE count(*) FILTER (b) END AS points,
  CASE WHEN count(*) FILTER (a) >= 5 THEN arg_min(x, [round(d2, 12), i]) FILTER (a) WHEN count(*) FILTER (b) >= 5 THEN arg_min(x, [round(d2, 12), i]) FILTER (b) END AS knee FROM bp GROUP BY 1)"""


ORACLES: dict[str, str] = {
    "robust_z_events": f"""WITH {Z}, m AS (SELECT event_type, median(value) AS med FROM events GROUP BY 1),
s AS (SELECT event_type, count(*) AS n, med, median(abs(value - med)) AS mad FROM events JOIN m USING (event_type) GROUP BY 1, 3)
SELECT event_type, n, {r('med', 'median')}, {r('mad', 'mad')}, count(*) FILTER (z < 2) AS n_pass, count(*) FILTER (z >= 2 AND z < 3.5) AS n_fail, count(*) FILTER (z >= 3.5) AS n_hard
FROM zs JOIN s USING (event_type) GROUP BY 1, 2, med, mad""",
    "robust_z_rows": f"WITH {Z} SELECT event_id, {r('z', 'z')} FROM zs",
    "scale_ladder_by_returnflag": f"{ladder('lineitem', 'l_returnflag', 'l_extendedprice')} SELECT l_returnflag, n, {r('q[3]', 'median')}, {r(LADDER_OUT, 'sigma')}, {LADDER_SOURCE} AS source FROM l",
    "scale_ladder_flat": f"{ladder('lineitem', 'l_linestatus', 'CASE WHEN l_linenumber <= 5 THEN 0.0::DOUBLE ELSE l_quantity END')} SELECT l_linestatus, n, {r('q[3]', 'median')}, {r(LADDER_OUT, 'sigma')}, {LADDER_SOURCE} AS source FROM l",
    "weighted_quantile_price": f"""WITH c AS (
  SELECT l_returnflag, l_extendedprice AS x, (sum(l_quantity) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice, l_orderkey * 100 + l_linenumber ROWS UNBOUNDED PRECEDING) - l_quantity / 2) / sum(l_quantity) OVER (PARTITION BY l_returnflag) AS c
  FROM lineitem WHERE l_quantity > 0), q AS (SELECT unnest([0.1, 0.5, 0.9])::DOUBLE AS q),
b AS (SELECT l_returnflag, q, max(c) FILTER (c <= q) AS c0, arg_max(x, c) FILTER (c <= q) AS x0, min(c) FILTER (c >= q) AS c1, arg_min(x, c) FILTER (c >= q) AS x1 FROM c, q GROUP BY 1, 2)
SELECT l_returnflag, q, {r('coalesce(x0 + (x1 - x0) * CASE WHEN c1 > c0 THEN (q - c0) / (c1 - c0) ELSE 0 END, x0, x1)', 'value')} FROM b""",
    "boxplot_orders": f"""WITH q AS (SELECT o_orderpriority, count(*) AS n, min(o_totalprice) AS low, quantile_cont(o_totalprice, 0.25) AS q1, median(o_totalprice) AS med, quantile_cont(o_totalprice, 0.75) AS q3, max(o_totalprice) AS high FROM orders GROUP BY 1),
j AS (SELECT q.*, o_totalprice AS v, o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM orders JOIN q USING (o_orderpriority))
SELECT o_orderpriority, n, {r('low', 'low')}, {r('q1', 'q1')}, {r('med', 'med')}, {r('q3', 'q3')}, {r('high', 'high')}, {r('q3 - q1', 'iqr')}, {r('min(v) FILTER (inside)', 'whisker_low')}, {r('max(v) FILTER (inside)', 'whisker_high')}, count(*) FILTER (NOT inside) AS outliers
FROM j GROUP BY o_orderpriority, n, low, q1, med, q3, high""",
    "signal_histogram": f"""WITH e AS (SELECT min(value) AS lo, (max(value) - min(value)) / 60 AS w FROM events),
c AS (SELECT least(floor((value - lo) / w), 59)::INT AS bin, count(*) AS n, count(*) FILTER (event_type = 'click') AS m FROM events, e GROUP BY 1)
SELECT b.bin::INT AS bin, {r('lo + b.bin * w', 'left_edge')}, {r('lo + b.bin * w + w', 'right_edge')}, coalesce(n, 0)::BIGINT AS n, coalesce(m, 0)::BIGINT AS n_marked FROM (SELECT unnest(range(60)) AS bin) b CROSS JOIN e LEFT JOIN c ON b.bin = c.bin""",
    "confusion_quality": confusion(),
    "confusion_by_lang": confusion("lang"),
    "tristate_quality": f"""WITH {LABELLED}, x AS (SELECT * FROM lab WHERE bad IS NOT NULL), t AS (SELECT lang, quantile_cont(n_chars, 0.8) AS w, quantile_cont(n_chars, 0.95) AS f FROM x GROUP BY 1),
s AS (SELECT bad, CASE WHEN n_chars > f THEN 'fail' WHEN n_chars > w THEN 'warn' ELSE 'pass' END AS s FROM x JOIN t USING (lang)),
c AS (SELECT count(*) AS n, count(*) FILTER (bad) AS n_bad, count(*) FILTER (s = 'pass') AS n_pass, count(*) FILTER (s = 'warn') AS n_warn, count(*) FILTER (s = 'fail') AS n_fail,
 count(*) FILTER (bad AND s = 'pass') AS bp, count(*) FILTER (bad AND s = 'warn') AS bw, count(*) FILTER (bad AND s = 'fail') AS bf FROM s)
SELECT n, n_bad, n_pass, n_warn, n_fail, {r('coalesce(bf / nullif(n_fail, 0), 0)', 'fail_precision')}, {r('coalesce(bf / nullif(n_bad, 0), 0)', 'fail_recall')}, {r('coalesce(bw / nullif(n_warn, 0), 0)', 'warn_bad_rate')}, {r('coalesce(bp / nullif(n_pass, 0), 0)', 'pass_bad_rate')},
 {r('coalesce(bw / nullif(n_warn, 0), 0) - coalesce(bp / nullif(n_pass, 0), 0)', 'warn_lift')}, {r('coalesce(n_warn / nullif(n, 0), 0)', 'warn_coverage')} FROM c""",
    "group_global_quantiles": f"""SELECT event_type, grouping(event_type) = 1 AS is_global, count(*) AS n, {r('quantile_cont(value, 0.5)', 'q0')}, {r('quantile_cont(value, 0.9)', 'q1')}, {r('quantile_cont(value, 0.99)', 'q2')} FROM events GROUP BY GROUPING SETS ((event_type), ())""",
    "group_threshold_fallback": f"""WITH e AS (SELECT user_id % 40 AS g, value FROM events), o AS (SELECT g, quantile_cont(value, 0.9) AS t FROM e GROUP BY 1 HAVING count(*) >= 240), a AS (SELECT quantile_cont(value, 0.9) AS t FROM e)
SELECT g, count(*) AS n, {r('max(coalesce(o.t, a.t))', 'threshold')}, count(*) FILTER (value > coalesce(o.t, a.t)) AS n_over FROM e LEFT JOIN o USING (g) CROSS JOIN a GROUP BY 1""",
    "type_entropy": f"""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), p AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c)
SELECT user_id, count(*) AS kinds, {r('CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 0 END', 'entropy')} FROM p GROUP BY 1""",
    "duplicate_rate": f"""WITH c AS (SELECT trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r]+', ' ', 'g')) AS k, count(*) AS n FROM documents GROUP BY 1) SELECT sum(n)::BIGINT AS n, count(*) AS n_distinct, {r('1 - count(*) / sum(n)', 'repeat_rate')} FROM c""",
    "top_repeats": "SELECT sha256(coalesce(text, '')) AS text_sha256, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) >= 2 ORDER BY 2 DESC, 1 LIMIT 10",
    "min_max_scale": f"SELECT event_id, {r('CASE WHEN max(value) OVER w > min(value) OVER w THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) ELSE 0.5 END', 'scaled')} FROM events WINDOW w AS (PARTITION BY event_type)",
    "soft_weights": f"""WITH x AS (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) / count(*) OVER (PARTITION BY event_type) AS k FROM events)
SELECT event_id, {r('least(1.0, greatest(0.05, exp(-6 * greatest(0.0, k - 0.9))))', 'weight')} FROM x""",
    "gap_jump": f"""WITH {Z}, {gaps('zs', 'z', 'event_id')} SELECT event_type, {r('jump', 'jump')}, {r('gap_z', 'gap_z')}, kind FROM jumps""",
    "tail_start_curvature": f"""WITH {Z}, {bends('zs', 'z', '0.30')} SELECT event_type, points, {r('knee', 'knee')} FROM bends""",
    "log_survival_grid": f"""WITH {Z}, {survival('zs', 'z', 40, 'min(v)', 'max(v)')} SELECT event_type, i, {r('x', 'x')}, {r('survival', 'survival')}, {r('smooth', 'smooth')}, {r('d1', 'd1')}, {r('d2', 'd2')} FROM curve""",
    "tail_start_policy": f"""WITH lad AS ({ladder('events', 'event_type', 'value')} SELECT event_type, q[3] AS median, {LADDER_OUT} AS sigma FROM l),
zt AS (SELECT e.event_type, e.event_id, (value - median) / sigma AS z FROM events e JOIN lad USING (event_type) WHERE sigma > 0), {gaps('zt', 'z', 'event_id')}, {bends('zt', 'z', 'least(0.95, greatest(0.30, mass + 0.05))')},
p AS (SELECT event_type, median, sigma, knee, jump, gap_z, CASE WHEN kind = 'strong_first' THEN jump ELSE greatest(knee, jump) END AS pick FROM lad LEFT JOIN jumps USING (event_type) LEFT JOIN bends USING (event_type)),
k AS (SELECT *, CASE WHEN pick IS NULL THEN 3.5 ELSE least(8.0, greatest(0.5, pick)) END AS k FROM p)
SELECT event_type, {r('median', 'median')}, {r('sigma', 'sigma')}, {r('knee', 'knee')}, {r('jump', 'jump')}, {r('gap_z', 'gap_z')}, {r('k', 'k')}, {r('CASE WHEN sigma > 0 THEN median + k * sigma END', 'threshold')} FROM k""",
    "flat_runs": """WITH x AS (SELECT user_id, floor((epoch(ts) - 1704067200) / 86400)::INT AS day, sum(value) AS v FROM events GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS i FROM x),
f AS (SELECT *, sum((v < 120)::INT) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS k FROM n)
SELECT user_id, min(i)::INT AS start, arg_min(day, i)::INT AS x FROM f WHERE k = 3 GROUP BY 1""",
    "rolling_jump": f"""WITH x AS (SELECT event_type, floor((epoch(ts) - 1704067200) / 86400)::INT AS day, round(sum(value), 4) AS v FROM events GROUP BY 1, 2),
s AS (SELECT event_type, day, avg(v) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM x),
d AS (SELECT event_type, day, round(coalesce(s - lag(s) OVER (PARTITION BY event_type ORDER BY day), 0), 9) AS d FROM s)
SELECT event_type, day AS at, {r('d', 'rise')} FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY d DESC, day) AS k FROM d) WHERE k = 1""",
    "zero_neighbours": f"SELECT c_mktsegment, {r('min(c_acctbal) FILTER (c_acctbal > 0)', 'next_up')}, {r('max(c_acctbal) FILTER (c_acctbal < 0)', 'next_down')} FROM customer GROUP BY 1",
    "stratified_folds": "SELECT doc_id, ((row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id::VARCHAR), doc_id) - 1) % 5)::INT AS fold FROM labels WHERE quality IS NOT NULL",
    "group_ordinals": """WITH f AS (SELECT o_orderpriority, min(o_orderkey) AS k, count(*) AS group_size FROM orders GROUP BY 1), i AS (SELECT *, printf('g%04d', row_number() OVER (ORDER BY k) - 1) AS group_id FROM f)
SELECT o_orderkey, group_id, group_size FROM orders JOIN i USING (o_orderpriority)""",
    "row_positions": "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS row_index FROM customer",
    "lenient_labels": """WITH x AS (SELECT l_orderkey, l_linenumber, lower(['TRUE', 'yes', '1', 'no', 'Y', 'maybe'][(l_orderkey % 6 + 1)::INT]) AS f FROM lineitem)
SELECT l_orderkey, l_linenumber, f IN ('true', '1', 'yes') AS strict_flag, f IN ('true', '1', 'yes', 'y', 't') AS yn_flag, CASE WHEN f IN ('true', 'yes') THEN 1.0::DOUBLE WHEN f = 'no' THEN 0.0::DOUBLE END AS label, f = 'no' AS bad FROM x""",
    "tail_triggers": f"""WITH {Z} SELECT event_type, count(*) FILTER (z >= 2.5) AS upper, count(*) FILTER (z <= -0.6) AS lower, count(*) FILTER (z >= 2.5 OR z <= -0.6) AS two_sided, count(*) FILTER (NOT value > 5 OR z <= 1) AS passes FROM zs GROUP BY 1""",
    "state_machine_events": f"WITH {Z} SELECT event_type, CASE WHEN user_id % 7 = 0 THEN 'na' ELSE {STATE} END AS state, count(*) AS n FROM zs GROUP BY 1, 2",
    "distribution_rollup": f"""WITH {Z}, s AS (SELECT user_id, CASE WHEN z >= 4 THEN 2 WHEN z >= 2 THEN 1 ELSE 0 END AS st FROM zs),
g AS (SELECT user_id, bool_or(st = 1) AS any_fail, bool_or(st = 2) AS any_hard, bool_and(st = 0) AS all_pass, count(*) AS n FROM s GROUP BY 1)
SELECT *, CASE WHEN n < 20 THEN 'na' WHEN any_hard THEN 'hard_fail' WHEN any_fail THEN 'fail' ELSE 'pass' END AS final_state FROM g""",
    "state_rates": f"""WITH {Z}, s AS (SELECT event_type, {STATE} AS s FROM zs) SELECT event_type, count(*) AS n, """ + ", ".join(r(f"avg((s = '{k}')::INT)", f"{k}_rate") for k in ("pass", "warn", "fail", "hard_fail")) + " FROM s GROUP BY 1",
    "label_lookup_last_wins": """WITH l AS (SELECT user_id::VARCHAR AS id, arg_max(event_type, event_id) AS label FROM events GROUP BY 1) SELECT c_custkey::VARCHAR AS cid, label FROM customer LEFT JOIN l ON c_custkey::VARCHAR = id""",
    "top_anomalies": f"SELECT event_type, k::INT AS rank, event_id, {r('value', 'value')} FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS k FROM events) WHERE k <= 30",
    "risk_topk_dedupe": f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events), t AS (SELECT *, row_number() OVER (ORDER BY value DESC, event_id) AS rank FROM o WHERE k = 1)
SELECT rank::INT AS rank, user_id, event_id, {r('value', 'value')} FROM t WHERE rank <= 20""",
    "rows_not_evaluated": """WITH d AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 200000)
SELECT c_mktsegment, count(*) AS n, 'anti' AS kind FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM d) GROUP BY 1 UNION ALL SELECT c_mktsegment, count(*), 'semi' FROM customer WHERE c_custkey IN (SELECT o_custkey FROM d) GROUP BY 1""",
    "exact_sample": "SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey::VARCHAR || '42'), o_orderkey LIMIT 100",
    "leaves_props": "SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS leaf FROM events",
    "bundle_props": "SELECT event_id, json_extract_string(props, '$.k') AS bundle FROM events",
    "schema_gate_props": "SELECT event_id, json_extract_string(props, '$.k')::INT % 2 = 0 AND json_extract_string(props, '$.k')::INT BETWEEN 0 AND 99 AS schema_pass FROM events",
    "textlen_thresholds": f"""WITH n AS (SELECT count(DISTINCT conv_id) AS n FROM conversations), g AS (SELECT role AS path, count(*) AS c, median(length(trim(text))) AS m FROM conversations WHERE trim(text) <> '' GROUP BY 1)
SELECT path, c AS n, {r('m * 0.3', 'threshold')} FROM g, n WHERE c >= greatest(3, ceil(n * 0.2))""",
    "textlen_gate": """WITH g AS (SELECT role, median(length(trim(text))) * 0.5 AS t FROM conversations WHERE trim(text) <> '' GROUP BY 1 HAVING count(*) >= 3),
f AS (SELECT conv_id, c.role, trim(text) <> '' AND length(trim(text)) <= t AS bad FROM conversations c LEFT JOIN g ON c.role = g.role)
SELECT conv_id, coalesce(string_agg(DISTINCT role, '|' ORDER BY role) FILTER (bad), '') AS failed, count(*) FILTER (bad) = 0 AS textlen_pass FROM f GROUP BY 1""",
    "token_stats": f"""WITH x AS (SELECT lang, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS k FROM documents) SELECT lang, count(*) AS n, sum(k)::BIGINT AS tokens, {r('median(k)', 'median_tokens')} FROM x GROUP BY 1""",
    "ngram_templates": """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: array_to_string(w[i:i+2], ' '))) AS gram FROM w WHERE len(w) >= 3)
SELECT gram, count(*) AS docs FROM g GROUP BY 1 HAVING count(*) >= 12""",
    "normal_ids": """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE '''' || c_name END AS id, CASE WHEN c_custkey % 5 = 0 THEN c_custkey::VARCHAR ELSE c_name END AS id_or_position FROM customer""",
    "trace_pairs": """WITH x AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS nr, lead(text) OVER w AS output, max(text) FILTER (role = 'system') OVER (PARTITION BY conv_id) AS p FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, coalesce(p, '__all__') AS prompt, text AS input, output FROM x WHERE role = 'user' AND nr = 'assistant'""",
    "nested_bundles": """WITH o AS (SELECT * FROM orders)
SELECT o_orderkey, 'a.o_orderstatus' AS path, o_orderstatus AS leaf FROM o UNION ALL SELECT o_orderkey, 'a.o_custkey', o_custkey::VARCHAR FROM o UNION ALL SELECT o_orderkey, 'b[0]', o_orderpriority FROM o UNION ALL SELECT o_orderkey, 'b[1]', 'x' FROM o""",
    "hard_gate_score": f"""WITH x AS (SELECT lang, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) >= 40 AS ok FROM documents), g AS (SELECT lang, count(*) AS n, avg(ok::INT) AS p FROM x GROUP BY 1)
SELECT lang, n, {r('p', 'pass_rate')}, CASE WHEN p >= 1 THEN 5 WHEN p >= 0.9 THEN 4 WHEN p >= 0.8 THEN 3 WHEN p >= 0.7 THEN 2 WHEN p >= 0.6 THEN 1 ELSE 0 END AS score FROM g""",
    "instruction_gate": """WITH x AS (SELECT doc_id, NOT contains(text, ',') AND trim(text) <> '' AS a, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) >= 50 AS b FROM documents)
SELECT doc_id, a AND b AS ifeval_pass, concat_ws('|', CASE WHEN NOT a THEN 'punctuation:no_comma' END, CASE WHEN NOT b THEN 'length_constraints:number_words' END) AS failed FROM x""",
    "instruction_accuracy": f"""WITH x AS (SELECT unnest([{{'id': 'punctuation:no_comma', 'tier': 'punctuation', 'ok': NOT contains(text, ',')}}, {{'id': 'detectable_format:title', 'tier': 'detectable_format', 'ok': regexp_matches(text, '<<[^\\n<>]*[^\\s<>][^\\n<>]*>>')}},
 {{'id': 'startend:quotation', 'tier': 'startend', 'ok': length(trim(text)) > 1 AND starts_with(trim(text), '"') AND ends_with(trim(text), '"')}}]) AS c FROM documents)
SELECT c.tier AS tier, c.id AS id, count(*) AS n, {r('avg(c.ok::INT)', 'accuracy')} FROM x GROUP BY GROUPING SETS ((), (c.tier), (c.id))""",
    "knn_euclid": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), d AS (SELECT a.vec_id, b.vec_id AS neighbour, list_distance(a.v, b.v)::FLOAT AS distance FROM e a JOIN e b ON a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS rank FROM d) SELECT vec_id, rank::INT AS rank, neighbour, round(distance::DOUBLE, 4) AS distance FROM k WHERE rank <= 5""",
    "knn_cosine_by_label": """WITH e AS (SELECT label, vec_id, embedding::DOUBLE[] AS v FROM embeddings), d AS (SELECT a.label, a.vec_id, b.vec_id AS neighbour, (1 - list_dot_product(a.v, b.v))::FLOAT AS distance FROM e a JOIN e b ON a.vec_id <> b.vec_id AND a.label = b.label),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS rank FROM d) SELECT label, vec_id, rank::INT AS rank, neighbour, round(distance::DOUBLE, 4) AS distance FROM k WHERE rank <= 3""",
    "unit_vectors": """WITH p AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x FROM embeddings), n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM p GROUP BY 1)
SELECT vec_id, round(sqrt(sum((3 * x / (3 * n)) * (3 * x / (3 * n)))), 6) AS length, round(sum(x * 2 * x), 6) AS dot FROM p JOIN n USING (vec_id) GROUP BY 1""",
    "output_density": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), d AS (SELECT a.vec_id, b.vec_id AS neighbour, list_distance(a.v, b.v)::FLOAT AS distance FROM e a JOIN e b ON a.vec_id <> b.vec_id),
r AS (SELECT vec_id, distance::DOUBLE AS distance, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS rank FROM d),
m AS (SELECT vec_id, k, avg(distance) AS m FROM r JOIN (VALUES (10), (15), (20)) AS ks(k) ON rank <= k GROUP BY 1, 2), c AS (SELECT k, median(m) AS c FROM m GROUP BY 1),
s AS (SELECT k, c, median(abs(m - c)) AS s FROM m JOIN c USING (k) GROUP BY 1, 2) SELECT vec_id, round(median((m - c) / (1.4826 * s + 1e-9)), 3) AS density FROM m JOIN s USING (k) GROUP BY 1""",
    "delta_length": f"{pair_signals()} SELECT id, round(length, 4) AS length_signal FROM signals",
    "delta_direction": f"{pair_signals()} SELECT id, round(direction * scale, 4) AS direction_signal FROM signals",
    "sim_conflict": f"{pair_signals('1 - distance::DOUBLE >= 0.35', 3)} SELECT id, round(coalesce(direction + length, 0.0), 4) AS conflict FROM p LEFT JOIN signals USING (id)",
    "class_centroids": f"""WITH p AS (SELECT label, vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM p WHERE label IN (SELECT label FROM embeddings GROUP BY 1 HAVING count(*) >= 20) GROUP BY 1, 2)
SELECT label, i::INT AS i, {r('x / sqrt(sum(x * x) OVER (PARTITION BY label))', 'x')} FROM m""",
    "robust_z_policy": f"{ladder('events', 'event_type', 'value')} SELECT event_type, n, {r('q[3]', 'median')}, {r(LADDER_OUT, 'sigma')}, {LADDER_SOURCE} AS source, {r(f'q[3] + 3.5 * {LADDER_OUT}', 'threshold')} FROM l",
    "quantile_tail_policy": f"SELECT event_type, count(*) AS n, {r('quantile_cont(value, 0.995)', 'threshold')} FROM events GROUP BY 1",
    "core_thresholds": f"""WITH t AS (SELECT event_type, quantile_cont(value, 0.9) AS t FROM events GROUP BY 1), x AS (SELECT event_type, t, value FROM events JOIN t USING (event_type) WHERE value <= t), m AS (SELECT event_type, t, median(value) AS m FROM x GROUP BY 1, 2),
d AS (SELECT x.event_type, m.t, m, 1.4826 * median(abs(value - m)) AS s FROM x JOIN m USING (event_type) GROUP BY 1, 2, 3) SELECT event_type, {r('m', 'core_median')}, {r('least(m + s, t)', 'core')}, {r('s', 'core_sigma')} FROM d""",
    "stability_cuts": f"""WITH t AS (SELECT event_type, s.s AS share, quantile_cont(value, 0.95) AS a, quantile_cont(value, 0.9) AS b, quantile_cont(value, 0.8) AS c FROM events, (SELECT unnest([0.05, 0.1, 0.2])::DOUBLE AS s) s GROUP BY 1, 2),
u AS (SELECT event_type, share, CASE WHEN share = 0.05 THEN a WHEN share = 0.1 THEN b ELSE c END AS cut FROM t)
SELECT event_type, share, {r('cut', 'cut')}, count(*) AS flagged, {r('var_pop(user_id % 17)', 'var_f1')} FROM events JOIN u USING (event_type) WHERE value >= cut GROUP BY 1, 2, cut""",
    "calib_tristate": """WITH t AS (SELECT event_type, quantile_cont(value, 0.9) AS w, quantile_cont(value, 0.99) AS f FROM events WHERE user_id % 11 <> 0 GROUP BY 1)
SELECT event_type, CASE WHEN user_id % 11 = 0 THEN 'na' WHEN value > f THEN 'fail' WHEN value > w THEN 'warn' ELSE 'pass' END AS state, count(*) AS n FROM events JOIN t USING (event_type) GROUP BY 1, 2""",
    "calib_grid_distance": f"""WITH {LABELLED}, x AS (SELECT doc_id, lang, n_chars, bad, (row_number() OVER (PARTITION BY bad ORDER BY md5(doc_id::VARCHAR), doc_id) - 1) % 5 AS fold FROM lab WHERE bad IS NOT NULL),
q AS (SELECT unnest([0.5, 0.7, 0.8, 0.9, 0.95])::DOUBLE AS q, unnest(range(5)) AS i), h AS (SELECT DISTINCT fold AS h FROM x),
t AS (SELECT h, lang, quantile_cont(n_chars, [0.5, 0.7, 0.8, 0.9, 0.95]) AS t FROM x JOIN h ON fold <> h GROUP BY 1, 2),
p AS (SELECT q, bad, n_chars > t[i + 1] AS p FROM x JOIN t ON fold = h AND x.lang = t.lang CROSS JOIN q),
c AS (SELECT q, count(*) FILTER (bad AND p) AS tp, count(*) FILTER (NOT bad AND p) AS fp, count(*) FILTER (bad AND NOT p) AS fn, count(*) FILTER (NOT bad AND NOT p) AS tn FROM p GROUP BY 1),
m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS re FROM c), f AS (SELECT *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) AS f1, pr >= 0.3 OR max((pr >= 0.3)::INT) OVER () = 0 AS ok FROM m)
SELECT {r('q', 'q')}, tp, fp, fn, tn, {r('pr', 'precision')}, {r('re', 'recall')}, {r('f1', 'f1')}, row_number() OVER (ORDER BY ok DESC, round(f1, 9) DESC, fp, round(re, 9) DESC, q) = 1 AS chosen FROM f""",
    "targets_met": f"""WITH {Z}, s AS (SELECT event_type, {STATE} AS s, user_id % 3 = 0 AS y FROM zs), g AS (SELECT event_type, count(*) FILTER (s = 'hard_fail' AND y) / nullif(count(*) FILTER (s = 'hard_fail'), 0) AS h, count(*) FILTER (s IN ('fail', 'hard_fail') AND y) / nullif(count(*) FILTER (s IN ('fail', 'hard_fail')), 0) AS f,
 count(*) FILTER (s = 'warn' AND NOT y) / nullif(count(*) FILTER (s = 'warn'), 0) AS w FROM s GROUP BY 1) SELECT event_type, {r('h', 'hard_precision')}, {r('f', 'fail_precision')}, {r('w', 'warn_good')}, coalesce(h >= 1, true) AND coalesce(f >= 0.88, true) AND coalesce(w < 0.3, true) AS met FROM g""",
    "tail_metrics": f"""WITH {Z} SELECT event_type, count(*) AS n, {r('avg((z >= 2)::INT)', 'p_fail')}, {r('avg((z >= 3.5)::INT)', 'p_hard')}, {r('least(12, avg(greatest(0, z - 2)) + 3 * avg(greatest(0, z - 3.5)))', 'mass')} FROM zs GROUP BY 1""",
    "confidence": f"""WITH g AS (SELECT event_type, count(*) FILTER (value > 3) AS n, avg((value > 3)::INT) AS a, bool_and(event_id % 50000 <> 7) AS th FROM events GROUP BY 1),
p AS (SELECT event_type, n AS n_valid, CASE WHEN n < 8 THEN 0 ELSE least(1.0, n / 3000) END AS d, least(1.0, a) AS c, th::INT AS t FROM g)
SELECT event_type, n_valid, {r('d', 'conf_data')}, {r('c', 'conf_calc')}, {r('t', 'conf_th')}, {r('5 * least(d, c, t)', 'confidence')} FROM p""",
    "coverage": f"SELECT event_type, {r('5 * avg((value > 3 AND user_id % 4 <> 0)::INT)', 'coverage')} FROM events GROUP BY 1",
    "window_rates": f"WITH {Z} SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, {r('avg((z >= 2)::INT)', 'fail_rate')} FROM zs GROUP BY 1, 2",
    "user_sessions": """WITH x AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x), c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY 1, 2)
SELECT user_id, count(*) AS sessions, sum(n)::BIGINT AS events, max(n)::BIGINT AS longest FROM c GROUP BY 1""",
    "class_margins": f"""WITH p AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE label IN (SELECT label FROM embeddings GROUP BY 1 HAVING count(*) >= 20)),
m AS (SELECT label, i, avg(x) AS x FROM p GROUP BY 1, 2), u AS (SELECT label, i, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM m), c AS (SELECT label, list(x ORDER BY i) AS c FROM u GROUP BY 1),
s AS (SELECT e.vec_id, e.label, c.label AS k, list_dot_product(e.embedding::DOUBLE[], c.c) AS s FROM embeddings e, c),
g AS (SELECT vec_id, max(s) FILTER (k = label) AS own, max(s) FILTER (k <> label) AS other, sum(exp(5 * s)) AS z, sum(exp(5 * s) * 5 * s) AS e, count(*) AS n FROM s GROUP BY vec_id, label)
SELECT vec_id, {r('own', 'own')}, {r('other', 'other')}, {r('other - own', 'margin')}, {r('(ln(z) - e / z) / ln(greatest(n, 2))', 'disorder')} FROM g WHERE own IS NOT NULL""",
    "scoring_maps": f"""WITH x AS (SELECT event_id, value AS v, value / 500 AS x, (event_id % 97) / 97 AS p, event_type FROM events),
y AS (SELECT *, CASE WHEN event_type <> 'click' THEN p END AS p2 FROM x), t AS (SELECT *, 0.5 + CASE WHEN p2 IS NULL THEN 0 ELSE 0.3 END + 0.2 AS w FROM y)
SELECT event_id, {r('1 / (1 + exp(-least(60.0, greatest(-60.0, (v - 100) / 20))))', 'sig')}, {r('ln(1 + exp(least(60.0, greatest(-60.0, (v - 100) / 20))))', 'soft')}, {r('greatest(v - 50, 0) / (greatest(v - 50, 0) + 40)', 'risk')}, {r('5 * pow(1 - least(1.0, greatest(0.0, x)), 1.5)', 'quality')},
 {r('1 - (1 - least(1.0, x) * 0.5 / w) * (CASE WHEN p2 IS NULL THEN 1 ELSE 1 - p2 * 0.3 / w END) * (1 - p * p * 0.2 / w)', 'noisy')}, {r('0.25 * p * (0.5 + 0.5 * least(1.0, x))', 'penalty')}, least(5, greatest(0, round_even(x * 6 - 0.5, 0)))::INT AS score,
 CASE WHEN p >= 0.99 THEN 5 WHEN p >= 0.95 THEN 4 WHEN p >= 0.9 THEN 3 WHEN p >= 0.8 THEN 2 WHEN p >= 0.6 THEN 1 ELSE 0 END AS pass_bucket, CASE WHEN p >= 0.95 THEN 5 WHEN p >= 0.85 THEN 4 WHEN p >= 0.7 THEN 3 WHEN p >= 0.5 THEN 2 WHEN p >= 0.3 THEN 1 ELSE 0 END AS relaxed_bucket,
 CASE WHEN p >= 0.9 THEN 5 WHEN p >= 0.8 THEN 4 WHEN p >= 0.7 THEN 3 WHEN p >= 0.55 THEN 2 WHEN p >= 0.4 THEN 1 ELSE 0 END AS good_bucket, CASE WHEN p >= 1 THEN 5 WHEN p >= 0.9 THEN 4 WHEN p >= 0.8 THEN 3 WHEN p >= 0.7 THEN 2 WHEN p >= 0.6 THEN 1 ELSE 0 END AS gate_score,
 CASE WHEN p <= 0.02 THEN 5 WHEN p <= 0.05 THEN 4 WHEN p <= 0.1 THEN 3 WHEN p <= 0.2 THEN 2 WHEN p <= 0.4 THEN 1 ELSE 0 END AS inverse, {r('CASE WHEN v BETWEEN 0 AND 1 THEN v WHEN v > 1 AND v <= 100 THEN v / 100 END', 'rate')},
 {r('CASE WHEN p >= 0.05 THEN 0 WHEN p >= 0.02 THEN 1 ELSE 4 END', 'guarded')}, {r('CASE WHEN p > 0.5 THEN 0.7 * x + 0.3 * p ELSE x END', 'wmean')}, {r('least(5, greatest(0, CASE WHEN abs(5 * x - 5 * p) <= 1 THEN least(5 * x, 5 * p) + 1 ELSE least(5 * x, 5 * p) END))', 'minplus')},
 {r('least(5, greatest(0, (5 * x + 5 * p) / 2 - least(5, 0.5 * ((x <= 0)::INT + (p <= 0)::INT))))', 'zeropen')}, {r('least(0.6 * 5 * x + 0.4 * 5 * p, least(5 * x, 5 * p) + 1)', 'gmean')},
 CASE WHEN p2 IS NULL THEN '#9ca3af' ELSE printf('#%02x%02x00', round_even(CASE WHEN p <= 0.5 THEN 255 ELSE 255 * (1 - (p - 0.5) / 0.5) END, 0)::INT, round_even(CASE WHEN p <= 0.5 THEN 255 * p / 0.5 ELSE 255 END, 0)::INT) END AS colour, {r('v + 3.5 * x', 'k_up')} FROM t""",
}



def capped_z(c: str, table: str) -> str:
    """(vec_id, z): robust z of a column over all rows, held to 30."""
    return f"""(SELECT vec_id, greatest(-30.0, least(30.0, ({c} - m) / (1.4826 * s + 1e-9))) AS z
  FROM {table}, (SELECT median({c}) AS m FROM {table}), (SELECT median(abs({c} - m)) AS s FROM {table}, (SELECT median({c}) AS m FROM {table})))"""


SIMS = ORACLES["class_margins"].rpartition("\nSELECT vec_id, ")[0].replace("SELECT vec_id, max(s) FILTER (k = label)", "SELECT vec_id, label, max(s) FILTER (k = label)")
SIMS += """, sims AS (SELECT vec_id, label, own, other - own AS margin, (ln(z) - e / z) / ln(greatest(n, 2)) AS disorder FROM g WHERE own IS NOT NULL),
parts AS (SELECT *, greatest(0.0, margin * greatest(0.0, 1 - own)) AS severity, 1 - own AS off, abs(own - median(own) OVER (PARTITION BY label)) AS apart FROM sims)"""
ORACLES["contradiction"] = f"""{SIMS} SELECT vec_id, round(0.7 * a.z + 0.3 * b.z, 4) AS contradiction FROM {capped_z('margin', 'parts')} a JOIN {capped_z('severity', 'parts')} b USING (vec_id)"""
ORACLES["discourse_instability"] = f"""{SIMS} SELECT vec_id, round((0.4 * a.z + 0.6 * b.z + 0.25 * c.z) / 1.25, 4) AS discourse
FROM {capped_z('off', 'parts')} a JOIN {capped_z('disorder', 'parts')} b USING (vec_id) JOIN {capped_z('apart', 'parts')} c USING (vec_id)"""
ORACLES["cosine_residuals"] = f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.vec_id // 2 AS id, list_cosine_similarity(a.v, b.v) AS c FROM e a JOIN e b ON a.vec_id % 2 = 0 AND b.vec_id = a.vec_id + 1)
SELECT id, {r('1 - c', 'residual')}, {r('acos(c)', 'angle')} FROM p"""


def positive_z(table: str, by: str, v: str, name: str) -> str:
    """CTE of rows with zp, the positive robust z of a column in its group."""
    return f"""{name} AS (SELECT *, greatest(0.0, ({v} - m) / (1.4826 * s + 1e-9)) AS zp
  FROM (SELECT *, median(abs({v} - m)) OVER (PARTITION BY {by}) AS s FROM (SELECT *, median({v}) OVER (PARTITION BY {by}) AS m FROM {table})))"""


def soft(x: str, width: float = 0.6) -> str:
    return f"(1 / (1 + exp(-least(60.0, ({x}) / {width}))))"


def plus(x: str) -> str:
    return f"ln(1 + exp(least(60.0, ({x}) / 0.8)))"


def unit_risk(x: str) -> str:
    return f"least(1.0, greatest(0.0, {x}))"


ORACLES["diag_quadrants"] = f"""WITH {positive_z('lineitem', 'l_returnflag', 'l_extendedprice', 'a')}, a2 AS (SELECT * EXCLUDE (m, s, zp), {soft('zp - 2')} AS p FROM a), {positive_z('a2', 'l_returnflag', 'l_quantity', 'b')},
x AS (SELECT l_returnflag, p, {soft('zp - 2')} AS q FROM b), g AS (SELECT l_returnflag, avg((1 - p) * (1 - q)) AS q00, avg(p * (1 - q)) AS q10, avg((1 - p) * q) AS q01, avg(p * q) AS q11 FROM x GROUP BY 1),
h AS (SELECT *, {unit_risk('q10 + q01 + q11')} AS rate, {unit_risk('q11 + 0.5 * least(q10, q01)')} AS mass FROM g)
SELECT l_returnflag, {', '.join(r(c, c) for c in ('q00', 'q10', 'q01', 'q11', 'rate', 'mass'))}, {r('1 - (1 - rate * 0.55 / 0.85) * (1 - mass * 0.3 / 0.85)', 'risk')} FROM h"""
ORACLES["bundle_axes"] = f"""WITH {positive_z('events', 'event_type', 'value', 'a')}, x AS (SELECT event_type, zp, {soft('zp - 2')} AS pf, {soft('zp - 3.5')} AS ph FROM a),
c AS (SELECT event_type, median(zp) AS cm FROM (SELECT *, quantile_cont(zp, 0.7) OVER (PARTITION BY event_type) AS q FROM x) WHERE zp <= q GROUP BY 1),
k AS (SELECT event_type, median(abs(zp - cm)) AS mad FROM (SELECT *, quantile_cont(zp, 0.7) OVER (PARTITION BY event_type) AS q FROM x) JOIN c USING (event_type) WHERE zp <= q GROUP BY 1),
g AS (SELECT event_type, count(*) AS n, avg(pf) AS p_fail, avg(ph) AS p_hard, avg({plus('zp - 2')}) + 3 * avg({plus('zp - 3.5')}) AS mass FROM x GROUP BY 1),
h AS (SELECT *, {unit_risk('p_fail + 8 * p_hard')} AS r_rate, mass / (mass + 0.5) AS r_mass, mad / (mad + 0.5) AS r_core FROM g JOIN k USING (event_type)),
o AS (SELECT *, {unit_risk('1 - (1 - r_core * 0.15) * (1 - r_rate * 0.55) * (1 - r_mass * 0.3) + 0.25 * p_hard * (0.5 + 0.5 * r_mass)')} AS risk FROM h)
SELECT event_type, n, {', '.join(r(c, c) for c in ('p_fail', 'p_hard', 'r_rate', 'r_mass', 'r_core', 'risk'))}, {r('5 * (1 - risk)', 'quality')} FROM o"""

# Instruction checks: a blank response follows none.
_W = "[\\p{L}\\p{N}_]+"
def language(t: str) -> str:
    """The language most of whose frequent words a text holds; ties go to the later code."""
    from gatelens.operators.gates import STOP_WORDS

    words = f"list_distinct(regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}_]+'))"
    held = ", ".join(f"{{'n': len(list_intersect({words}, [{', '.join(repr(w) for w in sorted(set(ws)))}])), 'k': '{k}'}}" for k, ws in STOP_WORDS.items())
    return f"list_max([{held}])"


_COUNT = "len(regexp_extract_all(text, '{}'))"
_CHECKS = {
    "instr_keyword_existence": "regexp_matches(lower(text), 'the') AND regexp_matches(lower(text), 'and')",
    "instr_keyword_frequency": "len(regexp_extract_all(lower(text), 'th')) >= 20",
    "instr_letter_frequency": "length(lower(text)) - length(replace(lower(text), 'e', '')) < 100",
    "instr_number_words": f"{_COUNT.format(_W)} >= 150",
    "instr_constrained": "contains(text, 'MIT License') OR contains(text, 'the. ')",
    "instr_sections": f"{_COUNT.format('555-[0-9]+')} >= 1",
    "instr_repeat_prompt": "starts_with(lower(trim(text)), 'the')",
    "instr_end": "ends_with(lower(regexp_replace(trim(text), '^\"+|\"+$', '', 'g')), 'the.')",
    "instr_upper": f"upper(text) = text AND regexp_matches(text, '\\p{{Lu}}') AND ({language('text')}.n = 0 OR {language('text')}.k = 'en')",
    "instr_lower": f"lower(text) = text AND regexp_matches(text, '\\p{{Ll}}') AND ({language('text')}.n = 0 OR {language('text')}.k = 'en')",
    "instr_language": f"{language('text')}.n = 0 OR {language('text')}.k = 'en'",
    "instr_no_comma": "NOT contains(text, ',')",
    "instr_quotation": "length(trim(text)) > 1 AND starts_with(trim(text), '\"') AND ends_with(trim(text), '\"')",
    "instr_placeholders": f"{_COUNT.format('\\[[^\\n]*?\\]')} >= 1",
    "instr_title": "regexp_matches(text, '<<[^\\n<>]*[^\\s<>][^\\n<>]*>>')",
    "instr_highlights": f"{_COUNT.format('\\*[^\\n*]*[^\\n*\\s][^\\n*]*\\*')} >= 1",
    "instr_bullets": f"{_COUNT.format('(?m)^[ \\t]*\\*[^*\\n]')} + {_COUNT.format('(?m)^[ \\t]*-[^\\n]')} = 0",
    "instr_start": "regexp_matches(text, '(?m)^\\s*The.*$')",
    "instr_rephrase": "regexp_replace(text, '\\*[^\\n*]*\\*', '', 'g') = 'The  text'",
    "instr_key_sentences": "contains(text, 'Released under the MIT License.')::INT + contains(text, 'the.')::INT = 1",
    "instr_forbidden_words": "NOT (list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), 'idiot') OR list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), 'moron'))",
    "instr_overlap": "least(len(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda x: x = 'the')), 2) + " + " + ".join(f"least(len(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda x: x = '{w}')), 1)" for w in ("of", "and", "to")) + " BETWEEN 3 AND 5",
    "instr_number_paragraphs": "len(list_filter(string_split_regex(text, '\\s?\\*\\*\\*\\s?')[2:-2], lambda p: trim(p) = '')) = 0 AND len(list_filter(string_split_regex(text, '\\s?\\*\\*\\*\\s?'), lambda p: trim(p) <> '')) = 1",
    "instr_first_word": "len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: trim(p) <> '')) = 1 AND lower(regexp_extract(trim(string_split(text, chr(10) || chr(10))[1]), '^[''\"]*([^\\s.,?!''\"]*)', 1)) = 'the'",
    "instr_two_responses": "len(list_filter(string_split(text, '******'), lambda p: trim(p) <> '')) = 2 AND len(list_distinct(list_transform(list_filter(string_split(text, '******'), lambda p: trim(p) <> ''), lambda p: trim(p)))) = 2",
    "instr_postscript": "regexp_matches(lower(text), 'p\\.\\s?s\\.')",
}
for _name, _test in _CHECKS.items():
    ORACLES[_name] = f"SELECT doc_id, trim(text) <> '' AND ({_test}) AS ok FROM documents"
