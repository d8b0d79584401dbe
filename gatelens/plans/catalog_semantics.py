"""Queries of templates and of semantic signals: documents and their labels stand for structured outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatelens.functions import vectors as V
from gatelens.operators import semantics, signals, templates
from gatelens.plans.catalog import T, emb, query, r
from gatelens.plans.oracles import ORACLES
from gatelens.plans.oracles import r as q


def outputs(spark, d):
    """(event_id, j): a verdict, a number, an id and two texts for each event."""
    e = T(spark, d, "events")
    note = F.when(F.pmod("event_id", F.lit(10)) > 0, F.concat_ws(" ", F.col("event_type"), F.lit("because of"), F.col("props"), F.lit("and more")))
    j = F.to_json(F.struct(F.col("event_type").alias("verdict"), (F.col("value") / 1000).alias("score"), F.col("event_id").alias("label"), F.when(F.pmod("event_id", F.lit(3)) == 0, F.lit("true")).alias("decision"), note.alias("reason"), F.lit("ok").alias("comment")))
    return e.select("event_id", j.alias("j"))


@query
def verdict_keys(spark, d):
    x = semantics.key_scores(outputs(spark, d), "j", semantics.VERDICT_KEYS, "scalar")
    return x.select("key", "place", r("support"), r("info"), r("score"))


ORACLES["verdict_keys"] = f"""WITH o AS (SELECT event_type AS verdict, value / 1000 AS score, event_id AS label, CASE WHEN event_id % 3 = 0 THEN 'true' END AS decision FROM events), n AS (SELECT count(*) AS n FROM o),
ev AS (SELECT verdict AS v, count(*) AS c FROM o GROUP BY 1), eh AS (SELECT -sum(c / n * ln(c / n)) / ln(count(*)) AS h, count(*) AS k FROM ev, n),
nq AS (SELECT 'score' AS key, quantile_cont(score, [0, 0.1, 0.25, 0.5, 0.75, 0.9, 1]) AS q FROM o UNION ALL SELECT 'label', quantile_cont(label::DOUBLE, [0, 0.1, 0.25, 0.5, 0.75, 0.9, 1]) FROM o),
nv AS (SELECT 'score' AS key, score AS x FROM o UNION ALL SELECT 'label', label FROM o), nb AS (SELECT key, (x >= q[3])::INT + (x >= q[4])::INT + (x >= q[5])::INT AS b, count(*) AS c FROM nv JOIN nq USING (key) GROUP BY 1, 2),
nh AS (SELECT key, -sum(c / n * ln(c / n)) / ln(count(*)) AS h FROM nb, n GROUP BY 1)
SELECT 'verdict' AS key, 4 AS place, 1.0::DOUBLE AS support, {q('h', 'info')}, {q('1 + 0.2 * h', 'score')} FROM eh
UNION ALL SELECT key, CASE key WHEN 'score' THEN 5 ELSE 2 END, 1.0::DOUBLE, {q('least(1, 0.8 * h + 0.2 * least(1, q[6] - q[2]))', 'info')}, {q('1 + 0.2 * least(1, 0.8 * h + 0.2 * least(1, q[6] - q[2]))', 'score')} FROM nh JOIN nq USING (key)
UNION ALL SELECT 'decision', 1, {q('count(decision) / count(*)', 'support')}, 0.0::DOUBLE, {q('count(decision) / count(*)', 'score')} FROM o"""


@query
def evidence_keys(spark, d):
    x = semantics.key_scores(outputs(spark, d), "j", semantics.EVIDENCE_KEYS, "text")
    return x.select("key", "place", r("support"), r("info"))


ORACLES["evidence_keys"] = f"""WITH o AS (SELECT event_id, event_type || ' because of ' || props || ' and more' AS t FROM events), k AS (SELECT event_id, len(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]+')) AS k FROM o WHERE event_id % 10 > 0), n AS (SELECT count(*) AS n FROM o)
SELECT 'reason' AS key, 3 AS place, {q('count(*) / any_value(n)', 'support')}, {q('least(1, greatest(0, (median(k) - 2) / 12))', 'info')} FROM k, n"""


@query
def verdict_bins(spark, d):
    x = semantics.verdicts(outputs(spark, d).select("event_id", semantics.value_of(F.col("j"), "score").alias("v")), "v")
    return x.groupBy("class", "class_name").agg(F.count("*").alias("n"))


ORACLES["verdict_bins"] = "WITH o AS (SELECT value / 1000 AS x FROM events), e AS (SELECT quantile_cont(x, 1 / 3) AS a, quantile_cont(x, 2 / 3) AS b FROM o) SELECT ((x >= a)::INT + (x >= b)::INT) AS class, 'bin_' || ((x >= a)::INT + (x >= b)::INT) AS class_name, count(*) AS n FROM o, e GROUP BY 1, 2".replace("quantile_cont(x, 1 / 3)", "quantile_cont(x, 0.3333333333333333)").replace("quantile_cont(x, 2 / 3)", "quantile_cont(x, 0.6666666666666666)")


@query
def verdict_classes(spark, d):
    x = semantics.verdicts(T(spark, d, "events"), "event_type", 3)
    return x.groupBy("class", "class_name").agg(F.count("*").alias("n"))


ORACLES["verdict_classes"] = "WITH c AS (SELECT event_type AS v, count(*) AS n FROM events GROUP BY 1), t AS (SELECT *, row_number() OVER (ORDER BY n DESC, v) - 1 AS k FROM c) SELECT CASE WHEN k < 3 THEN k END::INT AS class, CASE WHEN k < 3 THEN v END AS class_name, sum(n)::BIGINT AS n FROM t GROUP BY 1, 2"


@query
def self_contradiction(spark, d):
    """Rows are blocks of four vectors, their segments; the class is the block's smallest label."""
    e = emb(spark, d).withColumn("id", F.floor(F.col("vec_id") / 4).cast("long")).withColumn("place", F.pmod("vec_id", F.lit(4)).cast("int"))
    rows = e.groupBy("id").agg(F.min("label").alias("label"), F.min_by("v", "place").alias("v"))
    cents = signals.centroids(emb(spark, d), "label", "v")
    sims = signals.class_similarities(rows, cents, "id", "label", "v")
    return semantics.self_contradiction(sims, e.select("id", "place", "v"), cents, "id", "label").select("id", F.round("self_contradiction", 4).alias("self_contradiction"))


def capped(c: str) -> str:
    return f"(SELECT id, greatest(-30.0, least(30.0, ({c} - (SELECT median({c}) FROM raw)) / (1.4826 * (SELECT median(abs({c} - (SELECT median({c}) FROM raw))) FROM raw) + 1e-9))) AS z FROM raw)"


ORACLES["self_contradiction"] = f"""WITH e AS (SELECT vec_id, vec_id // 4 AS id, label, embedding::DOUBLE[] AS v FROM embeddings), big AS (SELECT label FROM e GROUP BY 1 HAVING count(*) >= 20),
p AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e WHERE label IN (FROM big)), m AS (SELECT label, i, avg(x) AS x FROM p GROUP BY 1, 2), cu AS (SELECT label, i, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM m), c AS (SELECT label AS k, list(x ORDER BY i) AS c FROM cu GROUP BY 1),
r AS (SELECT id, min(label) AS label, arg_min(v, vec_id) AS v FROM e GROUP BY 1), s AS (SELECT id, label, k, list_dot_product(v, c) AS s FROM r, c), g AS (SELECT id, label, max(s) FILTER (k = label) AS own, max(s) FILTER (k <> label) AS other FROM s GROUP BY 1, 2),
t AS (SELECT e.id, vec_id, g.label, v FROM e JOIN g ON g.id = e.id AND g.own IS NOT NULL QUALIFY count(*) OVER (PARTITION BY e.id) >= 2),
d AS (SELECT a.id, greatest(0, 1 - avg(list_cosine_similarity(a.v, b.v))) AS spread FROM t a JOIN t b ON a.id = b.id AND a.vec_id < b.vec_id GROUP BY 1),
f AS (SELECT id, avg((other > own)::INT) AS flip FROM (SELECT id, vec_id, max(list_cosine_similarity(v, c)) FILTER (k = label) AS own, max(list_cosine_similarity(v, c)) FILTER (k <> label) AS other FROM t, c GROUP BY 1, 2) GROUP BY 1),
raw AS (SELECT id, other - own AS margin, coalesce(spread, 0) AS spread, coalesce(flip, 0) AS flip FROM g LEFT JOIN d USING (id) LEFT JOIN f USING (id) WHERE own IS NOT NULL)
SELECT id, round((a.z + 0.3 * b.z + 0.15 * c.z) / 1.45, 4) AS self_contradiction FROM {capped('margin')} a JOIN {capped('spread')} b USING (id) JOIN {capped('flip')} c USING (id)"""


@query
def semantic_pack(spark, d):
    """Availability of the semantic signals of events' outputs under hashed vectors."""
    x, _ = semantics.pack(outputs(spark, d), "event_id", "j", signals.hash_embed_768, min_tokens=2)
    return x.groupBy("discourse_available", "contradiction_available", "self_contradiction_available", "consistency").agg(F.count("*").alias("n"))


ORACLES["semantic_pack"] = "SELECT event_id % 10 > 0 AS discourse_available, event_id % 10 > 0 AS contradiction_available, event_id % 10 > 0 AS self_contradiction_available, 0.0::DOUBLE AS consistency, count(*) AS n FROM events GROUP BY 1, 2, 3"


# templates ------------------------------------------------------------------------------------------------------------
def forms(spark, d):
    """(event_id, g, t): letters of one wording a group, of different lengths in their last part."""
    e = T(spark, d, "events").withColumn("g", F.pmod("user_id", F.lit(4)))
    return e.select("event_id", "g", F.concat(F.lit("Dear reader of page "), F.col("event_type"), F.lit(": thank you for the note"), F.when(F.col("g") == 0, F.concat(F.lit(" number "), F.col("event_id").cast("string"))).otherwise("")).alias("t"))


@query
def structural_templates(spark, d):
    x = templates.structural(forms(spark, d), ["g"], "event_id", "t", 3, 4)
    return x.select("g", "n", "gram", "docs", r("spread"))


ORACLES["structural_templates"] = f"""WITH f AS (SELECT event_id, user_id % 4 AS g, regexp_extract_all(lower('Dear reader of page ' || event_type || ': thank you for the note' || CASE WHEN user_id % 4 = 0 THEN ' number ' || event_id ELSE '' END), '[\\p{{L}}\\p{{N}}_]+') AS w FROM events),
p AS (SELECT event_id, g, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram, (i - 1) / len(w) AS pos FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM f, (VALUES (3), (4)) v(n) WHERE len(w) >= n)),
a AS (SELECT event_id, g, n, gram, min(pos) AS pos FROM p GROUP BY 1, 2, 3, 4), c AS (SELECT g, count(*) AS c FROM f GROUP BY 1)
SELECT g, n, gram, count(*) AS docs, {q('stddev_pop(pos)', 'spread')} FROM a JOIN c USING (g) GROUP BY g, n, gram, c HAVING count(*) >= greatest(2, floor(c * 0.7)) AND stddev_pop(pos) < 0.05"""


@query
def masked_templates(spark, d):
    x = templates.masked(forms(spark, d), ["g"], "event_id", "t", 3, 4)
    return x.select("event_id", "masked", r("coverage"), "is_template")




@query
def padded_coordinates(spark, d):
    """Two coordinates of each vector; short ones are filled with zeros."""
    e = emb(spark, d).withColumn("v", F.slice("v", 1, F.pmod("vec_id", F.lit(4)).cast("int")))
    return e.select("vec_id", r(V.coordinate("v", 1), "x"), r(V.coordinate("v", 2), "y"))


ORACLES["padded_coordinates"] = f"SELECT vec_id, {q('CASE WHEN vec_id % 4 >= 1 THEN embedding[1] ELSE 0 END', 'x')}, {q('CASE WHEN vec_id % 4 >= 2 THEN embedding[2] ELSE 0 END', 'y')} FROM embeddings"
