"""Queries by name over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatelens.functions import scalar as S
from gatelens.functions import vectors as V
from gatelens.operators import gates, relational, ridge, scoring, signals, stats, thresholds, windows
from gatelens.sources import tables
from gatelens.streaming import monitor

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
DIGITS = 6


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r(c, name: str | None = None) -> Column:
    """Rounded, as sums differ in their last digits by order; no negative zero."""
    out = F.round(S.col(c).cast("double"), DIGITS) + F.lit(0.0)
    return out.alias(name or (c if isinstance(c, str) else "value"))


def T(spark: SparkSession, d: str, name: str) -> DataFrame:
    return tables.read_table(spark, d, name)


def z_events(spark: SparkSession, d: str) -> DataFrame:
    return stats.robust_z(T(spark, d, "events").select("event_id", "user_id", "event_type", "value", "ts"), ["event_type"], "value")


# statistics -----------------------------------------------------------------------------------------------------------
@query
def robust_z_events(spark, d):
    c = stats.center(T(spark, d, "events"), ["event_type"], "value")
    z = z_events(spark, d).withColumn("st", S.z_state("z", F.lit(2.0), F.lit(3.5)))
    n = z.groupBy("event_type").agg(*[F.count_if(F.col("st") == k).alias(f"n_{s}") for k, s in ((0, "pass"), (1, "fail"), (2, "hard"))])
    return c.join(n, "event_type").select("event_type", "n", r("median"), r("mad"), "n_pass", "n_fail", "n_hard")


@query
def robust_z_rows(spark, d):
    return z_events(spark, d).select("event_id", r("z"))


@query
def scale_ladder_by_returnflag(spark, d):
    x = stats.scale_ladder(T(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return x.select("l_returnflag", "n", r("median"), r("sigma"), "source")


@query
def scale_ladder_flat(spark, d):
    x = T(spark, d, "lineitem").withColumn("v", F.when(F.col("l_linenumber") <= 5, 0.0).otherwise(F.col("l_quantity")))
    return stats.scale_ladder(x, ["l_linestatus"], "v").select("l_linestatus", "n", r("median"), r("sigma"), "source")


@query
def weighted_quantile_price(spark, d):
    x = T(spark, d, "lineitem").withColumn("k", F.col("l_orderkey") * 100 + F.col("l_linenumber"))
    x = stats.weighted_quantile(x, ["l_returnflag"], "l_extendedprice", "l_quantity", [0.1, 0.5, 0.9], "k")
    return x.select("l_returnflag", "q", r("value"))


@query
def boxplot_orders(spark, d):
    x = stats.boxplot(T(spark, d, "orders"), ["o_orderpriority"], "o_totalprice")
    return x.select("o_orderpriority", "n", *[r(c) for c in ("low", "q1", "med", "q3", "high", "iqr", "whisker_low", "whisker_high")], "outliers")


@query
def signal_histogram(spark, d):
    x = stats.histogram(T(spark, d, "events"), "value", 60, F.col("event_type") == "click")
    return x.select("bin", r("left_edge"), r("right_edge"), F.col("n").cast("long"), F.col("n_marked").cast("long"))


def labelled(spark, d):
    lab = T(spark, d, "labels").select("doc_id", "quality", "toxic")
    return T(spark, d, "documents").select("doc_id", "lang", "n_chars").join(lab, "doc_id", "left").withColumn("bad", F.col("quality") == 0).withColumn("pred", F.coalesce(F.col("toxic") == 1, F.lit(False)))


@query
def confusion_quality(spark, d):
    return stats.confusion(labelled(spark, d), "bad", "pred").select("tp", "fp", "tn", "fn", *[r(c) for c in ("precision", "recall", "f1", "fpr", "bad_rate")])


@query
def confusion_by_lang(spark, d):
    return stats.confusion(labelled(spark, d), "bad", "pred", ["lang"]).select("lang", "tp", "fp", "tn", "fn", *[r(c) for c in ("precision", "recall", "f1", "fpr", "bad_rate")])


@query
def tristate_quality(spark, d):
    x = thresholds.tristate(labelled(spark, d).where("bad is not null"), "lang", "n_chars", 0.8, 0.95)
    return stats.tristate_quality(x, "bad", "state").select("n", "n_bad", "n_pass", "n_warn", "n_fail", *[r(c) for c in ("fail_precision", "fail_recall", "warn_bad_rate", "pass_bad_rate", "warn_lift", "warn_coverage")])


@query
def group_global_quantiles(spark, d):
    x = stats.group_and_global(T(spark, d, "events"), "event_type", "value", [0.5, 0.9, 0.99])
    return x.select("event_type", "is_global", "n", r("q0"), r("q1"), r("q2"))


@query
def group_threshold_fallback(spark, d):
    e = T(spark, d, "events").withColumn("g", F.pmod(F.col("user_id"), F.lit(40)))
    th = stats.group_and_global(e, "g", "value", [0.9])
    x = stats.with_group_threshold(e, th, "g", 240)
    return x.groupBy("g").agg(F.count("*").alias("n"), r(F.max("threshold"), "threshold"), F.count_if(F.col("value") > F.col("threshold")).alias("n_over"))


@query
def type_entropy(spark, d):
    return stats.entropy(T(spark, d, "events"), ["user_id"], "event_type").select("user_id", "kinds", r("entropy"))


@query
def duplicate_rate(spark, d):
    x = stats.duplicate_rate(T(spark, d, "documents"), "text")
    return x.select("n", "n_distinct", r("repeat_rate"))


@query
def top_repeats(spark, d):
    return stats.top_repeats(T(spark, d, "documents"), "text")


@query
def min_max_scale(spark, d):
    w = Window.partitionBy("event_type")
    lo, hi = F.min("value").over(w), F.max("value").over(w)
    return T(spark, d, "events").select("event_id", r(F.when(hi > lo, (F.col("value") - lo) / (hi - lo)).otherwise(0.5), "scaled"))


# windows --------------------------------------------------------------------------------------------------------------
@query
def soft_weights(spark, d):
    return windows.soft_weights(T(spark, d, "events"), ["event_type"], "value", "event_id").select("event_id", r("weight"))


@query
def gap_jump(spark, d):
    return windows.gap_jump(z_events(spark, d), ["event_type"], "z", "event_id").select("event_type", r("jump"), r("gap_z"), "kind")


@query
def tail_start_curvature(spark, d):
    return windows.tail_start(z_events(spark, d), ["event_type"], "z").select("event_type", F.col("points").cast("long"), r("knee"))


@query
def log_survival_grid(spark, d):
    g = windows.log_survival(z_events(spark, d), ["event_type"], "z", 40, F.min("_v"), F.max("_v"))
    return g.select("event_type", "i", r("x"), r("survival"), r("smooth"), r("d1"), r("d2"))


@query
def flat_runs(spark, d):
    x = T(spark, d, "events").withColumn("day", F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - 1704067200) / 86400).cast("int"))
    x = stats.sum_in_order(x, ["user_id", "day"], "value", "event_id", "v")
    x = x.withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("day"))).withColumn("x", F.col("day"))
    return windows.first_flat_run(x, ["user_id"], F.col("v") < 120, 3).select("user_id", "start", "x")


@query
def rolling_jump(spark, d):
    x = T(spark, d, "events").groupBy("event_type", F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - 1704067200) / 86400).cast("int").alias("day")).agg(F.round(F.sum("value"), 4).alias("v"))
    return windows.rolling_jump(x, ["event_type"], "v", "day").select("event_type", "at", r("rise"))


@query
def zero_neighbours(spark, d):
    x = T(spark, d, "customer").withColumn("v", F.col("c_acctbal"))
    return windows.neighbour_of_zero(x, ["c_mktsegment"], "v").select("c_mktsegment", r("next_up"), r("next_down"))


@query
def stratified_folds(spark, d):
    return windows.folds(T(spark, d, "labels").where("quality is not null"), "quality", "doc_id").select("doc_id", F.col("fold").cast("int"))


@query
def group_ordinals(spark, d):
    x = windows.group_ids(T(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey")
    return x.select("o_orderkey", "group_id", "group_size")


@query
def row_positions(spark, d):
    return tables.with_row_index(T(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey").select("c_custkey", "row_index")


# predicates, maps, states ---------------------------------------------------------------------------------------------
@query
def lenient_labels(spark, d):
    x = T(spark, d, "lineitem")
    flag = F.concat(F.lit(" "), F.element_at(F.array(*map(F.lit, ("TRUE", "yes", "1", "no", "Y", "maybe"))), (F.pmod("l_orderkey", F.lit(6)) + 1).cast("int")), F.lit(" "))
    return x.select("l_orderkey", "l_linenumber", S.lenient_bool(flag).alias("strict_flag"), S.lenient_bool(flag, S.TRUE_WORDS_YN).alias("yn_flag"), S.label_value(flag, ("true", "yes"), ("no",)).alias("label"), S.is_bad(flag, "no").alias("bad"))


@query
def scoring_maps(spark, d):
    v = F.col("value")
    x = v / 500
    p = F.pmod("event_id", F.lit(97)) / 97
    return T(spark, d, "events").select(
        "event_id", r(S.sigmoid((v - 100) / 20), "sig"), r(S.softplus((v - 100) / 20), "soft"), r(S.risk_from_scale(v - 50, 40.0), "risk"), r(S.quality_from_risk(x, 1.5), "quality"),
        r(S.noisy_or([(x, 0.5), (F.when(F.col("event_type") != "click", p), 0.3), (p * p, 0.2)]), "noisy"), r(S.hard_tail_penalty(p, x), "penalty"), S.score(x * 6 - 0.5).alias("score"), S.bucket(p, S.PASS_RATE).alias("pass_bucket"),
        S.bucket(p, S.RELAXED).alias("relaxed_bucket"), S.bucket(p, S.GOOD_RATIO).alias("good_bucket"), S.bucket(p, S.HARD_GATE).alias("gate_score"), S.inverse_bucket(p, (0.02, 0.05, 0.1, 0.2, 0.4)).alias("inverse"), r(S.rate(v), "rate"),
        r(S.guard_catastrophic(F.lit(4.0), p), "guarded"), r(S.weighted_mean([(x, 0.7), (F.when(p > 0.5, p), 0.3)]), "wmean"), r(S.min_plus_consistency([x * 5, p * 5]), "minplus"), r(S.zero_penalty([x * 5, p * 5], 0.5), "zeropen"),
        r(S.guarded_mean([(x * 5, 0.6), (p * 5, 0.4)], 1.0), "gmean"), S.confidence_colour(F.when(F.col("event_type") != "click", p * 5)).alias("colour"), r(S.k_threshold(v, x, 3.5), "k_up"),
    )


@query
def tail_triggers(spark, d):
    z = z_events(spark, d)
    up, low, two = S.tail_trigger("z", "upper", threshold=F.lit(2.5)), S.tail_trigger("z", "lower", threshold=F.lit(-0.6)), S.tail_trigger("z", "two_sided", low=F.lit(-0.6), high=F.lit(2.5))
    return z.groupBy("event_type").agg(F.count_if(up).alias("upper"), F.count_if(low).alias("lower"), F.count_if(two).alias("two_sided"), F.count_if(S.quantile_pass("z", F.lit(1.0), F.col("value") > 5)).alias("passes"))


@query
def state_machine_events(spark, d):
    z = z_events(spark, d).withColumn("state", S.four_state(F.pmod("user_id", F.lit(7)) != 0, F.col("z") >= 1, F.col("z") >= 2, F.col("z") >= 4))
    return z.groupBy("event_type", "state").agg(F.count("*").alias("n"))


@query
def distribution_rollup(spark, d):
    z = z_events(spark, d).withColumn("st", S.z_state("z", F.lit(2.0), F.lit(4.0)))
    g = z.groupBy("user_id").agg(F.bool_or(F.col("st") == 1).alias("any_fail"), F.bool_or(F.col("st") == 2).alias("any_hard"), F.bool_and(F.col("st") == 0).alias("all_pass"), F.count("*").alias("n"))
    return g.withColumn("final_state", S.four_state(F.col("n") >= 20, F.lit(False), F.col("any_fail") | F.col("any_hard"), F.col("any_hard")))


@query
def state_rates(spark, d):
    z = z_events(spark, d).withColumn("state", S.four_state(F.lit(True), F.col("z") >= 1, F.col("z") >= 2, F.col("z") >= 4))
    x = scoring.state_rates(z, ["event_type"])
    return x.select("event_type", "n", *[r(f"{s}_rate") for s in ("pass", "warn", "fail", "hard_fail")])


# joins, top-k, sets ---------------------------------------------------------------------------------------------------
@query
def label_lookup_last_wins(spark, d):
    e = T(spark, d, "events").select(F.concat(F.lit("'"), F.col("user_id").cast("string"), F.lit("' ")).alias("uid"), "event_type", "event_id")
    users = T(spark, d, "customer").select(F.concat(F.lit(" "), F.col("c_custkey").cast("string")).alias("cid"))
    return relational.label_lookup(users, e, "cid", "uid", "event_type", "event_id").select(F.trim("cid").alias("cid"), "label")


@query
def top_anomalies(spark, d):
    return relational.top_per_group(T(spark, d, "events"), ["event_type"], "value", "event_id", 30).select("event_type", "rank", "event_id", r("value"))


@query
def risk_topk_dedupe(spark, d):
    return relational.top_risks(T(spark, d, "events"), "user_id", [F.desc("value"), F.col("event_id")], 20).select("rank", "user_id", "event_id", r("value"))


@query
def rows_not_evaluated(spark, d):
    done = T(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    c = T(spark, d, "customer")
    a = relational.not_evaluated(c, done, "c_custkey").groupBy("c_mktsegment").agg(F.count("*").alias("n")).withColumn("kind", F.lit("anti"))
    return relational.union_all(a, relational.evaluated_only(c, done, "c_custkey").groupBy("c_mktsegment").agg(F.count("*").alias("n")).withColumn("kind", F.lit("semi")))


@query
def exact_sample(spark, d):
    return relational.sample_exact(T(spark, d, "orders"), "o_orderkey", 100).select("o_orderkey")


# JSON and text --------------------------------------------------------------------------------------------------------
@query
def leaves_props(spark, d):
    return gates.leaves(T(spark, d, "events"), ["event_id"], "props")


@query
def bundle_props(spark, d):
    return T(spark, d, "events").select("event_id", gates.bundle("props").alias("bundle"))


@query
def schema_gate_props(spark, d):
    x = gates.schema_gate(T(spark, d, "events"), "props", {"k": [str(i) for i in range(0, 100, 2)]})
    return x.select("event_id", "schema_pass")


@query
def textlen_thresholds(spark, d):
    leaf = T(spark, d, "conversations").select(F.col("conv_id"), F.col("role").alias("path"), F.col("text").alias("leaf"))
    n = leaf.select("conv_id").distinct().count()
    return gates.length_thresholds(leaf, n).select("path", "n", r("threshold"))


@query
def textlen_gate(spark, d):
    leaf = T(spark, d, "conversations").select(F.col("conv_id"), F.col("role").alias("path"), F.col("text").alias("leaf"))
    th = gates.length_thresholds(leaf, 1, 0.5)
    return gates.length_gate(leaf, th, "conv_id").select("conv_id", F.array_join("textlen_failed", "|").alias("failed"), "textlen_pass")


@query
def token_stats(spark, d):
    x = T(spark, d, "documents").withColumn("k", S.token_count("text"))
    return x.groupBy("lang").agg(F.count("*").alias("n"), F.sum("k").cast("long").alias("tokens"), r(F.median("k"), "median_tokens"))


@query
def ngram_templates(spark, d):
    x = T(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(S.ngrams("text", 3))).alias("gram"))
    return x.groupBy("gram").agg(F.count("*").alias("docs")).where("docs >= 12")


@query
def text_previews(spark, d):
    return T(spark, d, "conversations").select("conv_id", "turn", S.preview("text", 40).alias("preview"), S.sanitize_path("text", 20).alias("path"), F.size(S.segments("text")).alias("n_segments"))


@query
def normal_ids(spark, d):
    c = F.concat(F.lit(" '"), F.col("c_name"), F.when(F.col("c_custkey") % 3 == 0, F.lit("' ")).otherwise(F.lit(" ")))
    return T(spark, d, "customer").select("c_custkey", S.normal_id(c).alias("id"), S.id_or_position(F.when(F.col("c_custkey") % 5 == 0, F.lit(" ")).otherwise(F.col("c_name")), "c_custkey").alias("id_or_position"))


@query
def trace_pairs(spark, d):
    return tables.conversation_pairs(T(spark, d, "conversations"))


@query
def trace_messages(spark, d):
    c = T(spark, d, "conversations")
    raw = F.to_json(F.array(F.struct(F.lit("system").alias("role"), F.lit(" be brief ").alias("content")), F.struct(F.col("role"), F.col("text").alias("content"))))
    t = tables.trace_rows(c.select(F.concat_ws("-", "conv_id", "turn").alias("id"), raw.alias("input"), F.to_json(F.struct(F.col("text").alias("answer"))).alias("output")))
    return t.select("id", "Prompt", F.md5("input").alias("input_md5"), F.md5("expectedOutput").alias("output_md5"), "eval")


@query
def nested_bundles(spark, d):
    """Leaf paths of nested JSON made from two tables."""
    o = T(spark, d, "orders").select("o_orderkey", F.to_json(F.struct(F.struct("o_orderstatus", "o_custkey").alias("a"), F.array("o_orderpriority", F.lit("x")).alias("b"))).alias("j"))
    return gates.leaves(o, ["o_orderkey"], "j")


# instruction checks ---------------------------------------------------------------------------------------------------
CHECKS: dict[str, tuple[str, dict]] = {
    "instr_keyword_existence": ("keywords:existence", {"keywords": ["the", "and"]}),
    "instr_keyword_frequency": ("keywords:frequency", {"keyword": "th", "frequency": 20, "relation": "at least"}),
    "instr_forbidden_words": ("keywords:forbidden_words", {"forbidden_words": ["idiot", "moron"]}),
    "instr_letter_frequency": ("keywords:letter_frequency", {"letter": "e", "let_frequency": 100, "let_relation": "less than"}),
    "instr_number_paragraphs": ("length_constraints:number_paragraphs", {"num_paragraphs": 1}),
    "instr_number_words": ("length_constraints:number_words", {"num_words": 150, "relation": "at least"}),
    "instr_first_word": ("length_constraints:nth_paragraph_first_word", {"num_paragraphs": 1, "nth_paragraph": 1, "first_word": "The"}),
    "instr_placeholders": ("detectable_content:number_placeholders", {"num_placeholders": 1}),
    "instr_postscript": ("detectable_content:postscript", {"postscript_marker": "P.S."}),
    "instr_bullets": ("detectable_format:number_bullet_lists", {"num_bullets": 0}),
    "instr_constrained": ("detectable_format:constrained_response", {"answers": ("MIT License", "the. ")}),
    "instr_highlights": ("detectable_format:number_highlighted_sections", {"num_highlights": 1}),
    "instr_sections": ("detectable_format:multiple_sections", {"section_spliter": "555-", "num_sections": 1}),
    "instr_title": ("detectable_format:title", {}),
    "instr_two_responses": ("combination:two_responses", {}),
    "instr_repeat_prompt": ("combination:repeat_prompt", {"prompt_to_repeat": " the "}),
    "instr_end": ("startend:end_checker", {"end_phrase": "the."}),
    "instr_capital_words": ("change_case:capital_word_frequency", {"capital_frequency": 1, "capital_relation": "at least"}),
    "instr_upper": ("change_case:english_capital", {}),
    "instr_lower": ("change_case:english_lowercase", {}),
    "instr_no_comma": ("punctuation:no_comma", {}),
    "instr_quotation": ("startend:quotation", {}),
    "instr_start": ("constrained_start", {"starter": "The"}),
    "instr_rephrase": ("rephrase", {"original_message": "The *old* text"}),
    "instr_key_sentences": ("key_sentences", {"key_sentences": ["Released under the MIT License.", "the."], "num_sentences": 1}),
    "instr_overlap": ("rephrase_paragraph", {"original_paragraph": "the of and to the", "low": 3, "high": 5}),
    "instr_sentences": ("length_constraints:number_sentences", {"num_sentences": 8, "relation": "at least"}),
    "instr_language": ("language:response_language", {"language_code": "en"}),
    "instr_json": ("detectable_format:json_format", {}),
}


def _check(name: str, rule: str, kw: dict) -> None:
    def f(spark, d):
        return T(spark, d, "documents").select("doc_id", gates.check(rule, "text", **kw).alias("ok"))

    f.__name__ = name
    query(f)


for _name, (_rule, _kw) in CHECKS.items():
    _check(_name, _rule, _kw)


@query
def instr_loose_variants(spark, d):
    return T(spark, d, "conversations").select("conv_id", "turn", gates.check("punctuation:no_comma", "text", loose=True).alias("ok"))


@query
def instruction_gate(spark, d):
    x = gates.instruction_gate(T(spark, d, "documents"), "text", [("punctuation:no_comma", {}), ("length_constraints:number_words", {"num_words": 50, "relation": "at least"})])
    return x.select("doc_id", "ifeval_pass", F.array_join("ifeval_failed", "|").alias("failed"))


@query
def instruction_accuracy(spark, d):
    rules = ["punctuation:no_comma", "detectable_format:title", "startend:quotation"]
    x = T(spark, d, "documents").select(F.explode(F.array(*[F.struct(F.lit(k).alias("id"), F.lit(k.split(":")[0]).alias("tier"), gates.check(k, "text").alias("ok")) for k in rules])).alias("c")).select("c.*")
    g = x.groupingSets([[], [F.col("tier")], [F.col("id")]], F.col("tier"), F.col("id")).agg(F.count("*").alias("n"), r(F.avg(F.col("ok").cast("double")), "accuracy"))
    return g.select(F.col("tier"), F.col("id"), "n", "accuracy")


@query
def hard_gate_score(spark, d):
    x = T(spark, d, "documents").withColumn("ok", gates.check("length_constraints:number_words", "text", num_words=40))
    return scoring.hard_gate_score(x, ["lang"], "ok").select("lang", "n", r("pass_rate"), "score")


# vectors and signals --------------------------------------------------------------------------------------------------
def emb(spark, d):
    return T(spark, d, "embeddings").select("vec_id", V.doubles("embedding").alias("v"), "label")


def pair_vectors(spark, d):
    e = emb(spark, d).withColumn("id", F.floor(F.col("vec_id") / 2).cast("long"))
    return e.groupBy("id").agg(F.max(F.when(F.col("vec_id") % 2 == 0, F.col("v"))).alias("x"), F.max(F.when(F.col("vec_id") % 2 == 1, F.col("v"))).alias("y")).where("x is not null and y is not null")


@query
def unit_vectors(spark, d):
    return emb(spark, d).select("vec_id", r(V.norm(V.unit(F.transform("v", lambda x: x * 3))), "length"), r(V.dot("v", F.transform("v", lambda x: x * 2)), "dot"))


@query
def knn_euclid(spark, d):
    return signals.knn(emb(spark, d), "vec_id", "v", 5).select("vec_id", "rank", "neighbour", F.round(F.col("distance").cast("double"), 4).alias("distance"))


@query
def knn_cosine_by_label(spark, d):
    return signals.knn(emb(spark, d), "vec_id", "v", 3, "cosine", "label").select("label", "vec_id", "rank", "neighbour", F.round(F.col("distance").cast("double"), 4).alias("distance"))


@query
def output_density(spark, d):
    return signals.output_density(signals.knn(emb(spark, d), "vec_id", "v", 20), "vec_id", [10, 15, 20]).select("vec_id", F.round("density", 3).alias("density"))


@query
def delta_length(spark, d):
    p = pair_vectors(spark, d)
    return signals.length_signal(signals.knn(p, "id", "x", 10, "cosine"), signals.deltas(p, "id", "x", "y"), "id").select("id", F.round("length_signal", 4).alias("length_signal"))


@query
def delta_direction(spark, d):
    p = pair_vectors(spark, d)
    return signals.direction_signal(signals.knn(p, "id", "x", 10, "cosine"), signals.deltas(p, "id", "x", "y"), "id").select("id", F.round("direction_signal", 4).alias("direction_signal"))


@query
def sim_conflict(spark, d):
    p = pair_vectors(spark, d)
    return signals.similar_input_conflict(signals.knn(p, "id", "x", 10, "cosine"), signals.deltas(p, "id", "x", "y"), "id", 0.35).select("id", F.round("conflict", 4).alias("conflict"))


@query
def adaptive_k(spark, d):
    return signals.adaptive_k(signals.knn(emb(spark, d), "vec_id", "v", 20), "vec_id", 8, 4, 1.03).select("vec_id", "used_k")


@query
def class_centroids(spark, d):
    c = signals.centroids(emb(spark, d), "label", "v")
    return c.select("label", F.posexplode("centroid").alias("i", "x")).select("label", "i", r("x"))


def sims(spark, d):
    e = emb(spark, d)
    return signals.class_similarities(e, signals.centroids(e, "label", "v"), "vec_id", "label", "v")


@query
def class_margins(spark, d):
    return sims(spark, d).select("vec_id", r("own"), r("other"), r("margin"), r("disorder"))


@query
def contradiction(spark, d):
    return signals.contradiction(sims(spark, d), "vec_id").select("vec_id", F.round("contradiction", 4).alias("contradiction"))


@query
def discourse_instability(spark, d):
    return signals.discourse_instability(sims(spark, d), "vec_id", "label").select("vec_id", F.round("discourse", 4).alias("discourse"))


@query
def cosine_residuals(spark, d):
    return pair_vectors(spark, d).select("id", r(V.cosine_residual("x", "y"), "residual"), r(V.angle("x", "y"), "angle"))


@query
def diff_residual(spark, d):
    p = pair_vectors(spark, d)
    return signals.local_mahalanobis(signals.knn(p, "id", "x", 15, "cosine"), signals.deltas(p, "id", "x", "y"), "id")


@query
def delta_ridge(spark, d):
    p = pair_vectors(spark, d)
    return ridge.ensemble_signal(p.join(signals.deltas(p, "id", "x", "y").select("id", "d"), "id"), "id", "x", "d")


@query
def pca_2d(spark, d):
    return signals.pca(emb(spark, d), "vec_id", "v")


@query
def hash_embed(spark, d):
    return T(spark, d, "conversations").select("conv_id", "turn", signals.hash_embed_768(F.col("text")).alias("vector"))


# thresholds and calibration -------------------------------------------------------------------------------------------
@query
def robust_z_policy(spark, d):
    x = thresholds.robust_z_policy(T(spark, d, "events"), ["event_type"], "value")
    return x.select("event_type", "n", r("median"), r("sigma"), "source", r("threshold"))


@query
def quantile_tail_policy(spark, d):
    return thresholds.quantile_tail_policy(T(spark, d, "events"), ["event_type"], "value").select("event_type", "n", r("threshold"))


@query
def tail_start_policy(spark, d):
    x = thresholds.tail_start_policy(T(spark, d, "events"), ["event_type"], "value", "event_id")
    return x.select("event_type", r("median"), r("sigma"), r("knee"), r("jump"), r("gap_z"), r("k"), r("threshold"))


@query
def core_thresholds(spark, d):
    t = thresholds.quantile_tail_policy(T(spark, d, "events"), ["event_type"], "value", 0.1)
    return thresholds.core_thresholds(T(spark, d, "events"), ["event_type"], "value", t).select("event_type", r("core_median"), r("core"), r("core_sigma"))


@query
def exceptional_out(spark, d):
    t = thresholds.quantile_tail_policy(T(spark, d, "events"), ["event_type"], "value", 0.2)
    return thresholds.exceptional(T(spark, d, "events"), ["event_type"], "value", t).select("event_type", "tail_rows", r("exceptional"))


@query
def stability_jump(spark, d):
    e = T(spark, d, "events").withColumn("f1", F.pmod("user_id", F.lit(17)).cast("double")).withColumn("f2", F.sqrt("value"))
    return thresholds.stability_jump_policy(e, ["event_type"], "value", ["f1", "f2"], [i / 100 for i in range(1, 31)]).select("event_type", "share", r("threshold"))


@query
def stability_cuts(spark, d):
    e = T(spark, d, "events").withColumn("f1", F.pmod("user_id", F.lit(17)).cast("double"))
    return thresholds.stability_cuts(e, ["event_type"], "value", ["f1"], [0.05, 0.1, 0.2]).select("event_type", "share", r("cut"), "flagged", r("var_f1"))


@query
def tri_thresholds_upper(spark, d):
    x = thresholds.hybrid(T(spark, d, "events"), ["event_type"], "value", "event_id")
    return x.select("event_type", *[r(c) for c in ("warn_low", "warn", "fail", "hard")], "source")


@query
def hybrid_states(spark, d):
    e = T(spark, d, "events")
    return thresholds.apply_states(e, thresholds.hybrid(e, ["event_type"], "value", "event_id"), ["event_type"], "value").groupBy("event_type", "state").agg(F.count("*").alias("n"))


@query
def calib_grid_distance(spark, d):
    x = windows.folds(labelled(spark, d).where("bad is not null"), "bad", "doc_id").withColumn("v", F.col("n_chars").cast("double"))
    return thresholds.grid_calibration(x, "lang", "v", "bad", "fold", [0.5, 0.7, 0.8, 0.9, 0.95], 0.3).select(r("q"), "tp", "fp", "fn", "tn", r("precision"), r("recall"), r("f1"), "chosen")


@query
def calib_tristate(spark, d):
    x = thresholds.tristate(T(spark, d, "events"), "event_type", "value", 0.9, 0.99, F.pmod("user_id", F.lit(11)) != 0)
    return x.groupBy("event_type", "state").agg(F.count("*").alias("n"))


@query
def targets_met(spark, d):
    z = z_events(spark, d).withColumn("state", S.four_state(F.lit(True), F.col("z") >= 1, F.col("z") >= 2, F.col("z") >= 4)).withColumn("bad", F.pmod("user_id", F.lit(3)) == 0)
    return thresholds.targets_met(z, ["event_type"], "bad").select("event_type", r("hard_precision"), r("fail_precision"), r("warn_good"), "met")


# scores and triage ----------------------------------------------------------------------------------------------------
@query
def bundle_axes(spark, d):
    x = scoring.axis_profile(T(spark, d, "events"), ["event_type"], "value")
    return x.select("event_type", "n", *[r(c) for c in ("p_fail", "p_hard", "r_rate", "r_mass", "r_core", "risk", "quality")])


@query
def tail_metrics(spark, d):
    return scoring.tail_metrics(z_events(spark, d), ["event_type"], "z", 2.0, 3.5).select("event_type", "n", r("p_fail"), r("p_hard"), r("mass"))


@query
def diag_quadrants(spark, d):
    x = scoring.diagnostic_quadrants(T(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity")
    return x.select("l_returnflag", *[r(c) for c in ("q00", "q10", "q01", "q11", "rate", "mass", "risk")])


@query
def confidence(spark, d):
    x = T(spark, d, "events").withColumn("a", F.col("value") > 3).withColumn("m", F.when(F.pmod("event_id", F.lit(50000)) == 7, " NA ").otherwise("tail_start"))
    return scoring.confidence(x, ["event_type"], "value", "a", 3000, "m").select("event_type", "n_valid", r("conf_data"), r("conf_calc"), r("conf_th"), r("confidence"))


@query
def coverage(spark, d):
    x = T(spark, d, "events").withColumn("g", F.col("value") > 3).withColumn("s", F.when(F.col("user_id") % 4 != 0, F.col("value")))
    return scoring.coverage(x, ["event_type"], "g", ["value", "s"]).select("event_type", r("coverage"))


@query
def warn_rank(spark, d):
    x = scoring.row_risk(T(spark, d, "events"), ["event_type"], "value").withColumn("hards", (F.col("value") > 200).cast("int")).withColumn("fails", F.least(F.floor(F.col("value") / 40), F.lit(5)).cast("int"))
    x = x.withColumn("hards", F.least("hards", "fails")).withColumn("detail", F.pmod("event_id", F.lit(50)) == 0)
    x = scoring.triage(x, "user_id", "event_id", "risk", "fails", "hards", 6, "detail")
    return x.select("rank", "user_id", "event_id", r("risk"), r("severity"), r("rank_score"), "tags")


# windows of a stream, as a table --------------------------------------------------------------------------------------
@query
def window_rates(spark, d):
    z = z_events(spark, d).withColumn("state", S.four_state(F.lit(True), F.col("z") >= 1, F.col("z") >= 2, F.col("z") >= 4))
    return monitor.window_rates(z, "ts", ["event_type"]).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", r("fail_rate"))


@query
def user_sessions(spark, d):
    x = monitor.sessions(T(spark, d, "events"), "ts", ["user_id"], "12 hours")
    return x.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").cast("long").alias("events"), F.max("n").cast("long").alias("longest"))
