"""Scalar Column functions: labels, states, scoring maps, text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUE_WORDS = ("true", "1", "yes")
TRUE_WORDS_YN = (*TRUE_WORDS, "y", "t")
WORD = r"[\p{L}\p{N}_]+"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# labels, predicates, states -------------------------------------------------------------------------------------------
def lenient_bool(c, words: tuple[str, ...] = TRUE_WORDS) -> Column:
    """True for true words in any case and spacing, False for all else, null too."""
    return F.coalesce(F.lower(F.trim(col(c).cast("string"))).isin(*words), F.lit(False))


def label_value(c, good: tuple[str, ...], bad: tuple[str, ...]) -> Column:
    v = F.lower(F.trim(col(c).cast("string")))
    return F.when(v.isin(*good), 1.0).when(v.isin(*bad), 0.0)


def is_bad(c, bad: str) -> Column:
    return F.coalesce(F.lower(F.trim(col(c).cast("string"))) == bad.strip().lower(), F.lit(False))


def finite(c) -> Column:
    """Null for NaN and infinities."""
    x = col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def all_true(*cs) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(col(c), F.lit(False)) for c in cs])


def quantile_pass(signal, threshold, available=None) -> Column:
    """Signal within threshold; where the signal isn't available, a pass."""
    ok = F.coalesce(col(signal) <= col(threshold), F.lit(False))
    return ok if available is None else ~col(available) | ok


def tail_trigger(score, direction: str, threshold=None, low=None, high=None) -> Column:
    x = finite(score)
    hit = {"upper": lambda: x >= col(threshold), "lower": lambda: x <= col(threshold), "two_sided": lambda: (x <= col(low)) | (x >= col(high))}[direction]()
    return F.coalesce(hit, F.lit(False))


def z_state(z, fail, hard) -> Column:
    """-1 invalid, 0 pass, 1 fail, 2 hard; the hard limit is at least the fail limit."""
    x, f = finite(z), col(fail)
    return F.when(x.isNull(), -1).when(x >= F.greatest(col(hard), f), 2).when(x >= f, 1).otherwise(0)


def four_state(base, warn, fail, hard) -> Column:
    return F.when(~col(base), "na").when(col(hard) & col(fail), "hard_fail").when(col(fail), "fail").when(col(warn), "warn").otherwise("pass")


# scoring maps ---------------------------------------------------------------------------------------------------------
def clip(c, low=0.0, high=1.0) -> Column:
    """Held to the bounds; null stays null."""
    return F.when(col(c).isNotNull(), F.least(F.greatest(col(c), F.lit(low)), F.lit(high)))


def sigmoid(c) -> Column:
    return 1 / (1 + F.exp(-clip(c, -60.0, 60.0)))


def softplus(c) -> Column:
    return F.log1p(F.exp(clip(c, -60.0, 60.0)))


def risk_from_scale(raw, scale: float) -> Column:
    r = F.when(col(raw).isNotNull(), F.greatest(col(raw), F.lit(0.0)))
    return r / (r + F.lit(scale))


def quality_from_risk(risk, gamma: float = 1.0) -> Column:
    return 5 * F.pow(1 - clip(risk), F.lit(gamma))


def noisy_or(pairs: list[tuple[Column, float]]) -> Column:
    """1 - prod(1 - w r) over the risks that are not null, their weights made to sum to one."""
    total = reduce(lambda a, b: a + b, [F.when(r.isNotNull(), F.lit(w)).otherwise(0.0) for r, w in pairs])
    left = reduce(lambda a, b: a * b, [F.when(r.isNotNull(), 1 - clip(r) * F.lit(w) / total).otherwise(1.0) for r, w in pairs])
    return F.when(total > 0, 1 - left)


def hard_tail_penalty(p_hard, mass, alpha: float = 0.25) -> Column:
    return F.lit(alpha) * clip(p_hard) * (0.5 + 0.5 * clip(mass))


def score(c) -> Column:
    return clip(F.rint(col(c)), 0.0, 5.0).cast("int")


def bucket(c, cuts: tuple[float, ...]) -> Column:
    """5 for at least the first of falling cuts, down to 0."""
    out = F.when(col(c).isNull(), None)
    for k, cut in enumerate(cuts):
        out = out.when(col(c) >= cut, 5 - k)
    return out.otherwise(5 - len(cuts))


def inverse_bucket(c, cuts: tuple[float, ...]) -> Column:
    """5 for at most the first of rising cuts, down to 0."""
    out = F.when(col(c).isNull(), None)
    for k, cut in enumerate(cuts):
        out = out.when(col(c) <= cut, 5 - k)
    return out.otherwise(5 - len(cuts))


PASS_RATE = (0.99, 0.95, 0.90, 0.80, 0.60)
RELAXED = (0.95, 0.85, 0.70, 0.50, 0.30)
GOOD_RATIO = (0.90, 0.80, 0.70, 0.55, 0.40)
HARD_GATE = (1.0, 0.9, 0.8, 0.7, 0.6)


def rate(c) -> Column:
    """A ratio from a ratio or a percentage; null outside 0 to 100."""
    x = col(c)
    return F.when((x >= 0) & (x <= 1), x).when((x > 1) & (x <= 100), x / 100)


def guard_catastrophic(s, p_hard, zero: float = 0.05, cap: float = 0.02) -> Column:
    return F.when(col(p_hard) >= zero, 0.0).when(col(p_hard) >= cap, F.least(col(s), F.lit(1.0))).otherwise(col(s))


def weighted_mean(pairs: list[tuple[Column, float]]) -> Column:
    w = reduce(lambda a, b: a + b, [F.when(v.isNotNull(), F.lit(k)).otherwise(0.0) for v, k in pairs])
    return F.when(w > 0, reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) * k for v, k in pairs]) / w)


def min_plus_consistency(parts: list[Column], tight: float = 1.0, bonus: float = 1.0) -> Column:
    low, high = F.array_min(F.array(*parts)), F.array_max(F.array(*parts))
    return clip(F.when(high - low <= tight, low + bonus).otherwise(low), 0.0, 5.0)


def zero_penalty(parts: list[Column], penalty: float, most: float = 5.0) -> Column:
    a = F.array(*parts)
    mean = F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.size(a)
    return clip(mean - F.least(F.size(F.filter(a, lambda x: x <= 0)) * F.lit(penalty), F.lit(most)), 0.0, 5.0)


def guarded_mean(pairs: list[tuple[Column, float]], margin: float) -> Column:
    return F.least(weighted_mean(pairs), F.array_min(F.array(*[v for v, _ in pairs])) + margin)


def confidence_colour(conf) -> Column:
    """Red over yellow to green for 0 to 5; grey for no value."""
    t = clip(finite(conf) / 5)
    red, green = F.when(t <= 0.5, 255.0).otherwise(255 * (1 - (t - 0.5) / 0.5)), F.when(t <= 0.5, 255 * t / 0.5).otherwise(255.0)
    colour = F.format_string("#%02x%02x00", F.rint(red).cast("int"), F.rint(green).cast("int"))
    return F.when(finite(conf).isNull(), "#9ca3af").otherwise(colour)


def k_threshold(median, sigma, k: float, direction: str = "upper") -> Column:
    return col(median) + (1 if direction == "upper" else -1) * k * col(sigma)


# text -----------------------------------------------------------------------------------------------------------------
def normal_id(c) -> Column:
    """Trimmed, one pair of equal quotes taken off."""
    return F.regexp_replace(F.trim(col(c).cast("string")), r"^(['\"])(.*)\1$", "$2")


def id_or_position(c, position) -> Column:
    v = normal_id(c)
    return F.coalesce(F.when(v != "", v), col(position).cast("string"))


def token_count(c) -> Column:
    return F.regexp_count(F.coalesce(col(c), F.lit("")), F.lit(WORD))


def segments(c, min_tokens: int = 2, most: int = 4) -> Column:
    parts = F.split(F.coalesce(col(c), F.lit("")), r"[.!?;:\n。！？；：]+|\s-\s")
    return F.slice(F.filter(F.transform(parts, F.trim), lambda p: token_count(p) >= min_tokens), 1, most)


def ngrams(c, n: int) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(WORD), F.lit(0))
    at = lambda w: F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
    grams = lambda w: F.transform(at(w), lambda i: F.array_join(F.slice(w, i, n), " "))
    return F.transform(F.array(words), grams)[0]  # the words are found once, not once for each n-gram


def sanitize_path(c, most: int = 96) -> Column:
    return F.substring(F.regexp_replace(col(c), r"[^A-Za-z0-9._-]+", "_"), 1, most)


def preview(c, most: int = 180) -> Column:
    t = F.regexp_replace(col(c), r"\n", " ")
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t)


def response_variants(c) -> Column:
    """Eight variants: all, without first, last, or both lines; each as it is and without asterisks."""
    t = F.coalesce(col(c), F.lit(""))
    lines = F.split(t, "\n")
    n = F.size(lines)
    cut = lambda start, drop: F.trim(F.array_join(F.slice(lines, start, F.greatest(n - drop, F.lit(0))), "\n"))
    base = [t, cut(2, 1), cut(1, 1), cut(2, 2)]
    return F.array(*base, *[F.replace(b, F.lit("*"), F.lit("")) for b in base])


def path_list(c) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), r"\|"), F.trim), lambda x: x != ""))


def bool_or_default(c, default: bool = False, words: tuple[str, ...] = TRUE_WORDS_YN) -> Column:
    """True for true words, False for others, the default for null: a column shorter than its table is filled with it."""
    return F.when(col(c).isNull(), F.lit(default)).otherwise(lenient_bool(c, words))


# buckets and guards ---------------------------------------------------------------------------------------------------
def good_bucket(c, cuts: list[Column]) -> Column:
    """0 to 5 by rising cuts; 0 for no value."""
    x = finite(c)
    return F.when(x.isNull(), 0).otherwise(sum((F.when(x >= k, 1).otherwise(0) for k in cuts), F.lit(0)))


def risk_bucket(c, cuts: list[Column]) -> Column:
    """5 to 0 by rising cuts, a value at a cut counting as below it; 0 for no value."""
    x = finite(c)
    return F.when(x.isNull(), 0).otherwise(5 - sum((F.when(x > k, 1).otherwise(0) for k in cuts), F.lit(0)))


def relaxed_risk_bucket(c, cuts: list[Column], floor: int = 1, zero: float = 0.95, catastrophic=None) -> Column:
    """risk_bucket, but 0 only for no value or, in a catastrophic case, from the zero cut on; else at least the floor."""
    b, x = risk_bucket(c, cuts), finite(c)
    bad = F.lit(False) if catastrophic is None else F.coalesce(col(catastrophic), F.lit(False))
    return F.when(b > 0, b).when(x.isNull() | (bad & (x >= zero)), 0).otherwise(max(0, min(5, floor)))


def or_risk(scores: list[Column], weights: list[float]) -> Column:
    """1 - prod(1 - w (1 - score / 5)) over the scores that are not null, weights made to sum to one, or even if none is positive."""
    w = [max(0.0, k) for k in weights]
    some = reduce(lambda a, b: a + b, [F.when(finite(s).isNotNull(), F.lit(k)).otherwise(0.0) for s, k in zip(scores, w, strict=True)])
    n = reduce(lambda a, b: a + b, [F.when(finite(s).isNotNull(), 1).otherwise(0) for s in scores])
    share = lambda k: F.when(some > 0, F.lit(k) / some).otherwise(1 / n)
    left = reduce(lambda a, b: a * b, [F.when(finite(s).isNull(), 1.0).otherwise(clip(1 - share(k) * clip(1 - finite(s) / 5))) for s, k in zip(scores, w, strict=True)])
    return F.when(n > 0, 1 - left)


def floor_unless(score_, floor: int, catastrophic) -> Column:
    """A score of at least the floor, unless the case is catastrophic."""
    s = F.least(F.greatest(col(score_).cast("int"), F.lit(0)), F.lit(5))
    return F.when(F.coalesce(col(catastrophic), F.lit(False)), s).otherwise(F.greatest(s, F.lit(max(0, min(5, floor)))))


def hard_events(p_hard, n, rate_cut: float, least: int, strict: bool = False) -> Column:
    """Whether hard events are frequent enough and enough in number."""
    p, cut = finite(p_hard), max(0.0, rate_cut)
    return F.coalesce(((p > cut) if strict else (p >= cut)) & (p * F.greatest(col(n), F.lit(0)) >= max(1, least)) & (col(n) > 0), F.lit(False))


def catastrophic(p_hard, n, mass, rate_cut: float, least: int, mass_cut: float, strict: bool = True) -> Column:
    """Hard events that count, together with much mass."""
    m, cut = finite(mass), max(0.0, mass_cut)
    return hard_events(p_hard, n, rate_cut, least, strict) & F.coalesce((m > cut) if strict else (m >= cut), F.lit(False))


def na_label(source, raw, bucket_, short_circuit=None, reasons: tuple = ()) -> tuple[Column, Column, Column]:
    """Whether a score is missing, the label of why, and all reasons joined by semicolons."""
    src = F.coalesce(col(source), F.lit(""))
    na = src.isin("na", "na_neutral") | finite(raw).isNull() | finite(bucket_).isNull()
    parts = [src, *([col(short_circuit)] if short_circuit is not None else []), *map(col, reasons)]
    said = F.array_distinct(F.filter(F.array(*[F.trim(F.coalesce(p, F.lit(""))) for p in parts]), lambda p: p != ""))
    label = (
        F.when(F.array_contains(said, "insufficient_edge_samples"), "NA (too few edge samples)").when(F.array_contains(said, "required_axis_na"), "NA (a required axis is missing)")
        .when(F.array_contains(said, "sem_zero_dominance"), "NA (too little semantic information)").when(src == "na_neutral", "NA (neutral)").otherwise("NA (not computed)")
    )
    return na, F.when(na, label).otherwise(""), F.when(na, F.array_join(said, ";")).otherwise("")


# JSON text ------------------------------------------------------------------------------------------------------------
def lower_keys(c) -> Column:
    """The top-level entries of a JSON object as a map of texts, keys trimmed and lower-cased; of equal keys the last counts."""
    entries = F.map_entries(F.from_json(col(c), "map<string, string>"))
    named = F.transform(entries, lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value")))
    last = F.filter(named, lambda e, i: ~F.exists(F.slice(named, i + 2, F.greatest(F.size(named) - i - 1, F.lit(0))), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def canonical(c) -> Column:
    """JSON objects and lists with sorted keys and no spaces; other text with its white space made one space."""
    v = F.try_parse_json(col(c))
    nested = F.schema_of_variant(v).startswith("OBJECT") | F.schema_of_variant(v).startswith("ARRAY")
    return F.when(F.coalesce(nested, F.lit(False)), F.to_json(v)).otherwise(F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)\s+", " ")))


def normal_text(c) -> Column:
    """Lower case, plain quotes, dashes and dots, no invisible characters, no runs of stops, dashes or spaces. NFKC is applied by nfkc."""
    t = F.lower(F.coalesce(col(c), F.lit("")))
    for pattern, to in (
        (r"[\u2018\u2019\u201a\u201b]", "'"), (r"[\u201c\u201d\u201e\u201f]", '"'), (r"[\u2013\u2014\u2015\u2012]", "-"), (r"\u2026", "..."),
        (r"[\u00a0\u2000-\u200b\u202f\u205f\u3000]", " "), (r"[\u200c\u200d\u200e\u200f\u00ad]", ""), (r"([.!?]){2,}", "$1"), ("-{2,}", "-"), (r"(?U)\s+", " "),
    ):
        t = F.regexp_replace(t, pattern, to)
    return F.trim(t)
