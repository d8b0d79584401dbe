"""Row validity: instruction checks, light schemas of JSON objects, and text length per leaf path."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatelens.functions.scalar import WORD, col, response_variants

Check = Callable[..., Column]
INSTRUCTIONS: dict[str, Check] = {}


def instruction(name: str) -> Callable[[Check], Check]:
    def add(f: Check) -> Check:
        INSTRUCTIONS[name] = f
        return f

    return add


def compare(count: Column, n: int, relation: str) -> Column:
    return count < n if relation == "less than" else count >= n


def count_of(t: Column, pattern: str) -> Column:
    return F.regexp_count(t, F.lit(pattern))


@instruction("keywords:existence")
def _existence(t: Column, keywords: list[str]) -> Column:
    out = F.lit(True)
    for k in keywords:
        out = out & t.rlike(f"(?iU){k}")
    return out


@instruction("keywords:frequency")
def _frequency(t: Column, keyword: str, frequency: int, relation: str = "at least") -> Column:
    return compare(count_of(t, f"(?iU){keyword}"), frequency, relation)


@instruction("keywords:forbidden_words")
def _forbidden(t: Column, forbidden_words: list[str]) -> Column:
    return ~t.rlike("(?iU)" + "|".join(rf"\b{w}\b" for w in forbidden_words))


@instruction("keywords:letter_frequency")
def _letters(t: Column, letter: str, let_frequency: int, let_relation: str = "at least") -> Column:
    low = F.lower(t)
    return compare(F.length(low) - F.length(F.replace(low, F.lit(letter.lower()), F.lit(""))), let_frequency, let_relation)


# Words that end with a stop inside a sentence.
ABBREVIATIONS = frozenset("mr mrs ms dr prof st sr jr inc ltd co vs etc e.g i.e cf fig no vol approx dept est jan feb mar apr jun jul aug sep sept oct nov dec a.m p.m u.s u.k ph.d".split())
_END = re.compile(r"[.!?…。！？]+[\"'”’)\]]*(?=\s|$)|[。！？]+")
_BEFORE = re.compile(r"[\w.]+$")


def sentences(text: str | None) -> list[str]:
    """Sentences of a text: they end with stops before white space or the end, but not after abbreviations, initials, or in numbers and addresses."""
    t, out, start = text or "", [], 0
    for m in _END.finditer(t):
        if m[0] == "." and m.end() < len(t):
            word = _BEFORE.search(t, start, m.start())
            w = word[0] if word else ""
            rest = t[m.end() :].lstrip()
            initial = len(w) == 1 and w.isupper() and w != "I"
            if w.lower() in ABBREVIATIONS or initial or rest[:1].islower():
                continue
        s = t[start : m.end()].strip()
        if re.search(r"\w", s):
            out.append(s)
            start = m.end()
    tail = t[start:].strip()
    return out + [tail] if re.search(r"\w", tail) else out


@F.pandas_udf(T.IntegerType())
def sentence_count(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: len(sentences(t))).astype("int32")


@F.pandas_udf(T.ArrayType(T.StringType()))
def sentence_list(texts: pd.Series) -> pd.Series:
    return texts.map(sentences)


@instruction("length_constraints:number_sentences")
def _sentences(t: Column, num_sentences: int, relation: str = "at least") -> Column:
    """By rules, in place of a trained splitter."""
    return compare(sentence_count(t), num_sentences, relation)


@instruction("length_constraints:number_paragraphs")
def _paragraphs(t: Column, num_paragraphs: int) -> Column:
    parts = F.split(t, r"\s?\*\*\*\s?")
    inner = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    filled = F.size(F.filter(parts, lambda p: F.trim(p) != ""))
    return ~F.exists(inner, lambda p: F.trim(p) == "") & (filled == num_paragraphs)


@instruction("length_constraints:number_words")
def _words(t: Column, num_words: int, relation: str = "at least") -> Column:
    return compare(count_of(t, WORD), num_words, relation)


@instruction("length_constraints:nth_paragraph_first_word")
def _first_word(t: Column, num_paragraphs: int, nth_paragraph: int, first_word: str) -> Column:
    parts = F.split(t, r"\n\n")
    filled = F.size(F.filter(parts, lambda p: F.trim(p) != ""))
    word = F.lower(F.regexp_extract(F.trim(F.coalesce(F.get(parts, F.lit(nth_paragraph - 1)), F.lit(""))), r"^['\"]*([^\s.,?!'\"]*)", 1))
    return (filled == num_paragraphs) & (word == first_word.lower())


@instruction("detectable_content:number_placeholders")
def _placeholders(t: Column, num_placeholders: int) -> Column:
    return count_of(t, r"\[[^\n]*?\]") >= num_placeholders


@instruction("detectable_content:postscript")
def _postscript(t: Column, postscript_marker: str = "P.S.") -> Column:
    marks = {"P.S.": r"\s*p\.\s?s\.", "P.P.S": r"\s*p\.\s?p\.\s?s"}
    return F.lower(t).rlike("(?m)" + marks.get(postscript_marker, r"\s*" + re.escape(postscript_marker.lower())) + ".*$")


@instruction("detectable_format:number_bullet_lists")
def _bullets(t: Column, num_bullets: int) -> Column:
    return count_of(t, r"(?m)^[ \t]*\*[^*\n]") + count_of(t, r"(?m)^[ \t]*-[^\n]") == num_bullets


@instruction("detectable_format:constrained_response")
def _constrained(t: Column, answers: tuple[str, ...] = ("My answer is yes.", "My answer is no.", "My answer is maybe.")) -> Column:
    out = F.lit(False)
    for a in answers:
        out = out | F.contains(t, F.lit(a))
    return out


@instruction("detectable_format:number_highlighted_sections")
def _highlights(t: Column, num_highlights: int) -> Column:
    return count_of(t, r"\*[^\n*]*[^\n*\s][^\n*]*\*") >= num_highlights


@instruction("detectable_format:multiple_sections")
def _sections(t: Column, section_spliter: str, num_sections: int) -> Column:
    return count_of(t, rf"\s?{section_spliter}\s?\d+\s?") >= num_sections


@instruction("detectable_format:json_format")
def _json(t: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.trim(t), r"^```(?:json|Json|JSON)?", ""), r"```$", "")
    return strict_json(F.trim(bare))


@instruction("detectable_format:title")
def _title(t: Column) -> Column:
    return t.rlike(r"<<[^\n<>]*[^\s<>][^\n<>]*>>")


@instruction("combination:two_responses")
def _two(t: Column) -> Column:
    parts = F.split(t, r"\*\*\*\*\*\*")
    filled = F.filter(F.transform(parts, F.trim), lambda p: p != "")
    return (F.size(filled) == 2) & (F.size(F.array_distinct(filled)) == 2)


@instruction("combination:repeat_prompt")
def _repeat(t: Column, prompt_to_repeat: str) -> Column:
    return F.startswith(F.lower(F.trim(t)), F.lit(prompt_to_repeat.strip().lower()))


@instruction("startend:end_checker")
def _end(t: Column, end_phrase: str) -> Column:
    return F.endswith(F.lower(F.regexp_replace(F.trim(t), r'^"+|"+$', "")), F.lit(end_phrase.strip().lower()))


@instruction("change_case:capital_word_frequency")
def _capitals(t: Column, capital_frequency: int, capital_relation: str = "at least") -> Column:
    return compare(count_of(t, r"(?<![\p{L}\p{N}_])\p{Lu}+(?![\p{L}\p{N}_])"), capital_frequency, capital_relation)


@instruction("change_case:english_capital")
def _upper(t: Column) -> Column:
    return (F.upper(t) == t) & t.rlike(r"\p{Lu}") & F.coalesce(language(t) == "en", F.lit(True))


@instruction("change_case:english_lowercase")
def _lower(t: Column) -> Column:
    return (F.lower(t) == t) & t.rlike(r"\p{Ll}") & F.coalesce(language(t) == "en", F.lit(True))


@instruction("punctuation:no_comma")
def _no_comma(t: Column) -> Column:
    return ~F.contains(t, F.lit(","))


@instruction("startend:quotation")
def _quotation(t: Column) -> Column:
    v = F.trim(t)
    return (F.length(v) > 1) & F.startswith(v, F.lit('"')) & F.endswith(v, F.lit('"'))


@instruction("constrained_start")
def _start(t: Column, starter: str) -> Column:
    return t.rlike(rf"(?m)^\s*{starter}.*$")


@instruction("rephrase")
def _rephrase(t: Column, original_message: str) -> Column:
    bare = lambda c: F.regexp_replace(c, r"\*[^\n*]*\*", "")
    return bare(t) == bare(F.lit(original_message))


@instruction("key_sentences")
def _key_sentences(t: Column, key_sentences: list[str], num_sentences: int) -> Column:
    return sum((F.contains(t, F.lit(k)).cast("int") for k in key_sentences), F.lit(0)) == num_sentences


@instruction("rephrase_paragraph")
def _overlap(t: Column, original_paragraph: str, low: int, high: int) -> Column:
    words = re.findall(r"\w+", original_paragraph.lower())
    own = F.regexp_extract_all(F.lower(t), F.lit(WORD), F.lit(0))
    held = lambda w: F.size(own) - F.size(F.array_remove(own, w))
    n = sum((F.least(held(w), F.lit(words.count(w))) for w in sorted(set(words))), F.lit(0))
    return n.between(low, high)


# Frequent words by language, enough to tell texts of a few words apart.
STOP_WORDS = {
    "en": "the of and to in is was that for with are this from by it be".split(), "fr": "le la les de des et est un une que dans pour pas sur avec".split(),
    "de": "der die das und ist nicht ein eine mit für von auf den sich".split(), "es": "el la los las de que y en un una por con para su".split(),
    "it": "il lo la gli di che e un una per con non sono del".split(), "pt": "o a os as de que e um uma por com para não do".split(), "nl": "de het een en van is dat niet met op voor zijn".split(),
}


def language(t: Column) -> Column:
    """The language most of whose frequent words a text holds; null without any."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(WORD), F.lit(0)))
    n = F.array(*[F.struct(F.size(F.array_intersect(words, F.array(*map(F.lit, ws)))).alias("n"), F.lit(k).alias("k")) for k, ws in STOP_WORDS.items()])
    best = F.array_max(n)
    return F.when(best["n"] > 0, best["k"])


@instruction("language:response_language")
def _language(t: Column, language_code: str) -> Column:
    return F.coalesce(language(t) == language_code, F.lit(True))


def check(name: str, text, loose: bool = False, **kw) -> Column:
    """Whether a response follows an instruction; loose: in any of its eight variants. Blank responses never do."""
    f = INSTRUCTIONS[name]
    t = F.coalesce(col(text), F.lit(""))
    one = lambda v: F.coalesce((F.trim(v) != "") & f(v, **kw), F.lit(False))
    if not loose:
        return one(t)
    v = response_variants(t)
    out = one(v[0])
    for i in range(1, 8):
        out = out | one(v[i])
    return out


def instruction_gate(df: DataFrame, text: str, rules: list[tuple[str, dict]], loose: bool = False) -> DataFrame:
    """df with ifeval_pass and the names of failed instructions."""
    failed = F.array_compact(F.array(*[F.when(~check(n, text, loose, **kw), F.lit(n)) for n, kw in rules])) if rules else F.array().cast("array<string>")
    return df.withColumn("ifeval_failed", failed).withColumn("ifeval_pass", F.size("ifeval_failed") == 0)


# JSON -----------------------------------------------------------------------------------------------------------------
@F.pandas_udf(T.BooleanType())
def strict_json(texts: pd.Series) -> pd.Series:
    """Whether a text is JSON, scalars and NaN allowed; trailing text isn't."""

    def ok(t) -> bool:
        try:
            json.loads(t)
        except (TypeError, ValueError, RecursionError):
            return False
        return True

    return texts.map(ok).astype(bool)


def _leaves(value, path: str = "") -> Iterator[tuple[str, str]]:
    if isinstance(value, dict):
        for k in sorted(value):
            yield from _leaves(value[k], f"{path}.{k}" if path else str(k))
    elif isinstance(value, list):
        for i, x in enumerate(value):
            yield from _leaves(x, f"{path}[{i}]")
    elif value is not None:
        yield path or "_value", str(value)


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def json_leaves(texts: pd.Series) -> pd.Series:
    """Leaf paths and values of a JSON text, values as Python writes them; empty for what isn't JSON."""

    def of(t):
        try:
            return dict(_leaves(json.loads(t)))
        except (TypeError, ValueError, RecursionError):
            return {}

    return texts.map(of)


def leaves(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """keep, path, leaf: one row per leaf."""
    return df.select(*keep, F.explode(json_leaves(F.col(text))).alias("path", "leaf"))


def bundle(text) -> Column:
    """Leaves that aren't blank, in path order, joined by ' || '."""
    entries = F.array_sort(F.map_entries(json_leaves(col(text))))
    return F.array_join(F.filter(F.transform(entries, lambda e: F.trim(e["value"])), lambda v: v != ""), " || ")


def _problems(value, spec, path: str, strict: bool, extra: bool) -> list[str]:
    if isinstance(spec, dict):
        if not isinstance(value, dict):
            return [f"{path or '$'}: not an object"]
        out = [f"{path}{k}: missing" for k in spec if k not in value] if strict else []
        if not extra:
            out += [f"{path}{k}: extra" for k in value if k not in spec]
        for k, s in spec.items():
            if k in value:
                out += _problems(value[k], s, f"{path}{k}.", strict, extra) if isinstance(s, dict) else _problems(value[k], s, f"{path}{k}", strict, extra)
        return out
    ok = True
    if isinstance(spec, (list, tuple)):
        ok = str(value) in [str(s) for s in spec]
    elif spec == "text":
        ok = isinstance(value, str) and bool(value)
    elif spec == "integer":
        ok = isinstance(value, int) and not isinstance(value, bool)
    elif spec == "number":
        ok = isinstance(value, (int, float)) and not isinstance(value, bool)
    elif spec == "boolean":
        ok = isinstance(value, bool)
    return [] if ok else [f"{path}: not {spec}"]


def schema_gate(df: DataFrame, text: str, spec: dict, strict: bool = True, extra: bool = False) -> DataFrame:
    """df with schema_pass and schema_problems under a light schema: lists are choices, dicts nest, else a type's name."""

    @F.pandas_udf("array<string>")
    def problems(texts: pd.Series) -> pd.Series:
        def of(t) -> list[str]:
            try:
                value = json.loads(t)
            except (TypeError, ValueError, RecursionError):
                return ["$: not JSON"]
            return _problems(value, spec, "", strict, extra)

        return texts.map(of)

    return df.withColumn("schema_problems", problems(F.col(text))).withColumn("schema_pass", F.size("schema_problems") == 0)


def length_thresholds(leaf_rows: DataFrame, n_rows: int, ratio: float = 0.30, support: float = 0.20) -> DataFrame:
    """path, n, threshold: share of the median length, for paths that enough rows fill. leaf_rows (path, leaf)."""
    x = leaf_rows.where(F.trim("leaf") != "").withColumn("_len", F.length(F.trim("leaf")))
    g = x.groupBy("path").agg(F.count("*").alias("n"), F.median("_len").alias("_m"))
    return g.where(F.col("n") >= F.greatest(F.lit(3), F.ceil(F.lit(n_rows * support)))).select("path", "n", (F.col("_m") * ratio).alias("threshold"))


def length_gate(leaf_rows: DataFrame, thresholds: DataFrame, key: str) -> DataFrame:
    """key, textlen_pass, textlen_failed: leaves no longer than their path's threshold fail."""
    x = leaf_rows.join(thresholds.select("path", "threshold"), "path", "left").withColumn("_bad", (F.trim("leaf") != "") & (F.length(F.trim("leaf")) <= F.col("threshold")))
    return x.groupBy(key).agg(F.array_sort(F.collect_set(F.when(F.col("_bad"), F.col("path")))).alias("textlen_failed")).withColumn("textlen_pass", F.size("textlen_failed") == 0)
