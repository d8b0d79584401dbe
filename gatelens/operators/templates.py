"""Structural templates of texts: n-grams that most texts of a group hold at the same place, how much they cover, and their masking."""

from __future__ import annotations

import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatelens.functions.scalar import WORD
from gatelens.sources.scratch import saved, with_group

MASK = "<TPL>"
#: Texts whose n-grams a task counts.
TEXTS = 50_000
WORDS = re.compile(r"\b\w+\b")


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def placed(df: DataFrame, by: list[str], key: str, text: str, low: int, high: int) -> DataFrame:
    """by, key, n, gram, at: the first place, as a share of the words, of every n-gram of a text."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0))
    # texts are dealt by key, so that the n-grams of a text, which are many times its size, are counted where they are made
    parts = max(1, math.ceil(df.count() / TEXTS))
    x = df.select(*by, key, text).repartition(parts, key).select(*by, key, words.alias("_w")).withColumn("n", F.explode(F.sequence(F.lit(low), F.lit(high)))).where(F.size("_w") >= F.col("n"))
    x = x.select(*by, key, "n", "_w", F.explode(F.sequence(F.lit(1), F.size("_w") - F.col("n") + 1)).alias("_i"))
    return x.groupBy(*by, key, "n", F.array_join(F.slice("_w", F.col("_i"), F.col("n")), " ").alias("gram")).agg(F.min((F.col("_i") - 1) / F.size("_w")).alias("at"))


def structural(df: DataFrame, by: list[str], key: str, text: str, low: int = 3, high: int = 7, share: float = 0.70, spread: float = 0.05) -> DataFrame:
    """by, n, gram, docs, spread: n-grams that enough texts of a group hold, at places of little spread; groups of under three texts have none."""
    n = df.groupBy(*by).agg(F.count("*").alias("_docs")).where("_docs >= 3")
    g = placed(df, by, key, text, low, high).groupBy(*by, "n", "gram").agg(F.count("*").alias("docs"), F.stddev_pop("at").alias("spread"))
    g = with_group(g, n, by, "inner")
    return g.where((F.col("docs") >= F.greatest(F.lit(2), F.floor(F.col("_docs") * share))) & (F.col("spread") < spread)).drop("_docs")


def mask_text(text: str, grams: set[str], mask: str = MASK) -> tuple[str, float]:
    """A text whose template spans, the longest first, are one mask; and the share of its words that templates cover."""
    spans = [m.span() for m in WORDS.finditer(text)]
    words = [text[a:b].lower() for a, b in spans]
    if not words:
        return text, 0.0
    found = [(n, i) for n in sorted({g.count(" ") + 1 for g in grams}, reverse=True) for i in range(len(words) - n + 1) if " ".join(words[i : i + n]) in grams]
    covered = bytearray(len(words))
    taken, picked = bytearray(len(words)), []
    for n, i in found:
        covered[i : i + n] = b"\1" * n
        if not any(taken[i : i + n]):
            taken[i : i + n] = b"\1" * n
            picked.append((i, i + n))
    out, at = [], 0
    for i, j in sorted(picked):
        out += [text[at : spans[i][0]], mask]
        at = spans[j - 1][1]
    return collapse("".join([*out, text[at:]]), mask), sum(covered) / len(words)


def collapse(text: str, mask: str = MASK) -> str:
    """The first mask alone, spaces tidied."""
    if text.count(mask) <= 1:
        return text
    head, _, tail = text.partition(mask)
    one = " ".join(f"{head}{mask}{tail.replace(mask, ' ')}".split())
    one = re.sub(rf"\s*{re.escape(mask)}\s*", f" {mask} ", one).strip()
    return re.sub(r"\s+([,.;:!?])", r"\1", one)


def masked(df: DataFrame, by: list[str], key: str, text: str, low: int = 3, high: int = 7, share: float = 0.70, spread: float = 0.05, covered: float = 0.70, mask: str = MASK) -> DataFrame:
    """by, key, masked, coverage, is_template: texts with their group's templates masked; a text of nothing else is the mask.

    A group's templates travel with its rows: they are as many as n-grams of one text can be that most texts share.
    """
    t = structural(df, by, key, text, low, high, share, spread).groupBy(*by).agg(F.sort_array(F.collect_list("gram")).alias("_grams"))
    x = with_group(df.select(*by, key, text).repartition(key), saved(t), by)

    @F.pandas_udf("masked string, coverage double")
    def run(texts: pd.Series, grams: pd.Series) -> pd.DataFrame:
        out, sets = [], {}
        for s, g in zip(texts, grams, strict=True):
            s, known = s or "", () if g is None else tuple(g)
            if known not in sets:
                sets[known] = set(known)
            m, c = mask_text(s, sets[known], mask) if known else (s, 0.0)
            out.append((m if m.strip() or not c else mask, round(c, 4)))
        return pd.DataFrame(out, columns=["masked", "coverage"])

    x = x.withColumn("_m", run(F.col(text), F.col("_grams")))
    return x.select(*by, key, "_m.masked", "_m.coverage", (F.col("_m.coverage") >= covered).alias("is_template"))
