"""Mixing sources to target weights, with DataFrame functions only.

Sizes are aggregated per source; a source's target is its weight's share of all words, held to MAX_REPEATS times its
size, the excess shared again by weight. Filling all sources to a common level does that at once: sources in the order
of the level at which they stop, the level being what the earlier, stopped ones leave over the weights of the rest.
The repetition rate is target over size; a document comes floor(rate) times, and once more if a number in [0, 1) made
from its id's MD5 is below the fraction. What a task gathers is one row per source, whatever their documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelens.llm.common import fresh, join_checked

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = "mix-1"


def words(text: Column) -> Column:
    r"""Number of [^\x20\x09-\x0D]+ in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def coin(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the id's text; a null id counts as the empty text."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def targets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size long, weight int, target double) per source of docs (source, text)."""
    per = docs.groupBy("source").agg(F.sum(words(F.col("text"))).alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))
    # one row per source: sources stop in the order of max_repeats * size / weight
    stop = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest, whole = stop.rowsBetween(Window.unboundedPreceding, -1), stop.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    cap = F.col("source_size") * max_repeats
    per = per.withColumn("over", F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(before), F.lit(0)))
    per = per.withColumn("share", F.sum("weight").over(rest))
    # the first source that the level doesn't stop sets the level of all later ones
    stopped = cap * F.col("share") <= F.col("over") * F.col("weight")
    per = per.withColumn("open", F.when(~stopped, F.struct("over", "share")))
    level = F.first("open", ignorenulls=True).over(stop.rowsBetween(Window.unboundedPreceding, 0))
    per = per.withColumn("level", level)
    target = F.coalesce(F.col("level.over").cast("double") * F.col("weight") / F.col("level.share"), cap.cast("double"))
    return per.select("source", "source_size", "weight", target.alias("target"))


def names(docs: DataFrame) -> list[str]:
    """The names that _size, _source_size, _target and _copies have beside the columns of docs."""
    return [fresh(n, docs.columns) for n in ("_size", "_source_size", "_target", "_copies")]


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """docs (doc_id, source, text, any other columns) with _size, _source_size, _target and _copies (see names).

    Null sources are one source, the last; null and empty texts have size 0; a source without words has the target 0.
    Repeated rows count each, and have the same number of copies. No rows, no result.
    """
    t = targets(docs.select("source", "text"), weights, max_repeats)
    size, source_size, target, copies_ = names(docs)
    own = fresh("_source", docs.columns)
    t = t.select(F.col("source").alias(own), F.col("source_size").alias(source_size), F.col("target").alias(target))
    sized = docs.withColumn(size, words(F.col("text")))
    out = join_checked(sized, t, F.col("source").eqNullSafe(F.col(own)), "left").drop(own)
    rate = F.when(F.col(source_size) > 0, F.least(F.col(target) / F.col(source_size), F.lit(float(max_repeats)))).otherwise(0.0)
    more = (coin(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("int")
    return out.withColumn(copies_, (F.floor(rate) + more).cast("int"))


def mixed(docs: DataFrame, **kw) -> DataFrame:
    """docs with each document as often as the mix takes it; columns as given."""
    out, times = copies(docs, **kw), names(docs)[-1]
    # a document comes once per element, and not at all for none
    out = out.withColumn(fresh("_copy", out.columns), F.explode(F.sequence(F.lit(1), F.greatest(F.col(times), F.lit(1)))))
    return out.where(F.col(times) > 0).select(docs.columns)
