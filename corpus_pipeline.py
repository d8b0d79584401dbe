"""A corpus from raw documents to token counts: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens.llm import linededup, mixing, piecebpe, puquality, simhash
from gatelens.llm.common import Scratch, read
from gatelens.llm.queries import tokenizer_model

#: Near duplicates of the pipeline: shingles of so many words, their least Jaccard similarity, and the bits in which fingerprints may differ.
NEAR_WORDS, NEAR_SIMILARITY, NEAR_BITS = 5, 0.8, 3


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return puquality.keep_good(docs, read(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that a later document repeats; n_chars follows."""
    out = linededup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        dropped = out.columns[-1]
        out = out.withColumn("n_chars", F.when(F.col(dropped) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by fingerprints at anchors and then by the sets of shingles for links farther apart."""
    return simhash.keep_one(docs, NEAR_WORDS, NEAR_SIMILARITY, NEAR_BITS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document: counts, and hashes of ids and decoded texts."""
    return piecebpe.tokens(docs, tokenizer_model())


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", keep_one_copy),
    ("mixing to target weights", mix),
    ("SentencePiece", tokenize),
]
#: The first, third and last stage are not expressible in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
