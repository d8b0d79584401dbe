"""One query per operator over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens.llm import htmltemplate, imagedesc, linededup, media, mixing, nndescent, piecebpe, puquality, simhash, surrogates, weaktox
from gatelens.llm.common import read


#: Of the registered query only; a corpus takes its own.
SURROGATE_KEY = b"key of the registered query"


def tokenizer_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = surrogates.replace_entities(docs, SURROGATE_KEY)
    return out.select("doc_id", "text", F.size("_entities").cast("long").alias("n_entities"), F.to_json("_entities").alias("entities"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = linededup.dedup_lines(docs)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weaktox.score_toxicity(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return puquality.score_quality(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltemplate.main_text(read(spark, sf_dir, "pages"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.near_duplicates(read(spark, sf_dir, "embeddings"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = mixing.copies(docs)
    return out.select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_size") * F.col("_copies")).alias("taken"),
    )


def op8_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imagedesc.image_copies(media.drawn(read(spark, sf_dir, "embeddings")))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecebpe.tokens(read(spark, sf_dir, "documents"), tokenizer_model())


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_surrogates": op1_surrogates,
    "op2_line_dedup": op2_line_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_quality": op4_quality,
    "op5_main_text": op5_main_text,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_mix_sources": op7_mix_sources,
    "op8_image_copies": op8_image_copies,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_simhash_dedup": op10_simhash_dedup,
    "pipeline": pipeline,
}

# RE2 and Java agree on these classes; DuckDB's trim takes the characters to strip.
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate(%s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op2_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents),
keyed AS (SELECT doc_id, line, place, {_LOWER % f"trim(line, {_BLANK})"} AS key FROM lines),
counts AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.line, k.place, c.last IS NOT NULL AND k.doc_id < c.last AS gone
  FROM keyed k LEFT JOIN counts c ON k.key = c.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op7_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM per),
ordered AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT
            - coalesce(sum(3 * source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS over_,
         (sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS share
  FROM weighed),
level AS (
  SELECT over_, share FROM ordered WHERE 3 * source_size * share > over_ * weight ORDER BY source_size / weight, source NULLS LAST LIMIT 1),
stops AS (
  SELECT o.source, o.source_size,
         CASE WHEN l.share IS NULL OR 3 * o.source_size * l.share <= l.over_ * o.weight THEN (3 * o.source_size)::DOUBLE
              ELSE l.over_::DOUBLE * o.weight / l.share END AS target
  FROM ordered o LEFT JOIN level l ON true),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0) ELSE 0.0 END AS rate FROM stops)
SELECT d.doc_id, d.size, r.source_size, r.target,
       (d.size * (floor(r.rate) + CASE WHEN ('0x' || md5(d.doc_id::VARCHAR || ':mix-1')[1:8])::BIGINT / 4294967296.0::DOUBLE < r.rate - floor(r.rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source""",
}
