"""Made-up benchmarks: answers to graded questions with good and bad rows, flat or nested, the same for a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUBJECTS = ("the river", "a bridge", "the old town", "this recipe", "the engine", "a novel", "the treaty", "an island")
FACTS = ("is known for its length", "was finished in spring", "needs little care", "has two parts", "changed the region", "is seldom visited")
#: Bad rows by family: wrong verdicts, broken form, noise, vagueness.
BAD = {
    "verdict": ("flipped", "contradicting", "unsupported"),
    "form": ("broken_json", "missing_key", "extra_key"),
    "noise": ("off_topic", "padded", "repeated"),
    "vague": ("hedged", "short", "two_sided"),
}
KINDS = [(family, kind) for family, kinds in BAD.items() for kind in kinds]


def pick(values, *parts) -> Column:
    """One of the values by a hash of columns."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(*parts), F.lit(len(values))) + 1).cast("int"))


def benchmark(spark: SparkSession, good: int, bad: int, seed: int = 42, prompt: str = "Grade the answer. Reply as JSON.") -> DataFrame:
    """id, Prompt, input, expectedOutput, eval, family, kind: bad rows take the twelve kinds in turn."""
    x = spark.range(good + bad).withColumn("bad", F.col("id") >= good)
    s = F.lit(seed)
    subject, fact, truth = pick(SUBJECTS, s, "id"), pick(FACTS, s, F.lit(1), "id"), F.pmod(F.xxhash64(s, F.lit(2), "id"), F.lit(2)) == 0
    answer = F.concat(subject, F.lit(" "), F.when(truth, fact).otherwise(pick(FACTS, s, F.lit(3), "id")))
    at = F.pmod(F.col("id") - good, F.lit(len(KINDS))).cast("int")
    family, kind = (F.when(F.col("bad"), F.element_at(F.array(*[F.lit(k[i]) for k in KINDS]), at + 1)) for i in (0, 1))
    x = x.withColumns({"subject": subject, "fact": fact, "truth": truth, "answer": answer, "family": family, "kind": kind})
    yes = F.when(F.col("kind").isin("flipped", "contradicting"), ~F.col("truth")).otherwise(F.col("truth"))
    why = F.concat(F.lit("The answer about "), F.col("subject"), F.when(F.col("truth"), " matches").otherwise(" does not match"), F.lit(" the reference, which says that it "), F.col("fact"), F.lit("."))
    why = (
        F.when(F.col("kind") == "off_topic", "I like long walks and warm weather.").when(F.col("kind") == "short", "Hm.").when(F.col("kind") == "hedged", F.concat(F.lit("Perhaps, or perhaps not; "), why))
        .when(F.col("kind") == "two_sided", F.concat(why, F.lit(" It could also be read the other way."))).when(F.col("kind") == "padded", F.concat(why, F.repeat(F.lit(" By the way, words."), 12)))
        .when(F.col("kind") == "repeated", F.repeat(why, 4)).when(F.col("kind") == "unsupported", "It is so because it is so.").otherwise(why)
    )
    plain = F.to_json(F.struct(F.when(yes, "correct").otherwise("incorrect").alias("is_correct"), why.alias("feedback")))
    out = F.when(F.col("kind") == "broken_json", F.substring(plain, 1, 40)).when(F.col("kind") == "missing_key", F.to_json(F.struct(why.alias("feedback")))).when(F.col("kind") == "extra_key", F.to_json(F.struct(F.when(yes, "correct").otherwise("incorrect").alias("is_correct"), why.alias("feedback"), F.lit(1).alias("mood")))).otherwise(plain)
    question = F.concat(F.lit("Question: what is true of "), F.col("subject"), F.lit("?\nReference: it "), F.col("fact"), F.lit(".\nAnswer: "), F.col("answer"), F.lit("."))
    return x.select(F.col("id").cast("string").alias("id"), F.lit(prompt).alias("Prompt"), question.alias("input"), out.alias("expectedOutput"), F.when(F.col("bad"), "incorrect").otherwise("correct").alias("eval"), "family", "kind")


def nested_benchmark(spark: SparkSession, good: int, bad: int, seed: int = 42, depth: int = 3) -> DataFrame:
    """The same with the output's verdict and texts some levels down, beside lists of parts."""
    x = benchmark(spark, good, bad, seed)
    inner = F.col("expectedOutput")
    for level in range(depth, 0, -1):
        parts = F.to_json(F.array(*[F.struct(F.lit(f"part {i}").alias("name"), F.pmod(F.xxhash64(F.lit(seed + i), "id"), F.lit(5)).alias("grade")) for i in range(2)]))
        inner = F.concat(F.lit(f'{{"level_{level}": '), inner, F.lit(f', "parts_{level}": '), parts, F.lit("}"))
    return x.withColumn("expectedOutput", F.when(F.col("kind") == "broken_json", F.substring(inner, 1, 60)).otherwise(inner))
