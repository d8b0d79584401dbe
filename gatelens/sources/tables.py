"""Sources and sinks: tables, CSV with encodings tried in turn, chat traces, JSON lines, caches of embeddings."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatelens.functions.scalar import id_or_position

ENCODINGS = ("utf-8", "utf-8-sig", "euc-kr", "cp949")
MESSAGES = "array<struct<role: string, content: string>>"
INSTRUCTION_ROWS = "key int, instruction_id_list array<string>, prompt string, kwargs array<map<string, string>>"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, encodings: tuple[str, ...] = ENCODINGS) -> tuple[DataFrame, str]:
    """The first encoding that gives no replacement characters wins; for those beyond UTF-8 the session is told to allow Java's."""
    for e in encodings:
        try:
            if not e.startswith("utf-8"):
                spark.conf.set("spark.sql.legacy.javaCharsets", "true")
            df = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8" if e == "utf-8-sig" else e)
            damaged = F.lit(False)
            for c in df.columns:
                damaged = damaged | F.coalesce(F.contains(F.col(f"`{c}`"), F.lit("�")), F.lit(False))
            if df.columns and not df.where(damaged).isEmpty():
                continue
            return df.withColumnRenamed(df.columns[0], df.columns[0].lstrip("﻿")) if df.columns else df, e
        except PySparkException:
            continue
    raise RuntimeError(f"no encoding reads {path}")


def with_row_index(df: DataFrame, *order: str) -> DataFrame:
    """df with row_index from 0 in the given order, by ranks within ranges and counts before them: no task sorts all rows."""
    from gatelens.operators.windows import ordered

    x = ordered(df.withColumn("_all", F.lit(0)).withColumn("_o", F.struct(*order)), ["_all"], "_o", order[-1])
    return x.withColumn("row_index", F.col("_i") - 1).drop("_all", "_o", "_i", "_n", "_next")


def messages(c: Column) -> Column:
    """Messages of a list, of an object with messages, or of one message."""
    one = F.from_json(c, "role string, content string")
    many = F.from_json(c, f"messages {MESSAGES}")["messages"]
    first = F.substring(F.ltrim(c), 1, 1)
    return F.when(first == "[", F.from_json(c, MESSAGES)).when(many.isNotNull(), many).when(one["role"].isNotNull(), F.array(one))


def _joined(c: Column, role: str) -> Column:
    own = F.filter(messages(c), lambda m: (m["role"] == role) & (F.trim(F.coalesce(m["content"], F.lit(""))) != ""))
    text = F.array_join(F.transform(own, lambda m: F.trim(m["content"])), "\n\n")
    return F.when(text != "", text)


def _keys(c: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.when(F.trim(F.get_json_object(c, f"$.{k}")) != "", F.get_json_object(c, f"$.{k}")) for k in keys])


def system_text(c: Column) -> Column:
    return F.coalesce(_joined(c, "system"), F.lit(""))


def user_text(c: Column) -> Column:
    return F.coalesce(_joined(c, "user"), _keys(c, ("user_input", "input", "query", "question", "content")), c)


def assistant_text(c: Column) -> Column:
    return F.coalesce(_joined(c, "assistant"), _keys(c, ("content", "response", "answer", "output", "text")), c)


INPUT, OUTPUT, ID, LABEL = ("input", "prompt_input", "request"), ("output", "expectedOutput", "response"), ("id", "traceId", "trace_id"), ("eval", "label", "score")


def first_column(df: DataFrame, names: tuple[str, ...]) -> str | None:
    return next((n for n in names if n in df.columns), None)


def trace_rows(df: DataFrame, default_eval: str = "correct") -> DataFrame:
    """id, Prompt, input, expectedOutput, eval from a chat-trace export."""
    i, o, k, e = (first_column(df, n) for n in (INPUT, OUTPUT, ID, LABEL))
    if not i or not o:
        raise ValueError("a trace export needs an input and an output column")
    df = df.withColumn("_i", F.monotonically_increasing_id()) if not k else df.withColumn("_i", F.lit(None).cast("long"))
    return df.select(
        (id_or_position(F.col(k), "_i") if k else F.col("_i").cast("string")).alias("id"), system_text(F.col(i)).alias("Prompt"), user_text(F.col(i)).alias("input"), assistant_text(F.col(o)).alias("expectedOutput"),
        (F.coalesce(F.when(F.trim(F.col(e)) != "", F.trim(F.col(e))), F.lit(default_eval)) if e else F.lit(default_eval)).alias("eval"),
    )


def conversation_pairs(turns: DataFrame) -> DataFrame:
    """conv_id, turn, prompt, input, output: each user turn with the next assistant turn, and the conversation's system text."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = turns.withColumn("_next_role", F.lead("role").over(w)).withColumn("output", F.lead("text").over(w))
    x = x.withColumn("prompt", F.coalesce(F.max(F.when(F.col("role") == "system", F.col("text"))).over(Window.partitionBy("conv_id")), F.lit("__all__")))
    return x.where((F.col("role") == "user") & (F.col("_next_role") == "assistant")).select("conv_id", "turn", "prompt", F.col("text").alias("input"), "output")


def read_instruction_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INSTRUCTION_ROWS).json(path)


def prompt_responses(spark: SparkSession, path: str) -> DataFrame:
    """prompt, response of a JSON-lines file; of a repeated prompt the last counts."""
    rows = spark.read.schema("prompt string, response string").json(path).withColumn("_i", F.monotonically_increasing_id())
    return rows.groupBy("prompt").agg(F.max_by("response", "_i").alias("response"))


def write_rows(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """parquet, json, or csv, where lists are joined by pipes."""
    if kind == "csv":
        for f in df.schema:
            if isinstance(f.dataType, T.ArrayType):
                df = df.withColumn(f.name, F.array_join(f.name, "|"))
            elif isinstance(f.dataType, (T.MapType, T.StructType)):
                df = df.withColumn(f.name, F.to_json(f.name))
        df.write.mode("overwrite").csv(path, header=True, escape='"')
    else:
        df.write.mode("overwrite").format(kind).save(path)


def cached_embeddings(spark: SparkSession, path: str, rows: DataFrame, key: str, make) -> DataFrame:
    """Vectors stored at path if they are those of all rows; made by make(rows) and stored if not."""
    try:
        have = spark.read.parquet(path)
        if have.count() == rows.count() and rows.select(key).join(have.select(key), key, "left_anti").isEmpty():
            return have
    except PySparkException:
        pass
    make(rows).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def json_columns(df: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """df with the leaves of a JSON column as columns named by it and their path, and _parse_error; keys: the paths, or all that there are."""
    from gatelens.operators.gates import json_leaves, strict_json

    x = df.withColumn("_parse_error", ~F.coalesce(strict_json(F.col(column)), F.lit(False))).withColumn("_leaves", json_leaves(F.col(column)))
    if keys is None:
        keys = sorted(r[0] for r in x.select(F.explode(F.map_keys("_leaves"))).distinct().collect())  # as many as the result has columns
    return x.withColumns({f"{column}.{k}": F.col("_leaves")[k] for k in keys}).drop("_leaves")
