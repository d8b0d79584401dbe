"""Helpers that the corpus operators share: Arrow batches of texts, scratch tables, size-checked broadcasts."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens.sources.scratch import _WRITTEN as written
from gatelens.sources.scratch import scratch_root

#: Rows a table may have to be broadcast; larger tables are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Rows and bytes in an Arrow batch of texts: bound what a Python worker holds at once; a longer text is a batch of its own.
TEXT_BATCH_ROWS, TEXT_BATCH_BYTES = 256, 32 << 20


class Scratch:
    """Tables written to the shared folder to cut lineage: a lost executor costs a reread, not a recomputation."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/gatelens-{uuid.uuid4().hex}"
        self.n = 0
        written.append(self.root)  # deleted when the process ends

    def save(self, df: DataFrame, files: int | None = None) -> DataFrame:
        """files: at most so many, for tables known to be small."""
        self.n += 1
        path = f"{self.root}/{self.n:04d}"
        (df.coalesce(files) if files else df).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Delete a table that no later step reads."""
        path = getattr(df, "_scratch_path", None)
        if path:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            with contextlib.suppress(Exception):
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def release(self) -> None:
        """Have shuffle files of steps that are done deleted: Spark does so once the driver's JVM has collected what names them."""
        self.spark._jvm.System.gc()


def fresh(name: str, taken: list[str]) -> str:
    """A column name that no column has, upper and lower case alike."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"{name}_"
    return name


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most so many rows; reads no more than that many and one."""
    return df.limit(rows + 1).count() <= rows


def join_checked(left: DataFrame, right: DataFrame, on, how: str = "left", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join that broadcasts the right side only after counting it; else a shuffle join, whose skew AQE splits."""
    return left.join(F.broadcast(right) if small(right, rows) else right.hint("merge"), on, how)


def text_batches(spark: SparkSession) -> None:
    """Small Arrow batches, so that long texts don't pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BATCH_BYTES))


def over_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow of a function on one batch."""
    text_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = fn(b)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null reads as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def fold_column(name: str = "doc_id", k: int = 3):
    """crc32 of the id as text, modulo k; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % k


def over_runs(df: DataFrame, keys: list[str], fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """fn on the rows of each key, which are dealt and sorted by it; cheaper than a grouped map for many small groups."""
    at = [df.columns.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        left: pa.Table | None = None

        def cut(table: pa.Table, last: bool):
            n = table.num_rows
            edge = np.zeros(n, bool)
            edge[0] = True
            for k in at:
                c = table.column(k).to_numpy()
                edge[1:] |= c[1:] != c[:-1]
            starts = [*np.flatnonzero(edge).tolist(), n]
            stop = len(starts) - 1 if last else len(starts) - 2
            whole = table.combine_chunks()
            return [whole.slice(a, b - a) for a, b in zip(starts[:stop], starts[1 : stop + 1], strict=True)], whole.slice(starts[stop])

        def given(groups: list[pa.Table]) -> Iterator[pa.RecordBatch]:
            out = [r for g in groups for r in [fn(g.combine_chunks().to_batches()[0])] if r is not None and r.num_rows]
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            left = t if left is None or not left.num_rows else pa.concat_tables([left, t])
            groups, left = cut(left, False)
            yield from given(groups)
        if left is not None and left.num_rows:
            yield from given(cut(left, True)[0])

    dealt = df.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, schema)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
