"""Tables written to the shared folder to cut lineage, and joins of rows to what is known of their groups."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only on a local master without the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/gatelens-scratch"


_WRITTEN: list[str] = []


@atexit.register
def clear() -> None:
    """Delete the tables of this process; at its end, if not before. What still reads them must be done."""
    spark = SparkSession.getActiveSession()
    paths = list(_WRITTEN)
    _WRITTEN.clear()
    for path in paths if spark is not None else ():
        with contextlib.suppress(Exception):
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def saved(df: DataFrame) -> DataFrame:
    """df, written once and read again: what builds on it more than once doesn't compute it more than once."""
    path = f"{scratch_root(df.sparkSession)}/gatelens-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_group(df: DataFrame, groups: DataFrame, by: list[str], how: str = "left") -> DataFrame:
    """df joined to a table of groups on by, null groups to null groups.

    No hint: the groups' size is known when they are computed, and only then are they broadcast, if they are small.
    """
    if not by:
        return df.crossJoin(F.broadcast(groups))  # one row
    renamed = groups.select(*[F.col(f"`{c}`").alias(f"_by{i}") for i, c in enumerate(by)], *[c for c in groups.columns if c not in by])
    on = reduce(lambda a, b: a & b, [df[c].eqNullSafe(renamed[f"_by{i}"]) for i, c in enumerate(by)])
    return df.join(renamed, on, how).drop(*[f"_by{i}" for i in range(len(by))])
