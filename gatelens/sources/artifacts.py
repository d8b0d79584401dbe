"""Files around a run: workbooks and unions of sources, paths of embedding caches and what belongs to them, and the latest summary."""

from __future__ import annotations

import json
import re
import zipfile
from dataclasses import dataclass
from functools import reduce
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens.sources import tables

SPACE = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def read_workbook(spark: SparkSession, path: str, sheets: list[str] | None = None) -> DataFrame:
    """The rows of a workbook's sheets, one below the other, as texts, with _sheet; the first row of a sheet has the names.

    A workbook is read on the driver: it is a file for people, of a million rows a sheet at most.
    """
    with zipfile.ZipFile(path) as z:
        parse = lambda name: ElementTree.fromstring(z.read(name))
        shared = ["".join(t.text or "" for t in s.iter(f"{{{SPACE['m']}}}t")) for s in parse("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in z.namelist() else []
        targets = {r.get("Id"): r.get("Target").lstrip("/").removeprefix("xl/") for r in parse("xl/_rels/workbook.xml.rels")}
        found, rows = [], []
        for s in parse("xl/workbook.xml").find("m:sheets", SPACE):
            if sheets is not None and s.get("name") not in sheets:
                continue
            found.append(s.get("name"))
            names: dict[int, str] = {}
            for i, row in enumerate(parse(f"xl/{targets[s.get(REL)]}").iter(f"{{{SPACE['m']}}}row")):
                cells = {}
                for j, c in enumerate(row.findall("m:c", SPACE)):
                    at = reduce(lambda n, x: n * 26 + ord(x) - 64, re.match(r"[A-Z]*", c.get("r") or "")[0], 0) - 1 if c.get("r") else j
                    v = c.find("m:v", SPACE)
                    text = "".join(t.text or "" for t in c.iter(f"{{{SPACE['m']}}}t")) if c.get("t") == "inlineStr" else None if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text
                    if text is not None:
                        cells[at] = text
                if i == 0:
                    names = cells
                elif cells:
                    rows.append({"_sheet": s.get("name"), **{names[k]: t for k, t in cells.items() if k in names}})
    missing = set(sheets or ()) - set(found)
    if missing:
        raise ValueError(f"no such sheets: {', '.join(sorted(missing))}")
    cols = list(dict.fromkeys(k for r in rows for k in r)) or ["_sheet"]
    return spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows], ", ".join(f"`{c}` string" for c in cols))


def union_sources(parts: list[DataFrame], names: dict[str, str], label: Column | list[str], fill: dict[str, str] | None = None) -> DataFrame:
    """Sources one below the other under common names, with eval: a value for each source, or an expression on the union.

    names: {old: new}; fill: {column: another whose value it takes where it has none}, by their old names.
    """
    if isinstance(label, list):
        parts = [p.withColumn("eval", F.lit(v)) for p, v in zip(parts, label, strict=True)]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    for c, other in (fill or {}).items():
        out = out.withColumn(c, F.coalesce(c, other))
    if not isinstance(label, list):
        out = out.withColumn("eval", label)
    return out.withColumnsRenamed({k: v for k, v in names.items() if k in out.columns})


@dataclass(frozen=True)
class CachePaths:
    """Where the vectors of a run and what is known of them lie."""

    inputs: str
    outputs: str
    meta: str


def cache_paths(folder: str, tag: str, stem: str, mode: str = "") -> CachePaths:
    base = f"{folder.rstrip('/')}/_temp/embeddings/{tag}_{stem}{f'_{mode}' if mode else ''}"
    return CachePaths(f"{base}_input_norm.parquet", f"{base}_output_norm.parquet", f"{base}_embedding_cache.json")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def resolve_cache(spark: SparkSession, folder: str, tag: str, stem: str, meta: str | None = None) -> CachePaths:
    """The paths of a run's cache: its own, those of the former naming if only they are there, or with a given meta file."""
    own, former = cache_paths(folder, tag, stem), cache_paths(folder, tag, stem, "nomask")
    if meta:
        return CachePaths(own.inputs, own.outputs, meta)
    whole = lambda c: all(_exists(spark, p) for p in (c.inputs, c.outputs, c.meta))
    return former if whole(former) and not whole(own) else own


def stamp(rows: int, dim: int, embedder: str, source: str = "rebuild") -> dict:
    return {"source": source, "embedder": embedder, "rows": rows, "dim": dim, "dtype": "float32"}


def write_cache(spark: SparkSession, paths: CachePaths, vectors: DataFrame, key: str, embedder: str, source: str = "rebuild") -> dict:
    """Store unit vectors (key, x, y) as single precision, and what made them."""
    one = lambda c: vectors.select(key, F.col(c).cast("array<float>").alias("v"))
    one("x").write.mode("overwrite").parquet(paths.inputs)
    one("y").write.mode("overwrite").parquet(paths.outputs)
    first = spark.read.parquet(paths.inputs).agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    meta = stamp(first["n"], first["d"] or 0, embedder, source)
    p = spark._jvm.org.apache.hadoop.fs.Path(paths.meta)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(json.dumps(meta, sort_keys=True).encode()))
    out.close()
    return meta


def load_cache(spark: SparkSession, paths: CachePaths, key: str, embedder: str | None = None, rows: int | None = None) -> DataFrame:
    """key, x, y of a stored cache; an error if it was made by another embedder, or of other rows, or its sides differ."""
    meta = json.loads("".join(r.value for r in spark.read.text(paths.meta).collect()))  # one small file
    if embedder is not None and meta.get("embedder") != embedder:
        raise ValueError(f"the cache was made by {meta.get('embedder')}")
    if rows is not None and meta.get("rows") != rows:
        raise ValueError(f"the cache holds {meta.get('rows')} rows")
    x, y = (spark.read.parquet(p) for p in (paths.inputs, paths.outputs))
    out = x.select(key, F.col("v").cast("array<double>").alias("x")).join(y.select(key, F.col("v").cast("array<double>").alias("y")), key)
    if out.count() != meta.get("rows") or not out.where(F.size("x") != F.size("y")).isEmpty():
        raise ValueError("the sides of the cache differ")
    return out


def load_or_rebuild(spark: SparkSession, paths: CachePaths, key: str, rows: DataFrame, embedder, columns: dict[str, str], rebuild: bool = False) -> DataFrame:
    """Stored vectors if they are of these rows and this embedder, else made and stored."""
    from gatelens.sources.embedders import embed

    if not rebuild:
        try:
            have = load_cache(spark, paths, key, embedder.name, rows.count())
            if rows.select(key).join(have.select(key), key, "left_anti").isEmpty():
                return have
        except Exception:  # noqa: BLE001  whatever is wrong with it, it is made anew
            pass
    write_cache(spark, paths, embed(rows, columns, embedder, key), key, embedder.name)
    return load_cache(spark, paths, key)


def peer_cache(row_results: str, folder: str, tag: str, stem: str, given: str = "") -> tuple[str, str]:
    """The meta file that belongs to a table of row results, and where that is known from: given, its run's configuration, or the usual place."""
    if given:
        return given, "given"
    here = Path(row_results).parent
    for config in sorted(here.glob("*run_config.json")):
        try:
            held = json.loads(config.read_text())
        except ValueError:
            continue
        for where, part in (("run configuration", held), ("nested run configuration", held.get("run_config") or {})):
            meta = str((part.get("embedding_cache") or {}).get("meta_json") or "").strip() if isinstance(part, dict) else ""
            if meta:
                return meta, where
    return cache_paths(folder, tag, stem).meta, "usual place"


def latest_summary(root: str, column: str = "hard_gate_pass_rate") -> str:
    """The newest summary table under a folder that has a column."""
    folder = Path(root)
    if not folder.is_dir():
        raise FileNotFoundError(root)
    found = sorted((p for p in folder.rglob("*summary.csv") if "thresholds_summary" not in p.name), key=lambda p: p.stat().st_mtime, reverse=True)
    for p in found:
        with p.open(encoding="utf-8-sig") as f:
            if column in f.readline().strip().split(","):
                return str(p)
    raise FileNotFoundError(f"no summary with {column} under {root}")


def hard_gate_summary(spark: SparkSession, path: str) -> DataFrame:
    """pass_rate and its score of a summary table."""
    from gatelens.functions.scalar import HARD_GATE, bucket, rate

    x = tables.read_csv(spark, path)[0]
    return x.select(rate(F.col("hard_gate_pass_rate").cast("double")).alias("pass_rate")).withColumn("score", bucket("pass_rate", HARD_GATE))
