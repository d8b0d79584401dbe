"""Pages of a run as HTML with drawings in SVG: histograms, boxes, leaves, arrows between inputs and outputs. No other package is needed.

Tables are made by DataFrame plans; what is drawn on the driver is one row per bin, leaf or box, or a bounded sample of rows.
"""

from __future__ import annotations

import html
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatelens.functions.scalar import finite
from gatelens.operators import leaves, relational, stats
from gatelens.sources.scratch import saved, with_group

GOOD, BAD, LINE = "#2a9d8f", "#e76f51", "#33415c"
STYLE = "body{font:14px sans-serif;margin:2em;color:#222}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.2em .6em;text-align:right}h2{margin-top:2em}svg{background:#fafafa}"


def document(title: str, *parts: str) -> str:
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>{STYLE}</style></head><body><h1>{html.escape(title)}</h1>{''.join(parts)}</body></html>"


def _text(v) -> str:
    return "" if v is None else html.escape(f"{v:.4g}" if isinstance(v, float) else str(v))


def table(df: DataFrame, caption: str = "", most: int = 500) -> str:
    """A small table; a page shows so many rows at most."""
    rows = df.limit(most + 1).collect()
    more = f"<p>first {most} rows</p>" if len(rows) > most else ""
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{_text(v)}</td>" for v in r) + "</tr>" for r in rows[:most])
    return f"<h2>{html.escape(caption)}</h2><table><tr>{head}</tr>{body}</table>{more}"


def _svg(width: int, height: int, *shapes: str) -> str:
    return f"<svg xmlns='http://www.w3.org/2000/svg' width='{width}' height='{height}'>{''.join(shapes)}</svg>"


def bars(bins: list[tuple[float, float, int, int]], lines: dict[str, float] | None = None, width: int = 640, height: int = 180) -> str:
    """A histogram of (left, right, rows, marked rows), the marked ones coloured, with lines at values."""
    if not bins:
        return "<p>no values</p>"
    low, high, most = bins[0][0], bins[-1][1], max(1, *(b[2] for b in bins))
    at = lambda v: (v - low) / max(high - low, 1e-12) * width
    shapes = []
    for left, right, n, marked in bins:
        w = max(1.0, at(right) - at(left) - 1)
        for k, colour in ((n, GOOD), (marked, BAD)):
            h = k / most * (height - 20)
            shapes.append(f"<rect x='{at(left):.1f}' y='{height - h:.1f}' width='{w:.1f}' height='{h:.1f}' fill='{colour}'/>")
    for name, v in (lines or {}).items():
        if v is not None and low <= v <= high:
            shapes.append(f"<line x1='{at(v):.1f}' x2='{at(v):.1f}' y1='0' y2='{height}' stroke='{LINE}'/><text x='{at(v) + 3:.1f}' y='12' font-size='11'>{html.escape(name)}</text>")
    return _svg(width, height, *shapes)


def boxes(rows: list, width: int = 640) -> str:
    """Boxes of rows (name, low, q1, med, q3, high)."""
    if not rows:
        return "<p>no values</p>"
    low, high = min(r[1] for r in rows), max(r[5] for r in rows)
    at = lambda v: 120 + (v - low) / max(high - low, 1e-12) * (width - 140)
    shapes = []
    for i, (name, a, b, m, c, d) in enumerate(rows):
        y = 20 + 30 * i
        shapes.append(f"<text x='4' y='{y + 4}' font-size='12'>{html.escape(str(name))}</text><line x1='{at(a):.1f}' x2='{at(d):.1f}' y1='{y}' y2='{y}' stroke='{LINE}'/>")
        shapes.append(f"<rect x='{at(b):.1f}' y='{y - 9}' width='{max(1, at(c) - at(b)):.1f}' height='18' fill='{GOOD}'/><line x1='{at(m):.1f}' x2='{at(m):.1f}' y1='{y - 9}' y2='{y + 9}' stroke='white'/>")
    return _svg(width, 30 * len(rows) + 20, *shapes)


# tables behind the pages ----------------------------------------------------------------------------------------------
def signal_bins(df: DataFrame, by: list[str], signal: str, bad: str | None = None, bins: int = 60) -> DataFrame:
    """by, bin, left_edge, right_edge, n, n_bad, bad_ratio of every group's signals."""
    x = df.select(*by, finite(signal).alias("signal"), (F.coalesce(F.col(bad), F.lit(False)) if bad else F.lit(False)).alias("_b")).where("signal is not null")
    h = leaves.histograms(x.withColumn("available", F.lit(True)).withColumn("pass", ~F.col("_b")), by, "signal", bins)
    return h.select(*by, "bin", "left_edge", "right_edge", "n", F.col("n_failed").alias("n_bad"), F.try_divide(F.col("n_failed"), F.col("n")).alias("bad_ratio"))


def diagnostics(df: DataFrame, by: list[str], signal: str, state: str, bad: str | None = None) -> DataFrame:
    """by, rows, box values, shares of states, and the share of bad rows among those that fail."""
    b = stats.boxplot(df, by, signal).select(*by, "n", "low", "q1", "med", "q3", "high", "outliers")
    s = F.col(state)
    failed = s.isin("fail", "hard_fail")
    y = F.coalesce(F.col(bad), F.lit(False)) if bad else F.lit(None).cast("boolean")
    g = df.groupBy(*by).agg(*[F.avg((s == k).cast("double")).alias(f"{k}_rate") for k in ("pass", "warn", "fail", "hard_fail")], F.avg(F.when(failed, y.cast("double"))).alias("bad_precision"))
    return with_group(b, g, by)


def arrows(points: DataFrame, key: str, anomalous: str, conflict: str, bad: str | None = None, passed: str | None = None) -> DataFrame:
    """key, x0, y0, x1, y1, kind and, with labels, outcome (TP, FP, TN, FN): the way from input to output; points (key, ix, iy, ox, oy)."""
    kind = F.when(F.col(conflict), "conflict").when(F.col(anomalous), "anomaly").otherwise("normal")
    out = points.withColumn("kind", kind)
    if bad and passed:
        flagged = ~F.col(passed)
        outcome = F.when(F.col(bad).isNull(), None).when(flagged & F.col(bad), "TP").when(flagged, "FP").when(F.col(bad), "FN").otherwise("TN")
        out = out.withColumn("outcome", outcome)
    return out.select(key, F.col("ix").alias("x0"), F.col("iy").alias("y0"), F.col("ox").alias("x1"), F.col("oy").alias("y1"), "kind", *(["outcome"] if bad and passed else []))


def arrow_page(arrows_: DataFrame, key: str, most: int = 400, seed: str = "42") -> str:
    """A drawing of so many arrows at most, anomalies first."""
    rows = relational.priority_sample(arrows_.withColumn("_a", F.col("kind") != "normal"), key, "_a", most, seed).collect()  # a drawing's sample
    if not rows:
        return document("Inputs and outputs", "<p>no rows</p>")
    v = np.array([[r.x0, r.y0, r.x1, r.y1] for r in rows], float)
    low, high = np.nanmin(v.reshape(-1, 2), axis=0), np.nanmax(v.reshape(-1, 2), axis=0)
    place = lambda x, y: ((x - low[0]) / max(high[0] - low[0], 1e-12) * 600 + 20, (y - low[1]) / max(high[1] - low[1], 1e-12) * 600 + 20)
    colour = {"normal": GOOD, "anomaly": BAD, "conflict": "#8338ec"}
    shapes = []
    for r, (a, b, c, d) in zip(rows, v, strict=True):
        if np.isfinite((a, b, c, d)).all():
            (x0, y0), (x1, y1) = place(a, b), place(c, d)
            shapes.append(f"<line x1='{x0:.1f}' y1='{y0:.1f}' x2='{x1:.1f}' y2='{y1:.1f}' stroke='{colour[r.kind]}' stroke-opacity='.5'><title>{html.escape(str(r[key]))}</title></line><circle cx='{x1:.1f}' cy='{y1:.1f}' r='2' fill='{colour[r.kind]}'/>")
    return document("Inputs and outputs", _svg(640, 640, *shapes))


def clusters(points: list[tuple[float, float]], k: int = 8, quantile: float = 0.65, least: int = 20, pad: float = 1.12) -> list[tuple[float, float, float, int]]:
    """Circles (x, y, radius, points) around components of the graph of near points, of edges up to a quantile of lengths. points: a drawing's sample."""
    p = np.array([q for q in points if all(map(math.isfinite, q))], float).reshape(-1, 2)
    if len(p) < max(2, least):
        return []
    d = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, : min(k, len(p) - 1)]
    length = np.take_along_axis(d, near, 1)
    cut = np.quantile(length, quantile)
    up = list(range(len(p)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in zip(*np.nonzero(length <= cut), strict=True):
        up[root(int(i))] = root(int(near[i, j]))
    of = np.array([root(i) for i in range(len(p))])
    out = []
    for c in np.unique(of):
        own = p[of == c]
        if len(own) >= least:
            x, y = own.mean(axis=0)
            out.append((float(x), float(y), float(np.hypot(*(own - (x, y)).T).max() * pad), len(own)))
    return sorted(out, key=lambda q: -q[3])


# pages ----------------------------------------------------------------------------------------------------------------
def signal_page(df: DataFrame, rule: str, signal: str, thresholds: dict[str, float] | None = None, bad: str | None = None, bins: int = 60) -> str:
    """Histograms of every rule's signals over all groups, with thresholds as lines. df (rule, signal)."""
    rows = signal_bins(df, [rule], signal, bad, bins).orderBy(rule, "bin").collect()  # rules times bins
    parts = []
    for name in dict.fromkeys(r[rule] for r in rows):
        own = [(r.left_edge, r.right_edge, r.n, r.n_bad) for r in rows if r[rule] == name]
        parts.append(f"<h2>{html.escape(str(name))}</h2>{bars(own, {k.split(':')[-1]: v for k, v in (thresholds or {}).items() if k.split(':')[0] == name})}")
    return document("Signals", *parts)


def leaf_page(hits: DataFrame, most: int = 120) -> str:
    """Distributions of the leaves of most support, and their histograms. hits as in operators.leaves."""
    d = saved(leaves.distribution(hits, ["leaf"]))
    top = d.orderBy(F.desc("support"), "leaf").limit(most)
    names = [r.leaf for r in top.collect()]
    h = leaves.histograms(hits.where(F.col("leaf").isin(names)), ["leaf"]).orderBy("leaf", "bin").collect() if names else []
    parts = [table(top, "Leaves", most)]
    for n in names:
        parts.append(f"<h2>{html.escape(str(n))}</h2>{bars([(r.left_edge, r.right_edge, r.n, r.n_failed) for r in h if r.leaf == n])}")
    return document("Leaves", *parts)


def diagnostics_page(df: DataFrame, rule: str, signal: str, state: str, bad: str | None = None, hits: DataFrame | None = None, drawings: bool = True) -> tuple[str, DataFrame]:
    """A page of boxes, histograms and states by rule, with leaves if there are any, and the table it shows; plain tables without drawings."""
    d = saved(diagnostics(df, [rule], signal, state, bad))
    parts = [table(d, "Rules")]
    if drawings:
        parts.append(boxes([(r[rule], r.low, r.q1, r.med, r.q3, r.high) for r in d.orderBy(rule).collect()]))
        for r in [x[0] for x in d.select(rule).orderBy(rule).collect()]:
            own = signal_bins(df.where(F.col(rule) == r), [rule], signal, bad).orderBy("bin").collect()
            parts.append(f"<h2>{html.escape(str(r))}</h2>{bars([(b.left_edge, b.right_edge, b.n, b.n_bad) for b in own])}")
    if hits is not None:
        parts.append(table(leaves.distribution(hits, ["leaf"]).orderBy(F.desc("fail_rate"), "leaf"), "Leaves"))
    return document("Diagnostics", *parts), d


def geometry_page(points: DataFrame, key: str, flagged: str, bad: str | None = None, most: int = 2000) -> str:
    """Inputs and outputs of a sample of rows on their main axes, flagged ones marked, with circles around clusters of outputs."""
    rows = relational.priority_sample(points, key, flagged, most).collect()  # a drawing's sample
    if not rows:
        return document("Geometry", "<p>no rows</p>")
    v = np.array([[r.ix, r.iy, r.ox, r.oy] for r in rows], float)
    low, high = np.nanmin(v.reshape(-1, 2), axis=0), np.nanmax(v.reshape(-1, 2), axis=0)
    scale = np.maximum(high - low, 1e-12)
    dots = []
    for r, p in zip(rows, v, strict=True):
        for (x, y), colour in (((p[0], p[1]), "#adb5bd"), ((p[2], p[3]), BAD if r[flagged] else GOOD)):
            if math.isfinite(x) and math.isfinite(y):
                edge = f" stroke='{LINE}'" if bad and r[bad] else ""
                dots.append(f"<circle cx='{(x - low[0]) / scale[0] * 600 + 20:.1f}' cy='{(y - low[1]) / scale[1] * 600 + 20:.1f}' r='3' fill='{colour}'{edge}/>")
    for x, y, radius, _ in clusters([(p[2], p[3]) for p in v]):
        dots.append(f"<circle cx='{(x - low[0]) / scale[0] * 600 + 20:.1f}' cy='{(y - low[1]) / scale[1] * 600 + 20:.1f}' r='{radius / scale.max() * 600:.1f}' fill='none' stroke='{LINE}' stroke-dasharray='4'/>")
    return document("Geometry", _svg(640, 640, *dots))


def write_page(spark, text: str, path: str) -> None:
    """A page to a file, wherever the path is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def ranked(df: DataFrame, order: list, most: int) -> DataFrame:
    """The first rows of a table in an order, numbered."""
    return df.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order)))
