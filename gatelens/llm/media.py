"""A media column for the image query: the tables hold no images, so every vector of embeddings is drawn as one.

Each component scales a fixed smooth texture, so near vectors give near images. By its id, an image is drawn whole,
cropped, or with its contrast and brightness changed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.llm.common import over_batches
from gatelens.llm.imagedesc import pgm

SIDE = 96


#: Textures by number; a plain table, as what functools caches travels to executors by name alone.
_KNOWN: dict[int, np.ndarray] = {}


def textures(n: int) -> np.ndarray:
    if n in _KNOWN:
        return _KNOWN[n]
    rng = np.random.default_rng(8)
    out = []
    for _ in range(n):
        coarse, fine = rng.standard_normal((21, 21)), rng.standard_normal((45, 45))
        big = [_enlarge(c, SIDE) for c in (coarse, fine)]
        out.append(big[0] + 0.8 * big[1])
    _KNOWN[n] = np.stack(out).reshape(n, -1)
    return _KNOWN[n]


def _enlarge(x: np.ndarray, side: int) -> np.ndarray:
    at = np.linspace(0, len(x) - 1.001, side)
    i, f = at.astype(int), at - at.astype(int)
    rows = x[i] * (1 - f)[:, None] + x[i + 1] * f[:, None]
    return rows[:, i] * (1 - f) + rows[:, i + 1] * f


def draw(vector: list[float], edit: int) -> np.ndarray:
    v = np.array(vector, np.float64)
    x = (v / max(np.linalg.norm(v), 1e-12)) @ textures(len(v))
    x = x.reshape(SIDE, SIDE) / 1.1 * 45 + 128
    if edit == 1:
        x = x[7:-5, 9:-4]
    elif edit == 2:
        x = (x - 128) * 0.8 + 140
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def drawn(vectors: DataFrame) -> DataFrame:
    """(media_id, image) for each row of vectors (vec_id, embedding); a vector that can't be drawn has a null image."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            fine = v and all(x is not None and np.isfinite(x) for x in v)
            out.append(pgm(draw(v, (i or 0) % 3)) if fine else None)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["media_id", "image"])

    # vectors are small and images are not: a file of vectors is work for many tasks
    tasks = 4 * vectors.sparkSession.sparkContext.defaultParallelism
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).repartition(tasks, "vec_id")
    return over_batches(rows, run, "media_id long, image binary")


