"""Embedders: what turns texts into vectors, by name. They are objects with a name and encode(texts) -> rows."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.operators.signals import float_lists, hash_rows


class Embedder(Protocol):
    name: str

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Signed feature hashing; needs no model."""

    def __init__(self, dim: int = 768):
        self.dim = max(64, int(dim))
        self.name = f"hash:{self.dim}"

    def encode(self, texts: list[str]) -> np.ndarray:
        return hash_rows(texts, self.dim)


class TransformerEmbedder:
    """A sentence-transformers model, loaded once in a worker; the package is only needed where it is used."""

    def __init__(self, model: str):
        self.model, self.name, self._loaded = model, f"sentence-transformers:{model}", None

    def encode(self, texts: list[str]) -> np.ndarray:
        if self._loaded is None:
            from sentence_transformers import SentenceTransformer

            self._loaded = SentenceTransformer(self.model)
        return np.asarray(self._loaded.encode(texts), np.float32)

    def __getstate__(self):
        return self.__dict__ | {"_loaded": None}


def make(backend: str = "auto", model: str = "", dim: int = 768) -> Embedder:
    """hash, sentence-transformers, or auto: the model's if the package is there, else hashing."""
    if backend == "hash":
        return HashEmbedder(dim)
    if backend not in ("auto", "sentence-transformers"):
        raise ValueError(f"unknown embedder: {backend}")
    if backend == "auto":
        import importlib.util

        if not model or importlib.util.find_spec("sentence_transformers") is None:
            return HashEmbedder(dim)
    return TransformerEmbedder(model)


def embed(df: DataFrame, columns: dict[str, str], embedder: Embedder, key: str, batch: int = 64) -> DataFrame:
    """key and a unit vector for each text column, by its new name: columns {new: text}. Rows of zeros stay zeros."""
    names = list(columns)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                cols = []
                for j in range(1, part.num_columns):
                    v = np.nan_to_num(embedder.encode([t or "" for t in part.column(j).to_pylist()]).astype(np.float64), nan=0.0, posinf=0.0, neginf=0.0)
                    n = np.linalg.norm(v, axis=1, keepdims=True)
                    cols.append(float_lists(v / np.where(n <= 1e-12, 1, n)))
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], [key, *names])

    return df.select(key, *[F.col(c).cast("string") for c in columns.values()]).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"`{n}` array<double>" for n in names))
