"""Reversible line deduplication: exact reference-count tables, and sharded cuckoo filters before them.

A line's key is the line stripped of ASCII white space with A-Z lower-cased; it is stored as 128 hash bits. Postings
(key, doc_id) are the exact record: inserting documents adds theirs, deleting takes them away, so counts go down as
they went up. Reference counts (documents holding a key, the largest of them) are counted from postings, after a change
of the touched keys only. Keys held by enough documents, the repeated ones, are dealt into shards; a shard holds their
counts, sorted, and a cuckoo filter of them, which insertions and deletions change in place. A lookup asks the filter of
its shard first, and only lines it admits meet the exact counts. Where all shards together are few they travel to the
texts, and no text is moved; else postings travel to the shards, a shard's spread over as many tasks as they need.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatelens.llm.common import Scratch, fresh, over_batches, text_batches, texts

MIN_CHARS = 20
MIN_DOCS = 3
#: Keys a shard's filter is made for, slots of a bucket, and kicks before a filter grows.
SHARD_KEYS = 1 << 16
SLOTS = 4
KICKS = 500
#: Repeated keys up to which the shards travel to the texts.
BROADCAST_KEYS = 500_000
#: Postings of a shard that a task looks up at once.
TASK_POSTINGS = 1 << 20
#: Changes after which the layers of postings are written as one table, and the fill at which keys are dealt to more shards.
LAYERS, CROWDED = 8, 2


def line_keys(text: str, min_chars: int = MIN_CHARS) -> tuple[list[str], list[bytes | None]]:
    """The lines of a text and the key of each; None for keys that are too short."""
    lines = text.split("\n")
    keys: list[bytes | None] = []
    for line in lines:
        k = line.encode("utf-8", "surrogatepass").strip().lower()  # of bytes: ASCII only
        keys.append(None if len(k) < min_chars or (len(k) < 4 * min_chars and len(k.decode("utf-8", "surrogatepass")) < min_chars) else xxhash.xxh3_128_digest(k))
    return lines, keys


def _split_keys(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    two = np.frombuffer(b"".join(keys), ">i8").astype(np.int64).reshape(-1, 2)
    return two[:, 0], two[:, 1]


class CuckooFilter:
    """16-bit fingerprints in buckets of four slots; keys are 64-bit hashes. Equal keys may be held more than once."""

    def __init__(self, keys: int):
        n = 1
        while n * SLOTS * 0.85 < max(keys, 1):
            n *= 2
        self.table = np.zeros((n, SLOTS), np.uint16)

    @classmethod
    def of(cls, raw: bytes) -> CuckooFilter:
        out = cls(1)
        out.table = np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy()
        return out

    def raw(self) -> bytes:
        return self.table.tobytes()

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = h.view(np.uint64)
        print_ = ((h >> np.uint64(48)).astype(np.uint16)) | np.uint16(1)
        one = (h & np.uint64(0xFFFFFFFF)).astype(np.int64) % len(self.table)
        return print_, one, one ^ self._jump(print_)

    def _jump(self, print_: np.ndarray) -> np.ndarray:
        return (print_.astype(np.int64) * 0x5BD1E995 & 0x7FFFFFFF) % len(self.table)

    def has(self, h: np.ndarray) -> np.ndarray:
        print_, one, two = self._places(h)
        return (self.table[one] == print_[:, None]).any(axis=1) | (self.table[two] == print_[:, None]).any(axis=1)

    def add(self, h: np.ndarray) -> bool:
        """False if the filter is too full for all of them; it is then as before."""
        before = self.table.copy()
        print_, one, two = self._places(h)
        for p, a, b in zip(print_.tolist(), one.tolist(), two.tolist(), strict=True):
            at = a
            for k in range(KICKS):
                free = np.flatnonzero(self.table[at] == 0)
                if not len(free) and k == 0:
                    at = b
                    free = np.flatnonzero(self.table[at] == 0)
                if len(free):
                    self.table[at, free[0]] = p
                    break
                slot = (k + p) % SLOTS
                p, self.table[at, slot] = int(self.table[at, slot]), p
                at = int(at ^ self._jump(np.array([p], np.uint16))[0])
            else:
                self.table = before
                return False
        return True

    def remove(self, h: np.ndarray) -> int:
        """Takes one entry of each key out; returns how many it found."""
        print_, one, two = self._places(h)
        found = 0
        for p, a, b in zip(print_.tolist(), one.tolist(), two.tolist(), strict=True):
            for at in (a, b):
                slot = np.flatnonzero(self.table[at] == p)
                if len(slot):
                    self.table[at, slot[0]] = 0
                    found += 1
                    break
        return found


def _postings(batch: pa.RecordBatch) -> pa.RecordBatch:
    ids, keys = [], []
    for i, t in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
        own = {k for k in line_keys(t)[1] if k} if i is not None else ()
        keys += own
        ids += [i] * len(own)
    k1, k2 = _split_keys(keys)
    return pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(ids, pa.int64())], ["k1", "k2", "doc_id"])


def postings(docs: DataFrame) -> DataFrame:
    """(k1, k2, doc_id), a row for each key of each document; repeated rows of a document may repeat them."""
    return over_batches(docs.select(F.col("doc_id").cast("long"), "text"), _postings, "k1 long, k2 long, doc_id long")


def reference_counts(posted: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(k1, k2, n_docs, last) of the keys that at least min_docs documents hold."""
    each = posted.groupBy("k1", "k2", "doc_id").agg(F.lit(1).alias("one"))  # dealt by key and document: no key is hot
    n = each.groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last"))
    return n.where(F.col("n_docs") >= min_docs)


def shard(shards: int):
    return F.pmod(F.xxhash64("k2"), F.lit(shards)).cast("int")


def filled(keys: np.ndarray) -> CuckooFilter:
    room = len(keys)
    while not (f := CuckooFilter(room)).add(keys):
        room = 2 * room + 1
    return f


SHARD = "shard int, filter binary, k1 binary, k2 binary, last binary"


def _state(number: int, f: CuckooFilter, k1: np.ndarray, k2: np.ndarray, last: np.ndarray) -> pd.DataFrame:
    at = np.lexsort((k2, k1))
    return pd.DataFrame({"shard": [number], "filter": [f.raw()], "k1": [k1[at].tobytes()], "k2": [k2[at].tobytes()], "last": [last[at].tobytes()]})


def _columns(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(pdf[c].to_numpy(np.int64) for c in ("k1", "k2", "last"))


def _fill(pdf: pd.DataFrame) -> pd.DataFrame:
    k1, k2, last = _columns(pdf)
    return _state(int(pdf["shard"].iloc[0]), filled(k1), k1, k2, last)


class Shard:
    """A shard's filter and its exact counts."""

    def __init__(self, row):
        self.filter = CuckooFilter.of(bytes(row["filter"]))
        self.k1, self.k2, self.last = (np.frombuffer(bytes(row[c]), np.int64) for c in ("k1", "k2", "last"))

    def lost(self, k1: np.ndarray, k2: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Whether a document loses the lines of a key: the key is repeated, and a larger doc_id holds it."""
        out = np.zeros(len(k1), bool)
        asked = np.flatnonzero(self.filter.has(np.ascontiguousarray(k1)))
        if not len(asked) or not len(self.k1):
            return out
        a, b = k1[asked], k2[asked]
        at = np.searchsorted(self.k1, a)
        found = np.full(len(asked), -1)
        while True:  # keys that share their first half lie side by side
            here = np.minimum(at, len(self.k1) - 1)
            live = (at < len(self.k1)) & (self.k1[here] == a)
            found = np.where(live & (self.k2[here] == b), here, found)
            at = at + 1
            if not (live & (found < 0)).any():
                break
        out[asked] = (found >= 0) & (doc[asked] < self.last[np.maximum(found, 0)])
        return out


class LineIndex:
    """State of incremental line deduplication over documents (doc_id, text, any other columns).

    A document with several rows counts once; rows without doc_id hold no keys and keep all their lines; null and empty
    texts are one empty line. Lines of fewer than MIN_CHARS code points always stay. Inserting an id that is held
    replaces that document.
    """

    def __init__(self, scratch: Scratch, layers: list[DataFrame], counts: DataFrame, shards: int, state: DataFrame, min_docs: int):
        self.scratch, self.layers, self.counts, self.shards, self.state, self.min_docs = scratch, layers, counts, shards, state, min_docs

    @property
    def posted(self) -> DataFrame:
        """The postings: each layer takes away the documents of its ids from those before, and adds its own."""
        out = None
        for layer in self.layers:
            own = layer.where("k1 is not null").select("k1", "k2", "doc_id")
            if out is None:
                out = own
            else:
                out = out.join(layer.select("doc_id").distinct(), "doc_id", "left_anti").select("k1", "k2", "doc_id").union(own)
        return out

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = MIN_DOCS, scratch: Scratch | None = None) -> LineIndex:
        scratch = scratch or Scratch(docs.sparkSession)
        posted = scratch.save(postings(docs))
        return cls._dealt(scratch, [posted], scratch.save(reference_counts(posted, min_docs)), min_docs)

    @classmethod
    def _dealt(cls, scratch: Scratch, layers: list[DataFrame], counts: DataFrame, min_docs: int) -> LineIndex:
        shards = max(1, -(-counts.count() // SHARD_KEYS))
        state = counts.select(shard(shards).alias("shard"), "k1", "k2", "last").groupBy("shard").applyInPandas(_fill, SHARD)
        return cls(scratch, layers, counts, shards, scratch.save(state), min_docs)

    def _changed(self, layer: DataFrame) -> LineIndex:
        """The state after a layer (k1, k2, doc_id; keys null for ids that hold none): only keys it touches are counted again."""
        layer = self.scratch.save(layer)
        before = self.posted
        ids = layer.select("doc_id").distinct()
        keys = ["k1", "k2"]
        touched = before.join(ids, "doc_id", "left_semi").select(keys).union(layer.where("k1 is not null").select(keys))
        touched = self.scratch.save(touched.distinct())
        grown = LineIndex(self.scratch, [*self.layers, layer], self.counts, self.shards, self.state, self.min_docs)
        fresh_counts = self.scratch.save(reference_counts(grown.posted.join(touched, keys, "left_semi"), self.min_docs))
        counts = self.scratch.save(self.counts.join(touched, keys, "left_anti").union(fresh_counts))
        layers = grown.layers if len(grown.layers) < LAYERS else [self.scratch.save(grown.posted)]
        if counts.count() > CROWDED * SHARD_KEYS * self.shards:
            return self._dealt(self.scratch, layers, counts, self.min_docs)
        old = self.counts.join(touched, keys, "left_semi").select(*keys, "last", F.lit(-1).alias("step"))
        moved = old.union(fresh_counts.select(*keys, "last", F.lit(1).alias("step"))).withColumn("shard", shard(self.shards))

        def update(key, state: pd.DataFrame, moved: pd.DataFrame) -> pd.DataFrame:
            if not len(moved):
                return state
            none = np.zeros(0, np.int64)
            now = Shard(state.iloc[0]) if len(state) else None
            f, k1, k2, last = (now.filter, now.k1, now.k2, now.last) if now else (CuckooFilter(1), none, none, none)
            gone, come = moved[moved["step"] == -1], moved[moved["step"] == 1]
            out = set(zip(gone["k1"], gone["k2"], strict=True))
            stay = np.array([k not in out for k in zip(k1.tolist(), k2.tolist(), strict=True)], bool) if out else np.ones(len(k1), bool)
            own = _columns(come)
            k1, k2, last = (np.concatenate([x[stay], y]) for x, y in zip((k1, k2, last), own, strict=True))
            f.remove(gone["k1"].to_numpy(np.int64))
            if not f.add(own[0]):  # too full: made anew, larger
                f = filled(k1)
            return _state(int(key[0]), f, k1, k2, last)

        state = self.state.groupBy("shard").cogroup(moved.groupBy("shard")).applyInPandas(update, SHARD)
        return LineIndex(self.scratch, layers, counts, self.shards, self.scratch.save(state), self.min_docs)

    def insert(self, docs: DataFrame) -> LineIndex:
        held = docs.select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct()
        return self._changed(postings(docs).union(held.select(F.lit(None).cast("long"), F.lit(None).cast("long"), "doc_id")))

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """The state without the documents of doc_ids (doc_id)."""
        held = doc_ids.select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct()
        return self._changed(held.select(F.lit(None).cast("long").alias("k1"), F.lit(None).cast("long").alias("k2"), "doc_id"))

    def losses(self) -> DataFrame:
        """(doc_id, lost array<binary>): the repeated keys whose lines a document loses, each once."""
        posted = self.scratch.save(self.posted) if len(self.layers) > 1 else self.layers[0]
        parts = max(1, -(-posted.count() // (TASK_POSTINGS * self.shards)))
        asked = posted.withColumn("shard", shard(self.shards)).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))
        state = self.state.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

        def look(asked: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
            if not len(state):
                return asked.iloc[:0][["k1", "k2", "doc_id"]]
            k1, k2, doc = (asked[c].to_numpy(np.int64) for c in ("k1", "k2", "doc_id"))
            return asked[Shard(state.iloc[0]).lost(k1, k2, doc)][["k1", "k2", "doc_id"]]

        at = asked.groupBy("shard", "part").cogroup(state.groupBy("shard", "part")).applyInPandas(look, "k1 long, k2 long, doc_id long")
        key = F.concat(F.unhex(F.lpad(F.hex("k1"), 16, "0")), F.unhex(F.lpad(F.hex("k2"), 16, "0")))
        return at.groupBy("doc_id").agg(F.collect_set(key).alias("lost"))

    def rewritten(self, docs: DataFrame, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
        """docs with their remaining text, plus _n_lines and _n_dropped, the last two columns; every column stays.

        A column of docs that has one of these names stays, and the new one gets underscores behind.
        """
        spark = docs.sparkSession
        text_batches(spark)
        names, shared = docs.columns, None
        more = [fresh(n, names) for n in ("_n_lines", "_n_dropped")]
        own_id = fresh("doc", names)
        if self.counts.count() <= broadcast_keys:
            shared = spark.sparkContext.broadcast([(r["k1"], r["k2"], r["last"], r["filter"], r["shard"]) for r in self.state.collect()])
            both = docs.withColumn(own_id, F.col("doc_id").cast("long"))
        else:
            lost, gone = self.losses().withColumnRenamed("doc_id", own_id), fresh("lost", names)
            both = docs.join(lost.withColumnRenamed("lost", gone), docs.doc_id.cast("long") == F.col(own_id), "left").drop(own_id)

        def by_shards(state: list[Shard | None], b: pa.RecordBatch) -> Iterator[set]:
            """Keys each document of a batch loses."""
            rows = [sorted({k for k in line_keys(t)[1] if k}) if i is not None else [] for i, t in zip(b.column(b.num_columns - 1).to_pylist(), texts(b), strict=True)]
            flat = [k for own in rows for k in own]
            if not flat:
                yield from (set() for _ in rows)
                return
            k1, k2 = _split_keys(flat)
            doc = np.repeat(np.array([i or 0 for i in b.column(b.num_columns - 1).to_pylist()], np.int64), [len(own) for own in rows])
            lost = np.zeros(len(flat), bool)
            for s in state:
                lost |= s.lost(k1, k2, doc)
            at = 0
            for own in rows:
                yield {k for k, x in zip(own, lost[at : at + len(own)].tolist(), strict=True) if x}
                at += len(own)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state = [Shard(dict(zip(("k1", "k2", "last", "filter"), r[:4], strict=True))) for r in shared.value] if shared else []
            for b in batches:
                kept, lines, dropped = [], [], []
                lost = by_shards(state, b) if shared else b.column(b.num_columns - 1).to_pylist()
                for t, gone in zip(texts(b), lost, strict=True):
                    if gone:
                        gone = set(gone)
                        all_lines, keys = line_keys(t)
                        stay = [x for x, k in zip(all_lines, keys, strict=True) if k not in gone]
                        kept.append("\n".join(stay))
                        lines.append(len(all_lines))
                        dropped.append(len(all_lines) - len(stay))
                    else:
                        kept.append(t)
                        lines.append(t.count("\n") + 1)
                        dropped.append(0)
                cols = [pa.array(kept, pa.string()) if c == "text" else b.column(i) for i, c in enumerate(names)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], [*names, *more])

        out = T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in more)])
        return both.mapInArrow(run, out)


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """All of docs inserted into a fresh index and rewritten by it. No rows, no result."""
    return LineIndex.build(docs, min_docs).rewritten(docs)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()
