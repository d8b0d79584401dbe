"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits are majority votes over the XXH64 hashes of word shingles. Two fingerprints that differ in at
most two bits differ in at most one bit in one of their 32-bit halves. For each half the anchors are a covering code:
the perfect [31, 26] Hamming code (covering radius 1) times one free bit. A fingerprint lives at its nearest anchor and
is replicated to every anchor within the covering radius plus the half's threshold of one, which are at most 17, so two
halves within one bit always meet at the nearest anchor of either. They are compared per anchor, on all 64 bits.

An anchor where more than HOT_HOMES fingerprints live is split exactly: the other halves of a link differ in at most
two bits, so one of three parts of the other half is equal, and that part joins the anchor in the key. The same anchors
also find all fingerprints that differ in three bits, with four parts.
Only distinct fingerprints are compared; copies share one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatelens.llm import shingles
from gatelens.llm.common import Scratch, join_checked, over_batches, texts
from gatelens.llm.components import connected_components, thin

SEED = 42
WORDS = 3
BITS = 2
#: Fingerprints at one anchor above which the anchor is split by parts of the other half.
HOT_HOMES = 512
CHUNK = 1 << 18


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The fingerprint as an unsigned integer; zero for a text without words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not w:
        return 0
    flat = b" ".join(w)
    digest = xxhash.xxh64_digest
    if len(w) <= words:
        return int.from_bytes(digest(flat, seed), "big")
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    a, b = starts[: len(w) - words + 1].tolist(), ends[words - 1 :].tolist()
    votes, n = np.zeros(64, np.int64), len(a)
    for i in range(0, n, CHUNK):
        h = b"".join([digest(flat[x:y], seed) for x, y in zip(a[i : i + CHUNK], b[i : i + CHUNK], strict=True)])
        votes += np.unpackbits(np.frombuffer(h, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def _fingerprints(batch: pa.RecordBatch) -> pa.RecordBatch:
    fps = np.array([fingerprint(t) for t in texts(batch)], dtype=np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id long, fp long): fp holds the 64 bits of the fingerprint as a signed integer."""
    return over_batches(docs.select(F.col("doc_id").cast("long"), "text"), _fingerprints, "doc_id long, fp long")


def with_fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """The rows (row, with a text) with the text's fingerprint as _key."""
    at = docs.columns.index("row")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, words) for t in b.column(at).field("text").to_pylist()], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(fps, pa.int64())], [*b.schema.names, "_key"])

    return over_batches(docs, run, T.StructType([*docs.schema.fields, T.StructField("_key", T.LongType())]))


def _syndromes(x: np.ndarray) -> np.ndarray:
    """For 31-bit words, the exclusive or of the places (1 to 31) of the bits that are set."""
    s = np.zeros(len(x), np.int64)
    for place in range(1, 32):
        s ^= np.where((x >> (place - 1)) & 1, place, 0)
    return s


#: Row s: the pairs of places i < j with i xor j = s; place 0 stands for no flip, so the first pair is the nearest anchor.
PAIRS = np.array([[(i, i ^ s) for i in range(32) if i < i ^ s] for s in range(1, 32)], dtype=np.int64)


def _anchors(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows (half, anchor, fp, home) of a batch of distinct fingerprints."""
    fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
    bits = fp.view(np.uint64)
    flips = np.concatenate(([0], 1 << np.arange(31)))
    keys, who, home = [], [], []
    for half in (0, 1):
        word = ((bits >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        low, free = word & 0x7FFFFFFF, word & 0x80000000
        s = _syndromes(low)
        nearest = low ^ flips[s]
        tag = np.int64(half) << 32
        keys += [tag | free | nearest, tag | (free ^ 0x80000000) | nearest]
        who += [fp, fp]
        home += [np.ones(len(fp), bool), np.zeros(len(fp), bool)]
        off = np.flatnonzero(s)  # codewords have no other anchor within 2
        pairs = PAIRS[s[off] - 1]
        more = low[off, None] ^ flips[pairs[:, 1:, 0]] ^ flips[pairs[:, 1:, 1]]
        keys.append((tag | free[off, None] | more).ravel())
        who.append(np.repeat(fp[off], more.shape[1]))
        home.append(np.zeros(more.size, bool))
    cols = [np.concatenate(x) for x in (keys, who, home)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["anchor", "fp", "home"])


def links(fps: DataFrame, scratch: Scratch, hot_homes: int = HOT_HOMES, bits: int = BITS) -> DataFrame:
    """Edges (a long, b long) of all pairs of a table of distinct fingerprints (fp long) that differ in at most so many bits."""
    if bits not in (2, 3):
        raise ValueError("the anchors cover two or three bits")
    at = scratch.save(over_batches(fps.select("fp"), _anchors, "anchor long, fp long, home boolean"))
    hot = at.where("home").groupBy("anchor").count().where(F.col("count") > hot_homes)
    hot = scratch.save(hot.select("anchor", F.lit(True).alias("hot")), files=8)
    # the other half: bits 32-63 for anchors of half 0, bits 0-31 for those of half 1
    shift = F.when(F.shiftright("anchor", 32) == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp")).bitwiseAND(F.lit(0xFFFFFFFF))
    width = -(-32 // (bits + 1))
    parts = [F.shiftright(shift, width * j).bitwiseAND(F.lit((1 << width) - 1)).bitwiseOR(F.lit((j + 1) << width)).cast("int") for j in range(bits + 1)]
    keyed = join_checked(at, hot, "anchor", "left").withColumn("part", F.explode(F.when(F.col("hot"), F.array(*parts)).otherwise(F.array(F.lit(0)))))
    keyed = keyed.select("anchor", "part", "fp", "home")
    a, b = keyed.where("home").drop("home").withColumnRenamed("fp", "a"), keyed.drop("home").withColumnRenamed("fp", "b")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    return a.hint("merge").join(b, ["anchor", "part"]).where(near).select("a", "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id long, fp long, component_id long) per row of docs (doc_id, text, any other columns).

    component_id is the smallest doc_id that links reach, the row's own included. A null or empty text, or one of white
    space, has the fingerprint zero and links like any other; repeated rows come back as often as they are given. A row
    without doc_id still links and gets the smallest id of its component, null if that has none. No rows, no result.
    """
    scratch = Scratch(docs.sparkSession)
    fps = scratch.save(fingerprints(docs))
    classes = scratch.save(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    comp = connected_components(links(classes, scratch), scratch)
    of = classes.join(comp, classes.fp == comp.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("first").alias("component_id"))
    of = scratch.save(of.join(least, "root").select("fp", "component_id"))
    return join_checked(fps, of, "fp", "left").select("doc_id", "fp", "component_id")


def hex_digits(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_classes(rows: DataFrame, bits: int, scratch: Scratch) -> DataFrame:
    """(a long, b long): pairs of classes that join all whose fingerprints differ in at most so many bits; rows as of shingles.keyed.

    A fingerprint stands for the class of the least key that has it; its other classes are paired with that one.
    """
    classes = scratch.save(rows.where("_n > 0").groupBy("_key").agg(F.first("_fp").alias("fp")))
    of = scratch.save(classes.groupBy("fp").agg(F.min("_key").alias("rep")))
    own = join_checked(classes, of, "fp", "inner").where("_key <> rep").select(F.col("rep").alias("a"), F.col("_key").alias("b"))
    near = scratch.save(thin(links(of, scratch, bits=bits)).distinct())  # a crowd of near fingerprints has no square of pairs
    for c in "ab":
        near = join_checked(near, of.select(F.col("fp").alias(c), F.col("rep").alias(f"r{c}")), c, "inner")
    return near.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).union(own)


def keep_one(docs: DataFrame, words: int = WORDS, similarity: float | None = None, bits: int = BITS) -> DataFrame:
    """The document with the smallest doc_id of each component, every column kept; of repeated rows one stays.

    Documents link whose fingerprints differ in at most so many bits. With a similarity, the fingerprints are those of
    the sets of shingles, and such pairs link if the sets have at least that Jaccard similarity. At a similarity of 0.8
    fingerprints differ in about 10 bits, more than anchors can cover: so the sets themselves are joined for the links
    between components that remain, and none is lost.
    Rows without doc_id stay only if their component has no row with one, and then all of them stay.
    """
    scratch = Scratch(docs.sparkSession)
    # the columns of docs travel in one struct, so that none can clash
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct("*").alias("row"))
    rows = scratch.save(shingles.keyed(docs, words) if similarity is not None else with_fingerprints(docs, words))
    classes = scratch.save(rows.groupBy("_key").agg(F.min("id").alias("first")))
    if similarity is not None:
        edges = shingles.links(rows, words, similarity, scratch, near_classes(rows, bits, scratch))
    else:
        edges = links(classes.select(F.col("_key").alias("fp")), scratch, bits=bits)
    comp = connected_components(edges, scratch)
    of = scratch.save(classes.join(comp, classes._key == comp.node, "left").select("_key", "first", F.coalesce("root", "_key").alias("root")))
    # ids may repeat in other components, so a row is known by its id and key
    best = of.groupBy("root").agg(F.min(F.when(F.col("first").isNotNull(), F.struct("first", "_key"))).alias("best"))
    stay = scratch.save(of.join(best, "root").where("best is null or best._key = _key").select("_key", F.col("best.first").alias("_id")))
    kept = join_checked(rows, stay, "_key", "inner")
    named = kept.where(F.col("id") == F.col("_id")).dropDuplicates(["_key"])
    return named.select("row.*").union(kept.where("_id is null").select("row.*"))
