"""Exact set-similarity join of word shingles: all pairs of texts whose shingle sets have a Jaccard similarity of at least s.

In any order of all shingles, two such sets share one of the first n - ceil(s n) + 1 of either, so pairs that meet at one
of these, and whose sizes and places there allow the similarity, are all that need a check. Shingles that a sample of the
texts shows in many of them come last in the order. Equal sets are one class and need no pair.

At each shingle a few classes, those of the least hashes, the same at all shingles that hold them, are hubs, and are paired
with the others first, so a large group of near copies gives pairs in proportion to itself. What hubs pass over matters only
between different components, and there all pairs are compared.
Classes carry parity sketches, whose distance is at most that of the sets, to the shingles, so that pairs too far apart are
never written; the others are held against the sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatelens.llm.common import Scratch, join_checked, over_batches, over_runs, text_batches, texts
from gatelens.llm.components import connected_components

SEED = 42
#: Least bytes of a parity sketch, and most that travel with a class to its shingles.
SKETCH, CARRIED = 32, 64
#: Texts of which one is sampled; times a shingle stands in the sample to come late in the order; most of these.
SAMPLED, OFTEN, MOST_OFTEN = 16, 8, 200_000
#: Classes that a task knows it has given already.
MOST_SEEN = 1 << 20
#: Hubs of a shingle.
HUBS = 4
BLOCK = 1024
#: Pairs of sketches compared at once.
PAIRS = 1 << 16
EPS = 1e-9


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Distinct hashes of the shingles, sorted; a text of fewer words is one shingle, one without words has none."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # as the fingerprint reads words
    digest = xxhash.xxh64_intdigest
    return np.array(sorted({digest(b" ".join(w[i : i + words]), SEED) for i in range(max(1, len(w) - words + 1))} if w else ()), np.uint64).view(np.int64)


def majority(s: np.ndarray) -> int:
    """The SimHash of a set of hashes, as a signed integer: a bit is 1 if it is in over half of them; zero for the empty set."""
    votes = np.unpackbits(s.byteswap().view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(s)).tobytes(), "big", signed=True)


def _sketch(s: np.ndarray) -> bytes:
    """Parities of the set's counts per low bits of the hash; at least a bit for each member, a power of two in all."""
    bits = max(8 * SKETCH, 1 << (max(1, len(s)) - 1).bit_length())
    return np.packbits((np.bincount(s & (bits - 1), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _apart(sketch: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bits in which the sketches of pairs differ, the longer folded to the other's length."""
    size = np.array([len(p) for p in sketch])
    out = np.zeros(len(i), np.int64)
    for u, w in {*zip(size[i].tolist(), size[j].tolist(), strict=True)}:
        own = np.flatnonzero((size[i] == u) & (size[j] == w))
        k = min(u, w)
        folded = {}
        for q in {u, w}:
            at = np.flatnonzero(size == q)
            rows = np.frombuffer(b"".join([sketch[x] for x in at.tolist()]), np.uint8).reshape(len(at), -1, k)
            folded[q] = (np.searchsorted(at, np.arange(len(size))), np.bitwise_xor.reduce(rows, axis=1))
        (pu, x), (pw, y) = folded[u], folded[w]
        for lo in range(0, len(own), PAIRS):
            part = own[lo : lo + PAIRS]
            out[part] = np.bitwise_count(x[pu[i[part]]] ^ y[pw[j[part]]]).sum(axis=1, dtype=np.int64)
    return out


def keyed(docs: DataFrame, words: int) -> DataFrame:
    """The rows (row, with a text) with _key, equal for equal shingle sets (zero for the empty one), _n, the set's size, _sketch, and _fp, its SimHash."""
    at = docs.columns.index("row")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, words) for t in b.column(at).field("text").to_pylist()]
        keys = [int(np.frombuffer(xxhash.xxh64_digest(s.tobytes(), SEED), np.int64)[0]) if len(s) else 0 for s in sets]
        more = [pa.array(keys, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([_sketch(s) for s in sets], pa.binary()), pa.array([majority(s) for s in sets], pa.int64())]
        return pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "_key", "_n", "_sketch", "_fp"])

    more = [T.StructField("_key", T.LongType()), T.StructField("_n", T.LongType()), T.StructField("_sketch", T.BinaryType()), T.StructField("_fp", T.LongType())]
    schema = T.StructType([*docs.schema.fields, *more])
    return over_batches(docs, run, schema)


def _often(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, sorted, that stand often in a sample, and how often."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *(shingle_set(t, words) for t in texts(b))]))], ["t"])

    part = rows.where(F.pmod(F.xxhash64("_key"), F.lit(SAMPLED)) == 0).select(F.col("row.text").alias("text"))
    n = over_batches(part, run, "t long").groupBy("t").count().where(F.col("count") >= OFTEN)
    got = sorted((r.t, r["count"]) for r in n.orderBy(F.desc("count"), "t").limit(MOST_OFTEN).collect())
    return np.array([t for t, _ in got], np.int64), np.array([c for _, c in got], np.int64)


def _least(n, similarity: float):
    return np.ceil(similarity * n - EPS).astype(np.int64)


def prefixes(rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """(t, key, pos, n): the shingles at which a set of size n meets others, and their places in its order; a class may repeat."""
    late, count = _often(rows, words)
    shared = rows.sparkSession.sparkContext.broadcast((late, count))

    def some(b: pa.RecordBatch, seen: set[int]) -> pa.RecordBatch:
        late, count = shared.value
        out: list[tuple] = []
        for text, key in zip(texts(b), b.column(1).to_pylist(), strict=True):
            if key in seen:
                continue
            if len(seen) >= MOST_SEEN:
                seen.clear()
            seen.add(key)
            s = shingle_set(text, words)
            if not len(s):
                continue
            k = len(s) - int(_least(np.array(len(s)), similarity)) + 1
            rank = np.zeros(len(s), np.int64)
            if len(late):
                at = np.minimum(np.searchsorted(late, s), len(late) - 1)
                rank = np.where(late[at] == s, count[at], 0)
            t = s[np.lexsort((s, rank))[:k]]
            out.append((t, np.full(k, key), np.arange(k), np.full(k, len(s))))
        cols = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(4)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["t", "key", "pos", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            yield some(b, seen)

    return rows.select(F.col("row.text").alias("text"), "_key").mapInArrow(run, "t long, key long, pos long, n long")


def _fit(pos: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether pairs whose first common shingle this may be can have the similarity."""
    a, b = n[i], n[j]
    most = 1 + np.minimum(a - pos[i], b - pos[j]) - 1
    return (np.minimum(a, b) >= similarity * np.maximum(a, b) - EPS) & (most >= similarity / (1 + similarity) * (a + b) - EPS)


def candidates(at: DataFrame, similarity: float, hubs: int | None) -> DataFrame:
    """(a, b): pairs of different components (comp) that meet and may be near; those with so many hubs, or all."""

    def run(g: pa.RecordBatch) -> pa.RecordBatch | None:
        m = g.num_rows
        if m < 2:
            return None
        key, pos, n, comp = (g.column(g.schema.get_field_index(c)).to_numpy() for c in ("key", "pos", "n", "comp"))
        if (comp == comp[0]).all():
            return None
        sketch = [p or b"\0" for p in g.column(g.schema.get_field_index("p")).to_pylist()]
        known = np.array([len(p) > 1 for p in sketch])

        def may(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            ok = _fit(pos, n, i, j, similarity)
            i, j = i[ok], j[ok]
            both = n[i] + n[j]
            far = both - 2 * _least(similarity / (1 + similarity) * both, 1.0)
            ok = np.ones(len(i), bool)
            told = np.flatnonzero(known[i] & known[j])
            ok[told] = _apart(sketch, i[told], j[told]) <= far[told]
            return i[ok], j[ok]

        if hubs is not None:
            # an odd factor and a shift mix the bits
            mixed = (key.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
            first = np.argsort(mixed ^ (mixed >> np.uint64(29)))[:hubs]
            i, j = np.repeat(first, m), np.tile(np.arange(m), len(first))
            twice = np.isin(j, first) & (j >= i)  # a pair of hubs comes once
            i, j = may(i[~twice], j[~twice])
        else:
            order = np.lexsort((key, n))
            key, pos, n, comp, sketch = key[order], pos[order], n[order], comp[order], [sketch[k] for k in order.tolist()]
            known = known[order]
            pairs = []
            for lo in range(0, m, BLOCK):
                # sizes ascend: no later one of more than n / similarity can be a partner
                end = int(np.searchsorted(n, n[min(lo + BLOCK, m) - 1] / similarity + 1))
                for to in range(lo, end, BLOCK):
                    i, j = np.nonzero(comp[lo : lo + BLOCK, None] != comp[None, to : to + BLOCK])
                    i, j = i + lo, j + to
                    ok = i < j
                    pairs.append(may(i[ok], j[ok]))
            i, j = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(key[i], key[j])), pa.array(np.maximum(key[i], key[j]))], ["a", "b"])

    return over_runs(at, ["t"], run, "a long, b long").distinct()


def _verified(pairs: DataFrame, rows: DataFrame, words: int, similarity: float, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) that have the similarity: by the sketches of long sets, then by the sets."""
    given = pairs
    known = rows.groupBy("_key").agg(F.first("_n").alias("n"), F.first("_sketch").alias("p"))
    x, y = (known.select(F.col("_key").alias(c), F.col("n").alias(f"n{c}"), F.col("p").alias(f"p{c}")) for c in "ab")

    def near(b: pa.RecordBatch) -> pa.RecordBatch:
        n = b.column(2).to_numpy() + b.column(4).to_numpy()
        own = [*b.column(3).to_pylist(), *b.column(5).to_pylist()]
        at = np.arange(b.num_rows)
        return b.select(["a", "b"]).filter(pa.array(_apart(own, at, at + b.num_rows) <= n - 2 * _least(similarity / (1 + similarity) * n, 1.0)))

    both = pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").select("a", "b", "na", "pa", "nb", "pb")
    pairs = scratch.save(over_batches(both, near, "a long, b long"))

    def sets(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t, words).tobytes() for t in texts(b)], pa.binary())], ["key", "s"])

    asked = pairs.select(F.col("a").alias("_key")).union(pairs.select(F.col("b").alias("_key"))).distinct()
    own = join_checked(rows.select("_key", F.col("row.text").alias("text")), scratch.save(asked), "_key", "left_semi").dropDuplicates(["_key"])
    own = scratch.save(over_batches(own.select("_key", "text"), sets, "key long, s binary"))

    def check(b: pa.RecordBatch) -> pa.RecordBatch:
        ok = []
        for s, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            s, t = np.frombuffer(s, np.int64), np.frombuffer(t, np.int64)
            both = len(np.intersect1d(s, t, assume_unique=True))
            ok.append(both >= similarity * (len(s) + len(t) - both) - EPS)
        return b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    x, y = (own.select(F.col("key").alias(c), F.col("s").alias(f"s{c}")) for c in "ab")
    out = pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").select("a", "b", "sa", "sb")
    good = scratch.save(over_batches(out, check, "a long, b long"))
    for used in (given, pairs, own):
        scratch.drop(used)
    return good


def links(rows: DataFrame, words: int, similarity: float, scratch: Scratch, suggested: DataFrame) -> DataFrame:
    """Edges (a long, b long) of keys, whose components are those of all pairs with the similarity; rows as of keyed, saved.

    suggested: pairs (a long, b long) that are held against the sets first, with those of hubs.
    """
    text_batches(rows.sparkSession)
    # shingles of one class are dropped, however many its copies are; dealt by shingle alone, so that they are dealt once
    at = prefixes(rows, words, similarity).repartition("t").dropDuplicates(["t", "key"])
    w = Window.partitionBy("t")
    at = at.withColumn("lo", F.min("key").over(w)).withColumn("hi", F.max("key").over(w)).where("lo < hi").drop("lo", "hi")
    carried = F.when(F.length("_sketch") <= CARRIED, F.col("_sketch")).alias("p")
    sketches = rows.select(F.col("_key").alias("key"), carried).dropDuplicates(["key"])
    at = scratch.save(at.join(sketches.hint("merge"), "key"))
    pairs = candidates(at.withColumn("comp", F.col("key")), similarity, HUBS).union(suggested).distinct()
    first = _verified(scratch.save(pairs), rows, words, similarity, scratch)
    comp = connected_components(first, scratch).select(F.col("node").alias("key"), "root")
    left = join_checked(at, comp, "key", "left").withColumn("comp", F.coalesce("root", "key")).drop("root")
    out = first.union(_verified(scratch.save(candidates(left, similarity, None)), rows, words, similarity, scratch))
    scratch.drop(at)
    return out
