"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The model has no piece in which a space follows anything but spaces, so a text splits exactly into units of spaces and
what follows them. Distinct units are encoded together: their symbols lie in one flat array; in each round every unit
finds its best-ranked adjacent pair (a segmented minimum), merges the leftmost occurrences of it, and the array is
compacted; units without a pair leave. A unit's other occurrences of the pair merge in the same round only if no pair
with the merged piece can rank before it (checked for each piece when the tables are built), as the library takes
one merge at a time, best rank first, leftmost first.

In a long unit (text without spaces), pairs of any rank merge in the same round if nothing that ranks before them can
ever reach them: no pair of their left symbol with a piece that ends in the symbol before it, none of their right symbol
with one that begins with the symbol after it, and none of the merged piece with either. What merges of those symbols
make still ends, or begins, with them, so the order of such merges makes no difference.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.llm.common import text_batches, texts

SPACE = "▁"
NONE = np.iinfo(np.int64).max
#: Units that a task keeps encoded.
CACHE_UNITS = 400_000
#: Symbols of a unit from which a round also looks for pairs that nothing can reach; in shorter ones the best pairs alone are cheaper.
LONG = 32
UNIT = re.compile(" *[^ ]+| +$")


class Tables:
    """What a BPE model with byte fallback says, as arrays."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model_file)
        self.size, self.end = sp.get_piece_size(), sp.eos_id()
        ids = range(self.size)
        self.pieces = [sp.id_to_piece(i) for i in ids]
        self.bytes = np.full(256, -1, np.int64)
        for i in ids:
            if sp.is_byte(i):
                self.bytes[int(self.pieces[i][1:-1], 16)] = i
        plain = {self.pieces[i]: i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        if any(SPACE in p.lstrip(SPACE) for p in plain) or (self.bytes < 0).any() or sp.encode(" a", out_type=str)[0][0] != SPACE:
            raise ValueError("the model needs byte fallback, a dummy prefix, and pieces with spaces only in front")
        self.chars = np.full(0x110000, -1, np.int64)
        for p, i in plain.items():
            if len(p) == 1:
                self.chars[ord(p)] = i
        scores = {i: sp.get_score(i) for i in plain.values()}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        keys, merged = [], []
        for p, i in plain.items():
            for k in range(1, len(p)):
                a, b = plain.get(p[:k]), plain.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    merged.append(i)
        at = np.argsort(np.array(keys, np.int64))
        self.keys, self.merged = np.array(keys, np.int64)[at], np.array(merged, np.int64)[at]
        self.rank = np.full(self.size, NONE, np.int64)
        for i, s in scores.items():
            self.rank[i] = order[s]
        # a piece's occurrences may merge together if all pairs that hold it rank after it
        first = np.full(self.size, NONE, np.int64)
        for side in (self.keys // self.size, self.keys % self.size):
            np.minimum.at(first, side, self.rank[self.merged])
        self.together = first > self.rank
        self._bounds(plain)
        self.control = {i for i in ids if sp.is_control(i)}
        self.byte_of = {int(i): b for b, i in enumerate(self.bytes)}
        # what an id is read as, None for bytes, and its digits
        self.shown = [None if i in self.byte_of else "" if i in self.control else p.replace(SPACE, " ") for i, p in enumerate(self.pieces)]
        self.digits = [str(i) for i in ids]

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair merges to, or -1. Symbols below zero are characters without a piece."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.merged[at], -1)

    def _bounds(self, plain: dict[str, int]) -> None:
        """Least ranks of pairs, by a piece that one side ends or begins with, and the other side."""
        a, b, rank = self.keys // self.size, self.keys % self.size, self.rank[self.merged]

        def expand(side: np.ndarray, parts) -> tuple[np.ndarray, np.ndarray]:
            """For each pair, the pieces that are parts of its side: (which pair, piece)."""
            own = [[i for part in parts(p) if (i := plain.get(part)) is not None] for p in self.pieces]
            n = np.fromiter(map(len, own), np.int64, len(own))
            flat, start = np.array([i for o in own for i in o], np.int64), np.cumsum(n) - n
            which = np.repeat(np.arange(len(side)), n[side])
            nth = np.arange(len(which)) - np.repeat(np.cumsum(n[side]) - n[side], n[side])
            return which, flat[start[side[which]] + nth]

        which, end = expand(a, lambda p: (p[k:] for k in range(len(p))))
        self.before = _least(end * self.size + b[which], rank[which])
        which, begin = expand(b, lambda p: (p[:k] for k in range(1, len(p) + 1)))
        self.after = _least(a[which] * self.size + begin, rank[which])

    def reach(self, left: np.ndarray, s: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Least rank of a pair that a piece may ever be in, given the symbols around it (below zero: none that merges)."""
        out = np.where(left >= 0, _look(self.before, left * self.size + s), NONE)
        return np.minimum(out, np.where(right >= 0, _look(self.after, s * self.size + right), NONE))

    def unreached(self, sym: np.ndarray, to: np.ndarray, rank: np.ndarray, same: np.ndarray) -> np.ndarray:
        """Places of pairs that no pair of a better or equal rank can ever reach; same: whether the next symbol is of the unit."""
        at = np.flatnonzero(rank < NONE)
        n, none = len(sym), np.full(len(at), -1, np.int64)
        left = np.where((at > 0) & same[at - 1], sym[at - 1], -1)
        right = np.where(same[at + 1], sym[np.minimum(at + 2, n - 1)], -1)
        r = rank[at]
        ok = (r < self.reach(left, sym[at], none)) & (r < self.reach(none, sym[at + 1], right))
        at, left, right, r = at[ok], left[ok], right[ok], r[ok]
        return at[r < self.reach(left, to[at], right)]

    def encode_units(self, units: list[str]) -> list[list[int]]:
        """The ids of each unit, whose spaces are SPACE already."""
        code = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
        sym = self.chars[code]
        sym = np.where(sym < 0, -1 - code, sym)
        unit = np.repeat(np.arange(len(units)), np.fromiter(map(len, units), np.int64, len(units)))
        done: list[list[int]] = [[] for _ in units]

        def leave(s: np.ndarray, u: np.ndarray) -> None:
            starts = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
            flat, cuts = s.tolist(), [*starts.tolist(), len(s)]
            for k, lo, hi in zip(u[starts].tolist(), cuts, cuts[1:], strict=False):
                done[k] = flat[lo:hi]
            for k in np.unique(u[s < 0]).tolist():
                done[k] = self._fall_back(done[k])

        # what the pair of a symbol and the next one merges to; of a merge, only the pairs around it are looked up again
        to = np.append(np.where(unit[1:] == unit[:-1], self.pairs(sym[:-1], sym[1:]), -1), -1)[: len(sym)]
        while len(sym):
            same = unit[1:] == unit[:-1]
            rank = np.where(to >= 0, self.rank[to], NONE)
            starts = np.concatenate(([0], np.flatnonzero(~same) + 1))
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(sym))))
            over = best == NONE
            if over.any():
                leave(sym[over], unit[over])
                stay = ~over
                sym, unit, rank, best, to = sym[stay], unit[stay], rank[stay], best[stay], to[stay]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == best)
            first = np.concatenate(([True], np.diff(unit[hit]) > 0))
            run = np.flatnonzero(np.concatenate(([True], np.diff(hit) > 1)))  # overlapping occurrences: every other one
            odd = (np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))) % 2 == 1
            take = hit[first | (self.together[to[hit]] & ~odd)]
            sizes = np.bincount(unit, minlength=len(units))
            if sizes.max() >= LONG:
                wide = sizes[unit] >= LONG
                more = self.unreached(sym[wide], to[wide], rank[wide], np.append(unit[wide][1:] == unit[wide][:-1], False))
                take = np.union1d(take, np.flatnonzero(wide)[more])
            sym = sym.copy()
            sym[take] = to[take]
            keep = np.ones(len(sym), bool)
            keep[take + 1] = False
            at = np.cumsum(keep)[take] - 1
            sym, unit, to = sym[keep], unit[keep], to[keep]
            to[at] = -1
            at = np.concatenate((at[at > 0] - 1, at))
            at = at[at + 1 < len(sym)]
            to[at] = np.where(unit[at] == unit[at + 1], self.pairs(sym[at], sym[at + 1]), -1)
        return done

    def _fall_back(self, symbols: list[int]) -> list[int]:
        out: list[int] = []
        for s in symbols:
            out += [s] if s >= 0 else self.bytes[list(chr(-1 - s).encode("utf-8", "surrogatepass"))].tolist()
        return out

    def decode_raw(self, ids: list[int]) -> str:
        """Text of ids with the dummy prefix still there; runs of byte pieces read as UTF-8, bad bytes as U+FFFD each."""
        try:
            return "".join([self.shown[i] for i in ids])
        except TypeError:  # bytes, which are shown as None
            pass
        out, run = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            out.append(self.shown[i])
        if run:
            out.append(_utf8(bytes(run)))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        first = next((i for i in ids if i not in self.control), None)
        prefixed = first is not None and first not in self.byte_of and self.pieces[first].startswith(SPACE)
        return self.decode_raw(ids)[prefixed:]

    def encode(self, text: str) -> list[int]:
        """Ids of one text with the end id."""
        return [*(i for u in self.encode_units(split(text)) for i in u), self.end]


def _least(keys: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the least rank of each."""
    at = np.argsort(keys, kind="stable")
    keys, rank = keys[at], rank[at]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[starts], np.minimum.reduceat(rank, starts)


def _look(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    known, rank = table
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, rank[at], NONE)


def _utf8(run: bytes) -> str:
    try:
        return run.decode("utf-8")
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(run):
            n = next((k for k in (1, 2, 3, 4) if i + k <= len(run) and _whole(run[i : i + k])), 0)
            out.append(run[i : i + n].decode("utf-8") if n else "�")
            i += n or 1
        return "".join(out)


def _whole(b: bytes) -> bool:
    try:
        return len(b.decode("utf-8")) == 1
    except UnicodeDecodeError:
        return False


def split(text: str) -> list[str]:
    """Units of a text: spaces, written SPACE, then anything else."""
    if not text:
        return []
    return [u.replace(" ", SPACE) for u in UNIT.findall(" " + text.replace(SPACE, " "))]


def encoder(tables: Tables):
    """A function from texts to (id string, ids, decoded text) triples that keeps what it has encoded."""
    ids_of: dict[str, str] = {}
    text_of: dict[str, str] = {}
    end = tables.digits[tables.end]

    def run(batch: list[str]) -> Iterator[tuple[str, int, str]]:
        if len(ids_of) > CACHE_UNITS:
            ids_of.clear()
            text_of.clear()
        parts = [UNIT.findall(" " + t.replace(SPACE, " ")) if t else [] for t in batch]
        fresh = list(set().union(*parts).difference(ids_of))
        for u, ids in zip(fresh, tables.encode_units([u.replace(" ", SPACE) for u in fresh]), strict=True):
            ids_of[u] = " ".join([tables.digits[i] for i in ids])
            back = tables.decode_raw(ids)
            text_of[u] = u if back == u else back  # one string where they are equal
        for p in parts:
            ids = " ".join([*map(ids_of.__getitem__, p), end])
            yield ids, ids.count(" ") + 1, "".join(map(text_of.__getitem__, p)).removeprefix(" ")

    return run


def tokens(docs: DataFrame, model_file: str, keep_text: bool = False) -> DataFrame:
    """Encode and decode every text of docs (doc_id, text, any other columns): (doc_id long, n_tokens long, ids_sha256, decoded_sha256).

    With keep_text, also ids (space-separated) and decoded. A null text reads as empty and has the end id alone; repeated
    rows come back as often as they are given; a null doc_id stays null; no rows, no result.
    """
    spark = docs.sparkSession
    text_batches(spark)
    tables = spark.sparkContext.broadcast(vars(Tables(model_file)))  # as large as the model file, whatever the corpus
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if keep_text else [])]
    sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tables.__new__(Tables)
        vars(own).update(tables.value)
        encode = encoder(own)
        for b in batches:
            ids, n, back = zip(*encode(texts(b)), strict=True) if b.num_rows else ((), (), ())
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array(map(sha, back), pa.string())]
            if keep_text:
                cols += [pa.array(ids, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = ", ".join(f"{c} {'long' if c in ('doc_id', 'n_tokens') else 'string'}" for c in names)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
