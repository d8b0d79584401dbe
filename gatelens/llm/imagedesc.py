"""Image copies by local descriptors.

An image column holds PGM, PPM or PNG bytes, or whatever a given decoder reads. Corners are found on an image pyramid, the
best of each tile; each is turned to the direction of its intensity centroid and described by 128 binary tests between
smoothed pixels of its surroundings. Descriptors meet in Hamming tables, whose join keys are bands of their bits.

Copies in crowds are linked first: in a table of wide bands, images of a bucket are ordered by a hash of their id, the same
in all buckets, and each is paired with the few before it, so copies, however many, give a number of pairs that is
proportional to them, not to its square. Then all images meet in a table of narrow bands: descriptors of a bucket are all
compared with each other, those of one component aside, and two images are paired where descriptors match that have two
neighbouring corners in common, alike in bits, place and turn; pairs of which half a descriptor says that too few match go no further. A crowded bucket is cut into blocks, its large components
into blocks of their own, and blocks are compared with each other but for two of one component. Pairs are verified: mutual
nearest descriptors, then the consensus of a similarity transform. Images of equal pixels are one.

Recall is audited: a hashed sample of images is compared with all by brute force; below MIN_RECALL the job fails.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.llm.common import Scratch, join_checked, over_batches, over_runs
from gatelens.llm.components import connected_components

SCALES = (1.0, 1.5, 2.25)
#: Corners of a tile of so many pixels a side, by scale.
POINTS, TILE = (24, 14, 8), 128
MARGIN = 11
TESTS = 128
#: Bands of the wide and the narrow table, and bytes of a band.
WIDE_BANDS, WIDE, NARROW_BANDS, NARROW = 2, 4, 4, 3
#: Images before it in a bucket of the wide table that an image is paired with, if they meet so often.
BEFORE = 6
MEETINGS = 2
#: Images of a bucket that a task compares as it reads; above, it is cut into blocks of about so many rows.
SMALL, BLOCK = 1024, 1024
#: Bins of buckets whose rows are counted first; only buckets of a bin of more than SMALL rows are counted by themselves.
BINS = 1 << 16
#: Rows that a task reads before it compares those of each bucket; pairs whose neighbours are compared at once.
RUN_ROWS = 16_384
PAIRS = 1 << 15
#: Nearest corners that a descriptor carries, how many two must have in common, and how far these may differ: in 32 bits,
#: in place (pixels of the corner's scale, and a share of the distance), in turn.
NEIGHBOURS, COMMON = 6, 2
NEAR_BITS, NEAR_PLACE, NEAR_SHARE, NEAR_TURN = 6, 2.5, 0.15, 0.5
#: Bits that matching descriptors may differ in; matches and share of points that must agree; pixels of tolerance.
MATCH_BITS, AGREE, AGREE_SHARE, TOLERANCE = 28, 8, 0.2, 3.0
#: Bits of half a descriptor in which a pair's nearest may differ, and how many such it needs before all of both is compared.
HALF_BITS, HALF_MATCHES = 18, 6
#: Images of the audit, the recall they must show, and links from which it is told.
AUDIT, MIN_RECALL, AUDIT_LINKS = 16, 0.9, 30
#: Pixels above which an image counts as unreadable.
MOST_PIXELS = 1 << 27

_rng = np.random.default_rng(20)
_PATTERN = np.clip(_rng.normal(0, 4.2, (TESTS, 2, 2)), -9, 9)
_DISC = np.array([(x, y) for x in range(-7, 8) for y in range(-7, 8) if x * x + y * y <= 49])


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey levels of an image, or None if it can't be read."""
    try:
        if not data:
            return None
        if data[:2] in (b"P5", b"P6"):
            return _netpbm(data)
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
    except (ValueError, IndexError, zlib.error, KeyError):
        pass
    return None


def _grey(x: np.ndarray) -> np.ndarray:
    if x.ndim == 2:
        return x
    if x.shape[2] in (2,):
        return x[:, :, 0]
    return (x[:, :, :3] @ np.array([0.299, 0.587, 0.114])).round().astype(np.uint8)


def _netpbm(data: bytes) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while not data[end : end + 1].isspace():
            end += 1
        fields.append(int(data[at:end]))
        at = end
    w, h, most = fields
    if most > 255:
        raise ValueError("16-bit samples")
    if not 0 < w * h <= MOST_PIXELS:
        raise ValueError("too many pixels")
    k = 3 if data[:2] == b"P6" else 1
    x = np.frombuffer(data, np.uint8, w * h * k, at + 1)
    return _grey(x.reshape(h, w, k) if k == 3 else x.reshape(h, w))


def _png(data: bytes) -> np.ndarray:
    at, body, palette = 8, [], None
    w = h = depth = kind = lace = 0
    while at + 8 <= len(data):
        n, name = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        chunk = data[at + 8 : at + 8 + n]
        if name == b"IHDR":
            w, h, depth, kind, lace = int.from_bytes(chunk[:4], "big"), int.from_bytes(chunk[4:8], "big"), chunk[8], chunk[9], chunk[12]
        elif name == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            body.append(chunk)
        at += 12 + n
    k = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    if depth != 8 or lace or not 0 < w * h <= MOST_PIXELS:
        raise ValueError("only 8-bit images without interlace")
    raw = np.frombuffer(zlib.decompressobj().decompress(b"".join(body), h * (w * k + 1)), np.uint8).reshape(h, w * k + 1)
    out = np.zeros((h, w * k), np.uint8)
    up = np.zeros(w * k, np.uint8)
    for r in range(h):
        f, line = raw[r, 0], raw[r, 1:]
        if f == 1:
            line = np.cumsum(line.reshape(w, k), axis=0, dtype=np.uint64).astype(np.uint8).ravel()
        elif f == 2:
            line = line + up
        elif f:
            line = np.array(_predicted(line.tolist(), up.tolist(), k, f == 4), np.uint8)
        out[r] = up = line
    x = out.reshape(h, w, k)
    return _grey(palette[x[:, :, 0]] if kind == 3 and palette is not None else x if k > 1 else x[:, :, 0])


def _predicted(line: list[int], up: list[int], k: int, paeth: bool) -> list[int]:
    """A line whose pixels were predicted from those before and above."""
    line = [0] * k + line
    up = [0] * k + up
    for i in range(k, len(line)):
        a, b = line[i - k], up[i]
        if paeth:
            c = up[i - k]
            to_a, to_b, to_c = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            add = a if to_a <= to_b and to_a <= to_c else b if to_b <= to_c else c
        else:
            add = (a + b) >> 1
        line[i] = (line[i] + add) & 255
    return line[k:]


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Mean over squares of side 2r + 1, the edge repeated."""
    p = np.pad(x, r + 1, mode="edge").cumsum(0).cumsum(1)
    k = 2 * r + 1
    return (p[k:-1, k:-1] - p[:-k - 1, k:-1] - p[k:-1, :-k - 1] + p[:-k - 1, :-k - 1]) / (k * k)


def _shrink(x: np.ndarray, by: float) -> np.ndarray:
    if by == 1:
        return x
    x = _box(x, 1 if by < 2 else 2)
    h, w = (max(1, int(n / by)) for n in x.shape)
    yy, xx = np.minimum(np.arange(h) * by, x.shape[0] - 1), np.minimum(np.arange(w) * by, x.shape[1] - 1)
    y0, x0 = yy.astype(int), xx.astype(int)
    y1, x1 = np.minimum(y0 + 1, x.shape[0] - 1), np.minimum(x0 + 1, x.shape[1] - 1)
    fy, fx = (yy - y0)[:, None], (xx - x0)[None]
    return (x[y0][:, x0] * (1 - fx) + x[y0][:, x1] * fx) * (1 - fy) + (x[y1][:, x0] * (1 - fx) + x[y1][:, x1] * fx) * fy


def describe(image: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Points (x, y, scale, angle) as float32 and descriptors as 16 bytes each; none for an image too small or flat."""
    points, bits = [], []
    for scale, most in zip(SCALES, POINTS, strict=True):
        if image is None or min(image.shape) / scale < 2 * MARGIN + 3:
            break
        x = _shrink(image.astype(np.float64), scale)
        gy, gx = np.gradient(x)
        a, b, c = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        corner = a * b - c * c - 0.05 * (a + b) ** 2
        inner = corner[MARGIN:-MARGIN, MARGIN:-MARGIN]
        h, w = inner.shape
        top = np.full((h, w), -np.inf)
        for dy in (-2, -1, 0, 1, 2):
            for dx in (-2, -1, 0, 1, 2):
                if dy or dx:
                    np.maximum(top, corner[MARGIN + dy : MARGIN + dy + h, MARGIN + dx : MARGIN + dx + w], out=top)
        ys, xs = np.nonzero((inner > top) & (inner > 1.0))
        if not len(ys):
            continue
        best = np.argsort(-inner[ys, xs], kind="stable")
        tile = (ys[best] * int(scale * 16) // (16 * TILE)) * (1 << 20) + xs[best] * int(scale * 16) // (16 * TILE)
        order = np.argsort(tile, kind="stable")  # the best of each tile, in the order of all
        first = np.concatenate(([True], np.diff(tile[order]) != 0))
        nth = np.arange(len(order)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        best = best[np.sort(order[nth < most])]
        ys, xs = ys[best] + MARGIN, xs[best] + MARGIN
        smooth = _box(x, 1)
        patch = smooth[ys[:, None] + _DISC[:, 1], xs[:, None] + _DISC[:, 0]]
        angle = np.arctan2(patch @ _DISC[:, 1], patch @ _DISC[:, 0])
        turn = np.stack([np.stack([np.cos(angle), -np.sin(angle)], -1), np.stack([np.sin(angle), np.cos(angle)], -1)], -2)
        at = np.einsum("nij,tpj->ntpi", turn, _PATTERN)
        px = np.clip(np.rint(at[..., 0]).astype(int) + xs[:, None, None], 0, x.shape[1] - 1)
        py = np.clip(np.rint(at[..., 1]).astype(int) + ys[:, None, None], 0, x.shape[0] - 1)
        v = smooth[py, px]
        bits.append(np.packbits(v[..., 0] < v[..., 1], axis=1))
        points.append(np.stack([xs * scale, ys * scale, np.full(len(xs), scale), angle], 1))
    if not points:
        return np.zeros((0, 4), np.float32), np.zeros((0, TESTS // 8), np.uint8)
    return unpacked(packed(np.concatenate(points))), np.concatenate(bits)


def packed(points: np.ndarray) -> bytes:
    """Points in eight bytes each: quarters of a pixel, thousandths of a scale, and the angle in 65,536 parts of a turn."""
    turn = np.rint(points[:, 3] / (2 * np.pi) * 65536) % 65536
    return np.column_stack([np.rint(points[:, 0] * 4), np.rint(points[:, 1] * 4), np.rint(points[:, 2] * 1000), turn]).astype("<u2").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    p = np.frombuffer(raw, "<u2").reshape(-1, 4).astype(np.float32)
    p *= np.array([0.25, 0.25, 0.001, 2 * np.pi / 65536], np.float32)
    p[:, 3] = (p[:, 3] + np.pi) % (2 * np.pi) - np.pi
    return p


def agree(pa_: np.ndarray, da: np.ndarray, pb: np.ndarray, db: np.ndarray, least: float = 2) -> int:
    """Points that agree on one similarity transform from a to b; the matches where these are fewer than least."""
    if not len(pa_) or not len(pb):
        return 0
    far = np.bitwise_count(da.view(np.uint64)[:, None] ^ db.view(np.uint64)[None]).sum(axis=2)
    i = np.arange(len(far))
    j = far.argmin(axis=1)
    ok = (far[i, j] <= MATCH_BITS) & (far.argmin(axis=0)[j] == i)
    a, b = pa_[i[ok]].astype(np.float64), pb[j[ok]].astype(np.float64)
    if len(a) < max(2, least):
        return len(a)
    most = 0
    turn, zoom = b[:, 3] - a[:, 3], b[:, 2] / a[:, 2]
    for k in range(len(a)):  # each match proposes a transform; the best-supported one counts
        cos, sin = zoom[k] * np.cos(turn[k]), zoom[k] * np.sin(turn[k])
        dx, dy = a[:, 0] - a[k, 0], a[:, 1] - a[k, 1]
        off = np.hypot(cos * dx - sin * dy + b[k, 0] - b[:, 0], sin * dx + cos * dy + b[k, 1] - b[:, 1])
        near = np.hypot(dx, dy)
        most = max(most, int((off <= TOLERANCE + 0.1 * near).sum()))
    return most


def is_copy(pa_: np.ndarray, da: np.ndarray, pb: np.ndarray, db: np.ndarray) -> bool:
    least = max(AGREE, AGREE_SHARE * min(len(pa_), len(pb)))
    return agree(pa_, da, pb, db, least) >= least


def _described(batch: pa.RecordBatch, decoder: Callable[[bytes], np.ndarray | None]) -> pa.RecordBatch:
    ids, k1, k2, n, points, bits = [], [], [], [], [], []
    for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        ids.append(i)
        if i is None or data is None:
            for column, nothing in ((k1, None), (k2, None), (n, 0), (points, None), (bits, None)):
                column.append(nothing)
            continue
        image = decoder(data)
        same = np.frombuffer(xxhash.xxh3_128_digest(data if image is None else repr(image.shape).encode() + image.tobytes()), np.int64)
        p, d = describe(image)
        k1.append(int(same[0]))
        k2.append(int(same[1]))
        n.append(len(p))
        points.append(packed(p))
        bits.append(d.tobytes())
    cols = [pa.array(x, pa.int64()) for x in (ids, k1, k2, n)] + [pa.array(points, pa.binary()), pa.array(bits, pa.binary())]
    return pa.RecordBatch.from_arrays(cols, ["media_id", "k1", "k2", "n_points", "points", "bits"])


def _band(d: np.ndarray, band: int, size: int) -> np.ndarray:
    own = np.full(len(d), band, np.int64)
    for byte in range(size):
        own = (own << 8) | d[:, size * band + byte]
    return own


def _keys(batch: pa.RecordBatch, bands: int = WIDE_BANDS, size: int = WIDE) -> pa.RecordBatch:
    """Rows (key, id): every bucket of an image once."""
    keys, who = [], []
    for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        d = np.frombuffer(raw, np.uint8).reshape(-1, TESTS // 8)
        for band in range(bands):
            own = np.unique(_band(d, band, size))
            keys.append(own)
            who.append(np.full(len(own), i))
    cols = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, who)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "id"])


def _buckets(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows (key, comp): every narrow bucket of an image once, with the image's component."""
    keys = _keys(batch.select(["id", "bits"]), NARROW_BANDS, NARROW)
    comp = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    of = np.array([comp[i] for i in keys.column(1).to_pylist()], np.int64)
    return pa.RecordBatch.from_arrays([keys.column(0), pa.array(of)], ["key", "comp"])


#: A neighbouring corner: a quarter of its bits, its place and turn as the descriptor's own corner sees it; used: whether there is one.
NEIGHBOUR = np.dtype([("bits", "<u4"), ("x", "i1"), ("y", "i1"), ("turn", "i1"), ("used", "i1")])


def neighbours(points: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The nearest corners of each."""
    out = np.zeros((len(d), NEIGHBOURS), NEIGHBOUR)
    if len(d) < 2:
        return out
    p = points.astype(np.float64)
    for lo in range(0, len(p), 512):
        own = p[lo : lo + 512]
        dx, dy = p[None, :, 0] - own[:, None, 0], p[None, :, 1] - own[:, None, 1]
        far = np.hypot(dx, dy)
        far[far < TOLERANCE] = np.inf  # the same corner on another scale
        j = np.argsort(far, axis=1, kind="stable")[:, :NEIGHBOURS]
        at = np.arange(len(own))[:, None]
        cos, sin, zoom = np.cos(own[:, 3:4]), np.sin(own[:, 3:4]), own[:, 2:3]
        x, y = (cos * dx[at, j] + sin * dy[at, j]) / zoom, (cos * dy[at, j] - sin * dx[at, j]) / zoom
        part = out[lo : lo + 512, : j.shape[1]]
        part["used"] = np.isfinite(far[at, j]) & (np.maximum(np.abs(x), np.abs(y)) < 127)
        part["bits"] = np.ascontiguousarray(d).view("<u4")[j, 0]
        part["x"], part["y"] = np.clip(np.rint(x), -127, 127), np.clip(np.rint(y), -127, 127)
        part["turn"] = np.rint(((p[j, 3] - own[:, 3:4] + np.pi) % (2 * np.pi) - np.pi) / np.pi * 127)
    return out


def _descriptors(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows (key, id, comp, lo, hi, near): every descriptor of an image under each of its narrow buckets, with its neighbours."""
    parts, near = [], []
    for i, comp, raw, points in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
        d = np.frombuffer(raw, np.uint8).reshape(-1, TESTS // 8)
        both = d.view(np.int64)
        around = [r.tobytes() for r in neighbours(unpacked(points), d)]
        for band in range(NARROW_BANDS):
            parts.append(np.stack([_band(d, band, NARROW), np.full(len(d), i), np.full(len(d), comp), both[:, 0], both[:, 1]]))
            near += around
    cols = np.concatenate(parts, axis=1) if parts else np.zeros((5, 0), np.int64)
    return pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), pa.array(near, pa.binary())], ["key", "id", "comp", "lo", "hi", "near"])


def _around(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), NEIGHBOUR).reshape(-1, NEIGHBOURS)


def alike(lo: np.ndarray, hi: np.ndarray, near: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of rows, those that match and have enough neighbours in common."""
    far = np.bitwise_count((lo[i] ^ lo[j]).view(np.uint64)).astype(np.int64) + np.bitwise_count((hi[i] ^ hi[j]).view(np.uint64))
    i, j = i[far <= MATCH_BITS], j[far <= MATCH_BITS]
    yes = np.zeros(len(i), bool)
    for k in range(0, len(i), PAIRS):
        a, b = near[i[k : k + PAIRS]], near[j[k : k + PAIRS]]
        bits = np.bitwise_count(a["bits"][:, :, None] ^ b["bits"][:, None]) <= NEAR_BITS
        bits &= (a["used"][:, :, None] & b["used"][:, None]).astype(bool)
        some = np.flatnonzero(bits.any(axis=2).sum(axis=1) >= COMMON)
        a, b, bits = a[some], b[some], bits[some]
        xa, ya, xb, yb = (v.astype(np.float32) for v in (a["x"], a["y"], b["x"], b["y"]))
        place = np.hypot(xa[:, :, None] - xb[:, None], ya[:, :, None] - yb[:, None]) <= NEAR_PLACE + NEAR_SHARE * np.hypot(xa, ya)[:, :, None]
        turn = np.abs((a["turn"].astype(np.int16)[:, :, None] - b["turn"].astype(np.int16)[:, None] + 127) % 254 - 127) <= NEAR_TURN / np.pi * 127
        yes[k + some] = (bits & place & turn).any(axis=2).sum(axis=1) >= COMMON
    return i[yes], j[yes]


def _named(who: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """Pairs of rows as pairs of images, each once."""
    both = np.stack([np.minimum(who[i], who[j]), np.maximum(who[i], who[j])])
    u, w = np.unique(both, axis=1) if len(i) else both
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(w, pa.int64())], ["a", "b"])


def _block_pairs(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    """Pairs of images of different components, one of each block, that are alike."""
    first, who, comp, lo, hi = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("first", "id", "comp", "lo", "hi"))
    near = _around(batch.column(batch.schema.get_field_index("near")))
    a, b = np.flatnonzero(first), np.flatnonzero(~first)
    own = not len(b)
    if own:  # a block with itself
        b = a
    found = [(np.zeros(0, np.int64),) * 2]
    for k in range(0, len(a), 64):
        x = a[k : k + 64]
        m, n = np.nonzero(comp[x][:, None] != comp[b][None])
        i, j = x[m], b[n]
        found.append(alike(lo, hi, near, *((i[i < j], j[i < j]) if own else (i, j))))
    out = _named(who, *(np.concatenate([f[k] for f in found]) for k in (0, 1)))
    return out if out.num_rows else None


def _small_pairs(batches):
    """Pairs of the rows (key, id, comp, lo, hi, near), sorted by key, that share a key, differ in component and are alike."""

    def pairs(rows: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
        key, who, comp, lo, hi = rows
        found, d = [(np.zeros(0, np.int64),) * 2], 1
        i = np.flatnonzero(key[1:] == key[:-1]) + 1
        while len(i):
            own = i[comp[i] != comp[i - d]]
            found.append(alike(lo, hi, near, own, own - d))
            d += 1
            i = i[i >= d]
            i = i[key[i] == key[i - d]]
        return _named(who, *(np.concatenate([f[k] for f in found]) for k in (0, 1)))

    held, around, n = [], [], 0
    for b in batches:
        held.append(np.stack([c.to_numpy() for c in b.columns[:5]]))
        around.append(_around(b.column(5)))
        n += b.num_rows
        if n >= RUN_ROWS:
            rows, near = np.concatenate(held, axis=1), np.concatenate(around)
            whole = int(np.searchsorted(rows[0], rows[0, -1]))  # the last key may go on
            yield pairs(rows[:, :whole], near[:whole])
            held, around, n = [rows[:, whole:]], [near[whole:]], 0
    if held:
        yield pairs(np.concatenate(held, axis=1), np.concatenate(around))


def crowded_buckets(held: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, mixed) of buckets of more than SMALL rows (key, comp); mixed: whether they hold several components."""
    bin_ = F.pmod(F.xxhash64("key"), F.lit(BINS))
    full = scratch.save(held.groupBy(bin_.alias("bin")).count().where(F.col("count") > SMALL).select("bin"), files=8)
    some = held.withColumn("bin", bin_).join(F.broadcast(full), "bin", "left_semi")  # at most BINS rows
    crowded = some.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    return scratch.save(crowded.where(F.col("n") > SMALL).select("key", (F.col("lo") != F.col("hi")).alias("mixed")))


def crowded_pairs(images: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): pairs of different components that are alike in a narrow bucket.

    images: (id, comp, bits, points). Blocks of a bucket that lie in one component are not compared with each other.
    """
    images = images.select("id", "comp", "bits", "points")
    held = over_batches(images, _buckets, "key long, comp long")
    crowded = crowded_buckets(held, scratch)
    scratch.release()
    seen = over_batches(images, _descriptors, "key long, id long, comp long, lo long, hi long, near binary")
    few = join_checked(seen, crowded.select("key"), "key", "left_anti").repartition("key").sortWithinPartitions("key")
    few = scratch.save(few.mapInArrow(_small_pairs, "a long, b long"))
    scratch.release()
    mixed = scratch.save(crowded.where("mixed").select("key"), files=8)
    parts = scratch.save(join_checked(held, mixed, "key", "inner").groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m")))
    # so many rows are in small components: blocks are cut by them alone, else few rows would be copied to many blocks
    small_rows = parts.where(F.col("m") <= BLOCK).groupBy("key").agg(F.sum("m").alias("small_rows"))
    parts = parts.join(small_rows, "key", "left")
    # a large component has blocks of its own, told by its name; small ones share those named zero
    large = F.col("m") > BLOCK
    parts = parts.select(
        "key", "comp",
        F.when(large, F.col("comp")).otherwise(F.lit(0)).alias("of"),
        F.when(large, F.ceil(F.col("m") / BLOCK)).otherwise(1).cast("int").alias("cuts"),
        F.when(large, 0).otherwise(F.pmod(F.xxhash64("comp"), F.ceil(F.col("small_rows") / BLOCK))).cast("int").alias("at"),
    )
    blocks = parts.select("key", "of", F.explode(F.when(F.col("of") == 0, F.array("at")).otherwise(F.sequence(F.lit(0), F.col("cuts") - 1))).alias("cut"))
    blocks = scratch.save(blocks.distinct())
    x, y = blocks.toDF("key", "of1", "cut1"), blocks.toDF("key", "of2", "cut2")
    ordered = (F.col("of1") < F.col("of2")) | ((F.col("of1") == F.col("of2")) & (F.col("cut1") <= F.col("cut2")))
    pairs = x.join(y, "key").where(ordered & ~((F.col("of1") == F.col("of2")) & (F.col("of1") != 0)))
    own = (F.col("of1") == F.col("of2")) & (F.col("cut1") == F.col("cut2"))
    # a hash names two blocks, its last bit a block with itself: where names clash, all are compared at once, and no pair is lost
    name = F.shiftleft(F.xxhash64("key", "of1", "cut1", "of2", "cut2"), 1).bitwiseOR(own.cast("long"))
    pairs = scratch.save(pairs.withColumn("pair", name))
    sides = pairs.select("key", F.col("of1").alias("of"), F.col("cut1").alias("cut"), F.lit(True).alias("first"), "pair").union(
        pairs.where(~own).select("key", "of2", "cut2", F.lit(False), "pair")
    )
    seen = join_checked(seen, mixed, "key", "left_semi").join(parts, ["key", "comp"]).withColumn("cut", F.when(F.col("of") == 0, F.col("at")).otherwise(F.pmod(F.xxhash64("id"), "cuts")).cast("int"))
    dealt = seen.join(sides, ["key", "of", "cut"]).select("pair", "first", "id", "comp", "lo", "hi", "near")
    return few.union(over_runs(dealt, ["pair"], _block_pairs, "a long, b long")).distinct()


def _meetings(batches):
    """Pairs of the sorted rows (key, at, id): of each with the BEFORE before it under its key."""
    left = None
    for b in batches:
        rows = np.stack([b.column(i).to_numpy() for i in (0, 2)])
        start = 0
        if left is not None:
            rows, start = np.concatenate([left, rows], axis=1), left.shape[1]
        key, who = rows
        u, w = [], []
        for d in range(1, BEFORE + 1):
            i = np.arange(max(start, d), len(key))
            i = i[key[i] == key[i - d]]
            u.append(np.minimum(who[i], who[i - d]))
            w.append(np.maximum(who[i], who[i - d]))
        left = rows[:, -BEFORE:]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(w))], ["a", "b"])


def _verified(batch: pa.RecordBatch) -> pa.RecordBatch:
    cols = [batch.column(i).to_pylist() for i in range(2, 6)]
    read = lambda p, d: (unpacked(p), np.frombuffer(d, np.uint8).reshape(-1, TESTS // 8))
    yes = [is_copy(*read(p, d), *read(q, e)) for p, d, q, e in zip(*cols, strict=True)]
    return batch.filter(pa.array(yes, pa.bool_())).select([0, 1])


def _halves(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(a, b) of pairs (a, b, and half of the descriptors of either) that have enough in common to be compared in full."""
    yes = []
    for p, q in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
        x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
        far = np.bitwise_count(x[:, None] ^ y[None])
        least = min(HALF_MATCHES, AGREE)
        yes.append(min((far.min(axis=1) <= HALF_BITS).sum(), (far.min(axis=0) <= HALF_BITS).sum()) >= least if far.size else False)
    return batch.filter(pa.array(yes, pa.bool_())).select([0, 1])


def _half(batch: pa.RecordBatch) -> pa.RecordBatch:
    half = [np.ascontiguousarray(np.frombuffer(d, np.uint64).reshape(-1, 2)[:, 0]).tobytes() for d in batch.column(1).to_pylist()]
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(half, pa.binary())], ["id", "half"])


def audit(one: DataFrame, comp: DataFrame, sample: int = AUDIT) -> tuple[int, int]:
    """Links of a hashed sample of images, found by brute force over all images, and how many of them lie in one component.

    one: (id, points, bits); comp: (node, root).
    """
    asked = one.orderBy(F.xxhash64("id", F.lit(5))).limit(sample).collect()
    got = one.sparkSession.sparkContext.broadcast([(r.id, bytes(r.points), bytes(r.bits)) for r in asked])

    def brute(b: pa.RecordBatch) -> pa.RecordBatch:
        read = lambda p, d: (unpacked(p), np.frombuffer(d, np.uint8).reshape(-1, TESTS // 8))
        queries = [(i, *read(p, d)) for i, p, d in got.value]
        u, w = [], []
        for i, p, d in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
            points, bits = read(p, d)
            for j, q, e in queries:
                if i != j and is_copy(q, e, points, bits):
                    u.append(j)
                    w.append(i)
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(w, pa.int64())], ["a", "b"])

    dealt = one.select("id", "points", "bits").repartition(4 * one.sparkSession.sparkContext.defaultParallelism, "id")
    links = over_batches(dealt, brute, "a long, b long")
    x, y = (comp.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
    held = links.join(x, "a", "left").join(y, "b", "left")
    r = held.agg(F.count("*").alias("n"), F.sum((F.col("ra") == F.col("rb")).cast("int")).alias("same")).first()
    return r["n"], r["same"] or 0


def image_copies(media: DataFrame, decoder: Callable[[bytes], np.ndarray | None] = decode) -> DataFrame:
    """(media_id long, n_points long, component_id long, kept) per row of media (media_id, image, any other columns).

    component_id is the smallest media_id that copies reach, the row's own included. decoder: grey levels (uint8, two
    dimensions) of an image's bytes, None where it can't be read. Images that are null, unreadable, small or flat have no
    points and are copies of images of equal pixels, or bytes, alone; null images of none. Rows without media_id are
    copies of none and get null. Repeated rows come back as often as they are given. No rows, no result.
    """
    scratch = Scratch(media.sparkSession)
    given = media.select(F.col("media_id").cast("long"), "image")
    described = over_batches(given, lambda b: _described(b, decoder), "media_id long, k1 long, k2 long, n_points long, points binary, bits binary")
    found = scratch.save(described)
    images = found.where("k1 is not null")
    ids = images.select("media_id", "k1", "k2").distinct()
    one = images.groupBy("k1", "k2").agg(F.min("media_id").alias("least"), F.first("points").alias("points"), F.first("bits").alias("bits"), F.first("n_points").alias("n_points"))
    one = scratch.save(one.withColumn("id", F.xxhash64("k1", "k2", "least")))
    pointed = one.where("n_points > 0")
    held = scratch.save(over_batches(pointed.select("id", "bits"), _keys, "key long, id long"))
    rows = held.select("key", F.xxhash64(F.col("id"), F.lit(3)).alias("at"), "id")
    # dealt by ranges of key and hash: a key that many images share spreads over tasks
    dealt = rows.repartitionByRange("key", "at").sortWithinPartitions("key", "at")
    met = dealt.mapInArrow(_meetings, "a long, b long").groupBy("a", "b").count().where(F.col("count") >= MEETINGS).select("a", "b")
    x = one.select(F.col("id").alias("a"), F.col("points").alias("pa"), F.col("bits").alias("da"))
    y = one.select(F.col("id").alias("b"), F.col("points").alias("pb"), F.col("bits").alias("db"))

    halves = scratch.save(over_batches(pointed.select("id", "bits"), _half, "id long, half binary"))

    def verified(pairs: DataFrame) -> DataFrame:
        given = scratch.save(pairs)
        p, q = (halves.select(F.col("id").alias(c), F.col("half").alias(f"h{c}")) for c in "ab")
        some = given.join(p, "a").join(q, "b").select("a", "b", "ha", "hb")
        some = scratch.save(over_batches(some, _halves, "a long, b long"))
        scratch.release()
        both = some.join(x, "a").join(y, "b").select("a", "b", "pa", "da", "pb", "db")
        out = scratch.save(over_batches(both, _verified, "a long, b long"))
        scratch.drop(given)
        scratch.drop(some)
        scratch.release()
        return out

    near = verified(met)
    scratch.drop(held)
    comp = connected_components(near, scratch)
    images = pointed.join(comp, one.id == comp.node, "left").select("id", F.coalesce("root", "id").alias("comp"), "bits", "points")
    images = scratch.save(images)
    more = verified(crowded_pairs(images, scratch))
    scratch.drop(images)
    if not more.isEmpty():
        comp = connected_components(near.union(more), scratch)
    n, same = audit(pointed, comp)
    if same < MIN_RECALL * n:
        told = f"components hold {same} of {n} links of a sample of images"
        if n >= AUDIT_LINKS:
            raise RuntimeError(told)
        warnings.warn(told, stacklevel=2)
    of = one.join(comp, one.id == comp.node, "left").select("k1", "k2", "n_points", "least", F.coalesce("root", "id").alias("root"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    of = of.join(least, "root").select("k1", "k2", "n_points", "component_id").join(ids, ["k1", "k2"])
    of = scratch.save(of.groupBy("media_id").agg(F.max("n_points").alias("n_points"), F.min("component_id").alias("component_id")))
    out = found.select("media_id").join(of, "media_id", "left")
    out = out.select("media_id", F.coalesce("n_points", F.lit(0)).alias("n_points"), F.coalesce("component_id", "media_id").alias("component_id"))
    return out.withColumn("kept", F.col("media_id") == F.col("component_id"))


def pgm(x: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (x.shape[1], x.shape[0]) + x.astype(np.uint8).tobytes()
