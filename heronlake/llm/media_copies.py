"""Copies of images by local descriptors: cropped, scaled, turned or edited ones too.

1. Each image (PNG of 8-bit grey, or binary PGM) gets corners on several scales (Harris response, local maxima), each with an
   orientation (intensity centroid) and 256 binary tests of smoothed pixels, turned by it.
2. Hamming tables: every corner, with each two of its NEIGHBOURS nearest corners of the same scale, gives TABLES keys, made of KEY_BITS fixed bits of
   the tests of all three. Three places must agree by chance for a false key, so unrelated images rarely meet. All images are indexed. The keys are
   range-partitioned and sorted, and each key's images are paired with the first of them only, so n copies make n pairs a key, not n * n.
3. Each pair is settled by geometry: corners that are each other's nearest vote for a turn, scale and shift; the vote that most
   matches agree with gives the count of inliers, and MIN_INLIERS make a link.
4. Links, and equal media, are joined to classes. Keys whose images still lie in several classes are compared once more: one image of each class,
   in pairs of blocks, until no such pair is left out. Classes are connected components over all links.

Cases: null media, or bytes that are neither format, have no corners; equal media are one class all the same (null media are not); flat
images likewise. Rows count by themselves, so ids may be null or repeat; a class is named by its smallest id, null if it has none. An empty table
gives an empty result; columns other than the two named are not read. The memory of an image follows its pixels and corners.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronlake.llm.common import Written, map_batches, table
from heronlake.llm.components import components

SCALES = (1.0, 1.25, 1.6)
TABLES = 2
#: Bits of the tests of each of a key's three corners, and how many of a corner's nearest ones take part.
KEY_BITS, NEIGHBOURS = 20, 3
MIN_INLIERS = 8
MAX_DISTANCE = 40
#: Rows of a distance matrix that are computed at once; images of a block.
STRIP, BLOCK = 256, 64
#: Rows of the sorted index that a task holds.
HELD = 1 << 18
#: Pixels (at a scale of 1) within which a corner's neighbours are looked for.
REACH = 64
RADIUS = 9
TOLERANCE = 3.0


# --- images --------------------------------------------------------------------------------------------------------------


def encode_png(image: np.ndarray) -> bytes:
    h, w = image.shape
    raw = np.concatenate((np.zeros((h, 1), np.uint8), image.astype(np.uint8)), axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 1)) + chunk(b"IEND", b"")


def decode(media: bytes | None) -> np.ndarray | None:
    """Grey image (rows of floats), or None."""
    try:
        if media is None:
            return None
        if media[:2] == b"P5":
            kind, w, h, _, body = media.split(maxsplit=4) if media.count(b"\n") < 3 else (*media.split(b"\n", 3)[0].split(), *media.split(b"\n", 3)[1].split(), *media.split(b"\n", 3)[2:])
            return np.frombuffer(body, np.uint8, int(w) * int(h)).reshape(int(h), int(w)).astype(np.float32) if int(w) > 0 and int(h) > 0 else None
        if media[:8] != b"\x89PNG\r\n\x1a\n":
            return None
        at, data, head = 8, [], None
        while at < len(media):
            (n,) = struct.unpack(">I", media[at : at + 4])
            kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", body)
            elif kind == b"IDAT":
                data.append(body)
            at += 12 + n
        if head is None or head[2:4] != (8, 0) or head[6]:
            return None
        w, h = head[:2]
        if not w or not h:
            return None
        raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(h, w + 1)
        if not raw[:, 0].any():
            return raw[:, 1:].astype(np.float32)
        out = np.zeros((h + 1, w + 1), np.int64)
        for y in range(h):  # filters of the PNG standard: none, left, up, mean, Paeth
            kind, line, up, now = int(raw[y, 0]), raw[y, 1:].astype(np.int64), out[y], out[y + 1]
            if kind in (0, 2):
                now[1:] = (line + (up[1:] if kind else 0)) & 255
            elif kind == 1:
                now[1:] = np.cumsum(line) & 255
            else:
                for x in range(1, w + 1):
                    a, b, c = now[x - 1], up[x], up[x - 1]
                    if kind == 3:
                        add = (a + b) // 2
                    else:
                        pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                        add = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
                    now[x] = (line[x - 1] + add) & 255
        return out[1:, 1:].astype(np.float32)
    except (ValueError, struct.error, zlib.error, IndexError):
        return None


def _smooth(a: np.ndarray) -> np.ndarray:
    for axis in (0, 1):
        p = np.pad(a, [(2, 2) if k == axis else (0, 0) for k in (0, 1)], mode="edge")
        n = a.shape[axis]
        cut = lambda k, p=p, n=n, axis=axis: p[k : k + n] if axis == 0 else p[:, k : k + n]
        a = (cut(0) + 4 * cut(1) + 6 * cut(2) + 4 * cut(3) + cut(4)) / 16
    return a


def _resize(a: np.ndarray, factor: float) -> np.ndarray:
    """Bilinear, by a factor that makes it smaller."""
    h, w = (max(1, int(n / factor)) for n in a.shape)
    y, x = np.minimum((np.arange(h) + 0.5) * factor - 0.5, a.shape[0] - 1), np.minimum((np.arange(w) + 0.5) * factor - 0.5, a.shape[1] - 1)
    y, x = np.maximum(y, 0), np.maximum(x, 0)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, a.shape[0] - 1), np.minimum(x0 + 1, a.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    return (a[y0][:, x0] * (1 - fx) + a[y0][:, x1] * fx) * (1 - fy) + (a[y1][:, x0] * (1 - fx) + a[y1][:, x1] * fx) * fy


@functools.cache
def _pattern() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of the 256 tests (pairs of points), and of the disk for orientation; fixed by a seed."""
    rng = np.random.default_rng(20240229)
    pairs = np.clip(rng.normal(0, RADIUS / 2.2, (256, 2, 2)), -RADIUS + 2, RADIUS - 2)
    yy, xx = np.mgrid[-RADIUS + 2 : RADIUS - 1, -RADIUS + 2 : RADIUS - 1]
    disk = yy**2 + xx**2 <= (RADIUS - 2) ** 2
    return pairs, yy[disk], xx[disk]


def describe(image: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(corners, tests): corners are x, y, angle, scale, response (strongest first); tests are rows of 32 bytes."""
    points, tests = [np.empty((0, 5), np.float32)], [np.empty((0, 32), np.uint8)]
    pairs, dy, dx = _pattern()
    for scale in SCALES if image is not None else ():
        a = _smooth(_resize(image, scale) if scale != 1 else image)
        h, w = a.shape
        if min(h, w) <= 2 * RADIUS + 2:
            continue
        gy, gx = np.gradient(a)
        xx, yy, xy = _smooth(gx * gx), _smooth(gy * gy), _smooth(gx * gy)
        r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        peak = r.copy()
        for sy in (-1, 0, 1):
            for sx in (-1, 0, 1):
                peak[1:-1, 1:-1] = np.maximum(peak[1:-1, 1:-1], r[1 + sy : h - 1 + sy, 1 + sx : w - 1 + sx])
        m = RADIUS + 1
        inner = np.zeros_like(r, bool)
        inner[m : h - m, m : w - m] = True
        top = r.max()
        y, x = np.nonzero(inner & (r == peak) & (r > max(0.01 * top, 1e-3)))
        if not len(y):
            continue
        patch = a[y[:, None] + dy, x[:, None] + dx]
        patch = patch - patch.mean(axis=1, keepdims=True)
        angle = np.arctan2((patch * dy).sum(axis=1), (patch * dx).sum(axis=1))
        cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
        ty = np.rint(y[:, None, None] + pairs[None, :, :, 0] * cos + pairs[None, :, :, 1] * sin).astype(int)
        tx = np.rint(x[:, None, None] + pairs[None, :, :, 1] * cos - pairs[None, :, :, 0] * sin).astype(int)
        v = a[np.clip(ty, 0, h - 1), np.clip(tx, 0, w - 1)]
        tests.append(np.packbits(v[:, :, 0] < v[:, :, 1], axis=1))
        points.append(np.stack([(x + 0.5) * scale, (y + 0.5) * scale, angle, np.full(len(x), scale), r[y, x]], axis=1).astype(np.float32))
    p, t = np.concatenate(points), np.concatenate(tests)
    order = np.lexsort((p[:, 0], p[:, 1], -p[:, 4]))
    return p[order], t[order]


@functools.cache
def _key_bits() -> np.ndarray:
    """The tests of each table's keys: KEY_BITS of the corner itself, then as many of its neighbours."""
    return np.stack([np.random.default_rng(100 + k).permutation(256)[: 2 * KEY_BITS] for k in range(TABLES)])


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: multiply and shift, twice."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


def nearest(z: np.ndarray, apart: float, reach: float) -> np.ndarray:
    """(NEIGHBOURS, n) places of the corners nearest to each of z (complex, ordered by the imaginary part), between `apart` and `reach` away; -1 for none."""
    out = np.full((NEIGHBOURS, len(z)), -1)
    for lo in range(0, len(z), STRIP):
        mine = z[lo : lo + STRIP]
        first, last = np.searchsorted(z.imag, [mine[0].imag - reach, mine[-1].imag + reach])
        far = np.abs(mine[:, None] - z[None, first:last])
        far[(far < apart) | (far > reach)] = np.inf
        for k in range(min(NEIGHBOURS, far.shape[1])):
            at = far.argmin(axis=1)
            rows = np.arange(len(mine))
            out[k, lo : lo + STRIP] = np.where(np.isfinite(far[rows, at]), first + at, -1)
            far[rows, at] = np.inf
    return out


def keys(corners: np.ndarray, tests: np.ndarray) -> np.ndarray:
    """The sorted table keys of an image's corners, as signed numbers."""
    found = [np.empty(0, np.uint64)]
    weight = np.uint64(1) << np.arange(KEY_BITS, dtype=np.uint64)
    for scale in SCALES:
        mine = np.flatnonzero(corners[:, 3] == np.float32(scale))
        mine = mine[np.lexsort((corners[mine, 0], corners[mine, 1]))]
        if len(mine) < 3:
            continue
        near = nearest(corners[mine, 0].astype(float) + 1j * corners[mine, 1], 4 * scale, REACH * scale)
        bits = np.unpackbits(tests[mine], axis=1).astype(np.uint64)
        for k, chosen in enumerate(_key_bits()):
            own, other = _mix(bits[:, chosen[:KEY_BITS]] @ weight + np.uint64(k + 1)), _mix(bits[:, chosen[KEY_BITS:]] @ weight)
            for i in range(NEIGHBOURS):
                for j in range(i + 1, NEIGHBOURS):
                    both = (near[i] >= 0) & (near[j] >= 0)
                    found.append(_mix(own[both] + _mix(other[near[i][both]] + other[near[j][both]])))
    return np.unique(np.concatenate(found).view(np.int64))


def _matches(s: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in s and t of rows of tests that are each other's nearest and at most MAX_DISTANCE apart; strip by strip."""
    s, t = np.ascontiguousarray(s).view(np.uint64), np.ascontiguousarray(t).view(np.uint64)
    mate, low = np.empty(len(s), np.int64), np.empty(len(s), np.int64)
    back, least = np.zeros(len(t), np.int64), np.full(len(t), 1 << 20)
    for lo in range(0, len(s), STRIP):
        far = np.bitwise_count(s[lo : lo + STRIP, None, :] ^ t[None, :, :]).sum(axis=2, dtype=np.int64)
        mate[lo : lo + STRIP], low[lo : lo + STRIP] = far.argmin(axis=1), far.min(axis=1)
        best = far.min(axis=0)
        closer = best < least
        back[closer], least[closer] = lo + far.argmin(axis=0)[closer], best[closer]
    i = np.flatnonzero((back[mate] == np.arange(len(s))) & (low <= MAX_DISTANCE))
    return i, mate[i]


def consensus(p: np.ndarray, s: np.ndarray, q: np.ndarray, t: np.ndarray) -> tuple[int, float, float]:
    """(inliers, scale, turn) of the best similarity that takes corners p to q; s and t are their tests."""
    if len(p) < MIN_INLIERS or len(q) < MIN_INLIERS:
        return 0, 1.0, 0.0
    i, j = _matches(s, t)
    if len(i) < MIN_INLIERS:
        return 0, 1.0, 0.0
    a, b = p[i], q[j]
    z, w = a[:, 0] + 1j * a[:, 1], b[:, 0] + 1j * b[:, 1]
    # each two matches that lie apart give a similarity w = m z + c; pairs of neighbours in the list suffice as hypotheses
    best = (0, 1.0, 0.0)
    for step in range(1, min(len(i), 8)):
        dz, dw = np.roll(z, -step) - z, np.roll(w, -step) - w
        ok = np.abs(dz) > 4
        m = dw[ok] / dz[ok]
        c = w[ok] - m * z[ok]
        fit = (np.abs(m[:, None] * z[None, :] + c[:, None] - w[None, :]) <= TOLERANCE).sum(axis=1)
        fit[(np.abs(m) < 0.3) | (np.abs(m) > 3.3)] = 0
        if len(fit) and fit.max() > best[0]:
            k = int(fit.argmax())
            best = (int(fit[k]), float(np.abs(m[k])), float(np.angle(m[k])))
    return best


# --- operator ------------------------------------------------------------------------------------------------------------

LINK = "a long, b long, inliers int, scale double, turn double"


def _pack(corners: np.ndarray, tests: np.ndarray) -> bytes:
    """Places of the corners as 16-bit fractions of the largest, and their tests, behind the unit of a fraction."""
    unit = max(float(corners[:, :2].max(initial=0)), 1.0) / 65535
    return np.float64(unit).tobytes() + np.rint(corners[:, :2] / unit).astype("<u2").tobytes() + tests.tobytes()


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = (len(packed) - 8) // 36
    return np.frombuffer(packed, "<u2", 2 * n, 8).reshape(n, 2) * np.frombuffer(packed, np.float64, 1)[0], np.frombuffer(packed, np.uint8, 32 * n, 8 + 4 * n).reshape(n, 32)


def compare(x: bytes, y: bytes) -> tuple[int, float, float]:
    (p, s), (q, t) = _unpack(x), _unpack(y)
    return consensus(p, s, q, t)


def features(media: DataFrame) -> DataFrame:
    """(row, id, same, corners, keys) of media (row, id, media): same tells media apart, corners are those of _pack."""

    def make():
        from xxhash import xxh3_128_digest

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            given = batch.column(2).to_pylist()
            found = [describe(decode(m)) for m in given]
            same = pa.array([None if m is None else xxh3_128_digest(m) for m in given], pa.binary())
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), same, pa.array([_pack(p, t) for p, t in found], pa.binary()), pa.array([keys(p, t) for p, t in found], pa.list_(pa.int64()))], ["row", "id", "same", "corners", "keys"])

        return step

    return map_batches(media, make, "row long, id long, same binary, corners binary, keys array<long>")


def first_pairs(index: DataFrame) -> DataFrame:
    """(a, b, key, node) of sorted (key, node) rows: b under a, the first of its key; and, as key and node, all of keys with three images or more, or at the ends of a
    partition or of a HELD run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = [], True

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, first
            key, node = (np.concatenate(x) for x in zip(*held, strict=True))
            cuts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
            whole = final or len(cuts) == 2  # a single run that fills all that is held goes as if it ended here
            if not whole:
                held, key, node, cuts = [(key[cuts[-2] :], node[cuts[-2] :])], key[: cuts[-2]], node[: cuts[-2]], cuts[:-1]
            else:
                held = []
            size = np.diff(cuts)
            wide = size > 2
            wide[0] |= first
            wide[-1] |= whole
            first = whole
            lead = np.repeat(node[cuts[:-1]], size)
            pair = lead != node
            a, b = np.unique(np.stack((lead[pair], node[pair])), axis=1) if pair.any() else (lead[:0], lead[:0])
            rest = np.repeat(wide, size)
            none = lambda n: pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none(len(a)), none(len(a))], ["a", "b", "key", "node"])
            yield pa.RecordBatch.from_arrays([none(rest.sum()), none(rest.sum()), pa.array(key[rest]), pa.array(node[rest])], ["a", "b", "key", "node"])

        size = 0
        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in range(2)))
            size += batch.num_rows
            if size >= HELD:
                yield from flush(False)
                size = sum(len(k) for k, _ in held)
        if held:
            yield from flush(True)

    return index.mapInArrow(run, "a long, b long, key long, node long")


def verify(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) that geometry accepts, as LINK. found: row, corners."""
    x, y = found.select(F.col("row").alias("a"), F.col("corners").alias("x")), found.select(F.col("row").alias("b"), F.col("corners").alias("y"))
    both = pairs.select("a", "b").join(y, "b").join(x, "a").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _linked((a, b, *compare(p, q)) for a, b, p, q in zip(*(c.to_pylist() for c in batch.columns), strict=True))

    return both.mapInArrow(run, LINK)


def _linked(rows) -> pa.RecordBatch:
    good = [r for r in rows if r[2] >= MIN_INLIERS]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in good], kind) for k, kind in enumerate(kinds)], ["a", "b", "inliers", "scale", "turn"])


def across(wide: DataFrame, roots: DataFrame, found: DataFrame) -> DataFrame:
    """Links between the classes that meet in keys (key, node): one image of each class and key is compared with those of the others, in pairs of blocks."""
    met = wide.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")).groupBy("key", "root").agg(F.min("node").alias("node"))
    met = Written(met, "key-classes")
    several = met.df.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("all"), F.sum(F.hash("node").cast("long")).alias("more")).where("n > 1")
    once = several.groupBy("all", "more", "n").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))  # keys that hold the same images are one
    dealt = met.df.join(once, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    blocks = Written(dealt.join(found.select(F.col("row").alias("node"), "corners"), "node").groupBy("key", "block").agg(F.collect_list(F.struct("node", "corners")).alias("all")), "image-blocks")
    left, right = blocks.df.select("key", F.col("block").alias("m"), F.col("all").alias("x")), blocks.df.select("key", F.col("block").alias("n"), F.col("all").alias("y"))
    pairs = left.join(right, "key").where("m <= n").select("m", "n", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m, n, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield _linked((p["node"], q["node"], *compare(p["corners"], q["corners"])) for k, p in enumerate(x) for q in (x[k + 1 :] if m == n else y))

    return pairs.mapInArrow(run, LINK)


class Copies:
    """Copies within a media table. links: LINK, between rows; classes: (id, class_id, class_size), one row for each row of the table."""

    def __init__(self, media: DataFrame, id_col: str = "id", media_col: str = "media"):
        rows = media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).cast("binary").alias("media")).select(F.monotonically_increasing_id().alias("row"), "id", "media")
        full = Written(features(rows), "features")
        index = full.df.select(F.explode("keys").alias("key"), F.col("row").alias("node"))
        parts = max(int(media.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
        met = Written(first_pairs(index.repartitionByRange(parts, "key", "node").sortWithinPartitions("key", "node")), "met")
        known = Written(full.df.select("row", "id", "same", "corners"), "images")
        full.drop()  # the keys have done their work
        found = known.df.select("row", "corners")
        equal = Written(known.df.where("same is not null").groupBy("same").agg(F.min("row").alias("a"), F.count("*").alias("n")).where("n > 1").select("same", "a"), "equal-media")
        exact = known.df.join(equal.df, "same").where("row <> a").select("a", F.col("row").alias("b"))
        pairs = Written(met.df.where("a is not null").select("a", "b").distinct(), "pairs")
        links = Written(verify(pairs.df, found), "links")
        roots = components(links.df.select("a", "b").unionByName(exact))
        more = Written(across(met.df.where("key is not null").select("key", "node"), roots.df, found), "links")
        self.links = links.df.unionByName(more.df)
        joined = components(self.links.select("a", "b").unionByName(exact))
        named = known.df.select("row", "id").join(joined.df.withColumnRenamed("node", "row"), "row", "left").select("row", "id", F.coalesce("root", "row").alias("root"))
        sizes = named.groupBy("root").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"))
        self.classes = named.join(sizes, "root").select("id", "class_id", "class_size")


def render(vector) -> bytes:
    """A picture of a vector of numbers: a square mosaic (of 8 x 8 tiles at least) with a tile for each, and in it an inner square of the opposite grey."""
    v = np.nan_to_num(np.array([] if vector is None else [0.0 if x is None else x for x in vector], float))
    side = max(8, int(np.ceil(np.sqrt(len(v)))))
    grey = np.clip(128 + 420 * np.pad(v, (0, side * side - len(v))), 0, 255).reshape(side, side)
    image = np.kron(grey, np.ones((10, 10)))
    for y in range(side):
        for x in range(side):
            k = 2 + (side * y + x) % 3
            image[10 * y + k : 10 * y + k + 4, 10 * x + 3 : 10 * x + 7] = 255 - grey[y, x]
    return encode_png(image)


def pictures(embeddings: DataFrame) -> DataFrame:
    """(id, media): the test tables hold no images, so each vector is drawn as one."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([render(v) for v in batch.column(1).to_pylist()], pa.binary())], ["id", "media"])

        return step

    return map_batches(embeddings.select(F.col("vec_id").cast("long"), "embedding"), make, "id long, media binary")


def op7_media_copies(spark, sf_dir: str) -> DataFrame:
    found = Copies(pictures(table(spark, sf_dir, "embeddings"))).classes
    return found.select(F.col("id").alias("vec_id"), "class_id", "class_size")
