"""Copies of images by local descriptors, also where they are cropped or edited.

An image column (binary PGM or PPM, "P5" or "P6") gives each image up to
``CORNERS`` corners over several scales, the direction of each (towards the
brightness around it) and 256 binary tests turned to that direction. The two
places of a test lie across the direction and away from the corner itself, where
unrelated corners look alike.

Descriptors meet in Hamming tables: ``TABLES`` bands of ``BAND`` bits, joined by
band, of which those meet that differ in ``MEET`` of all bits at most. Two pictures
are compared if two different corners of one meet corners of the other; they are
linked if ``INLIERS`` matches of their descriptors agree on one turn, size and shift. Linked pictures form classes; images of equal
bytes are one picture from the start.

Not all pairs of a group of copies are made. In buckets of ``LARGE`` pictures and
more, each is first compared with one picture that it meets, ``ROUNDS`` times with
another one, which puts most of a group into one class at the cost of its size;
then, in all buckets, all pairs that are still in different classes meet. So no
pair that shares two corners is missed. Each step is written out, so a lost
executor repeats tasks and nothing else.

What is lost: corners after the ``CORNERS`` strongest of a picture, so that a
small part of a busy picture may keep too few; and pictures without two matches
that share a band and differ in ``MEET`` bits at most. A band's bits bound how many
unrelated pictures share a bucket, which grows with the square of their number:
more pictures ask for more bits. ``MEET`` keeps all but few of these from going on.

There is no table of images among the inputs, so the query draws each vector of
``embeddings`` as a texture, the sum of fixed textures by its numbers (near
vectors are edited copies of a picture), and adds an edited copy, cut, turned or
brightened, of every hundredth, so that each table has links that are known.

Defined results: a null or unreadable image, and one too small or too plain for
corners, is a class of its own, unless its bytes are equal to another's (null
images are not equal to one another); a null id keeps its class but never names
one; repeated rows are copies of each other; of a very large image the strongest
corners count; an empty table gives an empty table; only id and image are read,
so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import discard, in_arrow, staged, table
from docspark.llm.graph import components

CORNERS = 48
SCALES = (1.0, 1.5, 2.25)
PATCH = 13
BITS, BAND, TABLES = 256, 32, 8
#: Bits in which two descriptors of a match may differ, and those that bring pictures together.
DIFFER, MEET = 64, 40
INLIERS = 10
#: Pictures of a bucket from which they are compared with one of them before they meet one another, and how often.
LARGE, ROUNDS = 16, 3
#: Pixels (at the scale of a corner) by which a match may miss its place.
MISS = 3.0

_rng = np.random.default_rng(20240229)


def _tests() -> np.ndarray:
    """Pairs of places (x, y): within the patch, five pixels from the corner at least, at most four apart along its direction."""
    p = _rng.uniform(-PATCH + 1, PATCH - 1, (64 * BITS, 2, 2))
    away = (p**2).sum(axis=2)
    return p[(away.max(axis=1) <= (PATCH - 1) ** 2) & (away.min(axis=1) >= 25) & (np.abs(p[:, 0, 0] - p[:, 1, 0]) <= 4)][:BITS]


_TESTS = _tests()
_Y, _X = np.mgrid[-PATCH : PATCH + 1, -PATCH : PATCH + 1]
_DISC = np.flatnonzero((_Y**2 + _X**2 <= PATCH**2).ravel())
#: Bits of each band, drawn anew for each table.
_ORDER = np.stack([_rng.permutation(BITS)[:BAND] for _ in range(TABLES)])


def decoded(raw: bytes | None) -> np.ndarray | None:
    """Brightness of a binary PGM or PPM of 8 bits; None if it is not one."""
    m = re.match(rb"P([56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", raw or b"")
    if not m or int(m[4]) > 255:
        return None
    w, h, planes = int(m[2]), int(m[3]), 3 if m[1] == b"6" else 1
    pixels = np.frombuffer(raw, np.uint8, -1, m.end())
    if len(pixels) < w * h * planes or not w * h:
        return None
    image = pixels[: w * h * planes].reshape(h, w, planes).astype(np.float32)
    return image @ np.array([0.299, 0.587, 0.114], np.float32) if planes == 3 else image[:, :, 0]


def encoded(image: np.ndarray) -> bytes:
    return f"P5 {image.shape[1]} {image.shape[0]} 255\n".encode() + np.clip(np.rint(image), 0, 255).astype(np.uint8).tobytes()


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, with the centres of pixels kept in place."""
    at = [np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1) for n, m in ((height, image.shape[0]), (width, image.shape[1]))]
    low = [np.floor(a).astype(int) for a in at]
    high = [np.minimum(a + 1, m - 1) for a, m in zip(low, image.shape, strict=True)]
    fy, fx = (at[0] - low[0])[:, None], (at[1] - low[1])[None]
    top = image[low[0]][:, low[1]] * (1 - fx) + image[low[0]][:, high[1]] * fx
    bottom = image[high[0]][:, low[1]] * (1 - fx) + image[high[0]][:, high[1]] * fx
    return (top * (1 - fy) + bottom * fy).astype(np.float32)


def blurred(image: np.ndarray) -> np.ndarray:
    for axis in (0, 1):
        p = np.pad(image, [(2, 2) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        s = [p.take(np.arange(k, k + image.shape[axis]), axis) for k in range(5)]
        image = (s[0] + 4 * s[1] + 6 * s[2] + 4 * s[3] + s[4]) / 16
    return image


def described(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners (x, y, scale, direction) in pixels of the image, and their descriptors of 32 bytes."""
    places, found = [], []
    for scale in SCALES:
        h, w = round(image.shape[0] / scale), round(image.shape[1] / scale)
        if min(h, w) < 12:
            break
        small = blurred(resized(image, h, w) if scale > 1 else image)
        gy, gx = np.gradient(small)
        a, b, c = blurred(gx * gx), blurred(gy * gy), blurred(gx * gy)
        corner = a * b - c * c - 0.05 * (a + b) ** 2
        padded = np.pad(corner, 1, constant_values=-np.inf)
        around = np.stack([padded[i : i + h, j : j + w] for i in range(3) for j in range(3) if (i, j) != (1, 1)])
        peak = (corner >= around.max(axis=0)) & (corner > 1.0)
        peak[:3], peak[-3:], peak[:, :3], peak[:, -3:] = False, False, False, False
        y, x = np.nonzero(peak)
        if not len(y):
            continue
        strength = corner[y, x]
        edge = np.pad(small, 2 * PATCH, mode="reflect" if min(h, w) > 2 * PATCH else "symmetric")
        disc = edge[(y + 2 * PATCH)[:, None] + _Y.ravel()[_DISC], (x + 2 * PATCH)[:, None] + _X.ravel()[_DISC]]
        disc = disc - disc.mean(axis=1, keepdims=True)
        turn = np.arctan2(disc @ _Y.ravel()[_DISC], disc @ _X.ravel()[_DISC])
        cos, sin = np.cos(turn)[:, None, None], np.sin(turn)[:, None, None]
        ty = np.rint(sin * _TESTS[:, :, 0] + cos * _TESTS[:, :, 1]).astype(int) + (y + 2 * PATCH)[:, None, None]
        tx = np.rint(cos * _TESTS[:, :, 0] - sin * _TESTS[:, :, 1]).astype(int) + (x + 2 * PATCH)[:, None, None]
        value = edge[ty, tx]
        found.append(np.packbits(value[:, :, 0] < value[:, :, 1], axis=1))
        places.append(np.stack([(x + 0.5) * image.shape[1] / w, (y + 0.5) * image.shape[0] / h, np.full(len(x), scale), turn, strength], axis=1))
    if not places:
        return np.zeros((0, 4), np.float32), np.zeros((0, BITS // 8), np.uint8)
    place, bits = np.concatenate(places), np.concatenate(found)
    best = np.argsort(-place[:, 4], kind="stable")[:CORNERS]
    return place[best, :4].astype(np.float32), bits[best]


def consensus(place_a: np.ndarray, bits_a: np.ndarray, place_b: np.ndarray, bits_b: np.ndarray) -> int:
    """Matches that agree best on one turn, size and shift from a to b."""
    if not len(bits_a) or not len(bits_b):
        return 0
    a, b = bits_a.view(np.uint64), bits_b.view(np.uint64)
    distance = np.bitwise_count(a[:, None, :] ^ b[None, :, :]).sum(axis=2, dtype=np.int64)
    nearest = distance.argmin(axis=1)
    mutual = distance.argmin(axis=0)[nearest] == np.arange(len(a))
    i = np.flatnonzero(mutual & (distance[np.arange(len(a)), nearest] <= DIFFER))
    if len(i) < INLIERS:
        return 0
    p, q = place_a[i].astype(float), place_b[nearest[i]].astype(float)
    # one hypothesis from each match, tried on all
    ratio, turn = q[:, 2] / p[:, 2], q[:, 3] - p[:, 3]
    zp, zq = p[:, 0] + 1j * p[:, 1], q[:, 0] + 1j * q[:, 1]
    move = ratio * np.exp(1j * turn)
    miss = np.abs(zq[:, None] + move[:, None] * (zp[None] - zp[:, None]) - zq[None]) / q[None, :, 2]
    off = np.abs(np.angle(np.exp(1j * (turn[:, None] - turn[None]))))
    good = (miss <= MISS) & (off <= 0.5) & (np.abs(np.log(ratio[:, None] / ratio[None])) < 0.5)
    return int(good.sum(axis=1).max())


DESCRIBED = "id long, content binary, places binary, bits binary"


def _described(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            content, places, bits = [], [], []
            for raw in batch.column("image").to_pylist():
                image = decoded(raw)
                p, b = described(image) if image is not None else (np.zeros((0, 4), np.float32), np.zeros((0, 32), np.uint8))
                content.append(None if raw is None else hashlib.sha256(raw).digest())
                places.append(p.astype("<f4").tobytes())
                bits.append(b.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, pa.binary()) for c in (content, places, bits))], names=["id", "content", "places", "bits"])


def _bands(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (band, node, corner) for each table and descriptor."""
    weight = 1 << np.arange(BAND, dtype=np.int64)
    for batch in batches:
        bits = [np.frombuffer(x, np.uint8).reshape(-1, BITS // 8) for x in batch.column("bits").to_pylist()]
        sizes = np.array([len(b) for b in bits], np.int64)
        tests = np.unpackbits(np.concatenate(bits), axis=1).astype(np.int64)
        band = np.concatenate([(tests[:, o] @ weight) * TABLES + k for k, o in enumerate(_ORDER)])
        node = np.repeat(batch.column("node").to_numpy(), sizes)
        corner = np.concatenate([np.arange(n, dtype=np.int16) for n in sizes])
        yield pa.RecordBatch.from_arrays([pa.array(band), pa.array(np.tile(node, TABLES)), pa.array(np.tile(corner, TABLES))], names=["band", "node", "corner"])


def _words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The descriptors of each picture as numbers of 64 bits."""
    for batch in batches:
        bits = batch.column("bits").to_pylist()
        ends = np.cumsum([0] + [len(b) // 8 for b in bits]).astype(np.int32)
        words = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(bits), "<i8")))
        yield pa.RecordBatch.from_arrays([batch.column("node"), words], names=["node", "words"])


#: 64-bit words of a descriptor.
WORDS = [f"w{k}" for k in range(BITS // 64)]


def meetings(pictures: DataFrame) -> DataFrame:
    """Rows (band, node, corner, size, w0 to w3): the buckets of two descriptors or more, and the whole descriptors.

    The count of a band is made before the shuffle where it can be; a band that
    very many rows have is split by the skew-aware join.
    """
    bits = pictures.select("node", "bits")
    bands = bits.transform(in_arrow, _bands, "band long, node long, corner short")
    shared = bands.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    words = bits.transform(in_arrow, _words, "node long, words array<long>")
    word = [F.get("words", F.col("corner") * len(WORDS) + k).alias(w) for k, w in enumerate(WORDS)]
    return bands.join(shared, "band").join(words, "node").select("band", "node", "corner", "size", *word)


def _agreed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = []
        for k in "uv":
            places, bits = batch.column(f"places_{k}").to_pylist(), batch.column(f"bits_{k}").to_pylist()
            sides.append([(np.frombuffer(p, "<f4").reshape(-1, 4), np.frombuffer(b, np.uint8).reshape(-1, BITS // 8)) for p, b in zip(places, bits, strict=True)])
        yield batch.select(["u", "v"]).filter(pa.array([agrees(one, other) for one, other in zip(*sides, strict=True)], pa.bool_()))


def agrees(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> bool:
    """Whether ``consensus`` links two pictures, from either to the other (a miss is measured in the other's scale)."""
    return consensus(*one, *other) >= INLIERS or consensus(*other, *one) >= INLIERS


def paired(hits: DataFrame) -> DataFrame:
    """The pairs (u, v) of ``hits`` (u, v, corner) that meet in two corners of u."""
    return hits.groupBy("u", "v").agg(F.min("corner").alias("a"), F.max("corner").alias("b")).where("a < b").select("u", "v")


def compared(pairs: DataFrame, pictures: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) that are linked."""
    side = lambda k: pictures.select(F.col("node").alias(k), F.col("places").alias(f"places_{k}"), F.col("bits").alias(f"bits_{k}"))
    return pairs.join(side("u"), "u").join(side("v"), "v").transform(in_arrow, _agreed, "u long, v long")


def links(pictures: DataFrame) -> DataFrame:
    """Edges (u, v) that connect all pictures (node, places, bits) that are linked."""
    met = staged(meetings(pictures), "meetings")
    large, found = met.where(F.col("size") >= LARGE), None
    classes = None
    for turn in range(ROUNDS):
        here = _classed(large, classes)
        # the picture of least hash in each bucket, and of these the least that a picture meets in two corners
        lead = here.groupBy("band").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("by"), "node", "root")).alias("lead"))
        hits = here.join(lead, "band").where("root <> lead.root").select(F.col("node").alias("u"), F.col("lead.node").alias("v"), "corner")
        pairs = paired(hits).groupBy("u").agg(F.min(F.struct(F.xxhash64("v", F.lit(turn)).alias("by"), "v")).alias("x")).select("u", "x.v")
        new = staged(compared(pairs, pictures), "leaders")
        found = new if found is None else found.unionByName(new)
        classes = staged(components(found), "roots")
    here = _classed(met, classes)
    rest = staged(compared(paired(near(here)), pictures), "links")
    discard(met)
    return found.unionByName(rest)


def near(here: DataFrame) -> DataFrame:
    """Pairs (u, v, corner of u) of different classes that share a bucket and differ in ``MEET`` bits at most."""
    one = here.select("band", F.col("node").alias("u"), "corner", F.col("root").alias("p"), *WORDS)
    other = here.select("band", F.col("node").alias("v"), F.col("root").alias("q"), *(F.col(w).alias(f"{w}_v") for w in WORDS))
    differ = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"{w}_v"))) for w in WORDS), F.lit(0))
    return one.join(other, (one["band"] == other["band"]) & F.expr("u < v AND p <> q") & (differ <= MEET)).select("u", "v", "corner")


def _classed(met: DataFrame, classes: DataFrame | None) -> DataFrame:
    """The rows of ``met`` with the class of their picture so far."""
    here = met.drop("size")
    return here.withColumn("root", F.col("node")) if classes is None else here.join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))


def copies(images: DataFrame) -> DataFrame:
    """id, class_id (the least id of the class) and members (rows of the class) of each row of ``images`` (id, image)."""
    described = staged(images.select(F.col("id").cast("long").alias("id"), "image").transform(in_arrow, _described, DESCRIBED), "described")
    # a node is a picture, known by a hash of its bytes; a null image is a node of its own
    every = described.withColumn("node", F.when(F.col("content").isNotNull(), F.xxhash64("content")))
    pictures = every.where("node IS NOT NULL AND length(bits) > 0").groupBy("node").agg(F.min(F.struct("id", "places", "bits")).alias("x"))
    pictures = staged(pictures.select("node", "x.places", "x.bits"), "pictures")
    rows = staged(every.select("id", "node"), "rows")
    discard(described)
    root = components(links(pictures))
    discard(pictures)
    rows = rows.join(root, "node", "left").select("id", F.coalesce("root", "node").alias("root"))
    named = rows.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("class_id"), F.count("*").alias("members"))
    own = F.col("root").isNull()
    return rows.join(named, "root", "left").select("id", F.when(own, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.when(own, 1).otherwise(F.col("members")).cast("long").alias("members"))


SIDE, CELL = 64, 6
#: One in so many vectors gives an edited copy too.
PLANTED = 100


@lru_cache(2)
def textures(n: int) -> np.ndarray:
    rng = np.random.default_rng(n)
    return np.stack([resized(rng.normal(size=(SIDE // CELL + 2,) * 2).astype(np.float32), SIDE, SIDE) for _ in range(n)])


def drawn(vector: list[float] | None, edit: int = 0) -> bytes | None:
    """The sum of textures by the vector's numbers; ``edit`` cuts it (1), turns it (2) or brightens it (3)."""
    if not vector or any(x is None for x in vector):
        return None
    field = np.tensordot(np.array(vector, np.float32), textures(len(vector)), 1)
    image = 128 + 44 * (field - field.mean()) / (float(field.std()) or 1.0)
    return encoded((image, image[:, : SIDE * 3 // 4], np.rot90(image), 1.1 * image + 6)[edit])


def _drawn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        images = [drawn(v, e) for v, e in zip(batch.column("embedding").to_pylist(), batch.column("edit").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(images, pa.binary())], names=["id", "image"])


def op10_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, edited (whether the row is an edited copy), class_id (a vec_id) and members."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    edits = F.when(F.col("vec_id") % PLANTED == 0, F.array(F.lit(0), (F.abs(F.col("vec_id")) / PLANTED).cast("int") % 3 + 1)).otherwise(F.array(F.lit(0)))
    rows = vectors.select((2 * F.col("vec_id")).alias("id"), "embedding", F.explode(edits).alias("edit"))
    rows = rows.select((F.col("id") + (F.col("edit") > 0).cast("int")).alias("id"), "embedding", "edit")
    found = copies(rows.transform(in_arrow, _drawn, "id long, image binary"))
    return found.select(F.expr("id div 2").alias("vec_id"), (F.col("id") % 2 == 1).alias("edited"), F.expr("class_id div 2").alias("class_id"), "members")
