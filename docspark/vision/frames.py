"""The pixel operators over DataFrames of images, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark import dims
from docspark.functions import geometry
from docspark.operators import detections
from docspark.vision import image as im
from docspark.vision.contours import card_corners
from docspark.vision.recognize import engine

MEASURES = "path string, error string, width int, height int, blur_score double, brightness double, contrast double, glare_ratio double, photo_score double, barcode_score double, scale double"
FIELDS = "path string, cls string, x int, y int, w int, h int, confidence double, crop_issues array<string>"
#: Images in memory at a time.
BATCH = 16


def _each(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple[str, bytes | None]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            yield list(zip(part.column("path").to_pylist(), part.column("content").to_pylist(), strict=True))


def card(image: np.ndarray) -> np.ndarray:
    """The card of the image, by its corners, at canonical size."""
    small, _ = im.normalize(image)
    return im.rectify(small, card_corners(small)[0])


def _measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in MEASURES.split(", ")]
    types = [pa.string(), pa.string(), pa.int32(), pa.int32(), *[pa.float64()] * 7]
    for part in _each(batches):
        rows = []
        for path, raw in part:
            image = im.decode(raw)
            if image is None:
                rows.append((path, "unreadable image", *[None] * 9))
                continue
            m = im.measures(image)
            whole, scale = card(image), min(dims.PROCESSING_MAX_DIM / max(image.shape[:2]), 4.0)
            rows.append((path, None, image.shape[1], image.shape[0], *m.values(), im.photo_score(whole), im.barcode_score(whole), scale))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def assessed(images: DataFrame, force_side: str | None = None) -> DataFrame:
    """Quality and side of each image (path, content); an unreadable one is a row with its error."""
    out = images.select("path", "content").mapInArrow(_measured, MEASURES)
    issues = geometry.quality_issues(F.col("blur_score"), F.col("brightness"), F.col("contrast"), F.col("glare_ratio"))
    side = geometry.side(F.col("photo_score"), F.col("barcode_score"))
    if force_side:
        side = F.struct(F.lit(force_side).alias("side"), F.lit(1.0).alias("confidence"))
    readable = F.col("error").isNull()
    return out.withColumn("issues", F.when(readable, issues)).withColumn("status", F.when(readable, geometry.quality_status(F.col("issues")))).withColumn("side", F.when(readable, side))


def placed(whole: np.ndarray, localizer: Any | None) -> list[tuple[str, int, int, int, int, float]]:
    """Fields by their print; those that the localizer finds (cls, x, y, w, h, confidence) take their place, unless it fails."""
    anchors = im.localize(whole)
    if localizer is None:
        return anchors
    try:
        found = [(c, int(x), int(y), int(w), int(h), float(p)) for c, x, y, w, h, p in localizer.boxes(whole)]
    except Exception:  # whatever a model raises, the card still has its print
        return anchors
    best: dict[str, tuple[str, int, int, int, int, float]] = {}
    for f in found:
        if f[0] not in best or f[5] > best[f[0]][5]:
            best[f[0]] = f
    return [*best.values(), *(f for f in anchors if f[0] not in best)]


def localized(images: DataFrame, localizer: Callable[[], Any] | None = None, key: str = "default") -> DataFrame:
    """The front fields of each readable image, apart from one another.

    ``localizer`` makes a model with ``boxes(card)`` in each worker; where it
    cannot be made or fails, fields are found by their print alone.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in FIELDS.split(", ")]
        types = [pa.string(), pa.string(), *[pa.int32()] * 4, pa.float64(), pa.list_(pa.string())]
        try:
            model = engine(localizer, f"localizer {key}") if localizer else None
        except Exception:
            model = None
        for part in _each(batches):
            rows = []
            for path, raw in part:
                image = im.decode(raw)
                if image is not None:
                    whole = card(image)
                    rows += [(path, f, x, y, w, h, c, im.crop_issues(whole[y : y + h, x : x + w])) for f, x, y, w, h, c in placed(whole, model)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    found = images.select("path", "content").mapInArrow(run, FIELDS).withColumnRenamed("path", "rec")
    return detections.resolve_overlaps(found).withColumnRenamed("rec", "path")


def _drawn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        images = [im.encode(im.drawn_card(428, 270, seed)) if seed % 7 else b"no image" for seed in batch.column("seed").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([f"card_{s}.ppm" for s in batch.column("seed").to_pylist()]), pa.array(images, pa.binary())], names=["path", "content"])


def drawn(seeds: DataFrame) -> DataFrame:
    """path and content of a drawn card for each seed; every seventh is unreadable."""
    return seeds.select("seed").mapInArrow(_drawn, "path string, content binary")


def _desk(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A drawn card on a desk, and its corners."""
    x, y, w = 90 + seed % 7 * 10, 70 + seed % 5 * 12, 428 + seed % 4 * 20
    h = round(w * dims.CANONICAL_HEIGHT / dims.CANONICAL_WIDTH)
    desk = np.clip(np.array([60, 95, 150]) + np.random.default_rng(seed).normal(0, 4, (450, 640, 1)), 0, 255).astype(np.uint8)
    desk[y : y + h, x : x + w] = im.drawn_card(w, h, seed)
    return desk, np.array([[x, y], [x + w, y], [x + w, y + h], [x, y + h]], np.float64)


def _found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        off, sure = [], []
        for seed in batch.column("seed").to_pylist():
            image, drawn = _desk(seed)
            quad, score = card_corners(image)
            off.append(float(np.abs(quad - drawn).max()) / image.shape[1])
            sure.append(score)
        yield pa.RecordBatch.from_arrays([batch.column("seed"), pa.array(off, pa.float64()), pa.array(sure, pa.float64())], names=["seed", "off", "score"])


def found_on_desks(seeds: DataFrame) -> DataFrame:
    """How far the corners that are found lie from those drawn, as a share of the picture's width, and how sure they are."""
    return seeds.select("seed").mapInArrow(_found, "seed long, off double, score double")


def _ordered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        quads = [im.order_corners(p).ravel().tolist() for p in batch.column("corners").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("rec"), pa.array(quads, pa.list_(pa.float64()))], names=["rec", "quad"])


def ordered_corners(quads: DataFrame) -> DataFrame:
    """rec and its corners (eight numbers), from top left around."""
    return quads.select("rec", "corners").mapInArrow(_ordered, "rec long, quad array<double>")
