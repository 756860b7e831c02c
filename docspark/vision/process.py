"""From images to flat records: quality, side, fields, recognition, ranking, checks.

``process`` takes images (path, content) and gives a row for each, whatever
becomes of it: an image that cannot be read, or whose side is not known, is a row
with its errors and no record. The images are read twice, for the boxes and for
the crops, and meet their boxes by path; everything in between is small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark import dims
from docspark.operators import candidates, record
from docspark.vision import frames, recognize
from docspark.vision import image as im

CROPS = "rec string, field string, field_type string, confidence double, content binary, crop_empty boolean"
#: Types of the fields that are found on a card.
TYPES = dims.CLASS_TYPES | {"serial_number": "text"}
NO_SIDE = "Could not confidently classify front vs back; skipping field localization. You can manually specify the card side in settings."


def _cropped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = [c.split()[0] for c in CROPS.split(", ")], [pa.string(), pa.string(), pa.string(), pa.float64(), pa.binary(), pa.bool_()]
    for batch in batches:
        for at in range(0, batch.num_rows, frames.BATCH):
            part, rows = batch.slice(at, frames.BATCH), []
            for path, raw, boxes in zip(*(part.column(c).to_pylist() for c in ("path", "content", "boxes")), strict=True):
                card = frames.card(im.decode(raw))
                for b in boxes:
                    crop = card[b["y"] : b["y"] + b["h"], b["x"] : b["x"] + b["w"]]
                    rows.append((path, b["cls"], TYPES.get(b["cls"], "arabic_text"), b["confidence"], im.encode(crop) if crop.size else None, not crop.size))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def crops(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """The parts of the rectified cards in ``boxes`` (path, cls, x, y, w, h, confidence)."""
    each = boxes.groupBy("path").agg(F.collect_list(F.struct("cls", "x", "y", "w", "h", "confidence")).alias("boxes"))  # a few for a card
    return images.select("path", "content").join(each, "path").mapInArrow(_cropped, CROPS)


def process(images: DataFrame, as_of: Column, engine: Callable[[], Any] | None = None, force_side: str | None = None, localizer: Callable[[], Any] | None = None, key: str = "default", barcode_reader: Callable[[], Any] | None = None) -> DataFrame:
    """path, errors, quality and side of each image, and its flat record.

    ``engine`` and ``localizer`` make what reads texts and finds fields, in the
    workers; without an engine all fields that have text are failed as
    unavailable, without a localizer (or where it fails) fields are found by
    their print; without a ``barcode_reader`` barcodes are seen, not read.
    ``force_side`` is the side of all cards, "front" or "back".
    """
    seen = frames.assessed(images, force_side)
    sided = seen.where("error IS NULL AND side.side <> 'unknown'").select("path")
    boxes = frames.localized(images.join(sided, "path", "left_semi"), localizer, key)
    cut = crops(images, boxes)
    reads = cut.select("rec", "field", "field_type", F.col("confidence").alias("localization_confidence"), "crop_empty", F.lit(False).alias("decoded"))
    if barcode_reader is not None:
        codes = recognize.barcodes(cut.where("field_type = 'barcode' AND NOT crop_empty"), barcode_reader, key).where("status = 'barcode_decoded'")
        reads = reads.drop("decoded").join(codes.select("rec", "field", F.lit(True).alias("decoded")), ["rec", "field"], "left").withColumn("decoded", F.coalesce("decoded", F.lit(False)))
    if engine is None:
        none = F.lit(None)
        fields = reads.select("*", none.cast("string").alias("raw"), none.cast("double").alias("ocr_confidence"), F.lit(False).alias("has_candidate"))
    else:
        text = cut.where("field_type NOT IN ('image_region', 'barcode') AND NOT crop_empty")
        best = candidates.best(recognize.recognized(text, engine, key), as_of).select("rec", "field", F.col("text").alias("raw"), F.col("confidence").alias("ocr_confidence"), F.lit(True).alias("has_candidate"))
        fields = reads.join(best, ["rec", "field"], "left").withColumn("has_candidate", F.coalesce("has_candidate", F.lit(False)))
    flat = record.assemble(fields, as_of, ocr_ready=engine is not None).withColumnRenamed("rec", "path")
    side = F.col("side.side")
    errors = F.array_compact(F.array("error", F.when(side == "unknown", NO_SIDE)))
    template = F.when(side == "front", dims.TEMPLATES[0][0]).when(side == "back", dims.TEMPLATES[1][0])
    out = seen.select("path", errors.alias("errors"), "status", side.alias("side"), F.round("side.confidence", 4).alias("side_confidence"), template.alias("template"))
    return out.join(flat, "path", "left")
