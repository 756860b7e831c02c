"""Detected regions: scales, classes, the best of each class, precedence, overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark import dims

RIGHT, LEFT = ("name", "address", "national_id"), ("photo", "date_of_birth", "serial_number")


def named(detections: DataFrame) -> DataFrame:
    """With the class name of each id, or the id itself where it has none. The dimension has nine rows."""
    known = dims.classes(detections.sparkSession).select("cls_id", F.col("cls").alias("__cls"))
    return detections.join(F.broadcast(known), "cls_id", "left").withColumn("cls", F.coalesce("__cls", F.col("cls_id").cast("string"))).drop("__cls")


def original_scale(detections: DataFrame) -> DataFrame:
    """Coordinates of all scales in pixels of the image, cut to whole ones."""
    return detections.withColumns({c: (F.col(c) / F.col("scale")).cast("int") for c in ("x0", "y0", "x1", "y1")})


def best_per_class(detections: DataFrame) -> DataFrame:
    """The most confident of each class; the first among equals."""
    first = Window.partitionBy("rec", "cls").orderBy(F.desc("confidence"), "det_ord")
    return detections.withColumn("__rank", F.row_number().over(first)).where("__rank = 1").drop("__rank")


def outside_header(width: float = dims.CANONICAL_WIDTH, height: float = dims.CANONICAL_HEIGHT) -> Column:
    cx, cy = (F.col("x0") + F.col("x1")) / 2 / width, (F.col("y0") + F.col("y1")) / 2 / height
    return ~((cx > 0.30) & (cy < 0.20))


def boxes(detections: DataFrame, width: int = dims.CANONICAL_WIDTH, height: int = dims.CANONICAL_HEIGHT) -> DataFrame:
    """x, y, w, h within the card; an address begins a little higher than it was found."""
    pad = max(8, int(0.025 * height))
    y0 = F.when(F.col("cls") == "address", F.greatest(F.lit(0), F.col("y0") - pad)).otherwise(F.col("y0"))
    x0 = F.greatest(F.lit(0), F.least(F.lit(width - 1), F.col("x0")))
    y0 = F.greatest(F.lit(0), F.least(F.lit(height - 1), y0))
    x1 = F.greatest(x0 + 1, F.least(F.lit(width), F.col("x1")))
    y1 = F.greatest(y0 + 1, F.least(F.lit(height), F.col("y1")))
    return detections.select("rec", "cls", "confidence", x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h"))


def merge(anchors: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each record and class: all of ``found``, and of ``anchors`` what it lacks."""
    columns = [c for c in found.columns if c not in ("rec", "cls")]
    a = anchors.select("rec", "cls", F.struct(*columns).alias("a"))
    b = found.select("rec", "cls", F.struct(*columns).alias("b"))
    both = a.join(b, ["rec", "cls"], "full")
    return both.withColumn("r", F.coalesce("b", "a")).select("rec", "cls", "r.*", F.when(F.col("b").isNotNull(), "found").otherwise("anchor").alias("source"))


def resolve_overlaps(table: DataFrame, pad: int = 4) -> DataFrame:
    """Part boxes of neighbouring classes that overlap downwards, pair after pair.

    One row a record holds the boxes of its (few, fixed) classes, so the second
    pair of a chain sees what the first has done.
    """
    kept = [c for c in table.columns if c not in ("rec", "cls", "x", "y", "w", "h")]
    names = [*RIGHT, *LEFT]
    entry = F.struct(*kept, *(F.col(c).alias(c) for c in ("x", "y", "w", "h")))
    wide = table.where(F.col("cls").isin(names)).groupBy("rec").pivot("cls", names).agg(F.first(entry))
    for chain in (RIGHT, LEFT):
        for top, bottom in zip(chain[:-1], chain[1:], strict=True):
            a, b = F.col(top), F.col(bottom)
            over = F.coalesce(a["y"] + a["h"] > b["y"], F.lit(False))
            middle = F.floor((a["y"] + a["h"] + b["y"]) / 2).cast("int")
            height = F.greatest(F.lit(20), middle - pad - a["y"])
            start = middle + pad
            rest = F.greatest(F.lit(20), b["y"] + b["h"] - start)
            wide = wide.withColumns({top: F.when(over, a.withField("h", height)).otherwise(a), bottom: F.when(over, b.withField("y", start).withField("h", rest)).otherwise(b)})
    long = wide.select("rec", F.explode(F.array(*[F.struct(F.lit(n).alias("cls"), F.col(n).alias("r")) for n in names])).alias("e"))
    changed = long.where("e.r IS NOT NULL").select("rec", "e.cls", "e.r.*").select(*table.columns)
    return changed.unionByName(table.where(~F.col("cls").isin(names)))


def localize(detections: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """All of it: scales, names, best of each class, header, boxes, overlaps, and gaps filled from ``anchors``."""
    found = boxes(best_per_class(named(original_scale(detections))).where(outside_header()))
    found = resolve_overlaps(found)
    return found.withColumn("source", F.lit("found")) if anchors is None else merge(anchors, found)
