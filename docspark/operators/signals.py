"""Profiles of pixels: moments, percentiles, islands of ink, valleys; and the evaluation summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import geometry


def pixel_stats(pixels: DataFrame, over: float) -> DataFrame:
    """Mean, population deviation and variance, and the share above ``over``, of each record (rec, v)."""
    return pixels.groupBy("rec").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.var_pop("v").alias("variance"), F.avg((F.col("v") > over).cast("double")).alias("share_over"))


def profile_percentile(pixels: DataFrame, share: float = 0.4) -> DataFrame:
    """By linear interpolation between the two nearest values."""
    return pixels.groupBy("rec").agg(F.percentile("v", F.lit(share)).alias("p"))


def islands(pixels: DataFrame, threshold: float, gap: int, least: int) -> DataFrame:
    """Runs of places above ``threshold``, cut where more than ``gap`` lie between, of ``least`` or longer."""
    w = Window.partitionBy("rec").orderBy("pos")
    on = pixels.where(F.col("v") > threshold)
    new = F.coalesce(F.col("pos") - F.lag("pos").over(w) > gap, F.lit(False)).cast("int")
    runs = on.withColumn("new", new).withColumn("island", F.sum("new").over(w))
    return runs.groupBy("rec", "island").agg(F.min("pos").alias("first"), F.max("pos").alias("last")).where(F.col("last") - F.col("first") >= least).select("rec", "island", "first", "last")


def valley(pixels: DataFrame, height: int) -> DataFrame:
    """The first place of least ink in the middle 30 to 70 %."""
    middle = pixels.where(F.col("pos").between(int(0.30 * height), int(0.70 * height) - 1))
    return middle.groupBy("rec").agg(F.min_by("pos", F.struct("v", "pos")).alias("valley"))


def quad_extent(corners: DataFrame) -> DataFrame:
    """Extent and centre of each record's corners (rec, x, y)."""
    return corners.groupBy("rec").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))


def best_quad(quads: DataFrame) -> DataFrame:
    """The best of each record's quads (rec, quad_ord, w, h, area, canvas_w, canvas_h): shape A before B among equals."""
    canvas = F.col("canvas_w") * F.col("canvas_h")
    fits = (F.col("area") < canvas * 0.96) & (F.col("area") >= canvas * 0.22)
    long, short = F.greatest("w", "h"), F.least("w", "h")
    a = F.when((F.col("w") >= 0.45 * F.col("canvas_w")) & (F.col("h") >= 0.40 * F.col("canvas_h")), geometry.quad_score(F.col("w"), F.col("h"), F.col("area"), canvas, 0.70, 0.40))
    b = F.when((long >= 0.45 * F.col("canvas_w")) & (short >= 0.35 * F.col("canvas_h")), geometry.quad_score(F.col("w"), F.col("h"), F.col("area"), canvas, 0.65, 0.35))
    shapes = F.explode(F.array(F.struct(F.lit("A").alias("shape"), a.alias("score")), F.struct(F.lit("B").alias("shape"), b.alias("score"))))
    scored = quads.where(fits).select("rec", "quad_ord", shapes.alias("s")).select("rec", "quad_ord", "s.shape", F.round("s.score", 9).alias("score")).where("score > 0")
    first = Window.partitionBy("rec").orderBy(F.desc("score"), "quad_ord", "shape")
    return scored.withColumn("__rank", F.row_number().over(first)).where("__rank = 1").drop("__rank")


def evaluation(rows: DataFrame, total: int | None = None) -> DataFrame:
    """Of each field: records in which it was found, their share in %, mean confidence and mean real overlap.

    ``rows``: rec, field, confidence and the boxes found (x, y, w, h) and true (tx, ty, tw, th).
    """
    overlap = geometry.iou(*(F.col(c) for c in ("x", "y", "w", "h", "tx", "ty", "tw", "th")))
    # records first, so that one shuffle by rec serves the distinct counts of fields and of all records
    sums = {"confidence": F.col("confidence"), "iou": overlap}
    each = rows.groupBy("rec", "field").agg(*(f(c).alias(f"{f.__name__}_{k}") for k, c in sums.items() for f in (F.sum, F.count)))
    first = (F.row_number().over(Window.partitionBy("rec").orderBy("field")) == 1).cast("long")
    per = each.withColumn("first", first).groupBy("field").agg(F.count("*").alias("detected"), *(F.sum(c).alias(c) for c in ("first", *(f"{f}_{k}" for k in sums for f in ("sum", "count")))))
    n = F.sum("first").over(Window.partitionBy()) if total is None else F.lit(total)  # over a row for each field
    mean = lambda k: F.try_divide(f"sum_{k}", f"count_{k}").alias(f"mean_{k}")
    return per.select("field", "detected", (F.col("detected") * 100.0 / n).alias("recall"), mean("confidence"), mean("iou"))
