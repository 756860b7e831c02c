"""Boxes, quads, crops and scales as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark import dims


def resize_scale(w: Column, h: Column, most: float = dims.PROCESSING_MAX_DIM) -> Column:
    """Longest side to ``most``, enlarging four times at the utmost."""
    return F.least(F.lit(float(most)) / F.greatest(w, h), F.lit(4.0))


def resize_plan(w: Column, h: Column) -> Column:
    s = resize_scale(w, h)
    return F.struct(s.alias("scale"), F.bround(w * s, 0).cast("int").alias("new_w"), F.bround(h * s, 0).cast("int").alias("new_h"))


def to_original(x: Column, scale: Column, pad: Column) -> Column:
    return (x - pad) / scale


def to_processing(x: Column, scale: Column, pad: Column) -> Column:
    return x * scale + pad


def to_canonical(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Fractions of the card to its pixels."""
    return F.struct((x * dims.CANONICAL_WIDTH).alias("x"), (y * dims.CANONICAL_HEIGHT).alias("y"), (w * dims.CANONICAL_WIDTH).alias("w"), (h * dims.CANONICAL_HEIGHT).alias("h"))


def to_normalized(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct((x / dims.CANONICAL_WIDTH).alias("x"), (y / dims.CANONICAL_HEIGHT).alias("y"), (w / dims.CANONICAL_WIDTH).alias("w"), (h / dims.CANONICAL_HEIGHT).alias("h"))


def iou(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    zero = F.lit(0.0)
    w = F.greatest(zero, F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    h = F.greatest(zero, F.least(ay + ah, by + bh) - F.greatest(ay, by))
    union = aw * ah + bw * bh - w * h
    return F.when(union > 0, w * h / union).otherwise(zero)


def box_to_polygon(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    """Centre form to eight numbers, clamped to the unit square."""
    x0, y0 = F.greatest(F.lit(0.0), cx - w / 2), F.greatest(F.lit(0.0), cy - h / 2)
    x1, y1 = F.least(F.lit(1.0), cx + w / 2), F.least(F.lit(1.0), cy + h / 2)
    return F.array(x0, y0, x1, y0, x1, y1, x0, y1)


def quad_score(w: Column, h: Column, area: Column, canvas: Column, by_aspect: float, most_off: float, aspect: float = 85.60 / 53.98) -> Column:
    """Null where the shape is too far from a card."""
    off = F.abs(F.greatest(w, h) / F.greatest(F.least(w, h), F.lit(1e-6)) - aspect) / aspect
    score = by_aspect * F.greatest(F.lit(0.0), 1 - off) + (1 - by_aspect) * F.least(area / (canvas * 0.65), F.lit(1.0))
    return F.when(off < most_off, score)


def quad_margin(x0: Column, y0: Column, x1: Column, y1: Column, area: Column, width: Column, height: Column) -> Column:
    """A quad that nearly fills the content gives way to the content; another grows by 2.5 % and is clipped."""
    zero, w, h = F.lit(0.0), F.greatest(F.lit(1.0), width), F.greatest(F.lit(1.0), height)
    margin = F.least(F.greatest(zero, x0 / w), F.greatest(zero, (width - x1) / w), F.greatest(zero, y0 / h), F.greatest(zero, (height - y1) / h))
    close = (margin < 0.04) & (area > w * h * 0.65)
    grown = lambda v, c, top: F.least(F.greatest(c + 1.025 * (v - c), zero), top)
    cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
    return F.struct(
        close.alias("is_content"),
        F.when(close, zero).otherwise(grown(x0, cx, width)).alias("x0"),
        F.when(close, zero).otherwise(grown(y0, cy, height)).alias("y0"),
        F.when(close, width).otherwise(grown(x1, cx, width)).alias("x1"),
        F.when(close, height).otherwise(grown(y1, cy, height)).alias("y1"),
    )


def side(photo: Column, barcode: Column) -> Column:
    front, back = photo - 0.3 * barcode, barcode - 0.3 * photo
    unknown = (front < 0.12) & (back < 0.12)
    name = F.when(unknown, "unknown").when(front >= back, "front").otherwise("back")
    return F.struct(name.alias("side"), F.when(unknown, 0.0).otherwise(F.least(F.greatest(front, back) + 0.5, F.lit(0.98))).alias("confidence"))


def crop_map(left: Column, top: Column, right: Column, bottom: Column, view_w: Column, view_h: Column, image_w: Column, image_h: Column) -> Column:
    """A rectangle of a view that an image fills from its centre, in pixels of the image."""
    scale = F.greatest(view_w / image_w, view_h / image_h)
    dx, dy = (image_w * scale - view_w) / 2, (image_h * scale - view_h) / 2
    put = lambda v, d, most: F.least(F.greatest(F.floor((v + d) / scale + 0.5), F.lit(0)), most)
    return F.struct(put(left, dx, image_w).alias("left"), put(top, dy, image_h).alias("top"), put(right, dx, image_w).alias("right"), put(bottom, dy, image_h).alias("bottom"))


def quality_issues(blur: Column, brightness: Column, contrast: Column, glare: Column) -> Column:
    found = [(blur < dims.BLUR_MIN, "image_is_blurry"), (brightness < 40, "image_too_dark"), (brightness > 230, "image_too_bright_or_overexposed"), (glare > 0.08, "possible_glare"), (contrast < 15, "low_contrast")]
    return F.filter(F.array(*[F.when(c, n) for c, n in found]), lambda x: x.isNotNull())


def quality_status(issues: Column) -> Column:
    n = F.size(issues)
    return F.when(n == 0, "good").when(n == 1, "acceptable").otherwise("poor")


def persisted_quality(status: Column) -> Column:
    """The stored vocabulary of capture quality."""
    return F.when(status == "good", "GOOD").when(status == "acceptable", "BORDERLINE").when(status == "poor", "BAD")
