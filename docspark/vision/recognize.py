"""Text recognition behind an interface: any engine, one for each worker, over all variants of a crop.

An engine has ``lines(image)``, giving (text, confidence, x, y) of the lines it
finds, or ``read(image)``, giving (text, confidence) of one line, or both. The
engine's maker is called in the worker; what it loads stays there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docspark.vision import image as im
from docspark.vision import variants

CANDIDATES = "field string, field_type string, variant_ord int, variant string, cand_ord int, text string, confidence double, engine string"
_ENGINES: dict[Any, Any] = {}


def available(make: Callable[[], Any]) -> tuple[bool, str | None]:
    """Whether an engine can be made here, and else why not; asked once, on the driver."""
    try:
        make()
    except Exception as e:  # whatever an optional engine raises means that it is not there
        return False, str(e)
    return True, None


def engine(make: Callable[[], Any], key: str) -> Any:
    if key not in _ENGINES:
        _ENGINES[key] = make()
    return _ENGINES[key]


def valley(g: np.ndarray) -> int:
    """The row of least ink between two lines: in the middle 30 to 70 %, 15 rows from the edges; else the middle."""
    h = g.shape[0]
    low, high = int(0.30 * h), int(0.70 * h)
    if h < 40 or high <= low:
        return h // 2
    rows = (g <= im.otsu(g)).sum(axis=1)
    at = low + int(rows[low:high].argmin())
    return at if 15 <= at <= h - 15 else h // 2


def _one(e: Any, image: np.ndarray) -> tuple[str, float]:
    try:
        text, confidence = e.read(image)
        return (text or "").strip(), float(confidence)
    except Exception:  # an engine that fails on a crop has read nothing there
        return "", 0.0


def candidates(e: Any, image: np.ndarray) -> list[tuple[str, float, str]]:
    """(text, confidence, kind) of one image: all lines in one and each line; else two halves, and the whole."""
    if not image.size:
        return []
    if hasattr(e, "lines"):
        try:
            found = [(t.strip(), float(c), x, y) for t, c, x, y in e.lines(image) if t and t.strip()]
        except Exception:
            found = []
        if found:
            found.sort(key=lambda f: (f[3] // 20, -f[2]))
            whole = [(" ".join(f[0] for f in found), float(np.mean([f[1] for f in found])), "paddleocr_multiline")] if len(found) > 1 else []
            return whole + [(t, c, "paddleocr") for t, c, _, _ in found]
    out = []
    if hasattr(e, "read"):
        h, w = image.shape[:2]
        if h >= 36 and w / h < 8.0:
            cut = valley(im.gray(image))
            (a, p), (b, q) = _one(e, image[:cut]), _one(e, image[cut:])
            if a and b:
                out.append((f"{a} {b}", (p + q) / 2, "paddleocr_segmented"))
        text, confidence = _one(e, image)
        if text:
            out.append((text, confidence, "paddleocr"))
    return out


def recognized(crops: DataFrame, make: Callable[[], Any], key: str = "default") -> DataFrame:
    """Candidates of all variants of each crop (rec, field, field_type, content as an encoded image)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = engine(make, key)
        types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.string()]
        for batch in batches:
            rows = []
            for rec, field, kind, raw in zip(*(batch.column(c).to_pylist() for c in ("rec", "field", "field_type", "content")), strict=True):
                crop = im.decode(raw)
                for v, (name, image) in enumerate(variants.of(crop, variants.preprocessor(field, kind)).items()) if crop is not None else ():
                    rows += [(rec, field, kind, v, name, c, *found) for c, found in enumerate(candidates(e, image))]
            if rows:
                names = ["rec", *(c.split()[0] for c in CANDIDATES.split(", "))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [batch.column("rec").type, *types], strict=True)], names=names)

    crops = crops.select("rec", "field", "field_type", "content")
    return crops.mapInArrow(run, f"rec {crops.schema['rec'].dataType.simpleString()}, {CANDIDATES}")


BARCODES = "field string, status string, payload string, symbology string"


def barcode(reader: Any | None, crop: np.ndarray | None) -> tuple[str, str | None, str | None]:
    """Status, payload and symbology of a crop; nothing is said to be in it that the reader did not find."""
    if not im.barcode_present(crop):
        return "barcode_not_detected", None, None
    try:
        found = list(reader.decode(crop)) if reader is not None else None
    except Exception:  # a reader that fails leaves the code as seen, not read
        found = None
    if found is None:
        return "barcode_detected", None, None
    if not found or found[0][0] is None:
        return "barcode_not_decoded", None, None
    payload, symbology = found[0]
    return "barcode_decoded", payload.decode("utf-8", "replace") if isinstance(payload, bytes) else str(payload), symbology


def barcodes(crops: DataFrame, make: Callable[[], Any] | None = None, key: str = "default") -> DataFrame:
    """status, payload and symbology of each crop (rec, field, content).

    ``make`` makes a reader with ``decode(image)``, giving (payload, symbology) of
    each code, in each worker; without one, or where it cannot be made, codes are
    seen but not read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            reader = engine(make, f"barcode {key}") if make else None
        except Exception:
            reader = None
        for batch in batches:
            read = [barcode(reader, im.decode(raw)) for raw in batch.column("content").to_pylist()]
            columns = [pa.array(c, pa.string()) for c in zip(*read, strict=True)] if read else [pa.array([], pa.string())] * 3
            yield pa.RecordBatch.from_arrays([batch.column("rec"), batch.column("field"), *columns], names=["rec", *(c.split()[0] for c in BARCODES.split(", "))])

    crops = crops.select("rec", "field", "content")
    return crops.mapInArrow(run, f"rec {crops.schema['rec'].dataType.simpleString()}, {BARCODES}")
