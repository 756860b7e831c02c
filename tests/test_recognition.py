"""Recognition with stand-in engines, variants and a whole document from pixels to record."""

import numpy as np
from pyspark.sql import functions as F

from docspark import dims
from docspark.operators import candidates
from docspark.sources import uploads
from docspark.vision import image as im
from docspark.vision import recognize, variants


class Lines:
    def lines(self, image):
        return [("b", 0.8, 10, 5), (" a ", 0.6, 90, 8), ("", 1.0, 0, 0)]


class Reader:
    def read(self, image):
        if image.shape[0] < 20:
            raise RuntimeError("too small")
        return f"w{image.shape[0]}", 0.5


def test_variants_follow_the_catalog():
    crop = im.drawn_card()[160:190, 380:800]
    for kind, names in dims.VARIANTS.items():
        made = variants.of(crop, kind)
        assert list(made) == names and all(v.shape[0] >= variants.LEAST.get(kind, 30) and v.dtype == np.uint8 for v in made.values())
        small = variants.of(crop[:1, :1], kind)
        assert all(v.size for v in small.values())
    assert variants.preprocessor("address", "x") == "text" and variants.preprocessor("x", "numeric") == "digits" and variants.preprocessor("x", "y") == "text"
    assert set(np.unique(variants.of(crop, "serial")["otsu_thresh"])) <= {0, 255}


def test_filters_by_plain_rules():
    g = np.random.default_rng(4).integers(0, 256, (19, 23)).astype(np.uint8)
    p = np.pad(g.astype(int), 1, mode="reflect")
    want = [[min(255, max(0, 5 * p[y, x] - p[y - 1, x] - p[y + 1, x] - p[y, x - 1] - p[y, x + 1])) for x in range(1, 24)] for y in range(1, 20)]
    assert variants.crisp(g).tolist() == want
    # a patch at a time, pixel by pixel
    q = np.pad(g.astype(float), 3, mode="reflect")
    y, x, part = 9, 11, lambda a, b: q[a - 1 : a + 2, b - 1 : b + 2]
    weights = {(a, b): np.exp(-((part(y + 3, x + 3) - part(a + 3, b + 3)) ** 2).mean() / 900) for a in range(y - 2, y + 3) for b in range(x - 2, x + 3)}
    mean = sum(w * q[a + 3, b + 3] for (a, b), w in weights.items()) / sum(weights.values())
    assert abs(int(variants.denoised(g, 30.0, 3, 5)[y, x]) - mean) <= 0.5
    flat = np.full((40, 60), 90, np.uint8)
    assert (variants.denoised(flat) == 90).all() and (variants.blurred(flat, 2.0).round(6) == 90).all()


def test_local_equalization():
    dim = np.random.default_rng(5).integers(100, 131, (64, 96)).astype(np.uint8)
    soft, hard = variants.locally_equalized(dim, 2.0), variants.locally_equalized(dim, 40.0)
    assert np.ptp(dim) < np.ptp(soft) < np.ptp(hard) and np.ptp(hard) > 200
    # in the middle of a tile of odd size, its own map alone counts
    odd = np.random.default_rng(6).integers(0, 256, (8 * 5, 8 * 7)).astype(np.uint8)
    tile, got = odd[10:15, 14:21], variants.locally_equalized(odd, 1000.0)
    assert got[12, 17] == round((tile <= odd[12, 17]).sum() * 255 / 35)


def test_engines():
    image = np.full((60, 200, 3), 255, np.uint8)
    assert recognize.candidates(Lines(), image) == [("a b", 0.7, "paddleocr_multiline"), ("a", 0.6, "paddleocr"), ("b", 0.8, "paddleocr")]
    image[10:22], image[40:52] = 0, 0
    assert 22 <= recognize.valley(im.gray(image)) < 40
    kinds = [k for _, _, k in recognize.candidates(Reader(), image)]
    assert kinds == ["paddleocr_segmented", "paddleocr"]
    assert recognize.candidates(Reader(), image[:10]) == [] and recognize.candidates(Lines(), image[:0]) == []
    assert recognize.available(Lines) == (True, None)
    assert recognize.available(lambda: 1 / 0) == (False, "division by zero")


def test_from_crops_to_the_best_candidate(spark):
    crop = im.encode(im.drawn_card()[160:230, 380:800])
    crops = spark.createDataFrame([(1, "name", "arabic_text", crop), (2, "national_id", "numeric", crop), (3, "name", "arabic_text", b"no image")], "rec long, field string, field_type string, content binary")

    def make():  # made in the worker, which cannot import this file
        class Found:
            def lines(self, image):
                return [("b", 0.8, 10, 5), (" a ", 0.6, 90, 8), ("", 1.0, 0, 0)]

        return Found()

    found = recognize.recognized(crops, make, "lines")
    assert {r["rec"]: r["count"] for r in found.groupBy("rec").count().collect()} == {1: 15, 2: 12}
    best = {r["rec"]: (r["text"], r["variant_ord"], r["cand_ord"]) for r in candidates.best(found, F.current_date()).collect()}
    assert best == {1: ("a b", 0, 0), 2: ("b", 0, 2)}


def bars():
    crop = np.full((40, 120, 3), 255, np.uint8)
    crop[:, ::4], crop[:, 1::4] = 0, 0
    return crop


class Codes:
    def __init__(self, *found):
        self.found = found

    def decode(self, image):
        if not self.found:
            raise RuntimeError("broken")
        return [f for f in self.found if f]


def test_barcode():
    assert recognize.barcode(Codes((b"12", "CODE128")), np.full((9, 9, 3), 255, np.uint8)) == ("barcode_not_detected", None, None)
    assert recognize.barcode(None, bars()) == recognize.barcode(Codes(), bars()) == ("barcode_detected", None, None)
    assert recognize.barcode(Codes(None), bars()) == ("barcode_not_decoded", None, None)
    assert recognize.barcode(Codes((b"12\xff", "CODE128"), ("3", "QR")), bars()) == ("barcode_decoded", "12\ufffd", "CODE128")
    assert recognize.barcode(Codes(), None)[0] == "barcode_not_detected"


def test_barcodes_of_crops(spark):
    crops = spark.createDataFrame([("a", "barcode", im.encode(bars())), ("b", "barcode", b"no image"), ("c", "barcode", None)], "rec string, field string, content binary")

    def make():  # made in the worker, which cannot import this file
        class Reader:
            def decode(self, image):
                return [(b"77", "CODE128")]

        return Reader()

    def broken():
        raise ImportError("no such library")

    read = lambda m, k: {r["rec"]: (r["status"], r["payload"]) for r in recognize.barcodes(crops, m, k).collect()}
    none = ("barcode_not_detected", None)
    assert read(make, "made") == {"a": ("barcode_decoded", "77"), "b": none, "c": none}
    assert read(broken, "broken") == read(None, "none") == {"a": ("barcode_detected", None), "b": none, "c": none}
    assert recognize.barcodes(crops.limit(0), make, "made").count() == 0


def test_newest_file(spark, tmp_path):
    import os

    for k, name in enumerate(("a.pt", "b.pt", "c.txt")):
        (tmp_path / name).write_text("x")
        os.utime(tmp_path / name, (1_700_000_000 + k, 1_700_000_000 + k))
    assert uploads.newest(spark, str(tmp_path), "*.pt").first()["path"].endswith("b.pt")
