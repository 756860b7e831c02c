"""Pictures from files and from bytes, localization at two scales, and images to records."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.operators import review
from docspark.sources import uploads
from docspark.vision import frames
from docspark.vision import image as im
from docspark.vision.process import NO_SIDE, process


def png(pixels, kind, palette=None):
    """A PNG of these samples whose lines take the five filters in turn."""
    h, w, planes = pixels.shape
    out, above = b"", np.zeros((w, planes), np.int64)
    for y in range(h):
        line, f = pixels[y].astype(np.int64), y % 5
        left, corner = np.vstack([np.zeros((1, planes), np.int64), line[:-1]]), np.vstack([np.zeros((1, planes), np.int64), above[:-1]])
        p = left + above - corner
        a, b, c = abs(p - left), abs(p - above), abs(p - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
        out += bytes([f]) + ((line - (0 * line, left, above, (left + above) // 2, paeth)[f]) & 255).astype(np.uint8).tobytes()
        above = line
    part = lambda k, d: len(d).to_bytes(4, "big") + k + d + zlib.crc32(k + d).to_bytes(4, "big")
    head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, kind, 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + (part(b"PLTE", palette.tobytes()) if palette is not None else b"") + part(b"IDAT", zlib.compress(out)) + part(b"IEND", b"")


@pytest.mark.parametrize(("kind", "planes"), [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_png(kind, planes):
    pixels = np.random.default_rng(kind).integers(0, 256, (12, 9, planes)).astype(np.uint8)
    raw = png(pixels, kind)
    want = pixels[:, :, 2::-1] if planes > 2 else np.repeat(pixels[:, :, :1], 3, axis=2)
    assert (im.decode(raw) == want).all()
    assert im.decode(raw[:60]) is None and im.decode(raw[:8]) is None


def test_png_with_palette():
    rng = np.random.default_rng(1)
    palette, pixels = rng.integers(0, 256, (7, 3)).astype(np.uint8), rng.integers(0, 7, (6, 5, 1)).astype(np.uint8)
    assert (im.decode(png(pixels, 3, palette)) == palette[pixels[:, :, 0]][:, :, ::-1]).all()


def test_pictures_of_a_folder(spark, tmp_path):
    pixels = np.random.default_rng(2).integers(0, 256, (20, 30, 3)).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(png(pixels, 2))
    (tmp_path / "broken.jpg").write_bytes(b"no image")
    (tmp_path / "note.txt").write_text("x")
    jvm = spark._jvm
    shot = jvm.java.awt.image.BufferedImage(40, 24, 5)
    for x in range(40):
        for y in range(24):
            shot.setRGB(x, y, 0x2060C0)
    assert jvm.javax.imageio.ImageIO.write(shot, "jpg", jvm.java.io.File(str(tmp_path / "b.JPG")))
    got = {r["path"].rsplit("/", 1)[1]: r["content"] for r in uploads.pictures(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.png", "b.JPG", "broken.jpg"} and got["broken.jpg"] is None
    assert (im.decode(bytes(got["a.png"])) == pixels[:, :, ::-1]).all()
    jpeg = im.decode(bytes(got["b.JPG"]))
    assert jpeg.shape == (24, 40, 3) and np.abs(jpeg.astype(int) - [0xC0, 0x60, 0x20]).max() < 8


@pytest.mark.parametrize(("size", "name", "address", "number"), [((428, 270), (383, 111), (562, 73), (741, 141)), ((1600, 1009), (333, 79), (411, 224), (743, 141))])
def test_localization_at_two_scales(size, name, address, number):
    boxes = {f: (x, y, w, h, c) for f, x, y, w, h, c in im.localize(frames.card(im.drawn_card(*size, 3)))}
    assert boxes["photo"] == (48, 50, 448, 626, 0.98)
    assert boxes["date_of_birth"] == (48, 686, 512, 171, 0.95) and boxes["serial_number"] == (48, 857, 512, 131, 0.95)
    assert boxes["name"] == (528, name[0], 1040, name[1], 0.95) and boxes["address"] == (528, address[0], 1040, address[1], 0.95)
    assert boxes["national_id"] == (528, number[0], 1040, number[1], 0.95)
    assert int(0.71 * 1009) <= number[0] and int(0.86 * 1009) <= sum(number) <= int(0.88 * 1009)


def test_a_blank_card_has_the_usual_strip():
    assert im.number_strip(np.full((1009, 1600, 3), 0, np.uint8))[2] in (0.85, 0.95)
    assert im.number_strip(np.zeros((1, 1, 3), np.uint8))[2] == 0.75


def test_process_without_a_recognizer(spark):
    images = [("a", im.encode(im.drawn_card(428, 270, 1))), ("b", im.encode(np.full((200, 300, 3), 255, np.uint8))), ("c", b"x"), ("d", None)]
    frame = spark.createDataFrame(images, "path string, content binary")

    def fails():
        raise RuntimeError("no model")

    for localizer in (None, fails):
        got = {r["path"]: r for r in process(frame, F.lit("2026-01-01").cast("date"), localizer=localizer, key=str(localizer)).collect()}
        assert len(got) == 4 and got["c"]["errors"] == got["d"]["errors"] == ["unreadable image"]
        assert got["b"]["errors"] == [NO_SIDE] and got["b"]["needs_review"] is None
        assert got["a"]["errors"] == [] and got["a"]["side"] == "front" and got["a"]["national_id"] is None
        assert got["a"]["needs_review"]["national_id"] and got["a"]["confidence"]["field_detection"]["photo"] == 0.98
    assert {r["side"] for r in process(frame, F.lit("2026-01-01").cast("date"), force_side="back").collect()} == {"back", None}


def test_a_localizer_takes_precedence(spark):
    def make():
        class Model:
            def boxes(self, card):
                return [("name", 600, 300, 500, 90, 0.7), ("name", 610, 310, 500, 90, 0.8)]

        return Model()

    frame = spark.createDataFrame([("a", im.encode(im.drawn_card(428, 270, 1)))], "path string, content binary")
    got = {r["cls"]: (r["x"], r["y"], r["confidence"]) for r in frames.localized(frame, make, "model").collect()}
    assert got["name"] == (610, 310, 0.8) and got["photo"][2] == 0.98


def test_only_two_actions(spark):
    state = spark.createDataFrame([(i, "PENDING") for i in range(6)], "id long, review_status string")
    asked = [(1, 0, None, None), (2, 1, None, "why"), (3, 2, "other", "why"), (4, 3, "reject", None), (5, 4, "reject", "why"), (6, 5, "approve", None), (7, 0, "approve", None)]
    got = {r["req"]: (r["status"], r["review_status"]) for r in review.transition(state, spark.createDataFrame(asked, "req long, id long, action string, decision_note string")).collect()}
    assert got == {1: (400, None), 2: (400, None), 3: (400, None), 4: (400, None), 5: (200, "REJECTED"), 6: (200, "ACCEPTED"), 7: (200, "ACCEPTED")}
