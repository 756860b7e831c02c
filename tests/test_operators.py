"""Ties, precedence, decisions, sources, sinks and pixels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from docspark import dims, sinks, sql
from docspark.operators import candidates, detections, ordering, record, review, signals
from docspark.sources import labels, settings, uploads
from docspark.streaming import folder
from docspark.vision import image as im

CAND = "rec long, field string, field_type string, variant_ord int, cand_ord int, text string, confidence double, engine string"


@pytest.mark.parametrize("parts", [1, 7])
def test_first_of_equals_wins(spark, parts):
    rows = [(r, "name", "arabic_text", v, c, "ab", 0.5, "e") for r in range(20) for v in (1, 0) for c in (2, 1)]
    best = candidates.best(spark.createDataFrame(rows, CAND).repartition(parts), F.current_date()).collect()
    assert len(best) == 20 and {(b["variant_ord"], b["cand_ord"]) for b in best} == {(0, 1)}


def test_lines_join_in_reading_order(spark):
    rows = [(1, "name", 0, 1, " b ", 0.8, 10.0, 5.0), (1, "name", 0, 2, "a", 0.6, 90.0, 8.0), (1, "name", 0, 3, "c", 0.7, 50.0, 45.0), (1, "name", 0, 4, " ", 0.9, 1.0, 1.0), (2, "name", 0, 1, "x", 0.4, 0.0, 0.0)]
    got = candidates.combine_lines(spark.createDataFrame(rows, "rec long, field string, variant_ord int, line_id int, text string, confidence double, x double, y double")).collect()
    assert [(r["text"], round(r["confidence"], 6)) for r in got if r["cand_ord"] == 0] == [("a b c", 0.7)]
    assert {(r["rec"], r["text"]) for r in got if r["cand_ord"]} == {(1, "a"), (1, "b"), (1, "c"), (2, "x")}


def test_found_boxes_come_before_anchors(spark):
    kind = "rec long, cls string, confidence double, x int, y int, w int, h int"
    a = spark.createDataFrame([(1, "name", 0.9, 0, 0, 9, 9), (1, "photo", 0.9, 0, 0, 9, 9)], kind)
    b = spark.createDataFrame([(1, "name", None, 5, 5, 1, 1)], kind)
    got = {r["cls"]: (r["confidence"], r["x"], r["source"]) for r in detections.merge(a, b).collect()}
    assert got == {"name": (None, 5, "found"), "photo": (0.9, 0, "anchor")}


def test_overlaps_are_parted_in_turn(spark):
    kind = "rec long, cls string, confidence double, x int, y int, w int, h int"
    rows = [(1, "name", 0.9, 0, 100, 50, 60), (1, "address", 0.9, 0, 150, 50, 100), (1, "national_id", 0.9, 0, 240, 50, 40), (1, "gender", 0.9, 0, 0, 5, 5)]
    got = {r["cls"]: (r["y"], r["h"]) for r in detections.resolve_overlaps(spark.createDataFrame(rows, kind)).collect()}
    assert got == {"name": (100, 51), "address": (159, 82), "national_id": (249, 31), "gender": (0, 5)}


def test_review_decisions(spark):
    state = spark.createDataFrame([(1, "PENDING"), (2, "ACCEPTED"), (3, "PENDING")], "id long, review_status string")
    asked = spark.createDataFrame([(1, 1, "reject", " "), (2, 1, "approve", None), (3, 1, "approve", None), (4, 2, "reject", "x"), (5, 9, "approve", None), (6, 3, "reject", "blurred")], "req long, id long, action string, decision_note string")
    out = review.transition(state, asked)
    assert {r["req"]: (r["status"], r["review_status"]) for r in out.collect()} == {1: (400, None), 2: (200, "ACCEPTED"), 3: (409, None), 4: (409, None), 5: (404, None), 6: (200, "REJECTED")}
    once = review.applied(state, out)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, review.applied(once, out).collect())) == [(1, "ACCEPTED"), (2, "ACCEPTED"), (3, "REJECTED")]


def test_search_ignores_case_and_nulls(spark):
    state = spark.createDataFrame([(1, "Ann", None, None, "PENDING"), (2, None, "123", "Giza", "accepted"), (3, None, None, None, None)], "id long, full_name string, national_id string, governorate string, review_status string")
    ids = lambda q, s="ALL": {r["id"] for r in review.search(state, q, s).collect()}
    assert ids(" ANN ") == {1} and ids("") == {1, 2, 3} and ids("", "ACCEPTED") == {2} and ids("12") == {2} and ids("zz") == set()


def test_fields_without_crops_or_texts(spark):
    kind = "rec long, field string, field_type string, raw string, ocr_confidence double, localization_confidence double, crop_empty boolean, decoded boolean, has_candidate boolean"
    rows = [(1, "name", "arabic_text", "x", 0.9, None, True, False, True), (2, "name", "arabic_text", "x", 0.5, None, False, False, True), (3, "name", "arabic_text", None, 0.9, None, False, False, False), (4, "photo", "image_region", None, None, 0.9, False, False, False), (5, "barcode", "barcode", None, None, None, False, True, False)]
    got = {r["rec"]: (r["status"], r["issue"]) for r in record.read_fields(spark.createDataFrame(rows, kind)).collect()}
    assert got == {1: ("FAILED", "empty_crop"), 2: ("LOW_CONFIDENCE", None), 3: ("FAILED", "no_text_detected"), 4: ("DETECTED", "not_an_ocr_field"), 5: ("EXTRACTED", None)}


def test_islands_and_valley(spark):
    profile = [0, 5, 5, 0, 5, 5, 0, 0, 0, 5, 0, 0]
    rows = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(profile)], "rec long, pos int, v double")
    assert [(r["first"], r["last"]) for r in signals.islands(rows, 1.0, 2, 3).collect()] == [(1, 5)]
    assert signals.valley(rows, 12).first()["valley"] == 3


def test_numbered_rows(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).cast("string").alias("k"), "id")
    got = ordering.numbered(rows, "k", "id", parts=5).orderBy("place").collect()
    assert [r["k"] for r in got] == sorted(str(i * 7919 % 5003) for i in range(5000)) and [r["place"] for r in got] == list(range(1, 5001))
    assert ordering.numbered(rows.limit(0), "k").count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "a.PPM").write_bytes(b"x")
    (tmp_path / "b.JPG").write_bytes(b"12")
    (tmp_path / "c.txt").write_text("1 0.5 0.5 0.2 0.2\n2 0.1\n3 0 0 1 0 1 1 0 1\n")
    assert [r["path"].rsplit("/", 1)[-1] for r in uploads.scan(spark, str(tmp_path)).collect()] == ["b.JPG"]
    got = labels.parsed(labels.scan(spark, str(tmp_path))).orderBy("cls").collect()
    assert [(r["cls"], r["n"]) for r in got] == [(1, 5), (3, 9)]
    assert got[0]["polygon"] == pytest.approx([0.4, 0.4, 0.6, 0.4, 0.6, 0.6, 0.4, 0.6])
    (tmp_path / "log.csv").write_text(" epoch, loss\n1,0.5\n")
    assert labels.metrics(spark, str(tmp_path / "log.csv")).columns == ["epoch", "loss"]
    assert settings.jdbc_options({"MYSQL_USER": "u", "MYSQL_PASSWORD": "p", "MYSQL_PORT": "1"})["url"] == "jdbc:mysql://localhost:1/documents"
    for bad in ({}, {"MYSQL_USER": "u", "MYSQL_PASSWORD": "p", "MYSQL_PORT": "x"}):
        with pytest.raises(ValueError):
            settings.jdbc_options(bad)
    query = folder.ingest(folder.incoming(spark, str(tmp_path)), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, b"ab", "", "1999-02-31", None), (2, b"", "image/png", "1999-02-28", "x")], "id long, content binary, image_mime_type string, birth_date string, full_name string")
    got = {r["id"]: r for r in sinks.sink_projection(rows).collect()}
    assert got[1]["image_mime_type"] == "application/octet-stream" and got[1]["birth_date"] is None and str(got[2]["birth_date"]) == "1999-02-28"
    assert '"full_name":null' in got[1]["ocr_result"]
    sinks.append(rows, str(tmp_path / "s"))
    sinks.append(rows, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 4


def test_dataset_of_images_and_labels(spark, tmp_path):
    rows = [(i, f"image {i}".encode(), [f"{i % 9} 0.5 0.5 0.2 0.1", "8 0 0 1 0 1 1"]) for i in range(11)] + [(50, b"x", None), (51, None, ["0 0 0 1 1"]), (None, b"y", [])]
    table = spark.createDataFrame(rows, "key long, content binary, lines array<string>").withColumn("__split", F.lit(1))
    for _ in range(2):  # a second run puts the same files there
        got = {r["split"]: r["images"] for r in sinks.write_dataset(table, str(tmp_path / "set")).collect()}
        assert got == {"val": 4, "train": 8}
        files = sorted(p.relative_to(tmp_path / "set").as_posix() for p in (tmp_path / "set").rglob("*") if p.is_file())
        want = [f"{kind}/{'train' if k % 5 else 'val'}/sample_{k}.{end}" for kind, end in (("images", "ppm"), ("labels", "txt")) for k in [*range(11), 50]]
        assert files == sorted([*want, "data.yaml"])
    assert (tmp_path / "set/images/val/sample_5.ppm").read_bytes() == b"image 5" and (tmp_path / "set/labels/val/sample_50.txt").read_text() == ""
    assert "  3: gender\n" in (tmp_path / "set/data.yaml").read_text()
    read = labels.parsed(labels.scan(spark, str(tmp_path / "set/labels")))
    assert read.count() == 22 and read.select("cls").distinct().count() == 9
    assert sinks.write_dataset(table.limit(0), str(tmp_path / "none")).count() == 0


def test_sql_functions(spark):
    sql.register_all(spark)
    assert spark.sql("SELECT parse_serial('IJ٣٣٠٥٥٩٩')").first()[0] == "IJ٣٣٠٥٥٩٩"
    got = spark.sql("SELECT nid_check_digit('2990417170011'), normalize_numeric('٣-4'), parse_serial('ij 4086874'), two_pass('', ''), (SELECT count(*) FROM governorates)").first()
    assert tuple(got) == (1, "34", "IJ4086874", "AGREEMENT", 28)


def test_pixels():
    flat = np.full((60, 80, 3), 10, np.uint8)
    m = im.measures(flat)
    assert m["blur_score"] == 0 and m["brightness"] == 10 and m["contrast"] == 0
    for h, w in ((480, 640), (1080, 1920), (500, 500)):
        small, scale = im.normalize(np.zeros((h, w, 3), np.uint8))
        assert max(small.shape[:2]) == 1600 and small.shape[0] == round(h * scale)
    card = im.drawn_card()
    assert (im.decode(im.encode(card)) == card).all() and im.decode(b"P6 9 9 255\nxx") is None and im.decode(None) is None
    framed = np.full((700, 1100, 3), 255, np.uint8)
    framed[80:620, 120:976] = card
    assert im.content_quad(framed).tolist() == [[120, 80], [975, 80], [975, 619], [120, 619]]
    shuffled = im.content_quad(framed)[[2, 0, 3, 1]]
    assert im.order_corners(shuffled).tolist() == im.content_quad(framed).tolist()
    assert im.photo_score(card) > im.barcode_score(card)
    assert not im.barcode_present(flat) and im.barcode_present(np.tile(np.repeat(np.array([0, 255], np.uint8), 3), (40, 20))[:, :, None].repeat(3, axis=2))
    assert im.crop_issues(None) == ["empty_crop"] and im.crop_issues(flat[:10]) == ["crop_too_small", "crop_blurry"]


@pytest.mark.parametrize("scale", [0.5, 1.0, 2.0])
def test_fields_lie_below_the_header_at_any_scale(scale):
    card = im.resize(im.drawn_card(), 1600, 1009) if scale == 1.0 else im.resize(im.resize(im.drawn_card(), int(856 * scale), int(540 * scale)), 1600, 1009)
    found = {f[0]: f for f in im.localize(card)}
    assert set(found) == {"photo", "name", "address", "national_id", "date_of_birth", "serial_number"}
    assert found["name"][2] >= im.header_bottom(card) - 4 and found["name"][2] < found["address"][2] < found["national_id"][2]


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and df.columns[0] == "status"
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(dims.GOVERNORATES) == 28
