"""Training folders as a data source: what is written is read back, filters list less, what dies leaves nothing."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docspark.sources import labels, training

ROWS = "key long, split string, content binary, lines array<string>"


@pytest.fixture(scope="module")
def known(spark):
    training.register(spark)
    return spark


@pytest.fixture
def rows(known):
    given = [(i, "val" if i % 5 == 0 else "train", f"image {i}".encode(), [f"{i % 9} 0.5 0.5 0.1 0.1", " 1 0 0 1 0 1 1 0 1"] if i % 7 else None) for i in range(60)]
    return known.createDataFrame([*given, (None, "val", b"x", []), (100, None, b"x", []), (101, "train", None, [])], ROWS).repartition(4)


def save(rows, folder):
    rows.write.format(training.NAME).mode("append").save(str(folder))


def load(spark, folder):
    return spark.read.format(training.NAME).load(str(folder))


def test_round_trip(known, rows, tmp_path):
    save(rows, tmp_path / "set")
    want = rows.where("key IS NOT NULL AND split IS NOT NULL AND content IS NOT NULL").select("split", F.concat(F.lit("sample_"), "key").alias("name"), F.posexplode("lines").alias("n", "line")).select("split", "name", (F.col("n") + 1).alias("line_no"), "line")
    got = load(known, tmp_path / "set")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    images = sorted(p.name for p in (tmp_path / "set/images").rglob("*.ppm"))
    assert images == sorted(f"sample_{i}.ppm" for i in range(60)) and len(list((tmp_path / "set/labels").rglob("*.txt"))) == 60
    assert next((tmp_path / "set/images/val").rglob("sample_5.ppm")).read_bytes() == b"image 5"
    assert "names:" in (tmp_path / "set/data.yaml").read_text() and not list((tmp_path / "set/_staging").iterdir())
    # parsed as label lines are elsewhere
    assert labels.parsed(got.withColumn("rec", F.col("name"))).count() == want.count()


def test_filters_reach_the_listing(known, rows, tmp_path, monkeypatch):
    save(rows, tmp_path / "set")
    val = load(known, tmp_path / "set").where("split = 'val' AND line_no = 1")
    assert {r["split"] for r in val.collect()} == {"val"} and val.count() == len([i for i in range(0, 60, 5) if i % 7])
    reader = training.LabelReader({"path": str(tmp_path / "set")})
    rest = list(reader.pushFilters([training.EqualTo(("split",), "val"), training.EqualTo(("line_no",), 1)]))
    assert rest == [training.EqualTo(("line_no",), 1)]
    monkeypatch.setattr(training, "FILES", 5)
    parts = reader.partitions()
    assert {p.split for p in parts} == {"val"} and len(parts) == 3 and max(len(p.files) for p in parts) == 5
    assert list(training.LabelReader.pushFilters(reader, [training.In(("split",), ("train", "x"))])) == [] and [p.files for p in reader.partitions()] == [[]]


def test_a_task_that_dies_leaves_no_half(known, rows, tmp_path):
    save(rows.where("key < 10"), tmp_path / "set")
    before = sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*"))
    dies = F.when(F.col("key") == 55, F.raise_error(F.lit("lost"))).otherwise(F.col("content"))
    with pytest.raises(Exception, match="lost"):
        save(rows.where("key >= 10").withColumn("content", dies), tmp_path / "set")
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*")) == before


def test_more_is_added(known, rows, tmp_path):
    for low in (0, 30):
        save(rows.where(F.col("key").between(low, low + 29)), tmp_path / "set")
    assert load(known, tmp_path / "set").select("name").distinct().count() == len([i for i in range(60) if i % 7])


def test_empty_and_refused(known, rows, tmp_path):
    save(rows.limit(0), tmp_path / "none")
    assert load(known, tmp_path / "none").collect() == [] and Path(tmp_path / "none/data.yaml").exists()
    assert load(known, tmp_path / "nowhere").collect() == []
    with pytest.raises(Exception, match="missing: lines"):
        save(rows.drop("lines"), tmp_path / "none")
    with pytest.raises(Exception, match="only added to"):
        rows.write.format(training.NAME).mode("overwrite").save(str(tmp_path / "none"))
