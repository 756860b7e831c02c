"""Ingest as a stream: repeats within and after the delay, late rows, failures and restarts."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docspark.streaming import dedup

BEGAN = datetime(2024, 1, 1)
SCHEMA = "name string, content string, ts timestamp"


def hours(n):
    return BEGAN + timedelta(hours=n)


@pytest.fixture
def stream(spark, tmp_path):
    class Stream:
        path, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

        def put(self, *rows):
            spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

        def frames(self):
            rows = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
            return dedup.fresh(dedup.keyed(rows, F.col("content"), F.col("ts")), "10 hours")

        def run(self, write=None):
            dedup.ingest(self.frames(), self.path, self.checkpoint, write).awaitTermination()

        def names(self):
            return sorted(r["name"] for r in dedup.ingested(spark, self.path, self.frames().schema).collect())

    return Stream()


def test_repeats_and_late_rows(stream):
    stream.put(("a", "x", hours(0)), ("b", "y", hours(1)), ("no time", "z", None), ("null", None, hours(1)))
    stream.run()
    assert stream.names() == ["a", "b", "null"]
    stream.put(("a again", "x", hours(5)), ("null again", None, hours(2)), ("c", "w", hours(20)))
    stream.run()  # the watermark is still behind the first hours
    assert stream.names() == ["a", "b", "c", "null"]
    stream.put(("a later", "x", hours(21)), ("late", "new", hours(9)), ("in time", "newer", hours(11)))
    stream.run()  # now it stands at ten hours: x is forgotten, rows at or behind it are late
    assert stream.names() == ["a", "a later", "b", "c", "in time", "null"]
    stream.run()
    assert stream.names() == ["a", "a later", "b", "c", "in time", "null"]


def test_failure_in_the_middle_of_a_batch(spark, stream):
    """The writer dies after it has written; the batch runs again under its number."""
    stream.put(("a", "x", hours(0)), ("b", "y", hours(1)))
    stream.run()
    stream.put(("a again", "x", hours(2)), ("c", "z", hours(3)))
    seen = []

    def dies(batch, number):
        dedup.write_batch(stream.path)(batch, number)
        seen.append(number)
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        stream.run(dies)
    stream.run()
    assert seen and stream.names() == ["a", "b", "c"]
    rows = dedup.ingested(spark, stream.path, stream.frames().schema).collect()
    assert {r["batch"] for r in rows if r["name"] == "c"} == set(seen)


def test_a_batch_without_success_is_not_read(spark, stream):
    stream.put(("a", "x", hours(0)))
    stream.run()
    spark.createDataFrame([("half", "q", hours(0), "h", hours(0))], "name string, content string, ts timestamp, content_sha256 string, event_time timestamp").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{stream.path}/batch=99")
    assert stream.names() == ["a"]


def test_empty(spark, stream):
    stream.put(("no time", "z", None))
    stream.run()
    assert stream.names() == []
