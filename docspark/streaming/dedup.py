"""Ingest of uploads as a stream: each content once while it is remembered, each batch written once.

The key is a hash of the content. Spark keeps it as keyed state until the
watermark (the newest event time of the batches before, less ``delay``) has
passed the event time of the row that came first by ``delay``; a repeat that
comes later than that is news again. Rows at or behind the watermark are late
and dropped, whatever their content. State lies in Spark's state store below
the checkpoint and its size follows what came within the delay, not the stream.

A batch is written as a folder of its number by ``foreachBatch``; a batch that
runs again after a failure has the same number and rows and replaces its folder,
so a restart from the checkpoint neither loses nor repeats a row.

Defined results: rows without an event time are left out, as no watermark can
pass them; null contents are one content of their own; rows of one content
within a batch count once, whichever the shuffle brings first, so rows of the
same content should carry the same columns; an empty stream writes no batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docspark.sinks import shared


def keyed(rows: DataFrame, content: Column, event_time: Column) -> DataFrame:
    """With content_sha256 and event_time; rows without an event time are left out."""
    return rows.withColumns({"content_sha256": F.sha2(content.cast("binary"), 256), "event_time": event_time.cast("timestamp")}).where("event_time IS NOT NULL")


def fresh(rows: DataFrame, delay: str) -> DataFrame:
    """The first row of each content within the delay, of those that are not late."""
    return rows.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["content_sha256"])


def write_batch(path: str):
    """Writes a batch as the folder of its number; again, if it runs again."""

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def ingest(rows: DataFrame, path: str, checkpoint: str, write=None) -> StreamingQuery:
    """All there is now, from where the checkpoint left off."""
    sink = rows.writeStream.foreachBatch(write or write_batch(path))
    return sink.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(spark: SparkSession, path: str, schema) -> DataFrame:
    """What was written, with the number of its batch."""
    batches = [f"{path}/{n}" for n in shared.names(spark, path) if shared.exists(spark, f"{path}/{n}/_SUCCESS")]
    if not batches:
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(0))
    return spark.read.schema(schema).option("basePath", path).parquet(*batches).withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), r"/batch=(\d+)/", 1).cast("int"))
