"""A folder of new images as a stream that ends when all there is has been read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docspark.sources import uploads

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def incoming(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.readStream.format("binaryFile").schema(SCHEMA).load(folder)
    return files.where(uploads.is_image(F.col("path"))).select("path", "length", "content")


def ingest(frames: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what is new; the checkpoint keeps each file from being read twice."""
    return frames.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
