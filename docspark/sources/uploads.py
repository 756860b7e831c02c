"""Images from folders and uploads, and the gates before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark import dims
from docspark.operators.ordering import numbered


def is_image(path: Column) -> Column:
    """By suffix, whatever its case."""
    return F.lower(path).rlike("(" + "|".join(s.replace(".", r"\.") for s in dims.IMAGE_SUFFIXES) + ")$")


def ordered(files: DataFrame) -> DataFrame:
    """With place: the lexical order of the paths."""
    return numbered(files, "path", "rec", name="place")


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """path and content of the images right in a folder; what cannot be read later is a row, not a failure."""
    files = spark.read.format("binaryFile").load(folder)
    return files.where(is_image(F.col("path"))).select("path", "length", "content")


def pictures(spark: SparkSession, folder: str) -> DataFrame:
    """path and content (plain pixels) of the images right in a folder, decoded by Spark: JPEG, PNG, BMP and GIF.

    One that cannot be decoded has null content.
    """
    read = spark.read.format("image").option("dropInvalid", "false").load(folder).select("image.*")
    head = F.encode(F.concat_ws("", F.lit("BGR"), F.col("nChannels").cast("string"), F.lit(" "), F.col("width").cast("string"), F.lit(" "), F.col("height").cast("string"), F.lit("\n")), "utf-8")
    return read.where(is_image(F.col("origin"))).select(F.col("origin").alias("path"), F.when((F.col("width") > 0) & (F.col("height") > 0), F.concat(head, "data")).alias("content"))


def gate(mime: Column, size: Column) -> Column:
    """415 for a kind that is not taken, 400 for no bytes, 413 for too many, else 200."""
    kind = F.coalesce(mime.isin(list(dims.UPLOAD_TYPES)), F.lit(False))
    return F.when(~kind, 415).when(F.coalesce(size, F.lit(0)) == 0, 400).when(size > dims.MAX_UPLOAD_BYTES, 413).otherwise(200)


def newest(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """The file of a pattern that was changed last (weights of a model, say)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "modificationTime").orderBy(F.desc("modificationTime"), "path").limit(1)
