"""Segmentation labels: lines of a class and a box or a polygon."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions.geometry import box_to_polygon
from docspark.functions.text import tokens


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """path and line of every label file below a folder."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(folder)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def parsed(lines: DataFrame) -> DataFrame:
    """With cls, n (parts of the line) and polygon: five parts are a box, seven and more a polygon, others no label."""
    rows = lines.withColumn("w", tokens(F.col("line"))).withColumn("n", F.size("w")).where("n = 5 OR n >= 7")
    numbers = F.transform(F.slice("w", 2, 1 << 20), lambda x: x.cast("double"))
    rows = rows.withColumn("f", numbers)
    box = box_to_polygon(*(F.try_element_at("f", F.lit(i)) for i in (1, 2, 3, 4)))
    return rows.withColumn("cls", F.element_at("w", 1).cast("int")).withColumn("polygon", F.when(F.col("n") == 5, box).otherwise(F.col("f"))).drop("w", "f", "line")


def paired(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Images with the first label of their stem; those without one are left out."""
    return images.join(labels.groupBy("stem").agg(F.min("label").alias("label")), "stem").select("rec", "stem", "label")


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """A training log, a row for each epoch, its names trimmed."""
    rows = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return rows.toDF(*[c.strip() for c in rows.columns])
