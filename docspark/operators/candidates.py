"""Text candidates of a field: reading order, combined lines, scores, the best one.

Windows and groups are by record and field, so they need one shuffle, which
what follows by record can reuse; every order is total, so results do not
depend on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import nid, parse
from docspark.functions.text import nonempty, normalize_numeric, tokens

GROUP = ("rec", "field", "variant_ord")


def reading_order(lines: DataFrame, band: int = 20) -> DataFrame:
    """line_ord from 1: bands of ``band`` pixels downwards, right to left within one."""
    by = Window.partitionBy(*GROUP).orderBy(F.floor(F.col("y") / band), F.desc("x"), "line_id")
    return lines.withColumn("line_ord", F.row_number().over(by))


def combine_lines(lines: DataFrame) -> DataFrame:
    """Each line as a candidate, and before them, where there are two or more, all in one with the mean confidence."""
    ordered = reading_order(lines.where(F.trim("text") != "").withColumn("text", F.trim("text")))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("line_ord", "text"))), lambda s: s["text"])
    whole = ordered.groupBy(*GROUP).agg(F.count("*").alias("n"), F.array_join(texts, " ").alias("text"), F.avg("confidence").alias("confidence")).where("n >= 2")
    whole = whole.select(*GROUP, F.lit(0).alias("cand_ord"), "text", "confidence", F.lit("paddleocr_multiline").alias("engine"))
    return whole.unionByName(ordered.select(*GROUP, F.col("line_ord").alias("cand_ord"), "text", "confidence", F.lit("paddleocr").alias("engine")))


def scored(candidates: DataFrame, as_of: Column) -> DataFrame:
    """With score: confidence and what the text's structure adds to it. Parsers run once a row, before the rules."""
    text, field = F.col("text"), F.col("field")
    out = nid.validated(candidates, F.when(field == "national_id", text), as_of, "__nid")
    out = out.withColumns({"__z": normalize_numeric(text), "__dob": F.when(field == "date_of_birth", parse.parse_dob(text)), "__serial": F.when(field == "serial_number", parse.parse_serial(text)), "__words": F.size(F.filter(tokens(text), lambda w: F.length(w) > 1))})
    n, words = F.length("__z"), F.col("__words")
    whole = (n == 14) & F.substring("__z", 1, 1).isin("2", "3")
    number = F.when(whole, F.when(F.col("__nid.status") == "VALID", 1.5).otherwise(0.5)).when(n >= 10, 0.2).otherwise(0.0)
    date = F.when(F.col("__dob").isNotNull(), 0.6).otherwise(0.0) + F.when(n == 8, 0.3).otherwise(0.0)
    serial = F.when(nonempty(F.col("__serial")).isNotNull(), 0.8).otherwise(0.0)
    lines = F.when(F.col("engine").contains("multiline") | F.col("engine").contains("segmented"), 0.25).otherwise(0.0)
    prose = F.when(words >= 2, 0.2).otherwise(0.0) + F.when(words >= 3, 0.1).otherwise(0.0) + lines
    bonus = F.when(field == "national_id", number).when(field == "date_of_birth", date).when(field == "serial_number", serial).when(F.col("field_type") == "arabic_text", prose).otherwise(0.0)
    return out.withColumn("score", F.round(F.col("confidence") + bonus, 9)).drop("__nid", "__z", "__dob", "__serial", "__words")


def best(candidates: DataFrame, as_of: Column) -> DataFrame:
    """The candidate of highest score of each record and field; the first in order of variant and candidate among equals."""
    first = Window.partitionBy("rec", "field").orderBy(F.desc("score"), "variant_ord", "cand_ord")
    return scored(candidates, as_of).withColumn("__rank", F.row_number().over(first)).where("__rank = 1").drop("__rank")
