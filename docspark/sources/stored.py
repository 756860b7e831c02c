"""Stored records read back from their JSON text as VARIANT values.

Text is parsed once into Spark's binary VARIANT; fields are then taken by path,
without a schema, so records written by different versions read alike.

Defined results: null, broken and empty text and JSON that is no object give
``readable`` false and null fields; a field that is absent, null or of another
type is null; further fields do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a flat record: path and type.
FIELDS: dict[str, tuple[str, str]] = {
    **{c: (f"$.{c}", "string") for c in ("national_id", "full_name", "first_name", "last_name", "birth_date", "gender", "governorate", "address", "serial_number")},
    "nid_confidence": ("$.confidence.national_id", "double"),
    "serial_confidence": ("$.confidence.serial_number", "double"),
    "review_national_id": ("$.needs_review.national_id", "boolean"),
    "review_full_name": ("$.needs_review.full_name", "boolean"),
}


def parsed(text: Column) -> Column:
    """The text as VARIANT, null where it is none."""
    return F.try_parse_json(text)


def readable(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def fields(rows: DataFrame, column: str = "ocr_result", wanted: dict[str, tuple[str, str]] = FIELDS) -> DataFrame:
    """``rows`` with readable and the wanted fields in place of the text."""
    rest = [c for c in rows.columns if c != column and c not in wanted and c != "readable"]
    value = rows.select(*rest, parsed(F.col(column)).alias("__record"))
    return value.select(*rest, readable(F.col("__record")).alias("readable"), *(F.try_variant_get("__record", path, kind).alias(c) for c, (path, kind) in wanted.items()))


def schema_of(rows: DataFrame, column: str = "ocr_result") -> str:
    """The type that all readable records fit, found in one pass; VOID where there is none."""
    value = rows.select(parsed(F.col(column)).alias("v")).where(readable(F.col("v")))
    return value.agg(F.schema_of_variant_agg("v")).first()[0]
