"""From fields, one row each, to the flat record of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark import dims
from docspark.functions import nid, parse, verify
from docspark.functions.text import either, nfkc, nonempty, normalize_numeric, normalize_text

FIELDS = ["national_id", "name", "address", "date_of_birth", "serial_number", "gender", "photo"]


def field_status(ocr_ready: bool = True) -> Column:
    """Status and issue of a field (crop_empty, field_type, decoded, has_candidate, ocr_confidence)."""
    rules = [
        (F.col("crop_empty"), "FAILED", "empty_crop"),
        ((F.col("field_type") == "barcode") & F.col("decoded"), "EXTRACTED", None),
        (F.col("field_type") == "barcode", "DETECTED", None),
        (F.col("field_type") == "image_region", "DETECTED", "not_an_ocr_field"),
        (F.lit(not ocr_ready), "FAILED", "ocr_unavailable"),
        (~F.col("has_candidate"), "FAILED", "no_text_detected"),
        (F.col("ocr_confidence") < dims.LOW_CONFIDENCE_OCR, "LOW_CONFIDENCE", None),
    ]
    status, issue = F.when(rules[0][0], rules[0][1]), F.when(rules[0][0], F.lit(rules[0][2]))
    for when, s, i in rules[1:]:
        status, issue = status.when(when, s), issue.when(when, F.lit(i))
    return F.struct(status.otherwise("EXTRACTED").alias("status"), issue.alias("issue"))


def normalized_field(text: Column) -> Column:
    """A field's text by the parser of its kind (field, field_type, raw); ``text`` is raw after compatibility normalization."""
    raw, field = F.col("raw"), F.col("field")
    return (
        F.when(field == "national_id", parse.parse_national_id(raw))
        .when(field == "date_of_birth", F.coalesce(parse.parse_dob(raw), normalize_numeric(raw)))
        .when(F.col("field_type") == "numeric", normalize_numeric(raw))
        .when(field == "serial_number", parse.parse_serial(raw))
        .when(field == "name", parse.parse_name(text, False))
        .when(field == "address", parse.parse_address(F.array(text), False))
        .otherwise(normalize_text(text, False))
    )


def read_fields(fields: DataFrame, compatibility: bool = True, ocr_ready: bool = True) -> DataFrame:
    """Adds status, issue and normalized; what was not read has neither text.

    Compatibility normalization, the one step in Python, runs once a row and
    only on texts that are prose.
    """
    out = fields.withColumn("s", field_status(ocr_ready)).select("*", "s.status", "s.issue").drop("s")
    read = F.col("status").isin("EXTRACTED", "LOW_CONFIDENCE")
    out = out.withColumn("raw", F.when(read, F.col("raw")))
    prose = ~F.col("field_type").isin("numeric", "text")
    out = out.withColumn("__text", nfkc(F.when(prose, F.col("raw"))) if compatibility else F.col("raw"))
    return out.withColumn("normalized", F.when(F.col("raw").isNotNull(), normalized_field(F.coalesce("__text", "raw")))).drop("__text")


def pivoted(fields: DataFrame) -> DataFrame:
    """A row for each record, with a struct for each field; the list is fixed, so no job looks for it."""
    entry = F.struct("raw", "normalized", "status", "ocr_confidence", "localization_confidence")
    return fields.groupBy("rec").pivot("field", FIELDS).agg(F.first(entry))


def recovered(wide: DataFrame) -> DataFrame:
    """Numbers that were read in another field's place."""
    number = parse.recover_nid(F.col("address.raw"), F.col("national_id.normalized"))
    serial = parse.recover_serial(F.col("date_of_birth.raw"), F.col("serial_number.normalized"), F.col("serial_number.status"))

    def put(field: str, value: Column) -> Column:
        c = F.col(field)
        new = c.withField("raw", value).withField("normalized", value).withField("status", F.lit("EXTRACTED")).withField("ocr_confidence", F.lit(0.95))
        return F.when(c.isNotNull() & value.isNotNull(), new).otherwise(c)

    return wide.withColumn("national_id", put("national_id", number)).withColumn("serial_number", put("serial_number", serial))


def verified(wide: DataFrame, as_of: Column) -> DataFrame:
    """Adds validation, printed values and checks; statuses follow the verifications."""
    there = nonempty(F.col("national_id.normalized")).isNotNull()
    first = F.lit(None).cast("string")
    for _, name, _ in reversed(dims.GOVERNORATES):  # the first of the list that the address names
        first = F.when(F.col("address.raw").contains(name), name).otherwise(first)
    out = nid.validated(wide, F.col("national_id.normalized"), as_of).withColumn("validation", F.when(there, F.col("validation")))
    out = out.withColumns({"printed_dob": parse.parse_dob(F.col("date_of_birth.raw")), "printed_gender": parse.parse_gender(F.col("gender.raw")), "printed_governorate": first})
    d = F.col("validation.derived")
    checks = verify.cross_field(F.col("printed_dob"), d["birth_date"], F.col("printed_gender"), d["gender"], F.col("printed_governorate"), d["governorate_name"])
    out = out.withColumn("checks", F.when(there, checks))

    def status(field: str, new: Column, when: Column) -> Column:
        return F.when(when, F.col(field).withField("status", new)).otherwise(F.col(field))

    both = lambda a, b: nonempty(a).isNotNull() & nonempty(b).isNotNull()
    out = out.withColumn("national_id", status("national_id", verify.verify_national_id(F.col("validation.status")), there))
    out = out.withColumn("date_of_birth", status("date_of_birth", verify.verify_dob(F.col("printed_dob"), d["birth_date"]), both(F.col("printed_dob"), d["birth_date"])))
    return out.withColumn("gender", status("gender", verify.verify_gender(F.col("printed_gender"), d["gender"]), both(F.col("printed_gender"), d["gender"])))


def _confidence(field: str) -> Column:
    return F.round(F.coalesce(F.col(f"{field}.ocr_confidence"), F.lit(0.0)), 4)


def flattened(wide: DataFrame) -> DataFrame:
    """The flat record. A date or gender falls back on the next source only where the one before does not exist."""
    value = lambda f: either(F.col(f"{f}.normalized"), F.col(f"{f}.raw"))
    validated = F.col("validation").isNotNull()
    derived = F.col("validation.derived")
    doubtful = lambda f: F.col(f"{f}.status").isin("LOW_CONFIDENCE", "FAILED")
    number, full, address, serial = (value(f) for f in ("national_id", "name", "address", "serial_number"))
    loose = (F.col("national_id.status") != "EXTRACTED") | number.isNull() | (F.length(number) != 14)
    review = F.when(F.col("national_id").isNull(), True).when(validated, (F.col("validation.status") != "VALID") | doubtful("national_id")).otherwise(loose)
    names = parse.split_name(full)
    detection = lambda f: F.coalesce(F.col(f"{f}.localization_confidence"), F.col(f"{f}.ocr_confidence"), F.lit(0.0))
    entries = F.filter(F.array(*[F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("key"), F.round(detection(f), 4).alias("value"))) for f in FIELDS]), lambda e: e.isNotNull())
    return wide.select(
        "rec",
        number.alias("national_id"),
        full.alias("full_name"),
        names["first_name"].alias("first_name"),
        names["last_name"].alias("last_name"),
        F.when(validated, nonempty(derived["birth_date"])).otherwise(nonempty(F.col("date_of_birth.normalized"))).alias("birth_date"),
        F.when(validated, nonempty(derived["gender"])).otherwise(nonempty(F.col("gender.normalized"))).alias("gender"),
        derived["governorate_name"].alias("governorate"),
        address.alias("address"),
        serial.alias("serial_number"),
        F.struct(_confidence("national_id").alias("national_id"), _confidence("name").alias("first_name"), _confidence("name").alias("last_name"), _confidence("address").alias("address"), _confidence("serial_number").alias("serial_number"), F.map_from_entries(entries).alias("field_detection")).alias("confidence"),
        F.struct(review.alias("national_id"), full.isNull().alias("full_name"), F.when(F.col("address").isNull(), True).otherwise(address.isNull() | doubtful("address")).alias("address"), serial.isNull().alias("serial_number")).alias("needs_review"),
    )


def assemble(fields: DataFrame, as_of: Column, compatibility: bool = True, ocr_ready: bool = True) -> DataFrame:
    """Statuses, parsers, pivot, recoveries, checks and the flat record: one shuffle, by record."""
    return flattened(verified(recovered(pivoted(read_fields(fields, compatibility, ocr_ready))), as_of))


def fill_detections(localized: DataFrame, fields: DataFrame) -> DataFrame:
    """Confidence of each record and field: as localized, else as the field itself has it."""
    rest = fields.join(localized, ["rec", "field"], "left_anti")
    rest = rest.select("rec", "field", F.coalesce("localization_confidence", "ocr_confidence", F.lit(0.0)).alias("confidence"))
    return localized.select("rec", "field", F.coalesce("localization_confidence", F.lit(0.0)).alias("confidence")).unionByName(rest)


def to_json(*columns: str) -> Column:
    """With nulls in place, as a store of whole records wants it."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
