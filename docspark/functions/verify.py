"""Checks between fields and statuses that follow from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark.functions.text import nonempty

MATCH, MISMATCH, INSUFFICIENT = "MATCH", "MISMATCH", "INSUFFICIENT_EVIDENCE"


def consistency(printed: Column, derived: Column, trimmed: bool = False) -> Column:
    a, b = nonempty(printed), nonempty(derived)
    same = F.trim(a) == F.trim(b) if trimmed else a == b
    return F.when(a.isNull() | b.isNull(), INSUFFICIENT).when(same, MATCH).otherwise(MISMATCH)


def cross_field(dob: Column, dob_derived: Column, gender: Column, gender_derived: Column, governorate: Column, governorate_derived: Column) -> Column:
    """All three checks, how many came out which way, and whether none disagrees."""
    results = {"dob": consistency(dob, dob_derived), "gender": consistency(gender, gender_derived), "governorate": consistency(governorate, governorate_derived, trimmed=True)}
    count = lambda what: sum((F.when(r == what, 1).otherwise(0) for r in results.values()), F.lit(0))
    return F.struct(*[r.alias(k) for k, r in results.items()], count(MATCH).alias("matches"), count(MISMATCH).alias("mismatches"), count(INSUFFICIENT).alias("warnings"), (count(MISMATCH) == 0).alias("overall_consistent"))


def verify_national_id(status: Column) -> Column:
    return F.when(status == "VALID", "VERIFIED").when(status == "INVALID_CHECKSUM", "LOW_CONFIDENCE").otherwise("FAILED")


def verify_dob(printed: Column, derived: Column) -> Column:
    a, b = nonempty(printed), nonempty(derived)
    return F.when(a == b, "CROSS_VALIDATED").when(a.isNotNull() & b.isNotNull(), "MISMATCH").when(a.isNotNull() | b.isNotNull(), "EXTRACTED").otherwise("FAILED")


def verify_gender(printed: Column, derived: Column) -> Column:
    a, b = nonempty(printed), nonempty(derived)
    return F.when(a == b, "CROSS_VALIDATED").when(a.isNotNull() & b.isNotNull(), "MISMATCH").when(a.isNotNull(), "EXTRACTED").otherwise("FAILED")


def two_pass(a: Column, b: Column) -> Column:
    """Of two readings; only null is missing here, an empty string is a value."""
    return F.when(a.isNull() | b.isNull(), INSUFFICIENT).when(a == b, "AGREEMENT").otherwise("DISAGREEMENT")


def barcode_state(present: Column, library: Column, failed: Column, payload: Column) -> Column:
    """A payload only where one was read."""
    status = F.when(~present, "barcode_not_detected").when(~library | failed, "barcode_detected").when(payload.isNull(), "barcode_not_decoded").otherwise("barcode_decoded")
    return F.struct(status.alias("status"), F.when(status == "barcode_decoded", payload).alias("payload"))
