"""The review portal: reading, searching, showing and deciding on stored results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions.text import either

COLUMNS = "id original_filename image_mime_type image_sha256 national_id full_name first_name last_name birth_date gender governorate address serial_number ocr_result capture_quality review_status reviewed_by reviewed_at decision_note ocr_model_version created_at".split()


def listing(state: DataFrame) -> DataFrame:
    """All columns but the image, which is then not read."""
    return state.select(*[c for c in COLUMNS if c in state.columns])


def by_id(state: DataFrame, ids: DataFrame) -> DataFrame:
    """A row for each asked id: 200 with the record, or 404."""
    asked = ids.select(F.col("id").alias("asked"))
    rows = asked.join(listing(state), F.col("asked") == F.col("id"), "left")
    found = F.col("id").isNotNull()
    return rows.select("asked", F.when(found, 200).otherwise(404).alias("status"), F.when(found, "OK.").otherwise("Record doesn't exist.").alias("message"), "national_id", "full_name", "review_status")


def image(state: DataFrame) -> DataFrame:
    return state.select("id", "image_mime_type", F.base64("card_image").alias("image_base64"))


def matches(query: str, status: str = "ALL") -> Column:
    """Trimmed text within name, number or region, whatever the case; and the status, unless all are wanted."""
    q = query.strip().lower()
    found = F.lit(not q)
    for c in ("full_name", "national_id", "governorate"):
        found = found | F.coalesce(F.lower(c).contains(q), F.lit(False))
    return found & (F.lit(True) if status == "ALL" else F.coalesce(F.upper("review_status") == status, F.lit(False)))


def search(state: DataFrame, query: str, status: str = "ALL") -> DataFrame:
    return listing(state).where(matches(query, status))


def counts(state: DataFrame, query: str, status: str = "ALL") -> DataFrame:
    """Showing n of m."""
    return state.agg(F.count_if(matches(query, status)).alias("shown"), F.count("*").alias("total"))


def _badge(c: str, colours: dict[str, str]) -> Column:
    out = F.lit("gray")
    for value, colour in colours.items():
        out = F.when(F.upper(c) == value, colour).otherwise(out)
    return out


def display(state: DataFrame) -> DataFrame:
    show = lambda c: either(F.col(c).cast("string"), F.lit("N/A")).alias(c)
    return state.select(
        "id",
        *(show(c) for c in ("full_name", "national_id", "birth_date", "governorate", "decision_note")),
        _badge("review_status", {"ACCEPTED": "green", "REJECTED": "red", "PENDING": "yellow"}).alias("status_badge"),
        _badge("capture_quality", {"GOOD": "green", "BORDERLINE": "yellow", "BAD": "red"}).alias("quality_badge"),
    )


def transition(state: DataFrame, requests: DataFrame, reviewer: str = "admin", now: Column | None = None) -> DataFrame:
    """What becomes of each request (req, id, action, decision_note); of several on one id, the first by ``req`` counts.

    404 for no such record, 409 if it is not pending (or was decided by an
    earlier request), 400 for a rejection without a reason and for any other
    action than approve and reject, a null one included.
    """
    asked = requests.select("req", "id", "action", "decision_note")
    return decided(asked.join(state.select("id", "review_status"), "id", "left"), reviewer, now)


def decided(rows: DataFrame, reviewer: str = "admin", now: Column | None = None) -> DataFrame:
    """The same of requests that stand beside the status of their record (null for no record); further columns stay."""
    note = F.coalesce(F.trim(F.regexp_replace("decision_note", r"(?U)\s+", " ")) != "", F.lit(False))
    reason = F.coalesce((F.col("action") == "approve") | ((F.col("action") == "reject") & note), F.lit(False))
    done = (F.col("review_status") == "PENDING") & reason
    earlier = F.max(F.when(done, 1).otherwise(0)).over(Window.partitionBy("id").orderBy("req").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("taken", F.coalesce(earlier, F.lit(0)) == 1)
    code = F.when(F.col("review_status").isNull(), 404).when((F.col("review_status") != "PENDING") | F.col("taken"), 409).when(~reason, 400).otherwise(200)
    new = F.when(F.col("action") == "approve", "ACCEPTED").otherwise("REJECTED")
    own = [c for c in rows.columns if c not in ("req", "id", "status", "action", "decision_note", "review_status", "taken")]
    return rows.withColumn("status", code).select(
        "req",
        "id",
        "status",
        *own,
        F.when(F.col("status") == 200, new).alias("review_status"),
        F.when(F.col("status") == 200, F.lit(reviewer)).alias("reviewed_by"),
        F.when(F.col("status") == 200, now if now is not None else F.current_timestamp()).alias("reviewed_at"),
        F.when(F.col("status") == 200, F.col("decision_note")).alias("decision_note"),
    )


def applied(state: DataFrame, decisions: DataFrame) -> DataFrame:
    """The state after the decisions that went through: a new snapshot, the same however often it is made."""
    columns = ["review_status", "reviewed_by", "reviewed_at", "decision_note"]
    new = decisions.where("status = 200").select("id", F.struct(*columns).alias("__new"))
    joined = state.join(new, "id", "left")
    return joined.withColumns({c: F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)) for c in columns if c in state.columns}).drop("__new")
