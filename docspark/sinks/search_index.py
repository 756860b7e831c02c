"""Search within names, numbers and regions of a review store by trigram posting lists.

Postings are rows (gram, field, id), dealt by range of gram and id and sorted,
so the files and row groups of a gram are found by their statistics and a gram
that most records have is spread over many files. A query reads the postings of
its rarest ``ASKED`` grams, takes the ids that have all of them in one field, and
reads only the buckets of the store that hold those ids; there the exact test
of ``review.matches`` decides. Names do not change in the store (only decisions
do), so postings stay right while the log grows and buckets are compacted.

Defined results: those of ``review.search``, whatever the query; texts shorter
than three letters have no postings, and queries shorter than that (or empty)
read the whole store; a query with a gram that no record has finds nothing and
reads no record; null texts have no postings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.operators import review
from docspark.sinks import shared
from docspark.sinks.review_store import ReviewStore

FIELDS = ("full_name", "national_id", "governorate")
LENGTH, ASKED = 3, 3
POSTINGS, COUNTS = "gram string, field int, id long", "gram string, n long"


def grams(text: str) -> list[str]:
    return sorted({text[i : i + LENGTH] for i in range(len(text) - LENGTH + 1)})


class SearchIndex:
    def __init__(self, store: ReviewStore, path: str | None = None):
        self.store, self.path = store, path or f"{store.path}/search"

    def build(self, parts: int | None = None) -> SearchIndex:
        spark = self.store.spark
        state = self.store.read()
        texts = F.array(*[F.struct(F.lit(k).alias("field"), F.lower(c).alias("text")) for k, c in enumerate(FIELDS) if c in state.columns])
        rows = state.select("id", F.explode(texts).alias("t")).select("id", "t.*").where(F.length("text") >= LENGTH)
        found = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("text") - LENGTH + 1), lambda i: F.substring("text", i, F.lit(LENGTH))))
        postings = rows.select(F.explode(found).alias("gram"), "field", "id")
        parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
        postings.repartitionByRange(parts, "gram", "id").sortWithinPartitions("gram", "field", "id").write.parquet(f"{self.path}/postings")
        spark.read.schema(POSTINGS).parquet(f"{self.path}/postings").groupBy("gram").agg(F.count("*").alias("n")).coalesce(1).write.parquet(f"{self.path}/counts")
        return self

    def candidates(self, query: str) -> DataFrame | None:
        """ids that may match; None where the index cannot tell."""
        spark, wanted = self.store.spark, grams(query.strip().lower())
        if not wanted:
            return None
        known = spark.read.schema(COUNTS).parquet(f"{self.path}/counts").where(F.col("gram").isin(wanted)).collect()  # as many as the query has
        if len(known) < len(wanted):
            return spark.createDataFrame([], "id long")
        rare = [r["gram"] for r in sorted(known, key=lambda r: (r["n"], r["gram"]))[:ASKED]]
        postings = spark.read.schema(POSTINGS).parquet(f"{self.path}/postings").where(F.col("gram").isin(rare))
        return postings.groupBy("id", "field").count().where(F.col("count") == len(rare)).select("id").distinct()

    def search(self, query: str, status: str = "ALL") -> DataFrame:
        found = self.candidates(query)
        if found is None:
            return review.search(self.store.read(), query, status)
        found = shared.staged(found, "candidates")
        return review.search(self.store.of(found), query, status)
