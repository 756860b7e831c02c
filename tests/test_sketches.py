"""Sketches against exact ranks, in one pass and merged from parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.operators import sketches

SHARES = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)


@pytest.fixture(scope="module")
def rows(spark):
    values = F.when(F.col("id") % 3 == 0, F.randn(1) * 5).otherwise(F.round(F.rand(2) * 20))
    return spark.range(90000, numPartitions=6).select("id", F.when(F.col("id") % 9 < 6, "hot").when(F.col("id") % 9 < 8, "b").otherwise("c").alias("g"), values.alias("v")).cache()


def check(got, rows):
    for r in got.collect():
        x = np.sort(np.array([q["v"] for q in rows.where(F.col("g") == r["g"]).collect()]))
        assert r["n"] == len(x)
        for share, q in zip(SHARES, r["quantiles"], strict=True):
            low, high = np.searchsorted(x, q, "left") / len(x), np.searchsorted(x, q, "right") / len(x)
            assert low - 2 * sketches.rank_error() <= share <= high + 2 * sketches.rank_error()
        assert (r["quantiles"][0], r["quantiles"][-1]) == (x[0], x[-1])


def test_one_pass(rows):
    check(sketches.quantiles(sketches.sketched(rows, "v", "g"), *SHARES), rows)


def test_merged_from_halves(rows):
    parts = sketches.sketched(rows.withColumn("day", F.col("id") % 2), "v", "g", "day")
    assert parts.count() == 6 and parts.agg(F.max(F.length("sketch"))).first()[0] < 40000
    check(sketches.quantiles(sketches.merged(parts, "g"), *SHARES), rows)


def test_odd_groups(spark):
    rows = spark.createDataFrame([("none", None), ("nan", float("nan")), ("one", 3.0), ("one", None), ("few", 1.0), ("few", 2.0), ("few", 3.0)], "g string, v double")
    got = {r["g"]: (r["n"], r["quantiles"]) for r in sketches.quantiles(sketches.merged(sketches.sketched(rows, "v", "g"), "g"), 0.5).collect()}
    assert got == {"none": (0, [None]), "nan": (0, [None]), "one": (1, [3.0]), "few": (3, [2.0])}
    assert sketches.quantiles(sketches.sketched(rows.limit(0), "v", "g"), 0.5).collect() == []
