"""Stored JSON read back as VARIANT; exact shares of classes by keyed hash."""

import hashlib
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from docspark.operators import split
from docspark.sources import stored

WHOLE = '{"national_id":"1","full_name":null,"birth_date":"1999-01-02","confidence":{"national_id":0.5},"needs_review":{"national_id":true,"full_name":false},"more":[1]}'


def test_fields(spark):
    rows = [(1, WHOLE), (2, WHOLE[:-1]), (3, None), (4, ""), (5, "[1]"), (6, "null"), (7, '"text"'), (8, "{}"), (9, '{"national_id":29904171700111,"confidence":"high","needs_review":{"national_id":"maybe"},"gender":{"x":1}}'), (10, '{"national_id":"a","national_id":"b"}')]
    got = {r["id"]: r for r in stored.fields(spark.createDataFrame(rows, "id long, ocr_result string")).collect()}
    assert {i for i, r in got.items() if r["readable"]} == {1, 8, 9}
    assert (got[1]["national_id"], got[1]["full_name"], got[1]["birth_date"], got[1]["nid_confidence"], got[1]["review_national_id"], got[1]["review_full_name"]) == ("1", None, "1999-01-02", 0.5, True, False)
    for i in (2, 3, 4, 5, 6, 7, 8, 10):
        assert all(got[i][c] is None for c in stored.FIELDS)
    assert got[9]["national_id"] == "29904171700111" and got[9]["nid_confidence"] is None and got[9]["review_national_id"] is None


def test_clashing_columns_and_empty(spark):
    rows = spark.createDataFrame([(1, WHOLE, "mine", True)], "id long, ocr_result string, national_id string, readable boolean")
    out = stored.fields(rows)
    assert len(set(out.columns)) == len(out.columns) and out.first()["national_id"] == "1"
    assert stored.fields(rows.limit(0)).collect() == []


def test_schema(spark):
    rows = spark.createDataFrame([('{"a":1,"b":{"c":"x"}}',), ('{"a":2.5}',), ("{",), (None,), ("[true]",)], "ocr_result string")
    assert stored.schema_of(rows) == "OBJECT<a: DECIMAL(11,1), b: OBJECT<c: STRING>>" or stored.schema_of(rows).startswith("OBJECT<a: D")
    assert stored.schema_of(rows.limit(0)) == "VOID"


def brute(rows, share, seed="split"):
    """The validation keys of each class."""
    out = set()
    for cls in {c for _, c in rows}:
        keys = sorted({k for k, c in rows if c == cls and k is not None}, key=lambda k: hashlib.sha256(f"{seed}|{k}".encode()).hexdigest())
        out |= {(k, cls) for k in keys[: int(len(keys) * share)]}
    return out


@pytest.mark.parametrize("few", [split.FEW, 1, 30])
@pytest.mark.parametrize("share", [Fraction(1, 5), Fraction(2, 3), Fraction(0), Fraction(1)])
def test_exact_shares(spark, few, share):
    rows = [(i, "abc"[min(2, i % 7)] if i % 50 else None) for i in range(700)] + [(5000, "alone"), (None, "a"), (7, "a"), (14, "a"), (14, "a")]
    df = spark.createDataFrame(rows, "k long, c string").repartition(5)
    got = split.stratified(df, "k", "c", share, few=few).collect()
    assert Counter((r["k"], r["c"]) for r in got) == Counter(rows)
    assert {(r["k"], r["c"]) for r in got if r["split"] == "val"} == brute(rows, share)


def test_partitions_do_not_matter(spark):
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 3).alias("c"))
    ask = lambda x: sorted(map(tuple, split.stratified(x, "k", "c", few=5).collect()))
    assert ask(df.repartition(9)) == ask(df.coalesce(1).orderBy(F.desc("k")))
    assert split.stratified(df.limit(0), "k", "c").collect() == []
