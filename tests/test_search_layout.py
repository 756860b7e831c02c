"""Search by trigrams and rows in a space-filling order: the same rows as the plain forms, from less of the files."""

import os
import random
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from docspark.operators import review
from docspark.sinks import layout
from docspark.sinks.review_store import ReviewStore
from docspark.sinks.search_index import SearchIndex, grams


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeİéf ") for _ in range(rng.randint(0, 12)))
    rows = [(i, None if i % 31 == 0 else f"Common {word()}", f"{29904170000000 + i * 7919}", rng.choice(["Cairo", "Giza", "", None]), rng.choice(["PENDING", "ACCEPTED", None])) for i in range(3000)]
    state = spark.createDataFrame(rows, "id long, full_name string, national_id string, governorate string, review_status string")
    store = ReviewStore(spark, str(tmp_path_factory.mktemp("search") / "store")).create(state, buckets=32)
    return store, SearchIndex(store).build(parts=40)


@pytest.mark.parametrize("query", ["", " ", "a", "ca", "CAIRO", " giza", "common", "abc", "zzz", "29904170", "2990417" + "0000000", "f f", "İ", "mon é", "abcabc", "🙂🙂🙂"])
@pytest.mark.parametrize("status", ["ALL", "PENDING"])
def test_the_same_rows(indexed, query, status):
    store, index = indexed
    assert rows_of(index.search(query, status)) == rows_of(review.search(store.read(), query, status))


def bytes_of(df):
    return sum(os.path.getsize(urlparse(f).path) for f in df.inputFiles() if "/state/" in f)


def test_less_is_read(indexed):
    store, index = indexed
    number = store.read().where("id = 1234").first()["national_id"]
    assert rows_of(index.search(number)) == rows_of(review.search(store.read(), number))
    assert 0 < bytes_of(index.search(number)) < 0.1 * bytes_of(store.read())
    assert bytes_of(index.search("nowhere at all")) == 0
    assert bytes_of(index.search("ab")) == bytes_of(store.read())  # too short for the index


def test_decisions_and_compaction_show(spark, tmp_path):
    state = spark.createDataFrame([(i, f"name {i:03}", "PENDING") for i in range(40)], "id long, full_name string, review_status string").withColumns({c: F.lit("x") for c in ("national_id", "governorate")})
    store = ReviewStore(spark, str(tmp_path / "s")).create(state, buckets=4)
    index = SearchIndex(store).build()
    store.apply(spark.createDataFrame([(1, 7, "approve", None)], "req long, id long, action string, decision_note string"), "portal", 0)
    for _ in range(2):
        assert [r["id"] for r in index.search("name 007", "ACCEPTED").collect()] == [7] and index.search("name 007", "PENDING").isEmpty()
        store.compact()


def test_a_gram_of_all_records_is_in_many_files(spark, indexed):
    _, index = indexed
    files = spark.read.parquet(f"{index.path}/postings").where("gram = 'omm'").select(F.input_file_name().alias("f")).distinct().count()
    assert files >= 2 and grams("abcab") == ["abc", "bca", "cab"] and grams("ab") == []


def scanned(df):
    """Rows that the scans of a plan gave out, after row groups and pages were left out by statistics."""
    df.collect()
    total, stack = 0, [df._jdf.queryExecution().executedPlan()]
    while stack:
        p = stack.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            stack.append(p.executedPlan())
            continue
        if p.getClass().getSimpleName().endswith("QueryStageExec"):
            stack.append(p.plan())
            continue
        if "Scan" in p.nodeName():
            total += p.metrics().apply("numOutputRows").value()
        children = p.children()
        stack.extend(children.apply(i) for i in range(children.size()))
    return total


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("layout") / "rows")
    rows = spark.range(20000).select(F.expr("pmod(id * 7919, 20011)").alias("id"), (F.col("id") % 25).alias("region"), (F.col("id") % 3).alias("status"), F.expr("CASE WHEN id % 50 = 0 THEN NULL ELSE id % 28 END").alias("month"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    layout.write_clustered(rows, path, layout.z_order(F.col("region"), F.col("status"), F.col("month")), parts=4, group_bytes=1 << 16)
    return path


def test_pages_are_all_rows_in_order(spark, clustered):
    whole = [tuple(r) for r in spark.read.parquet(clustered).orderBy("z", "id").select("z", "id").collect()]
    got, last = [], None
    while rows := layout.page(spark, clustered, 3000, last).collect():
        got += [(r["z"], r["id"]) for r in rows]
        last = got[-1]
    assert got == whole
    assert scanned(layout.page(spark, clustered, 100, whole[18000])) < 6000 < 20000


def test_lookup_and_filters_read_few_rows(spark, clustered):
    some = [r["id"] for r in spark.read.parquet(clustered).limit(2).collect()]
    found = layout.by_id(spark, clustered, *some, -5)
    assert sorted(r["id"] for r in found.collect()) == sorted(some)
    assert scanned(layout.by_id(spark, clustered, some[0])) <= 10000
    assert scanned(layout.by_id(spark, clustered, 20011 * 5 + 1)) == 0  # statistics say that it is in no row group
    assert layout.by_id(spark, clustered).collect() == []


def test_bloom_filter_leaves_files_out(spark, tmp_path):
    rows = spark.range(0, 40000, 2).withColumn("k", F.expr("pmod(id * 31, 977)"))
    layout.write_clustered(rows, str(tmp_path / "b"), F.col("k").cast("long"), parts=4)
    assert scanned(layout.by_id(spark, str(tmp_path / "b"), 20001)) == 0  # odd: within the ranges of all files, in none of them


def test_z_order(spark):
    rows = spark.createDataFrame([(3, 0), (0, 3), (1, 1), (99, -4), (None, 2)], "a int, b int").select(layout.z_order(F.col("a"), F.col("b"), bits=2).alias("z")).collect()
    assert [r["z"] for r in rows] == [0b1010, 0b0101, 0b11, 0b1010, 0b0100]
