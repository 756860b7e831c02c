"""The review store: batches, repeats, versions, two writers, compaction by bucket."""

import pytest
from pyspark.sql import functions as F

from docspark.operators import review
from docspark.plans.adapters import view
from docspark.sinks import shared
from docspark.sinks.review_store import ReviewStore

REQUEST = "req long, id long, action string, decision_note string, version long"


@pytest.fixture
def state(spark):
    return spark.createDataFrame([(i, f"name {i}", "PENDING" if i % 4 else "ACCEPTED") for i in range(1, 41)], "id long, full_name string, review_status string")


@pytest.fixture
def store(spark, state, tmp_path):
    return ReviewStore(spark, str(tmp_path / "store")).create(state, buckets=8)


def requests(spark, *rows):
    return spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], REQUEST)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def codes(answers):
    return {r["req"]: r["status"] for r in answers.collect()}


def test_batches_are_as_good_as_one(spark, sf, tmp_path):
    state = view(spark, sf, "review_state").select("id", "full_name", "review_status", "decision_note")
    asked = view(spark, sf, "review_req")
    plain = review.applied(state, review.transition(state, asked))
    want = rows_of(plain.select("id", "full_name", "review_status", "decision_note"))
    for n in (1, 3, 7):
        store = ReviewStore(spark, str(tmp_path / f"s{n}")).create(state)
        last = asked.agg(F.max("req")).first()[0]
        for k in range(n):
            store.apply(asked.where(F.col("req").between(k * last // n + (k > 0), (k + 1) * last // n)), "portal", k)
        assert rows_of(store.read().select("id", "full_name", "review_status", "decision_note")) == want
        store.compact()
        assert rows_of(store.read().select("id", "full_name", "review_status", "decision_note")) == want


def test_a_repeated_batch_changes_nothing(spark, store):
    batch = requests(spark, (1, 1, "approve"), (2, 4, "approve"), (3, 99, "approve"), (4, 2, "reject"), (5, 3, "reject", "blurred"))
    first = store.apply(batch, "portal", 0)
    assert codes(first) == {1: 200, 2: 409, 3: 404, 4: 400, 5: 200}
    before, files, at = rows_of(store.read()), store.files(), store._number()
    for _ in range(2):
        assert rows_of(store.apply(batch, "portal", 0)) == rows_of(first)
        assert (rows_of(store.read()), store.files(), store._number()) == (before, files, at)
        store.compact()
        files, at = store.files(), store._number()
    store.apply(requests(spark, (6, 5, "approve")), "portal", 1)
    assert rows_of(store.apply(batch, "portal", 0)) == rows_of(first)
    # another writer's first batch is a batch of its own
    assert codes(store.apply(batch, "mobile", 0)) == {1: 409, 2: 409, 3: 404, 4: 400, 5: 409}


def test_versions(spark, store):
    answers = store.apply(requests(spark, (1, 1, "approve", None, 0), (2, 2, "approve", None, 1), (3, 2, "approve", None, 0), (4, 99, "approve", None, 5), (5, 3, "approve", None, None), (6, None, "approve"), (7, 5, None)), "portal", 0)
    assert codes(answers) == {1: 200, 2: 409, 3: 200, 4: 404, 5: 200, 6: 404, 7: 400}
    got = {r["id"]: (r["version"], r["review_status"], r["reviewed_by"]) for r in store.read().collect()}
    assert got[1] == got[2] == got[3] == (1, "ACCEPTED", "admin") and got[5] == (0, "PENDING", None)
    assert {r["version"] for r in store.read(0).collect()} == {0}


def test_two_writers(spark, store, monkeypatch):
    """Between the decision and the commit of one writer, another one commits."""
    other = ReviewStore(spark, store.path)
    plain, came = store._commit, []

    def late(snapshot):
        if not came:
            came.append(codes(other.apply(requests(spark, (1, 1, "reject", "blurred"), (2, 2, "approve")), "mobile", 0)))
        return plain(snapshot)

    monkeypatch.setattr(store, "_commit", late)
    answers = codes(store.apply(requests(spark, (1, 1, "approve"), (2, 3, "approve")), "portal", 0))
    assert came == [{1: 200, 2: 200}] and answers == {1: 409, 2: 200}
    got = {r["id"]: r["review_status"] for r in store.read().collect()}
    assert (got[1], got[2], got[3]) == ("REJECTED", "ACCEPTED", "ACCEPTED")
    assert len(shared.names(spark, f"{store.path}/log")) == 2  # the attempt that lost is gone


def test_compaction_meets_a_writer(spark, store, monkeypatch):
    store.apply(requests(spark, (1, 1, "approve")), "portal", 0)
    plain, came = store._commit, []

    def late(snapshot):
        if not came:
            came.append(ReviewStore(spark, store.path).apply(requests(spark, (2, 2, "approve")), "mobile", 0))
        return plain(snapshot)

    monkeypatch.setattr(store, "_commit", late)
    store.compact()
    got = {r["id"]: r["review_status"] for r in store.read().collect()}
    assert got[1] == got[2] == "ACCEPTED" and store._snapshot()["log"] == []


def test_only_touched_buckets_are_written(spark, store):
    before = store.files()
    store.apply(requests(spark, (1, 1, "approve"), (2, 2, "approve"), (3, 4, "approve")), "portal", 0)
    assert store.files() == before  # changes are in the log
    state = rows_of(store.read())
    touched = store.compact()
    after = store.files()
    assert 0 < len(touched) <= 2 and {b for b in before if before[b] != after[b]} == set(touched)
    assert rows_of(store.read()) == state and store.compact() == []
    assert sum(1 for r in store.read(0).collect() if r["version"]) == 0  # older commits stay until the vacuum
    assert store.vacuum() == [] or rows_of(store.read()) == state


def test_a_hot_bucket_goes_when_all_of_it_was_written(spark, store):
    store.apply(requests(spark, *[(i, i, "approve") for i in range(1, 41)]), "portal", 0)
    store.compact()
    assert len(store.vacuum()) == 1 and store.read().where("version = 1").count() == 30


def test_what_is_refused(spark, state, store, tmp_path):
    with pytest.raises(ValueError, match="must be there and differ"):
        ReviewStore(spark, str(tmp_path / "twice")).create(state.union(state.limit(1)))
    with pytest.raises(Exception, match="store at"):
        ReviewStore(spark, store.path).create(state)
    with pytest.raises(ValueError, match="no store"):
        ReviewStore(spark, str(tmp_path / "none")).read()


def test_empty(spark, state, tmp_path):
    store = ReviewStore(spark, str(tmp_path / "empty")).create(state.limit(0))
    assert codes(store.apply(requests(spark, (1, 1, "approve")), "portal", 0)) == {1: 404}
    assert store.apply(requests(spark).limit(0), "portal", 1).collect() == [] and store.compact() == [] and store.read().collect() == []
