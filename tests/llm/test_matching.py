"""Substring dedup's FM-index search against brute force, and that nothing goes without it."""

import numpy as np
import pytest

from docspark.llm import substrings
from docspark.llm.fmindex import FMIndex

COLUMNS = "doc_id long, text string"


def brute(docs):
    """Places of all words that go, by (doc_id, word)."""
    seen, gone = {}, set()
    for doc, words in sorted(docs):
        for i in range(len(words) - 19):
            key = tuple(words[i : i + 20])
            if seen.setdefault(key, (doc, i)) != (doc, i):
                gone |= {(doc, j) for j in range(i, i + 20)}
    return gone


def words_of(rng, n, letters=50):
    return [f"w{x}" for x in rng.integers(0, letters, n)]


def test_matches_are_all_matches_of_that_length():
    rng = np.random.default_rng(3)
    for _ in range(40):
        parts = [rng.integers(1, 4, rng.integers(3, 40)) for _ in range(4)]
        index = FMIndex(np.concatenate([np.r_[p, 0] for p in parts]), 3)
        text = rng.integers(0, 4, 120)
        begin = np.array([0, 50, 90])
        end = np.array([50, 90, 120])
        least = int(rng.integers(2, 6))
        known = {tuple(p[i : i + least]) for p in parts for i in range(len(p) - least + 1)}
        want = {i for a, b in zip(begin, end, strict=True) for i in range(a, b - least + 1) if tuple(text[i : i + least]) in known}
        left, right, low, high = index.matches(text, begin, end, least)
        assert {i for a, b in zip(left, right, strict=True) for i in range(a, b - least + 1)} == want
        for a, b, x, y in zip(left, right, low, high, strict=True):
            pattern = text[a:b].tolist()
            assert y - x == sum(p[i : i + b - a].tolist() == pattern for p in parts for i in range(len(p)))


def test_confirmed_is_what_occurs_earlier(monkeypatch):
    rng = np.random.default_rng(0)
    packed = lambda x: [(int(d), s, len(w) - 19, " ".join(w).encode()) for d, s, w in x]
    for _ in range(40):
        monkeypatch.setattr(substrings, "PIECE", int(rng.integers(1, 40)))
        base = words_of(rng, 400, 3)
        spans = []
        for doc in rng.integers(0, 6, 8):
            a = int(rng.integers(0, 300))
            spans.append((int(doc), int(rng.integers(0, 5)), base[a : a + int(rng.integers(20, 90))] + words_of(rng, int(rng.integers(0, 30)), 5)))
        first: dict[tuple, tuple] = {}
        for doc, start, words in spans[:4]:
            for i in range(len(words) - 19):
                key = tuple(words[i : i + 20])
                first[key] = min(first.get(key, (99, 0)), (doc, start + i))
        want = {(d, s + i) for d, s, w in spans[4:] for i in range(len(w) - 19) if first.get(tuple(w[i : i + 20]), (99, 0)) < (d, s + i)}
        got = {(d, x) for d, s, n in substrings.confirmed(packed(spans[:4]), packed(spans[4:])) for x in range(s, s + n)}
        assert got == want


def passages(rng):
    """Copies, a passage with many surroundings, its parts, and a text that repeats itself."""
    shared, other = words_of(rng, 70, 1000), words_of(rng, 300, 1000)
    docs = [words_of(rng, int(rng.integers(0, 30))) + shared[: int(rng.integers(10, 71))] + words_of(rng, 12) for _ in range(120)]
    docs += [other] * 25 + [other[k : k + 60] for k in range(0, 240, 40)]
    docs += [words_of(rng, 40) * 3, shared[30:] + other[100:160] + shared[:30]]
    order = rng.permutation(len(docs))
    return [(int(i), docs[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize(("hot", "split", "shard"), [(4096, 1 << 19, 1 << 19), (3, 300, 500)])
def test_many_surroundings(spark, hot, split, shard, monkeypatch):
    """Hot anchors and hot earlier places dealt apart, in small shards, as in large ones."""
    for name, value in (("HOT", hot), ("SPLIT", split), ("SHARD_WORDS", shard)):
        monkeypatch.setattr(substrings, name, value)
    docs = passages(np.random.default_rng(4))
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], COLUMNS).repartition(5)
    gone = brute(docs)
    got = {r["doc_id"]: (r["text"], r["removed"]) for r in substrings.dedup(frame, counts=("total", "removed")).collect()}
    for doc, words in docs:
        kept = [w for i, w in enumerate(words) if (doc, i) not in gone]
        assert got[doc] == (" ".join(kept), len(words) - len(kept)), doc


def test_nothing_goes_without_the_index(spark, monkeypatch):
    """Where the matching finds nothing, as many hashes as there are agree to no avail."""
    docs = passages(np.random.default_rng(5))
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], COLUMNS)

    def nothing(batches):
        assert sum(b.num_rows for b in batches) >= 0
        return iter(())

    monkeypatch.setattr(substrings, "_match", nothing)
    assert substrings.dedup(frame, counts=("total", "removed")).agg({"removed": "sum"}).first()[0] == 0


def test_a_false_claim_is_turned_down():
    rng = np.random.default_rng(6)
    a, b = words_of(rng, 40, 1000), words_of(rng, 40, 1000)
    span = lambda d, w: (d, 0, 21, " ".join(w).encode())
    assert substrings.confirmed([span(1, a)], [span(2, b), span(3, a)]) == [(3, 0, 21)]


def removed(spark, docs):
    rows = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], COLUMNS)
    return {(r["doc_id"], i) for r in substrings.intervals(rows).collect() for i in range(r["start"], r["start"] + r["n"] + 19)}


@pytest.mark.parametrize("reach", [7, 40, substrings.REACH])
def test_claims_are_cut_by_reaches(spark, monkeypatch, reach):
    """Passages of all lengths, some over several reaches, from a long document at both of its ends."""
    monkeypatch.setattr(substrings, "REACH", reach)
    rng = np.random.default_rng(8)
    first = words_of(rng, 900, 4000)
    docs = [(1, first), (2, words_of(rng, 30, 4000) + first[:130]), (3, first[-130:] + words_of(rng, 9, 4000)), (4, first[300:700]), (5, first), (6, first[10:31] * 3)]
    assert removed(spark, docs) == brute(docs)


def test_an_earlier_document_is_never_held_whole(spark, monkeypatch):
    """Claims on both ends of a document do not bring what lies between them."""
    claims = spark.createDataFrame([(2, 0, 128, 1, 0), (3, 5, 127, 1, 299_854), (4, 0, 600_000, 1, 100)], substrings.CLAIMED)
    cut = substrings.reached(claims)
    assert cut.select(*claims.columns).dtypes == claims.dtypes
    reach = cut.groupBy("source", "reach").agg({"at": "min", "n": "max"}).collect()
    assert all(r["max(n)"] <= substrings.REACH for r in reach) and len(reach) == 3
    windows = lambda df: {(r["doc_id"], r["start"] + i, r["source"], r["at"] + i) for r in df.collect() for i in (*range(0, r["n"], 997), r["n"] - 1)}
    assert sum(r["n"] for r in cut.collect()) == 128 + 127 + 600_000
    assert {(d, s - a) for d, s, _, a in windows(cut)} == {(d, s - a) for d, s, _, a in windows(claims)}
