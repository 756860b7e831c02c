"""op10's classes against brute force over all pairs of pictures."""

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from docspark.llm import media


def brute(described):
    """Pairs of numbers that consensus links, whatever buckets they share."""
    return {(i, j) for i, j in combinations(range(len(described)), 2) if media.agrees(described[i], described[j])}


def found(spark, images):
    return {r["id"]: r["class_id"] for r in media.copies(spark.createDataFrame(list(enumerate(images)), "id long, image binary")).collect()}


EDITS = {
    "noise": lambda x, rng: x + rng.normal(0, 8, x.shape),
    "brighter": lambda x, rng: 1.15 * x + 5,
    "turned": lambda x, rng: np.rot90(x),
    "cut to three quarters": lambda x, rng: x[:, : x.shape[1] * 3 // 4],
    "cut to a half": lambda x, rng: x[:, : x.shape[1] // 2],
    "covered": lambda x, rng: np.where((np.arange(x.shape[0]) < x.shape[0] // 4)[:, None], 40, x),
    "rescaled to two thirds": lambda x, rng: media.resized(x, x.shape[0] * 2 // 3, x.shape[1] * 2 // 3),
}


@pytest.mark.parametrize("large", [media.LARGE, 2])
def test_recall_of_edited_copies(spark, large, monkeypatch):
    """240 pictures; each kind of edit is found in nine of ten cases where all pairs would find it, and nothing else is merged."""
    monkeypatch.setattr(media, "LARGE", large)
    rng = np.random.default_rng(9)
    plain = [media.resized(rng.normal(128, 60, (14, 14)), 140, 140) for _ in range(30)]
    images = [media.encoded(x) for one in plain for x in (one, *(edit(one, rng) for edit in EDITS.values()))]
    described = [media.described(media.decoded(x)) for x in images]
    step = len(EDITS) + 1
    want = brute(described)
    assert all(i // step == j // step for i, j in want)
    got = found(spark, images)
    assert all(got[i] // step == i // step for i in got)
    share = {}
    for k, name in enumerate(EDITS, 1):
        linked = [i for i in range(0, len(images), step) if (i, i + k) in want]
        share[name] = (len(linked), np.mean([got[i] == got[i + k] for i in linked]))
    assert all(n >= 15 and s >= 0.9 for n, s in share.values()), share


def test_links_hidden_by_unrelated_images(spark, monkeypatch):
    """All pictures have the same descriptors, so all buckets are shared by all; only the places of two agree."""
    rng = np.random.default_rng(8)
    common = rng.integers(0, 256, (16, 32), dtype=np.uint8)
    place = lambda: np.c_[rng.uniform(0, 500, (16, 2)), np.ones(16), rng.uniform(-3, 3, 16)].astype("<f4")
    pair = place()
    pictures = [pair, pair + np.float32([7, 3, 0, 0]), *(place() for _ in range(200))]
    assert brute([(p, common) for p in pictures[:40]]) == {(0, 1)}

    def given(batches):
        for batch in batches:
            raw = batch.column("image").to_pylist()
            content = [hashlib.sha256(x).digest() for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, pa.binary()) for c in (content, raw, [common.tobytes()] * len(raw)))], names=["id", "content", "places", "bits"])

    monkeypatch.setattr(media, "_described", given)
    assert found(spark, [p.tobytes() for p in pictures]) == {0: 0, 1: 0} | {i: i for i in range(2, 202)}


def test_a_large_group_is_not_expanded_into_pairs(spark, monkeypatch):
    rng = np.random.default_rng(12)
    one = media.resized(rng.normal(128, 60, (12, 12)), 100, 100)
    images = [media.encoded(one + rng.normal(0, 6, one.shape)) for _ in range(400)] + [media.encoded(media.resized(rng.normal(128, 60, (12, 12)), 100, 100)) for _ in range(20)]
    pairs = []
    whole = media.compared
    monkeypatch.setattr(media, "compared", lambda found, pictures: pairs.append(found.count()) or whole(found, pictures))
    got = found(spark, images)
    assert got == {i: 0 for i in range(400)} | {i: i for i in range(400, 420)}
    assert sum(pairs) < 400 * 8


def test_table_links(spark, sf):
    """Each planted copy is in the class of its picture, and apart from them only near vectors are together."""
    rows = media.op10_media_copies(spark, sf).collect()
    vectors = {r["vec_id"]: np.array(r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    assert sum(not r["edited"] for r in rows) == len(vectors)
    own = {r["vec_id"]: r["class_id"] for r in rows if not r["edited"]}
    edited = {r["vec_id"]: r["class_id"] for r in rows if r["edited"]}
    assert set(edited) == {i for i in vectors if i % media.PLANTED == 0} and edited
    assert np.mean([own[i] == c for i, c in edited.items()]) >= 0.9
    cosine = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b))
    assert all(own[i] == i or cosine(vectors[i], vectors[own[i]]) > 0.9 for i in own)
