"""Every operator on odd rows and on empty tables: defined results, no crash."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docspark.llm import decontaminate, huffman, language, media, packing, sharding, simhash, substrings, toxicity, warc
from docspark.llm.common import scratch

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BENCH = "item_id long, text string"
LABELS = "doc_id long, quality int, toxic int"


def test_simhash(odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: (r["fp"], r["component_id"]) for r in got}
    assert by[2] == by[3] == by[4] == (0, 2)  # no words
    assert by[1] == by[5] == by[None] and by[5][1] == 1
    assert by[6][1] == 6
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.kept(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, None, 6, 7, 8, 9, 10, 11}


def test_sharding(odd, none):
    rows = sharding.shard(odd, shards=3).collect()
    assert len(rows) == odd.count()
    slots = {s: sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(3)}
    assert all(v == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] == 2} == {(8, 0)}
    assert sharding.shard(none).count() == 0


def test_token_files(spark, odd, none):
    folder = scratch(spark, "t")
    manifest = huffman.write(odd, folder, TOKENIZER)
    rows = huffman.read(spark, folder, manifest).orderBy("start").collect()
    assert len(rows) == odd.count() and rows[0]["doc_id"] is None
    at = 0
    for r in rows:
        assert r["start"] == at
        at += len(r["ids"]) // 4
        assert np.frombuffer(r["ids"], "<u4")[-1] == huffman.END
    assert {len(r["ids"]) for r in rows if r["doc_id"] in (2, 3, 4)} == {4}
    empty = scratch(spark, "t")
    assert huffman.read(spark, empty, huffman.write(none, empty, TOKENIZER)).count() == 0


def test_packing(odd, none):
    rows = packing.packed(odd, TOKENIZER).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.SIZE
    assert sorted(by) == list(range(len(by)))
    assert sum(r["length"] for r in rows if r["doc_id"] == 2) == 1
    assert sum(1 for r in rows if r["doc_id"] == 5) == 2  # repeated rows are packed as often as they come
    assert packing.packed(none, TOKENIZER).count() == 0
    assert packing.sequences(packing.packed(odd, TOKENIZER)).agg(F.sum("used")).first()[0] == sum(r["length"] for r in rows)


def test_decontamination(spark, odd, none):
    bench = spark.createDataFrame([(1, "Quick BROWN fox"), (None, "lazy dog"), (2, None), (3, ""), (1, "quick brown fox"), (4, " ".join(f"p{i}" for i in range(5, 20)))], BENCH)
    got = {r["doc_id"]: r for r in decontaminate.find(odd, bench).collect()}
    assert [tuple(s) for s in got[1]["spans"]] == [(1, 4), (7, 9)] and got[1]["items"] == [1]
    assert got[2]["n_words"] == 0 and got[2]["spans"] == [] and got[6]["n_words"] == 60000
    assert got[7]["items"] == [4] and sum(b - a for a, b in got[7]["spans"]) == 15
    assert decontaminate.find(none, bench).count() == 0
    assert {tuple(r["spans"]) for r in decontaminate.find(odd, bench.limit(0)).collect()} == {()}
    clean = decontaminate.clean(odd, bench)
    assert clean.schema == odd.schema and clean.count() == odd.count()
    assert clean.where("doc_id = 1").first()["text"] == "the  jumps over the "
    assert decontaminate.find(clean, bench).where("size(spans) > 0").count() == 0


@pytest.mark.parametrize("hot", [0, 4096])
def test_substrings(odd, none, hot, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", hot)
    out = substrings.dedup(odd, counts=("total", "removed"))
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert {k: v[0]["removed"] for k, v in got.items() if k not in (6, 8)} == {k: 0 for k in got if k not in (6, 8)}
    assert got[8][0]["removed"] == 40 and got[8][0]["text"] == "other end" and got[8][0]["n_chars"] == 9
    assert got[6][0]["removed"] > 50000  # its own second period repeats the first
    assert len(got[5]) == 2 and got[2][0]["text"] is None and got[4][0]["text"] == " \t\n "
    assert substrings.dedup(odd).columns == odd.columns
    assert substrings.dedup(none).count() == 0


def test_toxicity(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (7, 1, None), (None, 0, 1), (11, 0, 1), (11, 0, 0), (9, 1, 0)], LABELS)
    model = toxicity.fit(odd, labels)
    rows = toxicity.score(odd, model, "doc_id").collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    for few in (labels.limit(0), labels.where("toxic = 0")):
        assert {r["score"] for r in toxicity.score(odd, toxicity.fit(odd, few), "doc_id").collect()} == {0.0}
    assert toxicity.score(none, model).count() == 0 and toxicity.fit(none, labels).trees is None
    assert toxicity.kept(odd, labels.limit(0)).columns == odd.columns and toxicity.kept(odd, labels.limit(0)).count() == odd.count()


def test_language(odd, none):
    model = language.fit(odd)
    got = {r["doc_id"]: r for r in language.predict(odd, model).collect()}
    assert model.languages == ["de", "en", "fr"]
    assert {got[k]["lang_pred"] for k in (2, 3, 4, 10)} == {"und"} and {got[k]["score"] for k in (2, 3, 4, 10)} == {0.0}
    assert got[9]["lang_pred"] != "und" and 0 < got[6]["score"] <= 1
    assert language.predict(none, model).count() == 0
    assert {r["lang_pred"] for r in language.predict(odd, language.fit(none)).collect()} == {"und"}


def test_warc(spark):
    kind = "page_id long, url string, html string, payload string, sha string"
    pages = spark.createDataFrame([(1, "http://a/b c", "x", "", ""), (2, None, "x", "", ""), (3, "u\r\nX: y", None, "", ""), (4, "u", "", "", ""), (None, "u", "x", "", ""), (2, None, "x", "", ""), (7, "é", "é" * 300000, "", ""), (None, "n", "only", "", ""), (None, "n", "only", "", "")], kind)
    a, b = scratch(spark, "w"), scratch(spark, "w")
    warc.write(pages, a)
    assert warc.normalise(spark, a, b).agg(F.sum("records")).first()[0] == 9
    rows = warc.read(spark, b).collect()
    got = sorted(((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in rows), key=str)
    assert got == sorted([(1, "revisit", 2, 1), (2, "response", None, 1), (2, "response", None, 1), (3, "revisit", 4, 0), (4, "response", None, 0), (0, "revisit", 2, 1), (7, "response", None, 600000), (0, "response", None, 4), (0, "response", None, 4)], key=str)
    assert {r["url"] for r in rows if r["page_id"] == 3} == {"u%0D%0AX:%20y"} and {r["url"] for r in rows if r["page_id"] == 2} == {None}
    assert warc.write(pages.limit(0), scratch(spark, "w")).isEmpty()


def test_media(spark):
    rng = np.random.default_rng(3)
    first, other = (media.resized(rng.normal(128, 60, (9, 9)), 90, 90) for _ in range(2))
    images = [(1, media.encoded(first)), (2, media.encoded(first)), (3, media.encoded(first[5:86, 4:87])), (4, media.encoded(np.rot90(first))), (5, media.encoded(np.clip(first * 1.1 + 4, 0, 255))), (6, media.encoded(other)), (7, None), (8, b"no image"), (9, b"no image"), (10, b""), (None, media.encoded(other)), (11, media.encoded(np.zeros((3, 3)))), (12, media.encoded(np.zeros((50, 50)))), (13, None)]
    frame = spark.createDataFrame([(i, b, 1, "x") for i, b in images], "id long, image binary, links int, content string")
    got = {r["id"]: r["class_id"] for r in media.copies(frame).collect()}
    assert {got[k] for k in (1, 2, 3, 4, 5)} == {1}
    assert got[6] == got[None] == 6 and got[8] == got[9] == 8 and (got[7], got[10], got[11], got[12], got[13]) == (7, 10, 11, 12, 13)
    assert media.copies(frame.limit(0)).count() == 0


def test_stages_on_odd_rows(spark, odd, none, tmp_path):
    """Each stage on the odd rows and on none; all but the last keep the columns."""
    odd.createOrReplaceTempView("odd_rows")
    spark.createDataFrame([(1, "lazy dog jumps")], BENCH).write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1, 0), (11, 0, 1)], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd, none):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
            assert (out.count() == 0) == (docs is none)


def test_checksums_are_of_little_endian_ids(plain):
    row = packing.packed(plain.limit(3), TOKENIZER).select("ids", F.crc32("ids").alias("c")).first()
    assert row["c"] == zlib.crc32(bytes(row["ids"]))
