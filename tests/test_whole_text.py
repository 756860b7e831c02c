"""The text view reads whole documents."""

from docspark.plans.adapters import view
from docspark.plans.queries import QUERIES


def test_text_reads_keep_every_word(spark, sf):
    raw = {r["rec"]: r["raw"] for r in view(spark, sf, "text_reads").collect()}
    long = [r for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r["text"] or "") > 200 and raw[r["doc_id"]]]
    assert {r["doc_id"] % 6 for r in long} == set(range(6))
    squeezed = lambda s: "".join(s.replace("ـ", "").replace("_~^*", "").split())
    assert all(squeezed(r["text"].replace("_~^*", "")) in squeezed(raw[r["doc_id"]]) for r in long)


def test_an_id_number_after_200_characters_is_read(spark, tmp_path):
    text = "lorem ipsum " * 40 + " 29904171700111 " + "dolor " * 30
    spark.createDataFrame([(4, text), (10, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["rec"]: r["recovered"] for r in QUERIES["recover_nid"](spark, str(tmp_path)).collect()}
    assert got == {4: "29904171700111", 10: "29904171700111"}
