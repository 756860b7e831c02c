"""The cut of the pipeline does not depend on how the benchmark falls into blocks."""

from docspark.llm import decontaminate

WORDS = [f"w{i}" for i in range(1, 31)]


def test_clean_is_the_same_for_one_block_and_many(spark, monkeypatch):
    # two items that overlap in document 1, and in document 2 a window of the first that the cut of the second forms
    items = [(1, " ".join(WORDS[:12])), (2, " ".join(WORDS[7:20])), (3, " ".join(f"x{i}" for i in range(10)))]
    split = " ".join([*WORDS[:6], *(f"x{i}" for i in range(10)), *WORDS[6:12], "end"])
    docs = [(1, "lead " + " ".join(WORDS[:20]) + " tail", "a", 1), (2, split, "b", 1), (3, None, "c", None), (4, "nothing here", "d", 12)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, spans string, n_chars long")
    got = []
    for size in (decontaminate.BLOCK_BYTES, 1):
        for order in (items, items[::-1]):
            monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
            out = decontaminate.clean(frame, spark.createDataFrame(order, "item_id long, text string").coalesce(1))
            assert out.columns == frame.columns
            got.append(sorted(map(tuple, out.collect())))
    assert got[0] == [(1, "lead  tail", "a", 10), (2, " end", "b", 4), (3, None, "c", None), (4, "nothing here", "d", 12)]
    assert all(g == got[0] for g in got)
