"""Near words against all pairs; the header rules of names against their plain forms."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docspark import dims
from docspark.functions import parse, text
from docspark.operators import words


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.fixture(scope="module")
def some():
    rng = random.Random(7)
    make = lambda letters, most: "".join(rng.choice(letters) for _ in range(rng.randint(0, most)))
    return sorted({make("abé", 6) for _ in range(150)} | {make("بطاقة", 7) for _ in range(80)} | {"", "a", "😀b", "😀c"}), sorted({make("abé", 8) for _ in range(90)} | {"", "😀", "بطاقة"})


def test_all_pairs(spark, some):
    asked, listed = some
    budget = lambda w: 1 if len(w) <= 3 else 2
    rows = spark.createDataFrame([(w,) for w in [*asked, *asked[:20], None]], "word string")
    known = spark.createDataFrame([(w, budget(w)) for w in listed] + [(listed[-1], 0), (None, 2)], "word string, edits int")
    got = sorted(map(tuple, words.near_words(rows, known).collect()))
    assert got == sorted((a, b, n) for a in asked for b in listed if (n := edits(a, b)) <= budget(b))


def test_empty_sides(spark):
    one, none = spark.createDataFrame([("a",)], "word string"), spark.createDataFrame([], "word string, edits int")
    assert words.near_words(one, none).collect() == [] and words.near_words(one.limit(0), one.withColumn("edits", F.lit(1))).collect() == []


def test_forms(spark):
    got = spark.range(1).select(words.forms(F.lit("abca"))).first()[0]
    want = {"".join(c for i, c in enumerate("abca") if i not in {j, k}) for j in range(4) for k in range(4)} | {"abca"}
    assert set(got) == want and len(got) == len(want)


def test_a_long_list_has_the_same_plan(spark):
    plans = []
    for n in (8, 5000):
        listed = spark.range(n).select(F.concat(F.lit("w"), F.col("id")).alias("word"), F.lit(2).alias("edits"))
        plan = words.near_words(spark.createDataFrame([("w17",)], "word string"), listed)._jdf.queryExecution().optimizedPlan().toString()
        plans.append(re.findall(r"^[\s:+-]*(\w+)", plan, re.M))
    assert plans[0] == plans[1]


def test_header_tokens_are_near_as_before(spark):
    """The test by bytes before the edit distance leaves no near word out."""
    rng = random.Random(11)
    letters = "".join(sorted(set("".join(dims.HEADER_KEYWORDS)))) + "xé"
    given = set(dims.HEADER_KEYWORDS)
    for k in dims.HEADER_KEYWORDS:
        for _ in range(60):
            w = list(k)
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randint(0, 1)] = rng.choice(["", *letters])
            given.add("".join(w))
    rows = spark.createDataFrame([(w,) for w in sorted(given)], "w string").select("w", parse.is_header_token(F.col("w")).alias("x")).collect()
    for r in rows:
        w = r["w"]
        near = any(edits(w, k) <= (1 if len(k) <= 5 else 2) for k in dims.HEADER_KEYWORDS)
        assert r["x"] == (len(w) > 1 and (w in dims.HEADER_TOKENS or near)), w


def test_headers_at_once_are_six_rounds(spark):
    heads = ["جمهورية مصر العربية", "بطاقة", "تحقيق", "الرقم", "القومي", "-", "_", "/", "  ", "name"]
    rng = random.Random(5)
    given = [rng.choice(["", " ", "  "]) + rng.choice([" ", "", "-"]).join(rng.choice(heads) for _ in range(rng.randint(1, 10))) for _ in range(400)]
    plain = F.col("t")
    for _ in range(6):
        plain = F.trim(F.regexp_replace(plain, parse.HEADER, ""))
    rows = spark.createDataFrame([(t,) for t in given], "t string").select("t", plain.alias("a"), F.trim(F.regexp_replace("t", parse.HEADERS, "")).alias("b")).collect()
    assert [r["t"] for r in rows if r["a"] != r["b"]] == []


def test_folding_is_normalization_digits_and_tatweel(spark):
    given = ["", "plain", "٣٤۵ ـــ x", "ﬁ １２ ｱ", "x|_y   z ", "é ß", None]
    rows = spark.createDataFrame([(t,) for t in given], "t string").select(text.folded(F.col("t")).alias("a"), text.digits_to_western(text.strip_tatweel(text.nfkc(F.col("t")))).alias("b"), text.normalize_text(F.col("t")).alias("n"), text.squeeze(F.regexp_replace(F.coalesce(text.digits_to_western(text.strip_tatweel(text.nfkc(F.col("t")))), F.lit("")), dims.NOISE, " ")).alias("m")).collect()
    assert all(r["a"] == r["b"] and r["n"] == r["m"] for r in rows)
