"""The SQL functions give what the Column functions give."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from docspark import dims, sql
from docspark.functions import geometry, nid, parse, text, verify

TEXTS = [
    None, "", " ", "a  b\tc", "٠١٢٣٤٥٦٧٨٩", "۱۹۹۹/٠٤/17", "17.4.1999", "1999-04-17 x", "19990417", "17041999", "20301341", "IJ4086874", "ij 40868 74", "IJ٣٣٠٥٥٩٩", "AB٢٠١٢٠٣٠٤",
    "29904170100119", "id 29904170100119 .", "0029904170100119", "39904170100119", "29913170100119", "29904179900119", "2990417", "59904170100119", "ذكر", "أنثى مسلمة", "انثى",
    "بطاقة تحقيق الشخصية محمدا احمد و علي", "جمهورية مصر العربية", "الاسم: خالدف ــ محمود", "ﬁne | text_", "شارع ١٢ ش القاهرة 12345", "'quoted' \\ text", "x" * 3000, "و ب محمد",
]
ONE = {
    "digits_to_western": text.digits_to_western, "strip_tatweel": text.strip_tatweel, "normalize_numeric": text.normalize_numeric, "squeeze": text.squeeze, "words": text.tokens,
    "nfkc": text.nfkc, "normalize_text": text.normalize_text, "parse_national_id": parse.parse_national_id, "parse_dob": parse.parse_dob, "parse_serial": parse.parse_serial,
    "parse_gender": parse.parse_gender, "is_header_token": parse.is_header_token, "parse_name": parse.parse_name, "nid_check_digit": nid.check_digit, "nid_birth_date": nid.birth_date,
    "nid_gender": nid.gender, "nid_governorate_code": nid.governorate_code, "governorate_name": nid.governorate_name, "verify_nid": verify.verify_national_id,
    "first_name": lambda c: parse.split_name(c)["first_name"], "last_name": lambda c: parse.split_name(c)["last_name"],
}
TWO = {"recover_nid": parse.recover_nid, "consistency": verify.consistency, "verify_dob": verify.verify_dob, "verify_gender": verify.verify_gender, "two_pass": verify.two_pass}


@pytest.fixture(scope="module")
def rows(spark):
    sql.register_all(spark)
    extra = [g[0] for g in dims.GOVERNORATES[:2]] + ["VALID", "INVALID_CHECKSUM", *dims.HEADER_KEYWORDS, *dims.NAME_CORRECTIONS["محمد"]]
    values = TEXTS + extra
    return spark.createDataFrame([(i, v, values[i * 7 % len(values)]) for i, v in enumerate(values)], "i int, a string, b string").cache()


@pytest.mark.parametrize("name", [*ONE, *TWO])
def test_same_as_columns(rows, name):
    call, want = (f"{name}(a)", ONE[name](F.col("a"))) if name in ONE else (f"{name}(a, b)", TWO[name](F.col("a"), F.col("b")))
    for r in rows.select("a", "b", F.expr(call).alias("got"), want.alias("want")).collect():
        assert r["got"] == r["want"], r


def test_of_several_kinds(rows):
    as_of = F.lit(date(2026, 1, 1))
    pairs = {
        "nid_status(a, DATE'2026-01-01')": nid.validate(F.col("a"), as_of)["status"],
        "parse_address(array(a, b, NULL))": parse.parse_address(F.array("a", "b", F.lit(None).cast("string"))),
        "recover_serial(a, b, 'FAILED')": parse.recover_serial(F.col("a"), F.col("b"), F.lit("FAILED")),
        "recover_serial(a, b, NULL)": parse.recover_serial(F.col("a"), F.col("b"), F.lit(None).cast("string")),
        "barcode_status(i % 2 = 0, i % 3 = 0, i % 5 = 0, a)": verify.barcode_state(F.expr("i % 2 = 0"), F.expr("i % 3 = 0"), F.expr("i % 5 = 0"), F.col("a"))["status"],
        "round(bbox_iou(i, 2, 5, 5, 3, i % 4, 9, 2), 9)": F.round(geometry.iou(*(F.expr(x).cast("double") for x in ("i", "2", "5", "5", "3", "i % 4", "9", "2"))), 9),
    }
    for r in rows.select(F.array(*[F.expr(k).cast("string") for k in pairs]).alias("got"), F.array(*[c.cast("string") for c in pairs.values()]).alias("want")).collect():
        assert r["got"] == r["want"]


def test_in_a_statement(spark, rows):
    rows.createOrReplaceTempView("readings")
    got = spark.sql("SELECT nid_status(a, DATE'2026-01-01') AS status, count(*) AS n FROM readings WHERE parse_gender(b) IS NULL GROUP BY 1 ORDER BY 1").collect()
    assert sum(r["n"] for r in got) > 0 and {"INVALID_FORMAT"} <= {r["status"] for r in got}
