"""The scalar functions on literal cases and against plain-Python rules."""

import calendar
import re
import unicodedata
from datetime import date

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docspark import dims
from docspark.functions import geometry, nid, parse, text, verify

AS_OF = date(2026, 1, 1)
WEST = str.maketrans(dims.ARABIC_DIGITS + dims.PERSIAN_DIGITS, "0123456789" * 2)


def apply(spark, column, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, raw {kind}")
    return [r[1] for r in sorted(rows.select("i", column(F.col("raw")).alias("out")).collect())]


def check(z13):
    c = 11 - sum(int(d) * w for d, w in zip(z13, dims.CHECK_WEIGHTS, strict=True)) % 11
    return c % 10 if c >= 10 else c


def number(century="2", yy="99", mm="04", dd="17", gov="01", serial="0011"):
    z = century + yy + mm + dd + gov + serial
    return z + str(check(z))


def test_digits_and_noise(spark):
    got = apply(spark, text.normalize_text, ["٠١٢٣٤٥٦٧٨٩", "۰۱۲۳", "ab١c", "مـــحمد", "a    b", None, "", " |_\\/~`^*x\t\ny ", "ﬁ"])
    assert got == ["0123456789", "0123", "ab1c", "محمد", "a b", "", "", "x y", "fi"]
    assert apply(spark, text.normalize_numeric, ["١٢-٣ ٤", None, "abc", "2 99-04"]) == ["1234", "", "", "29904"]
    assert apply(spark, text.strip_tatweel, ["ــ", None]) == ["", None]


@pytest.mark.parametrize("raw,status", [
    (number(), "VALID"), ("12345", "INVALID_FORMAT"), (number(mm="13"), "INVALID_DATE"), (number(mm="02", dd="30"), "INVALID_DATE"),
    (number(gov="99"), "INVALID_GOVERNORATE"), (number(century="5"), "INVALID_STRUCTURE"), (number()[:13] + str((int(number()[13]) + 1) % 10), "INVALID_CHECKSUM"),
    (number(century="3"), "INVALID_DATE"), (number().translate(str.maketrans("0123456789", dims.ARABIC_DIGITS)), "VALID"), ("", "INVALID_FORMAT"), (None, "INVALID_FORMAT"),
    ("2990230", "INVALID_DATE"), (number(serial="0000"), "VALID"),
])
def test_nid_status(spark, raw, status):
    got = apply(spark, lambda c: nid.validate(c, F.lit(AS_OF)), [raw])[0]
    assert got["status"] == status
    if status == "VALID":
        assert got["derived"]["birth_date"] == "1999-04-17" and got["derived"]["governorate_name"] == "القاهرة"
    assert got["warnings"] == (["serial_zeros"] if raw == number(serial="0000") else [])


def plain_nid(raw):
    z = re.sub(r"\D", "", (raw or "").translate(WEST))
    out = {"status": "INVALID_FORMAT", "born": None, "code": None, "gender": None}
    if not z:
        return out
    if len(z) >= 7 and z[0] in "23":
        y, m, d = int(z[1:3]) + (1900 if z[0] == "2" else 2000), int(z[3:5]), int(z[5:7])
        if not 1 <= m <= 12 or not 1 <= d <= calendar.monthrange(y, m)[1] or date(y, m, d) > AS_OF:
            return out | {"status": "INVALID_DATE"}
        out["born"] = date(y, m, d).isoformat()
    if len(z) >= 9 and z[7:9] in {g[0] for g in dims.GOVERNORATES}:
        out["code"] = z[7:9]
    if len(z) >= 13:
        out["gender"] = "male" if int(z[12]) % 2 else "female"
    if len(z) == 14:
        out["status"] = "INVALID_STRUCTURE" if z[0] not in "23" else "INVALID_GOVERNORATE" if not out["code"] else "VALID" if check(z[:13]) == int(z[13]) else "INVALID_CHECKSUM"
    return out


ids = st.one_of(st.none(), st.text("0123456789-٠٣ ", max_size=16), st.builds(number, st.sampled_from("235"), st.sampled_from(["99", "00", "25"]), st.sampled_from(["01", "02", "12", "13"]), st.sampled_from(["01", "29", "30", "31"]), st.sampled_from(["01", "88", "05"]), st.sampled_from(["0000", "0012", "9999"])))


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(ids, min_size=100, max_size=150))
def test_nid_rules(spark, values):
    for raw, got in zip(values, apply(spark, lambda c: nid.validate(c, F.lit(AS_OF)), values), strict=True):
        d = got["derived"]
        assert {"status": got["status"], "born": d["birth_date"], "code": d["governorate_code"], "gender": d["gender"]} == plain_nid(raw), raw


def plain_dob(raw):
    if not raw:
        return None
    plain = re.sub(r"[A-Z]{1,3}\d{5,9}", "", raw).strip()
    west, sep = plain.translate(WEST), r"[\s/\-\.]+"
    ok = lambda m, d: 1 <= int(m) <= 12 and 1 <= int(d) <= 31
    if (f := re.search(rf"(19\d{{2}}|20\d{{2}}){sep}(\d{{1,2}}){sep}(\d{{1,2}})", west)) and ok(f[2], f[3]):
        return f"{f[1]}-{f[2].zfill(2)}-{f[3].zfill(2)}"
    if (f := re.search(rf"(\d{{1,2}}){sep}(\d{{1,2}}){sep}(19\d{{2}}|20\d{{2}})", west)) and ok(f[2], f[1]):
        return f"{f[3]}-{f[2].zfill(2)}-{f[1].zfill(2)}"
    z = re.sub(r"\D", "", west)
    for y, m, d in ((z[:4], z[4:6], z[6:8]), (z[4:8], z[2:4], z[:2])) if len(z) >= 8 else ():
        if 1900 <= int(y) <= 2030 and ok(m, d):
            return f"{y}-{m}-{d}"
    return None


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.text("0129/-. IJ٣", max_size=14), st.from_regex(r"(19|20)[0-9]{2}[/.-][0-9]{1,2}[ /][0-9]{1,2}", fullmatch=True), st.from_regex(r"[0-3][0-9][01][0-9](19|20)[0-9]{2}", fullmatch=True)), min_size=80, max_size=120))
def test_dob_rules(spark, values):
    assert apply(spark, parse.parse_dob, values) == [plain_dob(v) for v in values]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def plain_header(w):
    return len(w) > 1 and (w in dims.HEADER_TOKENS or any(abs(len(w) - len(k)) <= 2 and distance(w, k) <= (1 if len(k) <= 5 else 2) for k in dims.HEADER_KEYWORDS))


def plain_text(raw):
    t = unicodedata.normalize("NFKC", raw or "").replace(dims.TATWEEL, "")
    return re.sub(r"\s+", " ", re.sub(dims.NOISE, " ", t).translate(WEST)).strip()


def plain_name(raw):
    t = plain_text(raw)
    for p in dims.NAME_PHRASES:
        t = t.replace(p, " ")
    for _ in range(6):
        t = re.sub("^(?:" + "|".join(dims.HEADER_PHRASES + dims.HEADER_WORDS) + r")[\s\-_/]*", "", t, flags=re.IGNORECASE).strip()
    fix = {w: right for right, wrongs in dims.NAME_CORRECTIONS.items() for w in wrongs}
    return " ".join(fix.get(w, w) for w in t.split() if (len(w) > 1 or w == "و") and not plain_header(w))


words = st.sampled_from(["محمدا", "احم", "خالدف", "و", "x", "بطاقة", "بطاقات", "تحقيقا", "الشخصيات", "جمهورية مصر العربية", "الاسم", "علي", "حسن", "مصطفىا", "الدخلية", "ـ", "12", "|"])


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(words, max_size=7).map(" ".join), min_size=60, max_size=90))
def test_names_with_near_misses(spark, values):
    assert apply(spark, parse.parse_name, values) == [plain_name(v) for v in values]


def test_header_tokens(spark):
    values = ["بطاقة", "بطاقا", "بطاا", "الشخصيات", "محمد", "و", "المدنيه", "الداخلة"]
    assert apply(spark, parse.is_header_token, values) == [plain_header(v) for v in values]


def test_parsers(spark):
    assert apply(spark, parse.parse_national_id, ["x29904171700111y", "000123", "9" * 20, None, "12029904171700111"]) == ["29904171700111", "123", "9" * 14, "", "20299041717001"]
    assert apply(spark, parse.parse_serial, [" ij 4086874 ", "A1234", None, "zzABCD12345678901"]) == ["IJ4086874", "", "", "BCD123456789"]
    assert apply(spark, parse.parse_gender, ["ذكر", "أنثى", "انثي", "أنثى ذكر", None, "x"]) == ["male", "female", "female", "male", None, None]
    assert apply(spark, parse.parse_address, [["العنوان شارع 5 ش", None, " ", "النيل 2990417"], []], "array<string>") == ["شارع ش النيل", ""]
    got = apply(spark, parse.split_name, ["a b  c", "a", "", None])
    assert [tuple(g) for g in got] == [("a", "b c"), ("a", None), (None, None), (None, None)]


def test_verification(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", ""), (None, "b"), (None, None), ("", "")], "a string, b string")
    got = rows.select(verify.consistency(F.col("a"), F.col("b")), verify.verify_dob(F.col("a"), F.col("b")), verify.verify_gender(F.col("a"), F.col("b")), verify.two_pass(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [
        ("MATCH", "CROSS_VALIDATED", "CROSS_VALIDATED", "AGREEMENT"),
        ("MISMATCH", "MISMATCH", "MISMATCH", "DISAGREEMENT"),
        ("INSUFFICIENT_EVIDENCE", "EXTRACTED", "EXTRACTED", "DISAGREEMENT"),
        ("INSUFFICIENT_EVIDENCE", "EXTRACTED", "FAILED", "INSUFFICIENT_EVIDENCE"),
        ("INSUFFICIENT_EVIDENCE", "FAILED", "FAILED", "INSUFFICIENT_EVIDENCE"),
        ("INSUFFICIENT_EVIDENCE", "FAILED", "FAILED", "AGREEMENT"),
    ]


def test_geometry(spark):
    one = spark.range(1)
    at = lambda *x: [F.lit(float(v)) for v in x]
    assert one.select(geometry.iou(*at(0, 0, 10, 10, 5, 0, 10, 10))).first()[0] == pytest.approx(1 / 3)
    assert one.select(geometry.iou(*at(0, 0, 0, 0, 0, 0, 0, 0))).first()[0] == 0
    assert one.select(geometry.box_to_polygon(*at(0.1, 0.5, 0.4, 0.2))).first()[0] == pytest.approx([0, 0.4, 0.3, 0.4, 0.3, 0.6, 0, 0.6])
    plan = one.select(geometry.resize_plan(*at(100, 50))).first()[0]
    assert (plan["scale"], plan["new_w"], plan["new_h"]) == (4.0, 400, 200)
    assert tuple(one.select(geometry.side(*at(0.05, 0.05))).first()[0]) == ("unknown", 0.0)
    assert tuple(one.select(geometry.side(*at(0.9, 0.1))).first()[0]) == ("front", 0.98)
