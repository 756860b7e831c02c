"""The scalar functions as temporary SQL functions, which the optimizer inlines.

They take their patterns and word lists from where the Column functions have
them; only compatibility normalization (``nfkc``) goes through Python, and only
for text that is not ASCII.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docspark import dims
from docspark.functions import parse, text


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _pattern(p: str) -> str:
    return f"r'{p}'"


def _listed(words: list[str]) -> str:
    return ", ".join(map(_quoted, words))


def _mapped(pairs: list[tuple[str, str]]) -> str:
    return "map(" + ", ".join(f"{_quoted(k)}, {_quoted(v)}" for k, v in pairs) + ")"


def _without(x: str, phrases: list[str]) -> str:
    for p in phrases:
        x = f"replace({x}, {_quoted(p)}, ' ')"
    return x


def _unheaded(x: str) -> str:
    for _ in range(6):
        x = f"trim(regexp_replace({x}, {_pattern(parse.HEADER)}, ''))"
    return x


def _header_token(w: str) -> str:
    """As text, as a SQL function cannot be called within a lambda."""
    close = [f"(abs(length({w}) - {len(k)}) <= 2 AND levenshtein({w}, {_quoted(k)}) <= {1 if len(k) <= 5 else 2})" for k in dims.HEADER_KEYWORDS]
    return f"(length({w}) > 1 AND ({w} IN ({_listed(dims.HEADER_TOKENS)}) OR {' OR '.join(close)}))"


_WEST = f"translate(x, '{dims.ARABIC_DIGITS}{dims.PERSIAN_DIGITS}', '{'0123456789' * 2}')"
_SQUEEZE = r"trim(regexp_replace({}, r'(?U)\s+', ' '))"
_TOTAL = " + ".join(f"try_cast(substr(z, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate(dims.CHECK_WEIGHTS))
_FOUND, _REST = f"regexp_extract(z, {_pattern(parse.ID)}, 0)", "trim(LEADING '0' FROM z)"
_DATE = "iso_date(" + ", ".join(["regexp_extract(west, {0}, {1})", "regexp_extract(west, {0}, {2})", "regexp_extract(west, {0}, {3})"]) + ")"
_RUN = "CASE WHEN length(z) >= 8 AND try_cast(substr(z, {0}, 4) AS INT) BETWEEN 1900 AND 2030 THEN iso_date(substr(z, {0}, 4), substr(z, {1}, 2), substr(z, {2}, 2)) END"
_NO_SERIAL = f"regexp_replace(x, {_pattern(parse.SERIAL)}, '')"
_FIXES = _mapped([(wrong, right) for right, wrongs in dims.NAME_CORRECTIONS.items() for wrong in wrongs])
_OVERLAP = "greatest(0, least(ax + aw, bx + bw) - greatest(ax, bx)) * greatest(0, least(ay + ah, by + bh) - greatest(ay, by))"

#: Signature, then type and body; a function may call those before it.
FUNCTIONS = {
    "digits_to_western(x STRING)": ("STRING", _WEST),
    "strip_tatweel(x STRING)": ("STRING", f"replace(x, '{dims.TATWEEL}', '')"),
    "normalize_numeric(x STRING)": ("STRING", r"regexp_replace(digits_to_western(coalesce(x, '')), r'(?U)[^\d]', '')"),
    "squeeze(x STRING)": ("STRING", _SQUEEZE.format("x")),
    "words(x STRING)": ("ARRAY<STRING>", "filter(split(squeeze(x), ' '), w -> w <> '')"),
    "nfkc(x STRING)": ("STRING", r"coalesce(nfkc_in_python(CASE WHEN x RLIKE r'[^\x00-\x7F]' THEN x END), x)"),
    "normalize_text(x STRING)": ("STRING", f"squeeze(digits_to_western(regexp_replace(strip_tatweel(nfkc(coalesce(x, ''))), {_pattern(dims.NOISE)}, ' ')))"),
    # parsers
    "id_in_digits(z STRING)": ("STRING", f"CASE WHEN {_FOUND} <> '' THEN {_FOUND} WHEN length({_REST}) > 14 THEN right({_REST}, 14) ELSE {_REST} END"),
    "parse_national_id(x STRING)": ("STRING", "id_in_digits(normalize_numeric(x))"),
    "iso_date(y STRING, m STRING, d STRING)": ("STRING", "CASE WHEN try_cast(m AS INT) BETWEEN 1 AND 12 AND try_cast(d AS INT) BETWEEN 1 AND 31 THEN concat_ws('-', y, lpad(m, 2, '0'), lpad(d, 2, '0')) END"),
    "date_in_print(west STRING, z STRING)": ("STRING", f"coalesce({_DATE.format(_pattern(parse.YMD), 1, 2, 3)}, {_DATE.format(_pattern(parse.DMY), 3, 2, 1)}, {_RUN.format(1, 5, 7)}, {_RUN.format(5, 3, 1)})"),
    "parse_dob(x STRING)": ("STRING", f"date_in_print(digits_to_western({_NO_SERIAL}), normalize_numeric({_NO_SERIAL}))"),
    "parse_serial(x STRING)": ("STRING", f"coalesce(regexp_extract(replace(upper(trim(x)), ' ', ''), {_pattern(parse.SERIAL)}, 0), '')"),
    "gender_in_text(t STRING)": ("STRING", f"CASE WHEN contains(t, '{dims.MALE}') THEN 'male' WHEN contains(t, '{dims.FEMALE[0]}') OR contains(t, '{dims.FEMALE[1]}') THEN 'female' END"),
    "parse_gender(x STRING)": ("STRING", "gender_in_text(normalize_text(x))"),
    "is_header_token(w STRING)": ("BOOLEAN", _header_token("w")),
    "parse_name(x STRING)": ("STRING", f"array_join(transform(filter(words({_unheaded(_without('normalize_text(x)', dims.NAME_PHRASES))}), w -> (length(w) > 1 OR w = 'و') AND NOT {_header_token('w')}), w -> coalesce(try_element_at({_FIXES}, w), w)), ' ')"),
    "address_in_text(t STRING)": ("STRING", f"array_join(filter(words(trim(regexp_replace({_without('normalize_text(t)', dims.ADDRESS_PHRASES)}, {_pattern(parse.TRAILING)}, ''))), w -> (length(w) > 1 OR w IN ('و', 'ش')) AND w NOT IN ({_listed(dims.ADDRESS_TOKENS)})), ' ')"),
    "parse_address(lines ARRAY<STRING>)": ("STRING", f"address_in_text(array_join(filter(lines, t -> coalesce({_SQUEEZE.format('t')} <> '', false)), ' '))"),
    "first_name(x STRING)": ("STRING", "try_element_at(words(x), 1)"),
    "last_name(x STRING)": ("STRING", "CASE WHEN size(words(x)) > 1 THEN array_join(slice(words(x), 2, 1048576), ' ') END"),
    "recover_nid(address STRING, current STRING)": ("STRING", f"CASE WHEN coalesce(length(current), 0) <> 14 THEN nullif(regexp_extract(digits_to_western(address), {_pattern(parse.ID)}, 0), '') END"),
    "recover_serial(dob STRING, current STRING, status STRING)": ("STRING", "CASE WHEN coalesce(nullif(current, '') IS NULL OR status IN ('LOW_CONFIDENCE', 'FAILED'), true) THEN nullif(parse_serial(dob), '') END"),
    # id number, of 14 western digits
    "nid_check_digit(z STRING)": ("INT", f"(11 - ({_TOTAL}) % 11) % 10"),
    "nid_birth_date(z STRING)": ("DATE", "CASE WHEN length(z) >= 7 AND substr(z, 1, 1) IN ('2', '3') THEN try_cast(concat_ws('-', concat(CASE substr(z, 1, 1) WHEN '2' THEN '19' ELSE '20' END, substr(z, 2, 2)), substr(z, 4, 2), substr(z, 6, 2)) AS DATE) END"),
    "nid_gender(z STRING)": ("STRING", "CASE WHEN length(z) >= 13 THEN CASE WHEN try_cast(substr(z, 13, 1) AS INT) % 2 = 1 THEN 'male' ELSE 'female' END END"),
    "nid_governorate_code(z STRING)": ("STRING", f"CASE WHEN length(z) >= 9 AND substr(z, 8, 2) IN ({_listed([g[0] for g in dims.GOVERNORATES])}) THEN substr(z, 8, 2) END"),
    "governorate_name(code STRING)": ("STRING", f"try_element_at({_mapped([g[:2] for g in dims.GOVERNORATES])}, code)"),
    "status_of_digits(z STRING, as_of DATE)": ("STRING", """CASE WHEN length(z) = 0 THEN 'INVALID_FORMAT'
        WHEN length(z) >= 7 AND substr(z, 1, 1) IN ('2', '3') AND (nid_birth_date(z) IS NULL OR nid_birth_date(z) > as_of) THEN 'INVALID_DATE'
        WHEN length(z) <> 14 THEN 'INVALID_FORMAT' WHEN substr(z, 1, 1) NOT IN ('2', '3') THEN 'INVALID_STRUCTURE'
        WHEN nid_governorate_code(z) IS NULL THEN 'INVALID_GOVERNORATE'
        WHEN nid_check_digit(z) <> try_cast(substr(z, 14, 1) AS INT) THEN 'INVALID_CHECKSUM' ELSE 'VALID' END"""),
    "nid_status(raw STRING, as_of DATE)": ("STRING", "status_of_digits(normalize_numeric(raw), as_of)"),
    # checks between fields
    "consistency(a STRING, b STRING)": ("STRING", "CASE WHEN coalesce(a, '') = '' OR coalesce(b, '') = '' THEN 'INSUFFICIENT_EVIDENCE' WHEN a = b THEN 'MATCH' ELSE 'MISMATCH' END"),
    "verify_nid(status STRING)": ("STRING", "CASE status WHEN 'VALID' THEN 'VERIFIED' WHEN 'INVALID_CHECKSUM' THEN 'LOW_CONFIDENCE' ELSE 'FAILED' END"),
    "verify_dob(a STRING, b STRING)": ("STRING", "CASE WHEN nullif(a, '') = nullif(b, '') THEN 'CROSS_VALIDATED' WHEN nullif(a, '') IS NOT NULL AND nullif(b, '') IS NOT NULL THEN 'MISMATCH' WHEN nullif(a, '') IS NOT NULL OR nullif(b, '') IS NOT NULL THEN 'EXTRACTED' ELSE 'FAILED' END"),
    "verify_gender(a STRING, b STRING)": ("STRING", "CASE WHEN nullif(a, '') = nullif(b, '') THEN 'CROSS_VALIDATED' WHEN nullif(a, '') IS NOT NULL AND nullif(b, '') IS NOT NULL THEN 'MISMATCH' WHEN nullif(a, '') IS NOT NULL THEN 'EXTRACTED' ELSE 'FAILED' END"),
    "two_pass(a STRING, b STRING)": ("STRING", "CASE WHEN a IS NULL OR b IS NULL THEN 'INSUFFICIENT_EVIDENCE' WHEN a = b THEN 'AGREEMENT' ELSE 'DISAGREEMENT' END"),
    "barcode_status(present BOOLEAN, library BOOLEAN, failed BOOLEAN, payload STRING)": ("STRING", "CASE WHEN NOT present THEN 'barcode_not_detected' WHEN NOT library OR failed THEN 'barcode_detected' WHEN payload IS NULL THEN 'barcode_not_decoded' ELSE 'barcode_decoded' END"),
    "stored_quality(s STRING)": ("STRING", "CASE s WHEN 'good' THEN 'GOOD' WHEN 'acceptable' THEN 'BORDERLINE' WHEN 'poor' THEN 'BAD' END"),
    "bbox_iou(ax DOUBLE, ay DOUBLE, aw DOUBLE, ah DOUBLE, bx DOUBLE, by DOUBLE, bw DOUBLE, bh DOUBLE)": ("DOUBLE", f"coalesce({_OVERLAP} / nullif(aw * ah + bw * bh - {_OVERLAP}, 0), 0)"),
}


def register_all(spark: SparkSession) -> None:
    spark.udf.register("nfkc_in_python", text.nfkc_in_python)
    for signature, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
    dims.governorates(spark).createOrReplaceTempView("governorates")
    dims.templates(spark).createOrReplaceTempView("templates")
    dims.classes(spark).createOrReplaceTempView("classes")
    dims.variants(spark).createOrReplaceTempView("variants")


#: Functions that give tables: signature, columns and body. ``reviewed`` is the view of stored records.
TABLES = {
    "portal_search(query STRING, wanted STRING)": (
        "id BIGINT, national_id STRING, full_name STRING, governorate STRING, review_status STRING",
        """SELECT r.id, r.national_id, r.full_name, r.governorate, r.review_status FROM reviewed r
        WHERE (contains(lower(coalesce(r.full_name, '')), lower(trim(query))) OR contains(lower(coalesce(r.national_id, '')), lower(trim(query))) OR contains(lower(coalesce(r.governorate, '')), lower(trim(query))))
        AND (wanted = 'ALL' OR upper(r.review_status) = wanted)""",
    ),
    "template_fields(wanted STRING)": ("ord INT, field STRING, field_type STRING, required BOOLEAN", "SELECT t.ord, t.field, t.field_type, t.required FROM templates t WHERE t.side = wanted"),
    "id_checks(raw STRING, as_of DATE)": (
        "place INT, part STRING, value STRING",
        """SELECT k AS place, element_at(array('status', 'birth_date', 'gender', 'governorate'), k) AS part,
        CASE k WHEN 1 THEN nid_status(raw, as_of) WHEN 2 THEN CASE WHEN nid_status(raw, as_of) <> 'INVALID_DATE' THEN CAST(nid_birth_date(normalize_numeric(raw)) AS STRING) END
        WHEN 3 THEN CASE WHEN nid_status(raw, as_of) <> 'INVALID_DATE' THEN nid_gender(normalize_numeric(raw)) END
        ELSE CASE WHEN nid_status(raw, as_of) <> 'INVALID_DATE' THEN governorate_name(nid_governorate_code(normalize_numeric(raw))) END END AS value FROM VALUES (1), (2), (3), (4) AS n(k)""",
    ),
}

#: Folds of what ``collect_list`` gathers of a small group.
FOLDS = {
    "combined(found ARRAY<STRUCT<line_ord: INT, text: STRING, confidence: DOUBLE>>)": (
        "STRUCT<text: STRING, confidence: DOUBLE>",
        "named_struct('text', array_join(transform(array_sort(found), x -> x.text), ' '), 'confidence', aggregate(array_sort(found), 0.0D, (s, x) -> s + x.confidence) / nullif(size(found), 0))",
    ),
}


def register_tables(spark: SparkSession, reviewed: DataFrame) -> None:
    """The functions that give tables, and the folds, beside the scalar ones they call."""
    register_all(spark)
    reviewed.createOrReplaceTempView("reviewed")
    for signature, (columns, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS TABLE ({columns}) RETURN {body}")
    for signature, (kind, body) in FOLDS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
