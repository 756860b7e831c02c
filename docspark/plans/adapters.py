"""Views that give the test tables the shapes of the operators' inputs, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docspark import dims

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_TOTAL = " + ".join(f"CAST(substr(b, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate(dims.CHECK_WEIGHTS))
_CHECK = f"CASE WHEN 11 - ({_TOTAL}) % 11 >= 10 THEN (11 - ({_TOTAL}) % 11) % 10 ELSE 11 - ({_TOTAL}) % 11 END"
_Y, _M, _D = "CAST(year(o_orderdate) AS STRING)", "CAST(month(o_orderdate) AS STRING)", "CAST(day(o_orderdate) AS STRING)"
_M2, _D2 = f"lpad({_M}, 2, '0')", f"lpad({_D}, 2, '0')"
_ROW = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)"

VIEWS: dict[str, str] = {}

VIEWS["id_reads"] = f"""
SELECT rec, CASE k
  WHEN 0 THEN substr(f, 1, 3) || '13' || substr(f, 6)
  WHEN 1 THEN substr(f, 1, 3) || '0230' || substr(f, 8)
  WHEN 2 THEN substr(f, 1, 7) || '99' || substr(f, 10)
  WHEN 3 THEN '5' || substr(f, 2)
  WHEN 4 THEN substr(f, 1, 13) || CAST((CAST(substr(f, 14, 1) AS INT) + 1) % 10 AS STRING)
  WHEN 5 THEN substr(f, 1, 8)
  WHEN 6 THEN translate(f, '0123456789', '{dims.ARABIC_DIGITS}')
  WHEN 7 THEN substr(f, 1, 7) || '-' || substr(f, 8, 3) || ' ' || substr(f, 11)
  WHEN 8 THEN '3990417' || substr(f, 8)
  WHEN 9 THEN ''
  WHEN 10 THEN NULL
  ELSE f END AS raw
FROM (SELECT rec, k, b || CAST({_CHECK} AS STRING) AS f FROM (
  SELECT o_orderkey AS rec, o_orderkey % 13 AS k,
    (CASE WHEN year(o_orderdate) < 2000 THEN '2' ELSE '3' END) || substr({_Y}, 3, 2) || {_M2} || {_D2}
    || lpad(CAST(o_orderkey % 36 AS STRING), 2, '0') || lpad(CAST(o_custkey % 10000 AS STRING), 4, '0') AS b
  FROM orders) x) y"""

VIEWS["text_reads"] = """
SELECT doc_id AS rec, CASE WHEN doc_id % 37 = 0 THEN NULL WHEN doc_id % 41 = 0 THEN ''
  WHEN doc_id % 6 = 0 THEN substr(t, 1, 20) || 'ـــ' || substr(t, 21)
  WHEN doc_id % 6 = 1 THEN '٣٤۵ ' || t || ' ش و 12'
  WHEN doc_id % 6 = 2 THEN '| ' || substr(t, 1, 50) || ' _~^* ' || substr(t, 51) || ' 2990417170011'
  WHEN doc_id % 6 = 3 THEN '   ' || substr(t, 1, 30) || '    ' || chr(9) || substr(t, 31) || '  العنوان ' || substr(t, 1, 9)
  WHEN doc_id % 6 = 4 THEN 'جمهورية مصر العربية بطاقة تحقيق الشخصية الاسم محمدا و ' || t || ' خالدف'
  ELSE t || ' القاهرة 29904171700111' END AS raw
FROM (SELECT doc_id, text AS t FROM documents) d"""

VIEWS["dob_reads"] = f"""
SELECT o_orderkey AS rec, CASE o_orderkey % 14
  WHEN 0 THEN {_Y} || '/' || {_M} || '/' || {_D}
  WHEN 1 THEN {_D} || '/' || {_M} || '/' || {_Y}
  WHEN 2 THEN {_Y} || '-' || {_M2} || '-' || {_D2}
  WHEN 3 THEN {_D} || '.' || {_M} || '.' || {_Y}
  WHEN 4 THEN {_Y} || {_M2} || {_D2}
  WHEN 5 THEN {_D2} || {_M2} || {_Y}
  WHEN 6 THEN 'IJ4086874 ' || {_Y} || ' / ' || {_M} || ' / ' || {_D}
  WHEN 7 THEN '1990/13/45'
  WHEN 8 THEN translate({_Y} || '/' || {_M} || '/' || {_D}, '0123456789', '{dims.ARABIC_DIGITS}')
  WHEN 9 THEN CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE NULL END
  WHEN 10 THEN 'AB' || translate({_Y} || {_M2} || {_D2}, '0123456789', '{dims.ARABIC_DIGITS}')
  WHEN 11 THEN {_Y} || '\u00a0' || {_M} || '\u2003' || {_D}
  WHEN 12 THEN 'AB' || translate(substr({_Y}, 1, 2) || {_M2} || '1', '0123456789', '{dims.PERSIAN_DIGITS}') || ' ' || {_D} || '-' || {_M} || '-' || {_Y}
  ELSE 'BR6325226' END AS raw
FROM orders"""

VIEWS["serial_reads"] = """
SELECT p_partkey AS rec, CASE p_partkey % 9
  WHEN 0 THEN 'IJ' || lpad(CAST(p_partkey AS STRING), 7, '0')
  WHEN 1 THEN ' br ' || lpad(CAST(p_partkey AS STRING), 6, '5') || ' '
  WHEN 2 THEN 'A1234'
  WHEN 3 THEN 'xx-ABCD' || lpad(CAST(p_partkey AS STRING), 11, '7')
  WHEN 4 THEN p_name
  WHEN 5 THEN ''
  WHEN 6 THEN 'ij ' || translate(lpad(CAST(p_partkey AS STRING), 7, '0'), '0123456789', '٠١٢٣٤٥٦٧٨٩')
  WHEN 7 THEN 'x' || translate(lpad(CAST(p_partkey AS STRING), 6, '9'), '0123456789', '०१२३४५६७८९')
  ELSE NULL END AS raw
FROM part"""

VIEWS["gender_reads"] = """
SELECT c_custkey AS rec, CASE c_custkey % 7 WHEN 0 THEN 'الجنس ذكر' WHEN 1 THEN 'أنثى' WHEN 2 THEN 'انثـى' WHEN 3 THEN c_name
  WHEN 4 THEN NULL WHEN 5 THEN '' ELSE 'أنثى / ذكر' END AS raw,
  CASE c_custkey % 4 WHEN 0 THEN 'male' WHEN 1 THEN 'female' WHEN 2 THEN '' ELSE NULL END AS derived
FROM customer"""

VIEWS["cand"] = f"""
SELECT rec, field, CASE field WHEN 'national_id' THEN 'numeric' WHEN 'date_of_birth' THEN 'numeric' WHEN 'serial_number' THEN 'text' ELSE 'arabic_text' END AS field_type,
  CAST(ord % 3 AS INT) AS variant_ord, CAST(ord AS INT) AS cand_ord, confidence,
  CASE k % 3 WHEN 0 THEN 'paddleocr' WHEN 1 THEN 'paddleocr_multiline' ELSE 'paddleocr_segmented' END AS engine,
  CASE field
    WHEN 'national_id' THEN CASE k % 4 WHEN 0 THEN '29904171700111' WHEN 1 THEN '2990417170011' || CAST(k % 10 AS STRING) WHEN 2 THEN '123 456 78901' ELSE 'no 12' END
    WHEN 'date_of_birth' THEN CASE k % 3 WHEN 0 THEN '1999/4/17' WHEN 1 THEN '19990417' ELSE 'x9' END
    WHEN 'serial_number' THEN CASE k % 2 WHEN 0 THEN 'IJ' || lpad(CAST(k AS STRING), 7, '0') ELSE 'I J' END
    ELSE CASE k % 3 WHEN 0 THEN 'ab cd ef' WHEN 1 THEN 'a b cd ef ' ELSE 'abc' END END AS text
FROM (SELECT l_orderkey AS rec, l_suppkey AS k, {_ROW} AS ord, 0.5 + l_discount * 5 AS confidence,
  CASE l_partkey % 4 WHEN 0 THEN 'national_id' WHEN 1 THEN 'date_of_birth' WHEN 2 THEN 'serial_number' ELSE 'name' END AS field FROM lineitem) x"""

VIEWS["lines"] = f"""
SELECT l_orderkey AS rec, CASE l_partkey % 2 WHEN 0 THEN 'name' ELSE 'address' END AS field, CAST(l_suppkey % 2 AS INT) AS variant_ord,
  CAST({_ROW} AS INT) AS line_id, CASE WHEN l_partkey % 17 = 0 THEN ' ' ELSE ' w' || CAST(l_partkey AS STRING) END AS text,
  0.5 + l_discount * 5 AS confidence, l_quantity * 10 AS x, l_tax * 1000 AS y
FROM lineitem"""

VIEWS["det"] = f"""
SELECT rec, CAST(1 + (k + ord) % 10 - 1 AS INT) AS cls_id, scale, CAST(ord AS INT) AS det_ord,
  (k * 7 % 1500) * scale AS x0, (k * 13 % 900) * scale AS y0,
  (k * 7 % 1500 + 20 + q * 8) * scale AS x1, (k * 13 % 900 + 10 + q * 5) * scale AS y1, confidence, source
FROM (SELECT l_orderkey AS rec, l_partkey AS k, l_quantity AS q, {_ROW} AS ord, CASE WHEN l_suppkey % 2 = 0 THEN 1.0E0 ELSE 1.25E0 END AS scale,
  l_discount * 10 AS confidence, CASE WHEN l_linestatus = 'O' THEN 'found' ELSE 'anchor' END AS source FROM lineitem) x"""

VIEWS["quad"] = f"""
SELECT l_orderkey AS rec, CAST({_ROW} AS INT) AS quad_ord, 700 + l_quantity * 16 AS w, 400 + (l_partkey % 500) * 1.0E0 AS h,
  (700 + l_quantity * 16) * (400 + (l_partkey % 500)) * 0.9E0 AS area, 1600.0E0 AS canvas_w, 1200.0E0 AS canvas_h,
  (l_partkey % 300) * 1.0E0 AS x0, (l_suppkey % 200) * 1.0E0 AS y0, l_discount * 10 AS photo, l_tax * 10 AS barcode
FROM lineitem"""

VIEWS["field_reads"] = f"""
SELECT o.o_orderkey AS rec, f.field, f.field_type,
  CASE f.field
    WHEN 'national_id' THEN i.raw
    WHEN 'date_of_birth' THEN d.raw
    WHEN 'serial_number' THEN CASE o.o_orderkey % 3 WHEN 0 THEN 'IJ' || lpad(CAST(o.o_orderkey AS STRING), 7, '0') WHEN 1 THEN 'zz' ELSE NULL END
    WHEN 'name' THEN CASE o.o_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'بطاقة محمدا ' || c.c_mktsegment ELSE c.c_name || ' ' || c.c_mktsegment || ' x' END
    WHEN 'address' THEN CASE o.o_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'العنوان شارع 29904171700111 القاهرة' WHEN 2 THEN 'الجيزة 12' ELSE c.c_name END
    WHEN 'gender' THEN CASE o.o_custkey % 4 WHEN 0 THEN 'ذكر' WHEN 1 THEN 'أنثى' WHEN 2 THEN NULL ELSE 'x' END
    ELSE NULL END AS raw,
  CAST(o.o_totalprice - floor(o.o_totalprice / 101) * 101 AS DOUBLE) / 101.0E0 AS ocr_confidence,
  CASE WHEN (o.o_orderkey + f.ord) % 9 = 0 THEN NULL ELSE 0.9E0 END AS localization_confidence,
  (o.o_orderkey + f.ord) % 29 = 0 AS crop_empty, FALSE AS decoded, (o.o_orderkey + f.ord) % 23 <> 0 AS has_candidate
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN ({VIEWS["id_reads"]}) i ON i.rec = o.o_orderkey
JOIN ({VIEWS["dob_reads"]}) d ON d.rec = o.o_orderkey
JOIN ({dims.values_sql([(0, "national_id", "numeric"), (1, "name", "arabic_text"), (2, "address", "arabic_text"), (3, "date_of_birth", "numeric"), (4, "serial_number", "text"), (5, "gender", "arabic_text"), (6, "photo", "image_region"), (7, "barcode", "barcode")], "ord, field, field_type")}) f
  ON (o.o_orderkey + f.ord) % 17 <> 0"""

VIEWS["review_state"] = """
SELECT o_orderkey AS id, 'card_' || CAST(o_orderkey AS STRING) || '.jpg' AS original_filename,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'image/jpeg' END AS image_mime_type, '2' || lpad(CAST(o_orderkey AS STRING), 13, '0') AS national_id,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE c_name END AS full_name, n_name AS governorate,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS birth_date,
  CASE o_orderkey % 4 WHEN 0 THEN 'GOOD' WHEN 1 THEN 'Borderline' WHEN 2 THEN 'BAD' ELSE NULL END AS capture_quality,
  CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'F' THEN 'ACCEPTED' ELSE 'REJECTED' END AS review_status,
  CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS decision_note, 'v1' AS ocr_model_version, encode(c_name || CAST(o_orderkey AS STRING){utf8}) AS card_image
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""

VIEWS["review_req"] = """
SELECT event_id AS req, CASE WHEN event_id % 10 = 0 THEN -event_id ELSE user_id * 7 % 15000 END AS id,
  CASE WHEN event_id % 13 = 5 THEN NULL WHEN event_id % 17 = 3 THEN 'escalate' WHEN event_type IN ('error', 'signup') THEN 'reject' ELSE 'approve' END AS action,
  CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN '' ELSE 'blurred' END AS decision_note
FROM events"""

VIEWS["uploads"] = """
SELECT page_id AS rec, CASE page_id % 5 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/gif' ELSE 'image/jpeg' END AS mime,
  CASE WHEN page_id % 9 = 0 THEN 0 WHEN page_id % 7 = 0 THEN 15728640 WHEN page_id % 11 = 0 THEN 15728641 ELSE length(html) END AS size,
  url || CASE page_id % 6 WHEN 0 THEN '.JPG' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.txt' WHEN 3 THEN '.WebP' WHEN 4 THEN '.tif' ELSE '/a.png' END AS path, html
FROM pages"""

VIEWS["label_lines"] = """
SELECT p_partkey AS rec, CASE p_partkey % 5
  WHEN 0 THEN CAST(p_size % 9 AS STRING) || ' 0.' || CAST(100 + p_partkey % 800 AS STRING) || ' 0.5 0.25 0.' || CAST(10 + p_size AS STRING)
  WHEN 1 THEN ' ' || CAST(p_size % 9 AS STRING) || ' 0.1 0.1 0.5 0.1 0.5 0.5 0.1 0.5  '
  WHEN 2 THEN '1 0.5 0.5'
  WHEN 3 THEN ''
  ELSE CAST(p_size % 9 AS STRING) || ' 0.02 0.98 0.25 0.125' END AS line
FROM part"""

_LINE = f"""SELECT CAST(floor(l_orderkey / 8) AS BIGINT) AS rec, 'c' || CAST(l_partkey % 9 AS STRING) AS cls, (l_orderkey % 8) * 100 + {_ROW} AS ord, l_suppkey AS s, l_discount AS d,
  (l_partkey % 40) * 10.0E0 AS x, (l_partkey % 23) * 8.0E0 AS y, 120.0E0 + l_quantity * 8 AS w, 90.0E0 + l_quantity * 3 AS h FROM lineitem"""
#: Boxes that are there; a class of its own has none that is found.
VIEWS["eval_truth"] = f"SELECT rec, CASE WHEN ord % 100 = 5 THEN 'unseen' ELSE cls END AS cls, ord AS truth_ord, x AS x0, y AS y0, x + w AS x1, y + h AS y1 FROM ({_LINE}) l WHERE ord % 2 = 1"
#: Boxes that are found: near what is there, elsewhere, or twice; with many ties in their confidence.
VIEWS["eval_found"] = f"""
SELECT rec, CASE WHEN ord % 100 = 6 THEN 'made up' ELSE cls END AS cls, ord * 2 + twice AS det_ord, d * 10 - twice * 0.125E0 AS confidence,
  x + (s % 11) * w / 40 - twice * 2 AS x0, y + (s % 7) * h / 50 AS y0, x + (s % 11) * w / 40 + w AS x1, y + (s % 7) * h / 50 + h + twice * 3 AS y1
FROM (SELECT *, 0 AS twice FROM ({_LINE}) a UNION ALL SELECT *, 1 AS twice FROM ({_LINE}) b WHERE s % 3 = 0) l"""

#: What settles the order of an order's lines, up to the last column that their boxes depend on.
_SETTLES = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")

#: Uploads as they arrive in four turns: all once, some again at once, some in the next turn, after sixteen or eight days, or late.
VIEWS["arrivals"] = """
SELECT CAST(arrival AS INT) AS arrival, ts, img FROM (
  SELECT arrival, ts, img FROM (SELECT CAST(floor((day(ts) - 1) / 8) AS INT) AS arrival, ts, CAST(event_id AS STRING) || '|' || event_type || '|' || props AS img FROM events) a
  UNION ALL SELECT CAST(floor((day(ts) - 1) / 8) AS INT) + CASE event_id % 20 WHEN 0 THEN 0 WHEN 2 THEN 2 ELSE 1 END,
    ts + CASE event_id % 20 WHEN 1 THEN INTERVAL '1' HOUR WHEN 2 THEN INTERVAL '384' HOUR WHEN 3 THEN INTERVAL '192' HOUR ELSE INTERVAL '0' HOUR END,
    CAST(event_id AS STRING) || '|' || event_type || '|' || props || CASE event_id % 20 WHEN 4 THEN '|late' ELSE '' END FROM events WHERE event_id % 20 < 5) x
WHERE arrival < 4"""

#: What differs between the engines: how text becomes bytes.
_SPARK, _DUCK = {"{utf8}": ", 'utf-8'"}, {"{utf8}": ""}


def view_sql(name: str, duckdb: bool = False) -> str:
    sql = VIEWS[name]
    for k, v in (_DUCK if duckdb else _SPARK).items():
        sql = sql.replace(k, v)
    return sql


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the tables of a folder."""
    sql = view_sql(name)
    for t in TABLES:
        if t in sql:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(sql)


def eval_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``eval_found`` and ``eval_truth`` in the shape of ``evaluation.boxes``, dealt by rec in one pass over the lines.

    Lines that are equal up to l_discount make the same boxes, so the columns behind it need not settle their order.
    """
    lines = table(spark, sf_dir, "lineitem").selectExpr("CAST(floor(l_orderkey / 8) AS BIGINT) AS rec", "l_orderkey", *_SETTLES).repartition("rec")
    order = f"(l_orderkey % 8) * 100 + row_number() OVER (PARTITION BY rec, l_orderkey ORDER BY {', '.join(_SETTLES)}) AS ord"
    rows = lines.selectExpr("rec", "'c' || CAST(l_partkey % 9 AS STRING) AS cls", order, "l_suppkey AS s", "l_discount AS d", "(l_partkey % 40) * 10.0E0 AS x", "(l_partkey % 23) * 8.0E0 AS y", "120.0E0 + l_quantity * 8 AS w", "90.0E0 + l_quantity * 3 AS h")
    # -1: a box that is there
    each = rows.selectExpr("*", "explode(array(-1, 0, 1)) AS twice").where("CASE twice WHEN -1 THEN ord % 2 = 1 WHEN 0 THEN TRUE ELSE s % 3 = 0 END")
    either = lambda there, found, name: f"CASE WHEN twice < 0 THEN {there} ELSE {found} END AS {name}"
    return each.selectExpr(
        "rec",
        either("CASE WHEN ord % 100 = 5 THEN 'unseen' ELSE cls END", "CASE WHEN ord % 100 = 6 THEN 'made up' ELSE cls END", "cls"),
        "twice < 0 AS there",
        either("NULL", "d * 10 - twice * 0.125E0", "confidence"),
        either("ord", "ord * 2 + twice", "ord"),
        either("x", "x + (s % 11) * w / 40 - twice * 2", "x0"),
        either("y", "y + (s % 7) * h / 50", "y0"),
        either("x + w", "x + (s % 11) * w / 40 + w", "x1"),
        either("y + h", "y + (s % 7) * h / 50 + h + twice * 3", "y1"),
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
