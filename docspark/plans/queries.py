"""The queries over the test tables, each with a separately written DuckDB form where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark import dims
from docspark.functions import geometry, nid, parse, text, verify
from docspark.operators import candidates, detections, signals
from docspark.plans.adapters import table, view, view_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The day that the id numbers are held against, so that results stay the same.
AS_OF = date(2026, 1, 1)
AS_OF_SQL = f"DATE '{AS_OF}'"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def v(name: str) -> str:
    return f"({view_sql(name, duckdb=True)})"


def as_of() -> Column:
    return F.lit(AS_OF)


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(c, digits)


# --- SQL forms of the functions, for DuckDB -------------------------------------------------------


def q_west(x: str) -> str:
    return f"translate({x}, '{dims.ARABIC_DIGITS}{dims.PERSIAN_DIGITS}', '01234567890123456789')"


def q_num(x: str) -> str:
    return f"regexp_replace({q_west(f'coalesce({x}, chr(32))')}, '[^0-9]', '', 'g')"


def q_norm(x: str) -> str:
    noise = "'[|_\\\\/~`^*]+'"
    plain = f"regexp_replace(replace(coalesce({x}, ''), '{dims.TATWEEL}', ''), {noise}, ' ', 'g')"
    return f"trim(regexp_replace({q_west(plain)}, '\\s+', ' ', 'g'))"


def q_pnid(x: str) -> str:
    z = q_num(x)
    rest = f"ltrim({z}, '0')"
    return f"CASE WHEN regexp_matches({z}, '[23][0-9]{{13}}') THEN regexp_extract({z}, '[23][0-9]{{13}}') WHEN length({rest}) > 14 THEN right({rest}, 14) ELSE {rest} END"


def q_serial(x: str) -> str:
    return f"coalesce(regexp_extract(replace(upper(trim({x})), ' ', ''), '[A-Z]{{1,3}}\\p{{Nd}}{{5,9}}'), '')"


def q_dob(x: str) -> str:
    plain = f"regexp_replace({x}, '[A-Z]{{1,3}}\\p{{Nd}}{{5,9}}', '', 'g')"
    west, z = q_west(plain), q_num(plain)
    sep = "[\\s\\p{Z}/\\-.]+"
    ymd, dmy = f"(19[0-9]{{2}}|20[0-9]{{2}}){sep}([0-9]{{1,2}}){sep}([0-9]{{1,2}})", f"([0-9]{{1,2}}){sep}([0-9]{{1,2}}){sep}(19[0-9]{{2}}|20[0-9]{{2}})"
    got = lambda p, k: f"regexp_extract({west}, '{p}', {k})"
    number = lambda s: f"try_cast({s} AS INTEGER)"

    def iso(y: str, m: str, d: str, more: str) -> str:
        return f"WHEN {more} AND {number(m)} BETWEEN 1 AND 12 AND {number(d)} BETWEEN 1 AND 31 THEN {y} || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0')"

    sub = lambda a, n: f"substr({z}, {a}, {n})"
    run = lambda y: f"length({z}) >= 8 AND {number(y)} BETWEEN 1900 AND 2030"
    return f"""CASE WHEN {x} IS NULL THEN NULL {iso(got(ymd, 1), got(ymd, 2), got(ymd, 3), "TRUE")} {iso(got(dmy, 3), got(dmy, 2), got(dmy, 1), "TRUE")}
      {iso(sub(1, 4), sub(5, 2), sub(7, 2), run(sub(1, 4)))} {iso(sub(5, 4), sub(3, 2), sub(1, 2), run(sub(5, 4)))} END"""


def q_gender(x: str) -> str:
    t = q_norm(x)
    return f"CASE WHEN contains({t}, '{dims.MALE}') THEN 'male' WHEN contains({t}, '{dims.FEMALE[0]}') OR contains({t}, '{dims.FEMALE[1]}') THEN 'female' END"


def q_words(x: str) -> str:
    return f"list_filter(string_split(trim(regexp_replace({x}, '\\s+', ' ', 'g')), ' '), lambda w: w <> '')"


def q_list(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def q_name(x: str) -> str:
    """Without the near misses of header words, which the inputs do not have: DuckDB counts edits in bytes."""
    t = q_norm(x)
    for p in dims.NAME_PHRASES:
        t = f"replace({t}, '{p}', ' ')"
    for _ in range(6):
        t = f"trim(regexp_replace({t}, '(?i)^(?:{'|'.join(dims.HEADER_PHRASES + dims.HEADER_WORDS)})[\\s\\-_/]*', ''))"
    fix = "CASE " + " ".join(f"WHEN w IN {q_list(wrongs)} THEN '{right}'" for right, wrongs in dims.NAME_CORRECTIONS.items()) + " ELSE w END"
    return f"array_to_string(list_transform(list_filter({q_words(t)}, lambda w: (length(w) > 1 OR w = 'و') AND w NOT IN {q_list(dims.HEADER_TOKENS)}), lambda w: {fix}), ' ')"


def q_address(x: str) -> str:
    """Of one line."""
    t = q_norm(x)
    for p in dims.ADDRESS_PHRASES:
        t = f"replace({t}, '{p}', ' ')"
    t = f"trim(regexp_replace({t}, '[\\s0-9٠-٩]{{4,}}$', ''))"
    return f"array_to_string(list_filter({q_words(t)}, lambda w: (length(w) > 1 OR w IN ('و', 'ش')) AND w NOT IN {q_list(dims.ADDRESS_TOKENS)}), ' ')"


def q_gov(code: str) -> str:
    return "CASE " + code + " " + " ".join(f"WHEN '{c}' THEN '{n}'" for c, n, _ in dims.GOVERNORATES) + " END"


def q_check(z: str) -> str:
    total = " + ".join(f"coalesce(try_cast(substr({z}, {i + 1}, 1) AS INTEGER), 0) * {w}" for i, w in enumerate(dims.CHECK_WEIGHTS))
    return f"(CASE WHEN 11 - ({total}) % 11 >= 10 THEN (11 - ({total}) % 11) % 10 ELSE 11 - ({total}) % 11 END)"


def q_nid(source: str, columns: str, raw: str = "raw") -> str:
    """columns, z, status, birth_date, gov_code, gov_name and gender of each row of ``source``."""
    born = "try_cast((CASE substr(z, 1, 1) WHEN '2' THEN '19' ELSE '20' END) || substr(z, 2, 2) || '-' || substr(z, 4, 2) || '-' || substr(z, 6, 2) AS DATE)"
    codes = q_list([c for c, _, _ in dims.GOVERNORATES])
    return f"""(SELECT {columns}, z, status, CASE WHEN going AND dated THEN CAST(born AS VARCHAR) END AS birth_date, CASE WHEN going THEN code END AS gov_code,
      CASE WHEN going THEN {q_gov("code")} END AS gov_name, CASE WHEN going AND length(z) >= 13 THEN CASE WHEN CAST(substr(z, 13, 1) AS INTEGER) % 2 = 1 THEN 'male' ELSE 'female' END END AS gender
    FROM (SELECT *, status <> 'INVALID_DATE' AND z <> '' AS going FROM (SELECT *, CASE WHEN z = '' THEN 'INVALID_FORMAT'
      WHEN dated AND (born IS NULL OR born > {AS_OF_SQL}) THEN 'INVALID_DATE' WHEN length(z) <> 14 THEN 'INVALID_FORMAT' WHEN substr(z, 1, 1) NOT IN ('2', '3') THEN 'INVALID_STRUCTURE'
      WHEN code IS NULL THEN 'INVALID_GOVERNORATE' WHEN {q_check("z")} <> CAST(substr(z, 14, 1) AS INTEGER) THEN 'INVALID_CHECKSUM' ELSE 'VALID' END AS status
    FROM (SELECT *, length(z) >= 7 AND substr(z, 1, 1) IN ('2', '3') AS dated, CASE WHEN length(z) >= 7 AND substr(z, 1, 1) IN ('2', '3') THEN {born} END AS born,
      CASE WHEN length(z) >= 9 AND substr(z, 8, 2) IN {codes} THEN substr(z, 8, 2) END AS code
    FROM (SELECT *, {q_num(raw)} AS z FROM {source} s0) s1) s2) s3) s4)"""


def on(key: str, view_name: str, sql: str, columns: Callable[[Column], dict[str, Column]]) -> None:
    """A query that puts columns, made from the raw text, beside rec of a view."""
    query(key, sql)(lambda spark, d: view(spark, d, view_name).select("rec", *[c.alias(k) for k, c in columns(F.col("raw")).items()]))


def raw_() -> Column:
    return F.col("raw")


def _validated(spark: SparkSession, d: str) -> DataFrame:
    return nid.validated(view(spark, d, "id_reads"), raw_(), as_of(), "r")


# --- scalars --------------------------------------------------------------------------------------

on("digits_western", "text_reads", f"SELECT rec, {q_west('raw')} AS western FROM {v('text_reads')} t", lambda raw: dict(western=text.digits_to_western(raw)))
on("strip_tatweel", "text_reads", f"SELECT rec, replace(raw, '{dims.TATWEEL}', '') AS plain FROM {v('text_reads')} t", lambda raw: dict(plain=text.strip_tatweel(raw)))
on("normalize_text", "text_reads", f"SELECT rec, {q_norm('raw')} AS normalized FROM {v('text_reads')} t", lambda raw: dict(normalized=text.normalize_text(raw)))
on("normalize_numeric", "id_reads", f"SELECT rec, {q_num('raw')} AS normalized FROM {v('id_reads')} t", lambda raw: dict(normalized=text.normalize_numeric(raw)))
on("field_value", "text_reads", f"SELECT rec, raw, {q_norm('raw')} AS normalized, {q_num('raw')} AS digits FROM {v('text_reads')} t", lambda raw: dict(raw=text.field_value(raw)["raw"], normalized=text.field_value(raw)["normalized"], digits=text.field_value(raw, True)["normalized"]))
on("parse_nid", "text_reads", f"SELECT rec, {q_pnid('raw')} AS national_id FROM {v('text_reads')} t", lambda raw: dict(national_id=parse.parse_national_id(raw)))
on("parse_dob", "dob_reads", f"SELECT rec, {q_dob('raw')} AS dob FROM {v('dob_reads')} t", lambda raw: dict(dob=parse.parse_dob(raw)))
on("parse_serial", "serial_reads", f"SELECT rec, {q_serial('raw')} AS serial FROM {v('serial_reads')} t", lambda raw: dict(serial=parse.parse_serial(raw)))
on("parse_gender", "gender_reads", f"SELECT rec, {q_gender('raw')} AS gender FROM {v('gender_reads')} t", lambda raw: dict(gender=parse.parse_gender(raw)))
on("parse_name", "text_reads", f"SELECT rec, {q_name('raw')} AS name FROM {v('text_reads')} t", lambda raw: dict(name=parse.parse_name(raw)))
on("parse_address", "text_reads", f"SELECT rec, {q_address('raw')} AS address FROM {v('text_reads')} t", lambda raw: dict(address=parse.parse_address(F.array(raw))))
on(
    "name_split", "text_reads",
    f"SELECT rec, w[1] AS first_name, CASE WHEN len(w) > 1 THEN array_to_string(w[2:], ' ') END AS last_name FROM (SELECT rec, {q_words(q_norm('raw'))} AS w FROM {v('text_reads')} t) x",
    lambda raw: dict(first_name=parse.split_name(text.normalize_text(raw))["first_name"], last_name=parse.split_name(text.normalize_text(raw))["last_name"]),
)
on(
    "recover_nid", "text_reads",
    f"SELECT rec, CASE WHEN rec % 2 = 0 THEN nullif(regexp_extract({q_west('raw')}, '[23][0-9]{{13}}'), '') END AS recovered FROM {v('text_reads')} t",
    lambda raw: dict(recovered=parse.recover_nid(raw, F.when(F.col("rec") % 2 == 0, F.lit("123")).otherwise(F.lit("1" * 14)))),
)
on(
    "recover_serial", "serial_reads",
    f"SELECT rec, CASE WHEN rec % 3 <> 2 THEN nullif({q_serial('raw')}, '') END AS recovered FROM {v('serial_reads')} t",
    lambda raw: dict(recovered=parse.recover_serial(raw, F.when(F.col("rec") % 3 == 0, "").otherwise("AB12345"), F.when(F.col("rec") % 3 == 1, "FAILED").otherwise("EXTRACTED"))),
)

_WORDS, _KEYS = ["header", "card", "the"], ["republic", "ident", "personal"]


@query("header_token", f"""SELECT w, n, length(w) > 1 AND (w IN {q_list(_WORDS)} OR {' OR '.join(f"(abs(length(w) - {len(k)}) <= 2 AND levenshtein(w, '{k}') <= {1 if len(k) <= 5 else 2})" for k in _KEYS)}) AS is_header
FROM (SELECT w, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part UNION ALL SELECT unnest(['header', 'republik', 'repblic', 'idnt', 'idents', 'persona', 'c', '']) AS w) a WHERE w <> '' GROUP BY w) b""")  # fmt: skip
def header_token(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("w"))
    more = spark.createDataFrame([(w,) for w in ("header", "republik", "repblic", "idnt", "idents", "persona", "c", "")], "w string")
    counted = words.unionByName(more).where("w <> ''").groupBy("w").agg(F.count("*").alias("n"))
    return counted.select("w", "n", parse.is_header_token(F.col("w"), _WORDS, _KEYS).alias("is_header"))


@query("edit_distance", "SELECT p_partkey AS rec, levenshtein(p_brand, 'Brand#34') AS distance, abs(length(p_type) - 8) <= 2 AND levenshtein(p_type, 'STANDARD') <= 2 AS near FROM part")
def edit_distance(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("rec"), F.levenshtein("p_brand", F.lit("Brand#34")).cast("long").alias("distance"), parse.near(F.col("p_type"), F.lit("STANDARD"), 2).alias("near"))


# --- id number ------------------------------------------------------------------------------------

_ids = q_nid(v("id_reads"), "rec")
@query("check_digit", f"SELECT rec, {q_check('z')} AS digit FROM (SELECT rec, {q_num('raw')} AS z FROM {v('id_reads')} t) x WHERE length(z) >= 13")
def check_digit(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "id_reads").select("rec", text.normalize_numeric(raw_()).alias("z")).where(F.length("z") >= 13)
    return rows.select("rec", nid.check_digit(F.col("z")).alias("digit"))


@query("nid_validate", f"SELECT rec, z AS normalized, status, birth_date, gov_code, gov_name, gender, CASE WHEN status IN ('VALID', 'INVALID_CHECKSUM') AND substr(z, 10, 4) = '0000' THEN 1 ELSE 0 END AS warnings FROM {_ids} x")
def nid_validate(spark: SparkSession, d: str) -> DataFrame:
    out = _validated(spark, d).select("rec", "r.*")
    return out.select("rec", "normalized", "status", "derived.birth_date", F.col("derived.governorate_code").alias("gov_code"), F.col("derived.governorate_name").alias("gov_name"), "derived.gender", F.size("warnings").alias("warnings"))


on("nid_birth_date", "id_reads", f"SELECT rec, try_cast((CASE substr(z, 1, 1) WHEN '2' THEN '19' WHEN '3' THEN '20' END) || substr(z, 2, 2) || '-' || substr(z, 4, 2) || '-' || substr(z, 6, 2) AS DATE) AS born FROM (SELECT rec, {q_num('raw')} AS z FROM {v('id_reads')} t) x", lambda raw: dict(born=nid.birth_date(text.normalize_numeric(raw))))
on("nid_gender", "id_reads", f"SELECT rec, CASE WHEN length(z) >= 13 THEN CASE WHEN substr(z, 13, 1) IN ('1', '3', '5', '7', '9') THEN 'male' ELSE 'female' END END AS gender FROM (SELECT rec, {q_num('raw')} AS z FROM {v('id_reads')} t) x", lambda raw: dict(gender=nid.gender(text.normalize_numeric(raw))))


@query("verify_nid", f"SELECT rec, CASE status WHEN 'VALID' THEN 'VERIFIED' WHEN 'INVALID_CHECKSUM' THEN 'LOW_CONFIDENCE' ELSE 'FAILED' END AS verification FROM {_ids} x")
def verify_nid(spark: SparkSession, d: str) -> DataFrame:
    return _validated(spark, d).select("rec", verify.verify_national_id(F.col("r.status")).alias("verification"))


@query("gov_lookup", f"SELECT i.rec, i.code, g.name, g.name_en FROM (SELECT rec, substr({q_num('raw')}, 8, 2) AS code FROM {v('id_reads')} t) i LEFT JOIN ({dims.values_sql(dims.GOVERNORATES, 'code, name, name_en')}) g ON i.code = g.code")
def gov_lookup(spark: SparkSession, d: str) -> DataFrame:
    ids = view(spark, d, "id_reads").select("rec", F.substring(text.normalize_numeric(raw_()), 8, 2).alias("code"))
    return ids.join(F.broadcast(dims.governorates(spark).drop("ord")), "code", "left").select("rec", "code", "name", "name_en")  # 28 rows


@query("nid_summary", f"SELECT status, coalesce(gov_name, '-') AS governorate, gender, count(*) AS n, min(birth_date) AS first_born, max(birth_date) AS last_born FROM {_ids} x GROUP BY 1, 2, 3")
def nid_summary(spark: SparkSession, d: str) -> DataFrame:
    """Id numbers by status, region and gender: normalize, validate, look up, count."""
    rows = _validated(spark, d).select("r.status", "r.derived.*")
    names = dims.governorates(spark).select(F.col("code").alias("governorate_code"), "name")
    named = rows.drop("governorate_name").join(F.broadcast(names), "governorate_code", "left")  # 28 rows
    return named.groupBy("status", F.coalesce("name", F.lit("-")).alias("governorate"), "gender").agg(F.count("*").alias("n"), F.min("birth_date").alias("first_born"), F.max("birth_date").alias("last_born"))


@query("gov_in_address", f"SELECT rec, CASE {' '.join(f'''WHEN contains(raw, '{n}') THEN '{n}' ''' for _, n, _ in dims.GOVERNORATES)} END AS governorate FROM {v('text_reads')} t")
def gov_in_address(spark: SparkSession, d: str) -> DataFrame:
    """The first region, in the order of the list, that a text names."""
    names = F.array(*[F.lit(n) for _, n, _ in dims.GOVERNORATES])
    return view(spark, d, "text_reads").select("rec", F.try_element_at(F.filter(names, lambda n: raw_().contains(n)), F.lit(1)).alias("governorate"))


# --- checks ---------------------------------------------------------------------------------------


@query("verify_dob", f"""SELECT rec, CASE WHEN a = b THEN 'CROSS_VALIDATED' WHEN a <> b THEN 'MISMATCH' WHEN a IS NULL AND b IS NULL THEN 'FAILED' ELSE 'EXTRACTED' END AS verification
FROM (SELECT d.rec, nullif({q_dob('d.raw')}, '') AS a, nullif(i.birth_date, '') AS b FROM {v('dob_reads')} d JOIN {_ids} i ON i.rec = d.rec) x""")  # fmt: skip
def verify_dob(spark: SparkSession, d: str) -> DataFrame:
    ids = _validated(spark, d).select("rec", F.col("r.derived.birth_date").alias("derived"))
    printed = view(spark, d, "dob_reads").select("rec", parse.parse_dob(raw_()).alias("printed"))
    return printed.join(ids, "rec").select("rec", verify.verify_dob(F.col("printed"), F.col("derived")).alias("verification"))


_g = q_gender("raw")
on("verify_gender", "gender_reads", f"SELECT rec, CASE WHEN a = b THEN 'CROSS_VALIDATED' WHEN a <> b THEN 'MISMATCH' WHEN a IS NOT NULL THEN 'EXTRACTED' ELSE 'FAILED' END AS verification FROM (SELECT rec, {_g} AS a, nullif(derived, '') AS b FROM {v('gender_reads')} t) x", lambda raw: dict(verification=verify.verify_gender(parse.parse_gender(raw), F.col("derived"))))
on("two_pass", "gender_reads", f"SELECT rec, CASE WHEN raw IS NULL OR derived IS NULL THEN 'INSUFFICIENT_EVIDENCE' WHEN raw = derived THEN 'AGREEMENT' ELSE 'DISAGREEMENT' END AS agreement FROM {v('gender_reads')} t", lambda raw: dict(agreement=verify.two_pass(raw, F.col("derived"))))
on(
    "cross_field", "gender_reads",
    f"""SELECT rec, dob, gender, gov, CAST(dob = 'MATCH' AS INTEGER) + CAST(gender = 'MATCH' AS INTEGER) + CAST(gov = 'MATCH' AS INTEGER) AS matches, CAST(dob = 'MISMATCH' AS INTEGER) + CAST(gender = 'MISMATCH' AS INTEGER) + CAST(gov = 'MISMATCH' AS INTEGER) AS mismatches, NOT (dob = 'MISMATCH' OR gender = 'MISMATCH' OR gov = 'MISMATCH') AS overall_consistent
    FROM (SELECT rec, CASE WHEN coalesce(raw, '') = '' OR coalesce(derived, '') = '' THEN 'INSUFFICIENT_EVIDENCE' WHEN raw = derived THEN 'MATCH' ELSE 'MISMATCH' END AS dob,
      CASE WHEN {_g} IS NULL OR coalesce(derived, '') = '' THEN 'INSUFFICIENT_EVIDENCE' WHEN {_g} = derived THEN 'MATCH' ELSE 'MISMATCH' END AS gender,
      CASE WHEN coalesce(derived, '') = '' THEN 'INSUFFICIENT_EVIDENCE' WHEN rec % 2 = 0 THEN 'MATCH' ELSE 'MISMATCH' END AS gov FROM {v('gender_reads')} t) x""",
    lambda raw: dict(**{k: (lambda c: c[s])(verify.cross_field(raw, F.col("derived"), parse.parse_gender(raw), F.col("derived"), F.when(F.col("rec") % 2 == 0, F.concat(F.lit(" "), F.col("derived"))).otherwise(F.lit("x")), F.col("derived"))) for k, s in (("dob", "dob"), ("gender", "gender"), ("gov", "governorate"), ("matches", "matches"), ("mismatches", "mismatches"), ("overall_consistent", "overall_consistent"))}),
)


@query("barcode_state", """SELECT rec, CASE WHEN NOT present THEN 'barcode_not_detected' WHEN NOT library OR failed THEN 'barcode_detected' WHEN payload IS NULL THEN 'barcode_not_decoded' ELSE 'barcode_decoded' END AS status, CASE WHEN present AND library AND NOT failed THEN payload END AS payload
FROM (SELECT p_partkey AS rec, p_partkey % 2 = 0 AS present, p_partkey % 3 <> 0 AS library, p_partkey % 5 = 0 AS failed, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_name END AS payload FROM part) x""")  # fmt: skip
def barcode_state(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    s = verify.barcode_state(k % 2 == 0, k % 3 != 0, k % 5 == 0, F.when(k % 7 != 0, F.col("p_name")))
    return table(spark, d, "part").select(k.alias("rec"), s["status"].alias("status"), s["payload"].alias("payload"))


# --- candidates -----------------------------------------------------------------------------------

_READ = f"SELECT *, trim(text) AS t, row_number() OVER (PARTITION BY rec, field, variant_ord ORDER BY floor(y / 20), x DESC, line_id) AS line_ord FROM {v('lines')} l WHERE trim(text) <> ''"


@query("reading_order", _READ.replace("*, trim(text) AS t", "rec, field, variant_ord, line_id").replace(" WHERE trim(text) <> ''", ""))
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    return candidates.reading_order(view(spark, d, "lines")).select("rec", "field", "variant_ord", "line_id", "line_ord")


@query("line_combine", f"""WITH o AS ({_READ}) SELECT rec, field, variant_ord, 0 AS cand_ord, string_agg(t, ' ' ORDER BY line_ord) AS text, round(avg(confidence), 6) AS confidence, 'paddleocr_multiline' AS engine FROM o GROUP BY 1, 2, 3 HAVING count(*) >= 2
UNION ALL SELECT rec, field, variant_ord, line_ord, t, round(confidence, 6), 'paddleocr' FROM o""")  # fmt: skip
def line_combine(spark: SparkSession, d: str) -> DataFrame:
    return candidates.combine_lines(view(spark, d, "lines")).withColumn("confidence", r("confidence"))


_CAND = f"""(SELECT c.*, confidence + CASE field
  WHEN 'national_id' THEN CASE WHEN length(z) = 14 AND substr(z, 1, 1) IN ('2', '3') THEN CASE WHEN status = 'VALID' THEN 1.5 ELSE 0.5 END WHEN length(z) >= 10 THEN 0.2 ELSE 0 END
  WHEN 'date_of_birth' THEN CASE WHEN {q_dob('text')} IS NOT NULL THEN 0.6 ELSE 0 END + CASE WHEN length(z) = 8 THEN 0.3 ELSE 0 END
  WHEN 'serial_number' THEN CASE WHEN {q_serial('text')} <> '' THEN 0.8 ELSE 0 END
  ELSE CASE WHEN n >= 2 THEN 0.2 ELSE 0 END + CASE WHEN n >= 3 THEN 0.1 ELSE 0 END + CASE WHEN engine LIKE '%multiline%' OR engine LIKE '%segmented%' THEN 0.25 ELSE 0 END END AS score
FROM (SELECT *, len(list_filter({q_words('text')}, lambda w: length(w) > 1)) AS n FROM {q_nid(v('cand'), 'rec, field, field_type, variant_ord, cand_ord, text, confidence, engine', 'text')} k) c)"""  # fmt: skip


@query("rank_candidates", f"SELECT rec, field, variant_ord, cand_ord, text, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY rec, field ORDER BY round(score, 9) DESC, variant_ord, cand_ord) AS k FROM {_CAND} s) q WHERE k = 1")
def rank_candidates(spark: SparkSession, d: str) -> DataFrame:
    return candidates.best(view(spark, d, "cand"), as_of()).select("rec", "field", "variant_ord", "cand_ord", "text", r("score").alias("score"))


# --- detections -----------------------------------------------------------------------------------

_CLS = "CASE cls_id " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(dims.CLASSES)) + " ELSE CAST(cls_id AS VARCHAR) END"
_UNIT = f"(SELECT rec, source, cls_id, {_CLS} AS cls, det_ord, confidence, " + ", ".join(f"CAST(trunc({c} / scale) AS INTEGER) AS {c}" for c in ("x0", "y0", "x1", "y1")) + f" FROM {v('det')} d)"
_BEST = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rec, cls ORDER BY confidence DESC, det_ord) AS k FROM {_UNIT} u) b WHERE k = 1)"
_HEAD = "((x0 + x1) / 2.0 / 1600 > 0.30 AND (y0 + y1) / 2.0 / 1009 < 0.20)"


def _found(spark: SparkSession, d: str) -> DataFrame:
    return detections.named(detections.original_scale(view(spark, d, "det")))


@query("class_lookup", f"SELECT rec, det_ord, cls_id, {_CLS} AS cls FROM {v('det')} d")
def class_lookup(spark: SparkSession, d: str) -> DataFrame:
    return detections.named(view(spark, d, "det")).select("rec", "det_ord", "cls_id", "cls")


@query("multi_scale_union", f"SELECT rec, det_ord, x0, y0, x1, y1 FROM {_UNIT} u")
def multi_scale_union(spark: SparkSession, d: str) -> DataFrame:
    det = view(spark, d, "det")
    both = det.where("scale = 1.0").unionByName(det.where("scale <> 1.0"))
    return detections.original_scale(both).select("rec", "det_ord", "x0", "y0", "x1", "y1")


@query("best_per_class", f"SELECT rec, cls, det_ord, round(confidence, 6) AS confidence FROM {_BEST} b")
def best_per_class(spark: SparkSession, d: str) -> DataFrame:
    return detections.best_per_class(_found(spark, d)).select("rec", "cls", "det_ord", r("confidence").alias("confidence"))


@query("det_spatial_filter", f"SELECT rec, det_ord FROM {_UNIT} u WHERE NOT {_HEAD}")
def det_spatial_filter(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).where(detections.outside_header()).select("rec", "det_ord")


def _q_boxes(source: str) -> str:
    y0 = "CASE WHEN cls = 'address' THEN greatest(0, y0 - 25) ELSE y0 END"
    return f"(SELECT rec, cls, confidence, x, y, greatest(x + 1, least(1600, x1)) - x AS w, greatest(y + 1, least(1009, y1)) - y AS h FROM (SELECT rec, cls, confidence, x1, y1, greatest(0, least(1599, x0)) AS x, greatest(0, least(1008, {y0})) AS y FROM {source} s) t)"


def _best_boxes(spark: SparkSession, d: str, source: str) -> DataFrame:
    return detections.boxes(detections.best_per_class(_found(spark, d).where(F.col("source") == source)))


def _q_best(source: str) -> str:
    return _q_boxes(f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rec, cls ORDER BY confidence DESC, det_ord) AS k FROM {_UNIT} u WHERE source = '{source}') b WHERE k = 1)")


@query("merge_precedence", f"""WITH a AS {_q_best('anchor')}, b AS {_q_best('found')} SELECT rec, cls, round(confidence, 6) AS confidence, x, y, w, h, 'found' AS source FROM b
UNION ALL SELECT rec, cls, round(confidence, 6), x, y, w, h, 'anchor' FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.rec = a.rec AND b.cls = a.cls)""")  # fmt: skip
def merge_precedence(spark: SparkSession, d: str) -> DataFrame:
    merged = detections.merge(_best_boxes(spark, d, "anchor"), _best_boxes(spark, d, "found"))
    return merged.withColumn("confidence", r("confidence"))


def _q_overlap() -> str:
    names = [*detections.RIGHT, *detections.LEFT]
    sql = "(SELECT rec, " + ", ".join(f"max(CASE WHEN cls = '{n}' THEN {c} END) AS {n}_{c}" for n in names for c in ("x", "y", "w", "h")) + f" FROM {_q_boxes(_BEST)} b GROUP BY rec)"
    for chain in (detections.RIGHT, detections.LEFT):
        for a, b in zip(chain[:-1], chain[1:], strict=True):
            over = f"coalesce({a}_y + {a}_h > {b}_y, FALSE)"
            mid = f"CAST(floor(({a}_y + {a}_h + {b}_y) / 2.0) AS INTEGER)"
            sql = f"(SELECT * REPLACE (CASE WHEN {over} THEN greatest(20, {mid} - 4 - {a}_y) ELSE {a}_h END AS {a}_h, CASE WHEN {over} THEN {mid} + 4 ELSE {b}_y END AS {b}_y, CASE WHEN {over} THEN greatest(20, {b}_y + {b}_h - ({mid} + 4)) ELSE {b}_h END AS {b}_h) FROM {sql} s)"
    parts = [f"SELECT rec, '{n}' AS cls, {n}_x AS x, {n}_y AS y, {n}_w AS w, {n}_h AS h FROM wide WHERE {n}_x IS NOT NULL" for n in names]
    return f"WITH wide AS {sql} " + " UNION ALL ".join(parts) + f" UNION ALL SELECT rec, cls, x, y, w, h FROM {_q_boxes(_BEST)} b WHERE cls NOT IN {q_list(names)}"


@query("overlap_resolve", _q_overlap())
def overlap_resolve(spark: SparkSession, d: str) -> DataFrame:
    return detections.resolve_overlaps(detections.boxes(detections.best_per_class(_found(spark, d)))).select("rec", "cls", "x", "y", "w", "h")


@query("bbox_iou", f"""SELECT rec, det_ord, round(CASE WHEN u > 0 THEN i / u ELSE 0 END, 6) AS iou FROM (SELECT rec, det_ord, i, 400.0 * 300 + (x1 - x0) * (y1 - y0) - i AS u
FROM (SELECT *, greatest(0.0, least(x1, 800) - greatest(x0, 400)) * greatest(0.0, least(y1, 600) - greatest(y0, 300)) AS i FROM {_UNIT} k) l) m""")  # fmt: skip
def bbox_iou(spark: SparkSession, d: str) -> DataFrame:
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    fixed = [F.lit(x) for x in (400.0, 300.0, 400.0, 300.0)]
    return _found(spark, d).select("rec", "det_ord", r(geometry.iou(F.col("x0"), F.col("y0"), w, h, *fixed)).alias("iou"))


@query("eval_summary", f"""SELECT cls AS field, count(DISTINCT rec) AS detected, round(count(DISTINCT rec) * 100.0 / (SELECT count(DISTINCT rec) FROM {_BEST} t), 6) AS recall, round(avg(confidence), 6) AS mean_confidence, round(avg(CASE WHEN u > 0 THEN i / u ELSE 0 END), 6) AS mean_iou
FROM (SELECT *, 400.0 * 300 + w * h - i AS u FROM (SELECT *, greatest(0.0, least(x + w, 800) - greatest(x, 400)) * greatest(0.0, least(y + h, 600) - greatest(y, 300)) AS i FROM {_q_boxes(_BEST)} b) c) e GROUP BY cls""")  # fmt: skip
def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = detections.boxes(detections.best_per_class(_found(spark, d))).withColumnRenamed("cls", "field")
    rows = rows.withColumns({k: F.lit(x) for k, x in (("tx", 400.0), ("ty", 300.0), ("tw", 400.0), ("th", 300.0))})
    return signals.evaluation(rows).select("field", "detected", r("recall").alias("recall"), r("mean_confidence").alias("mean_confidence"), r("mean_iou").alias("mean_iou"))
