"""Queries on stores, streams, evaluation, search and layout, each with a separately written DuckDB form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark import dims, sql
from docspark.operators import candidates, evaluation, sketches, split, words
from docspark.plans import queries as base
from docspark.plans import records
from docspark.plans.adapters import eval_boxes, table, view
from docspark.plans.queries import _READ as _LINES_READ
from docspark.plans.queries import AS_OF_SQL, q_nid, q_words, r, v
from docspark.plans.records import _FLAT, _pixels, _records
from docspark.sinks import layout, shared, sink_projection
from docspark.sinks.review_store import ReviewStore
from docspark.sinks.search_index import SearchIndex
from docspark.sources import labels, stored, training
from docspark.streaming import dedup

QUERIES: dict[str, base.Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: base.Query) -> base.Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# --- the review store -----------------------------------------------------------------------------

_VERSION = "CASE WHEN req % 5 = 1 THEN 0 WHEN req % 23 = 7 THEN 1 END"
_ANSWERS = f"""(SELECT req, id, CASE WHEN was IS NULL THEN 404 WHEN was <> 'PENDING' OR taken = 1 OR seen <> 0 THEN 409 WHEN NOT reason THEN 400 ELSE 200 END AS status, action, decision_note
FROM (SELECT *, coalesce(max(CASE WHEN was = 'PENDING' AND reason AND coalesce(seen, 0) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY req ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken
FROM (SELECT r.*, {_VERSION} AS seen, s.review_status AS was, coalesce(action = 'approve' OR (action = 'reject' AND trim(coalesce(r.decision_note, '')) <> ''), FALSE) AS reason
  FROM {v('review_req')} r LEFT JOIN {v('review_state')} s ON s.id = r.id) q) t)"""


def replayed(spark: SparkSession, d: str, batches: int = 3) -> tuple[ReviewStore, list[DataFrame]]:
    """A store of all records, after the requests came in batches by number, with a compaction before the last."""
    state = view(spark, d, "review_state").select("id", "national_id", "full_name", "review_status", "decision_note")
    store = ReviewStore(spark, shared.new_folder(spark, "review")).create(state)
    requests = view(spark, d, "review_req").withColumn("version", F.expr(_VERSION))
    last = requests.agg(F.max("req")).first()[0] or 0
    answers = []
    for k in range(batches):
        part = requests.where(F.col("req").between(k * last // batches + (k > 0), (k + 1) * last // batches))
        answers.append(store.apply(part, "portal", k))
        if k == batches - 2:
            store.compact()
    return store, answers


@query("review_log", f"""SELECT s.id, CASE WHEN a.id IS NULL THEN 0 ELSE 1 END AS version, CASE WHEN a.id IS NULL THEN s.review_status WHEN a.action = 'approve' THEN 'ACCEPTED' ELSE 'REJECTED' END AS review_status,
  CASE WHEN a.id IS NOT NULL THEN 'admin' END AS reviewed_by, CASE WHEN a.id IS NULL THEN s.decision_note ELSE a.decision_note END AS decision_note FROM {v('review_state')} s LEFT JOIN (SELECT * FROM {_ANSWERS} x WHERE status = 200) a ON a.id = s.id""")  # fmt: skip
def review_log(spark: SparkSession, d: str) -> DataFrame:
    """Every record after all requests, which came in three batches and may carry the version that their sender saw."""
    store, _ = replayed(spark, d)
    return store.read().select("id", "version", "review_status", "reviewed_by", "decision_note")


@query("review_log_answers", f"SELECT req, id, status, CASE WHEN status = 200 THEN 1 END AS version FROM {_ANSWERS} a")
def review_log_answers(spark: SparkSession, d: str) -> DataFrame:
    """What became of each of those requests."""
    _, answers = replayed(spark, d)
    return answers[0].unionByName(answers[1]).unionByName(answers[2]).select("req", "id", "status", "version")


# --- streams --------------------------------------------------------------------------------------

_TURNS = 4


@query("stream_dedup", f"""WITH a AS (SELECT DISTINCT * FROM {v('arrivals')} x), t AS (SELECT arrival, max(max(ts)) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM a GROUP BY arrival),
w AS (SELECT a.*, date_trunc('millisecond', newest) - INTERVAL 96 HOUR AS mark FROM a JOIN t ON t.arrival = a.arrival), n AS (SELECT * FROM w WHERE mark IS NULL OR ts > mark),
l AS (SELECT *, lag(ts) OVER (PARTITION BY img ORDER BY arrival) AS seen FROM n)
SELECT img, ts, sha256(img) AS content_sha256 FROM l WHERE seen IS NULL OR seen + INTERVAL 96 HOUR <= mark""")  # fmt: skip
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Uploads that come in four turns, each once within four days; every turn is a restart from the checkpoint."""
    folder = shared.new_folder(spark, "stream")
    rows = view(spark, d, "arrivals")
    for turn in range(_TURNS):
        rows.where(F.col("arrival") == turn).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        uploads = dedup.fresh(dedup.keyed(stream, F.col("img"), F.col("ts")), "96 hours")
        dedup.ingest(uploads, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return dedup.ingested(spark, f"{folder}/out", uploads.schema).select("img", "ts", "content_sha256")


# --- evaluation -----------------------------------------------------------------------------------

_IOU = "CASE WHEN i > 0 THEN i / ((p.x1 - p.x0) * (p.y1 - p.y0) + (t.x1 - t.x0) * (t.y1 - t.y0) - i) ELSE 0 END"


@query("eval_map", f"""WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY rec, cls ORDER BY confidence DESC, det_ord) AS place FROM {v('eval_found')} f), t AS {v('eval_truth')},
o AS (SELECT rec, cls, place, list({{'iou': iou, 'first': -truth_ord}}) AS near FROM (SELECT p.rec, p.cls, p.place, t.truth_ord, {_IOU} AS iou FROM (SELECT p.*, 1 AS one FROM p) p JOIN t ON t.rec = p.rec AND t.cls = p.cls,
  LATERAL (SELECT greatest(0, least(p.x1, t.x1) - greatest(p.x0, t.x0)) * greatest(0, least(p.y1, t.y1) - greatest(p.y0, t.y0)) AS i) x) y WHERE iou >= 0.5 GROUP BY rec, cls, place),
q AS (SELECT p.rec, p.cls, p.place, p.confidence, p.det_ord, coalesce(o.near, []) AS near FROM p LEFT JOIN o ON o.rec = p.rec AND o.cls = p.cls AND o.place = p.place),
g AS (SELECT q.*, k, list_max(list_filter(near, lambda c: c.iou >= (10 + k) / 20)) AS best, CAST([] AS BIGINT[]) AS taken FROM q, range(10) z(k) WHERE place = 1
  UNION ALL SELECT q.*, g.k, list_max(list_filter(q.near, lambda c: c.iou >= (10 + g.k) / 20 AND NOT list_contains(g.taken, c.first) AND (g.best IS NULL OR c.first <> g.best.first))) AS best,
  CASE WHEN g.best IS NULL THEN g.taken ELSE list_append(g.taken, g.best.first) END AS taken FROM g JOIN q ON q.rec = g.rec AND q.cls = g.cls AND q.place = g.place + 1),
m AS (SELECT cls, k, CASE WHEN best IS NULL THEN 0 ELSE 1 END AS hit, confidence, rec, det_ord FROM g),
n AS (SELECT *, sum(hit) OVER w / CAST(row_number() OVER w AS DOUBLE) AS prec FROM m WINDOW w AS (PARTITION BY cls, k ORDER BY confidence DESC, rec, det_ord ROWS UNBOUNDED PRECEDING)),
e AS (SELECT cls, k, hit, max(prec) OVER (PARTITION BY cls, k ORDER BY confidence, rec DESC, det_ord DESC ROWS UNBOUNDED PRECEDING) AS prec FROM n),
a AS (SELECT cls, count(*) FILTER (WHERE k = 0) AS detections, sum(hit) FILTER (WHERE k = 0) AS hits, sum(hit * prec) FILTER (WHERE k = 0) AS a50, sum(hit * prec) / 10 AS a FROM e GROUP BY cls),
c AS (SELECT cls, count(*) AS truths FROM t GROUP BY cls), k AS (SELECT cls FROM a UNION SELECT cls FROM c)
SELECT k.cls, coalesce(detections, 0) AS detections, coalesce(truths, 0) AS truths, round(coalesce(a50, 0) / truths, 6) AS ap50, round(coalesce(a, 0) / truths, 6) AS ap50_95, round(coalesce(hits, 0) / truths, 6) AS found50
FROM k LEFT JOIN a ON a.cls = k.cls LEFT JOIN c ON c.cls = k.cls""")  # fmt: skip
def eval_map(spark: SparkSession, d: str) -> DataFrame:
    """Average precision of each class, at an overlap of a half and over ten overlaps."""
    out = evaluation.precision(eval_boxes(spark, d))
    return out.withColumns({c: r(c) for c in ("ap50", "ap50_95", "found50")})


# --- words ----------------------------------------------------------------------------------------

#: DuckDB counts edits in bytes, so letters beyond ASCII become single bytes that no word of the tables has.
_BYTES = "translate({0}, 'ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü', '" + "".join(map(chr, (*range(1, 9), *range(14, 27)))) + "')"
_LISTED = f"SELECT DISTINCT word, CASE WHEN length(word) <= 5 THEN 1 ELSE 2 END AS edits FROM (SELECT unnest({q_words('text')}) AS word FROM benchmark UNION ALL SELECT unnest({dims.HEADER_KEYWORDS!r}) AS word) w"


@query("near_words", f"""WITH l AS ({_LISTED}), w AS (SELECT DISTINCT unnest({q_words("coalesce(text, '')")}) AS word FROM documents),
b AS (SELECT word, {_BYTES.format('word')} AS x FROM w), c AS (SELECT word, edits, {_BYTES.format('word')} AS x FROM l)
SELECT b.word, c.word AS near, levenshtein(b.x, c.x) AS distance FROM b JOIN c ON abs(length(b.word) - length(c.word)) <= c.edits WHERE levenshtein(b.x, c.x) <= c.edits""")  # fmt: skip
def near_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of documents near the words of the benchmark and the header keywords: one edit up to five letters, else two."""
    listed = words.distinct_words(table(spark, d, "benchmark"), "text").unionByName(spark.createDataFrame([(k,) for k in dims.HEADER_KEYWORDS], "word string"))
    listed = listed.withColumn("edits", F.when(F.length("word") <= 5, 1).otherwise(2))
    return words.near_words(words.distinct_words(table(spark, d, "documents"), "text"), listed)


# --- search and layout ----------------------------------------------------------------------------

_STATE = v("review_state")
_FOUND = "contains(lower(coalesce(full_name, '')), '0012') OR contains(lower(national_id), '0012') OR contains(lower(governorate), '0012')"


@query("portal_search_indexed", f"SELECT id, national_id, full_name, governorate, review_status FROM {_STATE} s WHERE ({_FOUND}) AND upper(review_status) = 'PENDING'")
def portal_search_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The portal's search from posting lists of trigrams; of the records only the buckets with candidates are read."""
    state = view(spark, d, "review_state").select("id", "national_id", "full_name", "governorate", "review_status")
    store = ReviewStore(spark, shared.new_folder(spark, "search")).create(state)
    return SearchIndex(store).build().search(" 0012 ", "PENDING").select("id", "national_id", "full_name", "governorate", "review_status")


_REGION = "CASE WHEN ascii(governorate) BETWEEN 65 AND 90 THEN ascii(governorate) - 65 ELSE 0 END"
_STATUS = "CASE review_status WHEN 'PENDING' THEN 0 WHEN 'ACCEPTED' THEN 1 ELSE 2 END"
_QUARTER = "coalesce((year(birth_date) - 1992) * 4 + quarter(birth_date) - 1, 0)"
_Z = " + ".join(f"(((least(31, greatest(0, {c})) >> {k}) & 1) << {3 * k + 2 - i})" for i, c in enumerate((_REGION, _STATUS, _QUARTER)) for k in range(5))
_COLUMNS = "id, full_name, governorate, review_status, birth_date"
_PAGE = 500


def _clustered(spark: SparkSession, d: str) -> str:
    """All records in order of region (its first letter), status and quarter."""
    path = shared.new_folder(spark, "clustered")
    rows = view(spark, d, "review_state").select(*_COLUMNS.split(", "))
    layout.write_clustered(rows, path, layout.z_order(F.expr(_REGION), F.expr(_STATUS), F.expr(_QUARTER)), group_bytes=1 << 16, file_rows=1 << 14)
    return path


@query("review_page", f"SELECT {_COLUMNS}, CAST(z AS BIGINT) AS z FROM (SELECT *, row_number() OVER (ORDER BY z, id) AS place FROM (SELECT *, {_Z} AS z FROM {_STATE} s) a) b WHERE place BETWEEN {_PAGE + 1} AND {2 * _PAGE}")
def review_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of records in their stored order, asked for by the last row of the first one."""
    path = _clustered(spark, d)
    last = layout.page(spark, path, _PAGE).agg(F.max(F.struct("z", "id")).alias("k")).first()["k"]
    return layout.page(spark, path, _PAGE, (last["z"], last["id"]) if last else None)


@query("review_by_id_indexed", f"SELECT {_COLUMNS} FROM {_STATE} s WHERE id IN (SELECT max(id) FROM {_STATE} a UNION ALL SELECT min(id) FROM {_STATE} b UNION ALL SELECT -1)")
def review_by_id_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The first and the last record by id, and one that is not there, through statistics and Bloom filters."""
    ends = view(spark, d, "review_state").agg(F.min("id").alias("a"), F.max("id").alias("b")).first()
    return layout.by_id(spark, _clustered(spark, d), *(i for i in (*ends, -1) if i is not None)).select(*_COLUMNS.split(", "))


# --- stored JSON ----------------------------------------------------------------------------------

_BROKEN = "id % 17 = 0 OR id % 19 = 3 OR id % 23 = 5"
_SCALARS = ("national_id", "full_name", "birth_date", "gender", "governorate", "serial_number", "review_national_id")


@query("record_variant", f"""SELECT id, NOT broken AS readable, {', '.join(f'CASE WHEN NOT broken THEN {c} END AS {c}' for c in _SCALARS)}, CASE WHEN NOT broken THEN nid_confidence END AS nid_confidence
FROM (SELECT s.id, f.*, {_BROKEN.replace('id', 's.id')} AS broken FROM {v('review_state')} s JOIN {_FLAT} f ON f.rec = s.id) x""")  # fmt: skip
def record_variant(spark: SparkSession, d: str) -> DataFrame:
    """Flat fields out of the JSON that is stored for each record; some of it is cut off, missing or no object."""
    uploads = view(spark, d, "review_state").select("id", "original_filename", "image_mime_type", F.col("card_image").alias("content"), "capture_quality")
    rows = sink_projection(uploads.join(_records(spark, d).withColumnRenamed("rec", "id"), "id"))
    text = F.when(F.expr("id % 17 = 0"), F.expr("substr(ocr_result, 1, length(ocr_result) - 1)")).when(F.expr("id % 19 = 3"), None).when(F.expr("id % 23 = 5"), F.lit("[1, 2]")).otherwise(F.col("ocr_result"))
    return stored.fields(rows.select("id", text.alias("ocr_result"))).select("id", "readable", *_SCALARS, r("nid_confidence", 4).alias("nid_confidence"))


# --- splits ---------------------------------------------------------------------------------------


@query("stratified_split", """SELECT doc_id, lang, CASE WHEN place <= n // 5 THEN 'val' ELSE 'train' END AS split FROM (SELECT doc_id, lang, count(*) OVER (PARTITION BY lang) AS n,
  row_number() OVER (PARTITION BY lang ORDER BY sha256('split|' || CAST(doc_id AS VARCHAR))) AS place FROM documents) d""")  # fmt: skip
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    """A fifth of the documents of each language, those of least hash."""
    return split.stratified(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang")


# --- SQL functions --------------------------------------------------------------------------------


def _with_sql(spark: SparkSession, d: str) -> None:
    sql.register_tables(spark, view(spark, d, "review_state").select("id", "national_id", "full_name", "governorate", "review_status"))


@query("sql_portal_search", f"SELECT id, national_id, full_name, governorate, review_status FROM {_STATE} s WHERE ({_FOUND.replace('0012', '01')}) AND upper(review_status) = 'PENDING'")
def sql_portal_search(spark: SparkSession, d: str) -> DataFrame:
    """The portal's search as a function in SQL that gives a table."""
    _with_sql(spark, d)
    return spark.sql("SELECT * FROM portal_search(' 01 ', 'PENDING')")


@query("sql_id_checks", f"""SELECT rec, place, part, CASE place WHEN 1 THEN status WHEN 2 THEN birth_date WHEN 3 THEN gender ELSE gov_name END AS value
FROM {q_nid('(SELECT rec, raw FROM ' + v('id_reads') + ' r)', 'rec')} n, (VALUES (1, 'status'), (2, 'birth_date'), (3, 'gender'), (4, 'governorate')) p(place, part)""")  # fmt: skip
def sql_id_checks(spark: SparkSession, d: str) -> DataFrame:
    """A row for each part of each id number, by a function that is joined laterally."""
    _with_sql(spark, d)
    view(spark, d, "id_reads").createOrReplaceTempView("id_reads_now")
    return spark.sql(f"SELECT r.rec, c.place, c.part, c.value FROM id_reads_now r, LATERAL id_checks(r.raw, {AS_OF_SQL}) c")


@query("sql_combined", f"SELECT rec, field, variant_ord, string_agg(t, ' ' ORDER BY line_ord) AS text, round(avg(confidence), 6) AS confidence FROM ({_LINES_READ}) o GROUP BY 1, 2, 3")
def sql_combined(spark: SparkSession, d: str) -> DataFrame:
    """Lines in reading order folded into one reading with its mean confidence."""
    _with_sql(spark, d)
    lines = view(spark, d, "lines")
    candidates.reading_order(lines.where(F.trim("text") != "").withColumn("text", F.trim("text"))).createOrReplaceTempView("lines_now")
    rows = spark.sql("SELECT rec, field, variant_ord, combined(collect_list(named_struct('line_ord', line_ord, 'text', text, 'confidence', confidence))) AS c FROM lines_now GROUP BY ALL")
    return rows.select("rec", "field", "variant_ord", "c.text", r("c.confidence").alias("confidence"))


# --- sketches -------------------------------------------------------------------------------------

_SHARES = (0.25, 0.5, 0.75)


@query("profile_sketch", "SELECT label, share, count(*) * 64 AS n, min(list_min(embedding)) AS least, max(list_max(embedding)) AS most, TRUE AS within FROM embeddings, (VALUES (0.25), (0.5), (0.75)) s(share) GROUP BY label, share")
def profile_sketch(spark: SparkSession, d: str) -> DataFrame:
    """Quartiles of the entries of each label, merged from sketches of two halves, held against their exact ranks."""
    rows = table(spark, d, "embeddings").select("label", (F.col("vec_id") % 2).alias("half"), F.explode("embedding").alias("v"))
    whole = sketches.merged(sketches.sketched(rows, "v", "label", "half"), "label")
    found = sketches.quantiles(whole, *_SHARES, 0.0, 1.0)
    asked = found.select("label", "n", F.col("quantiles")[3].alias("least"), F.col("quantiles")[4].alias("most"), F.explode(F.arrays_zip(F.array(*map(F.lit, _SHARES)).alias("share"), F.slice("quantiles", 1, 3).alias("q"))).alias("a"))
    asked = asked.select("label", "n", "least", "most", "a.share", "a.q")
    v = F.col("v").cast("double")
    held = rows.join(asked, "label").groupBy("label", "n", "least", "most", "share").agg(F.avg((v < F.col("q")).cast("double")).alias("low"), F.avg((v <= F.col("q")).cast("double")).alias("high"))
    slack = 2 * sketches.rank_error()
    return held.select("label", "share", "n", "least", "most", F.col("share").between(F.col("low") - slack, F.col("high") + slack).alias("within"))


# --- training folders -----------------------------------------------------------------------------


@query("training_folder", f"""SELECT CASE WHEN f % 5 = 0 THEN 'val' ELSE 'train' END AS split, 'sample_' || CAST(f AS VARCHAR) AS name, line_no, cls, n, x0, y0, x1, y1
FROM (SELECT rec, CAST(floor(rec / 40) AS BIGINT) AS f, row_number() OVER (PARTITION BY floor(rec / 40) ORDER BY rec) AS line_no FROM {v('label_lines')} l) a JOIN ({records.ORACLE_SQL['label_parse']}) p ON p.rec = a.rec""")  # fmt: skip
def training_folder(spark: SparkSession, d: str) -> DataFrame:
    """Labels of forty objects an image, written as a training folder and read back through the same data source."""
    training.register(spark)
    folder = shared.new_folder(spark, "training")
    key = F.floor(F.col("rec") / 40).cast("long")
    lines = view(spark, d, "label_lines").groupBy(key.alias("key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rec", "line"))), lambda x: x["line"]).alias("lines"))
    rows = lines.select("key", F.when(F.col("key") % 5 == 0, "val").otherwise("train").alias("split"), F.lit(b"P6 1 1 255 ").alias("content"), "lines")
    rows.write.format(training.NAME).mode("append").save(folder)
    found = labels.parsed(spark.read.format(training.NAME).load(folder))
    at = lambda i: r(F.element_at("polygon", i), 5)
    return found.select("split", "name", "line_no", "cls", "n", at(1).alias("x0"), at(2).alias("y0"), at(5).alias("x1"), at(6).alias("y1"))
