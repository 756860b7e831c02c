"""Queries on boxes and quads, pixels, sources and sinks, records and the review portal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark import dims
from docspark.functions import geometry
from docspark.operators import record, review, signals
from docspark.plans import queries as base
from docspark.plans.adapters import table, view
from docspark.plans.queries import as_of, q_address, q_dob, q_name, q_nid, q_norm, q_num, q_pnid, q_serial, q_west, q_words, r, v
from docspark.sinks import batch_map, dataset_split, sink_projection
from docspark.sources import labels, uploads
from docspark.vision import frames
from docspark.vision.process import process

QUERIES: dict[str, base.Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: base.Query) -> base.Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# --- geometry -------------------------------------------------------------------------------------

_CARD = 85.60 / 53.98
_WH = "SELECT p_partkey AS rec, 300.0 + p_size * 77 AS w, 200.0 + p_partkey % 1900 AS h FROM part"


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("rec"), (300.0 + F.col("p_size") * 77).alias("w"), (200.0 + F.col("p_partkey") % 1900).alias("h"))


@query("resize_plan", f"SELECT rec, round(s, 6) AS scale, CAST(round_even(w * s, 0) AS INTEGER) AS new_w, CAST(round_even(h * s, 0) AS INTEGER) AS new_h FROM (SELECT *, least(1600 / greatest(w, h), 4.0) AS s FROM ({_WH}) a) b")
def resize_plan(spark: SparkSession, d: str) -> DataFrame:
    p = geometry.resize_plan(F.col("w"), F.col("h"))
    return _sizes(spark, d).select("rec", r(p["scale"]).alias("scale"), p["new_w"].alias("new_w"), p["new_h"].alias("new_h"))


@query("affine_roundtrip", f"SELECT rec, round(w * s + 3, 6) AS px, round(w, 6) AS ox FROM (SELECT *, least(1600 / greatest(w, h), 4.0) AS s FROM ({_WH}) a) b")
def affine_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    s = geometry.resize_scale(F.col("w"), F.col("h"))
    there = geometry.to_processing(F.col("w"), s, F.lit(3))
    return _sizes(spark, d).select("rec", r(there).alias("px"), r(geometry.to_original(there, s, F.lit(3))).alias("ox"))


@query("bbox_canonical", f"SELECT rec, round(w / 4000 * 1600, 6) AS x, round(h / 4000 * 1009, 6) AS y, round(w / 1600, 6) AS nx, round(h / 1009, 6) AS ny FROM ({_WH}) a")
def bbox_canonical(spark: SparkSession, d: str) -> DataFrame:
    w, h = F.col("w"), F.col("h")
    c, n = geometry.to_canonical(w / 4000, h / 4000, w / 4000, h / 4000), geometry.to_normalized(w, h, w, h)
    return _sizes(spark, d).select("rec", r(c["x"]).alias("x"), r(c["y"]).alias("y"), r(n["x"]).alias("nx"), r(n["y"]).alias("ny"))


@query("crop_map", f"""SELECT rec, least(greatest(floor((100 + dx) / s + 0.5), 0), w) AS "left", least(greatest(floor((200 + dy) / s + 0.5), 0), h) AS top, least(greatest(floor((980 + dx) / s + 0.5), 0), w) AS "right", least(greatest(floor((755 + dy) / s + 0.5), 0), h) AS bottom
FROM (SELECT *, (w * s - 1080) / 2 AS dx, (h * s - 1920) / 2 AS dy FROM (SELECT rec, CAST(w AS BIGINT) AS w, CAST(h AS BIGINT) AS h, greatest(1080 / w, 1920 / h) AS s FROM ({_WH}) a) b) c""")  # fmt: skip
def crop_map(spark: SparkSession, d: str) -> DataFrame:
    box = geometry.crop_map(*(F.lit(x) for x in (100, 200, 980, 755, 1080, 1920)), F.col("w").cast("long"), F.col("h").cast("long"))
    return _sizes(spark, d).select("rec", box.alias("b")).select("rec", "b.*")


@query("box_to_polygon", """SELECT rec, k, round(CASE k WHEN 0 THEN x0 WHEN 1 THEN y0 WHEN 2 THEN x1 WHEN 3 THEN y0 WHEN 4 THEN x1 WHEN 5 THEN y1 WHEN 6 THEN x0 ELSE y1 END, 6) AS p
FROM (SELECT p_partkey AS rec, greatest(0.0, p_size / 50.0 - 0.15) AS x0, greatest(0.0, p_partkey % 100 / 100.0 - 0.1) AS y0, least(1.0, p_size / 50.0 + 0.15) AS x1, least(1.0, p_partkey % 100 / 100.0 + 0.1) AS y1 FROM part) a, range(8) t(k)""")  # fmt: skip
def box_to_polygon(spark: SparkSession, d: str) -> DataFrame:
    polygon = geometry.box_to_polygon(F.col("p_size") / 50.0, F.col("p_partkey") % 100 / 100.0, F.lit(0.3), F.lit(0.2))
    return table(spark, d, "part").select(F.col("p_partkey").alias("rec"), F.posexplode(polygon).alias("k", "p")).select("rec", "k", r("p").alias("p"))


@query("best_quad", f"""WITH s AS (SELECT rec, quad_ord, unnest([{{'shape': 'A', 'score': CASE WHEN w >= 720 AND h >= 480 AND d < 0.40 THEN 0.70 * greatest(0, 1 - d) + 0.30 * least(a, 1.0) END}}, {{'shape': 'B', 'score': CASE WHEN greatest(w, h) >= 720 AND least(w, h) >= 420 AND d < 0.35 THEN 0.65 * greatest(0, 1 - d) + 0.35 * least(a, 1.0) END}}]) AS z
  FROM (SELECT *, abs(greatest(w, h) / least(w, h) - {_CARD}) / {_CARD} AS d, area / (1920000 * 0.65) AS a FROM {v('quad')} q WHERE area < 1920000 * 0.96 AND area >= 1920000 * 0.22) b)
SELECT rec, quad_ord, shape, round(score, 6) AS score FROM (SELECT rec, quad_ord, z.shape AS shape, round(z.score, 9) AS score, row_number() OVER (PARTITION BY rec ORDER BY round(z.score, 9) DESC, quad_ord, z.shape) AS k FROM s WHERE z.score > 0) t WHERE k = 1""")  # fmt: skip
def best_quad(spark: SparkSession, d: str) -> DataFrame:
    return signals.best_quad(view(spark, d, "quad")).select("rec", "quad_ord", "shape", r("score").alias("score"))


@query("quad_margin", f"""SELECT rec, quad_ord, c AS is_content, round(CASE WHEN c THEN 0 ELSE least(greatest(cx + 1.025 * (x0 - cx), 0), 1600) END, 6) AS x0, round(CASE WHEN c THEN 0 ELSE least(greatest(cy + 1.025 * (y0 - cy), 0), 1200) END, 6) AS y0,
  round(CASE WHEN c THEN 1600 ELSE least(greatest(cx + 1.025 * (x1 - cx), 0), 1600) END, 6) AS x1, round(CASE WHEN c THEN 1200 ELSE least(greatest(cy + 1.025 * (y1 - cy), 0), 1200) END, 6) AS y1
FROM (SELECT *, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, (x0 / 1600 < 0.04 OR y0 / 1200 < 0.04 OR greatest(0, (1600 - x1) / 1600) < 0.04 OR greatest(0, (1200 - y1) / 1200) < 0.04) AND area > 1920000 * 0.65 AS c
FROM (SELECT *, x0 + w AS x1, y0 + h AS y1 FROM {v('quad')} q) a) b""")  # fmt: skip
def quad_margin(spark: SparkSession, d: str) -> DataFrame:
    x0, y0 = F.col("x0"), F.col("y0")
    m = geometry.quad_margin(x0, y0, x0 + F.col("w"), y0 + F.col("h"), F.col("area"), F.col("canvas_w"), F.col("canvas_h"))
    out = view(spark, d, "quad").select("rec", "quad_ord", m.alias("m")).select("rec", "quad_ord", "m.*")
    return out.withColumns({c: r(c) for c in ("x0", "y0", "x1", "y1")})


@query("quad_extent", f"SELECT rec, min(x0) AS x0, max(x0) AS x1, min(y0) AS y0, max(y0) AS y1, round(avg(x0), 6) AS cx, round(avg(y0), 6) AS cy FROM {v('quad')} q GROUP BY rec")
def quad_extent(spark: SparkSession, d: str) -> DataFrame:
    corners = view(spark, d, "quad").select("rec", F.col("x0").alias("x"), F.col("y0").alias("y"))
    return signals.quad_extent(corners).withColumns({c: r(c) for c in ("cx", "cy")})


@query("card_gate", f"SELECT rec, quad_ord, photo >= 0.5 AS is_id, photo > 0.40 AS passes_evaluation FROM {v('quad')} q")
def card_gate(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "quad").select("rec", "quad_ord", (F.col("photo") >= 0.5).alias("is_id"), (F.col("photo") > 0.40).alias("passes_evaluation"))


@query("side_classify", f"""SELECT rec, quad_ord, CASE WHEN f < 0.12 AND b < 0.12 THEN 'unknown' WHEN f >= b THEN 'front' ELSE 'back' END AS side, round(CASE WHEN f < 0.12 AND b < 0.12 THEN 0 ELSE least(0.5 + greatest(f, b), 0.98) END, 6) AS confidence
FROM (SELECT *, photo - 0.3 * barcode AS f, barcode - 0.3 * photo AS b FROM {v('quad')} q) x""")  # fmt: skip
def side_classify(spark: SparkSession, d: str) -> DataFrame:
    s = geometry.side(F.col("photo"), F.col("barcode"))
    return view(spark, d, "quad").select("rec", "quad_ord", s["side"].alias("side"), r(s["confidence"]).alias("confidence"))


# --- pixels ---------------------------------------------------------------------------------------

_PIX = "(SELECT vec_id AS rec, k - 1 AS pos, CAST(embedding[k] AS DOUBLE) AS v FROM embeddings, range(1, 65) t(k))"


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("rec"), F.posexplode("embedding").alias("pos", "v")).withColumn("v", F.col("v").cast("double"))


_STATS = f"(SELECT rec, avg(v) AS mean, stddev_pop(v) AS std, var_pop(v) AS variance, avg(CASE WHEN v > 0.1 THEN 1.0 ELSE 0.0 END) AS share_over FROM {_PIX} p GROUP BY rec)"


@query("pixel_stats", f"SELECT rec, round(mean, 6) AS mean, round(std, 6) AS std, round(variance, 6) AS variance, round(share_over, 6) AS share_over FROM {_STATS} s")
def pixel_stats(spark: SparkSession, d: str) -> DataFrame:
    out = signals.pixel_stats(_pixels(spark, d), 0.1)
    return out.withColumns({c: r(c) for c in ("mean", "std", "variance", "share_over")})


@query("quality_bucket", f"""SELECT rec, issues, CASE WHEN len(issues) = 0 THEN 'good' WHEN len(issues) = 1 THEN 'acceptable' ELSE 'poor' END AS status, CASE WHEN len(issues) = 0 THEN 'GOOD' WHEN len(issues) = 1 THEN 'BORDERLINE' ELSE 'BAD' END AS stored
FROM (SELECT rec, list_filter([CASE WHEN variance * 4000 < 60 THEN 'image_is_blurry' END, CASE WHEN 128 + mean * 4000 < 40 THEN 'image_too_dark' END, CASE WHEN 128 + mean * 4000 > 230 THEN 'image_too_bright_or_overexposed' END, CASE WHEN share_over / 3 > 0.08 THEN 'possible_glare' END, CASE WHEN std * 120 < 15 THEN 'low_contrast' END], lambda x: x IS NOT NULL) AS issues FROM {_STATS} s) q""")  # fmt: skip
def quality_bucket(spark: SparkSession, d: str) -> DataFrame:
    s = signals.pixel_stats(_pixels(spark, d), 0.1)
    issues = geometry.quality_issues(F.col("variance") * 4000, 128 + F.col("mean") * 4000, F.col("std") * 120, F.col("share_over") / 3)
    out = s.select("rec", issues.alias("issues"))
    return out.withColumn("status", geometry.quality_status(F.col("issues"))).withColumn("stored", geometry.persisted_quality(F.col("status")))


@query("profile_percentile", f"SELECT rec, round(quantile_cont(v, 0.4), 6) AS p FROM {_PIX} x GROUP BY rec")
def profile_percentile(spark: SparkSession, d: str) -> DataFrame:
    return signals.profile_percentile(_pixels(spark, d)).select("rec", r("p").alias("p"))


@query("ink_islands", f"""WITH a AS (SELECT rec, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY rec ORDER BY pos) > 2 THEN 1 ELSE 0 END AS new FROM {_PIX} x WHERE v > 0.05), b AS (SELECT *, sum(new) OVER (PARTITION BY rec ORDER BY pos) AS island FROM a)
SELECT rec, island, min(pos) AS "first", max(pos) AS "last" FROM b GROUP BY rec, island HAVING max(pos) - min(pos) >= 3""")  # fmt: skip
def ink_islands(spark: SparkSession, d: str) -> DataFrame:
    return signals.islands(_pixels(spark, d), 0.05, 2, 3)


@query("valley", f"SELECT rec, pos AS valley FROM (SELECT rec, pos, row_number() OVER (PARTITION BY rec ORDER BY v, pos) AS k FROM {_PIX} x WHERE pos BETWEEN 19 AND 43) y WHERE k = 1")
def valley(spark: SparkSession, d: str) -> DataFrame:
    return signals.valley(_pixels(spark, d), 64)


_POINTS = "SELECT p_partkey AS rec, [{'x': p_partkey % 7 + 100.0, 'y': p_size + 0.0, 'i': 1}, {'x': p_partkey % 11 + 0.0, 'y': p_size + 80.0, 'i': 2}, {'x': p_partkey % 5 + 0.0, 'y': p_size % 3 + 0.0, 'i': 3}, {'x': p_partkey % 13 + 90.0, 'y': p_size + 70.0, 'i': 4}] AS p FROM part"
_SIDE = "list_transform(list_sort(list_transform(h{0}, lambda c: {{'a': c.x, 'b': c.y, 'i': c.i}})), lambda c: {{'x': c.a, 'y': c.b}})"
_BEND = lambda a, b, c: f"(g[{b}].x - g[{a}].x) * (g[{c}].y - g[{b}].y) - (g[{b}].y - g[{a}].y) * (g[{c}].x - g[{b}].x)"


@query("order_corners", f"""WITH s AS (SELECT rec, p, list_transform(list_sort(list_transform(p, lambda c: {{'a': c.y, 'i': c.i, 'x': c.x}})), lambda c: {{'x': c.x, 'y': c.a, 'i': c.i}}) AS h FROM ({_POINTS}) z),
t AS (SELECT rec, p, {_SIDE.format('[:2]')} AS top, {_SIDE.format('[3:]')} AS low FROM s), q AS (SELECT rec, p, [top[1], top[2], low[2], low[1]] AS g FROM t),
m AS (SELECT rec, g, least({_BEND(1, 2, 3)}, {_BEND(2, 3, 4)}, {_BEND(3, 4, 1)}, {_BEND(4, 1, 2)}) < 0 AS crossed, list_transform(list_sort(list_transform(p, lambda c: {{'a': atan2(c.y - (p[1].y + p[2].y + p[3].y + p[4].y) / 4, c.x - (p[1].x + p[2].x + p[3].x + p[4].x) / 4), 'i': c.i, 'x': c.x, 'y': c.y}})), lambda c: {{'x': c.x, 'y': c.y}}) AS r FROM q),
n AS (SELECT rec, CASE WHEN crossed THEN r ELSE g END AS g, CASE WHEN crossed THEN list_position(list_transform(r, lambda c: c.x + c.y), list_min(list_transform(r, lambda c: c.x + c.y))) ELSE 1 END AS f FROM m)
SELECT rec, {', '.join(f"CAST(g[(f + {k - 2}) % 4 + 1].x AS DOUBLE) AS x{k}, CAST(g[(f + {k - 2}) % 4 + 1].y AS DOUBLE) AS y{k}" for k in (1, 2, 3, 4))} FROM n""")  # fmt: skip
def order_corners(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    corners = F.array(k % 7 + 100.0, size + 0.0, k % 11 + 0.0, size + 80.0, k % 5 + 0.0, size % 3 + 0.0, k % 13 + 90.0, size + 70.0)
    quads = frames.ordered_corners(table(spark, d, "part").select(k.cast("long").alias("rec"), corners.alias("corners")))
    return quads.select("rec", *(F.col("quad")[i].alias(f"{'xy'[i % 2]}{i // 2 + 1}") for i in range(8)))


@query("vision_quality")
def vision_quality(spark: SparkSession, d: str) -> DataFrame:
    """Quality, side and scale of drawn cards; unreadable ones are rows with an error."""
    out = frames.assessed(frames.drawn(table(spark, d, "nation").select(F.col("n_nationkey").alias("seed"))))
    return out.select("path", "error", "width", "height", r("brightness", 3).alias("brightness"), "issues", "status", F.col("side.side").alias("side"))


@query("card_corners", "SELECT n_nationkey AS seed, TRUE AS found, TRUE AS sure FROM nation")
def card_corners(spark: SparkSession, d: str) -> DataFrame:
    """Cards drawn on desks: corners within 4 % of the picture's width of those drawn (1 % is the margin that is added)."""
    out = frames.found_on_desks(table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("seed")))
    return out.select("seed", (F.col("off") < 0.04).alias("found"), (F.col("score") > 0.8).alias("sure"))


@query("vision_localize")
def vision_localize(spark: SparkSession, d: str) -> DataFrame:
    """The fields of drawn cards, found by their print and parted from one another."""
    return frames.localized(frames.drawn(table(spark, d, "nation").select(F.col("n_nationkey").alias("seed"))))


class Digits:
    """A stand-in for a recognizer: wide images hold an id number, others a place, brighter ones for sure."""

    def read(self, image):
        return ("29904171700111" if image.shape[1] > 5 * image.shape[0] else "القاهرة شارع النيل"), 0.9 if image.mean() > 127 else 0.6


_SEEN = lambda value: f"CASE WHEN n_nationkey % 7 <> 0 THEN {value} END"


@query("process_images", f"""SELECT 'card_' || CAST(n_nationkey AS VARCHAR) || '.ppm' AS path, CASE WHEN n_nationkey % 7 = 0 THEN 'unreadable image' ELSE '' END AS errors, {_SEEN("'good'")} AS status, {_SEEN("'front'")} AS side, {_SEEN("'egy_id_front_v1'")} AS template, {_SEEN("'29904171700111'")} AS national_id,
  {_SEEN("'29904171700111'")} AS full_name, {_SEEN("'29904171700111'")} AS address, {_SEEN("'1999-04-17'")} AS birth_date, {_SEEN("'male'")} AS gender, {_SEEN("'المنوفية'")} AS governorate, {_SEEN("FALSE")} AS review_national_id FROM nation""")  # fmt: skip
def process_images(spark: SparkSession, d: str) -> DataFrame:
    """Drawn cards from pixels to records; unreadable ones are rows with an error."""
    images = frames.drawn(table(spark, d, "nation").select(F.col("n_nationkey").alias("seed")))
    out = process(images, as_of(), Digits, key="digits")
    return out.select("path", F.array_join("errors", "; ").alias("errors"), "status", "side", "template", "national_id", "full_name", "address", "birth_date", "gender", "governorate", F.col("needs_review.national_id").alias("review_national_id"))


# --- dimensions -----------------------------------------------------------------------------------

_FIELDS_SQL = dims.values_sql([(t, side, i, f[0], f[5], f[6]) for t, side, fields in dims.TEMPLATES for i, f in enumerate(fields)], "template_id, side, ord, field, field_type, required")
_SIDES = "SELECT s_suppkey AS rec, CASE s_suppkey % 3 WHEN 0 THEN 'front' WHEN 1 THEN 'back' ELSE 'unknown' END AS side FROM supplier"


@query("template_lookup", f"SELECT s.rec, t.template_id, t.ord, t.field, t.field_type, t.required, t.template_id IS NULL AS missing FROM ({_SIDES}) s LEFT JOIN ({_FIELDS_SQL}) t ON s.side = t.side")
def template_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The fields of the template of each side; a side without one is marked, where a service would refuse it."""
    k = F.col("s_suppkey")
    sides = table(spark, d, "supplier").select(k.alias("rec"), F.when(k % 3 == 0, "front").when(k % 3 == 1, "back").otherwise("unknown").alias("side"))
    fields = dims.templates(spark).select("side", "template_id", "ord", "field", "field_type", "required")
    return sides.join(F.broadcast(fields), "side", "left").select("rec", "template_id", "ord", "field", "field_type", "required", F.col("template_id").isNull().alias("missing"))  # 12 rows


_VARIANTS_SQL = dims.values_sql([(p, i, x) for p, names in dims.VARIANTS.items() for i, x in enumerate(names)], "preprocessor, variant_ord, variant")


@query("preproc_dispatch", f"""SELECT f.template_id, f.field, f.preprocessor, x.variant_ord, x.variant FROM (SELECT template_id, field, CASE WHEN field IN ('national_id', 'date_of_birth') THEN 'digits' WHEN field IN ('name', 'address') THEN 'text' WHEN field = 'gender' THEN 'gender' WHEN field = 'serial_number' THEN 'serial' WHEN field = 'barcode' THEN 'barcode'
  WHEN field_type = 'numeric' THEN 'digits' WHEN field_type = 'barcode' THEN 'barcode' ELSE 'text' END AS preprocessor FROM ({_FIELDS_SQL}) t) f JOIN ({_VARIANTS_SQL}) x ON x.preprocessor = f.preprocessor""")  # fmt: skip
def preproc_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Image variants of each template field: by its name, else by its type, else those of text."""
    known = lambda table_: F.create_map(*[F.lit(x) for kv in table_.items() for x in kv])
    which = F.coalesce(F.try_element_at(known(dims.FIELD_PREPROCESSOR), F.col("field")), F.try_element_at(known(dims.TYPE_PREPROCESSOR), F.col("field_type")), F.lit("text"))
    fields = dims.templates(spark).withColumn("preprocessor", which)
    return fields.join(F.broadcast(dims.variants(spark)), "preprocessor").select("template_id", "field", "preprocessor", "variant_ord", "variant")


# --- sources and sinks ----------------------------------------------------------------------------


@query("upload_gate", f"SELECT rec, CASE WHEN mime NOT IN ('image/jpeg', 'image/png') THEN 415 WHEN size = 0 THEN 400 WHEN size > 15728640 THEN 413 ELSE 200 END AS status FROM {v('uploads')} u")
def upload_gate(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "uploads").select("rec", uploads.gate(F.col("mime"), F.col("size")).alias("status"))


@query("scan_image_filter", f"SELECT rec, path, row_number() OVER (ORDER BY path, rec) AS place FROM {v('uploads')} u WHERE regexp_matches(lower(path), '\\.(jpg|jpeg|png|bmp|tiff|webp)$')")
def scan_image_filter(spark: SparkSession, d: str) -> DataFrame:
    return uploads.ordered(view(spark, d, "uploads").where(uploads.is_image(F.col("path"))).select("rec", "path"))


@query("content_sha256", "SELECT page_id AS rec, sha256(html) AS image_sha256 FROM pages")
def content_sha256(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(F.col("page_id").alias("rec"), F.sha2(F.col("html").cast("binary"), 256).alias("image_sha256"))


@query("label_parse", f"""SELECT rec, cls, n, round(p[1], 5) AS x0, round(p[2], 5) AS y0, round(p[5], 5) AS x1, round(p[6], 5) AS y1 FROM (SELECT rec, CAST(w[1] AS INTEGER) AS cls, len(w) AS n,
  CASE WHEN len(w) = 5 THEN [greatest(0.0, f[1] - f[3] / 2), greatest(0.0, f[2] - f[4] / 2), 0, 0, least(1.0, f[1] + f[3] / 2), least(1.0, f[2] + f[4] / 2)] ELSE f END AS p
FROM (SELECT *, list_transform(w[2:], lambda x: CAST(x AS DOUBLE)) AS f FROM (SELECT rec, {q_words('line')} AS w FROM {v('label_lines')} l) a WHERE len(w) = 5 OR len(w) >= 7) b) c""")  # fmt: skip
def label_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = labels.parsed(view(spark, d, "label_lines"))
    at = lambda i: r(F.element_at("polygon", i), 5)
    return rows.select("rec", "cls", "n", at(1).alias("x0"), at(2).alias("y0"), at(5).alias("x1"), at(6).alias("y1"))


@query("label_pairing", "SELECT p.rec, p.stem, l.label FROM (SELECT page_id AS rec, 'f' || CAST(page_id % 100 AS VARCHAR) AS stem FROM pages) p JOIN (SELECT stem, min(label) AS label FROM (SELECT 'f' || CAST(s_suppkey % 70 AS VARCHAR) AS stem, s_name AS label FROM supplier) s GROUP BY stem) l ON l.stem = p.stem")
def label_pairing(spark: SparkSession, d: str) -> DataFrame:
    images = table(spark, d, "pages").select(F.col("page_id").alias("rec"), F.concat(F.lit("f"), F.col("page_id") % 100).alias("stem"))
    found = table(spark, d, "supplier").select(F.concat(F.lit("f"), F.col("s_suppkey") % 70).alias("stem"), F.col("s_name").alias("label"))
    return labels.paired(images, found)


@query("dataset_split", "SELECT p_partkey AS rec, CASE WHEN p_partkey % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM part")
def dataset_split_(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("rec"), dataset_split(F.col("p_partkey"), 5).alias("split"))


# --- records --------------------------------------------------------------------------------------

_REC_STATUS = f"""(SELECT *, status IN ('EXTRACTED', 'LOW_CONFIDENCE') AS is_read FROM (SELECT *, CASE WHEN crop_empty THEN 'FAILED' WHEN field_type = 'barcode' THEN CASE WHEN decoded THEN 'EXTRACTED' ELSE 'DETECTED' END WHEN field_type = 'image_region' THEN 'DETECTED'
  WHEN NOT has_candidate THEN 'FAILED' WHEN ocr_confidence < 0.55 THEN 'LOW_CONFIDENCE' ELSE 'EXTRACTED' END AS status,
  CASE WHEN crop_empty THEN 'empty_crop' WHEN field_type = 'barcode' THEN NULL WHEN field_type = 'image_region' THEN 'not_an_ocr_field' WHEN NOT has_candidate THEN 'no_text_detected' END AS issue FROM {v('field_reads')} f) s)"""


@query("field_status", f"SELECT rec, field, status, issue FROM {_REC_STATUS} x")
def field_status(spark: SparkSession, d: str) -> DataFrame:
    s = record.field_status()
    return view(spark, d, "field_reads").select("rec", "field", s["status"].alias("status"), s["issue"].alias("issue"))


_READ = f"""(SELECT *, CASE WHEN t IS NULL THEN NULL WHEN field = 'national_id' THEN {q_pnid('t')} WHEN field = 'date_of_birth' THEN coalesce({q_dob('t')}, {q_num('t')}) WHEN field = 'serial_number' THEN {q_serial('t')}
  WHEN field = 'name' THEN {q_name('t')} WHEN field = 'address' THEN CASE WHEN trim(t) = '' THEN '' ELSE {q_address('t')} END ELSE {q_norm('t')} END AS normalized FROM (SELECT *, CASE WHEN is_read THEN raw END AS t FROM {_REC_STATUS} x) y)"""


@query("field_summary", f"""SELECT rec, field, coalesce(nullif(normalized, ''), nullif(t, ''), '-') AS "value", round(ocr_confidence, 4) AS ocr_conf, status, coalesce(issue, '-') AS issues FROM {_READ} r""")
def field_summary(spark: SparkSession, d: str) -> DataFrame:
    """A row for each field, as a reviewer sees it."""
    fields = record.read_fields(view(spark, d, "field_reads"))
    return fields.select("rec", "field", record.either(F.col("normalized"), F.col("raw"), F.lit("-")).alias("value"), r("ocr_confidence", 4).alias("ocr_conf"), "status", F.coalesce("issue", F.lit("-")).alias("issues"))


@query("field_detection_fill", f"""WITH f AS {v('field_reads')}, l AS (SELECT rec, field, localization_confidence FROM f WHERE field <> 'gender' AND rec % 2 = 0) SELECT rec, field, round(coalesce(localization_confidence, 0.0), 4) AS confidence FROM l
UNION ALL SELECT f.rec, f.field, round(coalesce(f.localization_confidence, f.ocr_confidence, 0.0), 4) FROM f LEFT JOIN l ON l.rec = f.rec AND l.field = f.field WHERE l.rec IS NULL""")  # fmt: skip
def field_detection_fill(spark: SparkSession, d: str) -> DataFrame:
    fields = view(spark, d, "field_reads")
    localized = fields.where("field <> 'gender' AND rec % 2 = 0").select("rec", "field", "localization_confidence")
    return record.fill_detections(localized, fields).select("rec", "field", r("confidence", 4).alias("confidence"))


def _pivot(column: str, name: str) -> str:
    return ", ".join(f"max(CASE WHEN field = '{f}' THEN {column} END) AS {f}_{name}" for f in record.FIELDS)


_WIDE = f"(SELECT rec, {_pivot('t', 'raw')}, {_pivot('normalized', 'norm')}, {_pivot('status', 'status')}, {_pivot('ocr_confidence', 'conf')}, {_pivot('localization_confidence', 'loc')} FROM {_READ} r WHERE field <> 'barcode' GROUP BY rec)"
_RECOVERED = f"""(SELECT * REPLACE (CASE WHEN n THEN number ELSE national_id_raw END AS national_id_raw, CASE WHEN n THEN number ELSE national_id_norm END AS national_id_norm, CASE WHEN n THEN 'EXTRACTED' ELSE national_id_status END AS national_id_status, CASE WHEN n THEN 0.95 ELSE national_id_conf END AS national_id_conf,
  CASE WHEN s THEN serial ELSE serial_number_raw END AS serial_number_raw, CASE WHEN s THEN serial ELSE serial_number_norm END AS serial_number_norm, CASE WHEN s THEN 'EXTRACTED' ELSE serial_number_status END AS serial_number_status, CASE WHEN s THEN 0.95 ELSE serial_number_conf END AS serial_number_conf)
FROM (SELECT *, national_id_status IS NOT NULL AND number IS NOT NULL AND coalesce(length(national_id_norm), 0) <> 14 AS n, serial_number_status IS NOT NULL AND serial IS NOT NULL AND (coalesce(serial_number_norm, '') = '' OR serial_number_status IN ('LOW_CONFIDENCE', 'FAILED')) AS s
FROM (SELECT *, nullif(regexp_extract({q_west('address_raw')}, '[23][0-9]{{13}}'), '') AS number, nullif({q_serial('date_of_birth_raw')}, '') AS serial FROM {_WIDE} w) a) b)"""
_CHECKED = f"""(SELECT *, coalesce(national_id_norm, '') <> '' AS validated FROM {q_nid(_RECOVERED, '*', 'national_id_norm').replace('SELECT *, z, status, CASE WHEN going', 'SELECT * EXCLUDE (z, status, going, dated, born, code), z AS nid_z, status AS nid_status, CASE WHEN going')} c)"""
_FULL = "coalesce(nullif(name_norm, ''), nullif(name_raw, ''))"


def _value(f: str) -> str:
    return f"coalesce(nullif({f}_norm, ''), nullif({f}_raw, ''))"


_FLAT = f"""(SELECT rec, {_value('national_id')} AS national_id, {_FULL} AS full_name, {q_words(_FULL)}[1] AS first_name, CASE WHEN len({q_words(_FULL)}) > 1 THEN array_to_string({q_words(_FULL)}[2:], ' ') END AS last_name,
  CASE WHEN validated THEN birth_date ELSE nullif(date_of_birth_norm, '') END AS birth_date, CASE WHEN validated THEN gender ELSE nullif(gender_norm, '') END AS gender, CASE WHEN validated THEN gov_name END AS governorate,
  {_value('address')} AS address, {_value('serial_number')} AS serial_number, round(coalesce(national_id_conf, 0), 4) AS nid_confidence, round(coalesce(name_conf, 0), 4) AS name_confidence, round(coalesce(address_conf, 0), 4) AS address_confidence, round(coalesce(serial_number_conf, 0), 4) AS serial_confidence,
  CASE WHEN national_id_status IS NULL THEN TRUE WHEN validated THEN nid_status <> 'VALID' WHEN national_id_status <> 'EXTRACTED' THEN TRUE ELSE {_value('national_id')} IS NULL OR length({_value('national_id')}) <> 14 END AS review_national_id, {_FULL} IS NULL AS review_full_name,
  CASE WHEN address_status IS NULL THEN TRUE ELSE {_value('address')} IS NULL OR address_status IN ('LOW_CONFIDENCE', 'FAILED') END AS review_address, {_value('serial_number')} IS NULL AS review_serial_number,
  {' + '.join(f"(CASE WHEN {f}_status IS NULL THEN 0 ELSE round(coalesce({f}_loc, {f}_conf, 0), 4) END)" for f in record.FIELDS)} AS detection_sum FROM {_CHECKED} k)"""


def _records(spark: SparkSession, d: str) -> DataFrame:
    return record.assemble(view(spark, d, "field_reads").where("field <> 'barcode'"), as_of())


@query("record_flatten", f"SELECT * REPLACE (round(detection_sum, 4) AS detection_sum) FROM {_FLAT} f")
def record_flatten(spark: SparkSession, d: str) -> DataFrame:
    """Flat records, the nested parts spread out for comparison."""
    flat = _records(spark, d)
    total = F.aggregate(F.map_values("confidence.field_detection"), F.lit(0.0), lambda a, x: a + x)
    scalars = [c for c in flat.columns if c not in ("confidence", "needs_review")]
    parts = {"nid_confidence": "confidence.national_id", "name_confidence": "confidence.first_name", "address_confidence": "confidence.address", "serial_confidence": "confidence.serial_number"}
    return flat.select(*scalars, *(F.col(p).alias(k) for k, p in parts.items()), *(F.col(f"needs_review.{k}").alias(f"review_{k}") for k in ("national_id", "full_name", "address", "serial_number")), r(total, 4).alias("detection_sum"))


@query("record_to_json", f"SELECT rec, '{{\"national_id\":' || CASE WHEN national_id IS NULL THEN 'null' ELSE '\"' || national_id || '\"' END || ',\"gender\":' || CASE WHEN gender IS NULL THEN 'null' ELSE '\"' || gender || '\"' END || ',\"needs_review\":' || CAST(review_national_id AS VARCHAR) || '}}' AS ocr_result FROM {_FLAT} f")
def record_to_json(spark: SparkSession, d: str) -> DataFrame:
    flat = _records(spark, d).select("rec", "national_id", "gender", F.col("needs_review.national_id").alias("needs_review"))
    return flat.select("rec", record.to_json("national_id", "gender", "needs_review").alias("ocr_result"))


@query("sink_projection", f"SELECT s.id, s.original_filename, coalesce(s.image_mime_type, 'application/octet-stream') AS image_mime_type, sha256(s.card_image) AS image_sha256, f.national_id, f.full_name, try_cast(f.birth_date AS DATE) AS birth_date, f.gender, f.governorate, s.capture_quality, 'v1' AS ocr_model_version FROM {v('review_state')} s JOIN {_FLAT} f ON f.rec = s.id")
def sink_projection_(spark: SparkSession, d: str) -> DataFrame:
    uploads_ = view(spark, d, "review_state").select("id", "original_filename", "image_mime_type", F.col("card_image").alias("content"), "capture_quality")
    rows = sink_projection(uploads_.join(_records(spark, d).withColumnRenamed("rec", "id"), "id"), "v1")
    return rows.select("id", "original_filename", "image_mime_type", "image_sha256", "national_id", "full_name", "birth_date", "gender", "governorate", "capture_quality", "ocr_model_version")


@query("batch_map", f"""SELECT rec % 64 AS folder, '{{' || string_agg('"card_' || CAST(rec AS VARCHAR) || '.jpg":' || CAST(to_json({{'national_id': national_id, 'full_name': full_name, 'birth_date': birth_date}}) AS VARCHAR), ',' ORDER BY 'card_' || CAST(rec AS VARCHAR) || '.jpg') || '}}' AS records FROM {_FLAT} f GROUP BY rec % 64""")
def batch_map_(spark: SparkSession, d: str) -> DataFrame:
    """One JSON object of file names and records for each of some folders, as a batch writes it."""
    flat = _records(spark, d).select((F.col("rec") % 64).alias("folder"), F.concat(F.lit("card_"), F.col("rec"), F.lit(".jpg")).alias("name"), F.struct("national_id", "full_name", "birth_date").alias("record"))
    return batch_map(flat, "folder")


@query("full_record")
def full_record(spark: SparkSession, d: str) -> DataFrame:
    """Everything that is known of a record, as JSON."""
    fields = record.read_fields(view(spark, d, "field_reads").where("field <> 'barcode'"))
    wide = record.verified(record.recovered(record.pivoted(fields)), as_of())
    return wide.select("rec", record.to_json(*[c for c in wide.columns if c != "rec"]).alias("diagnostics"))


# --- review ---------------------------------------------------------------------------------------

_STATE = v("review_state")
_SEARCH = "contains(lower(coalesce(full_name, '')), '01') OR contains(lower(national_id), '01') OR contains(lower(governorate), '01')"


@query("review_all", f"SELECT id, original_filename, image_mime_type, national_id, full_name, birth_date, governorate, capture_quality, review_status, decision_note, ocr_model_version FROM {_STATE} s")
def review_all(spark: SparkSession, d: str) -> DataFrame:
    return review.listing(view(spark, d, "review_state"))


@query("review_by_id", f"SELECT a.asked, CASE WHEN s.id IS NULL THEN 404 ELSE 200 END AS status, CASE WHEN s.id IS NULL THEN 'Record doesn''t exist.' ELSE 'OK.' END AS message, s.national_id, s.full_name, s.review_status FROM (SELECT DISTINCT id AS asked FROM {v('review_req')} q) a LEFT JOIN {_STATE} s ON s.id = a.asked")
def review_by_id(spark: SparkSession, d: str) -> DataFrame:
    return review.by_id(view(spark, d, "review_state"), view(spark, d, "review_req").select("id").distinct())


@query("review_image_b64", f"SELECT id, image_mime_type, base64(card_image) AS image_base64 FROM {_STATE} s")
def review_image_b64(spark: SparkSession, d: str) -> DataFrame:
    return review.image(view(spark, d, "review_state"))


@query("portal_search", f"SELECT id, national_id, full_name, governorate, review_status FROM {_STATE} s WHERE ({_SEARCH}) AND upper(review_status) = 'PENDING'")
def portal_search(spark: SparkSession, d: str) -> DataFrame:
    return review.search(view(spark, d, "review_state"), " 01 ", "PENDING").select("id", "national_id", "full_name", "governorate", "review_status")


@query("portal_counts", f"SELECT count(*) FILTER (WHERE {_SEARCH}) AS shown, count(*) AS total FROM {_STATE} s")
def portal_counts(spark: SparkSession, d: str) -> DataFrame:
    return review.counts(view(spark, d, "review_state"), "01")


@query("display_projection", f"""SELECT id, coalesce(nullif(full_name, ''), 'N/A') AS full_name, coalesce(nullif(national_id, ''), 'N/A') AS national_id, coalesce(CAST(birth_date AS VARCHAR), 'N/A') AS birth_date, coalesce(nullif(governorate, ''), 'N/A') AS governorate, coalesce(nullif(decision_note, ''), 'N/A') AS decision_note,
  CASE upper(review_status) WHEN 'ACCEPTED' THEN 'green' WHEN 'REJECTED' THEN 'red' WHEN 'PENDING' THEN 'yellow' ELSE 'gray' END AS status_badge, CASE upper(capture_quality) WHEN 'GOOD' THEN 'green' WHEN 'BORDERLINE' THEN 'yellow' WHEN 'BAD' THEN 'red' ELSE 'gray' END AS quality_badge FROM {_STATE} s""")  # fmt: skip
def display_projection(spark: SparkSession, d: str) -> DataFrame:
    return review.display(view(spark, d, "review_state"))


@query("review_transition", f"""WITH q AS (SELECT r.req, r.id, r.action, r.decision_note, s.review_status AS was, coalesce(r.action = 'approve' OR (r.action = 'reject' AND trim(coalesce(r.decision_note, '')) <> ''), FALSE) AS reason FROM {v('review_req')} r LEFT JOIN {_STATE} s ON s.id = r.id),
t AS (SELECT *, coalesce(max(CASE WHEN was = 'PENDING' AND reason THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY req ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM q),
u AS (SELECT *, CASE WHEN was IS NULL THEN 404 WHEN was <> 'PENDING' OR taken = 1 THEN 409 WHEN NOT reason THEN 400 ELSE 200 END AS status FROM t)
SELECT req, id, status, CASE WHEN status = 200 THEN CASE WHEN action = 'approve' THEN 'ACCEPTED' ELSE 'REJECTED' END END AS review_status, CASE WHEN status = 200 THEN 'admin' END AS reviewed_by, CASE WHEN status = 200 THEN decision_note END AS decision_note FROM u""")  # fmt: skip
def review_transition(spark: SparkSession, d: str) -> DataFrame:
    return review.transition(view(spark, d, "review_state"), view(spark, d, "review_req")).drop("reviewed_at")
