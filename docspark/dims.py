"""Lookup tables, word lists, thresholds and vocabularies, and their DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Canonical card space and thresholds.
CANONICAL_WIDTH, CANONICAL_HEIGHT = 1600, 1009
PROCESSING_MAX_DIM = 1600
BLUR_MIN, CROP_HEIGHT_MIN = 60.0, 20
LOW_CONFIDENCE_OCR = 0.55
MAX_UPLOAD_BYTES = 15 * 1024 * 1024
UPLOAD_TYPES = ("image/jpeg", "image/png")
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".webp")

# Digits, tatweel and noise.
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
TATWEEL = "ـ"
NOISE = r"[|_\\/~`\^\*]+"

# Region codes of the id number, with both names.
GOVERNORATES = [
    ("01", "القاهرة", "Cairo"),
    ("02", "الإسكندرية", "Alexandria"),
    ("03", "بورسعيد", "Port Said"),
    ("04", "السويس", "Suez"),
    ("11", "دمياط", "Damietta"),
    ("12", "الدقهلية", "Dakahlia"),
    ("13", "الشرقية", "Ash Sharqia"),
    ("14", "القليوبية", "Kaliobeya"),
    ("15", "كفر الشيخ", "Kafr El Sheikh"),
    ("16", "الغربية", "Gharbia"),
    ("17", "المنوفية", "Monoufia"),
    ("18", "البحيرة", "Beheira"),
    ("19", "الإسماعيلية", "Ismailia"),
    ("21", "الجيزة", "Giza"),
    ("22", "بني سويف", "Beni Suef"),
    ("23", "الفيوم", "Fayoum"),
    ("24", "المنيا", "Minya"),
    ("25", "أسيوط", "Asyut"),
    ("26", "سوهاج", "Sohag"),
    ("27", "قنا", "Qena"),
    ("28", "أسوان", "Aswan"),
    ("29", "الأقصر", "Luxor"),
    ("31", "البحر الأحمر", "Red Sea"),
    ("32", "الوادي الجديد", "New Valley"),
    ("33", "مطروح", "Matrouh"),
    ("34", "شمال سيناء", "North Sinai"),
    ("35", "جنوب سيناء", "South Sinai"),
    ("88", "خارج مصر (مواليد خارج جمهورية مصر العربية)", "Born Abroad"),
]

# Weights of the check digit.
CHECK_WEIGHTS = (2, 7, 6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2)

# Classes of the localizer, in order of id, and the field type of each.
CLASSES = ["national_id", "name", "date_of_birth", "gender", "birth_governorate", "profession", "address", "barcode", "photo"]
CLASS_TYPES = {"national_id": "numeric", "name": "arabic_text", "date_of_birth": "numeric", "gender": "arabic_text", "birth_governorate": "arabic_text", "profession": "arabic_text", "address": "arabic_text", "barcode": "text", "photo": "image_region"}

# Templates (id, side, fields in order: name, x, y, w, h, type, required).
TEMPLATES = [
    ("egy_id_front_v1", "front", [
        ("photo", 0.03, 0.050, 0.28, 0.620, "image_region", True),
        ("name", 0.33, 0.260, 0.65, 0.200, "arabic_text", True),
        ("address", 0.33, 0.460, 0.65, 0.250, "arabic_text", True),
        ("national_id", 0.33, 0.710, 0.65, 0.170, "numeric", True),
        ("date_of_birth", 0.03, 0.680, 0.32, 0.170, "numeric", False),
        ("serial_number", 0.05, 0.850, 0.30, 0.130, "text", False),
    ]),
    ("egy_id_back_v1", "back", [
        ("job_or_status", 0.05, 0.06, 0.55, 0.14, "arabic_text", True),
        ("gender", 0.05, 0.22, 0.30, 0.12, "arabic_text", True),
        ("religion", 0.38, 0.22, 0.30, 0.12, "arabic_text", False),
        ("marital_status", 0.05, 0.36, 0.30, 0.12, "arabic_text", False),
        ("husband_name", 0.05, 0.50, 0.60, 0.12, "arabic_text", False),
        ("barcode", 0.55, 0.60, 0.42, 0.35, "barcode", True),
    ]),
]

# Image variants of each preprocessor, and the preprocessor of each field and type.
VARIANTS = {
    "digits": ["illum_sharpened", "clahe_norm", "otsu_thresh", "rgb_original"],
    "text": ["illum_norm", "ink_isolated", "denoised_norm", "clahe_norm", "rgb_minimal"],
    "gender": ["contrast_norm", "clahe_only"],
    "barcode": ["contrast_norm", "sharpened"],
    "serial": ["contrast_norm", "clahe_only", "otsu_thresh"],
}
FIELD_PREPROCESSOR = {"national_id": "digits", "name": "text", "address": "text", "date_of_birth": "digits", "gender": "gender", "serial_number": "serial", "barcode": "barcode"}
TYPE_PREPROCESSOR = {"numeric": "digits", "barcode": "barcode"}

# Phrases removed anywhere in a name, and in an address.
NAME_PHRASES = ["جمهورية مصر العربية", "جمهرية مصر العريبه", "بطاقة تحقيق الشخصية", "بطاقة تحقيق الشخصيه", "بطاقه تحقيق الشخصيه", "قطاع مصلحة الاحوال المدنية", "مصلحة الاحوال المدنية", "وزارة الداخلية", "الرقم القومي", "الرقم القومى", "بطاقة شخصية", "بطاقه شخصيه"]
ADDRESS_PHRASES = ["جمهورية مصر العربية", "جمهرية مصر العريبه", "بطاقة تحقيق الشخصية", "بطاقة تحقيق الشخصيه", "بطاقه تحقيق الشخصيه", "وزارة الداخلية", "مصلحة الاحوال المدنية", "بطاقة", "تحقيق", "الشخصية", "الشخصيه", "العنوان"]
ADDRESS_TOKENS = ["بطاقة", "بطاقه", "تحقيق", "الشخصية", "الشخصيه"]

# Headers removed from the front of a name, in the order of the alternatives.
HEADER_PHRASES = [
    r"جمهورية\s+مصر\s+العربية", r"جمهرية\s+مصر\s+العريبه", r"بطاقة\s+تحقيق\s+الشخصية", r"بطاقة\s+تحقيق\s+الشخصيه",
    r"بطاقه\s+تحقيق\s+الشخصيه", r"قطاع\s+مصلحة\s+الاحوال\s+المدنية", r"قطاع\s+مصلحه\s+الاحوال\s+المدنيه", r"مصلحة\s+الاحوال\s+المدنية",
    r"مصلحه\s+الاحوال\s+المدنيه", r"قطاع\s+الاحوال\s+المدنية", r"وزارة\s+الداخلية", r"وزاره\s+الداخليه",
    r"الرقم\s+القومي", r"الرقم\s+القومى", r"بطاقة\s+شخصية", r"بطاقه\s+شخصيه",
]
HEADER_WORDS = """جمهورية جمهرية جحورية جهمورية العربية العريبه بطاقة بطاقه بطافة بطافه بطاهة بطاهه بطقه بفاقة بفاقه تحقيق تحقيف حميق
    نحقيق ثحقيق الشخصية الشخصيه الشحصية الشحصيه شخصية شخصيه شحصية شحصيه الشخص الشحص مصلحة مصلحه الاحوال المدنية المدنيه الداخلية
    الداخليه الاسم العنوان المهنة المهنه الديانة الديانه الجنس طاة يق الة cطاة تحقي""".split()

# Words that are headers, and keywords that words may come near to.
HEADER_TOKENS = """جمهورية جمهرية جحورية جهمورية مصر العربية العريبه بطاقة بطاقه بطافة بطافه بطاهة بطاهه بطقه بفاقة بفاقه طاة cطاة
    تحقيق تحقيف حميق نحقيق ثحقيق يق تحقي الشخصية الشخصيه الشحصية الشحصيه شخصية شخصيه شحصية شحصيه الشخص الشحص مصلحة مصلحه الاحوال
    المدنية المدنيه الداخلية الداخليه الاسم العنوان المهنة المهنه الديانة الديانه الجنس""".split()
HEADER_KEYWORDS = ["بطاقة", "تحقيق", "الشخصية", "جمهورية", "العربية", "الداخلية", "الاحوال", "المدنية"]

# Frequent misreadings of names (those with a tatweel cannot occur after normalization).
NAME_CORRECTIONS = {
    "محمد": ["محمدا", "محمدم", "محمدة", "محمده", "محمل", "ممد"],
    "مصطفى": ["مصطفا", "مصطفىا", "مصطفط"],
    "احمد": ["احمدا", "احمدم", "احمدة", "احمده", "احم"],
    "خالد": ["خالدا", "خالدف", "خالدم"],
    "محمود": ["محمودا", "محمودم"],
    "هيام": ["هياما"],
}

MALE, FEMALE = "ذكر", ("أنث", "انث")


def governorates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *g) for i, g in enumerate(GOVERNORATES)], "ord int, code string, name string, name_en string")


def templates(spark: SparkSession) -> DataFrame:
    rows = [(t, side, i, *f) for t, side, fields in TEMPLATES for i, f in enumerate(fields)]
    return spark.createDataFrame(rows, "template_id string, side string, ord int, field string, x double, y double, w double, h double, field_type string, required boolean")


def classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, c, CLASS_TYPES[c]) for i, c in enumerate(CLASSES)], "cls_id int, cls string, field_type string")


def variants(spark: SparkSession) -> DataFrame:
    rows = [(p, i, v) for p, names in VARIANTS.items() for i, v in enumerate(names)]
    return spark.createDataFrame(rows, "preprocessor string, variant_ord int, variant string")


def values_sql(rows: list[tuple], columns: str) -> str:
    """The rows as a SELECT that any SQL engine can read."""
    put = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else repr(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"
    names = columns.split(", ")
    return " UNION ALL ".join("SELECT " + ", ".join(f"{put(v)} AS {n}" for v, n in zip(row, names, strict=True)) for row in rows)
