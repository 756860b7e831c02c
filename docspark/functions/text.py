"""Text normalization: digits, tatweel, noise, white space. Null counts as the empty string."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark import dims

_PLAIN = dict(zip(dims.ARABIC_DIGITS + dims.PERSIAN_DIGITS, "0123456789" * 2, strict=True)) | {dims.TATWEEL: ""}
_ODD = re.compile(f"[{dims.ARABIC_DIGITS}{dims.PERSIAN_DIGITS}{dims.TATWEEL}]")
#: Runs of noise and white space.
BLANK = r"(?U)[\s" + dims.NOISE[1:]


def nonempty(c: Column) -> Column:
    """Null in place of the empty string: both mean "not there"."""
    return F.nullif(c, F.lit(""))


def either(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[nonempty(c) for c in columns])


def digits_to_western(c: Column) -> Column:
    return F.translate(c, dims.ARABIC_DIGITS + dims.PERSIAN_DIGITS, "0123456789" * 2)


def strip_tatweel(c: Column) -> Column:
    return F.replace(c, F.lit(dims.TATWEEL), F.lit(""))


@F.pandas_udf(T.StringType())
def nfkc_in_python(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(c: Column) -> Column:
    """Compatibility normalization; ASCII, which it cannot change, does not go through Python."""
    return F.coalesce(nfkc_in_python(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


@F.pandas_udf(T.StringType())
def folded_in_python(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else _ODD.sub(lambda m: _PLAIN[m[0]], unicodedata.normalize("NFKC", t)))


def folded(c: Column) -> Column:
    """Compatibility normalization, western digits and no tatweel; ASCII, which none of it changes, stays in the JVM."""
    return F.coalesce(folded_in_python(F.when(F.octet_length(c) > F.length(c), c)), c)


def squeeze(c: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_text(c: Column, compatibility: bool = True) -> Column:
    text = F.coalesce(c, F.lit(""))
    text = folded(text) if compatibility else digits_to_western(strip_tatweel(text))
    return F.trim(F.regexp_replace(text, BLANK, " "))


def normalize_numeric(c: Column) -> Column:
    return F.regexp_replace(digits_to_western(F.coalesce(c, F.lit(""))), r"(?U)[^\d]", "")


def field_value(c: Column, numeric: bool = False) -> Column:
    return F.struct(c.alias("raw"), (normalize_numeric(c) if numeric else normalize_text(c)).alias("normalized"))


def tokens(c: Column) -> Column:
    """Words between white space; none for an empty text."""
    return F.filter(F.split(squeeze(c), " "), lambda w: w != "")
