"""The 14-digit id number: check digit, structure, derived values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark import dims
from docspark.functions.text import normalize_numeric


def _digit(z: Column, at: int) -> Column:
    return F.substring(z, at, 1).try_cast("int")


def check_digit(z: Column) -> Column:
    """The digit that belongs behind the first 13."""
    total = sum((_digit(z, i + 1) * w for i, w in enumerate(dims.CHECK_WEIGHTS)), F.lit(0))
    return (11 - total % 11) % 10


def birth_date(z: Column) -> Column:
    """The date in digits 1 to 7, null if the century is unknown or there is no such day."""
    century = F.when(F.substring(z, 1, 1) == "2", "19").when(F.substring(z, 1, 1) == "3", "20")
    iso = F.concat_ws("-", F.concat(century, F.substring(z, 2, 2)), F.substring(z, 4, 2), F.substring(z, 6, 2))
    return F.when(century.isNotNull() & (F.length(z) >= 7), iso.try_cast("date"))


def gender(z: Column) -> Column:
    return F.when(F.length(z) >= 13, F.when(_digit(z, 13) % 2 == 1, "male").otherwise("female"))


def governorate_code(z: Column) -> Column:
    code = F.substring(z, 8, 2)
    return F.when((F.length(z) >= 9) & code.isin([g[0] for g in dims.GOVERNORATES]), code)


def governorate_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for g in dims.GOVERNORATES for x in g[:2]])
    return F.try_element_at(names, code)


def validate(raw: Column, as_of: Column) -> Column:
    """normalized, status, warnings and derived values, as one expression. Of many rows, ``validated`` costs less."""
    z = normalize_numeric(raw)
    return _result(z, birth_date(z), governorate_code(z), as_of)


def validated(df: DataFrame, raw: Column, as_of: Column, name: str = "validation") -> DataFrame:
    """``df`` with that result as a column; digits, date and code are computed once, each in a projection of its own."""
    z, born, code = (f"__{name}_{x}" for x in ("z", "born", "code"))
    out = df.withColumn(z, normalize_numeric(raw)).withColumns({born: birth_date(F.col(z)), code: governorate_code(F.col(z))})
    return out.withColumn(name, _result(F.col(z), F.col(born), F.col(code), as_of)).drop(z, born, code)


def _result(z: Column, born: Column, code: Column, as_of: Column) -> Column:
    """A date that cannot be, or lies after ``as_of``, ends it all."""
    n, first = F.length(z), F.substring(z, 1, 1)
    dated = (n >= 7) & first.isin("2", "3")
    bad_date = dated & (born.isNull() | (born > as_of))
    on = ~bad_date & (n > 0)
    status = (
        F.when(n == 0, "INVALID_FORMAT")
        .when(bad_date, "INVALID_DATE")
        .when(n != 14, "INVALID_FORMAT")
        .when(~first.isin("2", "3"), "INVALID_STRUCTURE")
        .when(code.isNull(), "INVALID_GOVERNORATE")
        .when(check_digit(z) != _digit(z, 14), "INVALID_CHECKSUM")
        .otherwise("VALID")
    )
    whole = (n == 14) & first.isin("2", "3") & ~bad_date & code.isNotNull()
    zeros = F.when(whole & (F.substring(z, 10, 4) == "0000"), F.array(F.lit("serial_zeros"))).otherwise(F.array().cast("array<string>"))
    derived = F.struct(
        F.when(on & dated, F.date_format(born, "yyyy-MM-dd")).alias("birth_date"),
        F.when(on, code).alias("governorate_code"),
        F.when(on, governorate_name(code)).alias("governorate_name"),
        F.when(on, gender(z)).alias("gender"),
    )
    return F.struct(z.alias("normalized"), status.alias("status"), zeros.alias("warnings"), derived.alias("derived"))
