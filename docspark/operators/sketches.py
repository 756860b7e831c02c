"""Quantiles from KLL sketches that partitions and days can be merged from.

A sketch of a group holds some ``k`` values, not all of them, so partial
sketches meet in a shuffle of bounded rows, whatever a group's share of the
table; ``percentile`` in its place keeps every value of a group. The normalized
rank of an answer is off by at most ``rank_error(k)`` in 99 of 100 cases,
merged or not; groups of up to ``k`` values are exact to a rank.

Defined results: null values do not count, NaN is left out, a group without
values has a null quantile; merging sketches of different ``k`` keeps the error
of the smaller one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 800


def rank_error(k: int = K) -> float:
    """Of a single quantile, at 99 % confidence, as the sketch's authors have measured it."""
    return 2.296 / k**0.9021


def sketched(rows: DataFrame, value: str, *by: str, k: int = K) -> DataFrame:
    """A sketch of the values of each group."""
    number = F.col(value).cast("double")
    return rows.groupBy(*by).agg(F.kll_sketch_agg_double(F.when(~F.isnan(number), number), k).alias("sketch"))


def merged(sketches: DataFrame, *by: str) -> DataFrame:
    """One sketch for each group out of those of its parts."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def quantiles(sketches: DataFrame, *shares: float) -> DataFrame:
    """n and quantiles (an array, one for each share) in place of the sketch."""
    rest = [c for c in sketches.columns if c != "sketch"]
    n = F.coalesce(F.kll_sketch_get_n_double("sketch"), F.lit(0))
    found = F.array(*[F.when(n > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(s)))) for s in shares])
    return sketches.select(*rest, n.alias("n"), found.alias("quantiles"))
