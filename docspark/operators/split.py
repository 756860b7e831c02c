"""An exact share of each class by keyed hash, without sorting a class.

The keys of a class go by the SHA-256 of the seed and the key; the first
``floor(n * share)`` are for validation. The last of them is found digit by
digit: a histogram of the next ``DIGITS`` hexadecimal digits tells in which bin
it lies, and only the rows of that bin are looked at for the next ones, until no
bin holds more than ``FEW``. Those few are ranked, and each class ends with one
hash that parts it. A class may hold any share of all rows.

Defined results: a key that comes in several rows of a class counts once and all
of its rows go to one side; a null class is a class of its own; rows without a
key go to training; classes with too few keys for the share have no validation
rows; the result depends on nothing but the keys, the classes and the seed.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.sinks import shared

DIGITS, FEW = 3, 10_000
WHOLE = 64


def keyed_hash(key: Column, seed: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}|"), key.cast("string")).cast("binary"), 256)


def bounds(keys: DataFrame, share: Fraction, few: int = FEW) -> DataFrame:
    """cls and bound, the hash of the last validation key, of each class that has one; ``keys``: cls and hash, once each."""
    counts = keys.groupBy("cls").agg(F.count("*").alias("n"))
    need = counts.select("cls", F.lit("").alias("prefix"), F.floor(F.col("n") * share.numerator / share.denominator).cast("long").alias("need")).where("need > 0")
    depth, rows = 0, keys
    while depth < WHOLE:
        depth = min(WHOLE, depth + DIGITS)
        at, before = need.alias("s"), depth - DIGITS
        rows = rows.alias("k").join(at, (F.col("k.cls").eqNullSafe(F.col("s.cls"))) & (F.substring("k.hash", 1, max(0, before)) == F.col("s.prefix"))).select("k.cls", "k.hash", "s.need")
        rows = shared.staged(rows, "bins")
        bins = rows.groupBy("cls", F.substring("hash", 1, depth).alias("prefix"), "need").agg(F.count("*").alias("rows"))
        upto = F.sum("rows").over(Window.partitionBy("cls").orderBy("prefix"))  # 16^DIGITS bins of a class at most
        need = bins.withColumn("upto", upto).where("upto >= need AND upto - rows < need").select("cls", "prefix", (F.col("need") - F.col("upto") + F.col("rows")).alias("need"), "rows")
        need = shared.staged(need, "split")
        most = need.agg(F.max("rows")).first()[0]
        rows, need = rows.drop("need"), need.drop("rows")
        if most is None or most <= few:
            break
    last = rows.alias("k").join(need.alias("s"), F.col("k.cls").eqNullSafe(F.col("s.cls")) & F.col("k.hash").startswith(F.col("s.prefix"))).select("k.cls", "k.hash", "s.need")
    place = F.row_number().over(Window.partitionBy("cls").orderBy("hash"))
    return last.withColumn("place", place).where("place = need").select("cls", F.col("hash").alias("bound"))


def stratified(rows: DataFrame, key: str, by: str, share: Fraction = Fraction(1, 5), seed: str = "split", few: int = FEW) -> DataFrame:
    """``rows`` with split: val for the share of each class's keys of least hash, else train."""
    marked = rows.withColumn("__hash", keyed_hash(F.col(key), seed))
    keys = marked.where("__hash IS NOT NULL").select(F.col(by).alias("cls"), F.col("__hash").alias("hash")).distinct()
    edge = shared.staged(bounds(shared.staged(keys, "keys"), share, few), "bounds")
    edge = edge.select(F.col("cls").alias("__cls"), F.col("bound").alias("__bound"))
    joined = marked.join(edge, F.col(by).eqNullSafe(F.col("__cls")), "left")
    val = F.coalesce(F.col("__hash") <= F.col("__bound"), F.lit(False))
    return joined.select(*rows.columns, F.when(val, "val").otherwise("train").alias("split"))
