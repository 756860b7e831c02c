"""Rows in a space-filling order, so that filters on several columns and pages read few row groups.

``z_order`` interleaves the bits of small whole numbers, such as those of a
region, a status and a month. Files hold ranges of it and are sorted by it and
the id, so the least and greatest values of a row group tell whether a page or a
filter needs it; a Bloom filter on the id tells the same for lookups.

Defined results: null numbers count as zero and numbers beyond the bits are held
at their ends; rows of the same place go by id, which must be there and unique
for pages to be whole; a page after the last row is empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a row group, and rows that a file's Bloom filter is made for.
GROUP_BYTES, FILE_ROWS = 16 << 20, 1 << 20


def z_order(*columns: Column, bits: int = 5) -> Column:
    """The bits of the columns in turn, the first column's first, as a long."""
    held = [F.greatest(F.lit(0), F.least(F.lit((1 << bits) - 1), F.coalesce(c, F.lit(0)))).cast("long") for c in columns]
    parts = [F.shiftleft(F.shiftright(c, k).bitwiseAND(F.lit(1)), k * len(held) + len(held) - 1 - i) for i, c in enumerate(held) for k in range(bits)]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def write_clustered(rows: DataFrame, path: str, z: Column, parts: int | None = None, group_bytes: int = GROUP_BYTES, file_rows: int = FILE_ROWS) -> None:
    """The rows and their place ``z``, in files by range of (z, id), with Bloom filters on id."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.withColumn("z", z).repartitionByRange(parts, "z", "id").sortWithinPartitions("z", "id")
    options = {"parquet.block.size": group_bytes, "parquet.bloom.filter.enabled#id": "true", "parquet.bloom.filter.expected.ndv#id": file_rows}
    placed.write.options(**{k: str(v) for k, v in options.items()}).parquet(path)


def page(spark: SparkSession, path: str, size: int, after: tuple[int, int] | None = None) -> DataFrame:
    """The next ``size`` rows in order of (z, id), after the last one of the page before."""
    rows = spark.read.parquet(path)
    if after is not None:
        z, key = after
        rows = rows.where((F.col("z") >= z) & ((F.col("z") > z) | (F.col("id") > key)))
    return rows.orderBy("z", "id").limit(size)


def by_id(spark: SparkSession, path: str, *ids: int) -> DataFrame:
    """The rows of a few ids. Each is asked for by itself, as Bloom filters answer to equality."""
    rows = spark.read.parquet(path)
    if not ids:
        return rows.limit(0)
    return reduce(DataFrame.unionByName, [rows.where(F.col("id") == i) for i in sorted(set(ids))])
