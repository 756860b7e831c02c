"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``POINTS`` points of a ring of 2^32 places, which cut it into
arcs. A row falls on the arc of its hash. A shard takes at most its share of
the rows, shares being at most one apart, so the law is ``rows``. What a full
shard cannot take goes on clockwise to the next point, round after round; all
arcs go on in step, and within a round a shard takes from its points in the
order of the ring. The rows of an arc are taken in an order of their own hashes.

Only counts of arcs, as many as the ring has points, are needed to settle who
takes how many; every row then finds its shard by its rank in its arc. An
arc is cut into stretches by hash, as many as its rows ask for, and ranks are
counted within those, so that no task sorts an arc. A stretch that is still too
large, as rows of equal content share one, is cut by the places of its staged
rows. Everything is DataFrame functions.

A further shard adds points and lowers the shares: rows move to it, and rows
that had overflowed may move back or on; the rest stay.

Groups (equal texts) are not kept together: this law has to cut a group that
is larger than a shard's share.

Defined results: a null text has no bytes (size 8) and checksum 0; a null
doc_id hashes like the empty string; a very long text counts one row like any
other; repeated rows are rows of their own and get slots of their own, in no set
order among themselves (ties); an empty table gives an empty table; only doc_id
and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.llm.common import documents, staged, table, with_place

SHARDS = 24
POINTS = 128
RING = 1 << 32
#: Bits of a place below its cell.
CELL = 20
#: Rows of one stretch of an arc.
STRETCH = 50_000


def ring(shards: int, points: int = POINTS) -> tuple[list[int], list[int]]:
    """The points in order, and the shard of each. A shard's points do not depend on the others."""
    at = sorted((int.from_bytes(hashlib.md5(f"{s}/{p}".encode()).digest()[:4], "big"), s) for s in range(shards) for p in range(points))
    return [x for x, _ in at], [s for _, s in at]


def cells(at: list[int]) -> list[tuple[int, int, int, int]]:
    """(cell, arc, low, high): the arcs (low, high] that each equal cell of the ring meets.

    An arc ends at its point; what lies beyond the last point belongs to the first.
    """
    edges = [-1, *at, RING - 1]
    return [(cell, arc % len(at), low, high) for arc, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)) for cell in range(low + 1 >> CELL, (high >> CELL) + 1) if high > low]


def settle(counts: list[int], owners: list[int], shares: list[int]) -> list[tuple[int, int, int, int]]:
    """(arc, first rank, rows, shard): who takes which ranks of each arc."""
    left, used, room = list(counts), [0] * len(counts), list(shares)
    taken, n, waiting = [], len(counts), [a for a, c in enumerate(counts) if c]
    for round_ in range(n):
        if not waiting:
            break
        # within a round, each point serves the one arc that is ``round_`` points before it
        for arc in sorted(waiting, key=lambda a: (a + round_) % n):
            shard = owners[(arc + round_) % n]
            k = min(left[arc], room[shard])
            if k:
                taken.append((arc, used[arc], k, shard))
                used[arc] += k
                left[arc] -= k
                room[shard] -= k
        waiting = [a for a in waiting if left[a]]
    return taken


def shard(docs: DataFrame, shards: int = SHARDS, points: int = POINTS, text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard) of each row."""
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8
    crc = F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0).cast("long"))
    place = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")
    rows = documents(docs, size.alias("size"), crc.alias("text_crc32")).withColumn("place", place)
    at, owners = ring(shards, points)
    arcs = F.broadcast(spark.createDataFrame(cells(at), "cell long, arc long, low long, high long"))
    on_arc = (F.shiftright("place", CELL) == F.col("cell")) & (F.col("place") > F.col("low")) & (F.col("place") <= F.col("high"))
    rows = staged(rows.join(arcs, on_arc).drop("cell", "low", "high"), "ring")
    counts = [0] * len(at)
    for r in rows.groupBy("arc").count().collect():  # a row for each point at most
        counts[r["arc"]] = r["count"]
    total = sum(counts)
    shares = [total // shards + (s < total % shards) for s in range(shards)]
    taken = settle(counts, owners, shares)
    filled, segments = [0] * shards, []
    for arc, first, n, s in taken:
        segments.append((arc, first, first + n, s, filled[s] - first))
        filled[s] += n
    segments = spark.createDataFrame(segments, "arc long, low long, high long, shard int, shift long")
    stretches = total // (len(at) * STRETCH) + 1
    rows = with_place(rows, "at").withColumn("stretch", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(stretches)))
    large = rows.groupBy("arc", "stretch").count().where(F.col("count") > 2 * STRETCH).select("arc", "stretch", (F.col("count") / STRETCH).cast("long").alias("parts"))
    rows = rows.join(large, ["arc", "stretch"], "left").withColumn("part", F.coalesce(F.pmod("at", "parts"), F.lit(0))).drop("parts")
    key = ["arc", "stretch", "part"]
    before = F.sum("count").over(Window.partitionBy("arc").orderBy("stretch", "part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = rows.groupBy(*key).count().select(*key, F.coalesce(before, F.lit(0)).alias("before"))
    row = F.row_number().over(Window.partitionBy(*key).orderBy("place", "doc_id", "size", "text_crc32", "at")) - 1
    ranked = rows.withColumn("row", row).join(sizes, key).withColumn("rank", F.col("row") + F.col("before"))
    seated = ranked.join(F.broadcast(segments), "arc").where("rank >= low AND rank < high")
    return seated.select("doc_id", "size", "text_crc32", "shard", (F.col("rank") + F.col("shift")).alias("slot"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
