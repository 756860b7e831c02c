"""Packing documents into sequences: shortest pack first, over the histogram of lengths.

A document's ids, with its end id, are cut into pieces of at most ``size``: all
but the last are full. The histogram of piece lengths (at most ``size``
numbers) is all that the plan needs: lengths are placed from the longest to the
shortest, each into the pack with the most room that still takes it, and what
is counted are patterns of lengths, not documents. The pieces of one length
then take the places that the patterns have for it by rank.

Ranks are dealt: a length is split into as many buckets as its count asks for,
by the places of the staged pieces and not by what they hold, so no task gets all
pieces of a common length, nor all of one text, of one doc_id or of none.

Defined results: a null or empty text is its end id alone; a very long one is cut
into full pieces and a rest; a document without doc_id is packed like any other;
repeated rows are packed as often as they come; which of the pieces of one length
gets which place is not said (ties); an empty table gives no sequence; of the
documents only doc_id and text are read, and ``assign`` names its own columns
around those of its input, so none can clash.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.llm.common import documents, free_name, in_arrow, staged, table, utf8, with_place
from docspark.llm.tokens import encoder

SIZE = 2048
END = 1
BUCKET = 2_000
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


def _pieces(path: str, end: int, size: int):
    last = end.to_bytes(4, "little")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = encoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                rows: list[tuple] = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), strict=True):
                    raw = memo.ids(text) + last
                    n = len(raw) // 4
                    rows += [(doc, i, min(size, n - i), n, raw[4 * i : 4 * (i + size)]) for i in range(0, n, size)]
                types = [pa.int64()] * 4 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "start", "length", "doc_tokens", "ids"])
        memo.rest()

    return run


def pieces(docs: DataFrame, path: str, end: int = END, size: int = SIZE, text: str = "text") -> DataFrame:
    """A row for each piece, with its ids as little-endian unsigned 32-bit integers; nothing is shuffled."""
    return documents(docs, F.col(text).alias("text")).transform(in_arrow, _pieces(path, end, size), PIECES)


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, list[int]]]:
    """Patterns (how many packs, lengths in them) for so many pieces of each length."""
    room: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            most = max((r for r, packs in room.items() if packs and r >= length), default=None)
            if most is None:
                room[size - length].append((left, [length]))
                break
            packs, lengths = room[most].pop()
            taken = min(packs, left)
            if packs > taken:
                room[most].append((packs - taken, lengths))
            room[most - length].append((taken, [*lengths, length]))
            left -= taken
    return [p for r in sorted(room) for p in room[r]]


def places(patterns: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset): from that rank on, sequences follow one another."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for packs, lengths in patterns:
        offset = 0
        for length in lengths:
            rows.append((length, used[length], sequence, offset))
            used[length] += packs
            offset += length
        sequence += packs
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def _seated(table: np.ndarray, columns: list[str], ranks: str):
    """Looks each piece's length and rank up in the plan, whose size only ``size`` bounds."""
    keys = (table[:, 0] << 44) | table[:, 1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", ranks))
            at = np.searchsorted(keys, (length << 44) | rank, side="right") - 1
            sequence = table[at, 2] + rank - table[at, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sequence), pa.array(table[at, 3])], names=[*columns, "sequence_id", "offset"])

    return run


def assign(found: DataFrame, size: int = SIZE) -> DataFrame:
    """``found`` (doc_id, start, length and any other columns) with sequence_id and offset."""
    found = staged(found, "pieces")
    counts = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # ``size`` rows at most
    if not counts:
        return found.selectExpr("*", "0L AS sequence_id", "0L AS offset")
    spark, columns = found.sparkSession, found.columns
    place, of, bucket, row, before, rank = free_name(columns, "place", "of", "bucket", "row", "before", "rank")
    buckets = spark.createDataFrame([(k, n // BUCKET + 1) for k, n in counts.items()], f"length long, {of} long")
    dealt = with_place(found, place).join(F.broadcast(buckets), "length").withColumn(bucket, F.pmod(place, of)).drop(of)
    sizes = dealt.groupBy("length", bucket).count()
    earlier = F.sum("count").over(Window.partitionBy("length").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("length", bucket, F.coalesce(earlier, F.lit(0)).alias(before))
    number = F.row_number().over(Window.partitionBy("length", bucket).orderBy(place)) - 1
    ranked = dealt.withColumn(row, number).join(sizes, ["length", bucket]).withColumn(rank, F.col(row) + F.col(before)).select(*columns, rank)
    schema = ", ".join(f"`{n}` {t}" for n, t in found.dtypes) + ", sequence_id long, offset long"
    return ranked.transform(in_arrow, _seated(places(plan(counts, size)), columns, rank), schema)


def sequences(packed: DataFrame, size: int = SIZE, pad: int = 0) -> DataFrame:
    """sequence_id, ids and used: each sequence's ids, padded to ``size`` unless a power of two are used."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    whole = packed.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("used"))
    to = F.when(F.log2("used") == F.floor(F.log2("used")), F.col("used")).otherwise(F.lit(size))
    raw = F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "")
    padded = F.rpad(raw, (to * 8).cast("int"), pad.to_bytes(4, "little").hex().upper())
    return whole.select("sequence_id", F.unhex(padded).alias("ids"), "used")


def packed(docs: DataFrame, path: str, end: int = END, size: int = SIZE) -> DataFrame:
    """The pieces of ``docs`` with their ids and places."""
    return assign(pieces(docs, path, end, size), size)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """The pieces with a checksum for their ids; only the checksums are staged and ranked."""
    light = pieces(docs, path).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return assign(light)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
