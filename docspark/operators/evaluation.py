"""Detections held against truth: one-to-one matches at ten overlaps, average precision by class.

Boxes of one record meet in one shuffle. There the detections of a class go by
falling confidence, and each takes the truth it overlaps most of those that are
left, if by the threshold at least; so for each of the ten thresholds apart.
What a record holds is what one picture holds, and is gathered; workers take
the boxes of many records at a time. Pairs under the least threshold are left
out as they come, and of the others all detections choose at once: one whose
best truth no surer detection could still take has it for good, the rest choose
again. Where few are settled at a time, as in crowds, they go one by one.

Classes are few and may hold any share of all detections, so none of them is
ordered in one task. All detections are dealt into ranges of class, confidence
and number, and once in order their hits are kept in chunks, a number of ten
bits each. Chunks are counted, and each hit's precision comes from the counts
of the chunks before it and the running counts of its own. The precision
envelope, the best precision at a place or any later one, comes likewise from
the maxima of the chunks behind; only hits can raise it. Average precision is
the area under it: the sum of the envelope over the hits, divided by the number
of truths.

Defined results: detections of equal confidence go by rec, then det_ord; of
equally overlapped truths the first by truth_ord is taken; a null or NaN
confidence comes last; null or NaN coordinates overlap with nothing; a class
without truth has null for its average precision, one without detections 0;
rows without rec or cls are left out; empty tables give an empty table. rec and
cls are plain values, not structs or lists.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.sinks import shared

THRESHOLDS = [k / 20 for k in range(10, 20)]
_BOX = ("x0", "y0", "x1", "y1")
_KEY = ("cls", "low", "rec", "det_ord")
#: Rows that a worker takes at a time, and pairs of boxes that it compares at a time.
BLOCK, PAIRS = 1 << 17, 1 << 20
#: Detections choose all at once while one of so many pairs at least settles one (an estimate of what a choice by itself costs, in pairs; results do not depend on it).
PACE = 64
#: Detections of a chunk: as many at least, unless its class or its range ends, and less than twice as many.
CHUNK = 1 << 15


# --- matches --------------------------------------------------------------------------------------


def boxes(detections: DataFrame, truths: DataFrame) -> DataFrame:
    """Both in one shape: rec, cls, there (whether it is a truth), confidence, ord and the box."""
    box = [F.col(c).cast("double").alias(c) for c in _BOX]
    a = detections.select("rec", "cls", F.lit(False).alias("there"), F.col("confidence").cast("double").alias("confidence"), F.col("det_ord").cast("long").alias("ord"), *box)
    b = truths.select("rec", "cls", F.lit(True).alias("there"), F.lit(None).cast("double").alias("confidence"), F.col("truth_ord").cast("long").alias("ord"), *box)
    return a.unionByName(b)


def _codes(values: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """A number for each value, and the values by number."""
    coded = pa.concat_arrays(values.chunks).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """From where to where equal values lie beside each other."""
    return pairwise([0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)] if len(values) else [])


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in order of rec, many at a time, no rec in two blocks."""
    held, rows, least = [], 0, BLOCK
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= least:
            block = pa.Table.from_batches(held).combine_chunks()
            codes, _ = _codes(block["rec"])
            cut = int(np.argmax(codes == codes[-1]))
            if cut:
                yield block.slice(0, cut)
            # the last rec may go on; one that fills a block waits for twice as much
            held, rows = block.slice(cut).combine_chunks().to_batches(), rows - cut
            least = max(BLOCK, 2 * rows)
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _ordered(at: np.ndarray, keys: list[np.ndarray], box: np.ndarray) -> np.ndarray:
    """The rows ``at`` by keys, and by their boxes where these are equal."""
    by = at[np.lexsort([k[at] for k in reversed(keys)])]
    if len(by) and np.logical_and.reduce([k[by[1:]] == k[by[:-1]] for k in keys]).any():
        by = at[np.lexsort([k[at] for k in (*box[::-1], *reversed(keys))])]
    return by


def _near(p: np.ndarray, t: np.ndarray, first: np.ndarray, past: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of detections and truths (of each those from first to past) that overlap by the least threshold, and by how much; of a detection the best first."""
    n = past - first
    i = np.repeat(np.arange(len(n)), n)
    j = np.arange(len(i)) + np.repeat(first - (np.cumsum(n) - n), n)
    w = np.minimum(p[2][i], t[2][j]) - np.maximum(p[0][i], t[0][j])
    h = np.minimum(p[3][i], t[3][j]) - np.maximum(p[1][i], t[1][j])
    both = (w > 0) & (h > 0)
    i, j, inner = i[both], j[both], w[both] * h[both]
    area_p, area_t = ((b[2] - b[0]) * (b[3] - b[1]) for b in (p, t))
    iou = inner / (area_p[i] + area_t[j] - inner)
    enough = iou >= THRESHOLDS[0]
    i, j, iou = i[enough], j[enough], iou[enough]
    by = np.lexsort((-iou, i))  # stable: the first of equally overlapped truths stays first
    return i[by], j[by], iou[by]


def _take(i: np.ndarray, j: np.ndarray, hit: np.ndarray, taken: np.ndarray) -> None:
    """Which detections take a truth, and which truths are taken; the pairs are in order of detections, of each the best first."""
    first = np.empty(len(taken), np.int64)
    left = ~taken[j]
    pace = len(i)
    while pace >= len(i):
        i, j = i[left], j[left]
        if not len(i):
            return
        best = np.ones(len(i), bool)
        best[1:] = i[1:] != i[:-1]
        first[j[::-1]] = i[::-1]  # of each truth the surest detection that may take it
        sure = best & (first[j] == i)
        hit[i[sure]] = taken[j[sure]] = True
        left = ~(hit[i] | taken[j])
        pace = PACE * int(sure.sum())
    i, j = i[left], j[left]
    for a, b in _runs(i):
        free = j[a:b][~taken[j[a:b]]]
        if len(free):
            hit[i[a]] = taken[free[0]] = True


def _hits(p: np.ndarray, t: np.ndarray, first: np.ndarray, past: np.ndarray) -> np.ndarray:
    """A bit for each threshold at which a detection takes a truth; detections come in the order in which they choose, so those of a part know what is taken before it."""
    hits, taken = np.zeros(len(first), np.int16), np.zeros((len(THRESHOLDS), t.shape[1]), bool)
    ends, at = np.cumsum(past - first), 0
    while at < len(hits):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        i, j, iou = _near(p[:, at:to], t, first[at:to], past[at:to])
        for k, x in enumerate(THRESHOLDS):
            enough, hit = iou >= x, np.zeros(to - at, bool)
            _take(i[enough], j[enough], hit, taken[k])
            hits[at:to] |= hit.astype(np.int16) << k
        at = to
    return hits


def _matched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["rec", "cls", "low", "det_ord", "hits", "truths"]
    for rows in _blocks(batches):
        recs, (cls, classes) = _codes(rows["rec"])[0], _codes(rows["cls"])
        low, there = rows["low"].to_numpy(), rows["there"].to_numpy()
        number = pc.fill_null(rows["ord"], np.iinfo(np.int64).min).to_numpy()
        box = np.stack([rows[c].to_numpy() for c in _BOX])
        key = recs * len(classes) + cls
        with np.errstate(invalid="ignore", over="ignore"):
            d, t = _ordered(np.flatnonzero(~there), [key, low, number], box), _ordered(np.flatnonzero(there), [key, number], box)
            hits = _hits(box[:, d], box[:, t], *(np.searchsorted(key[t], key[d], side) for side in ("left", "right")))
        # rows of one class and confidence beside each other take less room when they are dealt anew
        by = np.lexsort((low[d], cls[d]))
        at = pa.array(d[by])
        found = [rows["rec"].take(at), rows["cls"].take(at), pa.array(low[d[by]]), rows["ord"].take(at), pa.array(hits[by]), pa.nulls(len(d), pa.int64())]
        counts = np.bincount(cls[t], minlength=len(classes))
        some = pa.array(np.flatnonzero(counts))
        n = len(some)
        true = [pa.nulls(n, rows["rec"].type), classes.take(some), pa.nulls(n, pa.float64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int16()), pa.array(counts[counts > 0])]
        for columns in (found, true):
            yield from pa.table(columns, names=names).combine_chunks().to_batches()


def matches(both: DataFrame) -> DataFrame:
    """Of ``boxes``, a row for each detection: rec, cls, low (minus its confidence), det_ord and hits, a bit for each threshold at which it takes a truth; besides, rows with a number of truths of a class and without rec."""
    confidence = F.when(~F.isnan("confidence"), F.col("confidence"))
    low = F.when(~F.col("there"), F.coalesce(-confidence, F.lit(float("inf")))).otherwise(F.lit(0.0))
    rows = both.where("rec IS NOT NULL AND cls IS NOT NULL").repartition("rec").sortWithinPartitions("rec").select("rec", "cls", "there", low.alias("low"), "ord", *_BOX)
    kinds = {"rec": rows.schema["rec"].dataType, "cls": rows.schema["cls"].dataType, "low": T.DoubleType(), "det_ord": T.LongType(), "hits": T.ShortType(), "truths": T.LongType()}
    return rows.mapInArrow(_matched, T.StructType([T.StructField(k, v) for k, v in kinds.items()]))


def grouped(detections: DataFrame, truths: DataFrame) -> DataFrame:
    """The matches of two tables."""
    return matches(boxes(detections, truths))


def matched(groups: DataFrame) -> DataFrame:
    """A row for each detection: rec, cls, low (minus its confidence), det_ord and hit0 to hit9, a 1 for each threshold at which it takes a truth."""
    return groups.where("rec IS NOT NULL").select("rec", "cls", "low", "det_ord", *(F.getbit("hits", F.lit(k)).cast("int").alias(f"hit{k}") for k in range(len(THRESHOLDS))))


# --- average precision ----------------------------------------------------------------------------


def _ranged(rows: DataFrame, parts: int) -> DataFrame:
    """With ``tile``, a number that rises with (cls, low, rec, det_ord)."""
    return rows.repartitionByRange(parts, *_KEY).withColumn("tile", F.spark_partition_id())


def _in_chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            held.append(batch.slice(at, CHUNK))
            rows += held[-1].num_rows
            if rows >= CHUNK:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def _chunked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order, a row for each stretch of a class: its place, the numbers of detections, of truths and of hits for each threshold, and the hits."""
    part = 0
    for rows in _in_chunks(batches):
        codes, classes = _codes(rows["cls"])
        for a, b in _runs(codes):
            hits = rows["hits"].slice(a, b - a).drop_null().to_numpy()
            sums = [int((hits >> k & 1).sum()) for k in range(len(THRESHOLDS))]
            truths = pc.sum(rows["truths"].slice(a, b - a)).as_py() or 0
            row = [rows["tile"].chunk(0)[:1], pa.array([part], pa.int32()), classes.take(pa.array(codes[a : a + 1])), pa.array([len(hits)]), pa.array([truths]), pa.array([sums]), pa.array([hits.astype("<i2").tobytes()])]
            yield pa.RecordBatch.from_arrays(row, names=["tile", "part", "cls", "rows", "truths", "sums", "hits"])
            part += 1


def _precise(row: dict) -> list[np.ndarray]:
    """For each threshold, the precision at each hit of a chunk; before: the detections of the chunks before it, then their hits."""
    hits = np.frombuffer(row["hits"], "<i2")
    places = [np.flatnonzero(hits >> k & 1) for k in range(len(THRESHOLDS))]
    return [(so_far + np.arange(1, len(at) + 1)) / (row["before"][0] + at + 1) for so_far, at in zip(row["before"][1:], places, strict=True)]


def _best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best precision of each chunk."""
    for batch in batches:
        best = [[float(p.max(initial=0.0)) for p in _precise(row)] for row in batch.select(["before", "hits"]).to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("tile", "part", "cls")), pa.array(best, pa.list_(pa.float64()))], names=["tile", "part", "cls", "best"])


def _areas(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of the envelope over the hits of each chunk; later: the best precision of the chunks behind it."""
    for batch in batches:
        areas = [[float(np.maximum(np.maximum.accumulate(p[::-1]), x).sum()) for p, x in zip(_precise(row), row["later"], strict=True)] for row in batch.select(["before", "hits", "later"]).to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("cls", "rows", "truths", "sums")), pa.array(areas, pa.list_(pa.float64()))], names=["cls", "rows", "truths", "sums", "areas"])


def precision(both: DataFrame, parts: int | None = None) -> DataFrame:
    """``average_precision`` of ``boxes``."""
    found = shared.staged(matches(both), "matches")
    cls = f"cls {found.schema['cls'].dataType.simpleString()}"
    # equal keys, which only repeated numbers have, go by their hits, so that results do not depend on partitions
    in_order = _ranged(found, parts or int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))).sortWithinPartitions(*_KEY, F.desc("hits"))
    chunks = shared.staged(in_order.select("tile", "cls", "hits", "truths").mapInArrow(_chunked, f"tile int, part int, {cls}, rows long, truths long, sums array<long>, hits binary"), "ranks")
    n = range(len(THRESHOLDS))
    at = ["cls", "tile", "part"]
    ahead = Window.partitionBy("cls").orderBy("tile", "part").rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.array(*(F.coalesce(F.sum(c).over(ahead), F.lit(0)) for c in (F.col("rows"), *(F.col("sums")[k] for k in n))))
    counted = chunks.join(chunks.select(*at, so_far.alias("before")), at)
    best = counted.select(*at, "before", "hits").mapInArrow(_best, f"tile int, part int, {cls}, best array<double>")
    behind = Window.partitionBy("cls").orderBy(F.desc("tile"), F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    later = F.array(*(F.coalesce(F.max(F.col("best")[k]).over(behind), F.lit(0.0)) for k in n))
    rows = counted.join(best.select(*at, later.alias("later")), at).select("cls", "rows", "truths", "sums", "before", "hits", "later")
    areas = rows.mapInArrow(_areas, f"{cls}, rows long, truths long, sums array<long>, areas array<double>")
    out = areas.groupBy("cls").agg(F.sum("rows").alias("detections"), F.sum("truths").alias("truths"), F.sum(F.col("sums")[0]).alias("hits50"), *(F.sum(F.col("areas")[k]).alias(f"a{k}") for k in n))
    per_truth = lambda c: c / F.nullif("truths", F.lit(0))
    mean = sum((F.col(f"a{k}") for k in n), F.lit(0.0)) / len(THRESHOLDS)
    return out.select("cls", "detections", "truths", per_truth(F.col("a0")).alias("ap50"), per_truth(mean).alias("ap50_95"), per_truth(F.col("hits50").cast("double")).alias("found50"))


def average_precision(detections: DataFrame, truths: DataFrame, parts: int | None = None) -> DataFrame:
    """cls, detections, truths, ap50, ap50_95 and found50, the share of truths that is found at an overlap of a half.

    ``detections``: rec, cls, det_ord, confidence and a box (x0, y0, x1, y1); ``truths``: rec, cls, truth_ord and a box.
    """
    return precision(boxes(detections, truths), parts)
