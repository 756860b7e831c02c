"""Average precision against a plain version: ties, doubles, empty sides, ranges cut anywhere."""

import math
import random

import pyarrow as pa
import pytest

from docspark.operators import evaluation
from docspark.plans import adapters, stores
from docspark.sinks import shared

FOUND = "rec long, cls string, det_ord long, confidence double, x0 double, y0 double, x1 double, y1 double"
TRUE = "rec long, cls string, truth_ord long, x0 double, y0 double, x1 double, y1 double"


def iou(a, b):
    if any(v is None or math.isnan(v) for v in (*a, *b)):
        return 0.0
    i = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    u = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i
    return i / u if u > 0 else 0.0


def brute(found, true, cls):
    """(ap50, ap50_95) of one class."""
    low = lambda r: math.inf if r[3] is None or math.isnan(r[3]) else -r[3]
    mine = sorted((r for r in found if r[1] == cls and r[0] is not None), key=lambda r: (low(r), r[0], r[2]))
    there = sorted((t for t in true if t[1] == cls and t[0] is not None), key=lambda t: t[2])
    if not there:
        return None, None
    areas = []
    for k in range(10, 20):
        taken, hits = set(), []
        for r in mine:
            left = [(iou(r[4:], t[3:]), -t[2], j) for j, t in enumerate(there) if t[0] == r[0] and j not in taken]
            best = max((x for x in left if x[0] >= k / 20), default=None)
            hits.append(best is not None)
            if best:
                taken.add(best[2])
        precision = [sum(hits[: i + 1]) / (i + 1) for i in range(len(hits))]
        areas.append(sum(max(precision[i:]) for i in range(len(hits)) if hits[i]) / len(there))
    return areas[0], sum(areas) / 10


@pytest.fixture(scope="module")
def boxes():
    rng = random.Random(3)
    found, true = [], []
    for rec in range(60):
        for k in range(rng.randint(0, 5)):
            x, y, w, h = (rng.randint(1, 60) for _ in range(4))
            true.append((rec, rng.choice("abc"), k, float(x), float(y), float(x + w), float(y + h)))
            for j in range(rng.randint(0, 3)):
                dx, dy = rng.randint(-4, 4), rng.randint(-4, 4)
                found.append((rec, true[-1][1], 10 * k + j, rng.choice([0.1, 0.5, 0.5, 0.9]), float(x + dx), float(y + dy), float(x + w + dx), float(y + h)))
    nan = math.nan
    found += [(1, "a", 900, None, 0.0, 0.0, 9.0, 9.0), (1, "a", 901, nan, 0.0, 0.0, 9.0, 9.0), (2, "b", 902, 0.99, nan, 0.0, 9.0, 9.0), (2, "b", 903, 0.99, None, 0.0, 9.0, 9.0), (None, "a", 904, 1.0, 0.0, 0.0, 9.0, 9.0), (3, "only found", 905, 0.3, 0.0, 0.0, 1.0, 1.0), (4, "c", 906, 0.7, 5.0, 5.0, 5.0, 5.0)]
    true += [(5, "only there", 907, 0.0, 0.0, 1.0, 1.0), (4, "c", 908, 5.0, 5.0, 5.0, 5.0)]
    return found, true


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_against_brute_force(spark, boxes, parts, monkeypatch):
    found, true = boxes
    got = evaluation.average_precision(spark.createDataFrame(found, FOUND).repartition(7), spark.createDataFrame(true, TRUE), parts).collect()
    assert {r["cls"] for r in got} == {"a", "b", "c", "only found", "only there"}
    for r in got:
        want = brute(found, true, r["cls"])
        assert (r["ap50"], r["ap50_95"]) == (want if want[0] is None else (pytest.approx(want[0], abs=1e-12), pytest.approx(want[1], abs=1e-12)))
        assert r["truths"] == sum(t[1] == r["cls"] for t in true) and r["detections"] == sum(f[1] == r["cls"] and f[0] is not None for f in found)


def test_a_truth_is_taken_once(spark):
    """The surer detection takes the truth, though the other one fits better; at a high overlap it is the other's."""
    found = [(1, "a", 1, 0.9, 0.0, 0.0, 10.0, 8.0), (1, "a", 2, 0.5, 0.0, 0.0, 10.0, 10.0)]
    rows = evaluation.matched(evaluation.grouped(spark.createDataFrame(found, FOUND), spark.createDataFrame([(1, "a", 1, 0.0, 0.0, 10.0, 10.0)], TRUE)))
    got = {r["det_ord"]: [r[f"hit{k}"] for k in range(10)] for r in rows.collect()}
    assert got[1] == [1] * 7 + [0] * 3 and got[2] == [0] * 7 + [1] * 3


def test_empty_tables(spark):
    none, true = spark.createDataFrame([], FOUND), spark.createDataFrame([(1, "a", 1, 0.0, 0.0, 1.0, 1.0)], TRUE)
    assert evaluation.average_precision(none, true.limit(0)).collect() == []
    assert [tuple(r) for r in evaluation.average_precision(none, true).collect()] == [("a", 0, 1, 0.0, 0.0, 0.0)]


def test_ranges_part_a_class(spark, boxes):
    """One class with all of the rows falls into several ranges, whatever its ties."""
    rows = [(i, "a", 1, 0.5, 0.0, 0.0, 1.0, 1.0) for i in range(5000)]
    ranged = evaluation._ranged(evaluation.matched(evaluation.grouped(spark.createDataFrame(rows, FOUND), spark.createDataFrame([], TRUE))), 8)
    sizes = [r["count"] for r in ranged.groupBy("tile").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 2500


def test_lines_move_once(spark, sf, monkeypatch):
    """eval_map reads the lines and deals them in one pass, for what is found and what is there alike, and compares boxes outside of interpreted expressions."""
    plans, staged = [], shared.staged
    monkeypatch.setattr(shared, "staged", lambda rows, name: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or staged(rows, name))
    assert stores.eval_map(spark, sf).count()
    assert plans[0].count("Exchange") == 1 and plans[0].count("FileScan") == 1
    assert "aggregate(" not in plans[0]


def test_boxes_of_the_lines_are_those_of_the_views(spark, sf):
    columns = ["rec", "cls", "there", "confidence", "ord", "x0", "y0", "x1", "y1"]
    want = evaluation.boxes(adapters.view(spark, sf, "eval_found"), adapters.view(spark, sf, "eval_truth")).select(columns)
    got = adapters.eval_boxes(spark, sf).select(columns)
    assert got.count() == want.count() and not got.exceptAll(want).count()


def batches_of(found, true, rows):
    """Detections and truths in order of rec, as a worker gets them."""
    low = lambda p: math.inf if p is None or math.isnan(p) else -p
    both = [(f[0], f[1], False, low(f[3]), f[2], *f[4:]) for f in found if f[0] is not None] + [(t[0], t[1], True, 0.0, t[2], *t[3:]) for t in true]
    both.sort(key=lambda r: r[0])
    types = [pa.int64(), pa.string(), pa.bool_(), pa.float64(), pa.int64(), *[pa.float64()] * 4]
    table = pa.table([pa.array(c, k) for c, k in zip(zip(*both, strict=True), types, strict=True)], names=["rec", "cls", "there", "low", "ord", "x0", "y0", "x1", "y1"])
    return table.to_batches(rows)


def hits_of(batches):
    return {(r["rec"], r["det_ord"]): r["hits"] for b in evaluation._matched(batches) for r in b.to_pylist() if r["rec"] is not None}


def one_by_one(found, true):
    out = dict.fromkeys(((f[0], f[2]) for f in found if f[0] is not None), 0)
    low = lambda p: math.inf if p is None or math.isnan(p) else -p
    for k in range(10):
        taken = set()
        for f in sorted((f for f in found if f[0] is not None), key=lambda f: (low(f[3]), f[2])):
            best = max(((iou(f[4:], t[3:]), -t[2]) for t in true if t[:2] == f[:2] and (t[0], t[2]) not in taken), default=(0, 0))
            if best[0] >= (10 + k) / 20:
                taken.add((f[0], -best[1]))
                out[f[0], f[2]] |= 1 << k
    return out


@pytest.mark.parametrize(("block", "pairs", "pace", "rows"), [(1 << 17, 1 << 20, 64, 1000), (7, 1, 1, 3), (50, 10, 0, 20), (1, 100, 1 << 30, 1)])
def test_matches_do_not_depend_on_blocks(boxes, block, pairs, pace, rows, monkeypatch):
    found, true = boxes
    rng = random.Random(5)
    # a crowd: every box overlaps with every other, and detections compete for the same truths
    for j in range(40):
        x, w = rng.randint(0, 30), rng.randint(200, 240)
        true = [*true, (99, "a", j, float(x), 0.0, float(x + w), 100.0)]
        x, w = rng.randint(0, 30), rng.randint(200, 240)
        found = [*found, (99, "a", j, rng.choice([0.2, 0.4, 0.4]), float(x), 0.0, float(x + w), 100.0)]
    for name, value in (("BLOCK", block), ("PAIRS", pairs), ("PACE", pace)):
        monkeypatch.setattr(evaluation, name, value)
    assert hits_of(batches_of(found, true, rows)) == one_by_one(found, true)


def test_chunks_part_a_class(boxes, monkeypatch):
    """Stretches of a class end with its rows or with a chunk, and are numbered in order."""
    monkeypatch.setattr(evaluation, "CHUNK", 4)
    rows = pa.table({"tile": pa.array([2] * 9, pa.int32()), "cls": ["a"] * 6 + ["b"] * 3, "hits": pa.array([None, 1, 3, 0, 1, 0, None, None, 2], pa.int16()), "truths": pa.array([5, *[None] * 5, 2, 1, None], pa.int64())})
    got = [r for b in evaluation._chunked(rows.to_batches(5)) for r in b.to_pylist()]
    assert [(r["cls"], r["rows"], r["truths"], r["sums"][:2]) for r in got] == [("a", 3, 5, [2, 1]), ("a", 2, 0, [1, 0]), ("b", 1, 3, [0, 1])]
    assert [r["part"] for r in got] == [0, 1, 2] and {r["tile"] for r in got} == {2}


def test_other_kinds_of_rec_and_cls(spark, boxes):
    """Text for rec and numbers for cls, as well; copies of a detection do not upset the rest."""
    found, true = boxes
    kinds = {"a": 1, "b": 2, "c": 3, "only found": 4, "only there": 5}
    f = spark.createDataFrame([(None if r[0] is None else f"r{r[0]:03}", kinds[r[1]], *r[2:]) for r in found], FOUND.replace("rec long, cls string", "rec string, cls int"))
    t = spark.createDataFrame([(f"r{r[0]:03}", kinds[r[1]], *r[2:]) for r in true], TRUE.replace("rec long, cls string", "rec string, cls int"))
    for r in evaluation.average_precision(f, t).collect():
        want = brute(found, true, next(k for k, v in kinds.items() if v == r["cls"]))
        assert (r["ap50"], r["ap50_95"]) == (want if want[0] is None else (pytest.approx(want[0], abs=1e-12), pytest.approx(want[1], abs=1e-12)))
    twice = evaluation.average_precision(f.unionByName(f), t).collect()
    assert {r["cls"]: r["detections"] for r in twice} == {r["cls"]: 2 * r["detections"] for r in evaluation.average_precision(f, t).collect()}
