"""Whitening of embeddings from exact covariances, by bit-sliced scatter.

Entries become integers, ``floor(256 * c)``. The distinct integer vectors are
the list that is fitted on. A block of it is written as bit planes: each
dimension, shifted so that its least entry is zero, gives one plane for each of
its bits, packed across rows into 64-bit words. The cross-product of two
dimensions is the sum over their planes of the population count of the AND,
weighted by the powers of both bits, so all sums are exact whatever their order.
Blocks take their shift back in integers and give a row for each pair of
dimensions; Spark adds them up, as two decimals each (below and above 10^18),
and only those totals, a row for each pair of dimensions, reach the driver.
There ``n * C - S * S`` centres them as integers, before anything is rounded.
An eigendecomposition of this one small matrix gives the components, which go
to the tasks with the totals; rows are whitened where they are read.

One shuffle makes the vectors distinct (copies meet in the map side first); the
other one carries the totals.

Defined results: vectors that are null or hold null or non-finite entries are
dropped, and so are those shorter than the longest, as entries of theirs are
missing; empty vectors therefore stay only where all are empty, and then there
is no component; entries beyond a long are held at its ends; repeated rows give
a row each and count once in the fit; a null id stays null; an empty table
gives an empty table. A deviation is exact as a decimal of up to 38 digits, and
null beyond that. A component without variance (at most ``FLAT`` of the total)
has null for whitened and zero for explained, and identity_error is over the
others (null if there is none). Equal eigenvalues are numbered as the
decomposition gives them, alike for all rows. Only the id and the vector are
read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import Decimal
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import in_arrow, table

SCALE, COMPONENTS = 256, 4
#: Rows of a block of bit planes, at most, and entries of it.
BLOCK, ENTRIES = 1 << 16, 1 << 22
#: The share of the total variance under which a component counts as flat.
FLAT = 1e-13
LIMB = 10**18
LEAST, MOST = -(1 << 63), (1 << 63) - 1


class Fit(NamedTuple):
    """Vectors fitted on, sums of their entries, unit components (columns), eigenvalues and the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float | None


def whole(vector: Column) -> Column:
    """Whether the vector is there with all of its entries finite."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return vector.isNotNull() & F.forall(vector, lambda c: F.coalesce(finite(c), F.lit(False)))


def integers(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id and x (an array of long) of the rows that remain."""
    rows = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(whole(F.col("v")))
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    scaled = F.transform("v", lambda c: F.floor(F.least(F.greatest(c * F.lit(float(SCALE)), F.lit(float(LEAST))), F.lit(float(MOST)))).cast("long"))
    return rows.where(F.size("v") == F.lit(longest or 0)).select("id", scaled.alias("x"))


def _matrices(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Record batches with the rows x dimensions of a list column, in parts of at most ENTRIES numbers."""
    for batch in batches:
        lists = batch.column(column)
        d = len(lists[0]) if len(lists) else 0
        step = max(1, min(BLOCK, ENTRIES // max(1, d)))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, d)


def planes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """The bit planes of the columns of x: words, and for each plane its dimension and bit; and what was taken off each column."""
    least = x.min(axis=0)
    shifted = x.astype(np.uint64) - least.astype(np.uint64)  # modulo 2^64, which is what the difference fits
    rows, dims, bits = [], [], []
    words = -(-len(x) // 64)
    for j in range(x.shape[1]):
        for b in range(int(shifted[:, j].max()).bit_length()):
            plane = np.zeros(words * 8, np.uint8)
            packed = np.packbits((shifted[:, j] >> np.uint64(b)).astype(np.uint8) & 1, bitorder="little")
            plane[: len(packed)] = packed
            rows.append(plane.view(np.uint64))
            dims.append(j)
            bits.append(b)
    return (np.stack(rows) if rows else np.zeros((0, words), np.uint64)), np.array(dims, int), np.array(bits, int), [int(v) for v in least]


def scatter(x: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Sums of the columns and their cross-products, exact, by population counts of ANDed planes."""
    d = x.shape[1]
    word, dim, bit, least = planes(x)
    ones = np.bitwise_count(word).sum(axis=1, dtype=np.int64)
    y = [0] * d
    for k in range(len(word)):
        y[dim[k]] += int(ones[k]) << int(bit[k])
    cross = [[0] * d for _ in range(d)]
    for k in range(len(word)):
        counts = np.bitwise_count(word[k] & word[k:]).sum(axis=1, dtype=np.int64)
        for other, c in zip(range(k, len(word)), counts.tolist(), strict=True):
            i, j = dim[k], dim[other]
            value = c << int(bit[k] + bit[other])
            # within a dimension a pair of unequal bits stands for both of its orders
            cross[i][j] += value if other == k or i != j else 2 * value
    m, n = least, len(x)
    sums = [y[i] + n * m[i] for i in range(d)]
    for i in range(d):
        for j in range(i, d):
            cross[i][j] += m[i] * y[j] + m[j] * y[i] + n * m[i] * m[j]
    return sums, cross


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    for _, x in _matrices(batches, "x"):
        held.append(x)
        if sum(map(len, held)) * x.shape[1] >= ENTRIES or sum(map(len, held)) >= BLOCK:
            yield _totals(np.concatenate(held))
            held = []
    if held:
        yield _totals(np.concatenate(held))


def _totals(x: np.ndarray) -> pa.RecordBatch:
    """A row for each pair i <= j; i = -1 holds the sums, and j = -1 beside it the count."""
    sums, cross = scatter(x)
    rows = [(-1, -1, len(x)), *((-1, j, s) for j, s in enumerate(sums)), *((i, j, cross[i][j]) for i in range(len(sums)) for j in range(i, len(sums)))]
    limbs = [divmod(v, LIMB) for _, _, v in rows]
    kind = pa.decimal128(38, 0)
    decimals = lambda k: pa.array([Decimal(x[k]) for x in limbs], kind)
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), decimals(0), decimals(1)], names=["i", "j", "high", "low"])


def fit(x: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """The components of the distinct vectors of ``x``; None where there is none."""
    parts = x.select("x").distinct().transform(in_arrow, _blocks, "i int, j int, high decimal(38,0), low decimal(38,0)")
    got = {(r["i"], r["j"]): int(r["high"]) * LIMB + int(r["low"]) for r in parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()}
    d = sum(1 for i, j in got if i == -1 and j >= 0)
    if not d:
        return None
    n, sums = got[-1, -1], [got[-1, j] for j in range(d)]
    centred = [[n * got[min(i, j), max(i, j)] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    # a quotient of two integers is rounded once
    v = np.array([[c / (n * n) for c in row] for row in centred])
    trace = sum(centred[i][i] for i in range(d)) / (n * n)
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors = values[order], vectors[:, order]
    live = values > FLAT * trace
    error = None
    if live.any():
        w = vectors[:, live] / np.sqrt(values[live])
        error = float(np.abs(w.T @ v @ w - np.eye(w.shape[1])).max())
    return Fit(n, sums, vectors, np.where(live, values, 0.0), trace, error)


def whitened(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each remaining vector and component: id, component, n, deviation (decimal), whitened, explained, identity_error."""
    x = integers(rows, id_column, vector)
    model = fit(x, components)
    schema = "id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in _matrices(batches, "x"):
            yield _applied(model, batch.column("id"), values)

    return x.transform(in_arrow, run, schema)


def _applied(model: Fit, ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
    bound = model.n * int(max(abs(int(x.max())), abs(int(x.min())))) + max(map(abs, model.sums))
    if bound**2 * x.shape[1] < 1 << 62:
        off = model.n * x - np.array(model.sums)
        deviation = [Decimal(v) for v in (off * off).sum(axis=1).tolist()]
        centred = off / model.n
    else:
        exact = [[model.n * v - s for v, s in zip(row, model.sums, strict=True)] for row in x.tolist()]
        totals = (sum(v * v for v in row) for row in exact)
        deviation = [Decimal(t) if t < 10**38 else None for t in totals]
        centred = np.array([[float(Fraction(v, model.n)) for v in row] for row in exact])
    k = len(model.values)
    live = model.values > 0
    on = np.zeros((len(x), k))
    for j in range(x.shape[1]):  # in one order, so that a row's last bit does not depend on its batch
        on += centred[:, j : j + 1] * model.components[j]
    white = np.divide(on, np.sqrt(model.values), out=np.zeros((len(x), k)), where=live)
    explained = np.divide(model.values, model.trace, out=np.zeros(k), where=live)
    times = np.repeat(np.arange(len(x)), k)
    column = lambda v, kind: pa.array(v, kind)
    return pa.RecordBatch.from_arrays(
        [
            ids.take(pa.array(times)),
            column(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), pa.int32()),
            column(np.full(len(times), model.n), pa.int64()),
            column([deviation[t] for t in times], pa.decimal128(38, 0)),
            pa.array(white.ravel(), pa.float64(), mask=np.tile(~live, len(x))),
            column(np.tile(explained, len(x)), pa.float64()),
            column([model.identity_error] * len(times), pa.float64()),
        ],
        names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the first four components; a deviation beyond a long is null."""
    rows = whitened(table(spark, sf_dir, "embeddings"))
    long = F.when(F.abs("deviation") <= F.lit(MOST), F.col("deviation").cast("long"))
    return rows.select(F.col("id").alias("vec_id"), "component", "n", long.alias("deviation"), "whitened", "explained", "identity_error")
