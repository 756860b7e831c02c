"""Near-dedup of embeddings: random-hyperplane signs in several tables, exact cosines, connected components.

Equal vectors are one class with a weight, so copies cost their size. In each
table a class falls into the bucket of the signs of its products with ``bits``
random hyperplanes; classes of one bucket are compared by exact cosines. Signs
come from vectors and hyperplanes rounded to integers whose products a double
holds exactly, so a task may compute them again and gets the same ones.

``bits`` grows with the logarithm of the number of classes, so that a bucket
holds about ``AIM`` unrelated ones; the number of tables follows from ``bits``
so that a pair at the very threshold is missed with probability ``MISS`` (nearer
pairs far less often), whatever the size of the input. A pair that meets in
several tables counts in the first one only: its task knows both signatures.
So a bucket gives no pairs, but the links it adds to each of its classes and a
spanning forest of them. A bucket above ``MOST`` classes (a cloud of near but
unequal vectors) is cut into parts by place, and each two parts meet in a task
of their own: nothing is dropped and no task is unbounded, but the comparisons
of such a cloud, not its rows or its results, grow with its square, as a count
of links asks for. Components are those of the forests (``graph``).

Cosines are in double precision; where one lies within 1e-9 of the threshold it
is computed again from correctly rounded sums.

Defined results: vectors that are null, empty, zero or hold null or non-finite
entries link with nothing; vectors of different lengths never link; repeated
rows are vectors of their own, so a row counts its repeats; a row without id
has links and a component, but never names one unless no other row of its
component has an id either (then component_id is null, and it is kept); ties
have no effect; an empty table gives an empty table; only the id and the vector
are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import in_arrow, staged, table
from docspark.llm.graph import components, forest
from docspark.llm.whitening import whole

THRESHOLD = 0.95
#: Unrelated classes that a bucket should hold, and the probability that a pair at the threshold is missed.
AIM, MISS = 512, 0.02
FEWEST_BITS, MOST_BITS = 8, 40
#: Classes of a bucket beyond which it is cut into parts of half as many.
MOST = 4096
#: Cosines that are held at a time.
FRONT = 1 << 21
NARROW = 1e-9
SEED = 20260101
#: Entries of a unit vector and of a hyperplane, as integers.
UNIT, PLANE = 1 << 20, 1 << 12


class Plan(NamedTuple):
    bits: int
    tables: int
    threshold: float


def planned(n: int, threshold: float = THRESHOLD, aim: int = AIM, miss: float = MISS) -> Plan:
    """Bits a table and tables for ``n`` classes."""
    bits = min(MOST_BITS, max(FEWEST_BITS, math.ceil(math.log2(max(1, n) / aim))))
    together = (1 - math.acos(threshold) / math.pi) ** bits
    return Plan(bits, math.ceil(math.log(miss) / math.log(1 - together)), threshold)


def units(v: np.ndarray) -> np.ndarray:
    """Rows of length one; entries too large or too small to square are scaled first."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def signatures(unit: np.ndarray, plan: Plan) -> np.ndarray:
    """The bucket of each row in each table (rows x tables), from exact products."""
    d = unit.shape[1]
    planes = np.rint(np.random.default_rng([SEED, d]).normal(size=(plan.tables * plan.bits, d)).clip(-8, 8) * PLANE)
    weights = 1 << np.arange(plan.bits, dtype=np.int64)
    x, out = np.rint(unit * UNIT), np.empty((len(unit), plan.tables), np.int64)
    for t in range(plan.tables):
        out[:, t] = ((x @ planes[t * plan.bits : (t + 1) * plan.bits].T) > 0) @ weights
    return out


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the rows of each vector length, and their matrix."""
    column = batch.column("v")
    sizes = np.diff(column.offsets.to_numpy())
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), d)


def _counted(plan: Plan):
    """Rows of each bucket, summed within a task's batches."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, v in _rows(batch):
                sign = signatures(units(v), plan)
                for t in range(plan.tables):
                    bucket, n = np.unique(sign[:, t], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), x), pa.int32()) for x in (v.shape[1], t)] + [pa.array(bucket), pa.array(n)], names=["size", "tab", "bucket", "n"])

    return run


def _dealt(plan: Plan):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, v in _rows(batch):
                sign = signatures(units(v), plan)
                rows = batch.take(pa.array(at))
                for t in range(plan.tables):
                    head = [pa.array(np.full(len(at), x), pa.int32()) for x in (v.shape[1], t)]
                    yield pa.RecordBatch.from_arrays([*head, pa.array(sign[:, t]), rows.column("node"), rows.column("n"), rows.column("v")], names=["size", "tab", "bucket", "node", "n", "v"])

    return run


def _exact(u: np.ndarray, v: np.ndarray) -> float:
    """The cosine from sums that are rounded once."""
    u, v = u / np.abs(u).max(), v / np.abs(v).max()
    return math.fsum(u * v) / math.sqrt(math.fsum(u * u) * math.fsum(v * v))


def linked(v: np.ndarray, w: np.ndarray | None, tab: int, plan: Plan) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of ``v`` with one another, or with those of ``w``, at the threshold or above, that meet in no earlier table."""
    a = units(v)
    b = a if w is None else units(w)
    right = v if w is None else w
    sa = signatures(a, plan)[:, :tab]
    sb = sa if w is None else signatures(b, plan)[:, :tab]
    step = max(1, FRONT // max(1, len(b)))
    for low in range(0, len(a), step):
        start = low if w is None else 0
        s = a[low : low + step] @ b[start:].T
        i, j = np.nonzero(s >= plan.threshold - NARROW)
        cosine = s[i, j]
        i, j = i + low, j + start
        keep = np.ones(len(i), bool) if w is not None else i < j
        for k in np.flatnonzero(keep & (np.abs(cosine - plan.threshold) <= NARROW)):
            keep[k] = _exact(v[i[k]], right[j[k]]) >= plan.threshold
        i, j = i[keep], j[keep]
        if tab and len(i):
            # those that share an earlier bucket were counted there
            first = np.ones(len(i), bool)
            for t in range(tab):
                first &= sa[i, t] != sb[j, t]
            i, j = i[first], j[first]
        yield i, j


def _compared(plan: Plan):
    """Of one bucket, or of two of its parts: links that each class gains, and a spanning forest."""

    def run(group: pa.Table) -> pa.Table:
        node, n, part = (group.column(c).to_numpy() for c in ("node", "n", "part"))
        size, tab = group.column("size")[0].as_py(), group.column("tab")[0].as_py()
        v = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(node), size)
        sides = np.unique(part)
        one, two = np.flatnonzero(part == sides[0]), np.flatnonzero(part == sides[-1]) if len(sides) > 1 else None
        other = one if two is None else two
        gained, parent = np.zeros(len(node), np.int64), np.arange(len(node))
        if group.column("twice")[0].as_py() and two is None:  # two parts of which one has no rows
            one = one[:0]
        if len(one):
            for i, j in linked(v[one], None if two is None else v[two], tab, plan):
                i, j = one[i], other[j]
                np.add.at(gained, i, n[j])
                np.add.at(gained, j, n[i])
                label = forest(len(node), np.concatenate([np.arange(len(node)), i]), np.concatenate([parent, j]))
                parent = label
        child = np.flatnonzero(gained)
        return pa.table({"u": node[child], "v": node[parent[child]], "links": gained[child]}, schema=pa.schema([("u", pa.int64()), ("v", pa.int64()), ("links", pa.int64())]))

    return run


def links(classes: DataFrame, plan: Plan) -> DataFrame:
    """(u, v, links): links that a class u gains in a bucket, and an edge to a class v of its component there.

    ``classes`` holds node (a number of its own), n (its rows) and v (the vector).
    """
    sizes = classes.select("v").transform(in_arrow, _counted(plan), "size int, tab int, bucket long, n long").groupBy("size", "tab", "bucket").agg(F.sum("n").alias("rows"))
    large = staged(sizes.where(F.col("rows") > MOST), "large")
    kind = classes.schema["v"].dataType.simpleString()
    dealt = classes.select("node", "n", "v").transform(in_arrow, _dealt(plan), f"size int, tab int, bucket long, node long, n long, v {kind}")
    key, none = ["size", "tab", "bucket"], F.lit(0)
    if large.isEmpty():
        rows = dealt.select("*", none.alias("a"), none.alias("b"), none.alias("part"), F.lit(False).alias("twice"))
    else:
        marked = dealt.join(large, key, "left")
        light = marked.where("rows IS NULL").select(*dealt.columns, none.alias("a"), none.alias("b"), none.alias("part"), F.lit(False).alias("twice"))
        parts = F.ceil(F.col("rows") / (MOST // 2)).cast("int")
        own = F.pmod(F.xxhash64("node"), parts).cast("int")
        heavy = marked.where("rows IS NOT NULL").withColumn("parts", parts).withColumn("part", own).withColumn("o", F.explode(F.sequence(none, F.col("parts") - 1)))
        a, b = F.least("part", "o"), F.greatest("part", "o")
        rows = light.unionByName(heavy.select(*dealt.columns, a.alias("a"), b.alias("b"), "part", (a != b).alias("twice")))
    return rows.groupBy(*key, "a", "b").applyInArrow(_compared(plan), "u long, v long, links long")


def near_duplicates(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """id, n_links and component_id of each row."""
    given = staged(rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("v")), "vectors")
    fits = F.coalesce(whole(F.col("v")) & F.exists("v", lambda c: c != 0), F.lit(False))
    # as grouping does it, minus zero counts as zero
    classes = given.where(fits).groupBy("v").agg(F.min("id").alias("first"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id())
    classes = staged(classes, "classes")
    plan = planned(classes.count(), threshold)
    found = staged(links(classes, plan), "links")
    gained = found.groupBy("u").agg(F.sum("links").alias("gained"))
    member = components(found.select("u", "v"))
    labelled = classes.join(member, classes["node"] == member["node"], "left").select(classes["node"], "first", "n", F.coalesce("root", classes["node"]).alias("root"))
    named = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    known = labelled.join(named, "root").join(gained, F.col("node") == F.col("u"), "left").select("node", (F.col("n") - 1 + F.coalesce("gained", F.lit(0))).alias("n_links"), "component_id")
    known = staged(known.join(classes.select("node", F.col("v").alias("w")), "node").drop("node"), "known")
    # the class of a vector: a side of one row for each key, so a hot vector's rows can be split
    out = given.withColumn("key", F.when(fits, F.col("v"))).join(known, F.col("key") == F.col("w"), "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("w").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector; of a component its least id is kept."""
    rows = near_duplicates(table(spark, sf_dir, "embeddings"))
    return rows.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
