"""SimHash near-dedup by a self-join of a binary trie of fingerprints.

A fingerprint has 64 bits over the XXH64 of a text's 4-word shingles. Two are
linked if at most four bits differ.

The join goes down the trie with pairs of nodes, adds up the bits in which
their paths differ and drops a pair once it is over budget. Of four differing
bits at most two lie in the upper half or at most one in the lower half, so two
tries do: one over the bits as they are with a budget of two for the first 32
levels, one with the halves exchanged and a budget of one. The upper levels are
walked by a deal: a subtrie gets its own fingerprints and, as probes, those of
the subtries whose path is within budget. Subtries above ``MOST`` rows are
dealt again six levels deeper, as often as needed. The levels below run in
numpy on sorted arrays. Each subtrie gives a spanning forest of its links, so
a dense group gives no more edges than it has fingerprints.

Defined results: a text without words (null, empty, white space) has
fingerprint zero and is linked like any other; equal fingerprints are always in
one component; a row without doc_id keeps its component but never names it;
repeated rows stay repeated; an empty table gives an empty table; only doc_id
and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import documents, in_arrow, staged, table, utf8
from docspark.llm.graph import components, forest

SHINGLE = 4
ERRORS = 4
HALF = 32
#: For each trie: the left rotation of its words and the budget of its first 32 levels.
TRIES = ((0, 2), (32, 1))
#: Fingerprints of a subtrie that the deal aims at, and rows beyond which it is dealt again.
AIM, MOST = 4096, 1 << 18
DEEPER = 6
#: Pairs of nodes that are taken down at once.
FRONT = 1 << 16


def fingerprint(text: bytes | None) -> int:
    words = text.lower().split() if text else []  # of bytes, only A-Z is lower-cased
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    begin = (ends - lengths)[: max(1, len(words) - SHINGLE + 1)]
    end = ends[min(SHINGLE, len(words)) - 1 :]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(begin), 1 << 16):
        a, b = begin[at : at + (1 << 16)].tolist(), end[at : at + (1 << 16)].tolist()
        hashes = np.array([xxhash.xxh64_intdigest(joined[i:j], 42) for i, j in zip(a, b, strict=True)], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(begin)).tobytes(), "big", signed=True)


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [fingerprint(t) for t in utf8(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and fp (the 64 bits as a long), without a shuffle."""
    return documents(docs, F.col(text).alias("text")).transform(in_arrow, _fingerprints, "doc_id long, fp long")


def masks(bits: int, budget: int) -> list[tuple[int, int]]:
    """All numbers of that many bits with at most ``budget`` bits set, and how many are set."""
    return [(sum(1 << b for b in c), k) for k in range(min(budget, bits) + 1) for c in combinations(range(bits), k)]


def _dealt(rows: DataFrame, depth: int, bits: int, budget: int) -> DataFrame:
    """Go ``bits`` levels down: rows (node, word, probe, differ) to all child nodes within budget.

    A row of the node itself stays one in its own child, and probes the
    children that come after it; a probe stays a probe.
    """
    options = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(k).alias("k")) for m, k in masks(bits, budget)])
    branch = F.shiftrightunsigned("word", 64 - depth - bits).bitwiseAND(F.lit((1 << bits) - 1))
    down = rows.withColumn("own", branch).withColumn("o", F.explode(F.filter(options, lambda o: F.col("differ") + o["k"] <= F.lit(budget))))
    to = F.col("own").bitwiseXOR(F.col("o.m"))
    down = down.where(F.col("probe") | (to >= F.col("own")))
    return down.select(F.shiftleft("node", bits).bitwiseOR(to).alias("node"), "word", (F.col("probe") | (F.col("o.m") != 0)).alias("probe"), (F.col("differ") + F.col("o.k")).alias("differ"))


def links(prints: DataFrame) -> DataFrame:
    """Edges (u, v) that connect all of the distinct fingerprints ``prints`` (fp) within four bits."""
    n = prints.count()
    out = None
    for turn, budget in TRIES:
        depth = max(4, min(20, math.ceil(math.log2(max(1, n) / AIM))))
        word = F.col("fp") if not turn else F.shiftleft("fp", turn).bitwiseOR(F.shiftrightunsigned("fp", 64 - turn))
        rows = _dealt(prints.select(F.lit(0).cast("long").alias("node"), word.alias("word"), F.lit(False).alias("probe"), F.lit(0).alias("differ")), 0, depth, budget)
        while True:
            if depth < 60:
                large = rows.groupBy("node").count().where(F.col("count") > MOST).select("node")
                large = staged(large, "large")
                deeper = not large.isEmpty()
            else:
                deeper = False
            light = rows.join(large, "node", "left_anti") if deeper else rows
            found = _joined(light, turn, budget)
            out = found if out is None else out.unionByName(found)
            if not deeper:
                break
            rest = staged(rows.join(large, "node", "left_semi"), "subtries")
            within = budget if depth + DEEPER <= HALF else ERRORS
            rows, depth = _dealt(rest, depth, DEEPER, within), depth + DEEPER
    return out


def _joined(rows: DataFrame, turn: int, budget: int) -> DataFrame:
    def subtrie(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        words, probe = group["word"].to_numpy().view(np.uint64), group["probe"].to_numpy()
        own, other = np.unique(words[~probe]), np.unique(words[probe])
        both = np.concatenate([own, other])
        u, v = join(own, other, budget)
        label = forest(len(both), u, v)
        child = np.flatnonzero(label != np.arange(len(both)))
        pairs = np.stack([both[child], both[label[child]]])
        if turn:
            pairs = (pairs << np.uint64(64 - turn)) | (pairs >> np.uint64(turn))
        return pd.DataFrame({"u": pairs[0].view(np.int64), "v": pairs[1].view(np.int64)})

    return rows.groupBy("node").applyInPandas(subtrie, "u long, v long")


def join(own: np.ndarray, other: np.ndarray, budget: int, errors: int = ERRORS, half: int = HALF) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the trie ``own`` with itself and with ``other`` within budget, as numbers into both together.

    Both are sorted and free of repeats, so a node is a range. What comes back
    are links enough to connect whatever the pairs connect.
    """
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    n = len(own)
    one = lambda *x: [np.array([k], np.int64) for k in x]
    stack = [(0, False, one(0, n, 0, len(other), 0)), (0, True, one(0, n, 0, n, 0))]
    while stack:
        level, same, front = stack.pop()
        right = own if same else other
        al, ah, bl, bh, differ = front
        on = (ah > al) & (bh > bl)
        front = [x[on] for x in front]
        # small products are compared at once; the rest goes a level down
        al, ah, bl, bh, differ = front
        if not len(al):
            continue
        small = ((ah - al) * (bh - bl) <= 64) | (level == 64)
        if small.any():
            picked = [x[small] for x in front]
            for at in range(0, len(picked[0]), FRONT >> 4):
                u, v = _compared(own, right, [x[at : at + (FRONT >> 4)] for x in picked], same, budget, errors, half)
                us.append(u)
                vs.append(v if same else v + n)
            if sum(map(len, us)) > 1 << 19:
                label = forest(n + len(other), np.concatenate(us), np.concatenate(vs))
                child = np.flatnonzero(label != np.arange(len(label)))
                us, vs = [child], [label[child]]
            al, ah, bl, bh, differ = (x[~small] for x in front)
        if not len(al):
            continue
        bit = np.uint64(63 - level)
        am, bm = _middle(own, al, ah, bit), _middle(right, bl, bh, bit)
        crossed = differ + 1 <= (budget if level < half else errors)
        twin = same & (al == bl) & (ah == bh)  # a node with itself: one crossing is enough
        left, cross = crossed.nonzero()[0], (crossed & ~twin).nonzero()[0]
        down = [
            np.concatenate([al, am, al[left], am[cross]]),
            np.concatenate([am, ah, am[left], ah[cross]]),
            np.concatenate([bl, bm, bm[left], bl[cross]]),
            np.concatenate([bm, bh, bh[left], bm[cross]]),
            np.concatenate([differ, differ, differ[left] + 1, differ[cross] + 1]),
        ]
        for at in range(0, len(down[0]), FRONT):
            stack.append((level + 1, same, [x[at : at + FRONT] for x in down]))
    return np.concatenate(us), np.concatenate(vs)


def _middle(words: np.ndarray, low: np.ndarray, high: np.ndarray, bit: np.uint64) -> np.ndarray:
    """Where the given bit turns to one in ranges of words that agree above it."""
    low_words = words[np.minimum(low, len(words) - 1)]
    edge = (low_words >> bit | np.uint64(1)) << bit
    return np.clip(np.searchsorted(words, edge), low, high)


def _compared(own: np.ndarray, right: np.ndarray, front: list[np.ndarray], same: bool, budget: int, errors: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    al, ah, bl, bh, _ = front
    width, sizes = bh - bl, (ah - al) * (bh - bl)
    which = np.repeat(np.arange(len(al)), sizes)
    k = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    u, v = al[which] + k // width[which], bl[which] + k % width[which]
    if same:
        u, v = u[u < v], v[u < v]
    x = own[u] ^ right[v]
    close = (np.bitwise_count(x) <= errors) & (np.bitwise_count(x >> np.uint64(64 - half)) <= budget)
    return u[close], v[close]


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, fp and component_id (the least doc_id of the component) for each row."""
    prints = staged(fingerprints(docs, text), "fingerprints")
    groups = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "groups")
    member = components(links(groups.select("fp")))
    labelled = groups.join(member, groups["fp"] == member["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = staged(labelled.join(named, "root").select("fp", "component_id"), "classes")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def kept(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the least of its component, and those without doc_id.

    Only what is dropped, rows of a number and no text, is joined to the texts.
    """
    known = near_duplicates(docs).where("doc_id IS NOT NULL")
    gone = staged(known.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")
