"""Benchmark decontamination with one FM-index per shard of training text.

Words are maximal runs of ``[0-9a-z]`` and non-ASCII bytes after A-Z is
lower-cased. Each item gives windows of ten consecutive words (an item of
fewer words is one window); a document word inside any occurrence of a window
is hit, and touching hit words merge into one removal span.

A shard is a bounded stretch of the documents of one task, so the training
text is never shuffled. Of it, the runs of words that the benchmark knows and
that are long enough for its shortest window are indexed: no window can lie
elsewhere. All windows are searched backward at once; occurrences are located
by sampled suffix positions.

The benchmark is staged as files, which the workers read a block of
``BLOCK_BYTES`` at a time, so neither the driver nor a task's code nor a worker
holds more than a block, however large the benchmark. What all blocks find on
the same text is merged before anything is decided or cut, so results do not
depend on blocks.

Defined results: a null text has no words; an item without words has no
window; items with equal ids count once, a null item id removes text but is
not listed; repeated rows are treated alike; a very long text is a shard of its
own; there are no ties, as all occurrences count; an empty table on either side
gives no hits; ``find`` reads doc_id and text only and ``clean`` puts texts in
place, so no name can clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import chunks, documents, in_arrow, open_file, staged, table, text_bytes, utf8
from docspark.llm.fmindex import FMIndex, ranges

WINDOW = 10
#: Bytes of text that a shard's index covers.
SHARD_BYTES = 24 << 20
#: Bytes of benchmark text that a worker holds at once.
BLOCK_BYTES = 4 << 20

_WORD = b"0123456789abcdefghijklmnopqrstuvwxyz"
_PLAIN = bytes(c if c >= 0x80 or c in _WORD else 0x20 for c in bytes(range(256)).lower())

FOUND = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<long>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_PLAIN).split() if text else []


class Phrases:
    """The windows of benchmark items over their own vocabulary (symbols from 1)."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text and text.encode())]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[i : i + window]), set()).update(() if item is None else (item,))
        self.lengths = np.array([len(p) for p in owners], np.int64)
        self.items = [sorted(x) for x in owners.values()]
        self.patterns = np.full((len(owners), window), -1, np.int64)
        for row, p in zip(self.patterns, owners, strict=True):
            row[window - len(p) :] = p
        self.shortest = int(self.lengths.min()) if len(owners) else window


def shard_hits(texts: list[bytes | None], phrases: Phrases) -> list[tuple[int, list[tuple[int, int]], list[int]]]:
    """Words, merged hit spans and found items of each text of one shard."""
    lookup, counts, runs = phrases.vocabulary.get, [], []
    for text in texts:
        words = words_of(text)
        counts.append(len(words))
        runs.append(np.fromiter(map(lookup, words, repeat(0)), np.int32, len(words)))
    symbols = np.concatenate([*runs, np.zeros(1, np.int32)]) if runs else np.zeros(1, np.int32)
    starts = np.cumsum([0, *counts])
    hit = np.zeros(len(symbols) + 1, np.int64)
    found: dict[int, set[int]] = {}
    if len(phrases.lengths):
        # stretches of known words inside one document, as [begin, end)
        known = symbols > 0
        first = known & np.r_[True, ~known[:-1]]
        first[starts[:-1][known[starts[:-1]]]] = True
        begin = np.flatnonzero(first)
        unknown_or_new = np.r_[np.flatnonzero(~known | first), len(symbols)]
        end = unknown_or_new[np.searchsorted(unknown_or_new, begin, side="right")]
        long = end - begin >= phrases.shortest
        begin, end = begin[long], end[long]
        if len(begin):
            at, run = ranges(begin, end + 1)  # one place more for the segment's end
            closing = np.r_[run[1:] != run[:-1], True]
            text = symbols[at].astype(np.int64)
            text[closing] = 0
            index = FMIndex(text, len(phrases.vocabulary))
            low, high = index.search(phrases.patterns)
            rows, which = ranges(low, high)
            places = at[index.locate(rows)]
            np.add.at(hit, places, 1)
            np.add.at(hit, places + phrases.lengths[which], -1)
            docs = np.searchsorted(starts, places, side="right") - 1
            for pair in np.unique(np.stack([docs, which], axis=1), axis=0).tolist():
                found.setdefault(pair[0], set()).update(phrases.items[pair[1]])
    covered = np.cumsum(hit)[:-1] > 0
    out = []
    for i, n in enumerate(counts):
        part = covered[starts[i] : starts[i] + n].astype(np.int8)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], part, [0]])))
        out.append((n, list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)), sorted(found.get(i, ()))))
    return out


Block = tuple[str, int, int]


def benchmark_files(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> list[str]:
    """The items in files of about BLOCK_BYTES each."""
    items = benchmark.select(F.col(item).cast("long").alias("item_id"), F.col(text).alias("text"))
    files = staged(items.repartition(text_bytes(items) // BLOCK_BYTES + 1), "benchmark").inputFiles()
    return sorted(files)


class Blocks:
    """The windows of all items, a block of ``most`` bytes at a time; the last block that was used is kept."""

    _last: tuple[Block, Phrases] | None = None

    def __init__(self, files: list[str], window: int, most: int):
        self.files, self.window, self.most = files, window, most

    def __iter__(self) -> Iterator[Phrases]:
        """One block at least, of no items if there are none."""
        some = False
        for path in self.files:
            if Blocks._last and Blocks._last[0] == (path, -1, self.window):
                yield Blocks._last[1]  # a file that was one block
                some = True
                continue
            rows = pq.ParquetFile(open_file(path)).read()
            items = list(zip(rows.column("item_id").to_pylist(), rows.column("text").to_pylist(), strict=True))
            cuts = list(self._cut(items))
            for k, part in enumerate(cuts):
                Blocks._last = None
                phrases = Phrases(part, self.window)
                Blocks._last = ((path, -1 if len(cuts) == 1 else k, self.window), phrases)
                yield phrases
                some = True
        if not some:
            yield Phrases([], self.window)

    def _cut(self, items: list[tuple[int | None, str | None]]) -> Iterator[list[tuple[int | None, str | None]]]:
        block: list[tuple[int | None, str | None]] = []
        size = 0
        for row in items:
            n = len((row[1] or "").encode()) + 16
            if block and size + n > self.most:
                yield block
                block, size = [], 0
            block.append(row)
            size += n
        if block:
            yield block

    def hits(self, texts: list[bytes | None]) -> list[tuple[int, list[tuple[int, int]], list[int]]]:
        """What ``shard_hits`` finds, of all blocks together."""
        found = None
        for phrases in self:
            new = shard_hits(texts, phrases)
            found = new if found is None else [(n, merged(a, b), sorted({*x, *y})) for (n, a, x), (_, b, y) in zip(found, new, strict=True)]
        return found


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, spans of hit words [start, end) and items, a row for each row of ``docs``."""
    blocks = Blocks(benchmark_files(benchmark, item, text), window, BLOCK_BYTES)
    return documents(docs, F.col(text).alias("text")).transform(in_arrow, _finder(blocks), FOUND)


def _finder(blocks: Blocks):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", SHARD_BYTES):
            n, spans, items = zip(*blocks.hits(utf8(batch.column("text"))), strict=True)
            spans = [[{"start": a, "end": b} for a, b in x] for x in spans]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.int64()))], names=["doc_id", "n_words", "spans", "items"])

    return run


def merged(old: list[tuple[int, int]], new: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Both lists' spans in order, touching and overlapping ones put together."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(old + new):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans; what stands between two words of a span goes with them."""
    raw = text.encode()
    places = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(_PLAIN))]
    kept, at = [], 0
    for start, end in spans:
        kept.append(raw[at : places[start][0]])
        at = places[end - 1][1]
    return b"".join([*kept, raw[at:]]).decode()


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with every hit span cut out of its text, and n_chars to match; all rows stay.

    The spans of all blocks are found on the same text and cut at once. What
    was cut is searched again by all blocks, as joining the two sides of a cut
    may form a window, until none hits. All of it happens where a text is read.
    """
    return docs.transform(in_arrow, _cleaner(Blocks(benchmark_files(benchmark), window, BLOCK_BYTES), docs.columns), docs.schema)


def _replaced(batch: pa.RecordBatch, columns: list[str], texts: list[str | None], changed: dict[int, str]) -> pa.RecordBatch:
    """The columns with these texts, and n_chars of those that changed."""
    arrays = {c: batch.column(c) for c in columns}
    arrays["text"] = pa.array(texts, batch.column("text").type)
    if "n_chars" in arrays:
        n = [len(changed[i]) if i in changed else x for i, x in enumerate(arrays["n_chars"].to_pylist())]
        arrays["n_chars"] = pa.array(n, arrays["n_chars"].type)
    return pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))


def _cleaner(blocks: Blocks, columns: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", SHARD_BYTES):
            texts, changed = batch.column("text").to_pylist(), {}
            todo = list(range(len(texts)))
            while todo:
                hits = blocks.hits([None if texts[i] is None else texts[i].encode() for i in todo])
                some = [(i, spans) for i, (_, spans, _) in zip(todo, hits, strict=True) if spans]
                for i, spans in some:
                    texts[i] = changed[i] = cut(texts[i], spans)
                todo = [i for i, _ in some]
            if changed:
                batch = _replaced(batch, columns, texts, changed)
            yield batch

    return run


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
