"""Token ids in files of canonical length-limited Huffman codes.

The code follows from the counts of all ids (a row for each id of the
vocabulary at most reaches the driver) by package-merge. A file holds the ids
of a range of documents in ascending order:

    b"HUFT" version
    payload    codes, most significant bit first
    footer     zlib of: code lengths, document ids and lengths, checkpoints
    length of the footer (8 bytes), b"HUFT"

A block is ``BLOCK`` ids, whatever documents they belong to; a checkpoint is
the bit at which a block begins, so blocks decode independently: from a table
of all words of the longest code's length, all blocks of a stretch in step.

A file is written whole or not at all under a name given by its place in the
order, so a task that is tried again leaves the same file.

Files grow with the corpus, up to ``FILE_TOKENS`` ids (some 200 MB), once there
are ``FILES`` of them for each core. The rows of one doc_id, or of none, may
fall into several files.

Defined results: a null or empty text is its end id alone; a very long one is
written in many blocks; documents without doc_id come first; repeated rows are
written as often as they come, in no set order among themselves (ties); an empty
table gives no file and no row; only doc_id and text are read, so other columns
cannot clash.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.llm.common import chunks, documents, in_arrow, open_file, put_file, scratch, staged, table, utf8, with_place
from docspark.llm.tokens import encoder

END = 2
LIMIT = 18
BLOCK = 512
#: Ids of a file at most, ids from which there is another file for a core, and files for each core before files grow.
FILE_TOKENS, LEAST_TOKENS, FILES = 1 << 27, 1 << 22, 4
#: Ids that are coded at once (so that all steps stay in a core's cache), and decoded at once.
CODED, DECODED = 1 << 17, 1 << 20
#: Bytes of texts whose words are looked up together.
TEXTS = 8 << 20
MAGIC = b"HUFT"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits; 0 for what never occurs."""
    lengths = np.zeros(len(counts), np.uint8)
    symbols = np.flatnonzero(counts)
    symbols = symbols[np.argsort(counts[symbols], kind="stable")]
    n = len(symbols)
    if n < 2:
        lengths[symbols] = 1
        return lengths
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need more than {limit} bits")
    leaves = counts[symbols].astype(np.int64)
    row, rows = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        order = np.argsort(both, kind="stable")
        row = both[order]
        rows.append(order < n)
    taken, found = 2 * n - 2, np.zeros(n, np.uint8)
    for leaf in reversed(rows):
        k = int(leaf[:taken].sum())
        found[:k] += 1
        taken = 2 * (taken - k)
    lengths[symbols] = found
    return lengths


class Code:
    """The canonical code of the given lengths."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        symbols = np.flatnonzero(lengths)
        self.order = symbols[np.lexsort((symbols, lengths[symbols]))]
        sorted_lengths = self.lengths[self.order]
        self.longest = int(sorted_lengths[-1]) if len(symbols) else 1
        # in canonical order, codes filled up to the longest length follow one another
        size = np.int64(1) << (self.longest - sorted_lengths)
        begin = np.cumsum(size) - size
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[self.order] = (begin >> (self.longest - sorted_lengths)).astype(np.uint64)
        self._sizes = size

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes, and the bit at which each block begins."""
        length = self.lengths[ids]
        ends = np.cumsum(length)
        at = ends - length
        words = np.zeros(int(ends[-1]) // 64 + 2, np.uint64)
        word, code = at >> 6, self.codes[ids]
        shift = 64 - (at & 63) - length
        over = shift < 0
        high = np.where(over, code >> np.where(over, -shift, 0).astype(np.uint64), code << np.where(over, 0, shift).astype(np.uint64))
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        words[word[first]] = np.add.reduceat(high, first)
        words[word[over] + 1] |= code[over] << (64 + shift[over]).astype(np.uint64)
        return words.byteswap().tobytes()[: (int(ends[-1]) + 7) // 8], at[::BLOCK]

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        size = 1 << self.longest
        symbols, lengths = np.zeros(size, np.uint32), np.ones(size, np.int64)
        n = int(self._sizes.sum())
        symbols[:n] = np.repeat(self.order, self._sizes)
        lengths[:n] = np.repeat(self.lengths[self.order], self._sizes)
        return symbols, lengths


def decode(raw: bytes, begin: np.ndarray, sizes: np.ndarray, longest: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The ids of whole blocks that begin at the given bits; all blocks go on in step."""
    padded = np.frombuffer(raw + bytes(8), np.uint8)
    words = np.ndarray(len(padded) - 3, ">u4", padded, strides=(1,))
    symbols, lengths = table
    out = np.zeros((len(begin), int(sizes.max(initial=0))), np.uint32)
    at, on = begin.astype(np.int64), np.arange(len(begin))
    for step in range(out.shape[1]):
        if step >= sizes[on].min():
            keep = sizes[on] > step
            at, on = at[keep], on[keep]
        index = ((words[at >> 3].astype(np.int64) << (at & 7)) & 0xFFFFFFFF) >> (32 - longest)
        out[on, step] = symbols[index]
        at = at + lengths[index]
    return out[np.arange(out.shape[1]) < sizes[:, None]]


def file_parts(documents: Iterable[tuple[int | None, np.ndarray]], code: Code, totals: list[int]) -> Iterator[bytes]:
    """The file of these documents, in pieces; ``totals`` gets the ids and documents written."""
    yield MAGIC + struct.pack("<H", 1)
    doc_ids: list[int | None] = []
    sizes: list[int] = []
    points: list[np.ndarray] = []
    held: list[np.ndarray] = []
    waiting, bits = 0, 0
    for doc_id, ids in documents:
        doc_ids.append(doc_id)
        sizes.append(len(ids))
        held.append(ids)
        waiting += len(ids)
        while waiting >= CODED:
            whole = np.concatenate(held)
            raw, at = code.encode(whole[:CODED])
            points.append(at + bits)
            bits += 8 * len(raw)
            held, waiting = [whole[CODED:]], waiting - CODED
            yield raw
    if waiting:
        raw, at = code.encode(np.concatenate(held))
        points.append(at + bits)
        yield raw
    known = np.array([x is not None for x in doc_ids], bool)
    columns = [code.lengths.astype("<u1"), known.astype("<u1"), np.diff([0 if x is None else x for x in doc_ids], prepend=0).astype("<i8"), np.array(sizes, "<i8"), np.diff(np.concatenate([*points, np.zeros(0, np.int64)]), prepend=0).astype("<i8")]
    footer = zlib.compress(struct.pack("<qq", len(code.lengths), len(doc_ids)) + b"".join(c.tobytes() for c in columns), 6)
    totals[:] = [sum(sizes), len(sizes)]
    yield footer + struct.pack("<q", len(footer)) + MAGIC


class Reader:
    """A file's index, and its ids by documents."""

    def __init__(self, uri: str):
        self.file = open_file(uri)
        size = self.file.size()
        length, magic = struct.unpack("<q4s", self.file.read_at(12, size - 12))
        if magic != MAGIC or self.file.read_at(4, 0) != MAGIC:
            raise ValueError(f"{uri} is not in this format, or cut off")
        raw = zlib.decompress(self.file.read_at(length, size - 12 - length))
        vocabulary, n = struct.unpack_from("<qq", raw)
        at = 16
        parts = []
        for kind, count in (("<u1", vocabulary), ("<u1", n), ("<i8", n), ("<i8", n), ("<i8", -1)):
            parts.append(np.frombuffer(raw, kind, count, at))
            at += parts[-1].nbytes
        lengths, self.known, ids, self.sizes, points = parts
        self.doc_ids, self.points = np.cumsum(ids), np.cumsum(points)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.tokens = int(self.sizes.sum())
        self.code = Code(lengths)
        self.table = self.code.table()
        self.payload = size - 12 - length - 6

    def blocks(self, first: int, last: int) -> np.ndarray:
        """The ids of blocks first to last - 1, reading only their bytes."""
        begin = self.points[first:last]
        low = int(begin[0]) // 8
        high = self.payload if last >= len(self.points) else int(self.points[last]) // 8 + 1
        sizes = np.minimum(BLOCK, self.tokens - BLOCK * np.arange(first, last))
        return decode(self.file.read_at(high - low, 6 + low), begin - 8 * low, sizes, self.code.longest, self.table)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, start in this file and ids of each document in turn."""
        held, base, block, step = np.zeros(0, np.uint32), 0, 0, DECODED // BLOCK
        for known, doc_id, start, size in zip(self.known.tolist(), self.doc_ids.tolist(), self.starts.tolist(), self.sizes.tolist(), strict=True):
            parts = [held]
            have = base + len(held)
            while have < start + size:
                parts.append(self.blocks(block, min(len(self.points), block + step)))
                block += step
                have += len(parts[-1])
            if len(parts) > 1:
                held = np.concatenate([held[start - base :], *parts[1:]])
                base = start
            yield (doc_id if known else None), start, held[start - base : start - base + size]


def _tokenized(path: str, end: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, press, last = encoder(path), zstandard.ZstdCompressor(1), end.to_bytes(4, "little")
        for batch in chunks(batches, "text", TEXTS, 64):
            ids, ends = memo.batch(utf8(batch.column("text")))
            packed = [press.compress(_narrow(ids[a:b].tobytes() + last)) for a, b in pairwise([0, *ends.tolist()])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, pa.binary())], names=["doc_id", "ids"])

    return run


def _narrow(raw: bytes) -> bytes:
    """16 bits an id where that is enough; else 32 bits behind one byte."""
    ids = np.frombuffer(raw, "<u4")
    return ids.astype("<u2").tobytes() if ids.max() < 1 << 16 else b"w" + raw


def _wide(blob: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    return np.frombuffer(raw, "<u2") if len(raw) % 2 == 0 else np.frombuffer(raw, "<u4", offset=1)


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            parts = [_wide(b) for b in batch.column("ids").slice(at, 512).to_pylist()]
            new = np.bincount(np.concatenate(parts), minlength=len(total))
            new[: len(total)] += total
            total = new
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])


WRITTEN = "file string, tokens long, documents long, bytes long"


def _written(lengths: np.ndarray, folder: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, rows = Code(lengths), []
        docs = ((d, _wide(b)) for batch in batches for d, b in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True))
        part, ahead = TaskContext.get().partitionId(), next(docs, None)
        while ahead is not None:

            def some() -> Iterator[tuple[int | None, np.ndarray]]:
                nonlocal ahead
                size = 0
                while ahead is not None and size < 2 * FILE_TOKENS:
                    now, ahead = ahead, next(docs, None)
                    size += len(now[1])
                    yield now

            totals: list[int] = []
            name = f"part-{part:08d}-{len(rows):06d}.huf"
            size = put_file(f"{folder}/{name}", file_parts(some(), code, totals))
            rows.append((name, *totals, size))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["file", "tokens", "documents", "bytes"])

    return run


def write(docs: DataFrame, folder: str, path: str, end: int = END, text: str = "text") -> DataFrame:
    """Files of all texts' ids in ``folder``; returns file, tokens, documents and bytes of each."""
    tokens = staged(documents(docs, F.col(text).alias("text")).transform(in_arrow, _tokenized(path, end), "doc_id long, ids binary"), "tokens")
    counted = tokens.select("ids").transform(in_arrow, _counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(1 + max((r["id"] for r in counted), default=0), np.int64)
    for r in counted:
        counts[r["id"]] = r["n"]
    total = int(counts.sum())
    files = max(1, min(FILES * docs.sparkSession.sparkContext.defaultParallelism, total // LEAST_TOKENS), total // FILE_TOKENS)
    ordered = with_place(tokens, "place").repartitionByRange(files, "doc_id", "place").sortWithinPartitions("doc_id", "place").drop("place")
    return staged(ordered.transform(in_arrow, _written(code_lengths(counts), folder), WRITTEN), "manifest")


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            reader, rows = Reader(path), []
            for doc_id, start, ids in reader.documents():
                rows.append((path.rsplit("/", 1)[-1], doc_id, start, ids.astype("<u4").tobytes()))
                if len(rows) == 1000:
                    yield _documents(rows)
                    rows = []
            if rows:
                yield _documents(rows)


def _documents(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["file", "doc_id", "at", "ids"])


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids of each document in the files."""
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, ids binary")
    before = F.sum("tokens").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    offsets = manifest.select("file", F.coalesce(before, F.lit(0)).alias("before"))  # a row for each file
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.huf").load(folder).select("path")
    return files.transform(in_arrow, _read, "file string, doc_id long, at long, ids binary").join(offsets, "file").select("doc_id", (F.col("at") + F.col("before")).alias("start"), "ids")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = scratch(spark, "token-files")
    manifest = write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    found = read(spark, folder, manifest)
    return found.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
