"""Fill-in-middle transformation by displacement scatter.

A text falls into units (a run of A-Z and a-z, or any other code point), two
cuts drawn from its doc_id part them into prefix, middle and suffix, and the
parts are written in another order between the marks ``<P>``, ``<S>``, ``<M>``.

A record batch is one array of bytes. A scan marks where units begin; running
counts give the units and the places of both cuts of all texts at once. Each
part of a text moves by one distance, so a difference array over the batch
holds the change of that distance where a part begins; its running sum is the
shift of every byte, and one scatter writes all outputs of the batch. The way
back finds the three marks of an output and gathers along the inverse shifts.
Nothing is shuffled, and no byte passes through a Python object of its own.
Scatter and gather go through ``WINDOW`` bytes at a time; record batches are
cut to ``BATCH`` bytes of text, one text at least, and the counts of the scan
take four bytes twice for each byte of them.

Defined results: a null text counts as the empty one, whose form is plain with
no units; a null doc_id is drawn for as the empty string; rows of the same
doc_id and text give the same row each, and ties of both cuts an empty middle;
very long texts are transformed whole; an empty table gives an empty table;
only doc_id and the text are read, so other columns cannot clash, and
``restored`` adds underscores to its new column's name if it is taken. A text
that holds a mark stays plain. ``restored`` refuses (ValueError) an output
whose marks do not fit its form.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.common import chunks, documents, free_name, in_arrow, small_batches, table

MARKS = {"P": b"<P>", "S": b"<S>", "M": b"<M>"}
#: Of 100 texts so many stay plain, and of 100 others so many put the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
BATCH, WINDOW = 4 << 20, 1 << 19
_OPEN = np.frombuffer(b"".join(MARKS.values()), np.uint8).reshape(3, 3)


def drawn(doc_id: Column, seed: str = "1:") -> list[Column]:
    """Four numbers below 2^32 from the SHA-256 of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, null as empty, and where each text begins; the last number is the end."""
    c = pc.fill_null(column.cast(pa.large_binary()), b"")
    ends = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]
    data = np.frombuffer(c.buffers()[2], np.uint8) if c.buffers()[2] is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def _strings(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data))


def _counted(flags: np.ndarray) -> np.ndarray:
    """How many flags are set before each place, and before the end."""
    out = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, dtype=np.int32, out=out[1:])
    return out


def _scan(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running counts of the units and of the code points that begin."""
    letter = ((data | 0x20) - np.uint8(97)) < 26
    point = (data & 0xC0) != 0x80
    unit = point.copy()
    unit[1:] &= ~(letter[1:] & letter[:-1])
    unit[begin[begin < len(data)]] = True
    return _counted(unit), _counted(point)


def _marks_in(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all marks, in order, and the letter of each."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    at = np.flatnonzero(data[:-2] == 60)
    at = at[(data[at + 2] == 62) & np.isin(data[at + 1], _OPEN[:, 1])]
    return at, data[at + 1]


def _shifts(places: np.ndarray, distances: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Windows of the places below ``size`` with the place that each is moved to or read from.

    ``places`` are where parts begin, in order; ``distances`` what each moves by.
    """
    change = np.diff(distances, prepend=0)
    carry = 0
    for low in range(0, size, WINDOW):
        high = min(size, low + WINDOW)
        first, last = np.searchsorted(places, [low, high])
        shift = np.zeros(high - low, np.int64)
        np.add.at(shift, places[first:last] - low, change[first:last])
        shift[0] += carry
        np.cumsum(shift, out=shift)
        carry = shift[-1]
        shift += np.arange(low, high)
        yield low, high, shift


def _forward(batch: pa.RecordBatch) -> pa.RecordBatch:
    data, at = _bytes(batch.column("text"))
    begin, end = at[:-1], at[1:]
    units, points = _scan(data, begin)
    n = (units[end] - units[begin]).astype(np.int64)
    h1, h2, h3, h4 = (batch.column(f"h{k}").to_numpy() for k in (1, 2, 3, 4))
    x, y = h1 % (n + 1), h2 % (n + 1)

    def cut(k: np.ndarray) -> np.ndarray:
        return np.where(k == n, end, np.searchsorted(units, units[begin] + k + 1) - 1)

    a, c = cut(np.minimum(x, y)), cut(np.maximum(x, y))
    own, _ = _marks_in(data)
    holder = np.searchsorted(at, own, side="right") - 1
    plain = (n == 0) | (h3 % 100 >= 100 - PLAIN)
    plain[holder[own + 3 <= end[holder]]] = True
    spm = h4 % 100 < SUFFIX_FIRST
    to = np.zeros(len(at), np.int64)
    np.cumsum(end - begin + np.where(plain, 0, 9), out=to[1:])
    out = np.empty(to[-1], np.uint8)
    # where prefix, middle and suffix begin in the output
    p = to[:-1] + np.where(spm, 6 + end - c, 3)
    s = to[:-1] + np.where(spm, 3, 6 + a - begin)
    m = to[:-1] + 9 + (a - begin) + (end - c)
    moved = np.stack([np.where(plain, to[:-1], p) - begin, np.where(plain, to[:-1] - begin, m - a), np.where(plain, to[:-1] - begin, s - c)], axis=1)
    for low, high, target in _shifts(np.stack([begin, a, c], axis=1).ravel(), moved.ravel(), len(data)):
        out[target] = data[low:high]
    on = ~plain
    for start, mark in ((p, "P"), (s, "S"), (m, "M")):
        for k in range(3):
            out[start[on] - 3 + k] = MARKS[mark][k]
    form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
    chars = lambda low, high: pa.array(points[high].astype(np.int64) - points[low], pa.int64(), mask=plain)
    columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()), chars(begin, a), chars(a, c), _strings(out, to)]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def _backward(output: pa.Array, form: pa.Array) -> pa.Array:
    data, at = _bytes(output)
    begin, end = at[:-1], at[1:]
    kinds = np.array([f or "plain" for f in form.to_pylist()], dtype=object)
    on = np.flatnonzero(kinds != "plain")
    spm = kinds[on] == "spm"
    mark, letter = _marks_in(data)
    holder = np.searchsorted(at, mark, side="right") - 1
    kept = (mark + 3 <= end[holder]) & (kinds[holder] != "plain")
    mark, letter, holder = mark[kept], letter[kept], holder[kept]
    expected = np.where(spm[:, None], np.frombuffer(b"SPM", np.uint8), np.frombuffer(b"PSM", np.uint8))
    if len(mark) != 3 * len(on) or (holder != np.repeat(on, 3)).any() or (letter != expected.ravel()).any() or (mark[::3] != begin[on]).any():
        raise ValueError("an output does not hold the three marks of its form")
    first, second, third = (mark[k::3] + 3 for k in range(3))
    p, s = np.where(spm, second, first), np.where(spm, first, second)
    low, high = np.where(spm, third - 3, second - 3) - p, np.where(spm, second - 3, third - 3) - s  # lengths of prefix and suffix
    middle = end[on] - third
    back = np.zeros(len(at), np.int64)
    sizes = end - begin
    sizes[on] -= 9
    np.cumsum(sizes, out=back[1:])
    places = np.repeat(back[:-1, None], 3, axis=1)
    away = np.repeat((begin - back[:-1])[:, None], 3, axis=1)
    home = back[:-1][on]
    places[on, 1], places[on, 2] = home + low, home + low + middle
    away[on] = np.stack([p - home, third - (home + low), s - (home + low + middle)], axis=1)
    out = np.empty(back[-1], np.uint8)
    for a, b, source in _shifts(places.ravel(), away.ravel(), len(out)):
        out[a:b] = data[source]
    return _strings(out, back)


def transformed(docs: DataFrame, text: str = "text", seed: str = "1:") -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars and the output text of each row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", BATCH):
            yield _forward(batch)

    named = documents(docs, F.col(text).alias("text"))
    rows = named.select("doc_id", "text", *(h.alias(f"h{k}") for k, h in enumerate(drawn(F.col("doc_id"), seed), 1)))
    return rows.transform(in_arrow, run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(rows: DataFrame, output: str = "output", form: str = "form", name: str = "restored") -> DataFrame:
    """``rows`` with the text that each output was made of, from the output and its form alone."""
    small_batches(rows.sparkSession)
    (name,) = free_name(rows.columns, name)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, output, BATCH):
            text = _backward(batch.column(output), batch.column(form))
            yield pa.RecordBatch.from_arrays([*batch.columns, text], names=[*batch.schema.names, name])

    return in_arrow(rows, run, T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())]))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the transformation makes of every document, and that the way back gives its text."""
    rows = restored(transformed(table(spark, sf_dir, "documents")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256"))
