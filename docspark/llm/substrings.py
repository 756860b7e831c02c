"""Substring dedup: repeated passages of twenty words or more, decided by FM-indexes.

Words are runs of bytes other than space and tab to carriage return, compared
unchanged. A window is 20 consecutive words of one document. A word goes if a
window over it has the same words as a window that starts earlier (smaller
doc_id, or the same document and an earlier start). All windows are judged on
the input.

Hashes only settle which texts have to meet, so no document is streamed against
every shard; what goes is found by backward search over the words themselves:

1. ``scan`` gives each window its anchor, the 8-word gram of least hash within
   it. Neighbouring windows with one anchor form a unit of at most 32 words.
   Equal windows have equal anchors. A task keeps the first of the equal units
   of each chunk and sends the later ones on as claims: this place may repeat
   that earlier one. So a passage that a third of all documents share reaches
   the shuffle of units once a chunk of ``SCAN_BYTES``.
2. ``settle`` meets equal units, dealt by their content, and makes claims of all
   but the first. The first ones meet those of their anchor, and are asked for if
   there are others. Claims that continue one another become one claim of a
   longer span.
3. ``match`` builds a compressed FM-index for each bounded shard. For claims it
   holds the earlier places, and the later spans are streamed against it: their
   matching statistics, from right to left, give every match of 20 words and
   more, and what occurs earlier goes. For units of one anchor the index holds
   them all, every window is streamed through it, and all but the earliest of its
   occurrences go.
4. The reported intervals meet their documents and are cut out.

Of an earlier document an index holds no more than ``REACH`` windows; a claim
that goes further is cut there, and each of its windows is looked for in one
index. An earlier place that very many spans claim is dealt with some of them to each
of several shards (``SPLIT``). An anchor with very many different units (``HOT``)
is dealt by whole windows, of which a task first removes the repeats it has
itself, by an index of its own; a task that settles very many of them does not
send them on to meet. So no task and no shard follows the size of a group.
Words whose hashes collide can only make a claim that the index turns down.

Defined results: a null text has no words and stays null; a text of fewer than
20 words stays; a very long text is cut into spans for the search, and only one
document is held whole; a document without doc_id stays as it is and hides
nothing; the rows of one doc_id are one document (the same start in two of them
is one occurrence, and what goes in one goes in all); of equal windows the
earliest place stays, so there are no ties; an empty table gives an empty table;
other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.common import chunks, documents, free_name, in_arrow, staged, table, text_bytes, utf8
from docspark.llm.fmindex import FMIndex, ranges

WINDOW = 20
GRAM = 8
PLACES = WINDOW - GRAM + 1
#: Different units of one anchor beyond which its windows are dealt one by one.
HOT = 4096
SCAN_BYTES = 5 << 19
SHARD_WORDS = 1 << 19
UNITS_A_PARTITION = 400_000
#: Words of later spans that one copy of an earlier place serves.
SPLIT = 1 << 19
#: Windows of an earlier document that one index holds at most: claims on longer ones are cut where these reaches end.
REACH = 1 << 18
#: Windows of a streamed piece.
PIECE = 256
#: Bytes of text to each partition of shards.
SHARD_BYTES = 12 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class _WordHashes(dict):
    """Hashes of the words met; emptied before it grows large."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word, 7)
        return h


_HASHES = _WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def units_of(texts: list[bytes | None]) -> tuple[np.ndarray, ...]:
    """Document number, first window, windows, anchor and content hash of each unit."""
    if len(_HASHES) > 150_000:
        _HASHES.clear()
    words = [t.split() if t else [] for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    offsets = np.cumsum(counts) - counts
    total = int(counts.sum())
    hashes = np.empty(total, np.uint64)
    for w, at in zip(words, offsets.tolist(), strict=True):
        hashes[at : at + len(w)] = np.fromiter(map(_HASHES.__getitem__, w), np.uint64, len(w))
    del words
    long = np.flatnonzero(counts >= WINDOW)
    window, owner = ranges(offsets[long], offsets[long] + counts[long] - WINDOW + 1)
    if not len(window):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    with np.errstate(over="ignore"):
        n = total - GRAM + 1
        gram = np.zeros(n, np.uint64)
        for j in range(GRAM):
            gram = gram * _BASE + hashes[j : j + n]
        gram = mixed(gram)
        least, size = gram, 1
        while size < PLACES:
            step = min(size, PLACES - size)
            least = np.minimum(least[: len(least) - step], least[step:])
            size += step
        least, at = least[window], np.full(len(window), -1, np.int64)
        for j in range(PLACES - 1, -1, -1):
            at[gram[window + j] == least] = j
        at += window
        new = np.r_[True, (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1)]
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(window)])
        power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(total, _BASE)])
        sums = np.r_[np.uint64(0), np.cumsum(mixed(hashes) * power[:-1])]
        back = np.multiply.accumulate(np.r_[np.uint64(1), np.full(total, _BACK)])
        begin = window[first]
        content = mixed((sums[begin + size + WINDOW - 1] - sums[begin]) * back[begin] + size.astype(np.uint64))
        doc = long[owner[first]]
        return doc, begin - offsets[doc], size, gram[at[first]], content


def first_of(doc_id: np.ndarray, start: np.ndarray, anchor: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """An order by content, anchor and place; in it, the first of each equal unit, the number of the first of each, and the later ones at another place."""
    order = np.lexsort((start, doc_id, anchor, content))
    a, c, d, s = anchor[order], content[order], doc_id[order], start[order]
    head = np.r_[True, (a[1:] != a[:-1]) | (c[1:] != c[:-1])] if len(order) else np.zeros(0, bool)
    of = np.flatnonzero(head)[np.cumsum(head) - 1]
    return order, head, of, ~head & ((d != d[of]) | (s != s[of]))


def continued(doc_id: np.ndarray, start: np.ndarray, n: np.ndarray, source: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Claims (n windows from start repeat those from ``at`` of ``source``), those that continue one another made one."""
    if not len(doc_id):
        return doc_id, start, n, source, at
    order = np.lexsort((start, at - start, source, doc_id))
    d, s, n, o, a = doc_id[order], start[order], n[order], source[order], at[order]
    new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (o[1:] != o[:-1]) | (a[1:] - s[1:] != a[:-1] - s[:-1]) | (s[1:] != s[:-1] + n[:-1])])
    return d[new], s[new], np.add.reduceat(n, new), o[new], a[new]


_DEALT = pa.schema([("part", pa.int32()), ("claims", pa.bool_()), ("units", pa.binary())])
#: Columns of units (anchor, content, doc_id, start, windows) and of claims (doc_id, start, windows, source, at).
_UNITS = ("<u8", "<u8", "<i8", "<i4", "<i4")
_CLAIMS = ("<i8", "<i4", "<i4", "<i8", "<i4")


def _packed(part: np.ndarray, types: tuple[str, ...], columns: Iterable[np.ndarray]) -> Iterator[tuple[int, bool, bytes]]:
    """Compressed columns for each part; the rows are in order of part."""
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else []
    press, columns = zstandard.ZstdCompressor(1), [c.astype(t) for c, t in zip(columns, types, strict=True)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        # bytes of equal weight lie together: the high ones of sorted hashes and ids repeat
        raw = b"".join(np.ascontiguousarray(c[a:b].view(np.uint8).reshape(b - a, -1).T).tobytes() for c in columns)
        yield int(part[a]), types == _CLAIMS, press.compress(raw)


def _unpacked(blobs: list[bytes], types: tuple[str, ...]) -> list[np.ndarray]:
    widths = [np.dtype(t).itemsize for t in types]
    parts: list[list[np.ndarray]] = [[] for _ in types]
    for blob in blobs:
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
        n, at = len(raw) // sum(widths), 0
        for k, (t, w) in enumerate(zip(types, widths, strict=True)):
            parts[k].append(np.ascontiguousarray(raw[at : at + n * w].reshape(w, n).T).view(t).ravel())
            at += n * w
    return [np.concatenate(p) if p else np.zeros(0, t) for p, t in zip(parts, types, strict=True)]


def _scan(parts: int):
    width = (1 << 64) // parts + 1

    def dealt(by: np.ndarray, types: tuple[str, ...], columns: list[np.ndarray]) -> Iterator[tuple[int, bool, bytes]]:
        part = (by // np.uint64(width)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        return _packed(part[order], types, [c[order] for c in columns])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", SCAN_BYTES):
            batch = batch.filter(batch.column("doc_id").is_valid())
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            doc, start, size, anchor, content = units_of(utf8(batch.column("text")))
            order, head, of, later = first_of(ids[doc], start, anchor, content)
            d, s, n = ids[doc][order], start[order], size[order]
            rows = list(_packed((content[order][head] // np.uint64(width)).astype(np.int32), _UNITS, (anchor[order][head], content[order][head], d[head], s[head], n[head])))
            claims = continued(d[later], s[later], n[later], d[of[later]], s[of[later]])
            rows += dealt(mixed(claims[0].astype(np.uint64)), _CLAIMS, list(claims))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _DEALT.types, strict=True)], schema=_DEALT)
        _HASHES.clear()

    return run


SETTLED = "doc_id long, start int, n int, source long, at int, anchor long, part int, units binary"
_SETTLED = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("source", pa.int64()), ("at", pa.int32()), ("anchor", pa.int64()), ("part", pa.int32()), ("units", pa.binary())])


def _rows(schema: pa.Schema, **columns: np.ndarray | list) -> pa.RecordBatch:
    """A batch of the schema; columns that are not given are null."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _claimed(claims: Iterable[np.ndarray]) -> pa.RecordBatch:
    doc_id, start, n, source, at = claims
    return _rows(_SETTLED, doc_id=doc_id, start=start.astype(np.int32), n=n.astype(np.int32), source=source, at=at.astype(np.int32))


def _settle(parts: int, hot: int):
    """Of one partition's units: claims of all but the first of equal ones, and the first ones, packed by anchor.

    Units are dealt by content, so each partition has its share of an anchor's
    units. Where that is large already, the units are rows (with their anchor),
    and one without windows tells the others of the anchor.
    """
    width, most = (1 << 64) // parts + 1, max(8, hot // parts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units: list[bytes] = []
        for batch in batches:
            claims = batch.column("claims").to_pylist()
            blobs = batch.column("units").to_pylist()
            units += [b for b, x in zip(blobs, claims, strict=True) if not x]
            if any(claims):
                yield _claimed(_unpacked([b for b, x in zip(blobs, claims, strict=True) if x], _CLAIMS))
        anchor, content, doc_id, start, n = _unpacked(units, _UNITS)
        order, head, of, later = first_of(doc_id, start, anchor, content)
        anchor, doc_id, start, n = anchor[order], doc_id[order], start[order], n[order]
        if later.any():
            yield _claimed(continued(doc_id[later], start[later], n[later], doc_id[of[later]], start[of[later]]))
        order = np.flatnonzero(head)
        order = order[np.argsort(anchor[order], kind="stable")]
        anchor, doc_id, start, n = anchor[order], doc_id[order], start[order], n[order]
        new = np.r_[True, anchor[1:] != anchor[:-1]] if len(anchor) else np.zeros(0, bool)
        many = (np.bincount(np.cumsum(new) - 1) > most)[np.cumsum(new) - 1] if len(anchor) else new
        if many.any():
            yield _rows(_SETTLED, doc_id=doc_id[many], start=start[many].astype(np.int32), n=n[many].astype(np.int32), anchor=anchor[many].view(np.int64))
            n = np.where(many, 0, n)
        sent = ~many | new
        part = (anchor[sent] // np.uint64(width)).astype(np.int32)
        packed = list(_packed(part, _UNITS, (anchor[sent], anchor[sent] * np.uint64(0), doc_id[sent], start[sent], n[sent])))
        if packed:
            yield _rows(_SETTLED, part=[x[0] for x in packed], units=[x[2] for x in packed])

    return run


ASKED = "doc_id long, start int, n int, anchor long, hot boolean"
_ASKED = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("anchor", pa.int64()), ("hot", pa.bool_())])


def _ask(hot: int):
    """Of one partition's anchors: the units of those that have several; ``hot`` if these are very many."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, _, doc_id, start, n = _unpacked([b for batch in batches for b in batch.column("units").to_pylist()], _UNITS)
        order = np.argsort(anchor, kind="stable")
        anchor, doc_id, start, n = anchor[order], doc_id[order], start[order], n[order]
        new = np.r_[True, anchor[1:] != anchor[:-1]] if len(anchor) else np.zeros(0, bool)
        if not len(new):
            return
        group = np.cumsum(new) - 1
        kinds = np.bincount(group) + np.bincount(group, n == 0).astype(np.int64) * (hot + 1)
        some = np.flatnonzero((kinds[group] > 1) & (n > 0))
        if len(some):
            yield _rows(_ASKED, doc_id=doc_id[some], start=start[some].astype(np.int32), n=n[some].astype(np.int32), anchor=anchor[some].view(np.int64), hot=kinds[group][some] > hot)

    return run


CLAIMED = "doc_id long, start int, n int, source long, at int"


def _continued(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The claims of a partition, which has all of a document's."""
    names = ["doc_id", "start", "n", "source", "at"]
    parts = [[b.column(c).to_numpy() for c in names] for b in batches]
    columns = continued(*map(np.concatenate, zip(*parts, strict=True))) if parts else [()]
    for at in range(0, len(columns[0]), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)].astype(t)) for c, t in zip(columns, (np.int64, np.int32, np.int32, np.int64, np.int32), strict=True)], names=names)


#: Kinds of spans: a unit that meets the others of its anchor, a later span of a claim, an earlier place of one.
UNIT, LATER, EARLIER = 0, 1, 2
SPANS = "kind int, route long, doc_id long, start int, n int, words binary"
_SPANS = pa.schema([("kind", pa.int32()), ("route", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("words", pa.binary())])


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the asked-for spans. Rows without words are repeats found on the way."""
    for whole in batches:
        for batch in chunks([whole], "z", SCAN_BYTES):
            out: list[tuple] = []
            hot: list[tuple[int, int, int, bytes]] = []
            for doc_id, z, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "z", "wanted")), strict=True):
                words = unzipped(z).split()
                line = b" ".join(words)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1).tolist()
                for x in wanted:
                    start = x["start"]
                    n = min(x["n"], len(words) - start - WINDOW + 1)
                    if n < 1 or n < x["n"] and x["kind"] == UNIT:
                        continue
                    span = line[ends[start - 1] if start else 0 : ends[start + n + WINDOW - 2] - 1]
                    if x["hot"]:
                        hot.append((doc_id, start, n, span))
                    else:
                        out.append((x["kind"], x["route"], doc_id, start, n, span))
            out += _windows(hot)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _SPANS.types, strict=True)], schema=_SPANS)


def _windows(hot: list[tuple[int, int, int, bytes]]) -> Iterator[tuple]:
    """The windows of the units one by one, routed by their words, without those that repeat others of these units."""
    gone: set[tuple[int, int]] = set()
    for doc_id, start, n in repeats(hot) if hot else ():
        gone.update((doc_id, s) for s in range(start, start + n))
        yield UNIT, _signed(xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little", signed=True))), doc_id, start, n, None
    for doc_id, start, n, text in set(hot):
        words = text.split()
        for k in range(n):
            if (doc_id, start + k) not in gone:
                window = b" ".join(words[k : k + WINDOW])
                yield UNIT, _signed(xxhash.xxh64_intdigest(window, 11)), doc_id, start + k, 1, window


INTERVALS = "doc_id long, start int, n int"
_INTERVALS = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])


class _Numbers(dict):
    """Words by number, from 1."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


def indexed(spans: list[tuple[int, int, int, bytes]]) -> tuple[FMIndex, np.ndarray, np.ndarray, dict[bytes, int]]:
    """An index of spans in order of place, with its text, the begin of each span, and its vocabulary."""
    vocabulary = _Numbers()
    sizes = np.array([s[2] for s in spans], np.int64) + WINDOW
    begin = np.cumsum(sizes) - sizes
    text = np.zeros(int(sizes.sum()), np.int64)
    inside = np.ones(len(text), bool)
    inside[begin + sizes - 1] = False
    text[inside] = np.fromiter(map(vocabulary.__getitem__, b" ".join([s[3] for s in spans]).split()), np.int64, len(text) - len(spans))
    return FMIndex(text, len(vocabulary)), text, begin, vocabulary


def repeats(spans: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int, int]]:
    """Of (doc_id, start, windows, words): windows that occur earlier among them, as runs (doc_id, start, windows)."""
    spans = sorted(set(spans))
    index, text, begin, _ = indexed(spans)
    windows, _ = ranges(begin, begin + np.array([s[2] for s in spans]))
    low, high = _searched(index, text, windows, 2)
    some = high > low
    low, at = np.unique(low[some], return_index=True)
    high = high[some][at]
    rows, group = ranges(low, high)
    places = index.locate(rows)
    if not len(places):
        return []
    # units of one document may overlap: the same place in two of them is one occurrence
    owner = np.searchsorted(begin, places, side="right") - 1
    docs, starts = np.array([s[0] for s in spans], np.int64)[owner], np.array([s[1] for s in spans], np.int64)[owner] + places - begin[owner]
    first = np.lexsort((starts, docs, group))[np.cumsum(high - low) - (high - low)]
    later = (docs != docs[first][group]) | (starts != starts[first][group])
    return _as_runs(docs[later], starts[later])


def _searched(index: FMIndex, text: np.ndarray, windows: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix ranges of the windows that begin at these places of the text."""
    low, high = np.zeros(len(windows), np.int64), np.zeros(len(windows), np.int64)
    for a in range(0, len(windows), 1 << 17):
        part = windows[a : a + (1 << 17)]
        low[a : a + len(part)], high[a : a + len(part)] = index.search(text[part[:, None] + np.arange(WINDOW)], least=least)
    return low, high


def _as_runs(docs: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
    if not len(docs):
        return []
    order = np.lexsort((starts, docs))
    docs, starts = docs[order], starts[order]
    cut = np.flatnonzero(np.r_[True, (docs[1:] != docs[:-1]) | (starts[1:] > starts[:-1] + 1)])
    last = np.r_[cut[1:], len(docs)] - 1
    return list(zip(docs[cut].tolist(), starts[cut].tolist(), (starts[last] - starts[cut] + 1).tolist(), strict=True))


def confirmed(earlier: list[tuple[int, int, int, bytes]], later: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int, int]]:
    """Of the later spans (doc_id, start, windows, words): windows that occur in an earlier place, as runs (doc_id, start, windows)."""
    earlier = sorted(set(earlier))
    index, _, begin, vocabulary = indexed(earlier)
    from_doc, from_start = np.array([s[0] for s in earlier], np.int64), np.array([s[1] for s in earlier], np.int64)
    counts = np.array([s[2] for s in later], np.int64) + WINDOW - 1
    offsets = np.cumsum(counts) - counts
    text = np.fromiter(map(vocabulary.get, b" ".join([s[3] for s in later]).split(), repeat(0)), np.int64, int(counts.sum()))
    # pieces of PIECE windows; two of a span overlap so that each window is whole in one
    pieces = -(-(counts - WINDOW + 1) // PIECE)
    number, owner = ranges(np.zeros(len(later), np.int64), pieces)
    first = offsets[owner] + number * PIECE
    left, right, low, high = index.matches(text, first, np.minimum(first + PIECE + WINDOW - 1, offsets[owner] + counts[owner]), WINDOW)
    to_doc, to_start = np.array([s[0] for s in later], np.int64), np.array([s[1] for s in later], np.int64)

    known, rank = np.unique(from_doc, return_inverse=True)

    def precede(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the text at these places occurs, in these suffix ranges, before itself."""
        each, of = np.unique((low << 32) | high, return_inverse=True)
        first = np.full(len(each), np.iinfo(np.int64).max)  # the earliest place of each range: document's rank and start
        some = np.flatnonzero(each >> 32 < each & 0xFFFFFFFF)
        ends = np.cumsum((each & 0xFFFFFFFF) - (each >> 32))[some]
        a = 0
        while a < len(some):
            to = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + (1 << 18), side="right")))
            x, y = each[some[a:to]] >> 32, each[some[a:to]] & 0xFFFFFFFF
            places = index.locate(ranges(x, y)[0])
            span = np.searchsorted(begin, places, side="right") - 1
            first[some[a:to]] = np.minimum.reduceat((rank[span] << 32) | (from_start[span] + places - begin[span]), np.cumsum(y - x) - (y - x))
            a = to
        mine = np.searchsorted(offsets, at, side="right") - 1
        doc, start = to_doc[mine], to_start[mine] + at - offsets[mine]
        own = np.searchsorted(known, doc)
        same = np.zeros(len(at), bool)
        inside = own < len(known)
        same[inside] = known[own[inside]] == doc[inside]
        return first[of] < np.where(same, (own << 32) | start, own << 32)

    sure = precede(left, low, high)
    windows, _ = ranges(left[sure], right[sure] - WINDOW + 1)
    # a long match may occur only at a later place where its windows occur earlier, too
    single = np.unique(ranges(left[~sure], right[~sure] - WINDOW + 1)[0])
    if len(single):
        windows = np.concatenate([windows, single[precede(single, *_searched(index, text, single, 1))]])
    mine = np.searchsorted(offsets, windows, side="right") - 1
    return _as_runs(to_doc[mine], to_start[mine] + windows - offsets[mine])


def _match(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repeats within each shard; rows come in order of kind and route, and a route is never cut."""
    held: list[tuple] = []
    size = 0
    for batch in batches:
        out: list[tuple[int, int, int]] = []
        for kind, route, doc_id, start, n, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if words is None:
                out.append((doc_id, start, n))
                continue
            group = (kind == UNIT, route)
            if held and held[-1][0] != group and (size >= SHARD_WORDS or held[-1][0][0] != group[0]):
                out += _shard(held)
                held, size = [], 0
            held.append((group, kind, (doc_id, start, n, words)))
            size += n + WINDOW
        if out:
            yield _runs(out)
    if held and (out := _shard(held)):
        yield _runs(out)


def _shard(held: list[tuple]) -> list[tuple[int, int, int]]:
    spans = {k: [x[2] for x in held if x[1] == k] for k in (UNIT, LATER, EARLIER)}
    if spans[UNIT]:
        return repeats(spans[UNIT])
    return confirmed(spans[EARLIER], spans[LATER]) if spans[EARLIER] and spans[LATER] else []


def _runs(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _INTERVALS.types, strict=True)], schema=_INTERVALS)


def unzipped(z: bytes | None) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z) if z else b""


def _zipped(columns: list[str], text: str, z: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(1)
        for batch in batches:
            packed = [None if t is None else press.compress(t) for t in utf8(batch.column(text))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(packed, pa.binary())], names=[*columns, z])

    return run


def _packed_texts(docs: DataFrame, text: str, z: str, *others: str) -> DataFrame:
    """The columns named and, as ``z``, the text, compressed for the shuffle."""
    kept = docs.select(*others, text)
    schema = T.StructType([*kept.drop(text).schema.fields, T.StructField(z, T.BinaryType())])
    return kept.transform(in_arrow, _zipped(list(others), text, z), schema)


def _cut(columns: list[str], names: list[str], text: str, z: str, spans: str, plain: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, removed = [], [], []
            for packed, found in zip(batch.column(z).to_pylist(), batch.column(spans).to_pylist(), strict=True):
                raw = None if packed is None else unzipped(packed)
                words = raw.split() if raw else []
                n = len(words)
                gone = np.zeros(n + 1, np.int64)
                for x in found or ():
                    np.add.at(gone, [min(x["start"], n), min(x["start"] + x["n"] + WINDOW - 1, n)], [1, -1])
                gone = np.cumsum(gone)[:n] > 0
                k = int(gone.sum())
                if k:
                    words = [words[i] for i in np.flatnonzero(~gone).tolist()]
                texts.append(None if raw is None else (b" ".join(words) if k or plain else raw).decode())
                counts.append(n)
                removed.append(k)
            arrays = {c: batch.column(c) for c in columns if c != text}
            arrays[text] = pa.array(texts, pa.string())
            if "n_chars" in arrays:
                n = [len(t) if k else x for t, k, x in zip(texts, removed, arrays["n_chars"].to_pylist(), strict=True)]
                arrays["n_chars"] = pa.array(n, arrays["n_chars"].type)
            yield pa.RecordBatch.from_arrays([*(arrays[c] for c in columns), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], names=names)

    return run


def reached(claims: DataFrame) -> DataFrame:
    """Claims cut by the reaches of the earlier document that they meet, each window in one of them."""
    first, last = F.floor(F.col("at") / REACH), F.floor((F.col("at") + F.col("n") - 1) / REACH)
    cut = claims.withColumn("reach", F.explode(F.sequence(first, last)))
    low, high = F.greatest("at", F.col("reach") * REACH), F.least(F.col("at") + F.col("n"), (F.col("reach") + 1) * REACH)
    types = {f.name: f.dataType for f in claims.schema.fields}
    cut = cut.withColumns({"start": F.col("start") + low - F.col("at"), "n": high - low, "at": low})
    return cut.withColumns({c: F.col(c).cast(types[c]) for c in ("start", "n", "at")})


def intervals(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, start, n: runs of n windows from word ``start`` that occur earlier."""
    docs = documents(docs, F.col(text).alias("text")).where("doc_id IS NOT NULL")
    size = text_bytes(docs)
    parts = max(8, size // (42 * UNITS_A_PARTITION))
    dealt = docs.transform(in_arrow, _scan(parts), "part int, claims boolean, units binary")
    settled = staged(dealt.repartition(parts, "part").transform(in_arrow, _settle(parts, HOT), SETTLED), "settled")
    # units whose anchor has different ones
    met = settled.where("units IS NOT NULL").select("part", "units").repartition(parts, "part").transform(in_arrow, _ask(HOT), ASKED)
    asked = met.unionByName(settled.where("anchor IS NOT NULL").select("doc_id", "start", "n", "anchor", F.lit(True).alias("hot")))
    asked = asked.select("doc_id", F.lit(UNIT).alias("kind"), F.col("anchor").alias("route"), "start", "n", "hot")
    # spans that may repeat an earlier place, each with as much of that place as its shard's spans claim
    claims = staged(settled.where("source IS NOT NULL").repartition(parts, "doc_id").transform(in_arrow, _continued, CLAIMED), "claims")
    claims = reached(claims)
    words = F.sum(F.col("n") + WINDOW)
    often = claims.groupBy("source", "reach").agg(words.alias("words")).where(F.col("words") > SPLIT).select("source", "reach", (F.col("words") / SPLIT).cast("long").alias("more"))
    claims = claims.join(often, ["source", "reach"], "left").withColumn("route", F.xxhash64("source", "reach", F.pmod(F.xxhash64("doc_id"), F.coalesce("more", F.lit(0)) + 1)))
    later = claims.select("doc_id", F.lit(LATER).alias("kind"), "route", "start", "n", F.lit(False).alias("hot"))
    reach = claims.groupBy("route", "source").agg(F.min("at").alias("start"), F.max(F.col("at") + F.col("n")).alias("end"))
    earlier = reach.select(F.col("source").alias("doc_id"), F.lit(EARLIER).alias("kind"), "route", "start", (F.col("end") - F.col("start")).alias("n"), F.lit(False).alias("hot"))
    wanted = asked.unionByName(later).unionByName(earlier).groupBy("doc_id").agg(F.collect_list(F.struct("kind", "route", "start", "n", "hot")).alias("wanted"))
    spans = _packed_texts(docs, "text", "z", "doc_id").join(wanted, "doc_id").transform(in_arrow, _texts, SPANS)
    shards = max(12, size // SHARD_BYTES)
    return spans.repartition(shards, F.col("kind") == UNIT, "route").sortWithinPartitions(F.col("kind") == UNIT, "route").transform(in_arrow, _match, INTERVALS)


def dedup(docs: DataFrame, text: str = "text", plain: bool = False, counts: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``, and n_chars to match.

    The words left of a cut text are joined by one space; a text with nothing
    to cut stays as it is, unless ``plain`` asks for the same form. ``counts``
    names columns for the words and the removed words of each row.
    """
    columns = docs.columns
    z, found, doc, total, removed = free_name(columns, "z", "spans", "doc", "total", "removed")
    spans = intervals(docs, text).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias(found)).select(F.col("doc_id").alias(doc), found)
    joined = _packed_texts(docs, text, z, *[c for c in columns if c != text])
    joined = joined.join(spans, joined["doc_id"] == spans[doc], "left").drop(doc)
    schema = T.StructType([*docs.schema.fields, T.StructField(total, T.LongType()), T.StructField(removed, T.LongType())])
    out = joined.transform(in_arrow, _cut(columns, [*columns, total, removed], text, z, found, plain), schema)
    return out.withColumnsRenamed({total: counts[0], removed: counts[1]}) if counts else out.drop(total, removed)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(table(spark, sf_dir, "documents"), "text")
    out = dedup(docs, plain=True, counts=("n_words", "n_removed"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
