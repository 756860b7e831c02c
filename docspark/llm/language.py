"""Language of whole texts by averaged hashed subword embeddings and a linear softmax.

Subwords are the byte sequences of 2 to 4 bytes within a word, a space on
either side counting as its border. Each falls in one of ``BUCKETS`` buckets
with an embedding; a text is the mean of its embeddings, followed by a linear
softmax. Both are trained together by stochastic gradient descent in numpy on
at most ``SAMPLE`` documents of least hash, with their whole texts, a fifth of
which only set the temperature of the softmax and the score below which a
prediction is marked as rejected. Embeddings and weights are then multiplied
out, so a text costs a table look-up for each subword and no shuffle.

Defined results: a null text and one without a letter are ``und`` with score 0,
as is every text where nothing could be learned; a row without doc_id is
predicted; of repeated training rows one is used; rows without lang are not
learned from; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import documents, in_arrow, staged, table, utf8

SAMPLE = 2500
BUCKETS = 1 << 15
DIMENSIONS = 16
SIZES = (2, 3, 4)
EPOCHS = 6
#: Of the accepted predictions of the calibration part, this share is right.
PRECISION = 0.99
SLICE = 1 << 18
UNKNOWN = "und"

#: ASCII that is no letter separates words; capitals are made small.
_PLAIN = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in bytes(range(256)).lower())
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or (not text.isascii() and any(c.isalpha() for c in text.decode()))


def subwords(text: bytes) -> Iterator[np.ndarray]:
    """The buckets of all subwords, in slices."""
    raw = text if text.isascii() else text.decode().lower().encode()
    plain = np.frombuffer(b" " + raw.translate(_PLAIN) + b" ", np.uint8)
    most = max(SIZES)
    for at in range(0, len(plain), SLICE):
        part = plain[at : at + SLICE + most - 1]
        space = part == 32
        inner = np.concatenate([[0], np.cumsum(space)])
        for n in SIZES:
            count = min(SLICE, len(part) - n + 1)
            if count <= 0:
                continue
            h = np.full(count, n, np.uint32)
            for j in range(n):
                h = h * np.uint32(0x01000193) + part[j : j + count]
            h ^= h >> np.uint32(15)
            # no space but at either end, and more than spaces
            whole = (inner[n - 1 : n - 1 + count] == inner[1 : 1 + count]) & ~(space[:count] & space[n - 1 : n - 1 + count] & (n == 2))
            yield (h[whole] & np.uint32(BUCKETS - 1)).astype(np.int64)


class Model:
    """Sums of ``logits`` over a text's subwords, divided by their number and the temperature."""

    def __init__(self, languages: list[str], logits: np.ndarray, bias: np.ndarray, temperature: float = 1.0, least: float = 0.0):
        self.languages, self.logits, self.bias, self.temperature, self.least = languages, logits, bias, temperature, least

    def raw(self, text: bytes) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for buckets in subwords(text):
            total += self.logits[buckets].sum(axis=0)
            n += len(buckets)
        return total / max(1, n) + self.bias

    def predict(self, text: bytes | None) -> tuple[str, float, bool]:
        """Language, score and whether it is to be rejected."""
        if not self.languages or text is None or not has_letter(text):
            return UNKNOWN, 0.0, True
        p = softmax(self.raw(text) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.least)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, weights and bias from (buckets, their shares, class) of each text."""
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.3, (BUCKETS, DIMENSIONS)).astype(np.float32)
    w, b = np.zeros((DIMENSIONS, classes), np.float32), np.zeros(classes, np.float32)
    steps, done = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            buckets, shares, y = rows[k]
            rate = np.float32(1.0 * (1 - done / steps))
            done += 1
            mean = shares @ e[buckets]
            g = softmax(mean @ w + b).astype(np.float32)
            g[y] -= 1
            down = w @ g
            w -= rate * np.outer(mean, g)
            b -= rate * np.float32(0.1) * g
            # shares are small: embeddings take steps as if each text had a hundred subwords
            e[buckets] -= rate * np.minimum(np.float32(1), shares * 100)[:, None] * np.float32(0.05) * down
    return e, w, b


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buckets, counts = [], []
        for text in utf8(batch.column("text")):
            total = np.zeros(BUCKETS, np.int64)
            for part in subwords(text):
                total += np.bincount(part, minlength=BUCKETS)
            some = np.flatnonzero(total)
            buckets.append(some.astype("<u2" if BUCKETS <= 1 << 16 else "<u4").tobytes())
            counts.append((total[some] / max(1, total.sum())).astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("held"), pa.array(buckets, pa.binary()), pa.array(counts, pa.binary())], names=["lang", "held", "buckets", "shares"])


def fit(docs: DataFrame, use: Column | None = None) -> Model:
    """A model from doc_id, text and lang of ``docs``; ``use`` says of a doc_id whether it may be learned from."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang").where("doc_id IS NOT NULL AND lang IS NOT NULL")
    if use is not None:
        ids = ids.where(use)
    ids = ids.groupBy("doc_id").agg(F.min("lang").alias("lang")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    ids = ids.withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(5)) == 0)
    texts = documents(docs, "text").where("text IS NOT NULL").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "held")).alias("x"))
    rows = staged(texts.select("x.*").transform(in_arrow, _counted, "lang string, held boolean, buckets binary, shares binary"), "language-sample").collect()
    rows = sorted(rows, key=lambda r: (r["lang"], r["buckets"], r["shares"]))  # the same model however the rows come
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    kind = "<u2" if BUCKETS <= 1 << 16 else "<u4"
    data = [(np.frombuffer(r["buckets"], kind).astype(np.int64), np.frombuffer(r["shares"], "<f4"), languages.index(r["lang"])) for r in rows]
    learned = [x for x, r in zip(data, rows, strict=True) if not r["held"]] or data
    e, w, b = train(learned, len(languages))
    model = Model(languages, e @ w, b.astype(float))
    held = [x for x, r in zip(data, rows, strict=True) if r["held"]]
    if held:
        raw = np.array([s @ model.logits[k] + model.bias for k, s, _ in held])
        y = np.array([x[2] for x in held])
        loss = lambda t: -np.log(softmax(raw / t)[np.arange(len(y)), y] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.3, 5, 60), key=loss))
        p = softmax(raw / model.temperature)
        best, right = p.max(axis=1), p.argmax(axis=1) == y
        order = np.argsort(-best)
        precise = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(y) + 1) >= PRECISION)
        model.least = float(best[order[precise[-1]]]) if len(precise) else 1.0
    return model


def _predicted(model: Model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t) for t in utf8(batch.column("text"))]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in zip(*found, strict=True))], names=["doc_id", "lang_pred", "score", "rejected"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and rejected of each row."""
    return documents(docs, "text").transform(in_arrow, _predicted(model), "doc_id long, lang_pred string, score double, rejected boolean")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    found = predict(docs, fit(docs, remainder != 0))
    return found.select("doc_id", (remainder == 0).alias("held_out"), "lang_pred", "score", "rejected")
