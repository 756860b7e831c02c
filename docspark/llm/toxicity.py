"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

The features of a text: densities of a fixed lexicon of insults and of a
learned one (words and beginnings of words that are far more frequent in
documents marked toxic), their nearness to words of second person, rates of
capitals, punctuation, digits and other letters, and of obfuscated words, with
hits counted again once the obfuscation is undone.

The model is fitted on at most ``SAMPLE`` labelled documents, those of least
hash, with their whole texts. Features of a training document use a lexicon
learned without its fold; trees fitted without its fold give the score that the
calibration sees. What reaches the driver is bounded by ``SAMPLE`` and
``CANDIDATES``. Scoring is one pass without a shuffle.

Defined results: null and empty texts have a score like any other; labels that
are null are not used, of several labels of a document the largest counts;
without labels of both classes each score is the share of toxic ones among
them, 0 if there are none; a row without doc_id is scored; repeated rows are
scored alike; an empty table gives an empty table; the scored rows keep only
doc_id unless the caller filters by score, which keeps all columns.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.boosting import Isotonic, Trees
from docspark.llm.common import chunks, documents, free_name, in_arrow, staged, table, utf8

#: Labelled documents that a model is fitted on, at most.
SAMPLE = 9000
#: Words and beginnings of words considered for the learned lexicon, and kept in it, at most.
CANDIDATES, LEXICON = 30_000, 4000
FOLDS = 3
THRESHOLD = 0.7
CHUNK_BYTES = 8 << 20
MEMO = 300_000

INSULTS = frozenset(
    """bastard bitch clown coward crap cretin creep damn disgusting dumb dumbass fool freak garbage hate hideous
    idiot idiotic imbecile jerk kill liar loser lunatic maggot moron moronic nasty parasite pathetic pig rat
    retard rubbish scum shit shut sick slob stupid trash ugly useless vermin vile worthless
    abschaum arschloch depp dreck idioten müll scheiße trottel abruti connard crétin ordure salaud
    asqueroso basura estúpido idiota imbécil inútil""".split()
)
SECOND_PERSON = frozenset("you your yours yourself youre u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"})
_NOT_LETTER = re.compile(r"[\W\d_]+")

#: Classes of bytes: other, lower, capital, digit, space, exclamation, question, stop or comma, other punctuation, not ASCII.
_CLASS = np.zeros(256, np.uint8)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b"!", b"?", b".,;:", b"#$%&()*+-/<=>@[\\]^_`{|}~\"'")):
    _CLASS[list(_chars)] = _k + 1
_CLASS[128:] = 9

# what is known of a word, in bits
_INSULT, _YOU, _SHOUT, _MASKED, _UNMASKED, _STRETCHED, _LONG = (1 << k for k in range(7))
_TOKEN = 7  # the learned entry, from here on


def forms(word: bytes) -> tuple[str, str]:
    """A word in lower case without marks around it, and with obfuscation undone."""
    text = word.decode("utf-8", "ignore").lower()
    bare = text.strip(".,;:!?\"'()[]{}<>*#$%&|-_~`+=/\\^")
    return bare, _NOT_LETTER.sub("", bare.translate(_LEET))


def tokens(word: bytes) -> list[str]:
    """What the learned lexicon may know a word by: itself and its first four to six letters."""
    bare, _ = forms(word)
    return [bare[:24], *(f"{bare[:k]}*" for k in (4, 5, 6) if len(bare) > k)] if bare else []


class Words(dict):
    """What is known of each word met; emptied before it grows large."""

    def __init__(self, lexicon: dict[str, float]):
        ranked = sorted(lexicon, key=lambda t: (-lexicon[t], t))
        self.place = {t: k + 1 for k, t in enumerate(ranked)}
        self.weights = np.array([0.0, *(lexicon[t] for t in ranked)])

    def __missing__(self, word: bytes) -> int:
        bare, plain = forms(word)
        masked = len(bare) > 2 and plain != bare and any(c.isalpha() for c in bare) and any(not c.isalpha() and c not in "'-" for c in bare)
        code = _INSULT * (bare in INSULTS) | _YOU * (bare in SECOND_PERSON) | _SHOUT * (len(word) > 2 and word.isupper()) | _MASKED * masked | _UNMASKED * (plain in INSULTS and bare not in INSULTS) | _STRETCHED * bool(re.search(r"(.)\1\1", bare)) | _LONG * (len(bare) > 12)
        code |= min((self.place[t] for t in tokens(word) if t in self.place), default=0) << _TOKEN
        self[word] = code
        return code


NAMES = ["words", "insult_rate", "insults", "learned_rate", "learned", "learned_kinds", "learned_best", "learned_sum", "near_you", "you_rate", "unmasked", "masked_rate", "shout_rate", "stretched_rate", "long_rate", "capitals", "digits", "exclamations", "questions", "stops", "marks", "foreign", "word_bytes"]


def features(text: bytes | None, known: Words) -> list[float]:
    words = text.split() if text else []
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    if len(known) > MEMO:
        known.clear()
    codes = np.fromiter(map(known.__getitem__, words), np.int64, n)
    rate = lambda flag: float(np.count_nonzero(codes & flag)) / n
    learned = codes >> _TOKEN
    hits = np.flatnonzero(learned)
    marked = np.flatnonzero((learned > 0) | (codes & (_INSULT | _UNMASKED) > 0))
    you = np.flatnonzero(codes & _YOU)
    near = 0.0
    if len(marked) and len(you):
        right = np.searchsorted(you, marked)
        gap = np.minimum(np.abs(marked - you[np.minimum(right, len(you) - 1)]), np.abs(marked - you[np.maximum(right - 1, 0)]))
        near = float(np.mean(1 / (1 + gap)))
    insults, unmasked = np.count_nonzero(codes & _INSULT), np.count_nonzero(codes & _UNMASKED)
    kinds = np.unique(learned[hits])
    weights = known.weights[learned[hits]]
    c = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=10) / max(1, len(text))
    letters = max(1e-9, c[1] + c[2])
    return [np.log1p(n), insults / n, np.log1p(insults), len(hits) / n, np.log1p(len(hits)), float(len(kinds)), float(weights.max(initial=0)), np.log1p(float(weights.sum())), near, rate(_YOU), np.log1p(unmasked), rate(_MASKED), rate(_SHOUT), rate(_STRETCHED), rate(_LONG), c[2] / letters, c[3], c[5], c[6], c[7], c[8], c[9], len(text) / n]


def fold_of(doc_id: Column, folds: int) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit(5)), F.lit(folds)).cast("int")


def _candidates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text", CHUNK_BYTES):
        seen: Counter[str] = Counter()
        for text in utf8(batch.column("text")):
            seen.update({t for w in set((text or b"").split()) for t in tokens(w)})
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())], names=["token", "n"])


def _counts(wanted: list[str]):
    index = {t: k for k, t in enumerate(wanted)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        memo: dict[bytes, list[int]] = {}
        for batch in batches:
            for text, toxic, fold in zip(utf8(batch.column("text")), batch.column("toxic").to_pylist(), batch.column("fold").to_pylist(), strict=True):
                row = total.setdefault((toxic, fold), np.zeros(len(index), np.int64))
                found: set[int] = set()
                for w in set((text or b"").split()):
                    if (ks := memo.get(w)) is None:
                        ks = memo[w] = [index[t] for t in tokens(w) if t in index]
                    found.update(ks)
                row[list(found)] += 1
                if len(memo) > MEMO:
                    memo.clear()
        rows = [(wanted[k], toxic, fold, int(x[k])) for (toxic, fold), x in total.items() for k in np.flatnonzero(x).tolist()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["token", "toxic", "fold", "n"])

    return run


def lexicon_of(counts: np.ndarray, totals: np.ndarray, names: list[str]) -> dict[str, float]:
    """Entries with their log-odds; counts and totals by class (clean, toxic) of documents."""
    clean, toxic = counts
    odds = np.log((toxic + 0.5) / (totals[1] + 1)) - np.log((clean + 0.5) / (totals[0] + 1))
    sure = odds / np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
    good = np.flatnonzero((toxic >= 3) & (sure > 3.0) & (odds > 1.5))
    best = good[np.lexsort((good, -sure[good]))][:LEXICON]
    return {names[k]: float(odds[k]) for k in best.tolist()}


def _featured(lexicons: list[dict[str, float]]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Words(x) for x in lexicons]
        for batch in chunks(batches, "text", CHUNK_BYTES):
            rows = [features(t, known[f]) for t, f in zip(utf8(batch.column("text")), batch.column("fold").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("fold"), pa.array(rows, pa.list_(pa.float64()))], names=["toxic", "fold", "x"])

    return run


class Model:
    def __init__(self, lexicon: dict[str, float], trees: Trees | None, calibration: Isotonic | None, share: float = 0.0):
        self.lexicon, self.trees, self.calibration, self.share = lexicon, trees, calibration, share

    def score(self, texts: list[bytes | None], known: Words) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        x = np.array([features(t, known) for t in texts]).reshape(-1, len(NAMES))
        return np.clip(self.calibration(self.trees.margin(x)), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, use: Column | None = None) -> Model:
    """A model from the labelled documents; ``use`` says of a label's doc_id whether it may be learned from."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    if use is not None:
        marks = marks.where(use)
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    sample = documents(docs, "text").join(F.broadcast(marks), "doc_id").select("text", "toxic", fold_of(F.col("doc_id"), FOLDS).alias("fold"))
    # copies would fill the lexicon with their own words: of equal texts, one is learned from
    sample = sample.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256)).agg(F.min(F.struct("toxic", "fold", "text")).alias("x")).select("x.*")
    sample = staged(sample, "toxicity-sample")
    sizes = np.zeros((2, FOLDS))
    for r in sample.groupBy("toxic", "fold").count().collect():
        sizes[r["toxic"], r["fold"]] = r["count"]
    if not sizes.sum(axis=1).all():
        return Model({}, None, None, float(sizes[1].sum() / max(1, sizes.sum())))
    wanted = sample.where("toxic = 1").transform(in_arrow, _candidates, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    names = [r["token"] for r in wanted.where("n >= 3").orderBy(F.desc("n"), "token").limit(CANDIDATES).collect()]
    counts = np.zeros((2, FOLDS, len(names)))
    index = {t: k for k, t in enumerate(names)}
    for r in sample.transform(in_arrow, _counts(names), "token string, toxic int, fold int, n long").groupBy("token", "toxic", "fold").agg(F.sum("n").alias("n")).collect():
        counts[r["toxic"], r["fold"], index[r["token"]]] = r["n"]
    others = [[g for g in range(FOLDS) if g != f] for f in range(FOLDS)]
    lexicons = [lexicon_of(counts[:, o].sum(axis=1), sizes[:, o].sum(axis=1), names) for o in others]
    rows = sample.transform(in_arrow, _featured(lexicons), "toxic int, fold int, x array<double>").collect()
    x = np.array([r["x"] for r in rows])
    y, fold = np.array([r["toxic"] for r in rows], float), np.array([r["fold"] for r in rows])
    order = np.lexsort((*x.T, y, fold))  # the same model however the rows come
    x, y, fold = x[order], y[order], fold[order]
    held = np.zeros(len(y))
    for f in range(FOLDS):
        if (fold == f).any():
            rest = fold != f
            held[~rest] = Trees().fit(x[rest], y[rest]).margin(x[~rest]) if rest.any() else 0.0
    return Model(lexicon_of(counts.sum(axis=1), sizes.sum(axis=1), names), Trees().fit(x, y), Isotonic().fit(held, y))


def _scored(model: Model, columns: list[str], text: str, name: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(model.lexicon)
        for batch in chunks(batches, text, CHUNK_BYTES):
            scores = model.score(utf8(batch.column(text)), known)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(scores)], names=[*columns, name])

    return run


def score(docs: DataFrame, model: Model, *columns: str, text: str = "text", name: str = "score") -> DataFrame:
    """The columns named (all, if none is) and the score of each row, where the text is read; ``name`` must be free."""
    columns = list(columns or docs.columns)
    schema = T.StructType([*docs.select(*columns).schema.fields, T.StructField(name, T.DoubleType())])
    return docs.select(*dict.fromkeys([*columns, text])).transform(in_arrow, _scored(model, columns, text, name), schema)


def remainder(divisor: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % divisor


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, learned from all labels."""
    (name,) = free_name(docs.columns, "score")
    return score(docs, fit(docs, labels), name=name).where(F.col(name) < THRESHOLD).drop(name)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(table(spark, sf_dir, "documents"), "text")
    model = fit(docs, table(spark, sf_dir, "labels"), remainder(3) != 1)
    scored = score(docs, model, "doc_id")
    return scored.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
