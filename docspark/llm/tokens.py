"""Token ids of whole texts by a public tokenizer file, with a memo of words."""

from __future__ import annotations

import os
import re
from array import array
from functools import cached_property
from itertools import pairwise

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer, pre_tokenizers

#: Words a worker remembers of late, and as many from before.
MEMO = 250_000

_STOP = re.compile(rb"(?<=[0-9A-Za-z])(?=[.,][ \n])")
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Latin-1 letters as the byte-level alphabet writes their two UTF-8 bytes.
_BYTES = {c: "".join(chr(b) if b > 160 and b != 173 else chr(323 if b == 173 else 162 + b) for b in chr(c).encode()) for c in range(0xA1, 0x100)}
#: Words on which the short way of a tokenizer is tried out.
_PROBES = ["the", "Straße", "ÉTÉ", "señor", "zqxjkvb", "ÿþß", "Ångströmµ", "internationalization"]
#: New words that go to the tokenizer in one call.
BULK = 2000
#: Kinds of bytes: white space, ASCII letters and digits, marks; 0 for others.
_SPACE, _SIGN, _MARK = 1, 2, 3
_KINDS = np.array([_SPACE if bytes([b]).isspace() else _SIGN if bytes([b]).isalnum() else _MARK if b in _MARKS else 0 for b in range(256)], np.uint8)


def _lower(text: bytes | None) -> bytes:
    """A-Z lower-cased where the tokenizer's ids stay: no special token's name may arise, no letter meet a combining mark (from lead byte 0xCC)."""
    if not text:
        return b""
    safe = (text.isascii() or np.frombuffer(text, np.uint8).max() < 0xCC) and b"<|" not in text
    return text.lower() if safe else text


class Encoder(dict):
    """Ids of the words of a text as little-endian unsigned 32-bit integers.

    The tokenizer's file must drop white space and never join characters
    across it, and take a run of letters, one of digits or one of marks as
    words of their own, as word-level BPE does; a text's ids are then those of
    its words in turn. Words are cut at ASCII white space only, so any other
    space is left to the tokenizer. Marks at a word's end are looked up apart,
    which saves most misses, and words of Latin-1 letters go to the tokenizer's
    model directly, if that gives the same ids on some probes.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.before: dict[bytes, bytes] = {}
        self.direct = all(self._direct(w) == self._encoded(w) for w in _PROBES)

    def _encoded(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _direct(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word.lower().translate(_BYTES))]

    @cached_property
    def bulk(self) -> Tokenizer:
        """The model alone, for many words in one call."""
        found = Tokenizer(self.model)
        found.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        return found

    @cached_property
    def last(self) -> np.ndarray:
        """The ids that end a word."""
        suffix, vocabulary = getattr(self.model, "end_of_word_suffix", None), self.tokenizer.get_vocab()
        found = np.zeros(1 + max(vocabulary.values()), bool)
        found[[i for w, i in vocabulary.items() if suffix and w.endswith(suffix)]] = True
        return found

    @cached_property
    def bulky(self) -> bool:
        return self.direct and self._bulk(_PROBES) == [array("I", self._encoded(w)).tobytes() for w in _PROBES]

    def _bulk(self, words: list[str]) -> list[bytes]:
        """The ids of each word; the words are of Latin-1 letters."""
        ids = np.array(self.bulk.encode_batch_fast([" ".join(words).lower()], add_special_tokens=False)[0].ids, "<u4")
        raw = ids.tobytes()
        return [raw[a:b] for a, b in pairwise([0, *(4 * np.flatnonzero(self.last[ids]) + 4).tolist()])]

    def _learn(self, words: list[bytes]) -> None:
        """Takes up words that the memo lacks; those of Latin-1 letters many at a time."""
        plain: list[bytes] = []
        texts: list[str] = []
        for word in words:
            ids = self.before.get(word)
            if ids is not None:
                self[word] = ids
            elif self.bulky and (text := word.decode()).isalpha() and (word.isascii() or max(text) < "Ā"):
                plain.append(word)
                texts.append(text)
        for at in range(0, len(plain), BULK):
            self.update(zip(plain[at : at + BULK], self._bulk(texts[at : at + BULK]), strict=True))

    def __missing__(self, word: bytes) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            if self.direct and word.isalpha():  # of bytes: ASCII letters
                ids = array("I", [t.id for t in self.model.tokenize(word.decode().lower())]).tobytes()
            else:
                ids = self._new(word)
        self[word] = ids
        return ids

    def _new(self, word: bytes) -> bytes:
        stem = word.rstrip(_MARKS)
        if stem and len(stem) < len(word) and b"<|" not in word and (stem[-1:].isalnum() or stem.decode()[-1].lower().isalpha()):
            return self[stem] + self[word[len(stem) :]]
        text = word.decode()
        found = self._direct(text) if self.direct and text.isalpha() and max(text) < "Ā" else self._encoded(text)
        return array("I", found).tobytes()

    def rest(self) -> None:
        """Forgets most of the memo, so that a worker does not hold it through what it does after."""
        self.before = {}
        if len(self) > MEMO // 4:
            self.clear()

    def ids(self, text: bytes | None) -> bytes:
        if not text:
            return b""
        if len(self) > MEMO:
            self.before = dict(self)
            self.clear()
        # a single full stop or comma behind a letter is a word of its own; set apart, it multiplies no entries
        words = _STOP.sub(b" ", text.lower() if text.isascii() else text).split()
        return b"".join(map(self.__getitem__, words))

    def batch(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, and the places where each text's ids end; a distinct word is looked up once.

        Words are cut as ``ids`` does, and before all marks that end a word
        behind an ASCII letter or digit.
        """
        if len(self) > MEMO:
            self.before = dict(self)
            self.clear()
        lowered = [_lower(t) for t in texts]
        whole = b"\n".join([*lowered, b""])
        raw = np.frombuffer(whole, np.uint8)
        kind = _KINDS[raw]
        keep = kind != _SPACE
        first = keep.copy()
        first[1:] &= ~keep[:-1]
        if b"<|" not in whole:  # else a special token's name might be cut
            mark = np.concatenate([[False], kind == _MARK, [False]])
            begin, end = np.flatnonzero(mark[1:-1] & ~mark[:-2]), np.flatnonzero(mark[1:-1] & ~mark[2:])
            first[begin[(kind[begin - 1] == _SIGN) & ~keep[end + 1]]] = True
        offsets = np.append(np.flatnonzero(first[keep]), np.count_nonzero(keep))
        words = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw[keep])]).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        self._learn([w for w in distinct if w not in self])
        found = [self[w] for w in distinct]
        lexicon = np.frombuffer(b"".join(found), "<u4")
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        start, index = np.cumsum(size) - size, words.indices.to_numpy()
        size = size[index]
        to = np.append(0, np.cumsum(size))
        ids = lexicon[np.repeat(start[index] - to[:-1], size) + np.arange(to[-1])]
        ends = np.cumsum([len(t) + 1 for t in lowered], dtype=np.int64)
        return ids, to[np.searchsorted(np.flatnonzero(first), ends)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each file and worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
