"""Token files: distinct words in bulk, ids as the tokenizer gives them for whole texts."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from docspark.llm import huffman, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


def written(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "text"])
    out = [(d, huffman._wide(b).tolist()) for part in huffman._tokenized(PATH, huffman.END)(iter([batch])) for d, b in zip(*part.to_pydict().values(), strict=True)]
    assert [d for d, _ in out] == list(range(len(texts)))
    return [ids for _, ids in out]


def plain(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, huffman.END] for t in texts]


def test_new_words_go_to_the_tokenizer_in_bulk(monkeypatch):
    rng, single = random.Random(3), []
    words = sorted({"".join(rng.choices("abcdeghéèüñß", k=9)) + "o" for _ in range(6000)})
    texts = [" ".join(rng.choices(words, k=50)) + rng.choice([".", ",%%%", "!"]) for _ in range(400)]
    monkeypatch.setattr(tokens, "_ENCODERS", {PATH: tokens.Encoder(PATH)})
    missing = tokens.Encoder.__missing__
    monkeypatch.setattr(tokens.Encoder, "__missing__", lambda self, word: single.append(word) or missing(self, word))
    assert written(texts) == plain(texts)
    assert len(single) < 10


def test_texts_of_all_kinds(monkeypatch):
    rng = random.Random(4)
    parts = ["Don't", "it's,", "J̌im", "J", "̌", "W̊", "É", "é", "İ", "ΣΑΣ", "日本", "12", "a_b", "...", "(x)", "x!?", "<|", "|>", "<|startoftext|>", "<|STARTOFTEXT|>", "<|EndOfText|>.", "'", "'S", " ", "\u0085", "\x1c", "\x00", "ﬁ", "µª", "😀", "A" * 300]
    spaces = ["", " ", "\n", "\t ", "\x0b", " "]
    texts = ["".join(x for _ in range(rng.randrange(12)) for x in (rng.choice(parts), rng.choice(spaces))) for _ in range(3000)]
    # texts with a special token's name apart, as it changes how its whole batch is cut
    for some in ([t for t in texts if "<|" not in t], texts, [None, "", " \n", None], ["x <|STARTOFTEXT|> y"]):
        assert written(some) == plain(some)
    monkeypatch.setattr(tokens, "MEMO", 10)
    monkeypatch.setattr(huffman, "TEXTS", 500)
    assert written(texts) == plain(texts)


def test_batches_are_cut_by_bytes_and_rows(monkeypatch):
    monkeypatch.setattr(huffman, "TEXTS", 6400)
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([None] * 1000, pa.string())], names=["doc_id", "text"])
    sizes = [part.num_rows for part in huffman._tokenized(PATH, huffman.END)(iter([batch]))]
    assert sum(sizes) == 1000 and max(sizes) == 100


def test_places_of_texts():
    ids, ends = tokens.Encoder(PATH).batch([None, b"one two.", b"", b"three"])
    assert ends.tolist() == [0, 3, 3, 4] and len(ids) == 4
    ids, ends = tokens.Encoder(PATH).batch([])
    assert len(ids) == len(ends) == 0 and ids.dtype == np.dtype("<u4")
