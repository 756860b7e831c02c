"""op13 against a brute-force version, on odd rows, and on texts that hold marks."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from docspark.llm import fill_middle


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = ["", "a", "<", "<P", "P>", "a <P> b", "x<S>", "<M>", "<<P", "S>>", "ab 12 cd", "日本語 Ünï İß", "é" * 9, "\x00\x7f[`{@", "a\nb\r\nc", "<S" * 5, "> <" * 7, "Zz" * 50, None]


def rows_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return fill_middle.restored(fill_middle.transformed(df))


@pytest.mark.parametrize("window, batch", [(fill_middle.WINDOW, fill_middle.BATCH), (5, 64)])
def test_against_brute_force(window, batch, monkeypatch):
    """Every short text under many draws, windows of a few bytes among them."""
    monkeypatch.setattr(fill_middle, "WINDOW", window)
    rng = np.random.default_rng(4)
    rows = [(i, TEXTS[i % len(TEXTS)] if i % 3 else "".join(rng.choice(list("ab <PSM>é漢"), size=i % 23))) for i in range(600)]
    for low in range(0, len(rows), batch):
        part = rows[low : low + batch]
        h = [[int(hashlib.sha256(f"1:{i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for i, _ in part] for k in range(4)]
        given = pa.RecordBatch.from_arrays([pa.array([i for i, _ in part]), pa.array([t for _, t in part], pa.string()), *map(pa.array, h)], names=["doc_id", "text", "h1", "h2", "h3", "h4"])
        out = fill_middle._forward(given)
        got = [tuple(r[c] for c in ("n", "form", "prefix_chars", "middle_chars", "output")) for r in out.to_pylist()]
        assert got == [brute(*r) for r in part]
        assert fill_middle._backward(out.column("output"), out.column("form")).to_pylist() == [t or "" for _, t in part]


def test_in_spark(spark, plain):
    out = fill_middle.restored(fill_middle.transformed(plain)).toPandas().set_index("doc_id")
    texts = {r["doc_id"]: r["text"] for r in plain.collect()}
    assert len(out) == len(texts)
    for i, t in texts.items():
        r = out.loc[i]
        n, form, p, m, output = brute(i, t)
        assert (r["n"], r["form"], r["output"], r["restored"]) == (n, form, output, t or "")
        assert p is None or (r["prefix_chars"], r["middle_chars"]) == (p, m)


def test_odd_rows(spark, odd, none):
    out = fill_middle.transformed(odd)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = sorted(repr(tuple(r)) for r in out.collect())
    assert got == sorted(repr((r["doc_id"], *brute(r["doc_id"], r["text"]))) for r in odd.collect())
    assert fill_middle.restored(fill_middle.transformed(none)).collect() == []
    again = fill_middle.restored(fill_middle.restored(out))  # a name that is taken gets an underscore
    assert again.columns[-2:] == ["restored", "restored_"] and again.where("NOT restored <=> restored_").isEmpty()


def test_refuses_what_it_did_not_write():
    for output, form in (("<P>a<S>b", "psm"), ("a<P>b<S>c<M>", "psm"), ("<P>a<S>b<M>c<M>", "psm"), ("<P>a<S>b<M>c", "spm")):
        with pytest.raises(ValueError, match="three marks"):
            fill_middle._backward(pa.array([output]), pa.array([form]))
    assert fill_middle._backward(pa.array(["<P>a"]), pa.array(["plain"])).to_pylist() == ["<P>a"]
