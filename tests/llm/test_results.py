"""The queries against brute force on the smallest tables, and held-out accuracy of the models."""

import base64
import hashlib
import re
import zlib
from collections import Counter
from itertools import combinations_with_replacement

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from docspark.llm import boosting, fmindex, graph, huffman, packing, sharding, simhash
from docspark.llm.queries import ORACLE_SQL, QUERIES
from docspark.llm.tokens import Encoder

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PATH = public_tokenizers.path("word_bpe_49k.json")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def docs(plain):
    return sorted(plain.collect(), key=lambda r: r["doc_id"])


def result(spark, sf, name, key="doc_id"):
    return {r[key]: r for r in QUERIES[name](spark, sf).collect()}


def brute_components(prints):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    f = np.array(prints, np.uint64)
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i] ^ f[i + 1 :]) <= 4) + i + 1:
            a, b = sorted((root(i), root(int(j))))
            parent[b] = a
    return [root(i) for i in range(len(f))]


def plain_print(text):
    w = SPACE.findall(lower(text))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


@pytest.mark.parametrize("most", [1 << 18, 30])
def test_op1(spark, sf, docs, most, monkeypatch):
    monkeypatch.setattr(simhash, "MOST", most)  # 30: subtries are dealt again and again
    got = result(spark, sf, "op1_simhash")
    prints = [plain_print(r["text"]) for r in docs]
    roots = brute_components(prints)
    for r, p, k in zip(docs, prints, roots, strict=True):
        assert (got[r["doc_id"]]["fingerprint"], got[r["doc_id"]]["component_id"]) == (f"{p:016x}", docs[k]["doc_id"])


def test_trie_join_on_a_dense_ball():
    rng = np.random.default_rng(0)
    centre = int(rng.integers(1 << 62))
    near = {centre ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in rng.integers(0, 7, 400)}
    words = np.array(sorted(near | {int(x) for x in rng.integers(1 << 62, size=300)}), np.uint64)
    own, other = words[::2], words[1::2]
    both = np.concatenate([own, other])
    labels = set()
    for turn, budget in simhash.TRIES:
        spin = lambda x: (x << np.uint64(turn)) | (x >> np.uint64(64 - turn)) if turn else x  # noqa: B023, E731
        a, b = np.sort(spin(own)), np.sort(spin(other))
        place = {int(w): i for i, w in enumerate(both)}
        back = lambda x: place[int((x >> np.uint64(turn)) | (x << np.uint64(64 - turn)) if turn else x)]  # noqa: B023, E731
        joined = np.concatenate([a, b])
        u, v = simhash.join(a, b, budget)
        labels |= {(back(joined[i]), back(joined[j])) for i, j in zip(u, v, strict=True)}
        u, v = simhash.join(b, a[:0], budget)
        labels |= {(back(b[i]), back(b[j])) for i, j in zip(u, v, strict=True)}
    pairs = np.array(sorted(labels))
    got = graph.forest(len(both), pairs[:, 0], pairs[:, 1])
    want = brute_components([int(x) for x in both])
    assert got.tolist() == want


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(80)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_op2(spark, sf, docs):
    got = result(spark, sf, "op2_sharding")
    at, owners = sharding.ring(24)
    home = lambda i: int(np.searchsorted(at, int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16))) % len(at)
    counts = Counter(home(r["doc_id"]) for r in docs)
    # one row at a time: each takes its home's shard, or goes on clockwise, all arcs in step
    room = [len(docs) // 24 + (s < len(docs) % 24) for s in range(24)]
    want, left, step = Counter(), dict(counts), 0
    while any(left.values()):
        for arc in sorted((a for a in left if left[a]), key=lambda a: (a + step) % len(at)):
            shard = owners[(arc + step) % len(at)]
            k = min(left[arc], room[shard])
            want[arc, shard] += k
            left[arc] -= k
            room[shard] -= k
        step += 1
    assert Counter((home(i), r["shard"]) for i, r in got.items()) == +want
    for r in docs:
        raw = (r["text"] or "").encode()
        assert (got[r["doc_id"]]["size"], got[r["doc_id"]]["text_crc32"], got[r["doc_id"]]["law"], got[r["doc_id"]]["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
    slots = {}
    for r in got.values():
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def ids_of(docs, end):
    tokenizer = Tokenizer.from_file(PATH)
    return [np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, end], "<u4") for r in docs]


@pytest.mark.parametrize("size", [1 << 22, 20_000])
def test_op3(spark, sf, docs, size, monkeypatch):
    monkeypatch.setattr(huffman, "LEAST_TOKENS", size)  # the small one: several files
    got, at = result(spark, sf, "op3_token_files"), 0
    for r, ids in zip(docs, ids_of(docs, 2), strict=True):
        g = got[r["doc_id"]]
        assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_huffman_round_trip(tmp_path):
    rng = np.random.default_rng(5)
    for n, limit in ((1, 5), (2, 5), (5, 4), (3000, 12), (40000, 18)):
        counts = rng.zipf(1.2, n).clip(max=10**9).astype(np.int64)
        lengths = huffman.code_lengths(counts, limit)
        assert lengths.max() <= limit and (n == 1 or (2.0 ** -lengths.astype(float)).sum() == 1)
        docs = [(i if i else None, rng.integers(0, n, k)) for i, k in enumerate((0, 1, 511, 512, 513, 300_000, 7))]
        path = tmp_path / f"{n}.huf"
        path.write_bytes(b"".join(huffman.file_parts(docs, huffman.Code(lengths), [])))
        back = list(huffman.Reader(path.as_uri()).documents())
        assert [b[0] for b in back] == [d for d, _ in docs] and all((a == b[2]).all() for (_, a), b in zip(docs, back, strict=True))
    (tmp_path / "cut.huf").write_bytes(path.read_bytes()[:-5])
    with pytest.raises(ValueError):
        huffman.Reader((tmp_path / "cut.huf").as_uri())


def test_length_limit_is_optimal():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21])
    assert sorted(huffman.code_lengths(counts, 20).tolist()) == [1, 2, 3, 4, 5, 6, 7, 7]
    for limit in (3, 4, 5, 6):
        lengths = huffman.code_lengths(counts, limit)
        assert lengths.max() <= limit and sum(2.0**-n for n in lengths.tolist()) <= 1
        # the cheapest of all sets of lengths that a prefix code can have, the longest for the rarest
        cheapest = min(int((np.array(x) * counts).sum()) for x in combinations_with_replacement(range(limit, 0, -1), 8) if sum(2.0**-n for n in x) <= 1)
        assert int((lengths * counts).sum()) == cheapest


def test_memo_equals_the_tokenizer():
    tokenizer, memo = Tokenizer.from_file(PATH), Encoder(PATH)
    rng = np.random.default_rng(2)
    letters = [*"aAbBéÉßÿİıſΣςσ'’.,!<|>%0159²½ \t\n\x1c\x85\xa0ẞKﬁ日-_", "<|endoftext|>", "'s", "...", "̱", "̇"]
    for _ in range(3000):
        text = "".join(rng.choice(letters, rng.integers(1, 14)))
        assert np.frombuffer(memo.ids(text.encode()), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def check_pieces(rows, texts):
    by, sequences = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by) == set(texts)
    for doc, ids in texts.items():
        at = 0
        for p in sorted(by[doc], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return sum(r["length"] for r in rows) / len(sequences) / 2048


def test_op4(spark, sf, docs):
    fill = check_pieces(QUERIES["op4_packing"](spark, sf).collect(), {r["doc_id"]: i for r, i in zip(docs, ids_of(docs, 1), strict=True)})
    assert fill > 0.95


def test_plan_places_every_piece():
    rng = np.random.default_rng(4)
    counts = {int(k): int(n) for k, n in zip(rng.integers(1, 2049, 300), rng.integers(1, 5000, 300), strict=True)}
    used = Counter()
    for packs, lengths in packing.plan(counts):
        assert sum(lengths) <= 2048
        for x in lengths:
            used[x] += packs
    assert used == Counter(counts)


def brute_hits(text, windows):
    w, hit, items = WORD.findall(lower(text)), set(), set()
    for n in {len(k) for k in windows}:
        for i in range(len(w) - n + 1):
            if found := windows.get(tuple(w[i : i + n])):
                hit |= set(range(i, i + n))
                items |= found
    return w, hit, items


def test_op5(spark, sf, docs):
    windows = {}
    for b in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = WORD.findall(lower(b["text"]))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(b["item_id"])
    got = result(spark, sf, "op5_decontaminate")
    for r in docs:
        w, hit, items = brute_hits(r["text"], windows)
        sha = hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_hit"], g["n_items"], g["items_sha256"], g["contaminated"]) == (len(w), len(hit), len(items), sha, bool(hit))


def brute_repeats(docs):
    seen, out = set(), {}
    for r in docs:
        w, gone = SPACE.findall(r["text"] or ""), set()
        for i in range(len(w) - 19):
            t = tuple(w[i : i + 20])
            gone |= set(range(i, i + 20)) if t in seen else set()
            seen.add(t)
        out[r["doc_id"]] = (w, gone)
    return out


def test_op6(spark, sf, docs):
    got = result(spark, sf, "op6_substring_dedup")
    for doc, (w, gone) in brute_repeats(docs).items():
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        g = got[doc]
        assert (g["n_words"], g["n_removed"], g["kept_sha256"]) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_fm_index():
    rng = np.random.default_rng(1)
    text = np.concatenate([np.r_[rng.integers(1, 4, rng.integers(1, 12)), 0] for _ in range(30)])
    index = fmindex.FMIndex(text, 3, every=4)
    patterns = [rng.integers(1, 4, rng.integers(1, 6)).tolist() for _ in range(60)]
    padded = np.array([[-1] * (5 - len(p)) + p for p in patterns])
    low, high = index.search(padded)
    for p, a, b in zip(patterns, low, high, strict=True):
        assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(len(text)) if text[i : i + len(p)].tolist() == p]


def test_op7_held_out(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    got = result(spark, sf, "op7_toxicity")
    marks = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(got[d]["score"], got[d]["predicted"], y) for d, y in marks.items() if got[d]["held_out"]]
    assert all(got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d in marks)
    assert sum(p for _, p, y in held if not y) <= 2
    assert sum(p for _, p, y in held if y) >= 0.6 * sum(y for _, _, y in held)
    assert all(p == (s >= 0.7) for s, p, _ in held)


def test_trees_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    margin = boosting.Trees(trees=40).fit(x, y).margin(x)
    assert ((margin > 0) == y).mean() > 0.97
    step = boosting.Isotonic().fit(margin, y)
    assert (np.diff(step(np.sort(margin))) >= 0).all() and 0 <= step(margin).min() <= step(margin).max() <= 1


def test_op8_held_out(spark, sf, docs):
    got = result(spark, sf, "op8_language")
    held = [r for r in docs if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(got[r["doc_id"]]["held_out"] for r in held) and sum(g["held_out"] for g in got.values()) == len(held)
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)


def test_op9(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    last = {}
    for p in pages:
        last[p["html"] or ""] = max(p["page_id"], last.get(p["html"] or "", -1))
    got = result(spark, sf, "op9_warc", "page_id")
    for p in pages:
        raw, top = (p["html"] or "").encode(), last[p["html"] or ""]
        again = top != p["page_id"]
        g = got[p["page_id"]]
        assert (g["payload_bytes"], g["payload_digest"], g["record_type"], g["refers_to"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", top if again else None)


def test_pipeline(spark, sf, docs):
    """Each stage but the first against brute force on what its predecessor kept."""
    current, kept = spark.read.parquet(f"{sf}/documents.parquet"), docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, current, sf).collect()
        if name == "toxicity":
            marks = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            gone = {r["doc_id"] for r in kept} - {r["doc_id"] for r in out}
            assert sum(marks.get(d) == 0 for d in gone) <= 1
        elif name == "simhash near-dedup":
            roots = brute_components([plain_print(r["text"]) for r in kept])
            assert {r["doc_id"] for r in out} == {kept[k]["doc_id"] for k in set(roots)}
        elif name == "substring dedup":
            texts = {r["doc_id"]: r["text"] for r in out}
            for doc, (w, lost) in brute_repeats(kept).items():
                assert SPACE.findall(texts[doc] or "") == [x for i, x in enumerate(w) if i not in lost]
        elif name == "benchmark decontamination":
            assert [r["doc_id"] for r in sorted(out, key=lambda r: r["doc_id"])] == [r["doc_id"] for r in kept]
            joined = {tuple(WORD.findall(lower(b["text"]))[:10]) for b in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
            assert not any(brute_hits(r["text"], {j: {0} for j in joined})[1] for r in out)
        else:
            assert check_pieces(out, {r["doc_id"]: i for r, i in zip(kept, ids_of(kept, 1), strict=True)}) > 0.9
            break
        kept = sorted(out, key=lambda r: r["doc_id"])
        current = spark.createDataFrame(kept, current.schema)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_duckdb_forms(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cursor = c.execute(ORACLE_SQL[name])
    columns = [x[0] for x in cursor.description]
    want = sorted(repr(tuple(r)) for r in cursor.fetchall())
    assert sorted(repr(tuple(r)) for r in QUERIES[name](spark, sf).select(*columns).collect()) == want
