"""op11 and op12 against brute force, on odd rows and on empty tables."""

import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from docspark.llm import near_vectors, whitening
from docspark.llm.graph import forest

VECTORS = "vec_id long, embedding array<float>, label int, id string, x int, v string, n int, component_id string, w int"


@pytest.fixture(scope="module")
def rows(sf):
    t = pq.read_table(f"{sf}/embeddings.parquet")
    return t.column("vec_id").to_pylist(), np.array(t.column("embedding").to_pylist(), np.float64)


@pytest.fixture(scope="module")
def strange(spark):
    """Nulls, non-finite and missing entries, zeros, copies, minus zero, a scaled copy, clashing names."""
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 0.0, 0.5], None, [nan, 0.0, 1.0], [inf, 0.0, 1.0], [None, 0.0, 1.0], [], [0.0, 0.0, 0.0], [1.0, -0.0, 0.5], [2.0, 0.0, 1.0], [0.0, 1.0, 0.0], [1.0, 0.0], [1.0, 0.0, 0.5], [0.0, 1.0, 0.01], [-1.0, 0.25, 0.125]]
    ids = [7, 1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 7, None, 13]
    return spark.createDataFrame([(i, v, 1, "a", 1, "b", 2, "c", 3) for i, v in zip(ids, vectors, strict=True)], VECTORS)


# --- whitening ------------------------------------------------------------------------------------


def exact(x):
    """n and S of the distinct integer rows."""
    fitted = {tuple(map(int, r)) for r in x}
    return len(fitted), [sum(column) for column in zip(*fitted, strict=True)]


def test_whitening_is_exact(spark, sf, rows):
    ids, vectors = rows
    x = np.floor(vectors * 256).astype(int)
    got = whitening.op11_whitening(spark, sf).toPandas()
    assert len(got) == 4 * len(ids)
    fitted = np.unique(x, axis=0)
    n, s = len(fitted), fitted.sum(axis=0)
    off = n * fitted.astype(object) - s
    v = np.array((off.T @ off) / n, float) / n**2
    values, vectors_ = np.linalg.eigh(v)
    values, vectors_ = values[::-1][:4], vectors_[:, ::-1][:, :4]
    by = {k: g.set_index("vec_id") for k, g in got.groupby("component")}
    for k in range(4):
        g = by[k + 1].loc[ids]
        assert (g["n"] == n).all() and g["identity_error"].max() < 1e-9
        assert g["deviation"].tolist() == [sum(int(a) ** 2 for a in n * r.astype(object) - s) for r in x]
        want = (x - s / n) @ vectors_[:, k] / math.sqrt(values[k])
        sign = np.sign(want @ g["whitened"].to_numpy())
        assert np.abs(sign * g["whitened"].to_numpy() - want).max() < 1e-7
        assert np.allclose(g["explained"], values[k] / np.trace(v), rtol=1e-9)


@pytest.mark.parametrize("low, high", [(-3, 4), (0, 1), (5, 5), (-(1 << 40), 1 << 40), (whitening.LEAST, whitening.MOST)])
def test_scatter(low, high):
    rng = np.random.default_rng(1)
    x = rng.integers(low, high, size=(201, 5), endpoint=True)
    x[:, 1] = low
    sums, cross = whitening.scatter(x)
    big = x.astype(object)
    assert sums == list(big.sum(axis=0))
    want = big.T @ big
    assert all(cross[i][j] == want[i][j] for i in range(5) for j in range(i, 5))


def test_whitening_does_not_depend_on_partitions(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    ask = lambda df: whitening.whitened(df).toPandas().sort_values(["id", "component"]).to_numpy().tolist()
    assert ask(rows.repartition(7)) == ask(rows.union(rows).distinct().coalesce(1))


def test_blocks_add_up(spark, sf, monkeypatch):
    x = whitening.integers(spark.read.parquet(f"{sf}/embeddings.parquet")).coalesce(1)
    whole = whitening.fit(x)
    batches = [b for b in x.select("x").toArrow().to_batches()]
    monkeypatch.setattr(whitening, "BLOCK", 37)
    parts = [r for b in whitening._blocks(batches) for r in b.to_pylist()]
    total = {}
    for r in parts:
        total[r["i"], r["j"]] = total.get((r["i"], r["j"]), 0) + int(r["high"]) * whitening.LIMB + int(r["low"])
    assert total[-1, -1] == whole.n and [total[-1, j] for j in range(64)] == whole.sums


def test_whitening_odd_rows(strange):
    got = whitening.whitened(strange).collect()
    kept = [7, 6, 8, 9, 10, 7, None, 13]
    assert sorted(str(r["id"]) for r in got if r["component"] == 1) == sorted(map(str, kept))
    assert {r["n"] for r in got} == {6} and {r["component"] for r in got} == {1, 2, 3}  # copies and minus zero count once
    x = {tuple(math.floor(256 * np.float32(c)) for c in v) for v in ([1, 0, 0.5], [0, 0, 0], [2, 0, 1], [0, 1, 0], [0, 1, 0.01], [-1, 0.25, 0.125])}
    n, s = exact(x)
    for r in got:
        if r["id"] == 13:
            assert int(r["deviation"]) == sum((n * a - b) ** 2 for a, b in zip((-256, 64, 32), s, strict=True))
    assert abs(sum(e for _, e in {(r["component"], r["explained"]) for r in got}) - 1) < 1e-9


def test_whitening_edges(spark, strange):
    assert whitening.whitened(strange.limit(0)).collect() == []
    assert whitening.whitened(strange.where("vec_id IN (1, 5)")).collect() == []  # null and empty
    one = whitening.whitened(strange.where("vec_id = 7")).collect()
    assert len(one) == 6 and {r["whitened"] for r in one} == {None} and {r["explained"] for r in one} == {0.0} and {r["identity_error"] for r in one} == {None} and {int(r["deviation"]) for r in one} == {0}
    huge = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, -0.001])], "vec_id long, embedding array<double>")
    got = {(r["id"], r["component"]): r for r in whitening.whitened(huge).collect()}
    n, s = exact([(whitening.MOST, 256), (whitening.LEAST, 512), (0, -1)])
    want = sum((n * a - b) ** 2 for a, b in zip((0, -1), s, strict=True))
    assert int(got[3, 1]["deviation"]) == want and got[1, 1]["deviation"] is None


# --- near vectors ---------------------------------------------------------------------------------


def brute(ids, vectors, threshold=0.95):
    """Links and components of rows without odd cases."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    i, j = np.nonzero(unit @ unit.T >= threshold)
    keep = i != j
    label = forest(len(ids), i[keep], j[keep])
    least = {}
    for k, c in enumerate(label):
        least[c] = min(ids[k], least.get(c, ids[k]))
    return np.bincount(i[keep], minlength=len(ids)), [least[c] for c in label]


@pytest.fixture(scope="module")
def planted(rows):
    """Given vectors with exact copies, scaled copies, clouds of near ones and pairs about the threshold."""
    rng = np.random.default_rng(5)
    _, v = rows
    v = v[:200]
    near = lambda x, c, n: c * x + math.sqrt(1 - c * c) * (lambda r: r / np.linalg.norm(r, axis=1, keepdims=True))((lambda r: r - (r @ x)[:, None] * x / (x @ x))(rng.normal(size=(n, len(x)))))
    parts = [v, v[:5], 3 * v[5:10], np.repeat(v[20:21], 60, axis=0), near(v[30], 0.99, 150)]
    parts += [near(v[40 + k], c, 4) for k, c in enumerate([0.951, 0.96, 0.94, 0.9501, 0.9499, 0.97, 0.98] * 8)]
    return np.concatenate(parts)


@pytest.mark.parametrize("most", [near_vectors.MOST, 24])
def test_near_vectors_against_brute_force(spark, planted, most, monkeypatch):
    monkeypatch.setattr(near_vectors, "MOST", most)
    ids = [int(i) for i in np.random.default_rng(2).permutation(len(planted)) * 3]
    df = spark.createDataFrame(list(zip(ids, planted.tolist(), strict=True)), "vec_id long, embedding array<double>")
    got = {r["id"]: r for r in near_vectors.near_duplicates(df.repartition(5)).collect()}
    n, component = brute(ids, planted)
    found = [got[i]["n_links"] for i in ids]
    assert all(f <= w for f, w in zip(found, n, strict=True))  # none below the threshold, none counted twice
    assert sum(found) >= 0.97 * n.sum()
    assert np.mean([got[i]["component_id"] == c for i, c in zip(ids, component, strict=True)]) > 0.97


def test_hot_buckets_change_nothing(spark, planted, monkeypatch):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(planted.tolist())], "vec_id long, embedding array<double>")
    ask = lambda: sorted(map(tuple, near_vectors.near_duplicates(df).collect()))
    plain = ask()
    monkeypatch.setattr(near_vectors, "MOST", 10)
    assert ask() == plain


@pytest.mark.parametrize("n", [1000, 10**6, 10**10])
def test_recall_at_the_threshold_is_the_same_at_every_size(n):
    """Of pairs at the very threshold, the share that shares a bucket, with the plan for ``n`` classes."""
    rng = np.random.default_rng(3)
    plan = near_vectors.planned(n)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    r = rng.normal(size=a.shape)
    r -= (r * a).sum(axis=1, keepdims=True) * a
    r /= np.linalg.norm(r, axis=1, keepdims=True)
    b = 0.95 * a + math.sqrt(1 - 0.95**2) * r
    met = (near_vectors.signatures(a, plan) == near_vectors.signatures(near_vectors.units(b), plan)).any(axis=1).mean()
    assert met > 0.965
    # unrelated ones fill a bucket with about AIM of n
    strangers = (near_vectors.signatures(a[:1000], plan)[:, 0][:, None] == near_vectors.signatures(a[1000:], plan)[:, 0]).mean()
    assert strangers * n < 40 * near_vectors.AIM


def test_threshold_is_exact():
    plan = near_vectors.planned(10)._replace(threshold=0.6)
    v = np.array([[1.0, 0.0], [3.0, 4.0], [math.nextafter(3.0, 0), 4.0]])  # 3/5 is the threshold; the last is just below
    pairs = {(int(a), int(b)) for i, j in near_vectors.linked(v, None, 0, plan) for a, b in zip(i, j, strict=True)}
    assert (0, 1) in pairs and (1, 2) in pairs
    assert ((0, 2) in pairs) == (near_vectors._exact(v[0], v[2]) >= 0.6)


def test_near_vectors_odd_rows(strange):
    got = sorted(((r["id"], r["n_links"], r["component_id"]) for r in near_vectors.near_duplicates(strange).collect()), key=str)
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 3, 7), (7, 3, 7), (8, 3, 7), (9, 3, 7), (10, 1, 10), (11, 0, 11), (13, 0, 13), (None, 1, 10)]
    assert got == sorted(want, key=str)
    assert near_vectors.near_duplicates(strange.limit(0)).collect() == []
    huge = strange.sparkSession.createDataFrame([(1, [1e300, 0.0]), (2, [1e300, 1.0]), (3, [0.0, 1e-300]), (4, [0.0, 5e-324])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, near_vectors.near_duplicates(huge).collect())) == [(1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 3)]


def test_op12_kept(spark, sf):
    out = near_vectors.op12_near_vectors(spark, sf).toPandas()
    assert list(out.columns) == ["vec_id", "n_links", "component_id", "kept"]
    assert (out["kept"] == (out["vec_id"] == out["component_id"])).all()
