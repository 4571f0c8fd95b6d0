import numpy as np
import pytest

from assayloom.llm import embedding_dedup as E


def brute(ids, vecs, threshold=0.9):
    ok = [i for i, v in enumerate(vecs) if v and all(x is not None and np.isfinite(x) for x in v) and any(v) and ids[i] is not None]
    n, up = [0] * len(ids), {ids[i]: ids[i] for i in range(len(ids)) if ids[i] is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ok:
        for b in ok:
            if a < b and len(vecs[a]) == len(vecs[b]):
                x, y = np.array(vecs[a], float), np.array(vecs[b], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    n[a] += 1
                    n[b] += 1
                    p, q = top(ids[a]), top(ids[b])
                    up[max(p, q)] = min(p, q)
    return sorted((ids[i], n[i], top(ids[i]) if ids[i] is not None else None) for i in range(len(ids)) if ids[i] is not None)


def pairs_at(rng, n, d, cosine):
    x = rng.standard_normal((n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((n, d))
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    return x, cosine * x + np.sqrt(1 - cosine**2) * z


def test_links_equal_brute_force_on_odd_vectors(spark):
    rng = np.random.default_rng(3)
    x, y = pairs_at(rng, 40, 8, 0.93)
    vecs = [v.astype(np.float32).tolist() for v in (*x, *y)]
    vecs += [None, [], [0.0] * 8, [float("nan")] + [1.0] * 7, [None] + [1.0] * 7, [float("inf")] * 8, [1.0] * 8, [2.0] * 8, [1.0] * 8, [1.0, 2.0], [2.0, 4.0], [1.0]]
    ids = list(range(len(vecs)))
    rows = [(i, v, "l", "x", "y") for i, v in zip(ids, vecs, strict=True)] + [(None, [1.0] * 8, "l", "x", "y")]
    got = E.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string, rep string, vec string")).collect()
    assert len(got) == len(rows)
    assert sorted((r["vec_id"], r["n_links"], r["component"]) for r in got if r["vec_id"] is not None) == brute(ids, vecs)
    assert [tuple(r) for r in got if r["vec_id"] is None] == [(None, 0, None)]


def test_repeated_ids_and_doubles_and_empty(spark):
    rows = [(1, [1e200, 1.0]), (1, [1e200, 1.0]), (2, [1.0, 0.0])]
    got = sorted(map(tuple, E.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert E.embedding_groups(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_recall_at_the_threshold(spark, monkeypatch):
    """Pairs just above 0.9 among random vectors: the hardest links there are; many more cells than probes."""
    monkeypatch.setattr(E, "PER_CELL", 16)
    rng = np.random.default_rng(5)
    x, y = pairs_at(rng, 2000, 64, 0.905)
    v = np.concatenate([x, y]).astype(np.float32)
    got = E.embedding_groups(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<float>")).collect()
    found = sum(r["n_links"] for r in got) / len(v)
    assert found >= 0.9, found


def test_recall_with_thousands_of_cells():
    """The share of pairs just above 0.9 that meet in a cell one of them is at home in, of 8,192 cells."""
    rng = np.random.default_rng(9)
    x, y = pairs_at(rng, 8_192, 64, 0.905)
    index = E.Index(np.concatenate([x, y]), 8_192)
    a, b = (np.concatenate([index.nearest(v[i : i + 1024], E.PROBES) for i in range(0, len(v), 1024)]) for v in (x, y))
    assert ((a == b[:, :1]) | (b == a[:, :1])).any(axis=1).mean() >= 0.97


def test_dense_groups_are_cut_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(E, "HOMES", 16)
    monkeypatch.setattr(E, "VISITORS", 40)
    rng = np.random.default_rng(6)
    v = np.concatenate([np.ones((150, 16)) + 0.05 * rng.standard_normal((150, 16)), rng.standard_normal((50, 16))]).astype(np.float32)
    rows = [(i, r.tolist()) for i, r in enumerate(v)]
    got = sorted(map(tuple, E.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()))
    assert got == brute([r[0] for r in rows], [r[1] for r in rows])


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(7)
    x = E.unit(rng.standard_normal((3000, 64)))
    index = E.Index(x[:500], 4)
    home = index.nearest(x, 1)[:, 0]
    cell = int(np.bincount(home).argmax())
    y, q = x[home == cell], x[:200]
    bits, factor, size = index.codes(y, np.full(len(y), cell))
    estimate, upper = E.upper_bounds(index, cell, q, y, bits, factor, size)
    exact = q @ y.T
    assert abs((estimate - exact).mean()) < 0.02  # one rotation; the mean over rotations is zero
    assert (exact > upper).mean() < 0.005


@pytest.mark.parametrize("n", [1, 7])
def test_forest_connects(n):
    rng = np.random.default_rng(n)
    a, b = rng.integers(0, 30, 20 * n), rng.integers(0, 30, 20 * n)
    x, y = E.forest(a, b)
    assert len(x) <= 30
    full, thin = (brute_components(*p) for p in ((a, b), (x, y)))
    assert {k: full[k] for k in set(a) | set(b)} == {k: thin.get(k, k) for k in set(a) | set(b)}


def brute_components(a, b):
    up = {k: k for k in set(a) | set(b)}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, j in zip(a, b, strict=True):
        p, q = top(i), top(j)
        up[max(p, q)] = min(p, q)
    return {k: top(k) for k in up}
