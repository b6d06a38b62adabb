"""Vector operators against brute force: nulls, non-finite and odd lengths, ties, repeated rows, empty tables, extra columns."""

import hashlib
import math
import random

import numpy as np
import pytest

from tracegauge.llm import lloyd, topk, whitening

ROW = "vec_id bigint, embedding array<float>, label int, rank int, cluster int"
NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], ROW)


def crowd(n, dims, seed, ids=None):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((5, dims))
    rows = [(i if ids is None else ids[i], [float(np.float32(x)) for x in centres[i % 5] * (i % 3) + rng.standard_normal(dims) / 4]) for i in range(n)]
    return rows


def odd(dims):
    return [(900, None), (901, [1.0] * (dims - 1) + [None]), (902, [NAN] * dims), (903, [1.0] * (dims - 1) + [-INF]), (904, [])]


def sound(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def whole(v, scale):
    return [math.floor(scale * c) for c in v]


# --- top k ---------------------------------------------------------------------------------------


def brute_top(rows, k, every):
    x = [(i, whole(v, 1024)) for i, v in rows if i is not None and sound(v)]
    out = {}
    for q, a in x:
        if q % every:
            continue
        best = out.setdefault(q, {})
        for c, b in x:
            if c != q:
                s = sum(p * r for p, r in zip(a, b, strict=False))
                best[c] = max(best.get(c, s), s)
    return {(q, r + 1, c, s) for q, best in out.items() for r, (c, s) in enumerate(sorted(best.items(), key=lambda t: (-t[1], t[0]))[:k])}


def test_top_k_equals_brute_force(spark):
    rows = crowd(300, 7, 1)
    common = rows[10][1]
    rows += [(1000 + i, common) for i in range(120)]  # a vector that a third of all rows hold
    rows += [(2000 + i, [0.0] * 7) for i in range(20)]
    rows += [(0, rows[0][1]), (20, [5.0] * 7), (20, [-5.0] * 7), (None, [9.0] * 7), (3000, [2.0, -1.0]), *odd(7)]
    random.Random(1).shuffle(rows)
    got = topk.search(frame(spark, rows), k=10, every=20)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == brute_top(rows, 10, 20)


def test_top_k_of_few_and_of_none(spark):
    rows = [(0, [1.0, 2.0]), (100, [1.0, 2.0]), (7, [3.0, -1.0])]
    got = {tuple(r) for r in topk.search(frame(spark, rows)).collect()}
    assert got == brute_top(rows, 10, 100) and len(got) == 4
    assert topk.search(frame(spark, rows[:1])).count() == 0
    assert topk.search(frame(spark, odd(3))).count() == 0  # an empty vector is alone
    assert topk.search(frame(spark, [])).count() == 0


def test_top_k_with_scores_beyond_doubles(spark):
    rows = [(i, [1e9 + i * 1e4, -3e8, 1.5]) for i in range(30)]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in rows]
    assert {tuple(r) for r in topk.search(frame(spark, rows), k=3, every=10).collect()} != set()
    small = [(i, [c / 1e4 for c in v]) for i, v in rows]
    small = [(i, [float(np.float32(c)) for c in v]) for i, v in small]
    assert {tuple(r) for r in topk.search(frame(spark, small), k=3, every=10).collect()} == brute_top(small, 3, 10)


def test_small_cells_give_the_same(spark, monkeypatch):
    rows = crowd(200, 6, 4)
    monkeypatch.setattr(topk, "CELL_ROWS", 16)
    monkeypatch.setattr(topk, "CELL_QUERIES", 4)
    monkeypatch.setattr(topk, "SCORES", 64)
    assert {tuple(r) for r in topk.search(frame(spark, rows), k=5, every=10).collect()} == brute_top(rows, 5, 10)


def test_later_phases_see_few_vectors(spark):
    rows = crowd(2000, 32, 9)
    made, _ = topk.classes(topk.integers(frame(spark, rows), "vec_id", "embedding", 1024), 10, 100)
    cells = topk.Cells(made)
    cut = {r.q: r.cut for r in topk.cutoffs(cells, topk.complete(cells, topk.known(cells.ask(topk.Best(11))).persist()), 11).collect()}
    sent = cells.ask(topk.Reaching(), spark.createDataFrame(list(cut.items()), "q bigint, cut bigint")).count()
    assert sent < 2000 * len(cut)  # of 2 * 2000 * queries partial scores


# --- whitening -----------------------------------------------------------------------------------


def check_whitening(rows, got, dims, k=8):
    kept = [(i, v) for i, v in rows if sound(v)]
    x = np.array([[*whole(v, 1024), *[0] * (dims - len(v))] for _, v in kept], object) + 100_000
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s).astype(float) / n
    v = c.T @ c / n
    e, w = np.linalg.eigh(v)
    e, w = e[::-1][:k], w[:, ::-1][:, :k]
    by = {}
    for r in got:
        by.setdefault((r.vec_id is None, r.vec_id), {}).setdefault(r.component, []).append(r)
    assert len(got) == n * min(k, dims) and all(r.n == n for r in got)
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(int(d) for d in ((n * x - s) ** 2).sum(axis=1))
    for j in range(min(k, dims)):
        mine = [r for r in got if r.component == j + 1]
        assert all(abs(r.explained - e[j] / v.trace()) <= 1e-10 for r in mine)
        if e[j] > 1e-9 * e[0]:
            want = c @ w[:, j] / np.sqrt(e[j])
            ids = [i for i, _ in kept]
            if len(set(ids)) == n:
                at = {r.vec_id: r.whitened for r in mine}
                have = np.array([at[i] for i in ids])
                alone = min(abs(e[j] - o) for m, o in enumerate(np.linalg.eigvalsh(v)[::-1]) if m != j) if dims > 1 else e[0]
                if alone > 1e-3 * e[0]:
                    assert np.abs(have - want * np.sign(have @ want)).max() < 1e-7
        else:
            assert all(r.whitened is None for r in mine)
    real = [j for j in range(min(k, dims)) if e[j] > 1e-9 * e[0]]
    assert all(r.identity_error < 1e-9 for r in got) and real


def test_whitening_equals_a_dense_solver(spark):
    rows = crowd(400, 20, 3) + [(None, [1.0] * 20), (5000, [1.0] * 18), *odd(20)[:4]]
    got = whitening.whiten(frame(spark, rows))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check_whitening(rows, got.collect(), 20)


@pytest.mark.parametrize("dims", [1, 3, 8, 9])
def test_whitening_of_few_dimensions_and_little_rank(spark, dims):
    rows = crowd(60, dims, dims)
    check_whitening(rows, whitening.whiten(frame(spark, rows)).collect(), dims)
    flat = [(i, [float(i % 2), *[0.5] * (dims - 1)]) for i in range(10)]
    check_whitening(flat, whitening.whiten(frame(spark, flat)).collect(), dims)


def test_whitening_of_equal_vectors_and_of_none(spark):
    got = whitening.whiten(frame(spark, [(1, [0.5, 0.25]), (1, [0.5, 0.25])])).collect()
    assert len(got) == 4 and all(r.whitened is None and r.explained is None and r.deviation == 0 for r in got)
    assert whitening.whiten(frame(spark, [])).count() == 0 and whitening.whiten(frame(spark, odd(3)[:4])).count() == 0


def test_equal_and_close_eigenvalues(spark):
    rng = np.random.default_rng(8)
    basis = np.linalg.qr(rng.standard_normal((12, 12)))[0]
    for values in ([5.0] * 12, [9, 9, 9, 9, 9, 9, 9, 9, 9, 1, 1, 0], [8, 7.9999999, 3, 3, 3, 2.5, 2.4, 2.3, 2.2, 2.1, 2.0, 0]):
        v = (basis * np.array(values)) @ basis.T
        v = (v + v.T) / 2
        e, w = whitening.leading(spark, v, 8)
        assert np.allclose(e, sorted(values, reverse=True)[:8], rtol=1e-12, atol=1e-12)
        assert np.abs(w.T @ w - np.eye(8)).max() < 1e-7 and np.abs(v @ w - w * e).max() < 1e-12


def test_inertia_counts(spark):
    rng = np.random.default_rng(2)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    e = np.linalg.eigvalsh(a)
    diag, off = whitening.tridiagonal(a)
    for shift in rng.uniform(-12, 12, 50):
        assert whitening.above(diag, off, shift) == (e > shift).sum()


# --- clustering ----------------------------------------------------------------------------------


def brute_lloyd(rows, k, rounds, dims):
    x = [(i, whole(v, 64)) for i, v in rows if v is not None and len(v) == dims and sound(v)]
    far = "g"
    c = [v for _, v in sorted(((hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else far, v) for i, v in x))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))

    for _ in range(rounds):
        to = [nearest(v)[1] for _, v in x]
        for j in range(len(c)):
            own = [v for (_, v), t in zip(x, to, strict=True) if t == j]
            if own:
                c[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    at = [(i, *nearest(v)) for i, v in x]
    inertia = {j: sum(d for _, d, t in at if t == j) for j in range(len(c))}
    names = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(((i, t, d, inertia[t], sum(inertia.values()), names[t]) for i, d, t in at), key=str)


@pytest.mark.parametrize("dims,k", [(64, 16), (20, 5), (3, 16)])
def test_lloyd_equals_brute_force(spark, dims, k):
    rows = crowd(300, dims, dims) + [(None, [1.0] * dims), *odd(dims), (950, [1.0] * (dims + 1))]
    rows += [(7, rows[7][1]), (7, rows[8][1])] + [(1000 + i, rows[3][1]) for i in range(150)]
    random.Random(2).shuffle(rows)
    got = lloyd.cluster(frame(spark, rows), k=k, dims=dims)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_lloyd(rows, k, 3, dims)


def test_lloyd_of_few_and_of_none(spark):
    rows = crowd(5, 64, 1)
    assert sorted((tuple(r) for r in lloyd.cluster(frame(spark, rows)).collect()), key=str) == brute_lloyd(rows, 16, 3, 64)
    assert lloyd.cluster(frame(spark, [])).count() == 0 and lloyd.cluster(frame(spark, odd(64))).count() == 0
    nameless = [(None, v) for _, v in rows]
    assert sorted((tuple(r) for r in lloyd.cluster(frame(spark, nameless)).collect()), key=str) == brute_lloyd(nameless, 16, 3, 64)


def test_starts_come_from_all_rows(spark):
    rows = crowd(3000, 4, 5)
    x = lloyd.kept(frame(spark, rows), "vec_id", "embedding", 64, 4)
    want = [whole(v, 64) for _, v in sorted(rows, key=lambda r: hashlib.sha256(f"1:{r[0]}".encode()).hexdigest())[:16]]
    assert lloyd.starts(x, 16).tolist() == want


def test_components_beyond_the_limit_count_as_it(spark):
    rows = [(0, [1e30, -1e30, 1.0]), (1, [1.0, 2.0, 3.0]), (2, [1e30, 1e30, 1.0])]
    got = {r.vec_id: r for r in lloyd.cluster(frame(spark, rows), k=2, dims=3).collect()}
    assert len(got) == 3 and all(r.distance >= 0 for r in got.values())
