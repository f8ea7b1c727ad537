import numpy as np

from civlake.llm import neighbours as n

S = "vec_id bigint, embedding array<float>, key string, rank int"


def brute(vecs, k, least=None):
    use = {i: np.array(v, dtype=float) for i, v in vecs if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, a in use.items():
        c = sorted(((-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 6), j) for j, b in use.items() if j != i and len(a) == len(b)))
        out[i] = [j for s, j in c[:k] if least is None or -s >= least]
    return out


def sample(seed=1, m=300, d=16):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((m, d)) * rng.uniform(0.1, 20, (m, 1))
    x[m // 2 : m // 2 + 60] = x[:60] * 3 + 0.15 * np.linalg.norm(x[:60], axis=1, keepdims=True) * rng.standard_normal((60, d))
    return [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]


def frame(spark, vecs):
    return spark.createDataFrame([(i, v, "k", 1) for i, v in vecs], S)


def run(df, **kw):
    out = {}
    for r in sorted(n.nearest(df, "vec_id", "embedding", **kw).collect(), key=lambda r: (r.id, r.rank)):
        out.setdefault(r.id, []).append(r.neighbour)
    return out


def test_exact_with_all_lists(spark):
    v = sample()
    got, want = run(frame(spark, v), k=5, nprobe=1.0), brute(v, 5)
    assert np.mean([len(set(got[i]) & set(want[i])) / 5 for i in want]) > 0.98


def test_many_lists_find_close_vectors(spark, monkeypatch):
    monkeypatch.setattr(n, "LIST_ROWS", 30)
    monkeypatch.setattr(n, "BLOCK_ROWS", 20)
    v = sample(2)
    got, want = run(frame(spark, v), k=5, least=0.85), brute(v, 5, 0.85)
    found = sum(len(set(got.get(i, [])) & set(w)) for i, w in want.items())
    assert found >= 0.95 * sum(map(len, want.values())) > 50
    assert all(set(g) <= set(want[i]) for i, g in got.items())


def test_nulls_zeros_dimensions_and_copies(spark):
    v = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, [1.0, 2.0, 3.0]), *[(i, [3.0, 4.0]) for i in range(10, 19)], (20, [6.0, 8.0]), (21, [3.0, 4.1])]
    got = run(frame(spark, v), k=3)
    assert got[10] == [11, 12, 13] and got[13] == [10, 11, 12] and got[20] == [10, 11, 12] and got[21] == [10, 11, 12]
    assert set(got) == {*range(10, 19), 20, 21}


def test_query_set_and_empty(spark):
    from pyspark.sql import functions as F

    v = sample(4)
    got = run(frame(spark, v), k=5, queries=F.col("id") % 20 == 0, nprobe=1.0)
    assert set(got) == {i for i, _ in v if i % 20 == 0}
    assert n.nearest(frame(spark, []), "vec_id", "embedding").count() == 0


def test_scan_abandons_only_what_is_far():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x[:50] + 0.05 * rng.standard_normal((50, 64)).astype(np.float32)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    i, j, d = n.scan(q, x, np.full(50, 0.3, dtype=np.float32))
    true = {(a, b) for a, b in zip(*np.nonzero(2 - 2 * q @ x.T <= 0.3), strict=True)}
    assert true == set(zip(i.tolist(), j.tolist(), strict=True))
