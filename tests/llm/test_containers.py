from collections import defaultdict

import numpy as np

from civlake.llm import containers as c

S = "doc_id bigint, n_tokens int, capacity string"


def check(rows, sizes, caps=c.CAPACITIES):
    docs, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append((r.piece, r.first_token, r.n_tokens))
        bins[r.container_id].append(r)
    for i, n in sizes:
        p = sorted(docs[i])
        assert sum(x[2] for x in p) == n and [x[1] for x in p] == [k * max(caps) for k in range(len(p))]
        assert len(p) == max(1, -(-n // max(caps)))
    for b in bins.values():
        filled = sum(r.n_tokens for r in b)
        assert {r.filled for r in b} == {filled} and {r.capacity for r in b} == {min(k for k in caps if k >= filled)}
    return bins


def test_every_text_is_packed_whole(spark, monkeypatch):
    rng = np.random.default_rng(2)
    sizes = [(i, int(n)) for i, n in enumerate(np.concatenate([rng.integers(0, 900, 1500), rng.integers(2000, 9000, 30), [0, 0, 2048, 2049]]))]
    bins = check(c.fill_containers(spark.createDataFrame([(*s, "x") for s in sizes], S), bucket_pieces=400).collect(), sizes)
    total = sum(n for _, n in sizes)
    assert sum(b[0].capacity for b in bins.values()) <= total * 1.02 + 4096


def test_empty_and_null(spark):
    assert c.fill_containers(spark.createDataFrame([], S)).count() == 0
    rows = c.fill_containers(spark.createDataFrame([(1, 0, "x"), (None, 5, "x"), (2, 10, "x")], S)).collect()
    assert {r.doc_id for r in rows} == {1, 2} and {r.capacity for r in rows} == {256}


def test_best_fit_takes_the_sum_that_fills():
    where, caps = c.best_fit(np.array([900, 1500, 500, 120, 48]), (1024, 2048))
    assert where[1] == where[2] == where[4] and where[0] == where[3] and sorted(caps) == [1024, 2048]


def test_capacities_are_chosen_jointly():
    rng = np.random.default_rng(4)
    for sizes, long in ((np.concatenate([rng.integers(300, 501, 2000), rng.integers(500, 513, 300)]), c.LONG), (rng.integers(300, 501, 3000), 20_000)):
        where, caps = c.cheapest_mix(sizes, c.CAPACITIES, long)
        filled = np.bincount(where, weights=sizes)
        cost = sum(c.OPEN_COST + k + k * k / long for k in caps.tolist())
        assert (filled <= caps).all() and filled.sum() == sizes.sum()
        assert long == c.LONG or {512, 2048} <= set(caps.tolist()) and filled[caps == 512].sum() >= 0.95 * 512 * (caps == 512).sum()
        one, only = c.best_fit(sizes, (2048,), long)
        assert cost <= sum(c.OPEN_COST + k + k * k / long for k in only.tolist())


def test_pieces_without_tokens_and_one_size_only():
    assert (c.best_fit(np.zeros(3, dtype=np.int64), c.CAPACITIES)[0] == 0).all()
    where, caps = c.best_fit(np.full(1000, 256), c.CAPACITIES)
    assert len(caps) == 500 and set(caps.tolist()) == {512}  # two in one cost less than one in each


def test_tokens_of_whole_texts(spark):
    d = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "a b " * 5000)], "id bigint, body string")
    got = {r.doc_id: r.n_tokens for r in c.token_counts(d, "id", "body").collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] == 0 and got[4] >= 10000
