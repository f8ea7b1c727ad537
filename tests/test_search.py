import numpy as np

from civlake.operators import search


def test_routed_queries(spark, tmp_path):
    d = str(tmp_path)
    rng = np.random.default_rng(4)
    v = [(i, i, rng.normal(size=4).tolist()) for i in range(200)]
    spark.createDataFrame(v, "vec_id bigint, card_rowid bigint, embedding array<float>").write.parquet(f"{d}/universe_embeddings.parquet")
    cards = [(i, f"B{i % 3:05d}", 1.0, "positive", "topic", 2020, f"V{i}", "homes by sex" if i % 2 else "all homes", i % 5 == 0, 0) for i in range(200)]
    spark.createDataFrame([(*c[:8], int(c[8]), 0) for c in cards], "rowid bigint, target_table_id string, weight double, polarity string, card_type string, target_year int, target_variable_id string, text string, is_total int, is_commonly_queried int").write.parquet(f"{d}/cards.parquet")
    wanted = set(range(0, 200, 20))
    x = np.array([r[2] for r in v], dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    got = {(r.q, r.table_id): r.score for r in search.target_aggregate(spark, d).collect()}
    brute = {}
    for q in wanted:
        s = x @ x[q]
        s[q] = -2
        for i in np.argsort(-s)[:30]:
            brute[q, f"B{i % 3:05d}"] = brute.get((q, f"B{i % 3:05d}"), 0) + max(0, s[i])
    assert got.keys() == brute.keys() and all(abs(got[k] - brute[k]) < 1e-4 for k in brute)
    assert {r.q for r in search.routed_top(spark, d).collect()} == wanted == {r.q for r in search.universe_pick(spark, d).collect()}
    # the query's own card is the likest, unless a mark or a total decides otherwise
    pick = {r.q: r.variable_id for r in search.universe_pick(spark, d).collect()}
    assert sum(pick[q] == f"V{q}" for q in wanted) >= 5


def test_family_shares(spark):
    t = spark.createDataFrame([(x,) for x in ("B19013", "B19013A", "B19013PR", "S0701I", "DP02", "CP05", "C17002", "K200", "X1", "B1900123A")], "table_id string")
    got = {r[0]: round(r[1], 6) for r in t.select("table_id", search.family_weight(t.table_id)).collect()}
    assert got == {"B19013": 1.0, "B19013A": 0.3, "B19013PR": 0.0, "S0701I": 0.18, "DP02": 0.2, "CP05": 0.2, "C17002": 0.9, "K200": 0.4, "X1": 1.0, "B1900123A": 1.0}


def test_nearest_among_mixed_lengths(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [1.0, 0.0, 0.0]), (4, [0.9, 0.0, 0.1]), (5, [0.0, 1.0]), (6, [0.0, 0.0, 0.0]), (7, None)]
    v = spark.createDataFrame(rows, "id bigint, v array<double>")
    got = {(r.q, r.id) for r in search.exact_nearest(v, v, 1).collect()}
    assert got == {(1, 2), (2, 1), (3, 4), (4, 3), (5, 2)}


def test_snippets(spark):
    d = spark.createDataFrame([("one two three four five six Rented, seven eight",), ("Rent first",), ("nothing",), (None,)], "t string")
    got = [r[0] for r in d.select(search.snippet(d.t, ["rent"], 2)).collect()]
    assert got == ["... five six Rented, seven eight", "Rent first", None, None]
