import numpy as np
import pytest

import __spark_entry__ as e
from civlake.operators import peers

SF = "/root/testdata/sf0.001"


def brute(rows, anchors, axes, top_k, least):
    out = set()
    for a in anchors:
        pool = [r for r in rows if r[0] != a[0]]
        sd = {}
        for f in {f for fs in axes.values() for f in fs}:
            x = [r[5][f] for r in pool if f in r[5]]
            sd[f] = (np.std(x) if len(set(x)) > 1 else 0.0) or 1.0
        for axis, fs in axes.items():
            found = []
            for r in pool:
                z = [(r[5][f] - a[5][f]) / sd[f] for f in fs if f in r[5] and f in a[5]]
                if len(z) >= least:
                    near = 0.75 if r[1] == a[1] else 0.88 if r[2] == a[2] else 0.94 if r[3] == a[3] else 1.0
                    ratio = r[4] / a[4]
                    size = 0.95 if ratio >= 1.25 else 1.0 if ratio >= 0.8 else 1.03
                    found.append((round(float(np.sqrt(np.mean(np.square(z)))) * near * size, 6), r[0], len(z)))
            out |= {(a[0], axis, i, k + 1, d, n) for k, (d, i, n) in enumerate(sorted(found)[:top_k])}
    return out


def test_peers_of_all_anchors_meet_by_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, i % 5, i % 3, i % 2, 100 + i, {"a": float(rng.normal()), "same": 0.1, "odd": 1e9 if i == 4 else 0.1, "b": float(i % 4)}) for i in range(60)]
    for i in range(0, 60, 7):
        del rows[i][5]["a"]
    df = spark.createDataFrame(rows, "id bigint, state int, division int, region int, population bigint, features map<string,double>")
    axes = {"x": ["a", "same", "b"], "y": ["odd", "same"]}
    monkeypatch.setattr(peers, "BLOCK", 13)
    monkeypatch.setattr(peers, "ANCHORS", 4)
    got = peers.peers(df, df.where("id % 3 = 1"), axes, 5, least=2)
    assert "stddev_pop" not in got._jdf.queryExecution().toString()  # no row per pair of anchor and area
    found = {(r.anchor, r.axis, r.id, r["rank"], r.distance, r.n_features) for r in got.collect()}
    assert found == brute(rows, rows[1::3], axes, 5, 2)


@pytest.mark.parametrize("name", ["peer_axes", "peer_rank", "peer_scopes"])
def test_peer_queries_compute_areas_once(spark, name):
    duckdb = pytest.importorskip("duckdb")
    df = e.queries()[name](spark, SF)
    assert "lineitem" not in df._jdf.queryExecution().toString()
    c = duckdb.connect()
    for t in ("lineitem", "supplier", "nation"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.execute(f"SELECT {', '.join(df.columns)} FROM ({e.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)
