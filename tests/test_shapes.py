import numpy as np
import pytest

import __spark_entry__ as e
from civlake.operators import spatial


@pytest.mark.parametrize("name", ["polygon_overlap", "trail_buffers", "within_distance", "near_tracts", "point_in_shape"])
def test_shapes_that_rows_share_are_compared_once(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    d = str(tmp_path)
    # places of 30 and tracts of 2,650 boxes, each box three and two times
    spark.range(90).selectExpr("id % 30 + 48985 * floor(id / 30) AS s_suppkey").write.parquet(f"{d}/supplier.parquet")
    spark.range(5300).toDF("c_custkey").write.parquet(f"{d}/customer.parquet")
    df = e.queries()[name](spark, d)
    above, _, below = df._jdf.queryExecution().optimizedPlan().toString().partition("ArrowEvalPython")
    assert "Aggregate" in below and "Aggregate" not in above
    c = duckdb.connect()
    for t in ("supplier", "customer"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    want = c.execute(f"SELECT {', '.join(df.columns)} FROM ({e.oracle_sql()[name]})").fetchall()
    got = sorted(map(tuple, df.collect()))
    assert len(got) > 100 and got == sorted(want)


def test_many_rings_at_once_as_one_by_one():
    rng = np.random.default_rng(1)

    def stars(n, far):
        at, r = np.sort(rng.uniform(0, 2 * np.pi, (100, n)), axis=1), rng.uniform(0.3, 1, (100, n)) * far
        return np.stack([r * np.cos(at), r * np.sin(at)], axis=2) + rng.uniform(0, 4, (100, 1, 2))

    for m, k in ((6, 4), (4, 6), (3, 3), (5, 5)):
        a, b = stars(m, 2), stars(k, 2)
        b[::3] = b[::3, ::-1]
        assert np.allclose(spatial.shared_areas(a, b), [spatial.shared_area(x, y) for x, y in zip(a, b)], atol=1e-12)
        for closed in (True, False):
            assert np.array_equal(spatial.ring_distances(a, b, closed), [spatial.ring_distance(x, y, closed) for x, y in zip(a, b)])
        assert np.array_equal(spatial.contain_points(a, b[:, 0, 0], b[:, 0, 1]), [spatial.contains_point(x[:, 0], x[:, 1], *y[0]) for x, y in zip(a, b)])
        assert np.array_equal(spatial.segment_distances(b[:, :1], a), [spatial.segment_distance(*y[0], x) for x, y in zip(a, b)])
