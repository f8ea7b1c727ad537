import numpy as np

from civlake.operators import spatial


def test_roads_of_all_places(spark, tmp_path):
    d = str(tmp_path)
    spark.range(1, 41).toDF("s_suppkey").write.parquet(f"{d}/supplier.parquet")
    spark.range(1, 901).toDF("c_custkey").write.parquet(f"{d}/customer.parquet")
    brute = set()
    for a in range(1, 41):
        x, y, w = a * 7 % 101, a * 13 % 97, a % 5 + 1
        for b in range(1, 901):
            px, py = b % 53 * 2 + 1, b // 53 % 50 * 2 + 1
            t = min(1, max(0, ((px - x) + (py - y)) / (2 * w)))
            if round(float(np.hypot(px - x - t * w, py - y - t * w)), 6) <= 1.5:
                brute.add((a, b))
    got = [(r.a, r.b) for r in spatial.within_distance(spark, d).collect()]
    assert len(got) == len(set(got)) and set(got) == brute and {a % 3 for a, _ in got} == {0, 1, 2}


def test_shared_area_and_distance_of_any_shape():
    rng = np.random.default_rng(5)
    ell = np.array([(0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4)], dtype=float)
    star = np.array([(1, 1), (6, 1.5), (2.5, 2.5), (1.5, 6)], dtype=float)
    pts = rng.uniform(-1, 7, (200_000, 2))
    inside = lambda r: np.array([((r[:, 1] > y) != (np.roll(r[:, 1], -1) > y)) & (x < r[:, 0] + (y - r[:, 1]) / (np.roll(r[:, 1], -1) - r[:, 1]) * (np.roll(r[:, 0], -1) - r[:, 0])) for x, y in pts[:20_000]]).sum(axis=1) % 2
    with np.errstate(all="ignore"):
        for a, b in ((ell, star), (star, ell), (ell[::-1], star)):
            want = (inside(a) & inside(b)).mean() * 64
            assert abs(spatial.shared_area(a, b) - want) < 0.15
    assert abs(spatial.shared_area(ell, ell) - 12) < 1e-9
    assert spatial.ring_distance(ell, ell + 10) > 0
    assert spatial.ring_distance(ell, ell + (5, 0)) == 1.0 and spatial.ring_distance(ell, star) == 0.0
