from datetime import datetime as dt

from civlake.operators import areas


def stat_values(spark, d):
    rows = []
    for var in ("B01_001", "B01_002", "B02_017E"):
        for year, f in ((2019, 1.0), (2020, 2.0)):
            rows += [("B01", year, "state", "01", var, 100.0 * f), ("B01", year, "county", "01001", var, 60.0 * f), ("B01", year, "county", "01003", var, 40.0 * f)]
    rows.append(("B01", 2020, "county", "02005", "B01_002", 7.0))
    s = spark.createDataFrame([(*r, None, dt(2024, 1, 1)) for r in rows], "table_id string, year int, geo_level string, geo_id string, variable_id string, estimate double, annotation string, loaded_at timestamp")
    s.write.parquet(f"{d}/stat_values.parquet")


def test_areas_take_every_variable(spark, tmp_path):
    d = str(tmp_path)
    stat_values(spark, d)
    of = lambda q: [tuple(r) for r in q.collect()]
    framed = of(areas.magnitude_framing(spark, d))
    assert len(framed) == 19 and ("B01", 2020, "01003", "B01_002", None, 0.4, "very_low", 2019, 1.0, "rising_strong") in framed
    flagged = of(areas.anomaly_flags(spark, d).groupBy("variable_id", "flag").count())
    assert set(flagged) == {(v, f, n) for v in ("B01_001", "B01_002", "B02_017E") for f, n in (("far_below_comparators", 4), ("trend_break_up", 3))}
    assert {(r[1], r[2]) for r in of(areas.trend_prior_period(spark, d))} == {(v, g) for v in ("B01_001", "B01_002", "B02_017E") for g in ("01", "01001", "01003")}
    assert len(of(areas.value_ranks(spark, d))) == 13
    assert ("02005", 0, "02") in of(areas.comparator_chain(spark, d))
