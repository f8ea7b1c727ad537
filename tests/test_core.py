from datetime import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from civlake.functions import normalize as n
from civlake.operators import areas, ingest, metadata, metrics, peers, predicates, resolve, search, spatial
from civlake.operators.predicates import RecordFilter


def one(spark, c):
    return spark.range(1).select(c).first()[0]


@pytest.mark.parametrize("text,value", [(None, None), ("", None), ("(X)", None), ("**", None), ("-666666666", None), (" 12345.6 ", 12345.6), ("1d", None), ("1_0", None), ("-5", -5.0)])
def test_cell_numbers(spark, text, value):
    assert one(spark, n.cell_number(F.lit(text).cast("string"))) == value


def test_ids_names_and_codes(spark):
    assert one(spark, n.stable_id("hmda", F.lit(" Income "))) == "c1aa5d4f3f72"
    assert one(spark, n.column_name(F.lit("1st Lien (USD)"))) == "v_1st_lien_usd"
    assert [one(spark, n.tract_code(F.lit(x))) for x in ("13", "123456789012", "a1")] == ["00000000013", None, None]
    assert one(spark, n.pad_left(F.lit("123"), 2)) == "123"
    assert one(spark, n.record_id("d", F.lit(2020), F.lit("f"), F.lit(7))) == "d:2020:f:000000000007"
    assert [one(spark, n.shown_number(F.lit(x))) for x in (3.0, 2.5, 1234567.5, 0.000012345, 0.25)] == ["3", "2.5", "1.23457e+06", "1.2345e-05", "0.25"]


ROWS = [("1", "White", 10.0), ("2", "black", 20.0), (None, "BLACK", None), ("3", None, 5.0)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "action string, race string, x double")


@pytest.mark.parametrize("f,count", [(RecordFilter("race", "equals", "black"), 2), (RecordFilter("race", "not_equals", "black"), 1), (RecordFilter("race", "in", ["WHITE", "black"]), 3), (RecordFilter("action", "not_in", ["1"]), 2), (RecordFilter("action", "is_null"), 1), (RecordFilter("race", "is_not_null"), 3)])
def test_predicates(rows, f, count):
    assert rows.where(predicates.predicate(f)).count() == count


def test_predicate_errors_and_shapes(rows):
    for bad in (RecordFilter("a b", "equals", 1), RecordFilter("race", "in", []), RecordFilter("race", "in", "x"), RecordFilter("race", "like", "x")):
        with pytest.raises(ValueError):
            predicates.predicate(bad)
    assert predicates.shaped("r", '["a", "b"]') == RecordFilter("r", "in", ["a", "b"])
    assert predicates.shaped("r", "a, b", "in") == RecordFilter("r", "in", ["a", "b"])
    assert predicates.shaped("r", "a", "not_in") == RecordFilter("r", "not_in", ["a"])
    assert predicates.is_ambiguous(RecordFilter("applicant_age", "equals", "Adult"))
    assert rows.where(predicates.numerator_flag([]) == 1).count() == 0


def test_prefixes_of_mixed_length(spark):
    df = spark.createDataFrame([("13121000100",), ("13089000100",), ("0112",), (None,)], "t string")
    assert predicates.with_prefixes(df, "t", ["13121", "01"]).count() == 2
    assert predicates.with_prefixes(df, "t", ["13121", "01"], inline=0).count() == 2
    assert predicates.with_prefixes(df, "t", []).count() == 4


def test_ratio_goldens(spark):
    r = lambda rows: metrics.ratio(spark.createDataFrame([("k", *x) for x in rows], "k string, a double, b double, d double"), ["k"], ["a", "b"], "d").first()
    x = r([(100.0, None, 1000.0), (200.0, None, 1000.0)])
    assert (x.ratio, x.denominator, x.rows_used) == (0.15, 2000.0, 2)
    assert r([(100.0, 30.0, 1000.0), (200.0, None, 1000.0)]).ratio == 0.165
    x = r([(100.0, None, 0.0), (None, None, 50.0), (5.0, None, None)])
    assert (x.ratio, x.denominator, x.rows_used) == (None, 0.0, 0)


def test_area_value_components_and_weights(spark):
    df = spark.createDataFrame([("k", 100000.0, 1, 300.0), ("k", 60000.0, 2, None), ("k", None, 0, 5.0)], "k string, v double, o int, w double")
    x = metrics.area_value(df, ["k"], "v", "o", F.lit(True)).first()
    assert (x.value, x.rows_used, x.caveat) == (80000.0, 2, metrics.MEAN_CAVEAT)
    x = metrics.area_value(df, ["k"], "v", "o", F.lit(False)).first()
    assert (x.value, x.rows_used, x.caveat) == (100000.0, 1, None)
    x = metrics.components(df, ["k"], ["v", "w"]).first()
    assert (x.v, x.w, x.rows_used) == (160000.0, 305.0, 3)
    assert metrics.weighted_mean(df, ["k"], "v", "w").first().value == 100000.0
    assert metrics.share_of_both(spark.createDataFrame([("k", 1.0, 0.0)], "k string, a double, b double"), ["k"], "a", "b").first().ratio is None


def test_metric_spec(spark):
    with pytest.raises(ValueError):
        metrics.MetricSpec("distribution")
    with pytest.raises(ValueError):
        metrics.MetricSpec("percentage")
    s = metrics.MetricSpec("sum", "x", (RecordFilter("race", "equals", "a"),), group_by=("race",))
    assert s.columns() == ["x", "race"]
    assert [metrics.operation_of(t) for t in ("the denial rate", "mean income", "median rent", "how many loans", "rent")] == ["percentage", "average", "median", "count", "value"]
    df = spark.createDataFrame([(2020, "1", "10"), (2020, "3", "NA"), (2021, "3", "30")], "activity_year int, action string, x string").withColumn("census_tract", F.lit("1"))
    got = {r.year: (r.value, r.denominator) for r in metrics.metric(df, metrics.MetricSpec("percentage", numerator=(RecordFilter("action", "equals", "3"),))).collect()}
    assert got == {2020: (0.5, 2), 2021: (1.0, 1)}
    assert [r.value for r in metrics.metric(df, metrics.MetricSpec("sum", "x", years=(2020,))).collect()] == [10.0]
    groups = metrics.metric(df, metrics.MetricSpec("count", group_by=("action",))).agg(F.sum("value")).first()[0]
    assert groups == df.count()


def test_pivot_of_variable_rows_is_the_records(spark):
    df = spark.createDataFrame([("a", "1", None), ("b", None, "y")], "id string, p string, q string")
    back = metrics.pivot_variables(metrics.variable_rows(df, "id", ["p", "q"]), ["p", "q"])
    assert sorted(tuple(r) for r in back.collect()) == [("a", "1", None), ("b", None, "y")]


def test_framing_and_flags(spark):
    v = spark.createDataFrame([("T", "v", y, g, x) for y, g, x in ((2020, "01001000100", 150.0), (2020, "01001", 100.0), (2020, "01", 300.0), (2019, "01001000100", 100.0), (2020, "02", 0.0))], "table_id string, variable_id string, year int, geo_id string, value double")
    f = areas.framed(v)
    r = f.where("geo_id = '01001000100' AND year = 2020").first()
    assert (r.vs_county, r.vs_state, r.prior_year, r.change_pct, r.trend) == (1.5, 0.5, 2019, 0.5, "rising_strong")
    assert sorted((x.flag, x.against) for x in areas.flags(f).where("geo_id = '01001000100'").collect()) == [("far_below_comparators", "state"), ("trend_break_up", None)]
    labels = [one(spark, n.when_chain(F.lit(x), areas.FRAMES, areas.TOP_FRAME)) for x in (0.59, 0.60, 1.0, 1.15, 1.80)]
    assert labels == ["very_low", "low", "typical", "elevated", "very_high"]


def test_years(spark):
    ys = F.array(F.lit(2012), F.lit(2016))
    assert [one(spark, areas.as_of(ys, F.lit(t))) for t in (2015, 2016, 2010)] == [2012, 2016, 2012]
    assert resolve.picked_years([2018, 2020, 2021], "change", 2021) == [2020, 2021]
    assert resolve.picked_years([2010, 2020], "change") == [2020]
    assert resolve.picked_years([2015, 2016], "latest", 2010) == [2015]
    assert resolve.picked_years(list(range(2010, 2020)), "trend") == [2015, 2016, 2017, 2018, 2019]


def test_set_operations_and_directions(spark):
    a = spark.createDataFrame([("p", "t1", 2), ("p", "t2", 1), ("p", None, 3)], "p string, t string, o int")
    b = spark.createDataFrame([("t1",), ("t1",)], "t string")
    assert [r.t for r in areas.intersected(a, b, [], "t").collect()] == ["t1"]
    assert {r.t for r in areas.subtracted(a, b, [], "t").collect()} == {"t2", None}
    pts = spark.createDataFrame([(1.0, 1.0), (0.0, 5.0), (2.0, 0.0)], "lat double, lon double")
    assert areas.in_direction(pts, "lat", "lon", (0.0, 0.0), "ne").count() == 1
    with pytest.raises(ValueError):
        areas.in_direction(pts, "lat", "lon", (0.0, 0.0), "x")


def test_division(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y"), ("b", "x")], "k string, i string")
    assert [r.k for r in metadata.divided(df, ["k"], "i", ["x", "y"]).collect()] == ["a"]
    assert metadata.divided(df, ["k"], "i", []).count() == 2


def test_decode_and_split(spark):
    book = spark.createDataFrame([("a", "1", "One", 2004, 2010), ("a", "1", "Uno", 2011, 9999)], "field string, code string, label string, year_start int, year_end int")
    df = spark.createDataFrame([("1", 2005), ("1", 2015), ("999", 2005), ("", 2005), (None, 2005)], "a string, y int")
    assert [r.a for r in ingest.decoded(df, "a", book, "y").collect()] == ["One", "Uno", "999", "", None]
    with pytest.raises(ValueError):
        ingest.active_codes(book.union(book.where("label = 'One'").withColumn("label", F.lit("I"))), 2005)
    v, s = ingest.number_and_status(F.col("a"))
    d = spark.createDataFrame([("6.25",), ("NA",), ("Exempt",), ("",), ("odd",)], "a string").select(v.alias("v"), s.alias("s"))
    assert [tuple(r) for r in d.collect()] == [(6.25, None), (None, "Not applicable"), (None, "Exempt"), (None, None), (None, "unknown")]


def test_upsert_and_registry(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "k int, v string")
    assert sorted(tuple(r) for r in ingest.upserted(old, new, ["k"], ["v"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(tuple(r) for r in ingest.kept_first(old, new, ["k"], ["v"]).collect()) == [(1, "a"), (2, "b"), (3, "d")]
    o, m = spark.createDataFrame([("x", "n1"), ("y", "n2")], "variable_id string, source_name string"), spark.createDataFrame([("x", "n1"), ("y", "zz"), ("w", "q")], "variable_id string, source_name string")
    assert {r.variable_id: r.state for r in ingest.merged_registry(o, m).collect()} == {"x": "kept", "y": "collision", "w": "added"}


def test_search_scores_and_nearest(spark):
    docs = spark.createDataFrame([("1", "gross rent paid"), ("2", "rent"), ("3", None), ("4", "")], "d string, t string")
    stats = docs.where("t IS NOT NULL").agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(search.tokens(F.col("t")))).alias("avg_dl"))
    got = {(r.q, r.doc) for r in search.bm25(search.inverted_index(docs.where("t IS NOT NULL"), "d", "t"), stats, [("a", "rent gro"), ("b", "re"), ("c", "")]).collect()}
    assert got == {("a", "1"), ("b", "1"), ("b", "2")}
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 8))
    v = spark.createDataFrame([(i, [float(z) for z in r]) for i, r in enumerate(x)] + [(100, None), (101, [0.0] * 8), (102, [1.0])], "id bigint, v array<double>")
    near = search.exact_nearest(v.where("id < 5"), v, 4).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(5):
        s = u @ u[q]
        s[q] = -2
        assert [r.id for r in sorted((r for r in near if r.q == q), key=lambda r: r.rank)] == list(np.argsort(-s)[:4])


def test_peers_leave_the_anchor_out(spark):
    rows = [(i, i % 2, 0, 0, 100 if i < 6 else 90_000, {"a": float(i), "b": float(i * i)}) for i in range(8)]
    df = spark.createDataFrame(rows, "id bigint, state int, division int, region int, population bigint, features map<string,double>")
    got = peers.peers(df, df.where("id = 2"), {"ab": ["a", "b"]}, 3, least=2).collect()
    assert [r.rank for r in got] == [1, 2, 3] and 2 not in {r.id for r in got} and all(r.id < 6 for r in got)
    again = peers.peers(df.orderBy(F.desc("id")), df.where("id = 2"), {"ab": ["a", "b"]}, 3, least=2).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert peers.peers(df, df.where("id = 2"), {"ab": ["a", "b"]}, 3).count() == 0
    own = peers.peers(df, df.where("id = 2"), {"ab": ["a", "b"]}, 5, least=2, within_state=True).collect()
    assert {r.id for r in own} == {0, 4} and {r.tier for r in own} == {"same_state"}
    made = peers.synthetic_anchor(spark, "west", 100, {"a": 2.0}, {"a", "b"}).withColumn("state", F.lit(None).cast("int")).withColumn("division", F.lit(None).cast("int")).withColumn("region", F.lit(None).cast("int"))
    assert {r.tier for r in peers.peers(df.withColumn("id", F.col("id").cast("string")), made, {"a": ["a"]}, 3, least=1).collect()} == {"nationwide"}
    with pytest.raises(ValueError):
        peers.synthetic_anchor(spark, "x", 1, {"zz": 1.0}, {"a"})


def test_geometry():
    sq = np.array([(0, 0), (4, 0), (4, 4), (0, 4)], dtype=float)
    tri = np.array([(2, 2), (6, 2), (2, 6)], dtype=float)
    assert spatial.ring_area(sq[:, 0], sq[:, 1]) == 16 and spatial.ring_centroid(sq[:, 0], sq[:, 1]) == (2, 2)
    c = spatial.clip_convex(sq, tri)
    assert abs(spatial.ring_area(c[:, 0], c[:, 1]) - 4.0) < 1e-9
    assert spatial.contains_point(sq[:, 0], sq[:, 1], 1, 1) and not spatial.contains_point(sq[:, 0], sq[:, 1], 5, 1)
    assert spatial.segment_distance(2, 3, np.array([(0, 0), (4, 0)], dtype=float)) == 3.0


def test_grid_join_has_each_pair_once(spark):
    rng = np.random.default_rng(3)
    box = lambda p: [(i, *map(float, (x, y, x + w, y + w))) for i, (x, y, w) in enumerate(np.c_[rng.uniform(-20, 20, (60, 2)), rng.uniform(0, 9, 60)])]
    a, b = box("a"), box("b")
    da = spark.createDataFrame(a, "a int, ax0 double, ay0 double, ax1 double, ay1 double")
    db = spark.createDataFrame(b, "b int, bx0 double, by0 double, bx1 double, by1 double")
    for grow in (0.0, 2.5):
        got = sorted((r.a, r.b) for r in spatial.grid_join(da, db, 3.0, grow).collect())
        want = sorted((p[0], q[0]) for p in a for q in b if p[1] - grow <= q[3] and q[1] <= p[3] + grow and p[2] - grow <= q[4] and q[2] <= p[4] + grow)
        assert got == want


def test_resolution(spark):
    names = spark.createDataFrame([("1", "Rome city", 100), ("2", "Rome County", 500), ("3", "Cityville", 5)], "id string, name string, population int")
    reg = resolve.aliases_of(names, "id", "name").join(names.select("id", "population"), "id")
    asked = spark.createDataFrame([("rome",), ("City of Rome",), ("nowhere",)], "asked string")
    got = {(r.asked, r.rank): r.id for r in resolve.resolved(asked, reg).collect()}
    assert got == {("rome", 1): "2", ("rome", 2): "1", ("City of Rome", 1): "1"}
    plan = resolve.calls(spark, ["01"], [2019, 2020], {"a": ["x", "y"]})
    assert {r.role for r in plan.collect()} == {"primary.group_a=x", "primary.group_a=y", "prior_period.group_a=x", "prior_period.group_a=y"}


def test_overlap_of_boxes_and_other_shapes(spark):
    rows = [([0.0, 0, 4, 0, 4, 4, 0, 4], [2.0, 2, 6, 2, 6, 6, 2, 6]), ([0.0, 0, 1, 0, 1, 1, 0, 1], [5.0, 5, 6, 5, 6, 6, 5, 6]), ([0.0, 0, 4, 0, 4, 4, 0, 4], [2.0, 2, 6, 2, 2, 6]), ([2.0, 0, 4, 2, 2, 4, 0, 2], [0.0, 0, 4, 0, 4, 4, 0, 4])]
    df = spark.createDataFrame([([float(x) for x in p], [float(x) for x in q]) for p, q in rows], "p array<double>, q array<double>")
    assert [round(r[0], 9) for r in df.select(spatial.overlap_area("p", "q")).collect()] == [4.0, 0.0, 4.0, 8.0]
