import pytest
from pyspark.sql import functions as F

from civlake.operators import planning as p
from civlake.operators import resolve


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_calls_keep_their_order_and_say_what_failed(spark):
    calls = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "zz", "x"), (4, "a", None), (5, "a", "gone")], "call_id bigint, dataset string, key string")
    src = {"a": spark.createDataFrame([("x", 1), ("x", 2)], "key string, n int"), "b": spark.createDataFrame([("x", "t")], "key string, t string")}
    got = [(r.call_id, r.status, r.n, r.t) for r in p.call_results(calls, src).orderBy("position", "n").collect()]
    assert got == [(1, "ok", 1, None), (1, "ok", 2, None), (2, "ok", None, "t"), (3, "no_source", None, None), (4, "bad_request", None, None), (5, "empty", None, None)]
    assert p.call_results(calls.limit(0), src).count() == 0


def test_labels_levels_and_forms(spark):
    arr = lambda *x: F.array(*[F.lit(v) for v in x]) if x else F.array().cast("array<string>")
    assert one(spark, p.rate_label(arr("Application Denied"))) == "mortgage denial rate"
    assert one(spark, p.rate_label(arr("loan originated", " application approved but not accepted"))) == "mortgage approval rate"
    assert one(spark, p.rate_label(arr("loan originated"))) == "mortgage origination rate" and one(spark, p.rate_label(arr("x"))) is None
    assert one(spark, p.data_level(F.lit("county"), arr("1"))) == "tract" and one(spark, p.data_level(F.lit("region"), arr())) == "tract" and one(spark, p.data_level(F.lit("msa"), arr())) == "msa"
    assert [one(spark, p.short_population(F.lit(n))) for n in (999, 12_345, 2_500_000)] == ["999", "12k", "2.5M"]
    assert one(spark, p.shown(F.lit(1234.5), F.lit("currency"))) == "$1,235" and one(spark, p.shown(F.lit(12.34), F.lit("percentage"))) == "12.3%"
    assert one(spark, p.ordered_distinct(arr("b", "a", None, " ", "b"))) == ["b", "a"]


def test_merges(spark):
    have = spark.createDataFrame([("t", "Gross rent?")], "t string, c string")
    want = spark.createDataFrame([("t", "gross  RENT"), ("t", "income"), ("t", "Income!"), ("u", "gross rent")], "t string, c string")
    got = sorted((r.t, r.source) for r in p.merged_concepts(have, want, "t", "c").collect())
    assert got == [("t", "added"), ("t", "request"), ("u", "added")]
    a = spark.createDataFrame([("Trend",), ("odd",)], "name string")
    assert [r.name for r in p.recognised(a, ["trend"], "name").collect()] == ["Trend"]


@pytest.mark.parametrize("label,sought,score", [("Percent of homes", "percentage", 3), ("Total homes", "percentage", -3), ("Total homes", "count", 2), ("Percent", "count", -3), ("Median rent", "median", 4), ("Mean rent", "currency", 3), (None, "count", 0)])
def test_measure_scores(spark, label, sought, score):
    assert one(spark, F.coalesce(resolve.measure_score(F.lit(label).cast("string"), sought), F.lit(0))) == score


def test_variable_scores(spark):
    s = lambda label, total, depth, **kw: one(spark, resolve.variable_score(F.lit(label), F.lit(total), F.lit(depth), F.lit(0), **kw))
    assert s("Total homes", 1, 1, sought="count", total_likely=True) == 4.0
    assert s("Homes of Latino owners", 0, 3) == -14.0
    assert s("Veterans", 1, 1, total_likely=False, of_subgroup=True) == -6.5
    assert s("x", 0, 1, in_top_table=F.lit(True), rank=F.lit(2), routed=F.lit(9.0)) == 5.0 + 8 * 0.3 + 1.0
