from datetime import datetime as dt

from civlake.operators import orphans as o

R = "ref_table string, row_id bigint, key string, arrived_at timestamp, reason int"
P = "key string, valid_from timestamp, valid_to timestamp, arrived_at string"


def run(spark, refs, parents, **kw):
    r, p = spark.createDataFrame(refs, R), spark.createDataFrame(parents, P)
    return sorted((x.row_id, x.reason) for x in o.orphan_references(r, p, **kw).collect())


def day(n):
    return dt(2020, 1, n)


PARENTS = [("a", day(5), day(10), ""), ("a", day(20), None, ""), ("b", day(1), None, ""), (None, day(1), None, ""), ("b", day(1), None, "")]
REFS = [("t", 1, "a", day(4), 0), ("t", 2, "a", day(5), 0), ("t", 3, "a", day(10), 0), ("t", 4, "a", day(25), 0), ("t", 5, "zz", day(5), 0), ("t", 6, None, day(5), 0), ("t", 7, "b", None, 0), ("t", 5, "zz", day(5), 0), ("t", 8, "b", day(3), 0)]
WANT = [(1, "not_yet_there"), (3, "gone"), (5, "never_there"), (5, "never_there"), (7, "unknown_time")]


def test_reasons_nulls_repeats_and_clashing_columns(spark):
    assert run(spark, REFS, PARENTS) == WANT


def test_a_filter_that_lets_everything_through_changes_nothing(spark):
    assert run(spark, REFS, [*PARENTS, *[(f"k{i}", day(1), None, "") for i in range(2000)]], max_bits=1024) == WANT


def test_empty_sides(spark):
    assert run(spark, [], PARENTS) == []
    assert [x[1] for x in run(spark, REFS[:2], [])] == ["never_there"] * 2


def test_no_false_rejections(spark):
    p = spark.range(5000).selectExpr("cast(id as string) key")
    words, bits = o.bloom_filter(p, "key")
    marked = o.may_exist(spark.range(10000).selectExpr("cast(id as string) key"), "key", words, bits)
    assert marked.where("cast(key as int) < 5000 and not may_exist").count() == 0
    assert marked.where("cast(key as int) >= 5000 and may_exist").count() < 250


def test_hot_keys_are_salted(spark, monkeypatch):
    from civlake import runtime

    monkeypatch.setattr(runtime, "hot_keys", lambda df, key, least=0: ["a"])
    assert run(spark, REFS, PARENTS) == WANT
