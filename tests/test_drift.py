from datetime import datetime as dt
from itertools import permutations

import numpy as np

from civlake.operators import drift as g

S = "var_row_id bigint, table_id string, dataset string, year int, variable_id string, label_natural string, predicate_type string, loaded_at timestamp, said string"


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, dt(2020, 1, 1 + i % 20), "x") for i, r in enumerate(rows)], S)


def V(year, var, label, kind="int", tid="T1"):
    return (tid, "d", year, var, label, kind)


ROWS = [
    V(2010, "A", "Number of homes: gas & heat"), V(2010, "B", "Pct of hh"), V(2010, "C", "Old thing"), V(2010, "D", "Text", "string"),
    V(2012, "A", "no of homes, GAS and heat (in 2012 inflation-adjusted dollars)", "INT64", " t1 "), V(2012, "B2", "Percent of households"), V(2012, "D", "Text", "float"), V(2012, "E", "New thing"),
    V(2013, "A", "Number of flats"), V(2013, "B2", "percent of households."), V(2013, "D", "Text", "double"), V(2013, "E", "new THING"), V(2013, "E", "new thing"),
    (None, "d", 2010, "X", "x", "int"), ("T2", "d", 2010, "Z", None, None), ("T2", "d", 2011, "Z", None, None), ("T3", "d", 2011, "Z", "z", "int"),
]


def test_changes(spark):
    got = sorted((r.year, r.variable_id, r.change, r.old_id) for r in g.schema_changes(frame(spark, ROWS)).collect())
    assert got == [(2012, "B2", "renamed", "B"), (2012, "C", "removed", None), (2012, "D", "retyped", None), (2012, "E", "added", None), (2013, "A", "relabelled", None)]


def test_unified_follows_renames(spark):
    rows = [V(y, f"N{y}", "Same label") for y in range(2010, 2019)]
    u = g.unified_columns(frame(spark, rows)).collect()
    assert len(u) == 9 and {r.unified_id for r in u} == {"N2018"}


def test_equal_labels_are_assigned_by_name(spark):
    rows = [V(2010, "X_001", "l"), V(2010, "Y_002", "l"), V(2011, "X_001EA", "l"), V(2011, "Y_002EA", "l"), V(2011, "Z", "l")]
    got = {r.variable_id: (r.change, r.old_id) for r in g.schema_changes(frame(spark, rows)).collect()}
    assert got == {"X_001EA": ("renamed", "X_001"), "Y_002EA": ("renamed", "Y_002"), "Z": ("renamed", None)}


def test_a_large_group_of_equal_labels_is_assigned_as_a_small_one(spark):
    rows = [V(2010, f"a{i:03d}x", "l") for i in range(120)] + [V(2011, f"a{i:03d}y", "l") for i in range(121)]
    got = {r.variable_id: r.old_id for r in g.schema_changes(frame(spark, rows)).collect()}
    assert len(got) == 121 and sum(x is None for x in got.values()) == 1 and sum(v is not None and k[:4] == v[:4] for k, v in got.items()) >= 119


def test_the_assignment_decides_what_is_renamed(spark, monkeypatch):
    rows = [V(2010, "X_1", "one"), V(2011, "X_9", "one")]
    ids = g._placed(g.profiles(frame(spark, rows)))
    group = g.matched_columns(ids, None)
    assert [(r.variable_id, r.old_id, r.matched_by) for r in group.where("side = 'new'").collect()] == [("X_9", "X_1", "label")]
    monkeypatch.setattr(g, "assignment", lambda cost: [])
    pdf = g.pd.DataFrame({"tkey": "t", "dataset": "d", "table_id": "T", "year": 2011, "v": 2, "said": "one", "words": "one", "kind": "integer", "variable_id": ["X_9", "X_1"], "side": ["new", "old"], "centre": [None, None], "spread": [None, None]})
    assert g._match(pdf)["matched_by"].isna().all()


def test_a_reworded_label_is_likely_the_same_column(spark):
    rows = [V(2010, "S_001", "Median gross rent of renter homes"), V(2010, "S_002", "Workers by bus"), V(2011, "S_001EA", "Median rent of renter homes"), V(2011, "S_077", "Something else")]
    got = {r.variable_id: (r.change, r.likely_from) for r in g.schema_changes(frame(spark, rows)).collect()}
    assert got == {"S_001EA": ("added", "S_001"), "S_077": ("added", None), "S_001": ("removed", None), "S_002": ("removed", None)}
    u = {r.variable_id: (r.unified_id, r.next_by) for r in g.unified_columns(frame(spark, rows)).collect()}
    assert u["S_001"] == ("S_001EA", "profile") and u["S_002"] == ("S_002", None)


def test_empty(spark):
    assert g.schema_changes(frame(spark, [])).count() == 0 and g.unified_columns(frame(spark, [])).count() == 0


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (3, 3), (3, 5), (4, 6)):
        c = rng.random((n, m))
        best = min(sum(c[i, p[i]] for i in range(n)) for p in permutations(range(m), n))
        assert abs(sum(c[i, j] for i, j in g.assignment(c)) - best) < 1e-9
