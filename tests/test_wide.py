from datetime import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from civlake.operators import wide as w

S = "table_id string, year int, geo_level string, geo_id string, variable_id string, estimate double, annotation string, loaded_at timestamp, entity string"


def row(geo, var, est, ann=None, day=1, level="tract", tid="T", year=2020):
    return (tid, year, level, geo, var, est, ann, dt(2020, 1, day) if day else None, "x")


ROWS = [
    row("1001012501", "T_001E", 5.0),
    row("01001012501", " t_001e ", 7.0, day=3),
    row("01001012501", "T_001E", 6.0, day=2),
    row("01001012501", "T_002E", -666666666.0, " $1,250.5+ "),
    row("01001012501", "T_002E", 1250.5, day=9),
    row("01001012501", "T_003E", None, "(X)"),
    row("1", "T_001E", 2.5, level="state"),
    row("1", "T_001E", 2.5, level="state"),
    row(None, "T_001E", 1.0),
    row("01001012502", None, 1.0),
    row("01001012503", "T_001E", 1.0, day=None),
    row("01001012503", "T_001E", 9.0, day=1),
    row("01001012504", "T_001E", 3.0),
    row("01001012504", "T_001E", 4.0),
]


def test_conflicts_last_values_and_types(spark):
    c = w.cells(spark.createDataFrame(ROWS, S))
    got = {(r.geo_id, r.variable_id): r.last_value for r in c.collect()}
    assert got == {("01001012501", "T_001E"): 7.0, ("01001012501", "T_002E"): 1250.5, ("01", "T_001E"): 2.5, ("01001012503", "T_001E"): 9.0, ("01001012504", "T_001E"): 4.0}
    assert sorted(r.geo_id for r in w.scatter_conflicts(spark.createDataFrame(ROWS, S)).collect()) == ["01001012501", "01001012503", "01001012504"]
    t = w.wide_table(spark.createDataFrame(ROWS, S), "T")
    assert dict(t.dtypes)["T_001E"] == "double" and dict(t.dtypes)["T_002E"] == "double"
    assert {r.geo_id: (r.n_cells, r["T_001E"], r["T_002E"]) for r in t.collect()}["01001012501"] == (2, 7.0, 1250.5)


def test_empty(spark):
    e = spark.createDataFrame([], S)
    assert w.wide_table(e, "T").count() == 0 and w.scatter_conflicts(e).count() == 0 and w.scatter_wide(e, w.attribute_places(e)).count() == 0


@pytest.mark.parametrize("text,value", [("1,234", 1234.0), ("$12", 12.0), (" 7 % ", 7.0), ("100+", 100.0), ("(X)", None), ("", None), ("1d", None), ("-3.5", -3.5), ("nan", None), ("1e3", 1000.0)])
def test_text_numbers(spark, text, value):
    assert spark.range(1).select(w.text_number(F.lit(text))).first()[0] == value


def test_small_blocks_never_split_an_entity(spark, monkeypatch):
    monkeypatch.setattr(w, "BLOCK_CELLS", 3)
    rows = [row(f"0100101{g:04d}", f"T_{v:03d}E", float(v)) for g in range(40) for v in range(5)]
    t = w.wide_table(spark.createDataFrame(rows, S), "T")
    assert t.count() == 40 and dict(t.dtypes)["T_000E"] == "bigint" and {r.n_cells for r in t.collect()} == {5}


def test_attributes_of_equal_endings_and_reserved_names_keep_their_values(spark):
    v = spark.createDataFrame([row("01001012501", x, float(i)) for i, x in enumerate(["A_001E", "B_001E", "YEAR", "geo_id", "n_cells", "WHOLE_0"])], S)
    r = w.wide_table(v, "T").first()
    assert (r["A_001E"], r["B_001E"], r["_YEAR"], r["_GEO_ID"], r["_N_CELLS"], r["WHOLE_0"], r["n_cells"]) == (0, 1, 2, 3, 4, 5, 6)


@pytest.mark.parametrize("few", [0, 500_000])
def test_many_attributes_of_many_tables(spark, monkeypatch, few):
    monkeypatch.setattr(w, "BROADCAST_PLACES", few)
    rows = [row("01001012501", f"V{k:04d}", float(k), tid="wide") for k in range(6000)] + [row("1", f"x{k}", k + 0.5, level="state", tid=f"t{k}") for k in range(50)] + [row("2", "x", 1.0, level="state", tid=None)]
    v = spark.createDataFrame(rows, S)
    places = w.attribute_places(v)
    wide = w.scatter_wide(v, places)
    assert len(wide.columns) == 4 + 6000 + 1 and wide.count() == 52
    back = {tuple(r) for r in w.melted(wide, places).collect()}
    assert back == {tuple(r) for r in w.cells(v).select(*w.CELL, "last_value").collect()} and len(back) == 6051


def test_a_hot_entity_and_hot_cell_are_folded(spark, monkeypatch):
    monkeypatch.setattr(w, "BLOCK_CELLS", 10)
    v = spark.createDataFrame([row("1", f"v{k % 3}", float(k), level="state", day=1 + k % 28) for k in range(300)], S).repartition(7)
    assert w.scatter_conflicts(v).count() == 3
    assert {r.variable_id: r.last_value for r in w.melted(w.scatter_wide(v, w.attribute_places(v)), w.attribute_places(v)).collect()} == {r.variable_id: r.last_value for r in w.cells(v).collect()}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 4), st.integers(0, 9)), min_size=1, max_size=40, unique_by=lambda x: x[:2]))
def test_unpivoting_the_wide_table_gives_the_cells_back(spark, cells):
    rows = [row(f"{g:011d}", f"T_{v}E", float(x)) for g, v, x in cells]
    t = w.wide_table(spark.createDataFrame(rows, S), "T")
    back = {(r.geo_id, c): r[c] for r in t.collect() for c in t.columns if c.startswith("T_") and r[c] is not None}
    assert back == {(f"{g:011d}", f"T_{v}E"): x for g, v, x in cells}
