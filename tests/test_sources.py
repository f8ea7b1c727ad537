import json
from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from civlake.sources import tables as s
from civlake.streaming import windows as w


def test_variable_tree_keeps_text_partitions_and_prunes(spark, tmp_path):
    root = str(tmp_path / "tree")
    df = spark.createDataFrame([("r1", "0012", "5", 2020), ("r2", None, "7", 2021)], "id string, v001234 string, e12 string, y int")
    s.write_variable_tree(df, root, "id", ["v001234", "e12"], "00123", F.col("y"))
    r = s.read_variable_tree(spark, root, ["v001234"], table_id="00123")
    assert [tuple(x) for x in r.select("record_id", "value", "year", "variable", "table_id").collect()] == [("r1", "0012", "2020", "v001234", "00123")]
    assert "PartitionFilters: [" in r._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        s.read_variable_tree(spark, root, ["../x"])


def test_files_by_suffix(spark, tmp_path):
    (tmp_path / "a.csv").write_text("code,name\n007,\n,x\n")
    assert [tuple(r) for r in s.read_file(spark, str(tmp_path / "a.csv")).collect()] == [("007", ""), ("", "x")]
    spark.range(3).write.parquet(str(tmp_path / "year=2020" / "b.parquet"))
    assert s.read_file(spark, str(tmp_path / "year=2020" / "b.parquet")).columns == ["id"]
    with pytest.raises(ValueError):
        s.read_file(spark, "x.xls")


def test_header_rows_and_features(spark, tmp_path):
    df = spark.createDataFrame([('[["a","b"],["1","2"],["3",null]]',), ('[["a"]]',), ("oops",), (None,)], "j string")
    assert [r.fields for r in s.header_rows(df, "j").orderBy("row_no").collect()] == [{"a": "1", "b": "2"}, {"a": "3", "b": None}]
    (tmp_path / "g.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"properties": {"n": 1}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}))
    r = s.features(spark, str(tmp_path / "g.json")).first()
    assert (json.loads(r.properties), r.kind, json.loads(r.coordinates)) == ({"n": 1}, "Point", [1, 2])


def test_manifest_and_reload(spark, tmp_path):
    reg = spark.createDataFrame([("a", "p1"), ("b", "p2")], "variable_id string, path string")
    assert s.manifest(reg.select("variable_id").limit(1), reg).count() == 1
    with pytest.raises(ValueError):
        s.manifest(spark.createDataFrame([("zz",)], "variable_id string"), reg)
    root = str(tmp_path / "r")
    s.replace_partitions(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), root, ["k"])
    s.replace_partitions(spark.createDataFrame([("a", 9)], "k string, v int"), root, ["k"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(root).collect()) == [("a", 9), ("b", 2)]


EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"


def test_stream_windows_agree_with_the_table(spark, tmp_path):
    rows = [(i, dt(2024, 1, 1 + i // 10, i % 24), i % 3, "ab"[i % 2], float(i)) for i in range(60)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, EVENTS).write.parquet(src)
    stream = spark.readStream.schema(EVENTS).parquet(src)
    q = w.tumbling(stream).writeStream.format("memory").queryName("t").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("t").collect())) == sorted(map(tuple, w.tumbling(spark.read.parquet(src)).collect()))


def test_appends_are_idempotent(spark, tmp_path):
    rows = [(i % 20, dt(2024, 1, 1), 1, "a", 1.0) for i in range(40)]
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    spark.createDataFrame(rows, EVENTS).write.parquet(src)
    for _ in range(2):
        stream = w.once(spark.readStream.schema(EVENTS).parquet(src))
        w.append_available(stream, out, ck, ["event_type"]).awaitTermination(120)
    assert spark.read.parquet(out).count() == 20
