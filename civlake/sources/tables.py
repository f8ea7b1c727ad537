"""Sources and sinks: partitioned trees, delimited and JSON text, GeoJSON features, manifests."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.metrics import variable_rows
from ..operators.wide import normal_geo, row_value
from ..runtime import scratch, table

LAYOUTS = ("wide_hive", "variable_tree")
_VALUE = re.compile(r"[A-Za-z0-9_.\-/]+")
TREE = T.StructType([T.StructField(c, T.StringType()) for c in ("record_id", "value", "census_tract", "table_id", "year", "variable")])


def checked_value(v: str) -> str:
    """A partition value that is safe in a path."""
    if not _VALUE.fullmatch(str(v)) or ".." in str(v):
        raise ValueError(f"not a partition value: {v!r}")
    return str(v)


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """One file by its suffix: parquet without partition columns of its path, delimited text with every column as text."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix == ".parquet":
        return spark.read.option("basePath", path).parquet(path)
    if suffix in (".csv", ".txt"):
        return read_delimited(spark, path)
    raise ValueError(f"unknown kind of file: {suffix!r}")


def read_delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Every column as text; an empty field stays an empty text."""
    df = spark.read.option("header", True).option("inferSchema", False).option("sep", sep).csv(path)
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def write_variable_tree(records: DataFrame, root: str, record_id: str, variables: list[str], table_id: str, year: Column, geo: str | None = None) -> None:
    """One partition per table, year and variable, from a single unpivot: record_id, value[, census_tract]."""
    keyed = records.withColumn("__k", F.concat_ws("\x1f", year.cast("string"), F.col(record_id)))
    rows = variable_rows(keyed, "__k", variables, geo)
    out = rows.select(F.substring_index("record_id", "\x1f", -1).alias("record_id"), "value", *([F.col("geo").alias("census_tract")] if geo else [F.lit(None).cast("string").alias("census_tract")]), F.lit(checked_value(table_id)).alias("table_id"), F.substring_index("record_id", "\x1f", 1).alias("year"), "variable")
    out.repartition("year", "variable").write.mode("append").option("compression", "zstd").partitionBy("table_id", "year", "variable").parquet(root)


def read_variable_tree(spark: SparkSession, root: str, variables: list[str], years: list[int] | None = None, table_id: str | None = None) -> DataFrame:
    """Only the partitions of the wanted variables are listed in the scan; partition values stay text."""
    df = spark.read.schema(TREE).parquet(root).where(F.col("variable").isin([checked_value(v) for v in variables]))
    if years:
        df = df.where(F.col("year").isin([str(y) for y in years]))
    return df.where(F.col("table_id") == checked_value(table_id)) if table_id else df


def write_wide(facts: DataFrame, root: str) -> None:
    facts.repartition("table_id", "year").write.mode("append").partitionBy("table_id", "year", "geo_level").parquet(root)


def read_wide(spark: SparkSession, root: str, schema: T.StructType, table_id: str, year: int, geo_level: str, columns: list[str]) -> DataFrame:
    """One partition, only the wanted columns."""
    return spark.read.schema(schema).parquet(root).where((F.col("table_id") == checked_value(table_id)) & (F.col("year") == str(year)) & (F.col("geo_level") == checked_value(geo_level))).select(*columns)


def header_rows(df: DataFrame, column: str) -> DataFrame:
    """JSON texts ``[[names...], [values...], ...]`` to rows: text_no, row_no, fields (map).  Fewer than two rows, or malformed text, give none."""
    p = df.select(F.monotonically_increasing_id().alias("text_no"), F.from_json(F.col(column), "array<array<string>>").alias("a")).where("size(a) >= 2")
    names = F.col("a")[0]
    return p.select("text_no", names.alias("names"), F.posexplode(F.slice("a", 2, 1_000_000_000)).alias("row_no", "v")).select("text_no", "row_no", F.map_from_arrays("names", "v").alias("fields"))


def features(spark: SparkSession, path: str) -> DataFrame:
    """Features of a GeoJSON collection: properties (JSON text), geometry type and coordinates (JSON text)."""
    schema = "features array<struct<properties:string,geometry:struct<type:string,coordinates:string>>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f")).select("f.properties", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))


def manifest(wanted: DataFrame, registry: DataFrame) -> DataFrame:
    """Registered paths of the wanted variable ids; an id without a registration is an error."""
    missing = wanted.join(registry, "variable_id", "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"unregistered variables: {[r[0] for r in missing]}")
    return registry.join(wanted, "variable_id", "left_semi")


def replace_partitions(df: DataFrame, root: str, by: list[str]) -> None:
    """Reload: the partitions that ``df`` has rows for are replaced, the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(root)


# queries: written to the shared folder and read back


def variable_tree_scan(spark, d):
    root = scratch(spark, "tree")
    write_variable_tree(table(spark, d, "hmda_lar"), root, "record_id", ["action_taken", "loan_type", "loan_purpose", "state_code"], "lar", F.col("activity_year"), "census_tract")
    r = read_variable_tree(spark, root, ["action_taken", "state_code"], [2018, 2020, 2022], "lar")
    return r.groupBy("variable", "year", "value").agg(F.count(F.lit(1)).alias("n"), F.count("census_tract").alias("with_tract"))


def wide_scan(spark, d):
    root = scratch(spark, "wide")
    s = table(spark, d, "stat_values").select("table_id", F.col("year").cast("string").alias("year"), "geo_level", normal_geo(F.col("geo_level"), F.col("geo_id")).alias("geo_id"), "variable_id", row_value(F.col("estimate"), F.col("annotation")).alias("value"), "moe")
    write_wide(s, root)
    hot, year = s.groupBy("table_id").agg(F.count(F.lit(1)).alias("n"), F.max("year").alias("y")).orderBy(F.desc("n"), "table_id").select("table_id", "y").first()
    schema = T.StructType([T.StructField("geo_id", T.StringType()), T.StructField("variable_id", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("moe", T.DoubleType()), *[T.StructField(c, T.StringType()) for c in ("table_id", "year", "geo_level")]])
    return read_wide(spark, root, schema, hot, int(year), "tract", ["geo_id", "variable_id", "value"]).groupBy("geo_id").agg(F.count("value").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def delimited_round_trip(spark, d):
    """Written with a pipe between fields and read back: nulls and blanks come back as empty text, leading zeros stay."""
    root = scratch(spark, "csv")
    table(spark, d, "place_tract_map").select("map_id", "place_id", "tract_geoid", "county_geoid").write.option("header", True).option("sep", "|").csv(root)
    r = read_delimited(spark, root, "|")
    return r.groupBy("county_geoid").agg(F.count(F.lit(1)).alias("n"), F.sum((F.trim("tract_geoid") == "").cast("bigint")).alias("blank"))


def level_csv_sink(spark, d):
    """Long rows to a folder of delimited text per level, ``us`` under the name ``national``."""
    root = scratch(spark, "levels")
    c = table(spark, d, "coverage").withColumn("geo_level", F.when(F.col("geo_level") == "us", "national").otherwise(F.col("geo_level")))
    c.select("geo_level", "coverage_id", "table_id", "status").write.partitionBy("geo_level").option("header", True).csv(root)
    return spark.read.option("header", True).option("inferSchema", False).csv(root).groupBy("geo_level", "status").agg(F.count(F.lit(1)).alias("n"))


def json_shards(spark, d):
    """JSON lines in shards by dataset and year, appended in two runs and read back."""
    root = scratch(spark, "jsonl")
    c = table(spark, d, "coverage").select("dataset", "year", "coverage_id", "geo_level", "row_count")
    for part in ("year <= 2017", "year > 2017"):
        c.where(part).write.mode("append").partitionBy("dataset", "year").json(root)
    r = spark.read.schema("coverage_id bigint, geo_level string, row_count bigint, dataset string, year int").json(root)
    return r.groupBy("dataset", "year").agg(F.count(F.lit(1)).alias("n"), F.sum("row_count").alias("rows"))


def json_header_rows(spark, d):
    """Responses of arrays, the first of them names: one response per region, taken apart again."""
    n = table(spark, d, "nation").select("n_regionkey", F.array(F.col("n_nationkey").cast("string"), F.col("n_name")).alias("v"))
    r = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("v")).alias("vs"))
    t = r.select(F.to_json(F.concat(F.array(F.array(F.lit("key"), F.lit("name"))), "vs")).alias("j"))
    return header_rows(t, "j").select(F.col("fields")["key"].cast("int").alias("key"), F.col("fields")["name"].alias("name"))


def partition_reload(spark, d):
    """One dataset is loaded again; the partitions of the others stay as they were."""
    root = scratch(spark, "reload")
    c = table(spark, d, "coverage").select("dataset", "coverage_id", "status")
    replace_partitions(c, root, ["dataset"])
    replace_partitions(c.where("dataset = 'hmda' AND status = 'success'"), root, ["dataset"])
    return spark.read.parquet(root).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


_HOT = "(SELECT table_id FROM stat_values GROUP BY 1 ORDER BY count(*) DESC, table_id LIMIT 1)"
QUERIES = {f.__name__: f for f in (variable_tree_scan, wide_scan, delimited_round_trip, level_csv_sink, json_shards, json_header_rows, partition_reload)}
SQL = {
    "variable_tree_scan": "SELECT variable, year, value, count(*) AS n, count(census_tract) AS with_tract FROM (SELECT activity_year::VARCHAR AS year, census_tract, unnest(['action_taken', 'state_code']) AS variable, unnest([action_taken, state_code]) AS value FROM hmda_lar WHERE activity_year IN (2018, 2020, 2022)) WHERE value IS NOT NULL GROUP BY 1, 2, 3",
    "delimited_round_trip": "SELECT coalesce(county_geoid, '') AS county_geoid, count(*) AS n, sum((trim(coalesce(tract_geoid, '')) = '')::INT)::BIGINT AS blank FROM place_tract_map GROUP BY 1",
    "level_csv_sink": "SELECT CASE WHEN geo_level = 'us' THEN 'national' ELSE geo_level END AS geo_level, status, count(*) AS n FROM coverage GROUP BY 1, 2",
    "json_shards": "SELECT dataset, year, count(*) AS n, sum(row_count)::BIGINT AS rows FROM coverage GROUP BY 1, 2",
    "json_header_rows": "SELECT n_nationkey AS key, n_name AS name FROM nation",
    "partition_reload": "SELECT dataset, count(*) AS n FROM coverage WHERE dataset <> 'hmda' OR status = 'success' GROUP BY 1",
}
from ..operators.wide import _SQL_CELLS  # noqa: E402

SQL["wide_scan"] = _SQL_CELLS.split(", n AS (")[0] + f", s AS (SELECT table_id, year, CASE WHEN length(g) < w THEN lpad(g, w::INT, '0') ELSE g END AS geo_id, w, v FROM r) SELECT geo_id, count(v) AS n, round(sum(v), 2) AS total FROM s WHERE table_id = {_HOT} AND year = (SELECT max(year) FROM stat_values WHERE table_id = {_HOT}) AND w = 11 GROUP BY 1"
