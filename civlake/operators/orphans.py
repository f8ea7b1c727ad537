"""References to records that do not exist.

A Bloom filter of the parent keys is built in a distributed way and broadcast; a reference it
rejects is proven to have no parent.  Only references it lets through go to the exact join,
where the parents' periods of existence decide.  The filter's size has a fixed upper bound
(``MAX_BITS``): beyond it the filter lets more references through, the result stays the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import blank_to_null, pad_left, salted_join, table

MAX_BITS = 1 << 28
HASHES = 3


def _positions(key: Column, bits: int) -> list[Column]:
    return [F.xxhash64(key, F.lit(i)).bitwiseAND(F.lit(bits - 1)) for i in range(HASHES)]


def bloom_filter(parents: DataFrame, key: str, max_bits: int = MAX_BITS) -> tuple[np.ndarray, int]:
    """The filter's bits as 64-bit words; at most ``max_bits`` / 64 words reach the driver."""
    n = parents.agg(F.approx_count_distinct(key)).first()[0]
    bits = 1024
    while bits < min(max_bits, 12 * n):
        bits *= 2
    pos = parents.where(F.col(key).isNotNull()).select(F.explode(F.array(*_positions(F.col(key), bits))).alias("p"))
    one = F.expr("shiftleft(1L, cast(p & 63 AS INT))")
    words = pos.groupBy(F.shiftrightunsigned("p", 6).alias("w")).agg(F.bit_or(one).alias("b")).toPandas()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[words["w"].to_numpy(dtype=np.int64)] = words["b"].to_numpy(dtype=np.int64).view(np.uint64)
    return out, bits


def may_exist(refs: DataFrame, key: str, words: np.ndarray, bits: int, name: str = "may_exist") -> DataFrame:
    """Mark the references that the filter cannot reject.  A null key is rejected."""
    shared = refs.sparkSession.sparkContext.broadcast(words)

    def probe(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        bitmap = shared.value
        for cols in batches:
            ok = np.ones(len(cols[0]), dtype=bool)
            for c in cols:
                p = c.to_numpy(dtype=np.int64)
                ok &= (bitmap[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1
            yield pd.Series(ok)

    udf = F.pandas_udf(probe, "boolean")
    return refs.withColumn(name, F.col(key).isNotNull() & udf(*_positions(F.coalesce(F.col(key), F.lit("")), bits)))


def orphan_references(refs: DataFrame, parents: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The references whose parent did not exist when they arrived.

    ``refs``: ref_table, row_id, key, arrived_at.  ``parents``: key, valid_from, valid_to (null: still valid).
    Returns ref_table, row_id, key, arrived_at, reason: ``never_there`` (no parent row at all), ``gone``
    (one was valid earlier), ``not_yet_there`` (the first came later), ``unknown_time`` (a parent exists,
    but the reference has no arrival time).  A null key is blank and no reference.  Parent rows without
    key or valid_from are no parents.  Repeated references come out each time; empty inputs give no rows
    (references without parents: all ``never_there``).  Other columns are ignored.
    """
    refs = refs.select("ref_table", "row_id", "key", "arrived_at").where(F.col("key").isNotNull())
    parents = parents.select("key", "valid_from", "valid_to").where("key IS NOT NULL AND valid_from IS NOT NULL")
    words, bits = bloom_filter(parents, "key", max_bits)
    marked = may_exist(refs, "key", words, bits)
    periods = parents.groupBy("key").agg(F.collect_set(F.struct("valid_from", "valid_to")).alias("periods"), F.min("valid_from").alias("first_from"))
    sure = marked.where(~F.col("may_exist")).select("ref_table", "row_id", "key", "arrived_at", F.lit("never_there").alias("reason"))
    joined = salted_join(marked.where("may_exist").drop("may_exist"), periods, "key", "row_id", "left")
    alive = F.exists("periods", lambda p: (p.valid_from <= F.col("arrived_at")) & (p.valid_to.isNull() | (F.col("arrived_at") < p.valid_to)))
    reason = (
        F.when(F.col("periods").isNull(), "never_there")
        .when(F.col("arrived_at").isNull(), "unknown_time")
        .when(alive, F.lit(None).cast("string"))
        .when(F.col("first_from") <= F.col("arrived_at"), "gone")
        .otherwise("not_yet_there")
    )
    checked = joined.select("ref_table", "row_id", "key", "arrived_at", reason.alias("reason")).where("reason IS NOT NULL")
    return sure.unionByName(checked)


def table_key(table_id: Column, dataset: Column, year: Column) -> Column:
    """Trimmed upper-case table id with its vintage; null where the id is blank."""
    tid = F.upper(blank_to_null(table_id))
    return F.when(tid.isNotNull(), F.concat_ws("\x1f", tid, F.coalesce(dataset, F.lit("\x00")), F.coalesce(year.cast("string"), F.lit("\x00"))))


def domain_references(spark, d: str) -> DataFrame:
    def of(name: str, row_id: str, key: Column) -> DataFrame:
        return table(spark, d, name).select(F.lit(name).alias("ref_table"), F.col(row_id).alias("row_id"), key.alias("key"), F.col("loaded_at").alias("arrived_at"))

    c = F.col
    tract = F.concat(F.lit("tract\x1f"), pad_left(blank_to_null(c("tract_geoid")), 11))
    return (
        of("cards", "rowid", table_key(c("target_table_id"), c("target_dataset"), c("target_year")))
        .unionByName(of("coverage", "coverage_id", table_key(c("table_id"), c("dataset"), c("year"))))
        .unionByName(of("variables", "var_row_id", table_key(c("table_id"), c("dataset"), c("year"))))
        .unionByName(of("place_tract_map", "map_id", tract))
    )


def domain_parents(spark, d: str) -> DataFrame:
    c = F.col
    tables = table(spark, d, "stat_tables").where("dataset IS NOT NULL AND year IS NOT NULL").select(table_key(c("table_id"), c("dataset"), c("year")).alias("key"), c("registered_at").alias("valid_from"), c("deleted_at").alias("valid_to"))
    tracts = table(spark, d, "admin_geographies").where("geo_type = 'tract'").select(F.concat(F.lit("tract\x1f"), c("geoid")).alias("key"), c("registered_at").alias("valid_from"), c("deleted_at").alias("valid_to"))
    return tables.unionByName(tracts)


def p1_orphans(spark, d: str) -> DataFrame:
    return orphan_references(domain_references(spark, d), domain_parents(spark, d))


def p1_found(spark, d: str) -> DataFrame:
    return p1_orphans(spark, d).select("ref_table", "row_id")


def p1_orphans_by_month(spark, d: str) -> DataFrame:
    """Orphans per referring table, referred table id or tract's county, month of arrival and reason."""
    who = F.when(F.col("key").startswith("tract\x1f"), F.substring("key", 7, 5)).otherwise(F.substring_index("key", "\x1f", 1))
    return p1_orphans(spark, d).groupBy("ref_table", who.alias("target"), F.date_format("arrived_at", "yyyy-MM").alias("month"), "reason").agg(F.count(F.lit(1)).alias("orphans"))


_SQL_REFS = """
WITH r AS (
  SELECT 'cards' AS ref_table, rowid AS row_id, upper(trim(target_table_id, E' \\t\\n\\r\\f\\v')) AS k, target_dataset AS ds, target_year AS y, loaded_at FROM cards
  UNION ALL SELECT 'coverage', coverage_id, upper(trim(table_id, E' \\t\\n\\r\\f\\v')), dataset, year, loaded_at FROM coverage
  UNION ALL SELECT 'variables', var_row_id, upper(trim(table_id, E' \\t\\n\\r\\f\\v')), dataset, year, loaded_at FROM variables
), p AS (SELECT upper(trim(table_id, E' \\t\\n\\r\\f\\v')) AS k, dataset AS ds, year AS y, registered_at, deleted_at FROM stat_tables),
t AS (SELECT map_id AS row_id, CASE WHEN length(trim(tract_geoid, E' \\t\\n\\r\\f\\v')) < 11 THEN lpad(trim(tract_geoid, E' \\t\\n\\r\\f\\v'), 11, '0') ELSE trim(tract_geoid, E' \\t\\n\\r\\f\\v') END AS k, loaded_at
      FROM place_tract_map WHERE trim(tract_geoid, E' \\t\\n\\r\\f\\v') <> ''),
g AS (SELECT geoid AS k, registered_at, deleted_at FROM admin_geographies WHERE geo_type = 'tract'),
j AS (
  SELECT r.ref_table, r.row_id, r.k AS target, r.loaded_at, count(p.k) AS n, min(p.registered_at) AS first_from,
         coalesce(bool_or(p.registered_at <= r.loaded_at AND (p.deleted_at IS NULL OR r.loaded_at < p.deleted_at)), false) AS alive
  FROM r LEFT JOIN p ON r.k = p.k AND r.ds = p.ds AND r.y = p.y WHERE r.k <> '' GROUP BY ALL
  UNION ALL
  SELECT 'place_tract_map', t.row_id, substr(t.k, 1, 5), t.loaded_at, count(g.k), min(g.registered_at),
         coalesce(bool_or(g.registered_at <= t.loaded_at AND (g.deleted_at IS NULL OR t.loaded_at < g.deleted_at)), false)
  FROM t LEFT JOIN g ON t.k = g.k GROUP BY t.row_id, t.k, t.loaded_at
), o AS (
  SELECT *, CASE WHEN n = 0 THEN 'never_there' WHEN loaded_at IS NULL THEN 'unknown_time' WHEN first_from <= loaded_at THEN 'gone' ELSE 'not_yet_there' END AS reason
  FROM j WHERE NOT alive
)
"""

QUERIES = {"p1_found": p1_found, "p1_orphans_by_month": p1_orphans_by_month}
SQL = {
    "p1_found": _SQL_REFS + "SELECT ref_table, row_id FROM o",
    "p1_orphans_by_month": _SQL_REFS + "SELECT ref_table, target, strftime(loaded_at, '%Y-%m') AS month, reason, count(*) AS orphans FROM o GROUP BY ALL",
}
