"""Metrics over records and areas: a declarative specification becomes one DataFrame plan.

A ``MetricSpec`` names the operation, measure, filters, numerator condition, groupings, years and area prefixes; what
would be one call per year, area and group is one scan, one pivot and one ``groupBy``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import cell_number
from ..runtime import table
from .predicates import RecordFilter, all_of, numerator_flag, with_prefixes
from .wide import cells

OPERATIONS = ("value", "count", "sum", "average", "median", "percentage")
#: Words that ask for an operation, in the order they are tried (fixed values).
ASKS_FOR = [("percentage", ("rate", "percent", "share")), ("average", ("average", "mean")), ("median", ("median",)), ("count", ("how many", "number of", "count"))]
MEAN_CAVEAT = "unweighted mean of tract values"


@dataclass(frozen=True)
class MetricSpec:
    operation: str
    measure: str | None = None
    filters: tuple[RecordFilter, ...] = ()
    numerator: tuple[RecordFilter, ...] = ()
    group_by: tuple[str, ...] = ()
    years: tuple[int, ...] = ()
    prefixes: tuple[str, ...] = ()
    year_column: str = "activity_year"
    geo_column: str = "census_tract"
    notes: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if self.operation not in OPERATIONS:
            raise ValueError(f"operation must be one of {OPERATIONS}")
        if self.operation in ("sum", "average", "median", "value") and not self.measure:
            raise ValueError(f"{self.operation} needs a measure")
        if self.operation == "percentage" and not self.numerator:
            raise ValueError("percentage needs a numerator condition")

    def columns(self) -> list[str]:
        """The variables the plan reads, each once, in the order they are met."""
        named = [self.measure, *self.group_by, *(f.column for f in (*self.filters, *self.numerator))]
        return list(dict.fromkeys(c for c in named if c))


def operation_of(text: str) -> str:
    low = text.lower()
    return next((op for op, words in ASKS_FOR if any(w in low for w in words)), "value")


def variable_rows(records: DataFrame, record_id: str, variables: list[str], geo: str | None = None) -> DataFrame:
    """Records to (record_id, variable, value[, geo]) rows; null values give no row."""
    long = records.select(F.col(record_id).alias("record_id"), *([F.col(geo).alias("geo")] if geo else []), F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("string").alias("value")) for v in variables])).alias("x"))
    return long.select("record_id", *(["geo"] if geo else []), "x.variable", "x.value").where("value IS NOT NULL")


def pivot_variables(rows: DataFrame, variables: list[str], keep: list[str] = ()) -> DataFrame:
    """(record_id, variable, value) rows to one row per record with a column per wanted variable: the largest value of each.

    Only wanted variables are read; one shuffle whatever their number.
    """
    wanted = rows.where(F.col("variable").isin(list(variables)))
    return wanted.groupBy("record_id", *keep).agg(*[F.max(F.when(F.col("variable") == v, F.col("value"))).alias(v) for v in variables])


def metric(records: DataFrame, spec: MetricSpec) -> DataFrame:
    """The metric per year and group: year, groups, value, denominator (percentages), rows_used."""
    rows = records.where(all_of(list(spec.filters)))
    if spec.years:
        rows = rows.where(F.col(spec.year_column).isin(list(spec.years)))
    rows = with_prefixes(rows, spec.geo_column, list(spec.prefixes))
    keys = [F.col(spec.year_column).alias("year"), *[F.coalesce(F.col(g).cast("string"), F.lit("")).alias(g) for g in spec.group_by]]
    num = cell_number(F.col(spec.measure)) if spec.measure else F.lit(None).cast("double")
    rows = rows.select(*keys, num.alias("__n"), numerator_flag(list(spec.numerator)).alias("__f"))
    by = ["year", *spec.group_by]
    used = F.count("__n")
    if spec.operation == "count":
        aggs = [F.count(F.lit(1)).cast("double").alias("value"), F.count(F.lit(1)).alias("rows_used")]
    elif spec.operation == "percentage":
        aggs = [F.avg("__f").alias("value"), F.count(F.lit(1)).alias("denominator"), F.count(F.lit(1)).alias("rows_used")]
    else:
        how = {"sum": F.sum, "average": F.avg, "median": F.median, "value": F.avg}[spec.operation]
        aggs = [how("__n").alias("value"), used.alias("rows_used")]
    return rows.groupBy(*by).agg(*aggs)


def ratio(rows: DataFrame, by: list[str], numerators: list[str], denominator: str) -> DataFrame:
    """Sum of numerators over sum of denominators, from rows with a denominator other than 0 and at least one numerator."""
    ok = F.col(denominator).isNotNull() & (F.col(denominator) != 0) & reduce(lambda a, b: a | b, [F.col(n).isNotNull() for n in numerators])
    total = F.sum(F.when(ok, reduce(lambda a, b: a + b, [F.coalesce(F.col(n), F.lit(0.0)) for n in numerators])))
    below = F.sum(F.when(ok, F.col(denominator)))
    return rows.groupBy(*by).agg(F.try_divide(total, below).alias("ratio"), F.coalesce(below, F.lit(0.0)).alias("denominator"), F.count(F.when(ok, 1)).alias("rows_used"))


def components(rows: DataFrame, by: list[str], parts: list[str]) -> DataFrame:
    """Independent sums per part (null where none has a value); a row is used if any part has one."""
    any_part = reduce(lambda a, b: a | b, [F.col(p).isNotNull() for p in parts])
    return rows.groupBy(*by).agg(*[F.sum(p).alias(p) for p in parts], F.count(F.when(any_part, 1)).alias("rows_used"))


def area_value(rows: DataFrame, by: list[str], value: str, order: str, is_tracts: Column) -> DataFrame:
    """The first value of a single area, or the unweighted mean over tracts, with a caveat where it is one of several."""
    n, mean = F.count(value), F.avg(value)
    first = F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order)))
    tracts = F.bool_or(is_tracts)
    return rows.groupBy(*by).agg(F.when(tracts & (n > 1), mean).otherwise(first).alias("value"), F.when(tracts & (n > 1), n).otherwise(F.least(n, F.lit(1))).alias("rows_used"), F.when(tracts & (n > 1), MEAN_CAVEAT).alias("caveat"))


def share_of_both(rows: DataFrame, by: list[str], numerator: str, denominator: str) -> DataFrame:
    """The neighbourhood rule: only rows with both parts, zero denominators kept, divided only if the total is positive."""
    both = F.col(numerator).isNotNull() & F.col(denominator).isNotNull()
    n, m = F.sum(F.when(both, F.col(numerator))), F.sum(F.when(both, F.col(denominator)))
    return rows.groupBy(*by).agg(F.when(m > 0, n / m).alias("ratio"))


def weighted_mean(rows: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    ok = F.col(value).isNotNull() & (F.col(weight) > 0)
    return rows.groupBy(*by).agg(F.try_divide(F.sum(F.when(ok, F.col(value) * F.col(weight))), F.sum(F.when(ok, F.col(weight)))).alias("value"))


# queries


def _records(spark, d):
    """Each record once, however often it was delivered."""
    return table(spark, d, "hmda_lar").dropDuplicates(["record_id"])


def d1_variable_pivot(spark, d):
    """Records taken apart into variable rows and put together again by one pivot."""
    rows = variable_rows(table(spark, d, "hmda_lar"), "record_id", ["action_taken", "loan_type", "loan_purpose", "income"], "census_tract")
    return pivot_variables(rows, ["action_taken", "loan_purpose", "income"], ["geo"])


def d1_filtered_pivot(spark, d):
    rows = variable_rows(table(spark, d, "hmda_lar"), "record_id", ["action_taken", "loan_type", "loan_purpose", "state_code"])
    p = pivot_variables(rows, ["action_taken", "loan_type", "state_code"]).where(all_of([RecordFilter("loan_type", "in", ["1", "2"])]))
    return p.groupBy("state_code").agg(F.avg(numerator_flag([RecordFilter("action_taken", "equals", "1")])).alias("rate"), F.count(F.lit(1)).alias("rows_used")).withColumn("rate", F.round("rate", 6))


def _metric(spark, d, **kw):
    return metric(_records(spark, d), MetricSpec(**kw)).withColumn("value", F.round("value", 6))


def d9_rate_by_group(spark, d):
    """Share of applications denied by year and loan purpose, over all applications."""
    return _metric(spark, d, operation="percentage", numerator=(RecordFilter("action_taken", "equals", "3"),), group_by=("loan_purpose",))


def d9_rate_completed(spark, d):
    """The other recipe: over completed decisions only."""
    return _metric(spark, d, operation="percentage", numerator=(RecordFilter("action_taken", "equals", "3"),), filters=(RecordFilter("action_taken", "in", ["1", "2", "3"]),), group_by=("state_code",))


def d2_count(spark, d):
    return _metric(spark, d, operation="count", filters=(RecordFilter("loan_type", "equals", "1"),), group_by=("state_code",))


def d3_sum(spark, d):
    return _metric(spark, d, operation="sum", measure="loan_amount", group_by=("loan_type",))


def d3_average(spark, d):
    return _metric(spark, d, operation="average", measure="income", prefixes=("03", "14"), years=(2018, 2020, 2022))


def d4_median(spark, d):
    return _metric(spark, d, operation="median", measure="property_value", group_by=("loan_purpose",))


def g8_grouping_labels(spark, d):
    """All combinations of two groupings with their role labels in one aggregation."""
    m = metric(_records(spark, d), MetricSpec("count", group_by=("loan_type", "loan_purpose")))
    return m.select("year", F.concat(F.lit("group_loan_purpose="), "loan_purpose", F.lit(";loan_type="), "loan_type").alias("role"), F.col("rows_used").alias("n"))


def _area_rows(spark, d):
    """Per table, year and area: the three first members of each table as parts."""
    c = cells(table(spark, d, "stat_values"))
    pick = lambda i: F.max(F.when(F.col("variable_id").rlike(rf"_0*{i}[A-Z]*$"), F.col("last_value")))
    return c.groupBy("table_id", "year", "geo_id").agg(pick(1).alias("total"), pick(2).alias("a"), pick(3).alias("b")).withColumn("is_tract", F.length("geo_id") == 11)


def d5_area_value(spark, d):
    v = area_value(_area_rows(spark, d), ["table_id", "year", "is_tract"], "total", "geo_id", F.col("is_tract"))
    return v.withColumn("value", F.round("value", 6))


def d6_ratio(spark, d):
    return ratio(_area_rows(spark, d), ["table_id", "year"], ["a", "b"], "total").withColumns({"ratio": F.round("ratio", 6), "denominator": F.round("denominator", 2)})


def d7_components(spark, d):
    return components(_area_rows(spark, d), ["table_id", "year"], ["total", "a", "b"]).withColumns({c: F.round(c, 2) for c in ("total", "a", "b")})


def d8_empty_buckets(spark, d):
    """Every registered table vintage comes out, with nulls and a note where no row was fetched for it."""
    plan = table(spark, d, "stat_tables").where("deleted_at IS NULL").select(F.upper(F.trim("table_id")).alias("table_id"), "year").distinct()
    got = _area_rows(spark, d).groupBy("table_id", "year").agg(F.avg("total").alias("value"), F.count("total").alias("rows_used"))
    return plan.join(got, ["table_id", "year"], "left").select("table_id", "year", F.round("value", 6).alias("value"), F.coalesce("rows_used", F.lit(0)).alias("rows_used"), F.when(F.coalesce("rows_used", F.lit(0)) == 0, "no rows").alias("note"))


def d16_weighted_mean(spark, d):
    pop = table(spark, d, "admin_geographies").where("geo_type = 'tract'").groupBy(F.col("geoid").alias("geo_id")).agg(F.max("population").alias("population"))
    return weighted_mean(_area_rows(spark, d).join(pop, "geo_id"), ["table_id", "year"], "total", "population").withColumn("value", F.round("value", 6))


def d17_share_of_both(spark, d):
    return share_of_both(_area_rows(spark, d), ["table_id", "year"], "a", "b").withColumn("ratio", F.round("ratio", 6))


def d18_row_features(spark, d):
    """Derived features per area: raw, ratio and sum ratio (missing numerators skipped, all missing: null)."""
    r = _area_rows(spark, d)
    some = F.when(F.col("a").isNotNull() | F.col("b").isNotNull(), F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0)))
    return r.select("table_id", "year", "geo_id", F.col("total").alias("raw"), F.round(F.try_divide("a", "total"), 6).alias("ratio"), F.round(F.try_divide(some, F.col("total")), 6).alias("sum_ratio"))


def d11_distinct_tracts(spark, d):
    t = F.trim("census_tract")
    code = F.when(t.rlike("^[0-9]{1,11}$"), F.lpad(t, 11, "0"))
    return table(spark, d, "hmda_lar").groupBy("activity_year").agg(F.countDistinct(code).alias("tracts"), F.sum(code.isNull().cast("bigint")).alias("without"))


def b8_place_members(spark, d):
    """Totals of a place over its member tracts: the tract list is a semi-join, rows without a tract drop out."""
    m = table(spark, d, "place_tract_map").select("place_id", F.lpad(F.trim("tract_geoid"), 11, "0").alias("geo_id")).where("geo_id IS NOT NULL AND length(trim(geo_id)) = 11").distinct()
    v = _area_rows(spark, d).where("total IS NOT NULL")
    return v.join(m, "geo_id").groupBy("place_id", "year").agg(F.count(F.lit(1)).alias("rows_used"), F.round(F.avg("total"), 6).alias("value"))


from .wide import _SQL_CELLS  # noqa: E402

SQL_RECORDS = "WITH h AS (SELECT DISTINCT ON (record_id) * FROM hmda_lar)"
_N = "CASE WHEN regexp_full_match(trim({0}), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)') THEN try_cast(trim({0}) AS DOUBLE) END"
SQL_AREA = _SQL_CELLS + """, area AS (
  SELECT table_id, year, geo_id, max(last_value) FILTER (regexp_matches(variable_id, '_0*1[A-Z]*$')) AS total, max(last_value) FILTER (regexp_matches(variable_id, '_0*2[A-Z]*$')) AS a,
         max(last_value) FILTER (regexp_matches(variable_id, '_0*3[A-Z]*$')) AS b, length(geo_id) = 11 AS is_tract FROM c GROUP BY table_id, year, geo_id)
"""
QUERIES = {f.__name__: f for f in (d1_variable_pivot, d1_filtered_pivot, d9_rate_by_group, d9_rate_completed, d2_count, d3_sum, d3_average, d4_median, g8_grouping_labels, d5_area_value, d6_ratio, d7_components, d8_empty_buckets, d16_weighted_mean, d17_share_of_both, d18_row_features, d11_distinct_tracts, b8_place_members)}
SQL = {
    "d1_variable_pivot": "SELECT record_id, census_tract AS geo, max(action_taken) AS action_taken, max(loan_purpose) AS loan_purpose, max(income) AS income FROM hmda_lar WHERE action_taken IS NOT NULL OR loan_purpose IS NOT NULL OR income IS NOT NULL GROUP BY 1, 2",
    "d1_filtered_pivot": "WITH p AS (SELECT record_id, max(action_taken) AS action_taken, max(loan_type) AS loan_type, max(state_code) AS state_code FROM hmda_lar GROUP BY 1) SELECT state_code, round(avg((coalesce(action_taken, '') = '1')::INT), 6) AS rate, count(*) AS rows_used FROM p WHERE loan_type IN ('1', '2') GROUP BY 1",
    "d9_rate_by_group": SQL_RECORDS + " SELECT activity_year AS year, coalesce(loan_purpose, '') AS loan_purpose, round(avg((coalesce(action_taken, '') = '3')::INT), 6) AS value, count(*) AS denominator, count(*) AS rows_used FROM h GROUP BY 1, 2",
    "d9_rate_completed": SQL_RECORDS + " SELECT activity_year AS year, coalesce(state_code, '') AS state_code, round(avg((action_taken = '3')::INT), 6) AS value, count(*) AS denominator, count(*) AS rows_used FROM h WHERE action_taken IN ('1', '2', '3') GROUP BY 1, 2",
    "d2_count": SQL_RECORDS + " SELECT activity_year AS year, coalesce(state_code, '') AS state_code, count(*)::DOUBLE AS value, count(*) AS rows_used FROM h WHERE loan_type = '1' GROUP BY 1, 2",
    "d3_sum": SQL_RECORDS + f" SELECT activity_year AS year, coalesce(loan_type, '') AS loan_type, round(sum(n), 6) AS value, count(n) AS rows_used FROM (SELECT *, {_N.format('loan_amount')} AS n FROM h) GROUP BY 1, 2",
    "d3_average": SQL_RECORDS + f" SELECT activity_year AS year, round(avg(n), 6) AS value, count(n) AS rows_used FROM (SELECT *, {_N.format('income')} AS n FROM h) WHERE activity_year IN (2018, 2020, 2022) AND left(census_tract, 2) IN ('03', '14') GROUP BY 1",
    "d4_median": SQL_RECORDS + f" SELECT activity_year AS year, coalesce(loan_purpose, '') AS loan_purpose, round(median(n), 6) AS value, count(n) AS rows_used FROM (SELECT *, {_N.format('property_value')} AS n FROM h) GROUP BY 1, 2",
    "g8_grouping_labels": SQL_RECORDS + " SELECT activity_year AS year, 'group_loan_purpose=' || coalesce(loan_purpose, '') || ';loan_type=' || coalesce(loan_type, '') AS role, count(*) AS n FROM h GROUP BY 1, 2",
    "d5_area_value": SQL_AREA + f"SELECT table_id, year, is_tract, round(CASE WHEN is_tract AND count(total) > 1 THEN avg(total) ELSE arg_min(total, geo_id) FILTER (total IS NOT NULL) END, 6) AS value, CASE WHEN is_tract THEN count(total) ELSE least(count(total), 1) END AS rows_used, CASE WHEN is_tract AND count(total) > 1 THEN '{MEAN_CAVEAT}' END AS caveat FROM area GROUP BY 1, 2, 3",
    "d6_ratio": SQL_AREA + "SELECT table_id, year, round(sum(coalesce(a, 0) + coalesce(b, 0)) FILTER (ok) / sum(total) FILTER (ok), 6) AS ratio, round(coalesce(sum(total) FILTER (ok), 0), 2) AS denominator, count(*) FILTER (ok) AS rows_used FROM (SELECT *, coalesce(total <> 0 AND (a IS NOT NULL OR b IS NOT NULL), false) AS ok FROM area) GROUP BY 1, 2",
    "d7_components": SQL_AREA + "SELECT table_id, year, round(sum(total), 2) AS total, round(sum(a), 2) AS a, round(sum(b), 2) AS b, count(*) FILTER (coalesce(total, a, b) IS NOT NULL) AS rows_used FROM area GROUP BY 1, 2",
    "d8_empty_buckets": SQL_AREA + "SELECT p.table_id, p.year, round(avg(total), 6) AS value, count(total) AS rows_used, CASE WHEN count(total) = 0 THEN 'no rows' END AS note FROM (SELECT DISTINCT upper(trim(table_id)) AS table_id, year FROM stat_tables WHERE deleted_at IS NULL) p LEFT JOIN area USING (table_id, year) GROUP BY 1, 2",
    "d16_weighted_mean": SQL_AREA + "SELECT table_id, year, round(sum(total * population) FILTER (total IS NOT NULL AND population > 0) / sum(population) FILTER (total IS NOT NULL AND population > 0), 6) AS value FROM area JOIN (SELECT geoid AS geo_id, max(population) AS population FROM admin_geographies WHERE geo_type = 'tract' GROUP BY 1) USING (geo_id) GROUP BY 1, 2",
    "d17_share_of_both": SQL_AREA + "SELECT table_id, year, round(CASE WHEN sum(b) FILTER (a IS NOT NULL AND b IS NOT NULL) > 0 THEN sum(a) FILTER (a IS NOT NULL AND b IS NOT NULL) / sum(b) FILTER (a IS NOT NULL AND b IS NOT NULL) END, 6) AS ratio FROM area GROUP BY 1, 2",
    "d18_row_features": SQL_AREA + "SELECT table_id, year, geo_id, total AS raw, round(a / nullif(total, 0), 6) AS ratio, round(CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN coalesce(a, 0) + coalesce(b, 0) END / nullif(total, 0), 6) AS sum_ratio FROM area",
    "d11_distinct_tracts": "SELECT activity_year, count(DISTINCT t) AS tracts, count(*) - count(t) AS without FROM (SELECT activity_year, CASE WHEN regexp_full_match(trim(census_tract), '[0-9]{1,11}') THEN lpad(trim(census_tract), 11, '0') END AS t FROM hmda_lar) GROUP BY 1",
    "b8_place_members": SQL_AREA + "SELECT place_id, year, count(*) AS rows_used, round(avg(total), 6) AS value FROM area JOIN (SELECT DISTINCT place_id, lpad(trim(tract_geoid), 11, '0') AS geo_id FROM place_tract_map WHERE tract_geoid IS NOT NULL) USING (geo_id) WHERE total IS NOT NULL GROUP BY 1, 2",
}
