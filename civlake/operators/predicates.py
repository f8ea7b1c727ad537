"""Filters as data, turned into column expressions; user values never become SQL text."""

from __future__ import annotations

import json
import re
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import table

OPERATORS = ("equals", "not_equals", "in", "not_in", "is_null", "is_not_null")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
#: Age words that name no group of their own (fixed values).
AMBIGUOUS_AGES = {"middle aged", "middle-aged", "adult", "adults"}
#: Up to so many prefixes are tested by an OR of startswith; more go through a semi-join by length.
PREFIXES_INLINE = 24


@dataclass(frozen=True)
class RecordFilter:
    column: str
    operator: str
    value: object = None


def shaped(column: str, value: object, operator: str | None = None) -> RecordFilter:
    """A filter from loosely shaped input: a list (or a JSON list, or a comma list) asks for ``in``; a scalar is wrapped where a list is due."""
    if isinstance(value, str):
        text = value.strip()
        if text.startswith("["):
            try:
                value = json.loads(text)
            except ValueError:
                pass
        elif operator in ("in", "not_in") and "," in text:
            value = [x.strip() for x in text.split(",") if x.strip()]
    if isinstance(value, list | tuple | set):
        return RecordFilter(column, {"equals": "in", "not_equals": "not_in", None: "in"}.get(operator, operator), list(value))
    if operator in ("in", "not_in"):
        return RecordFilter(column, operator, [value])
    return RecordFilter(column, operator or "equals", value)


def is_ambiguous(f: RecordFilter) -> bool:
    return "age" in f.column.lower() and str(f.value).strip().lower() in AMBIGUOUS_AGES


def predicate(f: RecordFilter) -> Column:
    """Case-insensitive text comparison; null cells fail every comparison but ``is_null``."""
    if not _NAME.fullmatch(f.column):
        raise ValueError(f"not a column name: {f.column!r}")
    c = F.col(f.column)
    low = lambda v: str(v).lower()
    text = F.lower(c.cast("string"))
    if f.operator == "equals":
        return text == low(f.value)
    if f.operator == "not_equals":
        return text != low(f.value)
    if f.operator in ("in", "not_in"):
        if not isinstance(f.value, list | tuple) or not f.value:
            raise ValueError(f"{f.operator} needs a list of values")
        hit = text.isin([low(v) for v in f.value])
        return hit if f.operator == "in" else ~hit
    if f.operator == "is_null":
        return c.isNull()
    if f.operator == "is_not_null":
        return c.isNotNull()
    raise ValueError(f"unknown operator: {f.operator!r}")


def all_of(filters: list[RecordFilter]) -> Column:
    """The conjunction; ambiguous filters are left out; none at all lets every row pass."""
    return reduce(lambda a, b: a & b, [predicate(f) for f in filters if not is_ambiguous(f)], F.lit(True))


def numerator_flag(filters: list[RecordFilter] | None) -> Column:
    """1 for rows in the numerator, else 0; without a condition no row is."""
    hit = all_of(filters) if filters else F.lit(False)
    return F.when(hit, 1).otherwise(0)


def with_prefixes(df: DataFrame, column: str, prefixes: list[str], inline: int = PREFIXES_INLINE) -> DataFrame:
    """Rows whose id starts with one of the prefixes, which may differ in length."""
    prefixes = sorted({p for p in prefixes if p})
    if not prefixes:
        return df
    if len(prefixes) <= inline:
        return df.where(reduce(lambda a, b: a | b, [F.col(column).startswith(p) for p in prefixes]))
    by_length = defaultdict(list)
    for p in prefixes:
        by_length[len(p)].append((p,))
    hits = df
    flags = []
    for n, v in by_length.items():
        keys = df.sparkSession.createDataFrame(v, f"p{n} string")
        hits = hits.join(F.broadcast(keys), F.substring(column, 1, n) == F.col(f"p{n}"), "left")
        flags.append(F.col(f"p{n}").isNotNull())
    return hits.where(reduce(lambda a, b: a | b, flags)).drop(*[f"p{n}" for n in by_length])


def _count(spark, d, filters, name="hmda_lar", by="state_code"):
    return table(spark, d, name).where(all_of(filters)).groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def b1_equals_ci(spark, d):
    return _count(spark, d, [RecordFilter("loan_purpose", "equals", "31")])


def b2_not_equals(spark, d):
    return _count(spark, d, [RecordFilter("income", "not_equals", "na"), RecordFilter("property_value", "not_equals", "EXEMPT")])


def b3_in(spark, d):
    return _count(spark, d, [shaped("income", '["na", "exempt"]')])


def b3_not_in_nulls(spark, d):
    return _count(spark, d, [shaped("loan_amount", "NA,exempt", "not_in")])


def b4_nulls(spark, d):
    a = _count(spark, d, [RecordFilter("income", "is_null")]).withColumnRenamed("n", "without_income")
    b = _count(spark, d, [RecordFilter("income", "is_not_null")]).withColumnRenamed("n", "with_income")
    return b.join(a, "state_code", "full").select("state_code", F.coalesce("with_income", F.lit(0)).alias("with_income"), F.coalesce("without_income", F.lit(0)).alias("without_income"))


def b6_geo_prefixes(spark, d):
    rows = with_prefixes(table(spark, d, "hmda_lar"), "census_tract", ["03", "14081", "58033"])
    return rows.groupBy(F.substring("census_tract", 1, 2).alias("state")).agg(F.count(F.lit(1)).alias("n"))


def b6_many_prefixes(spark, d):
    """Counties of a whole state and single tracts as prefixes, more than are tested inline."""
    prefixes = [f"03{n:03d}" for n in range(1, 200, 2)] + [f"{s}001012501" for s in range(10, 60)] + ["59"]
    rows = with_prefixes(table(spark, d, "hmda_lar"), "census_tract", prefixes)
    return rows.groupBy(F.substring("census_tract", 1, 5).alias("county")).agg(F.count(F.lit(1)).alias("n"))


def b7_ids(spark, d):
    """Rows of the counties that have a registered tract (an id list from another table)."""
    known = table(spark, d, "admin_geographies").where("geo_type = 'tract'").select(F.substring("geoid", 1, 5).alias("county_code")).distinct()
    return table(spark, d, "hmda_lar").join(known, "county_code", "left_semi").groupBy("county_code").agg(F.count(F.lit(1)).alias("n"))


def b9_numerator(spark, d):
    """A numerator condition does not restrict the denominator."""
    flag = numerator_flag([RecordFilter("action_taken", "equals", "3")])
    return table(spark, d, "hmda_lar").select("activity_year", flag.alias("f"), numerator_flag(None).alias("none")).groupBy("activity_year").agg(F.sum("f").alias("numerator"), F.count(F.lit(1)).alias("denominator"), F.sum("none").alias("no_condition"))


def b15_domains(spark, d):
    wanted = F.array(F.lit("housing"), F.lit("labor"))
    c = table(spark, d, "cards").where(F.arrays_overlap(F.coalesce(F.from_json("l1_domains", "array<string>"), F.array().cast("array<string>")), wanted))
    return c.groupBy("card_type").agg(F.count(F.lit(1)).alias("n"))


def b16_coverage_containment(spark, d):
    """Tables whose successful levels hold all required ones, or that have no coverage at all."""
    need = F.array(F.lit("county"), F.lit("state"))
    cov = table(spark, d, "coverage").where("status = 'success'").groupBy(F.upper(F.trim("table_id")).alias("table_id")).agg(F.collect_set("geo_level").alias("levels"))
    t = table(spark, d, "stat_tables").select("table_id").distinct().join(cov, "table_id", "left")
    return t.where(F.col("levels").isNull() | (F.size(F.array_except(need, "levels")) == 0)).select("table_id", F.coalesce(F.size("levels"), F.lit(0)).cast("bigint").alias("n_levels"))


#: Overlapping bands of population (from, to), the first that fits counts (fixed values).
SIZE_BANDS = [(0, 5_000), (2_000, 10_000), (5_000, 25_000), (15_000, 80_000), (50_000, 250_000), (150_000, 1_000_000), (500_000, 10_000_000)]


def size_band(population: Column) -> Column:
    """The band (from, to) of an anchor's population: the first with from <= population < to, above all of them the last."""
    each = [F.array(F.lit(lo), F.lit(hi)) for lo, hi in SIZE_BANDS]
    out = F.when(population.isNull(), None)
    for (lo, hi), band in zip(SIZE_BANDS, each, strict=True):
        out = out.when((population >= lo) & (population < hi), band)
    return out.otherwise(each[-1])


def b17_size_bucket(spark, d):
    """The size band of each tract by population."""
    band = F.concat_ws("-", size_band(F.col("population")))
    band = F.when(F.col("population").isNotNull(), band)
    return table(spark, d, "admin_geographies").where("geo_type = 'tract'").groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("tracts"), F.min("population").alias("least"), F.max("population").alias("most"))


def b19_expired(spark, d):
    """Cards whose embedding is older than a year (strictly) at the latest embedding time."""
    c = table(spark, d, "cards").where("embedded_at IS NOT NULL").select("embedding_version", "embedded_at")
    now = c.agg(F.max("embedded_at").alias("now"))
    return c.crossJoin(F.broadcast(now)).groupBy("embedding_version").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("now") - F.col("embedded_at") > 365 * 86400).cast("bigint")).alias("expired"))


def b26_alias_split(spark, d):
    """Names joined by slashes or ``and`` give one alias each; blanks drop out and repeats count once."""
    n = table(spark, d, "stat_tables").select("table_id", F.explode(F.split(F.lower("title"), r"/| and | by ")).alias("alias"))
    return n.select("table_id", F.trim("alias").alias("alias")).where("alias <> ''").distinct()


_OK = "GROUP BY state_code"
QUERIES = {f.__name__: f for f in (b1_equals_ci, b2_not_equals, b3_in, b3_not_in_nulls, b4_nulls, b6_geo_prefixes, b6_many_prefixes, b7_ids, b9_numerator, b15_domains, b16_coverage_containment, b17_size_bucket, b19_expired, b26_alias_split)}
SQL = {
    "b1_equals_ci": f"SELECT state_code, count(*) AS n FROM hmda_lar WHERE lower(loan_purpose) = '31' {_OK}",
    "b2_not_equals": f"SELECT state_code, count(*) AS n FROM hmda_lar WHERE lower(income) <> 'na' AND lower(property_value) <> 'exempt' {_OK}",
    "b3_in": f"SELECT state_code, count(*) AS n FROM hmda_lar WHERE lower(income) IN ('na', 'exempt') {_OK}",
    "b3_not_in_nulls": f"SELECT state_code, count(*) AS n FROM hmda_lar WHERE lower(loan_amount) NOT IN ('na', 'exempt') {_OK}",
    "b4_nulls": f"SELECT state_code, count(income) AS with_income, count(*) - count(income) AS without_income FROM hmda_lar {_OK}",
    "b6_geo_prefixes": "SELECT left(census_tract, 2) AS state, count(*) AS n FROM hmda_lar WHERE left(census_tract, 2) = '03' OR left(census_tract, 5) IN ('14081', '58033') GROUP BY 1",
    "b6_many_prefixes": "SELECT left(census_tract, 5) AS county, count(*) AS n FROM hmda_lar WHERE left(census_tract, 2) = '59' OR left(census_tract, 5) IN (SELECT '03' || lpad(i::VARCHAR, 3, '0') FROM range(1, 200, 2) t(i)) OR left(census_tract, 11) IN (SELECT i || '001012501' FROM range(10, 60) t(i)) GROUP BY 1",
    "b7_ids": "SELECT county_code, count(*) AS n FROM hmda_lar WHERE county_code IN (SELECT substr(geoid, 1, 5) FROM admin_geographies WHERE geo_type = 'tract') GROUP BY 1",
    "b9_numerator": "SELECT activity_year, sum((action_taken = '3')::INT)::BIGINT AS numerator, count(*) AS denominator, 0::BIGINT AS no_condition FROM hmda_lar GROUP BY 1",
    "b15_domains": "SELECT card_type, count(*) AS n FROM cards WHERE json_valid(l1_domains) AND list_has_any(from_json(l1_domains, '[\"VARCHAR\"]'), ['housing', 'labor']) GROUP BY 1",
    "b16_coverage_containment": """WITH c AS (SELECT upper(trim(table_id)) AS table_id, list(DISTINCT geo_level) AS levels FROM coverage WHERE status = 'success' GROUP BY 1)
SELECT t.table_id, coalesce(len(levels), 0)::BIGINT AS n_levels FROM (SELECT DISTINCT table_id FROM stat_tables) t LEFT JOIN c USING (table_id) WHERE levels IS NULL OR list_has_all(levels, ['county', 'state'])""",
    "b17_size_bucket": "SELECT CASE WHEN population IS NULL THEN NULL " + " ".join(f"WHEN population >= {lo} AND population < {hi} THEN '{lo}-{hi}'" for lo, hi in SIZE_BANDS) + f" ELSE '{SIZE_BANDS[-1][0]}-{SIZE_BANDS[-1][1]}' END AS band, count(*) AS tracts, min(population) AS least, max(population) AS most FROM admin_geographies WHERE geo_type = 'tract' GROUP BY 1",
    "b19_expired": "SELECT embedding_version, count(*) AS n, sum(((SELECT max(embedded_at) FROM cards) - embedded_at > 365 * 86400)::INT)::BIGINT AS expired FROM cards WHERE embedded_at IS NOT NULL GROUP BY 1",
    "b26_alias_split": "SELECT DISTINCT table_id, trim(a) AS alias FROM (SELECT table_id, unnest(regexp_split_to_array(lower(title), '/| and | by ')) AS a FROM stat_tables) WHERE trim(a) <> ''",
}
