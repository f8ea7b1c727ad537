"""From a structured request to typed rows: one plan for all areas, years and comparisons of a figure."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.areas import FRAMES, HIGH, LOW, SHIFT, TOP_FRAME, frame_of, framed, strongest
from ..operators.metrics import MetricSpec, metric
from ..operators.predicates import RecordFilter
from ..operators.wide import _SQL_CELLS, cells
from ..runtime import table

MODES = ("latest", "change", "trend")


@dataclass(frozen=True)
class Request:
    """What is asked of the statistics: a table, a variable (null: all of its), areas (empty: all) and a mode of years."""

    table_id: str
    variable_id: str | None = None
    geo_ids: tuple[str, ...] = ()
    mode: str = "latest"
    target_year: int | None = None
    most: int = 5

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")


def answer(values: DataFrame, request: Request) -> DataFrame:
    """variable_id, geo_id, year, role, value, vs_county, vs_state, frame, change_pct, flag.

    Comparisons are made before areas and years are narrowed down, so ancestors and prior periods are there.  The years
    are those each variable has, at or before the target (else its first); ``latest`` keeps the last, ``change`` the
    last two, ``trend`` the last ``most``.
    """
    c = cells(values.where(F.upper(F.trim("table_id")) == request.table_id.strip().upper()))
    if request.variable_id:
        c = c.where(F.col("variable_id") == request.variable_id.strip().upper())
    f = framed(c.select("table_id", "variable_id", "year", "geo_id", F.col("last_value").alias("value")))
    if request.geo_ids:
        f = f.where(F.col("geo_id").isin(list(request.geo_ids)))
    have = f.select("variable_id", "year").distinct().groupBy("variable_id").agg(F.array_sort(F.collect_list("year")).alias("ys"))
    target = request.target_year if request.target_year is not None else 9999
    upto = F.filter("ys", lambda y: y <= target)
    upto = F.when(F.size(upto) > 0, upto).otherwise(F.slice("ys", 1, 1))
    n = {"latest": 1, "change": 2, "trend": request.most}[request.mode]
    years = have.select("variable_id", F.slice(F.reverse(upto), 1, n).alias("ys")).select("variable_id", F.array_max("ys").alias("last"), F.explode("ys").alias("year"))
    f = f.join(years, ["variable_id", "year"])
    f = f.withColumn("strongest", strongest(f))
    best = F.col("strongest.ratio")
    flag = F.when(best >= HIGH, "far_above_comparators").when(best <= LOW, "far_below_comparators").when(F.col("change_pct") >= SHIFT, "trend_break_up").when(F.col("change_pct") <= -SHIFT, "trend_break_down")
    return f.select("variable_id", "geo_id", "year", F.when(F.col("year") == F.col("last"), "primary").otherwise("prior_period").alias("role"), "value", "vs_county", "vs_state", frame_of(f).alias("frame"), "change_pct", flag.alias("flag"))


def answer_records(records: DataFrame, spec: MetricSpec, mode: str = "trend") -> DataFrame:
    """A record metric with its change on the period before, per group."""
    m = metric(records, spec)
    by = list(spec.group_by)
    w = W.partitionBy(*by).orderBy("year") if by else W.partitionBy(F.lit(1)).orderBy("year")
    before = F.lag("value").over(w)
    out = m.withColumn("prior_value", before).withColumn("change", F.col("value") - before)
    return out if mode == "trend" else out.withColumn("__r", F.row_number().over(w.orderBy(F.desc("year")))).where("__r = 1").drop("__r")


def answer_statistics(spark, d):
    """Every variable of the table with the most rows: its two last years in all areas."""
    v = table(spark, d, "stat_values")
    hot = v.groupBy("table_id").count().orderBy(F.desc("count"), "table_id").first()[0]
    a = answer(v, Request(hot, mode="change"))
    return a.select("variable_id", "geo_id", "year", "role", "value", F.round("vs_county", 6).alias("vs_county"), F.round("vs_state", 6).alias("vs_state"), "frame", F.round("change_pct", 6).alias("change_pct"), "flag")


def answer_rate_trend(spark, d):
    """Share denied by loan purpose and year, with the change on the year before that is present."""
    r = table(spark, d, "hmda_lar").dropDuplicates(["record_id"])
    a = answer_records(r, MetricSpec("percentage", numerator=(RecordFilter("action_taken", "equals", "3"),), group_by=("loan_purpose",)))
    return a.select("year", "loan_purpose", F.round("value", 6).alias("value"), "denominator", F.round("change", 6).alias("change"))


_HOT = "(SELECT table_id FROM stat_values GROUP BY 1 ORDER BY count(*) DESC, table_id LIMIT 1)"
_NEAR = "coalesce(vs_state, vs_county)"
_CASE = f"CASE WHEN {_NEAR} IS NULL THEN 'unknown' " + " ".join(f"WHEN {_NEAR} < {b} THEN '{n}'" for b, n in FRAMES) + f" ELSE '{TOP_FRAME}' END"
_BEST = "CASE WHEN vs_state IS NOT NULL AND (vs_county IS NULL OR abs(vs_state - 1) >= abs(vs_county - 1)) THEN vs_state ELSE vs_county END"
QUERIES = {f.__name__: f for f in (answer_statistics, answer_rate_trend)}
SQL = {
    "answer_statistics": _SQL_CELLS + f""", v AS (SELECT variable_id, year, geo_id, last_value AS value FROM c WHERE table_id = {_HOT}),
f AS (SELECT v.*, CASE WHEN v.value > 0 AND co.value > 0 AND v.value / co.value BETWEEN 0.1 AND 10 THEN v.value / co.value END AS vs_county, CASE WHEN v.value > 0 AND st.value > 0 AND v.value / st.value BETWEEN 0.1 AND 10 THEN v.value / st.value END AS vs_state,
  CASE WHEN lag(v.value) OVER w <> 0 THEN (v.value - lag(v.value) OVER w) / abs(lag(v.value) OVER w) END AS change_pct
  FROM v LEFT JOIN v co ON length(v.geo_id) = 11 AND co.geo_id = left(v.geo_id, 5) AND co.variable_id = v.variable_id AND co.year = v.year LEFT JOIN v st ON length(v.geo_id) > 2 AND st.geo_id = left(v.geo_id, 2) AND st.variable_id = v.variable_id AND st.year = v.year
  WINDOW w AS (PARTITION BY v.variable_id, v.geo_id ORDER BY v.year)),
y AS (SELECT variable_id, year, row_number() OVER (PARTITION BY variable_id ORDER BY year DESC) AS k FROM (SELECT DISTINCT variable_id, year FROM v))
SELECT variable_id, geo_id, year, CASE WHEN k = 1 THEN 'primary' ELSE 'prior_period' END AS role, value, round(vs_county, 6) AS vs_county, round(vs_state, 6) AS vs_state, {_CASE} AS frame, round(change_pct, 6) AS change_pct,
CASE WHEN {_BEST} >= 1.5 THEN 'far_above_comparators' WHEN {_BEST} <= 0.67 THEN 'far_below_comparators' WHEN change_pct >= 0.25 THEN 'trend_break_up' WHEN change_pct <= -0.25 THEN 'trend_break_down' END AS flag FROM f JOIN y USING (variable_id, year) WHERE k <= 2""",
    "answer_rate_trend": "WITH h AS (SELECT DISTINCT ON (record_id) * FROM hmda_lar), m AS (SELECT activity_year AS year, coalesce(loan_purpose, '') AS loan_purpose, avg((coalesce(action_taken, '') = '3')::INT) AS v, count(*) AS denominator FROM h GROUP BY 1, 2) SELECT year, loan_purpose, round(v, 6) AS value, denominator, round(v - lag(v) OVER (PARTITION BY loan_purpose ORDER BY year), 6) AS change FROM m",
}
