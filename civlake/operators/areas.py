"""Area hierarchies, comparisons up the hierarchy and over time, and set operations on areas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.normalize import when_chain
from ..runtime import table
from .wide import _SQL_CELLS, cells

#: Bounds (strictly below) and labels of a comparison and of a change, and the labels above them (fixed values).
FRAMES = [(0.60, "very_low"), (0.85, "low"), (1.15, "typical"), (1.40, "elevated"), (1.80, "high")]
TRENDS = [(-0.10, "falling_strong"), (-0.03, "falling_mild"), (0.03, "flat"), (0.10, "rising_mild")]
TOP_FRAME, TOP_TREND = "very_high", "rising_strong"
#: Names of the comparisons, in the order in which equal deviations count (fixed values).
COMPARISONS = {"vs_msa": "metro", "vs_state": "state", "vs_county": "county", "vs_us": "national"}
#: Phrases of a comparison by the same bounds (fixed values).
PHRASES = [(0.60, "far below the"), (0.85, "below the"), (1.15, "roughly in line with the"), (1.40, "somewhat above the"), (1.80, "substantially above the")]
TOP_PHRASE = "far above the"
PLAUSIBLE = (0.10, 10.0)
HIGH, LOW, SHIFT = 1.50, 0.67, 0.25


def parent_of(geo_id: Column) -> Column:
    """County of a tract, state of a county or place, nothing above a state."""
    n = F.length(geo_id)
    return F.when(n == 11, F.substring(geo_id, 1, 5)).when(n.isin(5, 7), F.substring(geo_id, 1, 2))


def as_of(years: Column, target: Column) -> Column:
    """The greatest of the years that is not after the target, else the least."""
    return F.coalesce(F.array_max(F.filter(years, lambda y: y <= target)), F.array_min(years))


def plausible_ratio(a: Column, b: Column) -> Column:
    r = F.try_divide(a, b)
    return F.when((a > 0) & (b > 0) & r.between(*PLAUSIBLE), r)


def framed(values: DataFrame, metros: DataFrame | None = None) -> DataFrame:
    """Each area's value against its ancestors and its own last period.

    ``values``: table_id, variable_id, year, geo_id, value (one row per key; the nation's geo_id is ``us``).  ``metros``:
    county_id, msa_id (one row per county).  Adds vs_county, vs_msa, vs_state, vs_us (null where the ancestor has no
    value or the ratio is not plausible), prior_year, change_pct and trend label.
    """
    key = ["table_id", "variable_id", "year"]
    up = lambda width, name: values.where(F.length("geo_id") == width).select(*key, F.col("geo_id").alias(f"{name}_id"), F.col("value").alias(name))
    v = values.withColumn("county_id", F.when(F.length("geo_id") == 11, F.substring("geo_id", 1, 5))).withColumn("state_id", F.when(F.length("geo_id") > 2, F.substring("geo_id", 1, 2)))
    v = v.join(up(5, "county"), [*key, "county_id"], "left").join(up(2, "state").where("state_id <> 'us'"), [*key, "state_id"], "left")
    v = v.join(values.where("geo_id = 'us'").select(*key, F.col("value").alias("us")), key, "left")
    if metros is None:
        v = v.withColumn("msa", F.lit(None).cast("double"))
    else:
        of = metros.select(F.col("county_id").alias("own_county"), "msa_id")
        own = F.when(F.length("geo_id") == 5, F.col("geo_id")).otherwise(F.col("county_id"))
        v = v.withColumn("own_county", own).join(of, "own_county", "left").join(up(5, "msa"), [*key, "msa_id"], "left")
    w = W.partitionBy("table_id", "variable_id", "geo_id").orderBy("year")
    before = F.lag("value").over(w)
    change = F.when(before != 0, (F.col("value") - before) / F.abs(before))
    v = v.withColumns({"prior_year": F.lag("year").over(w), "change_pct": change})
    return v.select(*key, "geo_id", "value", plausible_ratio(F.col("value"), F.col("county")).alias("vs_county"), plausible_ratio(F.col("value"), F.col("state")).alias("vs_state"), plausible_ratio(F.col("value"), F.col("msa")).alias("vs_msa"), F.when(F.col("geo_id") != "us", plausible_ratio(F.col("value"), F.col("us"))).alias("vs_us"), "prior_year", "change_pct", when_chain(F.col("change_pct"), TRENDS, TOP_TREND).alias("trend"))


def strongest(v: DataFrame) -> Column:
    """The comparison that deviates most from 1 (name, ratio); of equal ones the first in COMPARISONS, none without a deviation."""
    parts = [F.when(F.abs(F.col(c) - 1) > 0, F.struct(F.abs(F.col(c) - 1).alias("dev"), F.lit(-i).alias("prio"), F.lit(name).alias("name"), F.col(c).alias("ratio"))) for i, (c, name) in enumerate(COMPARISONS.items())]
    return F.array_max(F.array(*parts))


def frame_of(v: DataFrame) -> Column:
    """Label of the comparison that stands for the area's surroundings: metro, else state, county, nation; ``unknown`` without any."""
    return F.coalesce(when_chain(F.coalesce(*COMPARISONS), FRAMES, TOP_FRAME), F.lit("unknown"))


def framing_phrase(v: DataFrame) -> Column:
    """One line on the comparison and the change, such as ``below the state level (0.72×); up 4.1% from 2019``."""
    which = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(name)) for c, name in COMPARISONS.items()])
    ratio = F.coalesce(*COMPARISONS)
    level = F.concat(when_chain(ratio, PHRASES, TOP_PHRASE), F.lit(" "), which, F.format_string(" level (%.2f×)", ratio))
    pct = F.col("change_pct") * 100
    move = F.when(F.col("prior_year").isNotNull() & pct.isNotNull(), F.concat(F.when(pct >= 0, "up ").otherwise("down "), F.format_string("%.1f%%", F.abs(pct)), F.lit(" from "), F.col("prior_year").cast("string")))
    return F.coalesce(F.nullif(F.concat_ws("; ", F.when(ratio.isNotNull(), level), move), F.lit("")), F.lit("no comparator or trend context available"))


def flags(v: DataFrame) -> DataFrame:
    """Up to two anomaly flags per value: one for its strongest comparison, one for its change."""
    best = F.col("strongest.ratio")
    level = F.when(best >= HIGH, "far_above_comparators").when(best <= LOW, "far_below_comparators")
    move = F.when(F.col("change_pct") >= SHIFT, "trend_break_up").when(F.col("change_pct") <= -SHIFT, "trend_break_down")
    each = F.filter(F.array(F.struct(level.alias("flag"), F.col("strongest.name").alias("against")), F.struct(move.alias("flag"), F.lit(None).cast("string").alias("against"))), lambda x: x.flag.isNotNull())
    return v.withColumn("strongest", strongest(v)).withColumn("x", F.explode(each)).select("table_id", "variable_id", "year", "geo_id", "x.flag", "x.against")


def intersected(primary: DataFrame, other: DataFrame, by: list[str], item: str) -> DataFrame:
    """Items of the primary that the other has as well; the primary's order column stays with them."""
    return primary.join(other.select(*by, item).distinct(), [*by, item], "left_semi")


def subtracted(primary: DataFrame, other: DataFrame, by: list[str], item: str) -> DataFrame:
    return primary.join(other.select(*by, item).distinct(), [*by, item], "left_anti")


def in_direction(df: DataFrame, lat: str, lon: str, at: tuple[float, float], direction: str) -> DataFrame:
    """Areas strictly north, south, east or west (or two of them, as in ``ne``) of a point."""
    tests = {"n": F.col(lat) > at[0], "s": F.col(lat) < at[0], "e": F.col(lon) > at[1], "w": F.col(lon) < at[1]}
    if direction not in ("n", "s", "e", "w", "ne", "nw", "se", "sw"):
        raise ValueError(f"unknown direction: {direction!r}")
    return df.where(reduce(lambda a, b: a & b, [tests[c] for c in direction]))


# queries


def _values(spark, d):
    """The last value of every cell of stat_values."""
    c = cells(table(spark, d, "stat_values"))
    return c.select("table_id", "variable_id", "year", "geo_id", F.col("last_value").alias("value"))


def geo_rollup(spark, d):
    """Population and tracts by state, county and in all, in one pass over the hierarchy."""
    t = table(spark, d, "admin_geographies").where("geo_type = 'tract'").select("geoid", "population").dropDuplicates(["geoid"])
    r = t.groupBy("geoid").agg(F.max("population").alias("p")).rollup(F.substring("geoid", 1, 2).alias("state"), F.substring("geoid", 1, 5).alias("county"))
    return r.agg(F.count(F.lit(1)).alias("tracts"), F.grouping_id().cast("int").alias("level"))


def comparator_chain(spark, d):
    """The ancestors of every area that has a value, each once, nearest first."""
    v = _values(spark, d).select("geo_id").distinct()
    chain = F.array_compact(F.array(F.when(F.length("geo_id") == 11, F.substring("geo_id", 1, 5)), F.when(F.length("geo_id") > 2, F.substring("geo_id", 1, 2)), F.lit("us")))
    return v.select("geo_id", F.posexplode(chain).alias("place", "comparator"))


def magnitude_framing(spark, d):
    f = framed(_values(spark, d))
    return f.select("table_id", "year", "geo_id", "variable_id", F.round("vs_county", 6).alias("vs_county"), F.round("vs_state", 6).alias("vs_state"), frame_of(f).alias("frame"), "prior_year", F.round("change_pct", 6).alias("change_pct"), "trend")


def anomaly_flags(spark, d):
    return flags(framed(_values(spark, d)))


def trend_last5(spark, d):
    """The last five vintages of each table, in order."""
    y = table(spark, d, "stat_tables").where("deleted_at IS NULL").select(F.upper(F.trim("table_id")).alias("table_id"), "year").distinct()
    return y.groupBy("table_id").agg(F.array_join(F.slice(F.reverse(F.array_sort(F.collect_list("year"))), 1, 5), ",").alias("years"))


def trend_prior_period(spark, d):
    v = _values(spark, d)
    w = W.partitionBy("table_id", "variable_id", "geo_id").orderBy("year")
    return v.withColumn("prior_year", F.lag("year").over(w)).withColumn("prior_value", F.lag("value").over(w)).where("prior_year IS NOT NULL AND year - prior_year <= 3").select("table_id", "variable_id", "geo_id", "year", "prior_year", "prior_value", "value")


def year_as_of(spark, d):
    have = table(spark, d, "stat_tables").groupBy("table_id").agg(F.collect_set("year").alias("years"))
    return have.select("table_id", "years", F.explode(F.sequence(F.lit(2008), F.lit(2025))).alias("target")).select("table_id", "target", as_of(F.col("years"), F.col("target")).alias("year"))


def geo_intersect(spark, d):
    """Tracts that places share with the place of the smallest id that overlaps the same county, in the place's own order."""
    m = table(spark, d, "place_tract_map").where("tract_geoid IS NOT NULL AND trim(tract_geoid) <> ''").select("place_id", F.trim("tract_geoid").alias("tract"), "map_id")
    known = table(spark, d, "admin_geographies").where("geo_type = 'tract' AND deleted_at IS NULL").select(F.col("geoid").alias("tract"))
    kept = intersected(m, known, [], "tract")
    return kept.groupBy("place_id").agg(F.array_join(F.transform(F.array_sort(F.array_agg(F.struct("map_id", "tract"))), lambda x: x.tract), ",").alias("tracts"))


COMPOUND_CONFIDENCE = 0.95


def compound(pairs: DataFrame, tracts: DataFrame, how: str) -> DataFrame:
    """Two places put together: primary, other, how, tracts (in the primary's order), removed, confidence, note.

    ``pairs``: primary, other.  ``tracts``: place, tract, position, confidence.  ``how``: ``intersect`` keeps the tracts of
    both, ``difference`` those of the primary alone.  Confidence is the lesser of the two, lowered once.  A place
    without tracts gives an empty list; repeated tracts count once, at their first position.
    """
    t = tracts.groupBy("place", "tract").agg(F.min("position").alias("position"), F.max("confidence").alias("confidence"))
    p = pairs.select("primary", "other").distinct()
    own = p.join(t.withColumnRenamed("place", "primary"), "primary", "left")
    filt = t.select(F.col("place").alias("other"), "tract", F.lit(True).alias("shared"))
    conf = t.groupBy(F.col("place").alias("other")).agg(F.min("confidence").alias("other_confidence"))
    j = own.join(filt, ["other", "tract"], "left").withColumn("keep", F.col("tract").isNotNull() & (F.coalesce("shared", F.lit(False)) if how == "intersect" else F.col("shared").isNull()))
    g = j.groupBy("primary", "other").agg(F.array_sort(F.collect_list(F.when(F.col("keep"), F.struct("position", "tract")))).alias("x"), F.count("tract").alias("n"), F.min("confidence").alias("c"))
    g = g.join(conf, "other", "left").withColumn("tracts", F.transform("x", lambda s: s.tract)).withColumn("removed", F.col("n") - F.size("x"))
    note = F.when(F.size("tracts") == 0, "no tract is left").when((F.lit(how) == "difference") & (F.col("removed") == 0), "nothing was excluded")
    return g.select("primary", "other", F.lit(how).alias("how"), "tracts", "removed", (F.least("c", "other_confidence") * COMPOUND_CONFIDENCE).alias("confidence"), note.alias("note"))


def _mapped_tracts(spark, d):
    m = table(spark, d, "place_tract_map").where("place_id IS NOT NULL AND trim(tract_geoid) <> ''")
    return m.select(F.col("place_id").alias("place"), F.trim("tract_geoid").alias("tract"), F.col("map_id").alias("position"), F.lit(0.9).alias("confidence"))


def _overlapping_pairs(t):
    """Each place with the first other place of the same county of its tracts."""
    c = t.select("place", F.substring("tract", 1, 5).alias("county")).distinct()
    w = W.partitionBy("county").orderBy("place")
    return c.withColumn("other", F.lead("place").over(w)).where("other IS NOT NULL").select(F.col("place").alias("primary"), "other")


def _compound_rows(c):
    return c.select("primary", "other", F.array_join("tracts", ",").alias("tracts"), "removed", F.round("confidence", 6).alias("confidence"), "note")


def geo_compound_intersect(spark, d):
    """Each place and the next one of a county: the tracts they share, in the first one's order."""
    t = _mapped_tracts(spark, d)
    return _compound_rows(compound(_overlapping_pairs(t), t, "intersect"))


def geo_compound_difference(spark, d):
    t = _mapped_tracts(spark, d)
    return _compound_rows(compound(_overlapping_pairs(t), t, "difference"))


def framing_phrases(spark, d):
    """How often each kind of line on comparison and change is said, by year (numbers left out)."""
    f = framed(_values(spark, d))
    return f.select("year", F.regexp_replace(framing_phrase(f), r"[0-9][0-9.,]*", "#").alias("phrase")).groupBy("year", "phrase").agg(F.count(F.lit(1)).alias("n"))


def geo_difference(spark, d):
    m = table(spark, d, "place_tract_map").where("tract_geoid IS NOT NULL AND trim(tract_geoid) <> ''").select("place_id", F.trim("tract_geoid").alias("tract"))
    known = table(spark, d, "admin_geographies").where("geo_type = 'tract' AND deleted_at IS NULL").select(F.col("geoid").alias("tract"))
    left = subtracted(m, known, [], "tract")
    return m.groupBy("place_id").agg(F.count(F.lit(1)).alias("before")).join(left.groupBy("place_id").agg(F.count(F.lit(1)).alias("removed")), "place_id", "left").select("place_id", "before", F.coalesce("removed", F.lit(0)).alias("unknown"))


def geo_directional(spark, d):
    """Counties north-east of the middle of a grid laid out by code (no coordinates are registered)."""
    c = table(spark, d, "admin_geographies").where("geo_type = 'county'").select("geoid", F.substring("geoid", 1, 2).cast("double").alias("lat"), F.substring("geoid", 3, 3).cast("double").alias("lon"))
    return in_direction(c, "lat", "lon", (30.0, 90.0), "ne").select("geoid")


def geo_top_or_state(spark, d):
    """The ten most populous counties of all, and every county of one state."""
    c = table(spark, d, "admin_geographies").where("geo_type = 'county'").select("geoid", "population", "state_fips")
    return c.orderBy(F.desc("population"), "geoid").limit(10).select("geoid").union(c.where("state_fips = '03'").select("geoid")).distinct()


def modal_parent(spark, d):
    """The county most tracts of a place are in; of equal ones the one mapped first."""
    m = table(spark, d, "place_tract_map").where("place_id IS NOT NULL AND county_geoid IS NOT NULL AND county_geoid <> ''").groupBy("place_id", "county_geoid").agg(F.count(F.lit(1)).alias("n"), F.min("map_id").alias("first"))
    w = W.partitionBy("place_id").orderBy(F.desc("n"), "first")
    return m.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("place_id", "county_geoid", "n")


def nearest_buffer(spark, d):
    """The precomputed buffer width nearest to a wanted one; of equally near ones the smaller."""
    widths = F.array(*[F.lit(x) for x in (0.5, 1.0, 2.0, 3.0, 5.0)])
    m = table(spark, d, "place_tract_map").where("overlap_pct IS NOT NULL").select("map_id", (F.col("overlap_pct") * 6).alias("wanted"))
    near = F.array_min(F.transform(widths, lambda b: F.struct(F.abs(b - F.col("wanted")).alias("gap"), b.alias("width"))))
    return m.select("map_id", near.getField("width").alias("width"))


def best_overlap(spark, d):
    """The place that shares the most tracts with each place: shared tracts are counted through the tract, never place by place."""
    m = table(spark, d, "place_tract_map").where("place_id IS NOT NULL AND trim(tract_geoid) <> ''").select("place_id", F.trim("tract_geoid").alias("t")).distinct()
    n = m.select(F.col("place_id").alias("other"), "t")
    pairs = m.join(n, "t").where("place_id <> other").groupBy("place_id", "other").agg(F.count(F.lit(1)).alias("shared"))
    w = W.partitionBy("place_id").orderBy(F.desc("shared"), "other")
    return pairs.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("place_id", "other", "shared")


def place_overlap_kind(tract_share: Column, place_share: Column) -> Column:
    """Type of an overlap of a named place and a tract: none below a share of .05 of both, a tract with most of the place
    contains it, a tract mostly covered is the majority."""
    kind = F.when(place_share >= 0.95, "contains").when(tract_share >= 0.5, "majority").otherwise("intersects")
    return F.when(F.greatest(tract_share, place_share) >= 0.05, kind)


def overlap_typing(spark, d):
    """Overlap types from shares: tract share of .95 and more contains, of .5 and more is the majority, below .01 drops out."""
    m = table(spark, d, "place_tract_map").where("overlap_pct >= 0.01").select("map_id", F.round("overlap_pct", 4).alias("share"))
    return m.select("map_id", "share", F.when(F.col("share") >= 0.95, "contains").when(F.col("share") >= 0.5, "majority").otherwise("intersects").alias("kind"))


def value_ranks(spark, d):
    """Rank of each county within its state and year by value, highest first."""
    v = _values(spark, d).where("length(geo_id) = 5")
    w = W.partitionBy("table_id", "variable_id", "year", F.substring("geo_id", 1, 2)).orderBy(F.desc("value"), "geo_id")
    return v.select("table_id", "variable_id", "year", "geo_id", F.row_number().over(w).alias("rank"), F.round(F.col("value") - F.lead("value").over(w), 4).alias("margin"))


_FIRST = _SQL_CELLS + ", v AS (SELECT table_id, variable_id, year, geo_id, last_value AS value FROM c)"
_FRAMED = _FIRST + """, f AS (
  SELECT v.*, CASE WHEN v.value > 0 AND co.value > 0 AND v.value / co.value BETWEEN 0.1 AND 10 THEN v.value / co.value END AS vs_county,
         CASE WHEN v.value > 0 AND st.value > 0 AND v.value / st.value BETWEEN 0.1 AND 10 THEN v.value / st.value END AS vs_state,
         lag(v.year) OVER w AS prior_year, CASE WHEN lag(v.value) OVER w <> 0 THEN (v.value - lag(v.value) OVER w) / abs(lag(v.value) OVER w) END AS change_pct
  FROM v LEFT JOIN v co ON length(v.geo_id) = 11 AND co.geo_id = left(v.geo_id, 5) AND co.table_id = v.table_id AND co.variable_id = v.variable_id AND co.year = v.year
  LEFT JOIN v st ON length(v.geo_id) > 2 AND st.geo_id = left(v.geo_id, 2) AND st.table_id = v.table_id AND st.variable_id = v.variable_id AND st.year = v.year
  WINDOW w AS (PARTITION BY v.table_id, v.variable_id, v.geo_id ORDER BY v.year)
)
"""


def _case(x: str, steps: list[tuple[float, str]], last: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL " + " ".join(f"WHEN {x} < {b} THEN '{n}'" for b, n in steps) + f" ELSE '{last}' END"


_M = "(SELECT place_id, trim(tract_geoid) AS tract, map_id FROM place_tract_map WHERE trim(tract_geoid) <> '')"
QUERIES = {f.__name__: f for f in (geo_rollup, comparator_chain, magnitude_framing, anomaly_flags, trend_last5, trend_prior_period, year_as_of, geo_intersect, geo_difference, geo_directional, geo_top_or_state, modal_parent, nearest_buffer, best_overlap, overlap_typing, value_ranks, geo_compound_intersect, geo_compound_difference, framing_phrases)}
SQL = {
    "geo_rollup": "SELECT substr(geoid, 1, 2) AS state, substr(geoid, 1, 5) AS county, count(*) AS tracts, grouping(substr(geoid, 1, 2), substr(geoid, 1, 5))::INT AS level FROM (SELECT DISTINCT geoid FROM admin_geographies WHERE geo_type = 'tract') GROUP BY ROLLUP (substr(geoid, 1, 2), substr(geoid, 1, 5))",
    "comparator_chain": _FIRST + ", g AS (SELECT DISTINCT geo_id FROM v), x AS (SELECT geo_id, CASE WHEN length(geo_id) = 11 THEN [left(geo_id, 5), left(geo_id, 2), 'us'] WHEN length(geo_id) > 2 THEN [left(geo_id, 2), 'us'] ELSE ['us'] END AS chain FROM g) SELECT geo_id, (i - 1)::INT AS place, chain[i] AS comparator FROM x, range(1, 4) t(i) WHERE i <= len(chain)",
    "magnitude_framing": _FRAMED + f"SELECT table_id, year, geo_id, variable_id, round(vs_county, 6) AS vs_county, round(vs_state, 6) AS vs_state, coalesce({_case('coalesce(vs_state, vs_county)', FRAMES, TOP_FRAME)}, 'unknown') AS frame, prior_year, round(change_pct, 6) AS change_pct, {_case('change_pct', TRENDS, TOP_TREND)} AS trend FROM f",
    "anomaly_flags": _FRAMED + """, s AS (SELECT *, CASE WHEN vs_state IS NOT NULL AND (vs_county IS NULL OR abs(vs_state - 1) >= abs(vs_county - 1)) THEN 'state' WHEN vs_county IS NOT NULL THEN 'county' END AS strongest FROM f),
u AS (SELECT *, CASE WHEN strongest = 'county' THEN vs_county ELSE vs_state END AS best FROM s)
SELECT table_id, variable_id, year, geo_id, CASE WHEN best >= 1.5 THEN 'far_above_comparators' ELSE 'far_below_comparators' END AS flag, strongest AS against FROM u WHERE best >= 1.5 OR best <= 0.67
UNION ALL SELECT table_id, variable_id, year, geo_id, CASE WHEN change_pct >= 0.25 THEN 'trend_break_up' ELSE 'trend_break_down' END, NULL FROM u WHERE change_pct >= 0.25 OR change_pct <= -0.25""",
    "trend_last5": "SELECT table_id, array_to_string(list(year ORDER BY year DESC)[1:5], ',') AS years FROM (SELECT DISTINCT upper(trim(table_id)) AS table_id, year FROM stat_tables WHERE deleted_at IS NULL) GROUP BY 1",
    "trend_prior_period": _FIRST + ", w AS (SELECT *, lag(year) OVER x AS prior_year, lag(value) OVER x AS prior_value FROM v WINDOW x AS (PARTITION BY table_id, variable_id, geo_id ORDER BY year)) SELECT table_id, variable_id, geo_id, year, prior_year, prior_value, value FROM w WHERE year - prior_year <= 3",
    "year_as_of": "SELECT table_id, t::INT AS target, coalesce(max(year) FILTER (year <= t), min(year)) AS year FROM stat_tables, range(2008, 2026) r(t) GROUP BY 1, 2",
    "geo_intersect": f"SELECT place_id, array_to_string(list(tract ORDER BY map_id), ',') AS tracts FROM {_M} WHERE tract IN (SELECT geoid FROM admin_geographies WHERE geo_type = 'tract' AND deleted_at IS NULL) GROUP BY 1",
    "geo_difference": f"SELECT place_id, count(*) AS before, count(*) FILTER (tract NOT IN (SELECT geoid FROM admin_geographies WHERE geo_type = 'tract' AND deleted_at IS NULL)) AS \"unknown\" FROM {_M} GROUP BY 1",
    **{
        f"geo_compound_{how}": f"""WITH t AS (SELECT place_id AS place, trim(tract_geoid) AS tract, min(map_id) AS position FROM place_tract_map WHERE place_id IS NOT NULL AND trim(tract_geoid) <> '' GROUP BY 1, 2),
p AS (SELECT DISTINCT place AS "primary", other FROM (SELECT place, lead(place) OVER (PARTITION BY county ORDER BY place) AS other FROM (SELECT DISTINCT place, left(tract, 5) AS county FROM t)) WHERE other IS NOT NULL),
j AS (SELECT p."primary", p.other, a.tract, a.position, b.tract IS {yes} NULL AS keep FROM p JOIN t a ON a.place = p."primary" LEFT JOIN t b ON b.place = p.other AND b.tract = a.tract),
g AS (SELECT "primary", other, coalesce(array_to_string(list(tract ORDER BY position) FILTER (keep), ','), '') AS tracts, count(*) FILTER (NOT keep) AS removed, count(*) AS n FROM j GROUP BY 1, 2)
SELECT "primary", other, tracts, removed, 0.855::DOUBLE AS confidence, CASE WHEN removed = n THEN 'no tract is left' WHEN '{how}' = 'difference' AND removed = 0 THEN 'nothing was excluded' END AS note FROM g"""
        for how, yes in (("intersect", "NOT"), ("difference", ""))
    },
    "framing_phrases": _FRAMED + f""", said AS (SELECT *, coalesce(vs_state, vs_county) AS ratio, CASE WHEN vs_state IS NOT NULL THEN 'state' ELSE 'county' END AS which FROM f)
SELECT year, coalesce(nullif(concat_ws('; ', CASE WHEN ratio IS NOT NULL THEN {_case('ratio', PHRASES, TOP_PHRASE)} || ' ' || which || ' level (#×)' END, CASE WHEN change_pct IS NOT NULL THEN CASE WHEN change_pct >= 0 THEN 'up ' ELSE 'down ' END || '#% from #' END), ''), 'no comparator or trend context available') AS phrase, count(*) AS n FROM said GROUP BY 1, 2""",
    "geo_directional": "SELECT geoid FROM admin_geographies WHERE geo_type = 'county' AND substr(geoid, 1, 2)::DOUBLE > 30 AND substr(geoid, 3, 3)::DOUBLE > 90",
    "geo_top_or_state": "SELECT geoid FROM (SELECT geoid FROM admin_geographies WHERE geo_type = 'county' ORDER BY population DESC, geoid LIMIT 10) UNION SELECT geoid FROM admin_geographies WHERE geo_type = 'county' AND state_fips = '03'",
    "modal_parent": "SELECT place_id, county_geoid, n FROM (SELECT place_id, county_geoid, count(*) AS n, row_number() OVER (PARTITION BY place_id ORDER BY count(*) DESC, min(map_id)) AS rn FROM place_tract_map WHERE place_id IS NOT NULL AND county_geoid <> '' GROUP BY 1, 2) WHERE rn = 1",
    "nearest_buffer": "SELECT map_id, (list_sort([{'gap': abs(b - overlap_pct * 6), 'width': b} for b in [0.5::DOUBLE, 1.0, 2.0, 3.0, 5.0]])[1]).width AS width FROM place_tract_map WHERE overlap_pct IS NOT NULL",
    "best_overlap": "WITH m AS (SELECT DISTINCT place_id, trim(tract_geoid) AS t FROM place_tract_map WHERE place_id IS NOT NULL AND trim(tract_geoid) <> ''), p AS (SELECT a.place_id, b.place_id AS other, count(*) AS shared FROM m a JOIN m b ON a.t = b.t AND a.place_id <> b.place_id GROUP BY 1, 2) SELECT place_id, other, shared FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY shared DESC, other) AS rn FROM p) WHERE rn = 1",
    "overlap_typing": "SELECT map_id, round(overlap_pct, 4) AS share, CASE WHEN round(overlap_pct, 4) >= 0.95 THEN 'contains' WHEN round(overlap_pct, 4) >= 0.5 THEN 'majority' ELSE 'intersects' END AS kind FROM place_tract_map WHERE overlap_pct >= 0.01",
    "value_ranks": _FIRST + "SELECT table_id, variable_id, year, geo_id, (row_number() OVER w)::INT AS rank, round(value - lead(value) OVER w, 4) AS margin FROM v WHERE length(geo_id) = 5 WINDOW w AS (PARTITION BY table_id, variable_id, year, left(geo_id, 2) ORDER BY value DESC, geo_id)",
}
