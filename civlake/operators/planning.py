"""Requests before and after fetching: merged results with their status, order of calls, caps, labels and typing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.normalize import lookup_key
from ..runtime import blank_to_null, table
from .metadata import tid

#: Data level at which an area's values are asked, by the level of the area (fixed values).
DATA_LEVELS = {"tract": "tract", "neighborhood": "tract", "region": "tract", "corridor": "tract", "landmark_area": "tract", "county": "county", "place": "place", "msa": "msa", "state": "state", "us": "us", "school_district_unified": "school_district_unified", "zcta": "zcta"}
MOST_COMPARATORS = 4
#: Words of a label and the meaning they give a column, the first that fits counts (fixed values).
MEANINGS = [("percentage", ("percent", "pct", "rate", "%")), ("summary_statistic", ("median", "mean", "average")), ("count", ("count", "number", "total", "population")), ("identifier", ("name", "code", "fips", "id"))]
DATA_TYPES = {"int": "integer", "float": "float", "string": "string"}
#: Labels of a rate by the outcomes its numerator counts (fixed values); all of the outcomes must be there.
RATE_LABELS = [(("application denied",), "mortgage denial rate"), (("loan originated", "application approved but not accepted"), "mortgage approval rate"), (("loan originated",), "mortgage origination rate")]


def data_level(level: Column, tracts: Column) -> Column:
    """The level to ask for: tracts for anything that has a list of them, else what the area's level maps to (itself if unknown)."""
    m = F.create_map(*[F.lit(x) for kv in DATA_LEVELS.items() for x in kv])
    return F.when((F.size(tracts) > 0) & (level != "tract"), "tract").otherwise(F.coalesce(m[level], level))


def call_results(calls: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """Every call's rows from the source its dataset names, in the order of the calls, with a status for each call.

    ``calls``: call_id, dataset, key, position (call_id where there is none).  Each source: key and its own columns.  status: ``ok``, ``empty`` (the source has
    nothing for the key), ``no_source`` (no source of that dataset) or ``bad_request`` (no key); the last three give one
    row with error.  Columns that a source lacks are null.
    """
    asked = calls if "position" in calls.columns else calls.withColumn("position", F.col("call_id"))
    known = F.col("dataset").isin(list(sources))
    parts = []
    for name, df in sources.items():
        own = asked.where((F.col("dataset") == name) & F.col("key").isNotNull())
        parts.append(own.join(df.withColumn("found", F.lit(True)), "key", "left").withColumn("status", F.when(F.col("found"), "ok").otherwise("empty")).drop("found"))
    rest = asked.where(F.col("key").isNull() | ~F.coalesce(known, F.lit(False)))
    parts.append(rest.withColumn("status", F.when(F.col("key").isNull(), "bad_request").otherwise("no_source")))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    said = {"empty": "no rows for the key", "no_source": "no source of that dataset", "bad_request": "the call has no key"}
    error = F
    for k, v in said.items():
        error = error.when(F.col("status") == k, v)
    return out.withColumn("error", error)


def capped_chain(chain: DataFrame, by: list[str], order: str, most: int = MOST_COMPARATORS) -> DataFrame:
    """The first ``most`` comparators of each chain."""
    w = W.partitionBy(*by).orderBy(order)
    return chain.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most).drop("__r")


def ordered_distinct(items: Column) -> Column:
    """The items of an array, each at its first place; nulls and blanks drop out."""
    return F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (F.trim(x) != "")))


def merged_concepts(have: DataFrame, wanted: DataFrame, by: str, text: str) -> DataFrame:
    """The concepts a request has, and those wanted besides whose normalised text it lacks; source: ``request`` or ``added``."""
    key = lambda df: df.withColumn("__k", lookup_key(F.col(text)))
    own = key(have)
    new = key(wanted).dropDuplicates([by, "__k"]).join(own.select(by, "__k").distinct(), [by, "__k"], "left_anti")
    cols = [by, text]
    return own.select(*cols, F.lit("request").alias("source")).unionByName(new.select(*cols, F.lit("added").alias("source")))


def recognised(analyses: DataFrame, known: list[str], name: str) -> DataFrame:
    """The analyses whose normalised name is known; the others drop out."""
    keys = spark_keys(known)
    return analyses.where(F.array_contains(keys, lookup_key(F.col(name))))


def spark_keys(names: list[str]) -> Column:
    return F.transform(F.array(*[F.lit(n) for n in names]), lookup_key)


def expanded(frames: DataFrame, requests: DataFrame, present: DataFrame) -> DataFrame:
    """What the frames a request matches require and the request does not have yet: request, concept.

    ``frames``: frame, concept; ``requests``: request, frame; ``present``: request, concept."""
    return requests.join(frames, "frame").select("request", "concept").distinct().join(present.select("request", "concept"), ["request", "concept"], "left_anti")


def rate_label(values: Column) -> Column:
    """Label of a rate whose numerator counts the given outcomes (an array of text, any case); null if none is known."""
    v = F.transform(values, lambda x: F.lower(F.trim(x)))
    out = F
    for needs, label in RATE_LABELS:
        out = out.when(reduce(lambda a, b: a & b, [F.array_contains(v, n) for n in needs]), label)
    return out


def flat_typing(label: Column, predicate_type: Column) -> tuple[Column, Column]:
    """Data type and meaning of a column of a table without a label hierarchy."""
    m = F.create_map(*[F.lit(x) for kv in DATA_TYPES.items() for x in kv])
    low = F.lower(F.coalesce(label, F.lit("")))
    meaning = F
    for name, words in MEANINGS:
        meaning = meaning.when(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), name)
    return F.coalesce(m[F.coalesce(predicate_type, F.lit(""))], F.lit("unknown")), meaning.otherwise("unknown")


def shown(value: Column, kind: Column) -> Column:
    """A value for reading: percent with one decimal, currency and counts with thousands commas, else two decimals."""
    whole = F.format_string("%,d", F.round(value).cast("bigint"))
    return F.when(kind == "percentage", F.format_string("%.1f%%", value)).when(kind == "currency", F.concat(F.lit("$"), whole)).when(kind == "count", whole).otherwise(F.format_string("%,.2f", value))


def short_population(n: Column) -> Column:
    """Population in words: 1.2M, 35k, or the number itself."""
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1e6)).when(n >= 10_000, F.format_string("%dk", (n / 1000).cast("bigint"))).otherwise(F.format_string("%,d", n))


# queries


def a9_call_status(spark, d):
    """Coverage checks as calls to two sources: outcome per dataset and status."""
    calls = table(spark, d, "coverage").select(F.col("coverage_id").alias("call_id"), "dataset", blank_to_null(F.upper("table_id")).alias("key"), F.col("coverage_id").alias("position"))
    t = table(spark, d, "stat_tables").select("dataset", tid().alias("key")).distinct()
    names = ["acs5", "acs1"]
    r = call_results(calls, {n: t.where(F.col("dataset") == n).select("key") for n in names})
    return r.groupBy("dataset", "status", "error").agg(F.count(F.lit(1)).alias("calls"), F.min("position").alias("first"))


def a10_call_order(spark, d):
    """The first and last call of each status in the order in which they were made."""
    calls = table(spark, d, "coverage").select(F.col("coverage_id").alias("call_id"), "dataset", blank_to_null(F.upper("table_id")).alias("key"), F.col("coverage_id").alias("position"))
    t = table(spark, d, "stat_tables").select("dataset", tid().alias("key")).distinct()
    r = call_results(calls, {"acs5": t.where("dataset = 'acs5'").select("key")})
    return r.groupBy("status").agg(F.min_by("call_id", "position").alias("first_call"), F.max_by("call_id", "position").alias("last_call"))


def f10_capped_comparators(spark, d):
    """Of the places that map a tract, the first four in the order they were mapped."""
    m = table(spark, d, "place_tract_map").where("place_id IS NOT NULL AND trim(tract_geoid) <> ''").select(F.trim("tract_geoid").alias("tract"), "place_id", "map_id")
    return capped_chain(m, ["tract"], "map_id").select("tract", "place_id", "map_id")


def g9_ordered_ids(spark, d):
    """Variable ids of each table in the order of their first question, each once."""
    q = table(spark, d, "variable_questions").groupBy(tid().alias("table_id")).agg(F.array_sort(F.collect_list(F.struct("question_id", F.trim("var_id").alias("v")))).alias("x"))
    return q.select("table_id", F.array_join(ordered_distinct(F.transform("x", lambda s: s.v)), ",").alias("ids"))


def p21_merged_concepts(spark, d):
    """Questions of a table with those of its variables that it lacks, in other spelling the same."""
    have = table(spark, d, "table_questions").where("question_text IS NOT NULL AND table_id IS NOT NULL").select(tid().alias("t"), F.col("question_text").alias("concept"))
    want = table(spark, d, "variable_questions").where("question_text IS NOT NULL AND table_id IS NOT NULL").select(tid().alias("t"), F.col("question_text").alias("concept"))
    return merged_concepts(have, want, "t", "concept").groupBy("t", "source").agg(F.count(F.lit(1)).alias("n"))


def t13_frame_expansion(spark, d):
    """Card types of a subject area that a table of that area has no card of."""
    c = table(spark, d, "cards").where("subject_area IS NOT NULL AND trim(target_table_id) <> ''").select("subject_area", "card_type", tid("target_table_id").alias("t"))
    frames = c.select(F.col("subject_area").alias("frame"), F.col("card_type").alias("concept")).distinct()
    req = c.select(F.col("t").alias("request"), F.col("subject_area").alias("frame")).distinct()
    return expanded(frames, req, c.select(F.col("t").alias("request"), F.col("card_type").alias("concept")).distinct())


def t16_data_levels(spark, d):
    """Level at which each kind of area is asked, with and without a list of tracts."""
    g = table(spark, d, "admin_geographies").where("deleted_at IS NULL").select("geo_type", F.col("geoid"))
    has = table(spark, d, "place_tract_map").where("trim(tract_geoid) <> ''").groupBy(F.col("place_id").alias("geoid")).agg(F.collect_set("tract_geoid").alias("tracts"))
    j = g.join(has, "geoid", "left")
    return j.groupBy("geo_type", data_level(F.col("geo_type"), F.coalesce("tracts", F.array().cast("array<string>"))).alias("level")).agg(F.count(F.lit(1)).alias("n"))


def t17_rate_labels(spark, d):
    """Label of the rate that each set of outcomes of a state and year makes."""
    names = F.create_map(F.lit("1"), F.lit("Loan originated"), F.lit("2"), F.lit("Application approved but not accepted"), F.lit("3"), F.lit(" Application denied "))
    s = table(spark, d, "hmda_lar").groupBy("state_code", "activity_year").agg(F.collect_set(names[F.col("action_taken")]).alias("v"))
    drop = F.filter("v", lambda x: ~F.lower(x).contains("denied"))
    return s.select("state_code", "activity_year", rate_label(F.col("v")).alias("label"), rate_label(drop).alias("without_denials"))


def q6_flat_types(spark, d):
    """Data types and meanings of columns, as of tables without a hierarchy of labels."""
    kind, meaning = flat_typing(F.col("label_natural"), F.col("predicate_type"))
    return table(spark, d, "variables").groupBy(tid().alias("table_id"), kind.alias("data_type"), meaning.alias("meaning")).agg(F.count(F.lit(1)).alias("n"))


def h24_shown_populations(spark, d):
    """Populations as they are said."""
    return table(spark, d, "admin_geographies").where("population IS NOT NULL").select("geoid", "registered_at", short_population(F.col("population")).alias("said"), shown(F.col("population").cast("double"), F.lit("count")).alias("count")).distinct()


_T = "upper(trim(table_id, E' \\t\\n\\r\\f\\v'))"
_C = f"(SELECT coverage_id, dataset, nullif({_T}, '') AS k FROM coverage)"
_S = f"(SELECT DISTINCT dataset, {_T} AS k FROM stat_tables)"
_SAID = "CASE status WHEN 'empty' THEN 'no rows for the key' WHEN 'no_source' THEN 'no source of that dataset' WHEN 'bad_request' THEN 'the call has no key' END"
_KEY = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
QUERIES = {f.__name__: f for f in (a9_call_status, a10_call_order, f10_capped_comparators, g9_ordered_ids, p21_merged_concepts, t13_frame_expansion, t16_data_levels, t17_rate_labels, q6_flat_types, h24_shown_populations)}
SQL = {
    "a9_call_status": f"WITH r AS (SELECT c.dataset, c.coverage_id, CASE WHEN c.k IS NULL THEN 'bad_request' WHEN c.dataset NOT IN ('acs5', 'acs1') OR c.dataset IS NULL THEN 'no_source' WHEN s.k IS NOT NULL THEN 'ok' ELSE 'empty' END AS status FROM {_C} c LEFT JOIN {_S} s ON s.dataset = c.dataset AND s.k = c.k) SELECT dataset, status, {_SAID} AS error, count(*) AS calls, min(coverage_id) AS first FROM r GROUP BY 1, 2",
    "a10_call_order": f"WITH r AS (SELECT c.coverage_id, CASE WHEN c.k IS NULL THEN 'bad_request' WHEN c.dataset <> 'acs5' OR c.dataset IS NULL THEN 'no_source' WHEN s.k IS NOT NULL THEN 'ok' ELSE 'empty' END AS status FROM {_C} c LEFT JOIN {_S} s ON s.dataset = c.dataset AND s.k = c.k) SELECT status, min(coverage_id) AS first_call, max(coverage_id) AS last_call FROM r GROUP BY 1",
    "f10_capped_comparators": "SELECT trim(tract_geoid) AS tract, place_id, map_id FROM place_tract_map WHERE place_id IS NOT NULL AND trim(tract_geoid) <> '' QUALIFY row_number() OVER (PARTITION BY trim(tract_geoid) ORDER BY map_id) <= 4",
    "g9_ordered_ids": f"SELECT t.table_id, coalesce(o.ids, '') AS ids FROM (SELECT DISTINCT {_T} AS table_id FROM variable_questions) t LEFT JOIN (SELECT table_id, array_to_string(list(v ORDER BY q), ',') AS ids FROM (SELECT {_T} AS table_id, trim(var_id) AS v, min(question_id) AS q FROM variable_questions WHERE trim(var_id) <> '' GROUP BY 1, 2) GROUP BY 1) o ON o.table_id IS NOT DISTINCT FROM t.table_id",
    "t13_frame_expansion": "WITH c AS (SELECT DISTINCT subject_area, card_type, upper(trim(target_table_id, E' \\t\\n\\r\\f\\v')) AS t FROM cards WHERE subject_area IS NOT NULL AND trim(target_table_id) <> '') SELECT DISTINCT r.t AS request, f.card_type AS concept FROM c r JOIN c f ON f.subject_area = r.subject_area WHERE NOT EXISTS (SELECT 1 FROM c x WHERE x.t = r.t AND x.card_type IS NOT DISTINCT FROM f.card_type)",
    "t16_data_levels": "SELECT geo_type, CASE WHEN p.place_id IS NOT NULL AND geo_type <> 'tract' THEN 'tract' ELSE geo_type END AS level, count(*) AS n FROM admin_geographies g LEFT JOIN (SELECT DISTINCT place_id FROM place_tract_map WHERE trim(tract_geoid) <> '') p ON p.place_id = g.geoid WHERE deleted_at IS NULL GROUP BY 1, 2",
    "t17_rate_labels": "WITH s AS (SELECT state_code, activity_year, bool_or(coalesce(action_taken, '') = '1') AS o, bool_or(coalesce(action_taken, '') = '2') AS a, bool_or(coalesce(action_taken, '') = '3') AS n FROM hmda_lar GROUP BY 1, 2) SELECT state_code, activity_year, CASE WHEN n THEN 'mortgage denial rate' WHEN o AND a THEN 'mortgage approval rate' WHEN o THEN 'mortgage origination rate' END AS label, CASE WHEN o AND a THEN 'mortgage approval rate' WHEN o THEN 'mortgage origination rate' END AS without_denials FROM s",
    "q6_flat_types": f"SELECT {_T} AS table_id, CASE predicate_type WHEN 'int' THEN 'integer' WHEN 'float' THEN 'float' WHEN 'string' THEN 'string' ELSE 'unknown' END AS data_type, CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(coalesce(label_natural, '')), '{w}')" for w in ws) + f" THEN '{n}'" for n, ws in MEANINGS) + " ELSE 'unknown' END AS meaning, count(*) AS n FROM variables GROUP BY 1, 2, 3",
    "h24_shown_populations": "SELECT DISTINCT geoid, registered_at, CASE WHEN population >= 1000000 THEN printf('%.1fM', population / 1e6) WHEN population >= 10000 THEN (population // 1000)::VARCHAR || 'k' ELSE format('{:,}', population) END AS said, format('{:,}', population) AS count FROM admin_geographies WHERE population IS NOT NULL",
}
