"""Scalar normalisers as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..runtime import pad_left, table

#: Marks that stand for a missing figure (fixed values).
MISSING_MARKS = ["", "null", "N", "(X)", "*", "**", "***"]
CELL_FLOOR = -555555555.0
FEATURE_FLOOR = -1000000.0
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def cell_number(c: Column) -> Column:
    """A figure as text to double; marks, negative sentinels and anything unparsable become null."""
    t = F.trim(c.cast("string"))
    n = F.when(~t.isin(MISSING_MARKS) & t.rlike(_NUMBER), t.try_cast("double"))
    return F.when(n > CELL_FLOOR, n)


def feature_number(c: Column) -> Column:
    """The feature reader's variant: a higher sentinel cut-off and no list of marks."""
    t = F.trim(c.cast("string"))
    n = F.when(t.rlike(_NUMBER), t.try_cast("double"))
    return F.when(n > FEATURE_FLOOR, n)


def snake_name(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), F.lit("_"))


def column_name(c: Column, width: int = 40) -> Column:
    """A snake name fit for a column: prefixed where it starts with a digit, cut at ``width``."""
    s = snake_name(c)
    return F.substring(F.when(s.rlike("^[0-9]"), F.concat(F.lit("v_"), s)).otherwise(s), 1, width)


def tract_code(c: Column) -> Column:
    """An 11-digit tract id, or null unless the text is 1 to 11 digits."""
    t = F.trim(c)
    return F.when(t.rlike("^[0-9]{1,11}$"), F.lpad(t, 11, "0"))


def assembled_geo_id(level: Column, state: Column, county: Column, tract: Column, place: Column, msa: Column) -> Column:
    s, c = pad_left(state, 2), pad_left(county, 3)
    return (
        F.when(level == "state", s)
        .when(level == "county", F.concat(s, c))
        .when(level == "tract", F.concat(s, c, pad_left(tract, 6)))
        .when(level == "place", F.concat(s, pad_left(place, 5)))
        .when(level == "msa", pad_left(msa, 5))
    )


def stable_id(dataset: str, name: Column) -> Column:
    """The first 12 hex digits of the SHA-256 of ``dataset:name`` (trimmed, lower case)."""
    return F.substring(F.sha2(F.concat(F.lit(f"{dataset}:"), F.lower(F.trim(name))), 256), 1, 12)


def stable_digest(text: Column, length: int = 16, kind: str = "sha256") -> Column:
    """The first hex digits of a text's SHA-256 or SHA-1, as a fingerprint or an id."""
    return F.substring(F.sha1(text) if kind == "sha1" else F.sha2(text, 256), 1, length)


def record_id(dataset: str, year: Column, stem: Column, number: Column) -> Column:
    return F.concat_ws(":", F.lit(dataset), year.cast("string"), stem, F.lpad(number.cast("string"), 12, "0"))


def lookup_key(c: Column) -> Column:
    """Lower case, dashes folded, punctuation out, white space collapsed."""
    t = F.translate(F.lower(c), "–—‐-", "    ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^\w\s]", ""), r"\s+", " "))


def shown_number(c: Column) -> Column:
    """Whole numbers without a decimal point, others with six significant digits and no zeros at the end.

    As usual for six digits, numbers of under 0.0001 and of a million and more have an exponent."""
    bare = lambda t: F.regexp_replace(F.regexp_replace(t, "0+$", ""), r"\.$", "")
    exponent = F.regexp_extract(F.format_string("%.5e", c), r"e([+-]\d+)$", 1).cast("int")
    out = F.concat(bare(F.substring_index(F.format_string("%.5e", c), "e", 1)), F.lit("e"), F.substring_index(F.format_string("%.5e", c), "e", -1))
    for e in range(-4, 6):
        text = F.format_string(f"%.{5 - e}f", c)
        out = F.when(exponent == e, bare(text) if e < 5 else text).otherwise(out)
    return F.when(c == F.floor(c), F.format_string("%d", c.cast("bigint"))).otherwise(out)


def when_chain(x: Column, steps: list[tuple[float, str]], last: str) -> Column:
    """The label of the first bound that ``x`` is strictly below, else ``last``; null stays null."""
    return reduce(lambda w, s: w.when(x < s[0], s[1]), steps, F.when(x.isNull(), None)).otherwise(last)


def h1_cell_numbers(spark, d):
    sv = table(spark, d, "stat_values").select("geo_level", cell_number(F.coalesce(F.col("annotation"), F.col("estimate").cast("string"))).alias("a"), feature_number(F.col("annotation")).alias("b"), cell_number(F.col("estimate").cast("decimal(20,2)")).alias("e"))
    return sv.groupBy("geo_level").agg(F.count("b").alias("annotation_numbers"), F.count("e").alias("estimates"), F.round(F.sum("e"), 2).alias("estimate_sum"), F.round(F.sum("b"), 2).alias("annotation_sum"))


def h2_column_names(spark, d):
    v = table(spark, d, "variables").select(snake_name(F.col("label_natural")).alias("snake"), column_name(F.col("label_natural")).alias("col_name"))
    return v.groupBy("snake", "col_name").agg(F.count(F.lit(1)).alias("uses"))


def h4_geo_ids(spark, d):
    c = F.col
    sv = table(spark, d, "stat_values").select("geo_level", assembled_geo_id(c("geo_level"), c("state_fips"), c("county_fips"), c("tract_ce"), c("place_fips"), c("msa_code")).alias("g"), F.trim("geo_id").alias("raw"))
    return sv.groupBy("geo_level").agg(F.countDistinct("g").alias("geographies"), F.sum((F.length("g") > F.length("raw")).cast("bigint")).alias("zeros_restored"), F.min("g").alias("first_geo"), F.max("g").alias("last_geo"))


def h5_geoid_parts(spark, d):
    t = table(spark, d, "admin_geographies").where("geo_type = 'tract'")
    return t.groupBy(F.substring("geoid", 1, 2).alias("state"), F.substring("geoid", 3, 3).alias("county")).agg(F.count(F.lit(1)).alias("tracts"), F.min(F.substring("geoid", 6, 6)).alias("first_tract"))


def h6_tract_codes(spark, d):
    m = table(spark, d, "place_tract_map").select(tract_code(F.col("tract_geoid")).alias("t"), F.col("tract_geoid").alias("raw"))
    return m.groupBy(F.when(F.col("t").isNull(), "unusable").when(F.col("t") == F.col("raw"), "as is").otherwise("padded").alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("t").alias("codes"))


def h7_stable_ids(spark, d):
    return table(spark, d, "variables").select("dataset", "variable_id", stable_id("acs", F.col("variable_id")).alias("stable_id"), F.substring(F.sha2("label_natural", 256), 1, 16).alias("fingerprint")).distinct()


def h8_record_ids(spark, d):
    from pyspark.sql import Window as W

    h = table(spark, d, "hmda_lar").dropDuplicates()
    rn = F.row_number().over(W.partitionBy("source_file").orderBy("record_id", "lender_key", "loaded_at")) - 1
    return h.select(record_id("lar", F.col("activity_year"), F.col("source_file"), rn).alias("generated_id"), F.col("record_id").alias("filed_id"))


def h10_lookup_keys(spark, d):
    return table(spark, d, "admin_geographies").select("geo_type", lookup_key(F.col("name")).alias("name_key")).groupBy("geo_type", "name_key").agg(F.count(F.lit(1)).alias("n"))


def h13_card_text(spark, d):
    """Text put together from title and optional parts; a missing title gives none."""
    c = F.col
    t = F.trim(F.concat(c("title"), F.lit(". "), F.coalesce(c("description"), F.lit("")), F.lit(" "), F.coalesce(c("use_when"), F.lit(""))))
    return table(spark, d, "stat_tables").select("table_id", "dataset", "year", t.alias("card_text")).distinct()


def h15_json_lists(spark, d):
    """JSON arrays to sorted distinct lists; malformed or missing ones are empty."""
    parsed = F.coalesce(F.from_json("l1_domains_json", "array<string>"), F.array().cast("array<string>"))
    s = table(spark, d, "stat_tables").select(F.array_sort(F.array_distinct(parsed)).alias("domains"))
    return s.groupBy(F.array_join("domains", "|").alias("domains")).agg(F.count(F.lit(1)).alias("n"))


def h28_shown_values(spark, d):
    sv = table(spark, d, "stat_values").where("estimate > -555555555").select("geo_level", shown_number(F.col("estimate")).alias("shown"))
    return sv.groupBy("geo_level", "shown").agg(F.count(F.lit(1)).alias("n"))


_NUM = "regexp_full_match(trim(%s), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')"
QUERIES = {"h1_cell_numbers": h1_cell_numbers, "h2_column_names": h2_column_names, "h4_geo_ids": h4_geo_ids, "h5_geoid_parts": h5_geoid_parts, "h6_tract_codes": h6_tract_codes, "h7_stable_ids": h7_stable_ids, "h8_record_ids": h8_record_ids, "h10_lookup_keys": h10_lookup_keys, "h13_card_text": h13_card_text, "h15_json_lists": h15_json_lists, "h28_shown_values": h28_shown_values}
SQL = {
    "h1_cell_numbers": f"""SELECT geo_level, count(b) AS annotation_numbers, count(e) AS estimates, round(sum(e), 2) AS estimate_sum, round(sum(b), 2) AS annotation_sum
FROM (SELECT geo_level, CASE WHEN {_NUM % "annotation"} AND try_cast(trim(annotation) AS DOUBLE) > -1000000 THEN try_cast(trim(annotation) AS DOUBLE) END AS b, CASE WHEN estimate > -555555555 THEN round(estimate, 2) END AS e FROM stat_values) GROUP BY geo_level""",
    "h2_column_names": """SELECT snake, substr(CASE WHEN regexp_matches(snake, '^[0-9]') THEN 'v_' || snake ELSE snake END, 1, 40) AS col_name, count(*) AS uses
FROM (SELECT trim(regexp_replace(lower(trim(label_natural)), '[^a-z0-9]+', '_', 'g'), '_') AS snake FROM variables) GROUP BY 1, 2""",
    "h4_geo_ids": """WITH x AS (SELECT geo_level, trim(geo_id) AS raw, CASE WHEN length(state_fips) < 2 THEN lpad(state_fips, 2, '0') ELSE state_fips END AS s,
 CASE WHEN length(county_fips) < 3 THEN lpad(county_fips, 3, '0') ELSE county_fips END AS co, CASE WHEN length(tract_ce) < 6 THEN lpad(tract_ce, 6, '0') ELSE tract_ce END AS tr,
 CASE WHEN length(place_fips) < 5 THEN lpad(place_fips, 5, '0') ELSE place_fips END AS pl, CASE WHEN length(msa_code) < 5 THEN lpad(msa_code, 5, '0') ELSE msa_code END AS ms FROM stat_values),
y AS (SELECT geo_level, raw, CASE geo_level WHEN 'state' THEN s WHEN 'county' THEN s || co WHEN 'tract' THEN s || co || tr WHEN 'place' THEN s || pl WHEN 'msa' THEN ms END AS g FROM x)
SELECT geo_level, count(DISTINCT g) AS geographies, sum((length(g) > length(raw))::INT)::BIGINT AS zeros_restored, min(g) AS first_geo, max(g) AS last_geo FROM y GROUP BY 1""",
    "h5_geoid_parts": "SELECT substr(geoid, 1, 2) AS state, substr(geoid, 3, 3) AS county, count(*) AS tracts, min(substr(geoid, 6, 6)) AS first_tract FROM admin_geographies WHERE geo_type = 'tract' GROUP BY 1, 2",
    "h6_tract_codes": """SELECT CASE WHEN t IS NULL THEN 'unusable' WHEN t = tract_geoid THEN 'as is' ELSE 'padded' END AS outcome, count(*) AS n, count(DISTINCT t) AS codes
FROM (SELECT tract_geoid, CASE WHEN regexp_full_match(trim(tract_geoid), '[0-9]{1,11}') THEN lpad(trim(tract_geoid), 11, '0') END AS t FROM place_tract_map) GROUP BY 1""",
    "h7_stable_ids": "SELECT DISTINCT dataset, variable_id, substr(sha256('acs:' || lower(trim(variable_id))), 1, 12) AS stable_id, substr(sha256(label_natural), 1, 16) AS fingerprint FROM variables",
    "h8_record_ids": """SELECT 'lar:' || activity_year || ':' || source_file || ':' || lpad((row_number() OVER (PARTITION BY source_file ORDER BY record_id, lender_key, loaded_at) - 1)::VARCHAR, 12, '0') AS generated_id, record_id AS filed_id
FROM (SELECT DISTINCT * FROM hmda_lar)""",
    "h10_lookup_keys": "SELECT geo_type, trim(regexp_replace(regexp_replace(translate(lower(name), '–—‐-', '    '), '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g')) AS name_key, count(*) AS n FROM admin_geographies GROUP BY 1, 2",
    "h13_card_text": "SELECT DISTINCT table_id, dataset, year, trim(title || '. ' || coalesce(description, '') || ' ' || coalesce(use_when, '')) AS card_text FROM stat_tables",
    "h15_json_lists": "SELECT array_to_string(list_sort(list_distinct(coalesce(CASE WHEN json_valid(l1_domains_json) THEN from_json(l1_domains_json, '[\"VARCHAR\"]') END, []))), '|') AS domains, count(*) AS n FROM stat_tables GROUP BY 1",
    "h28_shown_values": "SELECT geo_level, CASE WHEN estimate = floor(estimate) THEN estimate::BIGINT::VARCHAR ELSE printf('%.6g', estimate) END AS shown, count(*) AS n FROM stat_values WHERE estimate > -555555555 GROUP BY 1, 2",
}
