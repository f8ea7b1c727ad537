"""Resolution and planning over metadata: names to areas, aliases to canonical values, candidates to choices, calls to rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.normalize import lookup_key
from ..runtime import pad_left, table
from .metadata import latest, segments, tid
from .search import SUBGROUP_MARKS, tokens

#: Suffixes that an alias of an area drops (fixed values).
SUFFIXES = r"\s+(county|city|town|village|cdp|borough|parish|municipality)$"
LEVELS = ["us", "state", "county", "place", "tract", "msa"]
CONFIDENT, GAP = 0.90, 0.10
SECOND_BEST = 0.90


@dataclass(frozen=True)
class Call:
    """What is fetched for one area, year and role."""

    geo_id: str
    year: int
    role: str = "primary"


def picked_years(supported: list[int], wanted: str, target: int | None = None, lookback: int = 3, most: int = 5) -> list[int]:
    """Years of a plan: ``latest`` (at or before the target), ``change`` (that and one before within the lookback) or ``trend`` (the last five)."""
    have = sorted(set(supported))
    upto = [y for y in have if target is None or y <= target] or have[:1]
    if not upto:
        return []
    if wanted == "trend":
        return upto[-most:]
    if wanted == "change":
        before = [y for y in upto[:-1] if upto[-1] - y <= lookback]
        return before[-1:] + upto[-1:]
    return upto[-1:]


def calls(spark, geo_ids: list[str], years: list[int], groups: dict[str, list[str]]) -> DataFrame:
    """The plan as a table: every area, year and combination of group values with its role label."""
    combos = [";".join(f"{k}={v}" for k, v in zip(sorted(groups), c, strict=True)) for c in product(*(groups[k] for k in sorted(groups)))]
    latest_year = max(years) if years else None
    rows = [(g, y, ("primary" if y == latest_year else "prior_period") + (f".group_{c}" if c else "")) for g in geo_ids for y in years for c in combos or [""]]
    return spark.createDataFrame(rows, "geo_id string, year int, role string")


def canonical(value: Column, exact: dict[str, str], aliases: dict[str, str]) -> Column:
    """Exact canonical values first, then aliases, else the value itself; upper and lower case are the same."""
    as_map = lambda m: F.create_map(*[x for k, v in m.items() for x in (F.lit(k.lower()), F.lit(v))]) if m else F.lit(None)
    k = F.lower(F.trim(value))
    return F.coalesce(as_map(exact)[k], as_map(aliases)[k], value)


def aliases_of(names: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """Aliases of each name: itself, without its suffix, and ``<suffix> of <rest>``; keys only, repeats out."""
    n = F.trim(F.col(name_col))
    short = F.regexp_replace(F.lower(n), SUFFIXES, "")
    kind = F.regexp_extract(F.lower(n), SUFFIXES, 1)
    forms = F.array_compact(F.array(F.struct(lookup_key(n).alias("alias"), F.lit("full").alias("kind")), F.when(short != F.lower(n), F.struct(lookup_key(short).alias("alias"), F.lit("short").alias("kind"))), F.when(kind != "", F.struct(lookup_key(F.concat(kind, F.lit(" of "), short)).alias("alias"), F.lit("of").alias("kind")))))
    return names.select(F.col(id_col).alias("id"), F.explode(forms).alias("x")).select("id", "x.alias", "x.kind").where("alias <> ''").distinct()


def resolved(names: DataFrame, registry: DataFrame, most: int = 3) -> DataFrame:
    """Each asked name with up to ``most`` areas, best first, and its confidence.

    ``names``: asked (text).  ``registry``: id, alias, kind, population.  Exact full names come first, then aliases; of
    equal ones the more populous.  Confidence falls with the rank and, where the runner-up is of the same kind, by GAP.
    """
    tier = F.when(F.col("kind") == "full", 0).when(F.col("kind") == "of", 1).otherwise(2)
    j = names.select("asked", lookup_key(F.col("asked")).alias("alias")).join(registry, "alias").withColumn("tier", tier)
    j = latest(j, ["asked", "id"], ["tier"])
    w = W.partitionBy("asked").orderBy("tier", F.desc_nulls_last("population"), "id")
    j = j.withColumn("rank", F.row_number().over(w)).withColumn("next_tier", F.lead("tier").over(w))
    conf = F.round(1 / (1 + 0.25 * (F.col("rank") - 1)) - F.col("tier") * 0.05 - F.when(F.col("next_tier") == F.col("tier"), GAP).otherwise(0.0), 4)
    return j.where(F.col("rank") <= most).select("asked", "id", "rank", conf.alias("confidence"), (conf < CONFIDENT).alias("ask_back"))


def _any_of(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


_COUNTED = ("total ", "number ", "count ", "aggregate ")


def measure_score(label: Column, sought: str | None) -> Column:
    """How well a label fits the kind of measure that is sought: percentage, count, currency, median or none."""
    t = F.lower(label)
    begins = reduce(lambda a, b: a | b, [t.startswith(p) for p in _COUNTED])
    if sought == "percentage":
        return F.when(_any_of(t, ("percent", "share", " rate")), 3).when(begins, -3).otherwise(0)
    if sought == "count":
        return F.when(_any_of(t, _COUNTED), 2).when(t.startswith("percent"), -3).otherwise(0)
    if sought == "currency":
        return F.when(_any_of(t, ("median", "mean", "aggregate")), 3).otherwise(0)
    if sought == "median":
        return F.when(t.contains("median"), 4).otherwise(0)
    return F.lit(0)


def variable_score(label: Column, is_total: Column, depth: Column, common: Column, sought: str | None = None, in_top_table: Column | None = None, rank: Column | None = None, routed: Column | None = None, total_likely: bool | None = None, of_subgroup: bool = False) -> Column:
    """Score of a candidate variable (fixed values): +5 in the best table, its place and score among the routed, -8 for a label
    of a subgroup, the fit of its measure, -3 for each step of depth below the first, +0.5 if commonly asked, for and against
    totals as they are likely, -6 for a total when a subgroup is asked for."""
    low = F.lower(F.coalesce(label, F.lit("")))
    s = F.when(_any_of(low, SUBGROUP_MARKS), -8.0).otherwise(0.0) + F.coalesce(measure_score(label, sought), F.lit(0)) - F.coalesce(F.greatest(depth - 1, F.lit(0)), F.lit(0)) * 3.0 + F.when(common == 1, 0.5).otherwise(0.0)
    total = F.coalesce(is_total == 1, F.lit(False))
    if in_top_table is not None:
        s = s + F.when(in_top_table, 5.0).otherwise(0.0)
    if rank is not None:
        s = s + F.coalesce(F.greatest(10 - rank, F.lit(0)) * 0.3 + (F.least(routed, F.lit(5.0)) * 0.2 if routed is not None else F.lit(0.0)), F.lit(0.0))
    if total_likely is not None:
        s = s + (F.when(total, 2.0).otherwise(-1.0) if total_likely else F.when(total, -0.5).otherwise(0.0))
    return s - F.when(total, 6.0).otherwise(0.0) if of_subgroup else s


# queries


def _registry(spark, d):
    g = latest(table(spark, d, "admin_geographies").where("deleted_at IS NULL"), ["geoid"], [F.desc("registered_at")])
    return aliases_of(g, "geoid", "name").join(g.select(F.col("geoid").alias("id"), "geo_type", "population"), "id")


def area_aliases(spark, d):
    return _registry(spark, d).select("id", "alias", "kind")


def area_resolution(spark, d):
    """The names of all places and counties asked in lower case without their suffix."""
    asked = table(spark, d, "admin_geographies").where("geo_type IN ('place', 'county')").select(F.regexp_replace(F.lower("name"), SUFFIXES, "").alias("asked")).distinct()
    return resolved(asked, _registry(spark, d))


def candidate_hydration(spark, d):
    """Aliases joined to places, counties and states by id and type, the first that is there giving the subtype."""
    g = table(spark, d, "admin_geographies").where("deleted_at IS NULL").select("geoid", "geo_type", "lsad", "county_fips", "place_fips").dropDuplicates(["geoid"])
    a = _registry(spark, d).where("kind = 'full'").select("id", "geo_type", "alias")
    for t, col in (("place", "place_fips"), ("county", "county_fips"), ("state", "lsad")):
        dim = g.where(F.col("geo_type") == t).select(F.col("geoid").alias("id"), F.col("geo_type"), F.coalesce(F.col(col), F.lit("-")).alias(f"sub_{t}"))
        a = a.join(dim, ["id", "geo_type"], "left")
    return a.select("id", "alias", F.coalesce("sub_place", "sub_county", "sub_state", F.lit("none")).alias("subtype"))


def name_lookup(spark, d):
    """Titles looked up by normalised name: the first registration, and how many find none."""
    t = table(spark, d, "stat_tables").select(lookup_key(F.col("title")).alias("k"), "table_id")
    first = t.groupBy("k").agg(F.min("table_id").alias("target"))
    asked = table(spark, d, "stat_tables").select("table_id", lookup_key(F.regexp_replace("title", "household", "worker")).alias("k")).distinct()
    return asked.join(first, "k", "left").groupBy(F.col("target").isNull().alias("is_missing")).agg(F.count(F.lit(1)).alias("n"))


def pattern_lookup(spark, d):
    """The first pattern, by priority, that a title contains; an exact one goes before."""
    pats = spark.createDataFrame([(0, "rate"), (1, "share"), (2, "rent"), (3, "income"), (4, "annual family size")], "prio int, pattern string")
    t = table(spark, d, "stat_tables").select("table_id", "dataset", "year", F.lower("title").alias("title")).distinct()
    j = t.join(F.broadcast(pats), F.col("title").contains(F.col("pattern"))).withColumn("order", F.when(F.col("title") == F.col("pattern"), -1).otherwise(F.col("prio")))
    return j.groupBy("table_id", "dataset", "year").agg(F.min_by("pattern", F.struct("order", "prio")).alias("pattern"))


def value_canonical(spark, d):
    c = canonical(F.col("action_taken"), {"1": "originated", "3": "denied"}, {"2": "approved", "8": "approved"})
    return table(spark, d, "hmda_lar").groupBy(c.alias("action")).agg(F.count(F.lit(1)).alias("n"))


def plan_with_empty_calls(spark, d):
    """A plan of two states, three years and two groups joined to its rows; calls without rows come out with a note."""
    years = picked_years([r[0] for r in table(spark, d, "hmda_lar").select("activity_year").distinct().collect()], "trend", 2020, most=3)
    plan = calls(spark, ["03", "99"], years, {"loan_type": ["1", "2"]})
    h = table(spark, d, "hmda_lar").dropDuplicates(["record_id"]).groupBy("state_code", "activity_year", "loan_type").agg(F.count(F.lit(1)).alias("n"))
    p = plan.withColumn("loan_type", F.substring_index("role", "loan_type=", -1))
    j = p.join(h.withColumnRenamed("state_code", "geo_id").withColumnRenamed("activity_year", "year"), ["geo_id", "year", "loan_type"], "left")
    return j.select("geo_id", "year", "role", F.coalesce("n", F.lit(0)).alias("rows_used"), F.when(F.col("n").isNull(), "no rows").alias("note"))


def source_dispatch(spark, d):
    """Calls to two sources in one result: each row keeps its call and source, columns that a source lacks are null."""
    a = table(spark, d, "stat_values").groupBy(F.col("table_id").alias("call")).agg(F.count(F.lit(1)).alias("cells")).withColumn("source", F.lit("statistics"))
    b = table(spark, d, "hmda_lar").groupBy(F.col("state_code").alias("call")).agg(F.count(F.lit(1)).alias("records")).withColumn("source", F.lit("records"))
    return a.unionByName(b, allowMissingColumns=True).select("call", "source", "cells", "records")


def best_per_table(spark, d):
    """Candidates of several searches merged: least rank and greatest score per table."""
    q = table(spark, d, "table_questions").where("trim(table_id) <> ''")
    return q.groupBy(tid().alias("table_id")).agg(F.min("position").alias("rank"), F.max(F.when(F.col("polarity") == "positive", 1.5).otherwise(0.5)).alias("score"))


def candidate_cap(spark, d):
    """At most four candidates per subject, stable by score and then by first appearance."""
    t = table(spark, d, "stat_tables").where("deleted_at IS NULL AND subject_area IS NOT NULL").groupBy("subject_area", "table_id").agg(F.max("variable_count").alias("score"), F.min("registered_at").alias("first"))
    w = W.partitionBy("subject_area").orderBy(F.desc("score"), "first", "table_id")
    return t.withColumn("rank", F.row_number().over(w)).where("rank <= 4").select("subject_area", "table_id", "rank")


def dataset_preference(spark, d):
    """Does a subject go to the record dataset: its best table is one, or its second or third comes within a tenth of the best?"""
    t = table(spark, d, "stat_tables").where("deleted_at IS NULL AND subject_area IS NOT NULL").groupBy("subject_area", "table_id", "dataset").agg(F.max("variable_count").alias("score"))
    w = W.partitionBy("subject_area").orderBy(F.desc("score"), "table_id", "dataset")
    r = t.withColumn("rank", F.row_number().over(w)).withColumn("top", F.max("score").over(W.partitionBy("subject_area"))).where("rank <= 3")
    ok = (F.col("dataset") == "hmda") & ((F.col("rank") == 1) | (F.col("score") >= SECOND_BEST * F.col("top")))
    return r.groupBy("subject_area").agg(F.bool_or(ok).alias("prefers_records"))


def tract_lists(spark, d):
    """The distinct tracts of each place as one text."""
    m = table(spark, d, "place_tract_map").where("place_id IS NOT NULL AND trim(tract_geoid) <> ''")
    return m.groupBy("place_id").agg(F.array_join(F.array_sort(F.collect_set(F.trim("tract_geoid"))), ",").alias("tracts"), F.max("overlap_pct").alias("most"))


def dissolved_places(spark, d):
    """Overlaps of a place and county put together, in map order."""
    m = table(spark, d, "place_tract_map").where("place_id IS NOT NULL AND overlap_pct IS NOT NULL")
    return m.groupBy("place_id", "county_geoid").agg(F.count(F.lit(1)).alias("parts"), F.round(F.sum("overlap_pct"), 4).alias("total"), F.min("map_id").alias("first"), F.max("map_id").alias("last"))


def run_totals(spark, d):
    c = table(spark, d, "coverage")
    return c.groupBy("geo_level", "source").agg(F.sum("row_count").alias("rows"), F.sum((F.col("status") == "success").cast("bigint")).alias("ok"), F.count(F.lit(1)).alias("checks"), F.max("year").alias("last_year"))


def excluded_types(spark, d):
    g = table(spark, d, "admin_geographies").where(~F.col("geo_type").isin("tract", "state"))
    return g.groupBy("geo_type", "state_fips").agg(F.count(F.lit(1)).alias("n"))


def box_filter(spark, d):
    """Places with a corner of their outline in a box (outlines laid out by code)."""
    a, b = F.substring("geoid", 1, 2).cast("double"), F.substring("geoid", 3, 5).cast("double") / 1000
    pts = F.array(*[F.struct((a + i).alias("x"), (b + j).alias("y")) for i, j in ((0, 0), (3, 0), (3, 3), (0, 3))])
    inside = F.exists(pts, lambda p: p.x.between(5, 20) & p.y.between(0, 60))
    return table(spark, d, "admin_geographies").where("geo_type = 'place'").where(inside).select("geoid")


def numeric_probe(spark, d):
    """Is the first annotation (by arrival) of each table a number?  Tables without one count as numeric."""
    s = table(spark, d, "stat_values").where("annotation IS NOT NULL").groupBy("table_id").agg(F.min(F.struct("loaded_at", "geo_id", "variable_id", "annotation")).alias("f"))
    t = table(spark, d, "stat_values").select("table_id").distinct().join(s, "table_id", "left")
    return t.select("table_id", F.coalesce(F.trim("f.annotation").rlike(r"^[+-]?\d+(\.\d+)?$"), F.lit(True)).alias("is_numeric"))


def folded_tokens(spark, d):
    """Words of the documents with accents folded: the most used in each language (a report of the 20 first)."""
    frm, to = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
    w = table(spark, d, "documents").select("lang", F.explode(F.filter(F.split(F.translate(F.lower("text"), frm, to), "[^a-z0-9]+"), lambda x: F.length(x) > 3)).alias("w"))
    n = w.groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    win = W.partitionBy("lang").orderBy(F.desc("n"), "w")
    return n.withColumn("rank", F.row_number().over(win)).where("rank <= 20")


def cleaned_text(spark, d):
    """Texts without code fences, white space collapsed, cut after a number of words at a sentence's end."""
    t = F.trim(F.regexp_replace(F.regexp_replace("description", "```[a-z]*", " "), r"\s+", " "))
    words = F.split(t, " ")
    cut = F.array_join(F.slice(words, 1, 8), " ")
    return table(spark, d, "stat_tables").where("description IS NOT NULL").select("table_id", "dataset", "year", F.when(F.size(words) <= 8, t).otherwise(F.concat(F.regexp_replace(cut, r"[,;:]$", ""), F.lit("."))).alias("short")).distinct()


def variable_choice(spark, d):
    """The best variable of each table vintage for a request for a count that is likely a total."""
    v = latest(table(spark, d, "variables").withColumns({"t": tid()}), ["t", "dataset", "year", "variable_id"], [F.desc("loaded_at"), F.desc("var_row_id")])
    s = v.select("t", "dataset", "year", "variable_id", variable_score(F.col("label_natural"), F.col("is_total"), F.col("depth"), F.col("is_commonly_queried"), sought="count", total_likely=True).alias("score"))
    w = W.partitionBy("t", "dataset", "year").orderBy(F.desc("score"), "variable_id")
    return s.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(F.col("t").alias("table_id"), "dataset", "year", "variable_id", "score")


def label_siblings(spark, d):
    """Parent path and number of siblings of each label."""
    v = latest(table(spark, d, "variables").withColumns({"t": tid()}), ["t", "dataset", "year", "variable_id"], [F.desc("loaded_at"), F.desc("var_row_id")]).withColumn("seg", segments(F.col("label_natural"))).where("size(seg) > 0")
    v = v.withColumn("parent", F.expr("array_join(slice(seg, 1, size(seg) - 1), '|')"))
    return v.groupBy("t", "dataset", "year", "parent").agg(F.count(F.lit(1)).alias("children"), F.min("variable_id").alias("first_child"))


def common_phrases(spark, d):
    phrases = F.array(*[F.lit(x) for x in ("conventional loans", "food assistance", "vehicles")])
    hit = F.exists(phrases, lambda p: F.lower("label_natural").contains(p))
    return table(spark, d, "variables").groupBy(hit.alias("common")).agg(F.count(F.lit(1)).alias("n"))


def table_structure(spark, d):
    """Per table vintage: the headline (least depth, then id), label parts by place, and depth."""
    v = latest(table(spark, d, "variables").withColumns({"t": tid()}), ["t", "dataset", "year", "variable_id"], [F.desc("loaded_at"), F.desc("var_row_id")]).withColumn("seg", segments(F.col("label_natural"))).where("size(seg) > 0")
    return v.groupBy("t", "dataset", "year").agg(F.min_by("variable_id", F.struct(F.size("seg").alias("n"), "variable_id")).alias("headline"), F.countDistinct(F.col("seg")[0]).alias("roots"), F.countDistinct(F.get("seg", F.lit(1))).alias("members"), F.countDistinct(F.get("seg", F.lit(2))).alias("splits"), F.max(F.size("seg")).alias("depth"))


def level_specs(spark, d):
    """Levels that a dataset covers and that are wanted, in order of preference."""
    order = F.create_map(*[x for i, v in enumerate(LEVELS) for x in (F.lit(v), F.lit(i))])
    c = table(spark, d, "coverage").where("status = 'success' AND geo_level IN ('us', 'county', 'tract')").select("dataset", "geo_level").distinct()
    return c.select("dataset", "geo_level", order[F.col("geo_level")].alias("place"))


def metro_specs(spark, d):
    """Metros crossed with the levels and states they are fetched for (dimensions of bounded size)."""
    m = table(spark, d, "stat_values").where("geo_level = 'msa'").groupBy("msa_code").agg(F.count(F.lit(1)).alias("n")).where("n >= 5").select("msa_code")
    s = table(spark, d, "admin_geographies").where("geo_type = 'state'").select("state_fips").distinct()
    return m.crossJoin(F.broadcast(s)).withColumn("geo_level", F.explode(F.array(F.lit("county"), F.lit("tract"))))


def vocabulary_filter(spark, d):
    """Tags of tables that the vocabulary knows, and those it doesn't."""
    vocab = table(spark, d, "cards").where("subject_area IS NOT NULL").select(F.col("subject_area").alias("tag")).distinct()
    tags = table(spark, d, "stat_tables").select(F.explode(F.coalesce(F.from_json("l1_domains_json", "array<string>"), F.array().cast("array<string>"))).alias("tag"))
    known = tags.join(vocab, "tag", "left_semi").groupBy("tag").agg(F.count(F.lit(1)).alias("n")).withColumn("valid", F.lit(True))
    return known.unionByName(tags.join(vocab, "tag", "left_anti").groupBy("tag").agg(F.count(F.lit(1)).alias("n")).withColumn("valid", F.lit(False)))


def audit_rows(spark, d):
    """Values, margins and flags of each cell as long rows with a slot number and the area above."""
    s = table(spark, d, "stat_values").where("geo_level IN ('state', 'county')").select("table_id", "year", "geo_id", "geo_level", "estimate", "moe")
    g = s.groupBy("table_id", "year", "geo_level", "geo_id").agg(F.round(F.sum(F.when(F.col("estimate") > -555555555, F.col("estimate"))), 2).alias("estimate"), F.round(F.max("moe"), 2).alias("moe"), F.count(F.lit(1)).cast("double").alias("cells"))
    x = F.posexplode(F.array(*[F.struct(F.lit(n).alias("what"), F.col(n).alias("value")) for n in ("estimate", "moe", "cells")])).alias("slot", "x")
    return g.select("table_id", "year", "geo_id", F.when(F.col("geo_level") == "county", F.substring("geo_id", 1, 2)).otherwise("us").alias("parent"), x).select("table_id", "year", "geo_id", "parent", "slot", "x.what", "x.value").where("value IS NOT NULL")


def truncated_bundle(spark, d):
    """The first 50 areas of each table with a mark where more were left out (a capped report)."""
    s = table(spark, d, "stat_values").select("table_id", "geo_id").distinct()
    w = W.partitionBy("table_id").orderBy("geo_id")
    r = s.withColumn("rn", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("table_id")))
    return r.where("rn <= 50").groupBy("table_id").agg(F.count(F.lit(1)).alias("shown"), F.max(F.col("n") > 50).alias("values_truncated"))


def population_update(spark, d):
    """Counties with the population of their tracts where that is known and positive, else their own."""
    g = table(spark, d, "admin_geographies")
    t = g.where("geo_type = 'tract' AND deleted_at IS NULL AND population > 0").groupBy(F.substring("geoid", 1, 5).alias("geoid")).agg(F.sum("population").alias("p"))
    return g.where("geo_type = 'county'").join(t, "geoid", "left").select("geoid", F.coalesce("p", "population").alias("population"))


def crosswalk(spark, d):
    """Metro to county codes as they are delivered, brought to full width, each pair once."""
    s = table(spark, d, "stat_values").where("msa_code IS NOT NULL AND geo_level = 'msa'")
    return s.select(pad_left(F.col("msa_code"), 5).alias("msa"), F.coalesce(pad_left(F.col("state_fips"), 2), F.lit("")).alias("state")).distinct()


def status_rows(spark, d):
    """Per table and level: outcome of the last check, share of successful ones, least year."""
    c = table(spark, d, "coverage").groupBy(tid().alias("table_id"), "geo_level").agg(F.max_by("status", F.struct("loaded_at", "coverage_id")).alias("last"), F.round(F.avg((F.col("status") == "success").cast("double")) * 100, 4).alias("pct"), F.min("year").alias("since"))
    return c


_G = "(SELECT * FROM admin_geographies WHERE deleted_at IS NULL QUALIFY row_number() OVER (PARTITION BY geoid ORDER BY registered_at DESC) = 1)"
_KEY = "trim(regexp_replace(regexp_replace(translate(lower({0}), '–—‐-', '    '), '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g'))"
_SUF = "\\s+(county|city|town|village|cdp|borough|parish|municipality)$"
_AL = f"""al AS (SELECT DISTINCT geoid AS id, {_KEY.format('a')} AS alias, kind, geo_type, population FROM (
  SELECT geoid, geo_type, population, name AS a, 'full' AS kind FROM {_G} UNION ALL SELECT geoid, geo_type, population, regexp_replace(lower(name), '{_SUF}', ''), 'short' FROM {_G} WHERE regexp_matches(lower(name), '{_SUF}')
  UNION ALL SELECT geoid, geo_type, population, regexp_extract(lower(name), '{_SUF}', 1) || ' of ' || regexp_replace(lower(name), '{_SUF}', ''), 'of' FROM {_G} WHERE regexp_matches(lower(name), '{_SUF}')) WHERE alias <> '')"""
_V = "(SELECT * REPLACE (upper(trim(table_id)) AS table_id) FROM variables QUALIFY row_number() OVER (PARTITION BY upper(trim(table_id)), dataset, year, variable_id ORDER BY loaded_at DESC, var_row_id DESC) = 1)"
_SEG = "list_filter(list_transform(regexp_split_to_array(upper(trim(label_natural)), '!!|:|;|,| - |\\(|\\)'), lambda x: trim(x)), lambda x: x <> '')"
QUERIES = {f.__name__: f for f in (area_aliases, area_resolution, candidate_hydration, name_lookup, pattern_lookup, value_canonical, plan_with_empty_calls, source_dispatch, best_per_table, candidate_cap, dataset_preference, tract_lists, dissolved_places, run_totals, excluded_types, box_filter, numeric_probe, folded_tokens, cleaned_text, variable_choice, label_siblings, common_phrases, table_structure, level_specs, metro_specs, vocabulary_filter, audit_rows, truncated_bundle, population_update, crosswalk, status_rows)}
SQL = {
    "area_aliases": f"WITH {_AL} SELECT id, alias, kind FROM al",
    "area_resolution": f"""WITH {_AL}, q AS (SELECT DISTINCT regexp_replace(lower(name), '{_SUF}', '') AS asked FROM admin_geographies WHERE geo_type IN ('place', 'county')),
j AS (SELECT asked, id, population, min(CASE kind WHEN 'full' THEN 0 WHEN 'of' THEN 1 ELSE 2 END) AS tier FROM q JOIN al ON al.alias = {_KEY.format('asked')} GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER w AS rank, lead(tier) OVER w AS nt FROM j WINDOW w AS (PARTITION BY asked ORDER BY tier, population DESC NULLS LAST, id)),
c AS (SELECT asked, id, rank::INT AS rank, round(1 / (1 + 0.25 * (rank - 1)) - tier * 0.05 - CASE WHEN nt = tier THEN 0.1 ELSE 0 END, 4)::DOUBLE AS confidence FROM r WHERE rank <= 3) SELECT *, confidence < 0.9 AS ask_back FROM c""",
    "candidate_hydration": f"WITH {_AL}, g AS (SELECT DISTINCT ON (geoid) * FROM admin_geographies WHERE deleted_at IS NULL) SELECT al.id, alias, CASE al.geo_type WHEN 'place' THEN coalesce(place_fips, '-') WHEN 'county' THEN coalesce(county_fips, '-') WHEN 'state' THEN coalesce(lsad, '-') ELSE 'none' END AS subtype FROM al JOIN g ON g.geoid = al.id WHERE kind = 'full'",
    "name_lookup": f"WITH f AS (SELECT DISTINCT {_KEY.format('title')} AS k FROM stat_tables), a AS (SELECT DISTINCT table_id, {_KEY.format(chr(114) + 'eplace(title, ' + chr(39) + 'household' + chr(39) + ', ' + chr(39) + 'worker' + chr(39) + ')')} AS k FROM stat_tables) SELECT f.k IS NULL AS is_missing, count(*) AS n FROM a LEFT JOIN f USING (k) GROUP BY 1",
    "pattern_lookup": "WITH p(prio, pattern) AS (VALUES (0, 'rate'), (1, 'share'), (2, 'rent'), (3, 'income'), (4, 'annual family size')), t AS (SELECT DISTINCT table_id, dataset, year, lower(title) AS title FROM stat_tables) SELECT table_id, dataset, year, arg_min(pattern, (CASE WHEN title = pattern THEN -1 ELSE prio END, prio)) AS pattern FROM t JOIN p ON contains(title, pattern) GROUP BY 1, 2, 3",
    "value_canonical": "SELECT CASE action_taken WHEN '1' THEN 'originated' WHEN '3' THEN 'denied' WHEN '2' THEN 'approved' WHEN '8' THEN 'approved' ELSE action_taken END AS action, count(*) AS n FROM hmda_lar GROUP BY 1",
    "plan_with_empty_calls": "WITH y AS (SELECT DISTINCT activity_year AS year FROM hmda_lar WHERE activity_year <= 2020 ORDER BY 1 DESC LIMIT 3), p AS (SELECT g.g AS geo_id, year, t.t AS loan_type, CASE WHEN year = (SELECT max(year) FROM y) THEN 'primary' ELSE 'prior_period' END || '.group_loan_type=' || t.t AS role FROM (VALUES ('03'), ('99')) g(g), y, (VALUES ('1'), ('2')) t(t)) SELECT geo_id, year, role, count(DISTINCT record_id) AS rows_used, CASE WHEN count(record_id) = 0 THEN 'no rows' END AS note FROM p LEFT JOIN hmda_lar h ON h.state_code = geo_id AND h.activity_year = year AND h.loan_type = p.loan_type GROUP BY 1, 2, 3",
    "source_dispatch": "SELECT table_id AS call, 'statistics' AS source, count(*) AS cells, NULL::BIGINT AS records FROM stat_values GROUP BY 1 UNION ALL SELECT state_code, 'records', NULL, count(*) FROM hmda_lar GROUP BY 1",
    "best_per_table": "SELECT upper(trim(table_id)) AS table_id, min(position) AS rank, max(CASE WHEN polarity = 'positive' THEN 1.5 ELSE 0.5 END)::DOUBLE AS score FROM table_questions WHERE trim(table_id) <> '' GROUP BY 1",
    "candidate_cap": "WITH t AS (SELECT subject_area, table_id, max(variable_count) AS s, min(registered_at) AS f FROM stat_tables WHERE deleted_at IS NULL AND subject_area IS NOT NULL GROUP BY 1, 2) SELECT subject_area, table_id, (row_number() OVER (PARTITION BY subject_area ORDER BY s DESC, f, table_id))::INT AS rank FROM t QUALIFY rank <= 4",
    "dataset_preference": "WITH t AS (SELECT subject_area, table_id, dataset, max(variable_count) AS s FROM stat_tables WHERE deleted_at IS NULL AND subject_area IS NOT NULL GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY subject_area ORDER BY s DESC, table_id, dataset) AS rank, max(s) OVER (PARTITION BY subject_area) AS top FROM t QUALIFY rank <= 3) SELECT subject_area, bool_or(dataset = 'hmda' AND (rank = 1 OR s >= 0.9 * top)) AS prefers_records FROM r GROUP BY 1",
    "tract_lists": "SELECT place_id, array_to_string(list_sort(list(DISTINCT trim(tract_geoid))), ',') AS tracts, max(overlap_pct) AS most FROM place_tract_map WHERE place_id IS NOT NULL AND trim(tract_geoid) <> '' GROUP BY 1",
    "dissolved_places": "SELECT place_id, county_geoid, count(*) AS parts, round(sum(overlap_pct), 4) AS total, min(map_id) AS first, max(map_id) AS last FROM place_tract_map WHERE place_id IS NOT NULL AND overlap_pct IS NOT NULL GROUP BY 1, 2",
    "run_totals": "SELECT geo_level, source, sum(row_count)::BIGINT AS rows, sum((status = 'success')::INT)::BIGINT AS ok, count(*) AS checks, max(year) AS last_year FROM coverage GROUP BY 1, 2",
    "excluded_types": "SELECT geo_type, state_fips, count(*) AS n FROM admin_geographies WHERE geo_type NOT IN ('tract', 'state') GROUP BY 1, 2",
    "box_filter": "SELECT geoid FROM (SELECT geoid, substr(geoid, 1, 2)::DOUBLE AS a, substr(geoid, 3, 5)::DOUBLE / 1000 AS b FROM admin_geographies WHERE geo_type = 'place') WHERE (a BETWEEN 5 AND 20 OR a + 3 BETWEEN 5 AND 20) AND (b BETWEEN 0 AND 60 OR b + 3 BETWEEN 0 AND 60)",
    "numeric_probe": "SELECT table_id, coalesce(regexp_full_match(trim(f), '[+-]?[0-9]+(\\.[0-9]+)?'), true) AS is_numeric FROM (SELECT table_id, arg_min(annotation, (loaded_at, geo_id, variable_id, annotation)) FILTER (annotation IS NOT NULL) AS f FROM stat_values GROUP BY 1)",
    "folded_tokens": "WITH n AS (SELECT lang, w, count(*) AS n FROM (SELECT lang, unnest(regexp_split_to_array(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9]+')) AS w FROM documents) WHERE length(w) > 3 GROUP BY 1, 2) SELECT lang, w, n, (row_number() OVER (PARTITION BY lang ORDER BY n DESC, w))::INT AS rank FROM n QUALIFY rank <= 20",
    "cleaned_text": "WITH t AS (SELECT table_id, dataset, year, trim(regexp_replace(regexp_replace(description, '```[a-z]*', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM stat_tables WHERE description IS NOT NULL), w AS (SELECT *, string_split(t, ' ') AS w FROM t) SELECT DISTINCT table_id, dataset, year, CASE WHEN len(w) <= 8 THEN t ELSE regexp_replace(array_to_string(w[1:8], ' '), '[,;:]$', '') || '.' END AS short FROM w",
    "variable_choice": "WITH s AS (SELECT table_id, dataset, year, variable_id, CASE WHEN " + " OR ".join(f"contains(lower(coalesce(label_natural, '')), '{m}')" for m in SUBGROUP_MARKS) + " THEN -8.0 ELSE 0 END + CASE WHEN " + " OR ".join(f"contains(lower(label_natural), '{m}')" for m in _COUNTED) + f" THEN 2 WHEN starts_with(lower(label_natural), 'percent') THEN -3 ELSE 0 END - coalesce(greatest(depth - 1, 0), 0) * 3.0 + CASE WHEN is_commonly_queried = 1 THEN 0.5 ELSE 0 END + CASE WHEN coalesce(is_total = 1, false) THEN 2.0 ELSE -1.0 END AS score FROM {_V}) SELECT table_id, dataset, year, variable_id, score::DOUBLE AS score FROM s QUALIFY row_number() OVER (PARTITION BY table_id, dataset, year ORDER BY score DESC, variable_id) = 1",
    "label_siblings": f"SELECT table_id AS t, dataset, year, array_to_string(seg[1:len(seg) - 1], '|') AS parent, count(*) AS children, min(variable_id) AS first_child FROM (SELECT *, {_SEG} AS seg FROM {_V}) WHERE len(seg) > 0 GROUP BY 1, 2, 3, 4",
    "common_phrases": "SELECT contains(lower(label_natural), 'conventional loans') OR contains(lower(label_natural), 'food assistance') OR contains(lower(label_natural), 'vehicles') AS common, count(*) AS n FROM variables GROUP BY 1",
    "table_structure": f"SELECT table_id AS t, dataset, year, arg_min(variable_id, (len(seg), variable_id)) AS headline, count(DISTINCT seg[1]) AS roots, count(DISTINCT seg[2]) AS members, count(DISTINCT seg[3]) AS splits, max(len(seg))::INT AS depth FROM (SELECT *, {_SEG} AS seg FROM {_V}) WHERE len(seg) > 0 GROUP BY 1, 2, 3",
    "level_specs": "SELECT DISTINCT dataset, geo_level, CASE geo_level WHEN 'us' THEN 0 WHEN 'county' THEN 2 ELSE 4 END AS place FROM coverage WHERE status = 'success' AND geo_level IN ('us', 'county', 'tract')",
    "metro_specs": "SELECT msa_code, state_fips, l AS geo_level FROM (SELECT msa_code FROM stat_values WHERE geo_level = 'msa' GROUP BY 1 HAVING count(*) >= 5), (SELECT DISTINCT state_fips FROM admin_geographies WHERE geo_type = 'state'), (VALUES ('county'), ('tract')) v(l)",
    "vocabulary_filter": "WITH t AS (SELECT unnest(from_json(l1_domains_json, '[\"VARCHAR\"]')) AS tag FROM stat_tables WHERE json_valid(l1_domains_json)) SELECT tag, count(*) AS n, tag IN (SELECT subject_area FROM cards WHERE subject_area IS NOT NULL) AS valid FROM t GROUP BY 1",
    "audit_rows": "WITH g AS (SELECT table_id, year, geo_level, geo_id, round(sum(estimate) FILTER (estimate > -555555555), 2) AS e, round(max(moe), 2) AS m, count(*)::DOUBLE AS c FROM stat_values WHERE geo_level IN ('state', 'county') GROUP BY 1, 2, 3, 4), x AS (SELECT *, unnest([0, 1, 2]) AS slot, unnest(['estimate', 'moe', 'cells']) AS what, unnest([e, m, c]) AS value FROM g) SELECT table_id, year, geo_id, CASE WHEN geo_level = 'county' THEN substr(geo_id, 1, 2) ELSE 'us' END AS parent, slot, what, value FROM x WHERE value IS NOT NULL",
    "truncated_bundle": "SELECT table_id, least(50, count(DISTINCT geo_id)) AS shown, count(DISTINCT geo_id) > 50 AS values_truncated FROM stat_values GROUP BY 1",
    "population_update": "SELECT g.geoid, coalesce(p, population) AS population FROM admin_geographies g LEFT JOIN (SELECT substr(geoid, 1, 5) AS geoid, sum(population)::BIGINT AS p FROM admin_geographies WHERE geo_type = 'tract' AND deleted_at IS NULL AND population > 0 GROUP BY 1) USING (geoid) WHERE geo_type = 'county'",
    "crosswalk": "SELECT DISTINCT lpad(msa_code, 5, '0') AS msa, coalesce(lpad(state_fips, 2, '0'), '') AS state FROM stat_values WHERE msa_code IS NOT NULL AND geo_level = 'msa'",
    "status_rows": "SELECT upper(trim(table_id)) AS table_id, geo_level, arg_max(status, (loaded_at, coverage_id)) AS last, round(avg((status = 'success')::INT) * 100, 4) AS pct, min(year) AS since FROM coverage GROUP BY 1, 2",
}
