"""Ingestion and reshaping: decode, split, unpivot, merge, upsert, and checks on what was delivered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.normalize import cell_number
from ..runtime import table
from .metadata import latest, tid

#: Codes that stand for a state of a number, and what they say (fixed values).
STATUSES = {"NA": "Not applicable", "Exempt": "Exempt"}
#: A codebook: field, code, label, first and last year (fixed values).
CODEBOOK = [
    ("action_taken", "1", "Loan originated", 2004, 9999),
    ("action_taken", "2", "Approved but not accepted", 2004, 9999),
    ("action_taken", "3", "Application denied", 2004, 9999),
    ("action_taken", "4", "Application withdrawn", 2004, 9999),
    ("action_taken", "5", "Closed for incompleteness", 2004, 9999),
    ("loan_purpose", "1", "Home purchase", 2004, 9999),
    ("loan_purpose", "2", "Home improvement", 2004, 9999),
    ("loan_purpose", "3", "Refinancing", 2004, 2017),
    ("loan_purpose", "31", "Refinancing", 2018, 9999),
    ("loan_purpose", "32", "Cash-out refinancing", 2018, 9999),
    ("loan_purpose", "4", "Other purpose", 2018, 9999),
]
TOLERANCE = 0.015


def active_codes(codebook: DataFrame, year: int) -> DataFrame:
    """The codes of a year; a code with two labels in it is an error."""
    a = codebook.where(F.lit(year).between(F.col("year_start"), F.col("year_end")))
    if a.groupBy("field", "code").count().where("count > 1").limit(1).count():
        raise ValueError("a code has several labels in one year")
    return a


def decoded(df: DataFrame, field: str, codebook: DataFrame, year: str) -> DataFrame:
    """The field's codes replaced by their labels of the row's year; unknown and empty codes stay as they are."""
    c = codebook.where(F.col("field") == field).select(F.col("code").alias("__c"), "label", "year_start", "year_end")
    j = df.join(F.broadcast(c), (F.trim(F.col(field)) == F.col("__c")) & F.col(year).between(F.col("year_start"), F.col("year_end")), "left")
    return j.withColumn(field, F.coalesce("label", field)).drop("__c", "label", "year_start", "year_end")


def number_and_status(raw: Column) -> tuple[Column, Column]:
    """A number where the text is one; else a status: what the code says, null where blank, ``unknown`` otherwise."""
    t = F.trim(raw)
    n = cell_number(t)
    status = F.when(n.isNotNull() | t.isNull() | (t == ""), None)
    for code, says in STATUSES.items():
        status = status.when(t == code, says)
    return n, status.otherwise("unknown")


def unpivoted(wide: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    """Wide rows with ``<v>_e`` and ``<v>_m`` text columns to (keys, variable, estimate, moe, annotation) rows.

    An estimate that is no number becomes the annotation; a negative margin becomes null; a cell with neither an
    estimate nor an annotation gives no row.
    """
    x = wide.select(*keys, F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(f"{v}_e").cast("string").alias("e"), F.col(f"{v}_m").cast("string").alias("m")) for v in variables])).alias("x")).select(*keys, "x.*")
    e, m = cell_number(F.col("e")), cell_number(F.col("m"))
    return x.select(*keys, "variable", e.alias("estimate"), F.when(m >= 0, m).alias("moe"), F.when(e.isNull() & (F.trim("e") != ""), F.trim("e")).alias("annotation")).where("estimate IS NOT NULL OR annotation IS NOT NULL")


def upserted(old: DataFrame, new: DataFrame, key: list[str], order: list) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key; within each the given order decides."""
    both = old.withColumn("__p", F.lit(1)).unionByName(new.withColumn("__p", F.lit(0)), allowMissingColumns=True)
    return latest(both, key, ["__p", *order]).drop("__p")


def kept_first(old: DataFrame, new: DataFrame, key: list[str], order: list) -> DataFrame:
    """Rows of ``new`` are added only where their key is not there yet."""
    both = old.withColumn("__p", F.lit(0)).unionByName(new.withColumn("__p", F.lit(1)), allowMissingColumns=True)
    return latest(both, key, ["__p", *order]).drop("__p")


def merged_registry(old: DataFrame, new: DataFrame) -> DataFrame:
    """variable_id, source_name, state: kept, added, or collision (one id, two names)."""
    j = old.select("variable_id", F.col("source_name").alias("o")).join(new.select("variable_id", F.col("source_name").alias("n")), "variable_id", "full")
    return j.select("variable_id", F.coalesce("o", "n").alias("source_name"), F.when(F.col("o").isNull(), "added").when(F.col("n").isNull() | (F.col("o") == F.col("n")), "kept").otherwise("collision").alias("state"))


def loaded_rows(raw: DataFrame, columns: list[str], dataset: str) -> DataFrame:
    """Only columns of the target schema that are there, blanks as null, rows of one dataset."""
    have = [c for c in columns if c in raw.columns]
    blank = lambda c: F.when(F.trim(F.col(c).cast("string")) != "", F.col(c).cast("string")).alias(c)
    return raw.where(F.col("dataset") == dataset).select(*[blank(c) for c in have])


def numbers_in(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\d[\d,]*\.?\d*)"), F.lit(1)), lambda s: F.regexp_replace(s, ",", "").try_cast("double"))


def near_any(n: Column, known: Column) -> Column:
    return F.exists(known, lambda k: F.abs(n - k) <= TOLERANCE * F.greatest(F.abs(n), F.abs(k)))


# queries


def _codes(spark):
    return spark.createDataFrame(CODEBOOK, "field string, code string, label string, year_start int, year_end int")


def decode_codebook(spark, d):
    h = decoded(decoded(table(spark, d, "hmda_lar"), "action_taken", _codes(spark), "activity_year"), "loan_purpose", _codes(spark), "activity_year")
    return h.groupBy("action_taken", "loan_purpose").agg(F.count(F.lit(1)).alias("n"))


def codebook_active(spark, d):
    return active_codes(_codes(spark), 2020).select("field", "code", "label")


def numeric_status_split(spark, d):
    n, s = number_and_status(F.col("income"))
    return table(spark, d, "hmda_lar").select("activity_year", n.alias("n"), s.alias("status")).groupBy("activity_year", "status").agg(F.count(F.lit(1)).alias("rows"), F.count("n").alias("numbers"), F.round(F.sum("n"), 2).alias("total"))


def unpivot_moe(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    w = o.groupBy(F.col("c_nationkey").alias("nation"), F.year("o_orderdate").alias("year")).agg(
        F.count(F.lit(1)).cast("string").alias("orders_e"),
        F.when(F.count(F.lit(1)) % 2 == 0, "-1").otherwise("3").alias("orders_m"),
        F.when(F.col("nation") % 5 == 0, "(X)").when(F.col("nation") % 5 == 1, "low sample").otherwise(F.sum(F.floor("o_totalprice")).cast("bigint").cast("string")).alias("value_e"),
        F.lit("5.5").alias("value_m"),
    )
    return unpivoted(w, ["nation", "year"], ["orders", "value"])


def upsert_latest(spark, d):
    """Deleted registrations first, then those that are there: one row per geography."""
    g = table(spark, d, "admin_geographies").select("geoid", "name", "population", "registered_at", "deleted_at")
    return upserted(g.where("deleted_at IS NOT NULL"), g.where("deleted_at IS NULL"), ["geoid"], [F.desc("registered_at")]).select("geoid", "name", "population", F.col("deleted_at").isNull().alias("is_there"))


def insert_if_absent(spark, d):
    t = table(spark, d, "stat_tables").select("table_id", "dataset", "title", "year", "registered_at")
    return kept_first(t.where("year <= 2016"), t.where("year > 2016"), ["table_id", "dataset"], ["year", "registered_at", "title"]).select("table_id", "dataset", "year", "title")


def dedup_best(spark, d):
    """The most populous geography of each name and kind."""
    g = table(spark, d, "admin_geographies").withColumn("k", F.lower(F.trim("name")))
    return latest(g, ["k", "geo_type"], [F.desc_nulls_last("population"), "geoid", "registered_at"]).select("geoid", "geo_type", "name")


def registry_merge(spark, d):
    v = table(spark, d, "variables").select(F.upper(F.trim("variable_id")).alias("variable_id"), "column_name", "year")
    side = lambda c: v.where(c).where("column_name IS NOT NULL").groupBy("variable_id").agg(F.max("column_name").alias("source_name"))
    return merged_registry(side("year <= 2016"), side("year > 2016")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def generic_load(spark, d):
    r = loaded_rows(table(spark, d, "stat_tables"), ["table_id", "title", "universe", "avoid_when", "no_such_column"], "acs5")
    return r.groupBy("table_id").agg(F.count("title").alias("titles"), F.count("universe").alias("universes"), F.count("avoid_when").alias("cautions"))


def first_value_merge(spark, d):
    """Two deliveries of a feature merged on area: the first that has a value counts."""
    t = table(spark, d, "stat_values").where("geo_level = 'county'")
    one = lambda s: t.where(F.col("source") == s).groupBy("geo_id").agg(F.max(F.when(F.col("estimate") > -555555555, F.col("estimate"))).alias(s))
    return one("census_api").join(one("bulk_file"), "geo_id", "full").select("geo_id", F.coalesce("census_api", "bulk_file").alias("value"))


def msa_filter(spark, d):
    """Rows of metropolitan areas that at least 20 cells speak of."""
    s = table(spark, d, "stat_values").where("geo_level = 'msa'")
    keep = s.groupBy("msa_code").count().where("count >= 20").select("msa_code")
    return s.join(keep, "msa_code", "left_semi").groupBy("msa_code").agg(F.count(F.lit(1)).alias("n"))


def group_split(spark, d):
    """Tables by each of their subject groups: a list in one field is taken apart."""
    t = table(spark, d, "stat_tables").select("table_id", F.explode(F.split(F.concat_ws(",", "subject_area", "measure_type"), ",")).alias("g")).where("trim(g) <> ''")
    return t.groupBy(F.trim("g").alias("grp")).agg(F.countDistinct("table_id").alias("tables"))


def cache_stats(spark, d):
    """Entries, text size and expired entries of the card cache by version."""
    c = table(spark, d, "cards")
    now = c.agg(F.max("loaded_at").alias("now"))
    age = F.unix_timestamp(F.col("now").cast("timestamp")) - F.unix_timestamp(F.col("loaded_at").cast("timestamp"))
    return c.crossJoin(F.broadcast(now)).groupBy("card_type").agg(F.count(F.lit(1)).alias("entries"), F.sum(F.length("text")).alias("chars"), F.sum((age > 86400 * 365).cast("bigint")).alias("expired"))


def gap_missing(spark, d):
    """Levels that were asked for and not fetched, per table vintage."""
    need = F.array(*[F.lit(x) for x in ("county", "state", "tract", "us")])
    c = table(spark, d, "coverage").groupBy(tid().alias("table_id"), "dataset", "year").agg(F.collect_set(F.when(F.col("status") == "success", F.col("geo_level"))).alias("have"))
    return c.select("table_id", "dataset", "year", F.array_join(F.array_sort(F.array_except(need, "have")), ",").alias("missing")).where("missing <> ''")


def unsourced_numbers(spark, d):
    """Numbers of answers that no figure of their item's text supports (within 1.5 %)."""
    e = table(spark, d, "eval_items").where("answer IS NOT NULL").select("item_id", numbers_in(F.col("answer")).alias("said"), numbers_in(F.col("text")).alias("known"))
    bad = F.filter("said", lambda n: n.isNotNull() & ~F.coalesce(near_any(n, F.col("known")), F.lit(False)))
    return e.select("item_id", F.size("said").cast("bigint").alias("numbers"), F.size(bad).cast("bigint").alias("unsourced"))


def rationales(spark, d):
    """Proposals per theme: how many, and up to five distinct reasons in order of appearance."""
    q = table(spark, d, "table_questions").where("notes IS NOT NULL AND trim(notes) <> ''")
    g = q.groupBy("question_type", F.col("notes")).agg(F.min("question_id").alias("first"), F.count(F.lit(1)).alias("n"))
    return g.groupBy("question_type").agg(F.sum("n").alias("proposals"), F.array_join(F.slice(F.transform(F.array_sort(F.array_agg(F.struct("first", "notes"))), lambda x: x.notes), 1, 5), " / ").alias("reasons"))


def phantom_ids(spark, d):
    return table(spark, d, "variables").groupBy((F.col("table_id").contains(",") | (F.trim("table_id") != F.col("table_id")) | (F.upper("table_id") != F.col("table_id"))).alias("odd")).agg(F.count(F.lit(1)).alias("n"))


_BOOK = "(VALUES " + ", ".join(f"('{f}', '{c}', '{n}', {a}, {b})" for f, c, n, a, b in CODEBOOK) + ") b(field, code, label, ys, ye)"
_NUM = "CASE WHEN regexp_full_match(trim({0}), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)') THEN try_cast(trim({0}) AS DOUBLE) END"
_REG = "(SELECT upper(trim(variable_id)) AS v, max(column_name) AS s FROM variables WHERE column_name IS NOT NULL AND year {0} 2016 GROUP BY 1)"
_NUMS = "list_transform(regexp_extract_all({0}, '[0-9][0-9,]*\\.?[0-9]*'), lambda s: try_cast(replace(s, ',', '') AS DOUBLE))"
QUERIES = {f.__name__: f for f in (decode_codebook, codebook_active, numeric_status_split, unpivot_moe, upsert_latest, insert_if_absent, dedup_best, registry_merge, generic_load, first_value_merge, msa_filter, group_split, cache_stats, gap_missing, unsourced_numbers, rationales, phantom_ids)}
SQL = {
    "decode_codebook": f"SELECT coalesce(a.label, action_taken) AS action_taken, coalesce(p.label, loan_purpose) AS loan_purpose, count(*) AS n FROM hmda_lar LEFT JOIN (SELECT * FROM {_BOOK} WHERE field = 'action_taken') a ON trim(action_taken) = a.code AND activity_year BETWEEN a.ys AND a.ye LEFT JOIN (SELECT * FROM {_BOOK} WHERE field = 'loan_purpose') p ON trim(loan_purpose) = p.code AND activity_year BETWEEN p.ys AND p.ye GROUP BY 1, 2",
    "codebook_active": f"SELECT field, code, label FROM {_BOOK} WHERE 2020 BETWEEN ys AND ye",
    "numeric_status_split": f"SELECT activity_year, CASE WHEN n IS NOT NULL OR income IS NULL OR trim(income) = '' THEN NULL WHEN trim(income) = 'NA' THEN 'Not applicable' WHEN trim(income) = 'Exempt' THEN 'Exempt' ELSE 'unknown' END AS status, count(*) AS rows, count(n) AS numbers, round(sum(n), 2) AS total FROM (SELECT *, {_NUM.format('income')} AS n FROM hmda_lar) GROUP BY 1, 2",
    "unpivot_moe": """WITH w AS (SELECT c_nationkey AS nation, year(o_orderdate)::INT AS year, count(*) AS n, sum(floor(o_totalprice)) AS t FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT nation, year, 'orders' AS variable, n::DOUBLE AS estimate, CASE WHEN n % 2 = 0 THEN NULL ELSE 3.0::DOUBLE END AS moe, NULL AS annotation FROM w
UNION ALL SELECT nation, year, 'value', CASE WHEN nation % 5 > 1 THEN t::DOUBLE END, 5.5, CASE nation % 5 WHEN 0 THEN '(X)' WHEN 1 THEN 'low sample' END FROM w""",
    "upsert_latest": "SELECT geoid, name, population, deleted_at IS NULL AS is_there FROM (SELECT *, row_number() OVER (PARTITION BY geoid ORDER BY (deleted_at IS NOT NULL)::INT, registered_at DESC) AS rn FROM admin_geographies) WHERE rn = 1",
    "insert_if_absent": "SELECT table_id, dataset, year, title FROM stat_tables QUALIFY row_number() OVER (PARTITION BY table_id, dataset ORDER BY (year > 2016)::INT, year, registered_at, title) = 1",
    "dedup_best": "SELECT geoid, geo_type, name FROM admin_geographies QUALIFY row_number() OVER (PARTITION BY lower(trim(name)), geo_type ORDER BY population DESC NULLS LAST, geoid, registered_at) = 1",
    "registry_merge": f"SELECT CASE WHEN o.v IS NULL THEN 'added' WHEN n.v IS NULL OR o.s = n.s THEN 'kept' ELSE 'collision' END AS state, count(*) AS n FROM {_REG.format('<=')} o FULL JOIN {_REG.format('>')} n ON o.v = n.v GROUP BY 1",
    "generic_load": "SELECT table_id, count(nullif(trim(title), '')) AS titles, count(nullif(trim(universe), '')) AS universes, count(nullif(trim(avoid_when), '')) AS cautions FROM stat_tables WHERE dataset = 'acs5' GROUP BY 1",
    "first_value_merge": "SELECT geo_id, coalesce(max(estimate) FILTER (source = 'census_api' AND estimate > -555555555), max(estimate) FILTER (source = 'bulk_file' AND estimate > -555555555)) AS value FROM stat_values WHERE geo_level = 'county' AND source IN ('census_api', 'bulk_file') GROUP BY 1",
    "msa_filter": "SELECT msa_code, count(*) AS n FROM stat_values WHERE geo_level = 'msa' GROUP BY 1 HAVING count(*) >= 20 AND msa_code IS NOT NULL",
    "group_split": "SELECT trim(g) AS grp, count(DISTINCT table_id) AS tables FROM (SELECT table_id, unnest(string_split(concat_ws(',', subject_area, measure_type), ',')) AS g FROM stat_tables) WHERE trim(g) <> '' GROUP BY 1",
    "cache_stats": "SELECT card_type, count(*) AS entries, sum(length(text))::BIGINT AS chars, sum((epoch(date_trunc('second', (SELECT max(loaded_at) FROM cards))) - epoch(date_trunc('second', loaded_at)) > 86400 * 365)::INT)::BIGINT AS expired FROM cards GROUP BY 1",
    "gap_missing": "SELECT table_id, dataset, year, m AS missing FROM (SELECT upper(trim(table_id)) AS table_id, dataset, year, array_to_string(list_filter(['county', 'state', 'tract', 'us'], lambda x: NOT list_contains(coalesce(list(geo_level) FILTER (status = 'success'), []), x)), ',') AS m FROM coverage GROUP BY 1, 2, 3) WHERE m <> ''",
    "unsourced_numbers": f"WITH e AS (SELECT item_id, {_NUMS.format('answer')} AS said, {_NUMS.format('text')} AS known FROM eval_items WHERE answer IS NOT NULL), s AS (SELECT item_id, unnest(said) AS n FROM e), b AS (SELECT s.item_id, n FROM s JOIN e USING (item_id) WHERE n IS NOT NULL AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(e.known) AS k) WHERE abs(n - k) <= 0.015 * greatest(abs(n), abs(k)))) SELECT item_id, len(said)::BIGINT AS numbers, (SELECT count(*) FROM b WHERE b.item_id = e.item_id) AS unsourced FROM e",
    "rationales": "SELECT question_type, sum(n)::BIGINT AS proposals, array_to_string(list(notes ORDER BY first)[1:5], ' / ') AS reasons FROM (SELECT question_type, notes, min(question_id) AS first, count(*) AS n FROM table_questions WHERE trim(notes) <> '' GROUP BY 1, 2) GROUP BY 1",
    "phantom_ids": "SELECT contains(table_id, ',') OR trim(table_id) <> table_id OR upper(table_id) <> table_id AS odd, count(*) AS n FROM variables GROUP BY 1",
}
