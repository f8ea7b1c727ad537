"""Metadata of tables and variables: coverage, latest vintages, cards, labels, denominators, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..runtime import table

#: Card weights by kind (fixed values).
CARD_WEIGHTS = {"table_description": 1.0, "table_avoid_when": 1.0, "table_question_canonical": 1.5, "table_question_varied": 1.3, "table_question_negative": 1.0, "var_label_natural": 1.0, "var_question": 2.0}
QUESTIONS_MOST = 3


def tid(c: str = "table_id") -> Column:
    return F.upper(F.trim(c))


def latest(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """One row per key: the first in the given order."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("__rn = 1").drop("__rn")


def divided(rows: DataFrame, by: list[str], item: str, wanted: list[str]) -> DataFrame:
    """Keys that have every wanted item (relational division); with none wanted, every key."""
    if not wanted:
        return rows.select(*by).distinct()
    return rows.where(F.col(item).isin(wanted)).groupBy(*by).agg(F.countDistinct(item).alias("__n")).where(F.col("__n") == len(set(wanted))).drop("__n")


def segments(label: Column) -> Column:
    """The parts of a label, upper case, whatever separates them."""
    s = F.split(F.upper(F.trim(label)), r"!!|:|;|,| - |\(|\)")
    return F.filter(F.transform(s, lambda x: F.trim(x)), lambda x: x != "")


# queries


def coverage_division(spark, d):
    c = table(spark, d, "coverage").where("status = 'success'").select(tid().alias("table_id"), "dataset", "year", "geo_level")
    return divided(c, ["table_id", "dataset", "year"], "geo_level", ["county", "state"])


def coverage_exists(spark, d):
    """Registered vintages with a successful row for each wanted level: one semi-join a level."""
    t = table(spark, d, "stat_tables").select("table_id", "dataset", "year").distinct()
    c = table(spark, d, "coverage").where("status = 'success'").select(tid().alias("table_id"), "dataset", "year", "geo_level")
    for level in ("tract", "us"):
        t = t.join(c.where(F.col("geo_level") == level), ["table_id", "dataset", "year"], "left_semi")
    return t


def coverage_maps(spark, d):
    c = table(spark, d, "coverage").where("status = 'success'").groupBy(tid().alias("table_id"))
    return c.agg(F.array_join(F.array_sort(F.collect_set("geo_level")), ",").alias("levels"), F.array_join(F.transform(F.array_sort(F.collect_set("year")), lambda y: y.cast("string")), ",").alias("years"))


def coverage_latest_status(spark, d):
    """The last check of each table, vintage and level, with the number of checks before it."""
    c = table(spark, d, "coverage").withColumns({"table_id": tid()})
    w = W.partitionBy("table_id", "dataset", "year", "geo_level").orderBy(F.desc("loaded_at"), F.desc("coverage_id"))
    c = c.withColumn("rn", F.row_number().over(w)).withColumn("checks", F.count(F.lit(1)).over(W.partitionBy("table_id", "dataset", "year", "geo_level")))
    return c.where("rn = 1").select("table_id", "dataset", "year", "geo_level", "status", "row_count", "checks")


def variable_coverage_report(spark, d):
    """Registered against delivered variables per table vintage: missing, extra and share."""
    want = table(spark, d, "variables").select(tid().alias("table_id"), "year", F.upper(F.trim("variable_id")).alias("v")).distinct()
    have = table(spark, d, "stat_values").select(tid().alias("table_id"), "year", F.upper(F.trim("variable_id")).alias("v")).distinct().withColumn("got", F.lit(1))
    j = want.withColumn("due", F.lit(1)).join(have, ["table_id", "year", "v"], "full")
    g = j.groupBy("table_id", "year").agg(F.count("due").alias("expected"), F.count(F.when(F.col("due").isNotNull() & F.col("got").isNotNull(), 1)).alias("actual"), F.count(F.when(F.col("got").isNull(), 1)).alias("missing"), F.count(F.when(F.col("due").isNull(), 1)).alias("extra"))
    return g.withColumn("pct", F.when(F.col("expected") == 0, 100.0).otherwise(F.round(F.col("actual") / F.when(F.col("expected") > 0, F.col("expected")) * 100, 4)))


def dataset_years(spark, d):
    return table(spark, d, "hmda_lar").groupBy("activity_year").count().withColumnRenamed("count", "n")


def latest_vintage(spark, d):
    t = table(spark, d, "stat_tables").where("deleted_at IS NULL")
    return latest(t, ["table_id", "dataset"], [F.desc("year"), F.desc("registered_at"), "title"]).select("table_id", "dataset", "year", "title")


def label_latest(spark, d):
    v = table(spark, d, "variables").where("trim(label_natural) <> ''").select(tid().alias("table_id"), "dataset", "variable_id", "year", "label_natural", "loaded_at", "var_row_id")
    return latest(v, ["table_id", "dataset", "variable_id"], [F.desc("year"), F.desc("loaded_at"), F.desc("var_row_id")]).select("table_id", "dataset", "variable_id", "year", "label_natural")


def metadata_join(spark, d):
    """Variables with the title of their own table vintage (three keys)."""
    t = table(spark, d, "stat_tables").where("deleted_at IS NULL").select("table_id", "dataset", "year", "title", "measure_type").distinct()
    v = table(spark, d, "variables").select(tid().alias("table_id"), "dataset", "year", "variable_id").distinct()
    return v.join(t, ["table_id", "dataset", "year"]).groupBy("table_id", "dataset", "year", "title", "measure_type").agg(F.countDistinct("variable_id").alias("variables"))


def question_chain(spark, d):
    """Questions of variables through the variable (latest vintage) to its table."""
    q = table(spark, d, "variable_questions").where("trim(question_text) <> ''").select(tid().alias("table_id"), "dataset", F.upper(F.trim("var_id")).alias("v"), "question_id", "polarity")
    v = table(spark, d, "variables").groupBy(tid().alias("table_id"), "dataset", F.upper(F.trim("variable_id")).alias("v")).agg(F.max("year").alias("year"))
    t = table(spark, d, "stat_tables").where("deleted_at IS NULL").select("table_id", "dataset", "year", "subject_area").distinct()
    return q.join(v, ["table_id", "dataset", "v"]).join(t, ["table_id", "dataset", "year"]).groupBy("subject_area", "polarity").agg(F.count(F.lit(1)).alias("questions"))


def labels_with_cards(spark, d):
    """Variables and how many label cards stand for them; the constant condition filters the right side before a left join."""
    v = table(spark, d, "variables").select(tid().alias("table_id"), "dataset", "year", F.upper(F.trim("variable_id")).alias("v")).distinct()
    c = table(spark, d, "cards").where("card_type = 'var_label_natural'").select(tid("target_table_id").alias("table_id"), F.col("target_dataset").alias("dataset"), F.col("target_year").alias("year"), F.upper(F.trim("target_variable_id")).alias("v"), "rowid")
    return v.join(c, ["table_id", "dataset", "year", "v"], "left").groupBy("table_id", "dataset", "year").agg(F.count("rowid").alias("cards"), F.count(F.lit(1)).alias("rows_joined"))


def label_row_in(spark, d):
    """Variables asked for by a four-part key: a semi-join on all parts."""
    v = table(spark, d, "variables").select(tid().alias("table_id"), "dataset", "year", F.upper(F.trim("variable_id")).alias("variable_id"), "label_natural")
    k = table(spark, d, "cards").select(tid("target_table_id").alias("table_id"), F.col("target_dataset").alias("dataset"), F.col("target_year").alias("year"), F.upper(F.trim("target_variable_id")).alias("variable_id"))
    return v.join(k, ["table_id", "dataset", "year", "variable_id"], "left_semi").distinct()


def card_union(spark, d):
    """Cards built anew from descriptions, cautions, labels and questions: one union, one weight per kind."""
    w = lambda k: (F.lit(k).alias("card_type"), F.lit(CARD_WEIGHTS[k]).alias("weight"))
    none = F.lit(None).cast("string").alias("variable_id")
    t = table(spark, d, "stat_tables").where("deleted_at IS NULL")
    desc = t.where("trim(description) <> ''").select("table_id", none, F.col("description").alias("text"), *w("table_description"))
    avoid = t.where("trim(avoid_when) <> ''").select("table_id", none, F.col("avoid_when").alias("text"), *w("table_avoid_when"))
    label = label_latest(spark, d).select("table_id", "variable_id", F.col("label_natural").alias("text"), *w("var_label_natural"))
    kind = F.when(F.col("polarity") == "negative", "table_question_negative").when(F.col("question_type") == "varied", "table_question_varied").otherwise("table_question_canonical")
    q = table(spark, d, "table_questions").where("trim(question_text) <> ''").withColumn("k", kind)
    weights = F.create_map(*[x for k, v in CARD_WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    tq = q.select(tid().alias("table_id"), none, F.col("question_text").alias("text"), F.col("k").alias("card_type"), weights[F.col("k")].alias("weight"))
    vq = table(spark, d, "variable_questions").where((F.trim("question_text") != "") & (F.col("position") < QUESTIONS_MOST)).select(tid().alias("table_id"), F.upper(F.trim("var_id")).alias("variable_id"), F.col("question_text").alias("text"), *w("var_question"))
    out = desc.unionByName(avoid).unionByName(label).unionByName(tq).unionByName(vq)
    return out.groupBy("card_type", "weight").agg(F.count(F.lit(1)).alias("cards"), F.countDistinct("table_id").alias("tables"), F.count("variable_id").alias("with_variable"))


def card_anti_append(spark, d):
    """Label cards not there yet: an anti-join that treats equal nulls as equal."""
    new = table(spark, d, "variables").select(tid().alias("t"), F.when(F.col("role") == "measure", F.upper(F.trim("variable_id"))).alias("v")).distinct()
    old = table(spark, d, "cards").select(tid("target_table_id").alias("ct"), F.upper(F.trim("target_variable_id")).alias("cv")).distinct()
    return new.join(old, (F.col("t") == F.col("ct")) & F.col("v").eqNullSafe(F.col("cv")), "left_anti").groupBy("t").agg(F.count(F.lit(1)).alias("new_cards"))


def questions_per_variable(spark, d):
    """The first questions of each variable, repeats (in any case) out, in position order."""
    q = table(spark, d, "variable_questions").where("trim(question_text) <> ''").withColumns({"t": tid(), "v": F.upper(F.trim("var_id")), "k": F.lower(F.trim("question_text"))})
    once = latest(q, ["t", "v", "k"], ["position", "question_id"])
    w = W.partitionBy("t", "v").orderBy("position", "question_id")
    return once.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= QUESTIONS_MOST).select(F.col("t").alias("table_id"), F.col("v").alias("variable_id"), "question_id", "rn")


def citations(spark, d):
    """What was used per table vintage: how many variables and rows, and the first variables in id order."""
    s = table(spark, d, "stat_values").select("table_id", "dataset_path", "year", F.upper(F.trim("variable_id")).alias("v"))
    return s.groupBy("table_id", F.col("dataset_path").alias("dataset"), "year").agg(F.countDistinct("v").alias("variables"), F.count(F.lit(1)).alias("rows_used"), F.array_join(F.slice(F.array_sort(F.collect_set("v")), 1, 3), ",").alias("first_variables"))


def denominator_pairs(spark, d):
    """The nearest ancestor of each label within its table vintage: the longest proper prefix of its parts that is itself a label."""
    v = latest(table(spark, d, "variables").select(tid().alias("table_id"), "dataset", "year", "variable_id", "label_natural", "loaded_at", "var_row_id"), ["table_id", "dataset", "year", "variable_id"], [F.desc("loaded_at"), F.desc("var_row_id")]).withColumn("seg", segments(F.col("label_natural")))
    key = ["table_id", "dataset", "year"]
    own = v.where("size(seg) > 0").groupBy(*key, F.array_join("seg", "|").alias("path")).agg(F.min("variable_id").alias("denominator"))
    up = v.where("size(seg) > 1").select(*key, "variable_id", F.explode(F.sequence(F.lit(1), F.size("seg") - 1)).alias("n"), "seg").select(*key, "variable_id", "n", F.expr("array_join(slice(seg, 1, n), '|')").alias("path"))
    return up.join(own, [*key, "path"]).groupBy(*key, "variable_id").agg(F.max_by("denominator", "n").alias("denominator"))


def label_tree(spark, d):
    """Children per first label part of each table (latest vintage), and how deep it goes."""
    v = label_latest(spark, d).withColumn("seg", segments(F.col("label_natural"))).where("size(seg) > 0")
    return v.groupBy("table_id", F.col("seg")[0].alias("root")).agg(F.count(F.lit(1)).alias("members"), F.max(F.size("seg")).alias("depth"), F.countDistinct(F.get("seg", F.lit(1))).alias("children"))


def earns_questions(spark, d):
    """Variables that deserve questions: totals, those of depth 2 at most, commonly asked ones, summary statistics."""
    ok = (F.col("is_total") == 1) | (F.col("depth") <= 2) | (F.col("is_commonly_queried") == 1) | F.col("kind").isin("median", "aggregate", "ratio")
    return table(spark, d, "variables").groupBy(tid().alias("table_id")).agg(F.sum(F.coalesce(ok, F.lit(False)).cast("bigint")).alias("earning"), F.count(F.lit(1)).alias("variables"))


def variable_roles(spark, d):
    """Classes of variables by name and kind."""
    c = F.col("column_name")
    role = F.when(c.rlike("weight|wgt"), "weight").when(c.rlike("(^|_)id$|serial"), "identifier").when(F.col("predicate_type").rlike("(?i)str|char"), "other").otherwise("substantive")
    return table(spark, d, "variables").groupBy("dataset", role.alias("class")).agg(F.count(F.lit(1)).alias("n"))


def column_collisions(spark, d):
    """Column names used by several variables of a vintage get the id's tail appended."""
    v = table(spark, d, "variables").where("column_name IS NOT NULL").select(tid().alias("table_id"), "dataset", "year", F.upper(F.trim("variable_id")).alias("variable_id"), "column_name").distinct()
    n = F.count(F.lit(1)).over(W.partitionBy("table_id", "dataset", "year", "column_name"))
    return v.withColumn("n", n).where("n > 1").select("table_id", "dataset", "year", "variable_id", F.concat_ws("_", "column_name", F.lower(F.substring_index("variable_id", "_", -1))).alias("resolved"))


def json_filter_fields(spark, d):
    """How often each field of the JSON filters of questions is asked, and under which polarity."""
    q = table(spark, d, "variable_questions").where("required_filters_json IS NOT NULL")
    k = q.select("polarity", F.explode_outer(F.json_object_keys("required_filters_json")).alias("field"))
    return k.groupBy("polarity", "field").agg(F.count(F.lit(1)).alias("n"))


def json_props(spark, d):
    """Counts and averages over a JSON field of events."""
    e = table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").try_cast("double").alias("k"))
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.round(F.avg("k"), 6).alias("mean"), F.sum((F.col("k") > 50).cast("bigint")).alias("high"))


_T = "upper(trim(table_id))"
_SEG = "list_filter(list_transform(regexp_split_to_array(upper(trim(label_natural)), '!!|:|;|,| - |\\(|\\)'), lambda x: trim(x)), lambda x: x <> '')"
_LBL = f"(SELECT {_T} AS table_id, dataset, variable_id, arg_max(year, (year, loaded_at, var_row_id)) AS year, arg_max(label_natural, (year, loaded_at, var_row_id)) AS label_natural FROM variables WHERE trim(label_natural) <> '' GROUP BY 1, 2, 3)"
QUERIES = {f.__name__: f for f in (coverage_division, coverage_exists, coverage_maps, coverage_latest_status, variable_coverage_report, dataset_years, latest_vintage, label_latest, metadata_join, question_chain, labels_with_cards, label_row_in, card_union, card_anti_append, questions_per_variable, citations, denominator_pairs, label_tree, earns_questions, variable_roles, column_collisions, json_filter_fields, json_props)}
SQL = {
    "coverage_division": f"SELECT {_T} AS table_id, dataset, year FROM coverage WHERE status = 'success' AND geo_level IN ('county', 'state') GROUP BY 1, 2, 3 HAVING count(DISTINCT geo_level) = 2",
    "coverage_exists": "SELECT DISTINCT table_id, dataset, year FROM stat_tables t WHERE " + " AND ".join(f"EXISTS (SELECT 1 FROM coverage c WHERE c.status = 'success' AND c.geo_level = '{x}' AND upper(trim(c.table_id)) = t.table_id AND c.dataset = t.dataset AND c.year = t.year)" for x in ("tract", "us")),
    "coverage_maps": f"SELECT {_T} AS table_id, array_to_string(list_sort(list(DISTINCT geo_level)), ',') AS levels, array_to_string(list_sort(list(DISTINCT year)), ',') AS years FROM coverage WHERE status = 'success' GROUP BY 1",
    "coverage_latest_status": f"SELECT {_T} AS table_id, dataset, year, geo_level, arg_max(status, (loaded_at, coverage_id)) AS status, last(row_count ORDER BY loaded_at, coverage_id) AS row_count, count(*) AS checks FROM coverage GROUP BY 1, 2, 3, 4",
    "variable_coverage_report": f"WITH w AS (SELECT DISTINCT {_T} AS t, year, upper(trim(variable_id)) AS v, 1 AS due FROM variables), h AS (SELECT DISTINCT {_T} AS t, year, upper(trim(variable_id)) AS v, 1 AS got FROM stat_values) SELECT t AS table_id, year, count(due) AS expected, count(*) FILTER (due IS NOT NULL AND got IS NOT NULL) AS actual, count(*) FILTER (got IS NULL) AS missing, count(*) FILTER (due IS NULL) AS extra, CASE WHEN count(due) = 0 THEN 100.0 ELSE round(count(*) FILTER (due IS NOT NULL AND got IS NOT NULL) / count(due)::DOUBLE * 100, 4) END AS pct FROM w FULL JOIN h USING (t, year, v) GROUP BY 1, 2",
    "dataset_years": "SELECT activity_year, count(*) AS n FROM hmda_lar GROUP BY 1",
    "latest_vintage": "SELECT table_id, dataset, year, title FROM (SELECT *, row_number() OVER (PARTITION BY table_id, dataset ORDER BY year DESC, registered_at DESC, title) AS rn FROM stat_tables WHERE deleted_at IS NULL) WHERE rn = 1",
    "label_latest": f"SELECT table_id, dataset, variable_id, year, label_natural FROM {_LBL}",
    "metadata_join": f"SELECT table_id, dataset, year, title, measure_type, count(DISTINCT v) AS variables FROM (SELECT {_T} AS table_id, dataset, year, variable_id AS v FROM variables) JOIN (SELECT DISTINCT table_id, dataset, year, title, measure_type FROM stat_tables WHERE deleted_at IS NULL) USING (table_id, dataset, year) GROUP BY ALL",
    "question_chain": f"SELECT subject_area, polarity, count(*) AS questions FROM (SELECT {_T} AS t, dataset, upper(trim(var_id)) AS v, polarity FROM variable_questions WHERE trim(question_text) <> '') q JOIN (SELECT {_T} AS t, dataset, upper(trim(variable_id)) AS v, max(year) AS year FROM variables GROUP BY 1, 2, 3) USING (t, dataset, v) JOIN (SELECT DISTINCT table_id AS t, dataset, year, subject_area FROM stat_tables WHERE deleted_at IS NULL) USING (t, dataset, year) GROUP BY 1, 2",
    "labels_with_cards": f"SELECT v.table_id, v.dataset, v.year, count(rowid_) AS cards, count(*) AS rows_joined FROM (SELECT DISTINCT {_T} AS table_id, dataset, year, upper(trim(variable_id)) AS v FROM variables) v LEFT JOIN (SELECT upper(trim(target_table_id)) AS t, target_dataset AS ds, target_year AS y, upper(trim(target_variable_id)) AS cv, \"rowid\" AS rowid_ FROM cards WHERE card_type = 'var_label_natural') c ON t = v.table_id AND ds = v.dataset AND y = v.year AND cv = v.v GROUP BY 1, 2, 3",
    "label_row_in": f"SELECT DISTINCT {_T} AS table_id, dataset, year, upper(trim(variable_id)) AS variable_id, label_natural FROM variables WHERE ({_T}, dataset, year, upper(trim(variable_id))) IN (SELECT (upper(trim(target_table_id)), target_dataset, target_year, upper(trim(target_variable_id))) FROM cards WHERE target_table_id IS NOT NULL AND target_variable_id IS NOT NULL)",
    "card_union": f"""WITH x AS (SELECT table_id, NULL::VARCHAR AS variable_id, 'table_description' AS card_type, 1.0::DOUBLE AS weight FROM stat_tables WHERE deleted_at IS NULL AND trim(description) <> ''
UNION ALL SELECT table_id, NULL, 'table_avoid_when', 1.0 FROM stat_tables WHERE deleted_at IS NULL AND trim(avoid_when) <> '' UNION ALL SELECT table_id, variable_id, 'var_label_natural', 1.0 FROM {_LBL}
UNION ALL SELECT {_T}, NULL, CASE WHEN polarity = 'negative' THEN 'table_question_negative' WHEN question_type = 'varied' THEN 'table_question_varied' ELSE 'table_question_canonical' END, CASE WHEN polarity = 'negative' THEN 1.0 WHEN question_type = 'varied' THEN 1.3 ELSE 1.5 END FROM table_questions WHERE trim(question_text) <> ''
UNION ALL SELECT {_T}, upper(trim(var_id)), 'var_question', 2.0 FROM variable_questions WHERE trim(question_text) <> '' AND position < {QUESTIONS_MOST}) SELECT card_type, weight, count(*) AS cards, count(DISTINCT table_id) AS tables, count(variable_id) AS with_variable FROM x GROUP BY 1, 2""",
    "card_anti_append": f"WITH n AS (SELECT DISTINCT {_T} AS t, CASE WHEN role = 'measure' THEN upper(trim(variable_id)) END AS v FROM variables) SELECT t, count(*) AS new_cards FROM n WHERE NOT EXISTS (SELECT 1 FROM cards c WHERE upper(trim(c.target_table_id)) = n.t AND upper(trim(c.target_variable_id)) IS NOT DISTINCT FROM n.v) GROUP BY 1",
    "questions_per_variable": f"WITH q AS (SELECT *, {_T} AS t, upper(trim(var_id)) AS v FROM variable_questions WHERE trim(question_text) <> '' QUALIFY row_number() OVER (PARTITION BY {_T}, upper(trim(var_id)), lower(trim(question_text)) ORDER BY position, question_id) = 1) SELECT t AS table_id, v AS variable_id, question_id, (row_number() OVER (PARTITION BY t, v ORDER BY position, question_id))::INT AS rn FROM q QUALIFY rn <= {QUESTIONS_MOST}",
    "citations": "SELECT table_id, dataset_path AS dataset, year, count(DISTINCT upper(trim(variable_id))) AS variables, count(*) AS rows_used, array_to_string(list_sort(list(DISTINCT upper(trim(variable_id))))[1:3], ',') AS first_variables FROM stat_values GROUP BY 1, 2, 3",
    "denominator_pairs": f"""WITH v AS (SELECT {_T} AS table_id, dataset, year, variable_id, arg_max({_SEG}, (loaded_at, var_row_id)) AS seg FROM variables GROUP BY 1, 2, 3, 4),
o AS (SELECT table_id, dataset, year, array_to_string(seg, '|') AS path, min(variable_id) AS den FROM v WHERE len(seg) > 0 GROUP BY 1, 2, 3, 4),
u AS (SELECT v.*, n, array_to_string(seg[1:n], '|') AS path FROM v, range(1, 20) t(n) WHERE n < len(seg)) SELECT table_id, dataset, year, variable_id, arg_max(den, n) AS denominator FROM u JOIN o USING (table_id, dataset, year, path) GROUP BY 1, 2, 3, 4""",
    "label_tree": f"SELECT table_id, seg[1] AS root, count(*) AS members, max(len(seg))::INT AS depth, count(DISTINCT seg[2]) AS children FROM (SELECT table_id, {_SEG} AS seg FROM {_LBL}) WHERE len(seg) > 0 GROUP BY 1, 2",
    "earns_questions": f"SELECT {_T} AS table_id, sum(coalesce(is_total = 1 OR depth <= 2 OR is_commonly_queried = 1 OR kind IN ('median', 'aggregate', 'ratio'), false)::INT)::BIGINT AS earning, count(*) AS variables FROM variables GROUP BY 1",
    "variable_roles": "SELECT dataset, CASE WHEN regexp_matches(column_name, 'weight|wgt') THEN 'weight' WHEN regexp_matches(column_name, '(^|_)id$|serial') THEN 'identifier' WHEN regexp_matches(lower(predicate_type), 'str|char') THEN 'other' ELSE 'substantive' END AS class, count(*) AS n FROM variables GROUP BY 1, 2",
    "column_collisions": f"WITH v AS (SELECT DISTINCT {_T} AS table_id, dataset, year, upper(trim(variable_id)) AS variable_id, column_name FROM variables WHERE column_name IS NOT NULL) SELECT table_id, dataset, year, variable_id, column_name || '_' || lower(regexp_extract(variable_id, '[^_]*$')) AS resolved FROM v QUALIFY count(*) OVER (PARTITION BY table_id, dataset, year, column_name) > 1",
    "json_filter_fields": "SELECT polarity, field, count(*) AS n FROM (SELECT polarity, unnest(CASE WHEN len(json_keys(required_filters_json)) = 0 THEN [NULL] ELSE json_keys(required_filters_json) END) AS field FROM variable_questions WHERE required_filters_json IS NOT NULL) GROUP BY 1, 2",
    "json_props": "SELECT event_type, count(k) AS n, round(avg(k), 6) AS mean, sum((k > 50)::INT)::BIGINT AS high FROM (SELECT event_type, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) GROUP BY 1",
}
