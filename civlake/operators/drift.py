"""Schemas that drift between vintages.

Each vintage's columns are profiled (label with the spelling taken out, type class, value sketch).  A column present in
two neighbouring vintages is compared with itself.  The columns that come and go between two vintages of a table are
matched by a bipartite assignment over name, type and value-sketch distance: first those whose labels say the same,
then, of the others, those whose profiles are near enough, whatever their labels say.  The assignment decides what is
renamed.  Chains of matches give one list of columns over all vintages.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..runtime import BLANKS, durable, partitions, salted_join, table
from .wide import row_value

#: A column whose label says something else is taken for another one renamed if their labels share this much of their
#: words and the cost (name + value + words not shared) stays under LIKELY_COST.
LIKELY_WORDS, LIKELY_COST = 0.5, 1.0
SHORT_FORMS = {"hh": "households", "pct": "percent", "pop": "population", "no": "number"}
INFLATION = r"\(?\s*(?:in\s+)?(?:\d{4}\s+)?(?:inflation[\s-]*adjusted(?:\s+dollars?)?|dollars?\s*,?\s+adjusted\s+for\s+inflation)(?:\s+(?:of|to|in)\s+\d{4})?\s*\)?"


def said(label: Column) -> Column:
    """What a label says: case, punctuation, spacing, short forms and the inflation remark taken out."""
    return F.regexp_replace(label_words(label), r"[^\p{L}\p{N}]+", "")


def label_words(label: Column) -> Column:
    """A label in lower case, with its short forms spelled out and without the inflation remark."""
    t = F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), INFLATION, " ")
    t = F.regexp_replace(t, "&", " and ")
    for short, full in SHORT_FORMS.items():
        t = F.regexp_replace(t, rf"\b{short}\b", full)
    return t


def type_class(t: Column) -> Column:
    x = F.lower(F.trim(t))
    return F.when(x.rlike("int|long|short|serial"), "integer").when(x.rlike("float|double|real|decimal|numeric|number"), "floating").when(x.rlike("str|char|text"), "text").otherwise(F.coalesce(x, F.lit("")))


def profiles(variables: DataFrame) -> DataFrame:
    """One row per (dataset, table_id, year, variable_id): label, said, kind; of repeated deliveries the last counts.

    A blank table id, id or year gives no column.  Equal arrival times are settled by var_row_id.
    """
    rows = variables.select("dataset", F.upper(F.btrim("table_id", F.lit(BLANKS))).alias("table_id"), "year", F.btrim("variable_id", F.lit(BLANKS)).alias("variable_id"), F.struct(F.coalesce(F.col("loaded_at").cast("timestamp_ltz"), F.timestamp_micros(F.lit(-(1 << 55)))).alias("at"), "var_row_id", F.col("label_natural").alias("label"), F.col("predicate_type").alias("type")).alias("x"))
    last = rows.where("table_id <> '' AND variable_id <> '' AND year IS NOT NULL").groupBy("dataset", "table_id", "year", "variable_id").agg(F.max("x").alias("x"))
    return last.select("dataset", "table_id", "year", "variable_id", F.col("x.label").alias("label"), said(F.col("x.label")).alias("said"), label_words(F.col("x.label")).alias("words"), type_class(F.col("x.type")).alias("kind"))


def value_sketches(values: DataFrame) -> DataFrame:
    """Per table, vintage and variable: how many values, their mean and spread on a log scale."""
    v = row_value(F.col("estimate"), F.col("annotation"))
    x = F.signum(v) * F.log1p(F.abs(v))
    return values.select(F.upper(F.btrim("table_id", F.lit(BLANKS))).alias("table_id"), "year", F.upper(F.btrim("variable_id", F.lit(BLANKS))).alias("variable_id"), x.alias("x")).groupBy("table_id", "year", "variable_id").agg(F.count("x").alias("n_values"), F.avg("x").alias("centre"), F.stddev_pop("x").alias("spread"))


def _placed(cols: DataFrame) -> DataFrame:
    """Number the vintages of each table and mark where a column's unbroken run begins and ends."""
    c = cols.withColumn("tkey", F.concat_ws("\x1f", F.coalesce("dataset", F.lit("\x00")), "table_id"))
    years = c.select("tkey", "year").distinct().groupBy("tkey").agg(F.sort_array(F.collect_list("year")).alias("years"))
    c = salted_join(c, years, "tkey", "variable_id", "inner").withColumn("v", F.array_position("years", F.col("year")).cast("int")).withColumn("n_vintages", F.size("years"))
    w = W.partitionBy("tkey", "variable_id").orderBy("v")
    c = c.withColumn("stays_from", F.lag("v").over(w) == F.col("v") - 1).withColumn("stays_to", F.lead("v").over(w) == F.col("v") + 1)
    c = c.withColumn("was_said", F.lag("said").over(w)).withColumn("was_kind", F.lag("kind").over(w))
    start = F.last(F.when(~F.coalesce("stays_from", F.lit(False)), F.col("v")), True).over(w.rowsBetween(W.unboundedPreceding, 0))
    return c.withColumn("run", start)


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Minimum-cost assignment of the rows to the columns of ``cost`` (shortest augmenting paths), rows <= columns."""
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        low, came, used = np.full(m + 1, math.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while owner[j0]:
            used[j0] = True
            i0 = owner[j0]
            free = np.nonzero(~used[1:])[0] + 1
            step = cost[i0 - 1, free - 1] - u[i0] - v[free]
            better = step < low[free]
            low[free[better]], came[free[better]] = step[better], j0
            j1 = free[np.argmin(low[free])]
            delta = low[j1]
            u[owner[used]] += delta
            v[used] -= delta
            low[~used] -= delta
            j0 = j1
        while j0:
            owner[j0], j0 = owner[came[j0]], came[j0]
    return [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]


def _name_distance(a: list[str], b: list[str]) -> np.ndarray:
    """Share of letter pairs that two ids do not have in common, for each of ``a`` and each of ``b``."""
    place: dict[str, int] = {}

    def counts(names: list[str]) -> list[dict[int, int]]:
        out = []
        for n in names:
            own: dict[int, int] = defaultdict(int)
            for x, y in zip(f"^{n.lower()}", f"{n.lower()}$", strict=True):
                own[place.setdefault(x + y, len(place))] += 1
            out.append(own)
        return out

    ca, cb = counts(a), counts(b)
    y = np.zeros((len(b), len(place)), dtype=np.float32)
    for j, own in enumerate(cb):
        y[j, list(own)] = list(own.values())
    size = y.sum(axis=1)
    out = np.empty((len(a), len(b)))
    for i, own in enumerate(ca):
        at, n = np.fromiter(own, dtype=int), np.fromiter(own.values(), dtype=np.float32)
        out[i] = 1 - 2 * np.minimum(y[:, at], n).sum(axis=1) / (n.sum() + size)
    return out


def _costs(new: pd.DataFrame, old: pd.DataFrame) -> np.ndarray:
    """Name distance, sketch distance (0.5 where one is not known) and 1 for another type class."""
    name = _name_distance(new["variable_id"].tolist(), old["variable_id"].tolist())
    c, s = ([f[k].to_numpy(dtype=float) for f in (new, old)] for k in ("centre", "spread"))
    value = np.minimum(1.0, np.abs(c[0][:, None] - c[1][None]) / (0.1 + np.nan_to_num(s[0])[:, None] + np.nan_to_num(s[1])[None]))
    return name + np.where(np.isnan(value), 0.5, value) + (new["kind"].to_numpy()[:, None] != old["kind"].to_numpy()[None])


def _assigned(cost: np.ndarray) -> list[tuple[int, int]]:
    return [(i, j) for j, i in assignment(cost.T)] if cost.shape[0] > cost.shape[1] else assignment(cost)


def _match(g: pd.DataFrame) -> pd.DataFrame:
    """The columns that come and go between two vintages of a table, with old_id, matched_by and cost."""
    g = g.sort_values(["side", "variable_id"], kind="stable").reset_index(drop=True)
    old_id, by, price = [None] * len(g), [None] * len(g), [None] * len(g)
    where = {s: np.nonzero(g["side"].to_numpy() == s)[0] for s in ("new", "old")}
    blocks: dict[str, tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))
    for k, s in enumerate(("new", "old")):
        for r in where[s]:
            blocks[g.at[r, "said"]][k].append(r)
    rest: tuple[list[int], list[int]] = ([], [])
    for new, old in blocks.values():
        pairs = []
        if new and old:
            cost = _costs(g.loc[new], g.loc[old])
            pairs = _assigned(cost)
        for i, j in pairs:
            old_id[new[i]], price[new[i]] = g.at[old[j], "variable_id"], float(cost[i, j])
        if pairs:  # those left over of a matched block say the same as a column of the other side as well
            for r in [*new, *old]:
                by[r] = "label"
        else:
            rest[0].extend(new)
            rest[1].extend(old)
    for new, old, near in _likely(g, *rest):
        cost = np.where(near < LIKELY_COST, near, LIKELY_COST)
        for i, j in _assigned(cost):
            if near[i, j] < LIKELY_COST:
                old_id[new[i]], by[new[i]], price[new[i]] = g.at[old[j], "variable_id"], "profile", float(near[i, j])
    return g[["tkey", "dataset", "table_id", "year", "v", "side", "variable_id"]].assign(old_id=old_id, matched_by=by, cost=price)


def _likely(g: pd.DataFrame, new: list[int], old: list[int]):
    """Components of the columns that could be each other by the words of their labels, with their costs."""
    words = {r: frozenset(re.findall(r"[^\W_]+", g.at[r, "words"] or "")) for r in [*new, *old]}
    having = defaultdict(list)
    for j in old:
        for w in words[j]:
            having[w].append(j)
    edges, root = {}, {r: r for r in [*new, *old]}

    def find(r: int) -> int:
        while root[r] != r:
            root[r] = root[root[r]]
            r = root[r]
        return r

    for i in new:
        shared: dict[int, int] = defaultdict(int)
        for w in words[i]:
            for j in having[w]:
                shared[j] += 1
        for j, n in shared.items():
            part = n / (len(words[i]) + len(words[j]) - n)
            if part >= LIKELY_WORDS and g.at[i, "kind"] == g.at[j, "kind"]:
                edges[i, j] = part
                root[find(i)] = find(j)
    parts: dict[int, tuple[set[int], set[int]]] = defaultdict(lambda: (set(), set()))
    for i, j in edges:
        parts[find(i)][0].add(i)
        parts[find(i)][1].add(j)
    for a, b in parts.values():
        a, b = sorted(a), sorted(b)
        apart = np.array([[1 - edges.get((i, j), -math.inf) for j in b] for i in a])
        yield a, b, _costs(g.loc[a], g.loc[b]) + apart


def matched_columns(placed: DataFrame, sketches: DataFrame | None) -> DataFrame:
    """Every column that comes (side new) or goes (old), by the vintage v that lacks or has it: old_id, matched_by, cost.

    matched_by: ``label`` where the labels say the same, ``profile`` where only the profiles are alike, null unmatched.
    A group is the columns that come and go between two vintages of one table, so it grows with the width of a table only.
    """
    keep = ["tkey", "dataset", "table_id", "year", "v", "said", "words", "kind", "variable_id", "side", "of_year"]
    new = placed.where("v > 1 AND NOT coalesce(stays_from, false)").withColumns({"side": F.lit("new"), "of_year": F.col("year")}).select(*keep)
    old = placed.where("v < n_vintages AND NOT coalesce(stays_to, false)").withColumns({"side": F.lit("old"), "of_year": F.col("year"), "year": F.get("years", F.col("v")), "v": F.col("v") + 1}).select(*keep)
    both = new.unionByName(old)
    if sketches is None:
        both = both.withColumns({"centre": F.lit(None).cast("double"), "spread": F.lit(None).cast("double")})
    else:
        s = sketches.select("table_id", F.col("year").alias("of_year"), F.col("variable_id").alias("vid"), "centre", "spread")
        both = both.withColumn("vid", F.upper("variable_id")).join(s, ["table_id", "of_year", "vid"], "left").drop("vid")
    group = W.partitionBy("tkey", "v")
    both = both.withColumns({"n_new": F.count(F.when(F.col("side") == "new", 1)).over(group), "n_old": F.count(F.when(F.col("side") == "old", 1)).over(group)})
    schema = "tkey string, dataset string, table_id string, year int, v int, side string, variable_id string, old_id string, matched_by string, cost double"
    both = durable(both)
    matched = both.where("n_new > 0 AND n_old > 0").drop("n_new", "n_old").repartition(partitions(placed.sparkSession), "tkey", "v").groupBy("tkey", "v").applyInPandas(_match, schema)
    none = {"old_id": F.lit(None).cast("string"), "matched_by": F.lit(None).cast("string"), "cost": F.lit(None).cast("double")}
    return matched.unionByName(both.where("n_new = 0 OR n_old = 0").withColumns(none).select(*matched.columns))


def schema_changes(variables: DataFrame, values: DataFrame | None = None, placed: DataFrame | None = None, moved: DataFrame | None = None) -> DataFrame:
    """Every change between neighbouring vintages: dataset, table_id, year, variable_id, change, old_id, likely_from.

    ``renamed``: a new id matched to an id now gone whose label says the same (old_id: that id, null for those left over
    where more come than go); ``added`` / ``removed``: other new or gone ids; ``relabelled`` / ``retyped``: an id that stays
    with another label or type class.  likely_from: for an added id, the gone id it probably is by its profile, though the
    label says something else.  A table of one vintage, or none, has no change.
    """
    placed = _placed(profiles(variables)) if placed is None else placed
    moved = matched_columns(placed, None if values is None else value_sketches(values)) if moved is None else moved
    by_label = F.coalesce(F.col("matched_by") == "label", F.lit(False))
    change = F.when((F.col("side") == "new") & by_label, "renamed").when(F.col("side") == "new", "added").when(~by_label, "removed")
    a = moved.select("dataset", "table_id", "year", "variable_id", change.alias("change"), F.when(by_label, F.col("old_id")).alias("old_id"), F.when(~by_label, F.col("old_id")).alias("likely_from")).where("change IS NOT NULL")
    both = F.filter(F.array(F.when(F.col("said") != F.col("was_said"), "relabelled"), F.when(F.col("kind") != F.col("was_kind"), "retyped")), lambda x: x.isNotNull())
    null = F.lit(None).cast("string")
    b = placed.where("stays_from").select("dataset", "table_id", "year", "variable_id", F.explode(both).alias("change"), null.alias("old_id"), null.alias("likely_from"))
    return a.unionByName(b)


def unified_columns(variables: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """One list of columns over all vintages: dataset, table_id, unified_id, variable_id, first_year, last_year, label, kind, next_by.

    A row is an unbroken run of an id; runs linked by a match share the unified_id, the id of the last of them.  next_by:
    how the run is linked to the next one (``label`` or ``profile``), null for the last.
    """
    placed = durable(_placed(profiles(variables)))
    moved = matched_columns(placed, None if values is None else value_sketches(values))
    runs = placed.groupBy("tkey", "dataset", "table_id", "variable_id", "run").agg(F.max("v").alias("until"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.max_by("label", "v").alias("label"), F.max_by("kind", "v").alias("kind"))
    link = moved.where("side = 'new' AND old_id IS NOT NULL").select("tkey", F.col("old_id").alias("variable_id"), (F.col("v") - 1).alias("until"), F.col("variable_id").alias("next_id"), F.col("v").alias("next_run"), F.col("matched_by").alias("next_by"))
    node = lambda i, r: F.concat_ws("\x1f", "tkey", i, F.col(r).cast("string"))
    nodes = runs.join(link, ["tkey", "variable_id", "until"], "left").withColumn("node", node("variable_id", "run"))
    nodes = durable(nodes.withColumn("to", F.coalesce(F.when(F.col("next_id").isNotNull(), node("next_id", "next_run")), F.col("node"))))
    hop = nodes.select("node", "to")
    while True:  # pointer doubling: a chain of n renames is resolved in log2(n) rounds
        far = durable(hop.join(hop.select(F.col("node").alias("to"), F.col("to").alias("far")), "to", "left").select("node", F.coalesce("far", "to").alias("to"), (F.coalesce("far", "to") != F.col("to")).alias("moved")))
        hop = far.select("node", "to")
        if far.where("moved").limit(1).count() == 0:
            break
    out = nodes.drop("to").join(hop, "node")
    return out.select("dataset", "table_id", F.element_at(F.split("to", "\x1f"), -2).alias("unified_id"), "variable_id", "first_year", "last_year", "label", "kind", "next_by")


def p6_changes(spark, d: str) -> DataFrame:
    return schema_changes(table(spark, d, "variables"), table(spark, d, "stat_values"))


def p6_found(spark, d: str) -> DataFrame:
    return p6_changes(spark, d).select("dataset", "table_id", "year", "variable_id", "change").distinct()


def p6_unified(spark, d: str) -> DataFrame:
    return unified_columns(table(spark, d, "variables"), table(spark, d, "stat_values"))


_SAID = "lower(label_natural)"
_SAID = f"regexp_replace({_SAID}, '\\(?\\s*(in\\s+)?([0-9]{{4}}\\s+)?(inflation[\\s-]*adjusted(\\s+dollars?)?|dollars?\\s*,?\\s+adjusted\\s+for\\s+inflation)\\s*\\)?', ' ', 'g')"
_SAID = f"replace({_SAID}, '&', ' and ')"
for _short, _full in SHORT_FORMS.items():
    _SAID = f"regexp_replace({_SAID}, '\\b{_short}\\b', '{_full}', 'g')"
_SAID = f"regexp_replace({_SAID}, '[^a-z0-9]+', '', 'g')"

QUERIES = {"p6_found": p6_found, "p6_changes": p6_changes, "p6_unified": p6_unified}
SQL = {
    "p6_found": f"""
WITH c AS (
  SELECT dataset, upper(trim(table_id)) AS table_id, year, variable_id, arg_max({_SAID}, (loaded_at, var_row_id)) AS said,
         arg_max(CASE WHEN lower(predicate_type) LIKE '%int%' THEN 'i' WHEN regexp_matches(lower(predicate_type), 'float|double') THEN 'f' ELSE 't' END, (loaded_at, var_row_id)) AS kind
  FROM variables GROUP BY ALL
), y AS (SELECT *, lag(year) OVER (PARTITION BY dataset, table_id ORDER BY year) AS before FROM (SELECT DISTINCT dataset, table_id, year FROM c)),
j AS (
  SELECT y.dataset, y.table_id, y.year, coalesce(n.variable_id, o.variable_id) AS variable_id, n.said AS ns, o.said AS os, n.kind AS nk, o.kind AS ok
  FROM (SELECT y.*, k.variable_id FROM y JOIN (SELECT DISTINCT dataset, table_id, variable_id FROM c) k USING (dataset, table_id) WHERE before IS NOT NULL) y
  LEFT JOIN c n ON n.dataset = y.dataset AND n.table_id = y.table_id AND n.year = y.year AND n.variable_id = y.variable_id
  LEFT JOIN c o ON o.dataset = y.dataset AND o.table_id = y.table_id AND o.year = y.before AND o.variable_id = y.variable_id
  WHERE n.variable_id IS NOT NULL OR o.variable_id IS NOT NULL
), m AS (SELECT *, EXISTS (SELECT 1 FROM j b WHERE b.dataset = j.dataset AND b.table_id = j.table_id AND b.year = j.year AND b.ns IS NULL AND b.os = j.ns) AS was,
                EXISTS (SELECT 1 FROM j b WHERE b.dataset = j.dataset AND b.table_id = j.table_id AND b.year = j.year AND b.os IS NULL AND b.ns = j.os) AS becomes FROM j)
SELECT dataset, table_id, year, variable_id, CASE WHEN os IS NULL AND was THEN 'renamed' WHEN os IS NULL THEN 'added' ELSE 'removed' END AS change FROM m WHERE os IS NULL OR (ns IS NULL AND NOT becomes)
UNION ALL SELECT dataset, table_id, year, variable_id, 'relabelled' FROM m WHERE ns <> os
UNION ALL SELECT dataset, table_id, year, variable_id, 'retyped' FROM m WHERE nk <> ok
""",
}
