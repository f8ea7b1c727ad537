"""Text search over an inverted index, exact vector retrieval with aggregation to targets, and keyword matching."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..runtime import partitions, table
from .metadata import tid

K1, B = 1.2, 0.75
ACCEPT_BELOW = -3.0  # a BM25 score (lower is better) above this is no match
QUERY_BLOCK, VECTOR_BLOCK = 4096, 65_536
QUERIES_AT_ONCE = 256
SCORE_FLOOR = 0.05
UNIVERSE_FLOOR = 0.30
COMMON_BOOST = 1.10
#: Marks of labels that hold for a part of the population only, and of leaves of a breakdown (fixed values).
SUBGROUP_MARKS = ("race and hispanic", "hispanic or latino", "disability status", "sex", " by age ", "age of householder", "nativity", "citizenship", "country of birth", "language spoken", "limited english", "household type", "family type", "educational attainment", "school enrollment", "nativity and citizenship", "white alone", "black alone", "asian alone", "hispanic", "white non-hispanic", "non-hispanic white", "black or african american alone", "native hawaiian", "american indian", "two or more races", "some other race alone", "non-hispanic", "latino", "non-latino", "with a disability", "without a disability", "with any disability", "foreign born", "foreign-born", "native born", "native-born", "limited english speaking")
LEAF_MARKS = ("18 to 19", "20 to 24", "25 to 29", "30 to 34", "35 to 39", "40 to 44", "45 to 54", "55 to 59", "60 to 61", "62 to 64", "65 to 66", "67 to 69", "70 to 74", "75 years and over", "75 to 84", "85 years", "under 5", "under 18", "under 6", "5 to 9", "5 to 17", "10 to 14", "15 to 17", "!!male:!!", "!!female:!!", "with own children under 18", "with related children", "less than 9th grade", "9th to 12th grade")
#: Share of its score that a table keeps by the family its id begins with (the longest prefix counts, 1 for others), by an
#: ending PR, and by the letter of a single race (fixed values).
FAMILIES = {"B": 1.0, "C": 0.90, "S": 0.60, "DP": 0.20, "CP": 0.20, "K": 0.40}
PR_SHARE = 0.0
SUBGROUP = r"^[BCS]\d{4,5}[A-I]$"
SUBGROUP_SHARE = 0.30


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def inverted_index(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """term, doc, tf, dl: one row per term and document."""
    t = docs.select(F.col(doc_id).alias("doc"), tokens(F.col(text)).alias("w")).withColumn("dl", F.size("w"))
    return t.select("doc", "dl", F.explode("w").alias("term")).groupBy("term", "doc", "dl").agg(F.count(F.lit(1)).alias("tf"))


def bm25(index: DataFrame, n_docs: DataFrame, queries: list[tuple[str, str]]) -> DataFrame:
    """q, doc, score for documents that have every token of a query (the last as a prefix); lower is better.

    A prefix counts as one phrase: its frequency is the sum over the terms it begins.  ``n_docs``: one row n, avg_dl.
    """
    spark = index.sparkSession
    asked = []
    for q, text in queries:
        words = [w for w in "".join(c.lower() if c.isalnum() else " " for c in text).split()]
        asked += [(q, i, w, i == len(words) - 1, len(words)) for i, w in enumerate(words)]
    a = spark.createDataFrame(asked, "q string, i int, w string, is_prefix boolean, n_words int")
    # a prefix meets the terms with the same first letters, as many as the shortest prefix has: equality in any case
    head = min((len(w) for _, _, w, p, _ in asked if p), default=1)
    whole = index.join(a.where("NOT is_prefix"), F.col("term") == F.col("w"))
    begun = index.withColumn("head", F.substring("term", 1, head)).join(a.where("is_prefix").withColumn("head", F.substring("w", 1, head)), "head").where(F.col("term").startswith(F.col("w"))).drop("head")
    hit = whole.unionByName(begun)
    phrase = hit.groupBy("q", "i", "n_words", "doc", "dl").agg(F.sum("tf").alias("tf"))
    df = phrase.groupBy("q", "i").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    s = phrase.join(df, ["q", "i"]).crossJoin(F.broadcast(n_docs)).withColumn("part", part)
    return s.groupBy("q", "doc", "n_words").agg(F.count(F.lit(1)).alias("m"), (-F.sum("part")).alias("score")).where("m = n_words").select("q", "doc", "score")


def exact_nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """q, id, cosine, rank: the k most similar vectors for each of a stated set of queries (an id never finds itself).

    ``queries`` and ``vectors``: id, v (array).  Nothing is collected: both sides are cut into blocks of at most about
    QUERY_BLOCK and VECTOR_BLOCK rows of one length, each query block meets each vector block of its length in one task,
    and there each query keeps its k best and their ties.  Null, empty and all-zero vectors take no part.
    """
    spark = vectors.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        v = df.select(F.col("id").cast("bigint").alias("id"), F.col("v").cast("array<double>").alias("v"))
        return v.where(F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))

    q, x = usable(queries), usable(vectors)
    sizes = q.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).join(x.groupBy("dim").agg(F.count(F.lit(1)).alias("m")), "dim").collect()
    if not sizes:
        return spark.createDataFrame([], "q bigint, id bigint, cosine double, rank int")
    plan = [(r["dim"], -(-r["n"] // QUERY_BLOCK), -(-r["m"] // VECTOR_BLOCK)) for r in sizes]  # a row for each length
    cut = spark.createDataFrame(plan, "dim int, qs int, xs int")
    spread = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    left = q.join(F.broadcast(cut), "dim").select("dim", spread("qs").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("xs") - 1)).alias("xb"), F.lit(0).alias("side"), "id", "v")
    right = x.join(F.broadcast(cut), "dim").select("dim", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("qb"), spread("xs").alias("xb"), F.lit(1).alias("side"), "id", "v")
    tasks = min(4 * partitions(spark), sum(a * b for _, a, b in plan))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, qid, unit = None, [], []
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(4)], axis=1)
            cuts = np.append(np.concatenate([[0], np.nonzero((key[1:] != key[:-1]).any(axis=1))[0] + 1]), b.num_rows)
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if tuple(key[lo, :3]) != now:
                    now, qid, unit = tuple(key[lo, :3]), [], []
                part = b.slice(lo, hi - lo)
                ids = part.column(4).to_numpy(zero_copy_only=False)
                v = part.column(5).flatten().fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(hi - lo, int(key[lo, 0]))
                norm = np.sqrt((v * v).sum(axis=1))
                ok = norm > 0
                ids, v = ids[ok], v[ok] / norm[ok][:, None]
                if key[lo, 3] == 0:
                    qid.append(ids)
                    unit.append(v)
                    continue
                own, u = (np.concatenate(qid), np.concatenate(unit)) if qid else (ids[:0], v[:0])
                for at in range(0, len(own) if len(ids) else 0, QUERIES_AT_ONCE):
                    part_id = own[at : at + QUERIES_AT_ONCE]
                    s = u[at : at + QUERIES_AT_ONCE] @ v.T
                    s[part_id[:, None] == ids[None]] = -2
                    # whatever ties with the last of the k, as cosines are compared, stays
                    last = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(s), -2.0)
                    i, j = np.nonzero((s >= last[:, None] - 2e-9) & (s > -2))
                    yield pa.RecordBatch.from_arrays([pa.array(part_id[i]), pa.array(ids[j]), pa.array(s[i, j])], names=["q", "id", "cosine"])

    met = left.unionByName(right).repartition(tasks, "dim", "qb", "xb").sortWithinPartitions("dim", "qb", "xb", "side")
    w = W.partitionBy("q").orderBy(F.round("cosine", 9).desc(), "id")
    return met.mapInArrow(run, "q bigint, id bigint, cosine double").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def family_weight(table_id: Column) -> Column:
    """Longest prefix first, then the subgroup share."""
    w = None
    for p in sorted(FAMILIES, key=lambda p: (-len(p), p)):
        w = (F if w is None else w).when(table_id.startswith(p), FAMILIES[p])
    return w.otherwise(1.0) * F.when(table_id.endswith("PR"), PR_SHARE).otherwise(1.0) * F.when(table_id.rlike(SUBGROUP), SUBGROUP_SHARE).otherwise(1.0)


def target_scores(hits: DataFrame, cards: DataFrame, by_variable: bool = False) -> DataFrame:
    """Hits (q, rowid, cosine) joined to their cards and added up per target table, or per table and variable.

    A hit scores max(0, cosine) times the card's weight, COMMON_BOOST more for a commonly asked variable, negative for
    negative cards; hits without a card (or, by variable, without one) drop out.
    """
    c = cards.select(F.col("rowid"), tid("target_table_id").alias("table_id"), F.upper(F.trim("target_variable_id")).alias("variable_id"), "weight", "polarity", "card_type", "target_year", "is_commonly_queried").where("table_id <> ''")
    key = ["q", "table_id", "variable_id"] if by_variable else ["q", "table_id"]
    c = c.where("variable_id <> ''") if by_variable else c
    h = hits.join(c, "rowid").withColumn("sim", F.greatest(F.lit(0.0), F.col("cosine")))
    signed = F.col("sim") * F.col("weight") * F.when(F.col("is_commonly_queried") == 1, COMMON_BOOST).otherwise(1.0) * F.when(F.col("polarity") == "negative", -1.0).otherwise(1.0)
    g = h.groupBy(*key).agg(
        F.sum(signed).alias("score"),
        F.sum((F.col("polarity") == "positive").cast("bigint")).alias("n_pos"),
        F.sum((F.col("polarity") == "negative").cast("bigint")).alias("n_neg"),
        F.max(F.struct(F.round("cosine", 9).alias("c"), (-F.col("rowid")).alias("r"))).alias("best"),
        F.array_join(F.array_sort(F.collect_set("card_type")), ",").alias("card_types"),
        F.array_join(F.transform(F.array_sort(F.collect_set("target_year")), lambda y: y.cast("string")), ",").alias("years"),
    )
    return g.select(*key, (F.col("score") * family_weight(F.col("table_id"))).alias("score"), "n_pos", "n_neg", (-F.col("best.r")).alias("best_card"), "card_types", "years")


# queries

SEARCHES = [("q1", "gross rent occup"), ("q2", "vacancy rate"), ("q3", "family size older build"), ("q4", "zzz nothing"), ("q5", "working families")]
_TRIGGERS = [("commute", "commuting"), ("commute time", "commuting time"), ("rent", "housing cost"), ("gross rent", "housing cost"), ("veteran", "veterans"), ("disability", "health"), ("school enrollment", "education")]


def text_docs(spark, d):
    t = table(spark, d, "stat_tables").select(F.concat_ws("|", "table_id", "dataset", F.col("year").cast("string")).alias("doc"), F.concat_ws(" ", "title", "description", "use_when").alias("text"))
    return t.groupBy("doc").agg(F.max("text").alias("text"))


def bm25_search(spark, d):
    docs = text_docs(spark, d)
    n = docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(tokens(F.col("text")))).alias("avg_dl"))
    s = bm25(inverted_index(docs, "doc", "text"), n, SEARCHES)
    w = W.partitionBy("q").orderBy(F.round("score", 9), "doc")
    return s.withColumn("rank", F.row_number().over(w)).where("rank <= 20").select("q", "doc", F.round("score", 6).alias("score"), "rank", (F.col("score") <= ACCEPT_BELOW).alias("accepted"))


def prefix_match(spark, d):
    """Names whose words begin with all words of a search, exact matches first, then by kind and population."""
    g = table(spark, d, "admin_geographies").where("deleted_at IS NULL").withColumn("w", tokens(F.col("name")))
    hit = F.exists("w", lambda x: x == "county") & F.exists("w", lambda x: x.startswith("j"))
    tier = F.when(F.lower("name") == "junction county", 0).when(F.lower("name").startswith("junction"), 1).otherwise(2)
    return g.where(hit).select("geoid", "name", tier.alias("tier"), "population").orderBy("tier", F.desc("population"), "geoid").limit(25).select("geoid", "name", "tier")


def keyword_gate(spark, d):
    """Questions that speak of a known theme: whole words, with or without a plural s."""
    pats = [rf"\b{t}s?\b" for t, _ in _TRIGGERS]
    q = table(spark, d, "table_questions").where("question_text IS NOT NULL")
    hits = sum((F.lower("question_text").rlike(p).cast("int") for p in pats), F.lit(0))
    return q.select("question_id", hits.alias("hits")).where("hits > 0")


def longest_trigger(spark, d):
    """The theme of the longest trigger in a text; texts with two longest of equal length have none."""
    found = F.array_compact(F.array(*[F.when(F.lower("question_text").contains(t), F.struct(F.lit(len(t)).alias("n"), F.lit(v).alias("theme"))) for t, v in _TRIGGERS]))
    q = table(spark, d, "variable_questions").where("question_text IS NOT NULL").select("question_id", found.alias("f")).where("size(f) > 0")
    top = F.array_max(F.transform("f", lambda x: x.n))
    best = F.filter("f", lambda x: x.n == top)
    return q.select("question_id", F.when(F.size(best) == 1, best[0].theme).alias("theme"))


def vector_knn(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return exact_nearest(e.where("id % 20 = 0"), e, 10).select("q", "id", F.round("cosine", 5).alias("cosine"), "rank")


def _routed(spark, d):
    u = table(spark, d, "universe_embeddings").where("embedding IS NOT NULL")
    e = u.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    near = exact_nearest(e.where("id % 20 = 0"), e, 30)
    return target_scores(near.join(u.select(F.col("vec_id").alias("id"), F.col("card_rowid").alias("rowid")), "id").select("q", "rowid", "cosine"), table(spark, d, "cards"))


def target_aggregate(spark, d):
    return _routed(spark, d).withColumn("score", F.round("score", 5))


def routed(scores: DataFrame, top_k: int, floor: float = SCORE_FLOOR, allowed: DataFrame | None = None, boosted: DataFrame | None = None, boost: float = 1.0) -> DataFrame:
    """q, table_id, score, rank: the ``top_k`` best tables of each query, and of these those above the floor.

    ``allowed``: the tables (table_id) that may come out, such as those of a domain or with coverage of a level;
    ``boosted``: tables whose score is multiplied by ``boost`` before they are ranked."""
    s = scores if allowed is None else scores.join(allowed.select("table_id").distinct(), "table_id", "left_semi")
    if boosted is not None:
        s = s.join(boosted.select("table_id").distinct().withColumn("__b", F.lit(boost)), "table_id", "left").withColumn("score", F.col("score") * F.coalesce("__b", F.lit(1.0)))
    w = W.partitionBy("q").orderBy(F.round("score", 9).desc(), "table_id")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k).where(F.col("score") >= floor).select("q", "table_id", F.round("score", 5).alias("score"), "rank")


def routed_filtered(spark, d):
    """Routing to tables that have tract values, those of an area called housing preferred."""
    level = table(spark, d, "coverage").where("geo_level = 'tract' AND status = 'success'").select(tid().alias("table_id"))
    housing = table(spark, d, "stat_tables").where(F.lower("l1_domains_json").contains("housing")).select(tid().alias("table_id"))
    return routed(_routed(spark, d), 5, allowed=level, boosted=housing, boost=1.5)


def routed_dataset(spark, d):
    """Routing within one dataset: its queries against its vectors only."""
    u = table(spark, d, "universe_embeddings").where("embedding IS NOT NULL AND dataset = 'acs5'")
    e = u.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    near = exact_nearest(e.where("id % 20 = 0"), e, 30)
    hits = near.join(u.select(F.col("vec_id").alias("id"), F.col("card_rowid").alias("rowid")), "id").select("q", "rowid", "cosine")
    return routed(target_scores(hits, table(spark, d, "cards")), 5)


def variable_aggregate(spark, d):
    """Scores at the grain of table and variable."""
    u = table(spark, d, "universe_embeddings").where("embedding IS NOT NULL")
    e = u.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    near = exact_nearest(e.where("id % 20 = 0"), e, 30)
    hits = near.join(u.select(F.col("vec_id").alias("id"), F.col("card_rowid").alias("rowid")), "id").select("q", "rowid", "cosine")
    return target_scores(hits, table(spark, d, "cards"), by_variable=True).select("q", "table_id", "variable_id", F.round("score", 5).alias("score"), "n_pos", "n_neg", "best_card")


def snippet(text: Column, words: list[str], around: int = 5) -> Column:
    """The first word of the text that begins with one of the searched, with up to ``around`` words on either side."""
    w = F.split(F.trim(text), r"\s+")
    low = F.transform(w, lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]", ""))
    hit = F.array_position(F.transform(low, lambda x: reduce(lambda a, b: a | b, [x.startswith(q) for q in words])), True)
    start = F.greatest(F.lit(1), hit - around).cast("int")
    cut = F.slice(w, start, (hit + around - start + 1).cast("int"))
    return F.when(hit > 0, F.concat(F.when(start > 1, "... ").otherwise(""), F.array_join(cut, " "), F.when(hit + around < F.size(w), " ...").otherwise("")))


def search_filtered(spark, d):
    """A search among the tables of one dataset that have been checked for states, best first, counted from 0, with a snippet."""
    docs = text_docs(spark, d)
    n = docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(tokens(F.col("text")))).alias("avg_dl"))
    s = bm25(inverted_index(docs, "doc", "text"), n, [("q", "vacancy ra")])
    part = F.split("doc", r"\|")
    have = table(spark, d, "coverage").where("geo_level = 'state'").select(tid().alias("t")).distinct()
    s = s.where(part[1] == "acs5").withColumn("t", F.upper(F.trim(part[0]))).join(have, "t", "left_semi").join(docs, "doc")
    w = W.orderBy(F.round("score", 9), "doc")
    top = s.orderBy(F.round("score", 9), "doc").limit(20)
    return top.withColumn("rank_position", F.row_number().over(w) - 1).select("doc", "rank_position", snippet(F.col("text"), ["vacancy", "ra"]).alias("snippet"))


def routed_top(spark, d):
    """The five best tables of each query, and of these those above the floor."""
    w = W.partitionBy("q").orderBy(F.round("score", 9).desc(), "table_id")
    return _routed(spark, d).withColumn("rank", F.row_number().over(w)).where("rank <= 5").where(F.col("score") >= SCORE_FLOOR).select("q", "table_id", F.round("score", 5).alias("score"), "rank")


def picked(near: DataFrame, top: DataFrame, cards: DataFrame, vectors: DataFrame, asked: DataFrame) -> DataFrame:
    """q, table_id, variable_id, pick_score: the best variable of the two tables that stand a second look.

    ``near``: q, table_id, cosine of each hit; ``top``: q, table_id, score.  A table's score is its prior (score up to 10, as a
    share) times the likeness of its universe (the best hit; UNIVERSE_FLOOR where it has none) times its family's share.
    A variable's is the cosine of its card with the query, times the penalties of its label and the bonus of a total,
    times one and the table's score.  ``asked``: id, v of the queries; ``vectors``: rowid, v of the cards.
    """
    u = near.groupBy("q", "table_id").agg(F.max("cosine").alias("u"))
    prior = F.least(F.col("score"), F.lit(10.0)) / 10
    t = top.join(u, ["q", "table_id"], "left").withColumn("table_score", prior * F.coalesce(F.greatest("u", F.lit(0.0)), F.lit(UNIVERSE_FLOOR)) * family_weight(F.col("table_id")))
    w = W.partitionBy("q").orderBy(F.round("table_score", 9).desc(), "table_id")
    t = t.withColumn("rn", F.row_number().over(w)).where("rn <= 2 AND table_score > 0").select("q", "table_id", "table_score", "rn")
    c = cards.where("trim(target_variable_id) <> ''").select("rowid", tid("target_table_id").alias("table_id"), F.upper(F.trim("target_variable_id")).alias("variable_id"), F.lower("text").alias("label"), "is_total")
    j = t.join(c, "table_id").join(vectors, "rowid").join(asked.select(F.col("id").alias("q"), F.col("v").alias("qv")), "q").where(F.size("v") == F.size("qv"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    cos = F.greatest(F.lit(0.0), dot("v", "qv") / F.sqrt(dot("v", "v") * dot("qv", "qv")))
    narrow = reduce(lambda a, b: a | b, [F.col("label").contains(m) for m in SUBGROUP_MARKS])
    leaf = reduce(lambda a, b: a | b, [F.col("label").contains(m) for m in LEAF_MARKS])
    s = cos * F.when(narrow, 0.4).otherwise(1.0) * F.when(leaf, 0.3).otherwise(1.0) * F.when(F.col("is_total") == 1, 1.3).otherwise(1.0) * (1 + F.col("table_score"))
    w = W.partitionBy("q").orderBy(F.desc("pick_score"), "rn", "variable_id")
    return j.withColumn("pick_score", F.round(s, 5)).withColumn("k", F.row_number().over(w)).where("k = 1").select("q", "table_id", "variable_id", "pick_score")


def universe_pick(spark, d):
    """For each query the variable picked among those of its two best tables."""
    u = table(spark, d, "universe_embeddings").where("embedding IS NOT NULL")
    e = u.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    cards = table(spark, d, "cards")
    near = exact_nearest(e.where("id % 20 = 0"), e, 30).join(u.select(F.col("vec_id").alias("id"), F.col("card_rowid").alias("rowid")), "id")
    near = near.join(cards.select("rowid", tid("target_table_id").alias("table_id")).where("table_id <> ''"), "rowid").select("q", "table_id", "cosine")
    top = _routed(spark, d)
    w = W.partitionBy("q").orderBy(F.round("score", 9).desc(), "table_id")
    top = top.withColumn("rank", F.row_number().over(w)).where("rank <= 5").where(F.col("score") >= SCORE_FLOOR).select("q", "table_id", "score")
    v = u.where(F.exists("embedding", lambda x: x != 0)).select(F.col("card_rowid").alias("rowid"), F.col("embedding").alias("v"))
    return picked(near, top, cards, v, e.where("id % 20 = 0"))


def similarity_margin(spark, d):
    """Confidence of the best neighbour: lowered where the runner-up is close."""
    n = vector_knn(spark, d)
    gap = F.col("cosine") - F.lead("cosine").over(W.partitionBy("q").orderBy("rank"))
    return n.withColumn("gap", gap).where("rank = 1").select("q", "id", F.round(F.least(F.lit(1.0), F.lit(0.70) + 0.30 * F.least(F.lit(1.0), F.col("gap") / 0.25)), 4).alias("confidence"))


def family_bias(spark, d):
    t = table(spark, d, "stat_tables").select("table_id").distinct()
    return t.select("table_id", F.round(family_weight(F.col("table_id")), 6).alias("weight"))


_FAM = "(CASE " + " ".join(f"WHEN starts_with(table_id, '{p}') THEN {FAMILIES[p]}" for p in sorted(FAMILIES, key=lambda p: (-len(p), p))) + " ELSE 1.0 END * CASE WHEN ends_with(table_id, 'PR') THEN 0.0 ELSE 1.0 END * CASE WHEN regexp_matches(table_id, '^[BCS][0-9]{4,5}[A-I]$') THEN 0.3 ELSE 1.0 END)::DOUBLE"
_KNN = """WITH n AS (SELECT a.vec_id AS q, b.vec_id AS id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS cosine FROM {t} a JOIN {t} b ON a.vec_id <> b.vec_id AND len(a.embedding) = len(b.embedding)
  WHERE a.vec_id % {m} = 0 AND list_sum(list_transform(a.embedding::DOUBLE[], lambda x: abs(x))) > 0 AND list_sum(list_transform(b.embedding::DOUBLE[], lambda x: abs(x))) > 0),
k AS (SELECT *, (row_number() OVER (PARTITION BY q ORDER BY round(cosine, 9) DESC, id))::INT AS rank FROM n QUALIFY rank <= {k})
"""
_ROUTED = _KNN.format(t="universe_embeddings", m=20, k=30) + f""", h AS (SELECT k.q, c.\"rowid\" AS r, cosine, greatest(0, cosine) AS sim, upper(trim(target_table_id)) AS table_id, weight, polarity, card_type, target_year, is_commonly_queried, upper(trim(target_variable_id)) AS variable_id FROM k JOIN universe_embeddings u ON u.vec_id = k.id JOIN cards c ON c.\"rowid\" = u.card_rowid WHERE trim(target_table_id) <> ''),
g AS (SELECT q, table_id, sum(sim * weight * CASE WHEN is_commonly_queried = 1 THEN 1.1::DOUBLE ELSE 1 END * CASE WHEN polarity = 'negative' THEN -1 ELSE 1 END) AS s, sum((polarity = 'positive')::INT)::BIGINT AS n_pos, sum((polarity = 'negative')::INT)::BIGINT AS n_neg, arg_max(r, (round(cosine, 9), -r)) AS best_card, array_to_string(list_sort(list(DISTINCT card_type)), ',') AS card_types, array_to_string(list_sort(list(DISTINCT target_year)), ',') AS years FROM h GROUP BY 1, 2),
t AS (SELECT q, table_id, s * {_FAM} AS score, n_pos, n_neg, best_card, card_types, years FROM g)
"""
_TOP = _ROUTED + ", top AS (SELECT q, table_id, score, (row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, table_id))::INT AS rank FROM t), five AS (SELECT q, table_id, round(score, 5) AS score, rank FROM top WHERE rank <= 5 AND score >= 0.05)\n"
_TOK = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
_ASKED = ", ".join(f"('{q}', {i}, '{w}', {str(i == len(t.split()) - 1).lower()}, {len(t.split())})" for q, t in SEARCHES for i, w in enumerate(t.split()))


def _marks(marks: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(label, '{m}')" for m in marks) + ")"


QUERIES = {f.__name__: f for f in (bm25_search, prefix_match, keyword_gate, longest_trigger, vector_knn, target_aggregate, routed_top, universe_pick, similarity_margin, family_bias, routed_filtered, routed_dataset, variable_aggregate, search_filtered)}
SQL = {
    "bm25_search": f"""WITH d AS (SELECT table_id || '|' || dataset || '|' || year AS doc, max(concat_ws(' ', title, description, use_when)) AS text FROM stat_tables GROUP BY 1),
w AS (SELECT doc, {_TOK.format('text')} AS w FROM d), st AS (SELECT count(*) AS n, avg(len(w)) AS avg_dl FROM w), ix AS (SELECT term, doc, dl, count(*) AS tf FROM (SELECT doc, len(w) AS dl, unnest(w) AS term FROM w) GROUP BY 1, 2, 3),
a(q, i, w, is_prefix, n_words) AS (VALUES {_ASKED}),
p AS (SELECT q, i, n_words, doc, dl, sum(tf) AS tf FROM ix JOIN a ON CASE WHEN is_prefix THEN starts_with(term, a.w) ELSE term = a.w END GROUP BY ALL), f AS (SELECT q, i, count(*) AS df FROM p GROUP BY 1, 2),
s AS (SELECT p.q, doc, n_words, count(*) AS m, -sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))) AS score FROM p JOIN f ON p.q = f.q AND p.i = f.i, st GROUP BY 1, 2, 3 HAVING count(*) = n_words)
SELECT q, doc, round(score, 6) AS score, (row_number() OVER (PARTITION BY q ORDER BY round(score, 9), doc))::INT AS rank, score <= -3.0 AS accepted FROM s QUALIFY rank <= 20""",
    "prefix_match": "SELECT geoid, name, CASE WHEN lower(name) = 'junction county' THEN 0 WHEN starts_with(lower(name), 'junction') THEN 1 ELSE 2 END AS tier FROM admin_geographies WHERE deleted_at IS NULL AND regexp_matches(lower(name), '\\bcounty\\b') AND regexp_matches(lower(name), '\\bj') ORDER BY tier, population DESC, geoid LIMIT 25",
    "keyword_gate": "SELECT question_id, (" + " + ".join(f"regexp_matches(lower(question_text), '\\b{t}s?\\b')::INT" for t, _ in _TRIGGERS) + ")::INT AS hits FROM table_questions WHERE question_text IS NOT NULL AND hits > 0",
    "longest_trigger": "WITH t(k, v) AS (VALUES " + ", ".join(f"('{t}', '{v}')" for t, v in _TRIGGERS) + "), h AS (SELECT question_id, v, length(k) AS n FROM variable_questions, t WHERE contains(lower(question_text), k)), m AS (SELECT *, max(n) OVER (PARTITION BY question_id) AS top FROM h) SELECT question_id, CASE WHEN count(*) = 1 THEN max(v) END AS theme FROM m WHERE n = top GROUP BY 1",
    "vector_knn": _KNN.format(t="embeddings", m=20, k=10) + "SELECT q, id, round(cosine, 5) AS cosine, rank FROM k",
    "target_aggregate": _ROUTED + "SELECT q, table_id, round(score, 5) AS score, n_pos, n_neg, best_card, card_types, years FROM t",
    "routed_top": _TOP + "SELECT * FROM five",
    "routed_filtered": _ROUTED + """, b AS (SELECT q, table_id, score * CASE WHEN table_id IN (SELECT upper(trim(table_id)) FROM stat_tables WHERE contains(lower(l1_domains_json), 'housing')) THEN 1.5::DOUBLE ELSE 1 END AS score FROM t WHERE table_id IN (SELECT upper(trim(table_id)) FROM coverage WHERE geo_level = 'tract' AND status = 'success')),
r AS (SELECT q, table_id, score, (row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, table_id))::INT AS rank FROM b) SELECT q, table_id, round(score, 5) AS score, rank FROM r WHERE rank <= 5 AND score >= 0.05""",
    "routed_dataset": _TOP.replace("a.vec_id % 20 = 0", "a.vec_id % 20 = 0 AND a.dataset = 'acs5' AND b.dataset = 'acs5'") + "SELECT * FROM five",
    "variable_aggregate": _ROUTED.rsplit("t AS (", 1)[0] + f"""gv AS (SELECT q, table_id, variable_id, sum(sim * weight * CASE WHEN is_commonly_queried = 1 THEN 1.1::DOUBLE ELSE 1 END * CASE WHEN polarity = 'negative' THEN -1 ELSE 1 END) AS s, sum((polarity = 'positive')::INT)::BIGINT AS n_pos, sum((polarity = 'negative')::INT)::BIGINT AS n_neg, arg_max(r, (round(cosine, 9), -r)) AS best_card FROM h WHERE variable_id <> '' GROUP BY 1, 2, 3) SELECT q, table_id, variable_id, round(s * {_FAM}, 5) AS score, n_pos, n_neg, best_card FROM gv""",
    "universe_pick": _TOP + f""", un AS (SELECT q, table_id, max(cosine) AS u FROM h GROUP BY 1, 2),
ts AS (SELECT top.q, top.table_id, least(top.score, 10) / 10 * coalesce(greatest(u, 0), 0.3) * {_FAM.replace('table_id', 'top.table_id')} AS table_score FROM top JOIN un ON un.q = top.q AND un.table_id = top.table_id WHERE top.rank <= 5 AND top.score >= 0.05),
kept AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(table_score, 9) DESC, table_id) AS rn FROM ts QUALIFY rn <= 2),
vc AS (SELECT c."rowid" AS r, upper(trim(target_table_id)) AS table_id, upper(trim(target_variable_id)) AS variable_id, lower(text) AS label, is_total, e.embedding::DOUBLE[] AS v FROM cards c JOIN universe_embeddings e ON e.card_rowid = c."rowid" WHERE trim(target_variable_id) <> '' AND list_sum(list_transform(e.embedding::DOUBLE[], lambda x: abs(x))) > 0),
sc AS (SELECT kept.q, kept.table_id, variable_id, rn, round(greatest(0, list_cosine_similarity(v, a.embedding::DOUBLE[])) * CASE WHEN {_marks(SUBGROUP_MARKS)} THEN 0.4 ELSE 1 END * CASE WHEN {_marks(LEAF_MARKS)} THEN 0.3 ELSE 1 END * CASE WHEN is_total = 1 THEN 1.3 ELSE 1 END * (1 + table_score), 5)::DOUBLE AS pick_score
  FROM kept JOIN vc ON vc.table_id = kept.table_id JOIN universe_embeddings a ON a.vec_id = kept.q WHERE table_score > 0 AND len(v) = len(a.embedding))
SELECT q, table_id, variable_id, pick_score FROM sc QUALIFY row_number() OVER (PARTITION BY q ORDER BY pick_score DESC, rn, variable_id) = 1""",
    "similarity_margin": _KNN.format(t="embeddings", m=20, k=10) + ", r AS (SELECT q, id, rank, round(cosine, 5) AS c FROM k) SELECT a.q, a.id, round(least(1.0, 0.7 + 0.3 * least(1.0, (a.c - b.c) / 0.25)), 4) AS confidence FROM r a JOIN r b ON a.q = b.q AND a.rank = 1 AND b.rank = 2",
    "family_bias": f"SELECT DISTINCT table_id, round({_FAM}, 6) AS weight FROM stat_tables",
}
