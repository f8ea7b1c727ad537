"""Peers: the most alike areas by standardised features among those of similar size."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..runtime import durable, table
from .predicates import SIZE_BANDS, size_band

AXES = {"volume": ["quantity", "lines"], "price": ["price", "discount"], "all": ["quantity", "lines", "price", "discount"]}
#: Discount of a distance by nearness: same state, division, region, elsewhere (fixed values).
NEARNESS = {"state": 0.75, "division": 0.88, "region": 0.94}
ELSEWHERE = 1.0
LEAST_FEATURES = 3
#: A feature less than this apart (in standard deviations) is named as a close match.
CLOSE = 1.0
#: Areas and anchors of a size band that meet in one task.
BLOCK, ANCHORS = 8_192, 512


def size_modifier(ratio):
    return F.when(ratio.isNull(), 1.0).when(ratio >= 1.25, 0.95).when(ratio >= 0.8, 1.0).otherwise(1.03)


def nearness(a: str = "anchor_", b: str = "") -> tuple:
    """Tier (``same_state`` and so on, else ``nationwide``) and discount of two areas; an unknown place is near none."""
    tier, share = F, F
    for level, x in NEARNESS.items():
        same = F.col(f"{a}{level}") == F.col(f"{b}{level}")
        tier, share = tier.when(same, f"same_{level}"), share.when(same, x)
    return tier.otherwise("nationwide"), share.otherwise(ELSEWHERE)


def lookup_anchor(areas: DataFrame, ids: list, vintage: int | None = None) -> DataFrame:
    """The areas of the given ids in a vintage (the latest one each has, if none is named); unknown ids give no row."""
    a = areas.where(F.col("id").isin(list(ids)))
    if vintage is not None:
        return a.where(F.col("vintage") == vintage)
    w = W.partitionBy("id").orderBy(F.desc("vintage"))
    return a.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def synthetic_anchor(spark, label: str, population: int, features: dict[str, float], known: set[str], state: str | None = None) -> DataFrame:
    """An anchor put together from values instead of looked up; features that no axis knows are an error."""
    unknown = sorted(set(features) - set(known))
    if unknown:
        raise ValueError(f"unknown features: {unknown[:5]}")
    row = (f"synthetic::{label}", state, None, None, population, {k: float(v) for k, v in features.items()})
    return spark.createDataFrame([row], "id string, state string, division string, region string, population bigint, features map<string,double>")


def _rest(x: np.ndarray) -> tuple[int, float, float]:
    """Count, mean and squared deviations; equal values deviate by exactly 0."""
    if not len(x):
        return 0, 0.0, 0.0
    mean = x[0] + (x - x[0]).mean()
    return len(x), float(mean), float(((x - mean) ** 2).sum())


def _moments(names: list[str]):
    """Moments of each feature over a block of areas, and over it without each anchor of the block (``own``)."""

    def of(pool: pa.Table, own: pa.Table) -> pa.Table:
        rows = []
        xs = [(pool.column(f"x{i}").drop_null().to_numpy(), np.asarray(pool.column(f"x{i}").is_valid())) for i in range(len(names))]
        ids = pd.Series(pool.column("id").to_pylist(), dtype=object)
        at = ids.groupby(ids).indices
        if pool.num_rows:
            group, block = pool.column("group_")[0].as_py(), pool.column("block")[0].as_py()
            rows += [(group, block, None, i, *_rest(x)) for i, (x, _) in enumerate(xs)]
            for a in own.column("anchor").to_pylist():
                if a in at:
                    other = np.ones(len(ids), dtype=bool)
                    other[at[a]] = False
                    rows += [(group, block, a, i, *_rest(x[other[valid]])) for i, (x, valid) in enumerate(xs)]
        kinds = [pool.schema.field("group_").type, pa.int32(), pool.schema.field("id").type, pa.int32(), pa.int64(), pa.float64(), pa.float64()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], ["group_", "block", "own", "feature", "n", "mean", "m2"])

    return of


def _round6(x: np.ndarray) -> np.ndarray:
    """Six digits, halves of the decimal text away from 0 (as Spark's ``round``); x is not negative."""
    scaled = x * 1e6
    low = np.floor(scaled)
    with np.errstate(invalid="ignore"):
        out = np.where(scaled < 2.0**52, (low + (scaled - low >= 0.5)) / 1e6, x)
        near = np.nonzero((np.abs(scaled - low - 0.5) < 1e-6 + scaled * 1e-15) & (scaled < 2.0**52))[0]
    for i in near:
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out


def _nearest(axes: dict[str, list[int]], names: list[str], top_k: int, least: int):
    """The ``top_k`` nearest areas of a block on each axis, for each anchor of a block."""
    tiers = [*NEARNESS]
    shares = np.array([*NEARNESS.values(), ELSEWHERE])

    def of(pool: pa.Table, anchors: pa.Table) -> pa.Table:
        rows = []
        n, m = pool.num_rows, anchors.num_rows
        if n and m:
            number = lambda c: (c.combine_chunks().fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64), np.asarray(c.is_valid()))
            code = {}
            for level in ("id", *tiers):
                kind = pool.column(level).type
                both = pa.chunked_array([*pool.column(level).chunks, *anchors.column("anchor" if level == "id" else f"anchor_{level}").cast(kind).chunks], kind)
                codes = both.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                code[level] = codes[:n], codes[n:]
            xs = [(*number(pool.column(f"x{i}")), *number(anchors.column(f"y{i}")), number(anchors.column(f"sd{i}"))[0]) for i in range(len(names))]
            people, theirs = number(pool.column("population"))[0], number(anchors.column("anchor_population"))[0]
            ids, of_anchor = pool.column("id"), anchors.column("anchor")
            for j in range(m):
                z, has = np.zeros((len(names), n)), np.zeros((len(names), n), dtype=bool)
                for i, (x, valid, y, there, sd) in enumerate(xs):
                    if there[j]:
                        z[i], has[i] = np.where(valid, (x - y[j]) / sd[j], 0.0), valid
                squares = z * z
                tier = np.full(n, len(tiers))
                for k in reversed(range(len(tiers))):
                    a, b = code[tiers[k]]
                    if b[j] >= 0:
                        tier[a == b[j]] = k
                ratio = people / theirs[j] if theirs[j] else np.ones(n)
                factor = shares[tier], np.where(ratio >= 1.25, 0.95, np.where(ratio >= 0.8, 1.0, 1.03))
                other = code["id"][0] != code["id"][1][j]
                for axis, own in axes.items():
                    count = has[own].sum(axis=0)
                    use = np.nonzero(other & (count >= max(least, 1)))[0]
                    if not len(use):
                        continue
                    rms = np.sqrt(squares[own][:, use].sum(axis=0) / count[use])
                    far = rms * factor[0][use] * factor[1][use]
                    if len(use) > top_k:  # what may round to the last one's distance stays
                        keep = np.nonzero(~(far > np.partition(far, top_k - 1)[top_k - 1] + 1e-6))[0]
                        use, rms, far = use[keep], rms[keep], far[keep]
                    far = _round6(far)
                    if len(use) > top_k:
                        keep = np.nonzero(~(far > np.partition(far, top_k - 1)[top_k - 1]))[0]
                        use, rms, far = use[keep], rms[keep], far[keep]
                    near = sorted(zip(far.tolist(), ids.take(use).to_pylist(), use.tolist(), rms.tolist(), strict=True), key=lambda r: (r[0] != r[0], r[0], r[1]))[:top_k]
                    for d, area, at, raw in near:
                        gaps = sorted((abs(z[i, at]), names[i]) for i in own if has[i, at])[:2]
                        rows.append((of_anchor[j].as_py(), axis, area, d, raw, int(count[at]), f"same_{tiers[tier[at]]}" if tier[at] < len(tiers) else "nationwide", ",".join(f for gap, f in gaps if gap < CLOSE)))
        kinds = [anchors.schema.field("anchor").type, pa.string(), pool.schema.field("id").type, pa.float64(), pa.float64(), pa.int64(), pa.string(), pa.string()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)], ["anchor", "axis", "id", "distance", "rms", "n_features", "tier", "close"])

    return of


def peers(areas: DataFrame, anchors: DataFrame, axes: dict[str, list[str]], top_k: int, least: int = LEAST_FEATURES, within_state: bool = False) -> DataFrame:
    """anchor, axis, id, rank, distance, raw_distance, n_features, tier, close (up to two closest features under CLOSE apart).

    ``areas``: id, state, division, region, population, features (map name to double; absent features are not compared).
    ``anchors``: rows of the same columns, a stated set.  An anchor's pool are the other areas in its size band
    (``size_band``, both ends included), with ``within_state`` those of its state only.
    Features are standardised over the pool (population deviation, 0 counts as 1), the anchor left out;
    distance is the root mean square over the features both have, times the nearness and size modifiers.

    Pairs of anchor and area are never rows: areas lie in blocks of about BLOCK, anchors in blocks of about ANCHORS, each block
    of the ones meets each of the others in a task that keeps the ``top_k`` of each anchor.  Deviations are put together from
    the moments of the blocks, an anchor's own block without the anchor.
    """
    names = sorted({f for fs in axes.values() for f in fs})
    renamed = {"id": "anchor", **{c: f"anchor_{c}" for c in ("state", "division", "region", "population")}}
    group = lambda lo, state: F.concat_ws(":", lo.cast("string"), state.cast("string")) if within_state else lo.cast("string")
    features = lambda to: [F.element_at("features", F.lit(f)).cast("double").alias(f"{to}{i}") for i, f in enumerate(names)]
    one = anchors.withColumn("group_", group(size_band(F.col("population"))[0], F.col("state"))).where("population IS NOT NULL" + " AND state IS NOT NULL" * within_state)
    one = one.select("group_", *[F.col(a).alias(b) for a, b in renamed.items()], *features("y"))
    bands = F.array(*[F.when(F.col("population").between(lo, hi), F.lit(lo)) for lo, hi in SIZE_BANDS])
    pool = areas.where("state IS NOT NULL") if within_state else areas
    pool = pool.withColumn("lo", F.explode(F.array_compact(bands))).select(group(F.col("lo"), F.col("state")).alias("group_"), "id", "state", "division", "region", "population", *features("x"))
    pool = pool.join(one.select("group_").distinct(), "group_", "left_semi")
    blocks = pool.groupBy("group_").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    blocks = blocks.join(one.groupBy("group_").agg(F.ceil(F.count(F.lit(1)) / ANCHORS).cast("int").alias("sets")), "group_")
    block = lambda c, n: F.pmod(F.xxhash64(F.col(c).cast("string")), F.col(n)).cast("int")
    pool, one = pool.join(blocks, "group_").withColumn("block", block("id", "blocks")), one.join(blocks, "group_").withColumn("set", block("anchor", "sets"))

    a, b = areas.schema["id"].dataType.simpleString(), anchors.schema["id"].dataType.simpleString()
    own = one.select("group_", "anchor", block("anchor", "blocks").alias("block"))
    m = pool.groupBy("group_", "block").cogroup(own.groupBy("group_", "block")).applyInArrow(_moments(names), f"group_ string, block int, own {a}, feature int, n bigint, mean double, m2 double")
    m = durable(m)
    each = one.select("group_", "anchor").join(m.where("own IS NULL").drop("own"), "group_")
    mine = m.where("own IS NOT NULL").select("group_", "block", F.col("own").cast(b).alias("anchor"), "feature", *[F.col(c).alias(f"own_{c}") for c in ("n", "mean", "m2")])
    each = each.join(mine, ["group_", "block", "anchor", "feature"], "left")
    each = each.select("anchor", "feature", *[F.when(F.col("own_n").isNull(), F.col(c)).otherwise(F.col(f"own_{c}")).alias(c) for c in ("n", "mean", "m2")]).where("n > 0")
    # from one mean on, so that equal means give exactly their own
    from_ = each.groupBy("anchor", "feature").agg(F.collect_list(F.struct("n", "mean", "m2")).alias("p"), F.sum("n").alias("n"), F.min("mean").alias("low"))
    total = lambda f: F.aggregate("p", F.lit(0.0), lambda s, x: s + f(x))
    from_ = from_.withColumn("mean", F.col("low") + total(lambda x: x.n * (x["mean"] - F.col("low"))) / F.col("n"))
    from_ = from_.withColumn("sd", F.sqrt(total(lambda x: x.m2 + x.n * (x["mean"] - F.col("mean")) * (x["mean"] - F.col("mean"))) / F.col("n")))
    sd = from_.groupBy("anchor").agg(*[F.coalesce(F.max(F.when((F.col("feature") == i) & (F.col("sd") > 0), F.col("sd"))), F.lit(1.0)).alias(f"sd{i}") for i in range(len(names))])

    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    l = pool.withColumn("set", upto("sets")).groupBy("group_", "block", "set")
    r = durable(one.join(sd, "anchor")).withColumn("block", upto("blocks")).groupBy("group_", "block", "set")
    at = {axis: [names.index(f) for f in fs] for axis, fs in axes.items()}
    g = l.cogroup(r).applyInArrow(_nearest(at, names, top_k, least), f"anchor {b}, axis string, id {a}, distance double, rms double, n_features bigint, tier string, close string")
    w = W.partitionBy("anchor", "axis").orderBy("distance", "id")
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k).select("anchor", "axis", "id", "rank", "distance", F.round("rms", 6).alias("raw_distance"), "n_features", "tier", "close")


def peer_context(areas: DataFrame, anchors: DataFrame, axes: dict[str, list[str]], text: str, keywords: dict[str, str], top_k: int, least: int = LEAST_FEATURES, most_axes: int = 3, enough: int = 2) -> DataFrame:
    """Peers on up to ``most_axes`` axes whose keywords the text has (all of them if it has none): those of the anchor's own
    state, and where these are fewer than ``enough`` on an axis, those of the whole nation instead."""
    low = text.lower()
    wanted = list(dict.fromkeys(axis for word, axis in keywords.items() if word in low and axis in axes))[:most_axes] or list(axes)[:most_axes]
    use = {a: axes[a] for a in wanted}
    home = durable(peers(areas, anchors, use, top_k, least, within_state=True)).withColumn("scope", F.lit("state"))
    wide = peers(areas, anchors, use, top_k, least).withColumn("scope", F.lit("nation"))
    have = home.groupBy("anchor", "axis").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= enough).select("anchor", "axis")
    return home.join(have, ["anchor", "axis"], "left_semi").unionByName(wide.join(have, ["anchor", "axis"], "left_anti"))


def supplier_areas(spark, d) -> DataFrame:
    l = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.countDistinct("l_orderkey").alias("population"), F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).cast("double").alias("lines"), F.avg("l_extendedprice").alias("price"), F.avg("l_discount").alias("discount"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("state"))
    # nations of one region and of even or odd number stand for a division
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("state"), (F.col("n_regionkey") * 2 + F.col("n_nationkey") % 2).alias("division"), F.col("n_regionkey").alias("region"))
    names = AXES["all"]
    # quantities ending in 7 are left out, so that features differ between areas
    m = F.map_filter(F.map_from_arrays(F.array(*[F.lit(x) for x in names]), F.array(F.when(F.pmod(F.col("id"), F.lit(7)) != 3, F.col("quantity")), "lines", "price", "discount")), lambda k, v: v.isNotNull())
    return s.join(n, "state").join(l, "id").select("id", "state", "division", "region", "population", m.alias("features"))


def peer_axes(spark, d):
    a = durable(supplier_areas(spark, d))
    return peers(a, a.where("id % 20 = 0"), AXES, 10, least=2).select("anchor", "axis", "id", "rank", "distance", "n_features")


def peer_rank(spark, d):
    a = durable(supplier_areas(spark, d))
    return peers(a, a.where("id % 20 = 0"), {"all": AXES["all"]}, 5).select("anchor", "id", "rank", "distance", "tier", "close")


def peer_scopes(spark, d):
    """Peers on the axes that a question speaks of, within the state or, where these are too few, nationwide."""
    a = durable(supplier_areas(spark, d))
    c = peer_context(a, a.where("id % 20 = 0"), AXES, "How do prices compare?", {"price": "price", "volume": "volume"}, 3, least=2)
    return c.select("anchor", "axis", "id", "rank", "distance", "scope")


def feature_stats(spark, d):
    """Mean and population deviation of each feature; a deviation of 0 counts as 1."""
    f = supplier_areas(spark, d).select(F.explode("features").alias("feature", "x"))
    sd = F.stddev_pop("x")
    return f.groupBy("feature").agg(F.round(F.avg("x"), 4).alias("mean"), F.round(F.when(sd > 0, sd).otherwise(1.0), 4).alias("deviation"), F.count(F.lit(1)).alias("n"))


_AREAS = """WITH l AS (SELECT l_suppkey AS id, count(DISTINCT l_orderkey) AS population, sum(l_quantity) AS quantity, count(*)::DOUBLE AS lines, avg(l_extendedprice) AS price, avg(l_discount) AS discount FROM lineitem GROUP BY 1),
a AS (SELECT s_suppkey AS id, s_nationkey AS state, n_regionkey * 2 + n_nationkey % 2 AS division, n_regionkey AS region, population, CASE WHEN s_suppkey % 7 <> 3 THEN quantity END AS quantity, lines, price, discount FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN l ON l.id = s_suppkey),
f AS (UNPIVOT a ON quantity, lines, price, discount INTO NAME feature VALUE x)
"""
_BAND = "CASE " + " ".join(f"WHEN o.population < {hi} THEN x.population BETWEEN {lo} AND {hi}" for lo, hi in SIZE_BANDS) + f" ELSE x.population BETWEEN {SIZE_BANDS[-1][0]} AND {SIZE_BANDS[-1][1]} END"


def _peers_sql(name: str, where: str, least: int) -> str:
    return f""", p{name} AS (SELECT b.id AS anchor, f.id, f.feature, (f.x - b.x) / CASE WHEN f.sd > 0 THEN f.sd ELSE 1 END AS z, CASE WHEN f.state = b.state THEN 'same_state' WHEN f.division = b.division THEN 'same_division' WHEN f.region = b.region THEN 'same_region' ELSE 'nationwide' END AS tier,
  CASE WHEN f.state = b.state THEN 0.75 WHEN f.division = b.division THEN 0.88 WHEN f.region = b.region THEN 0.94 ELSE 1.0 END * CASE WHEN f.population / b.population >= 1.25 THEN 0.95 WHEN f.population / b.population >= 0.8 THEN 1.0 ELSE 1.03 END AS m
  FROM (SELECT o.id AS anchor, x.*, stddev_pop(x.x) OVER (PARTITION BY o.id, x.feature) AS sd FROM a o JOIN f x ON x.id <> o.id AND {_BAND} {where} WHERE o.id % 20 = 0) f JOIN f b ON b.id = f.anchor AND b.feature = f.feature),
g{name} AS (SELECT anchor, axis, id, tier, round(sqrt(avg(z * z)) * m, 6) AS distance, count(*) AS n_features, array_to_string(list_transform(list_filter(list_sort(list({{'gap': abs(z), 'feature': feature}}))[1:2], lambda y: y.gap < 1), lambda y: y.feature), ',') AS close FROM p{name} JOIN ax USING (feature) GROUP BY anchor, axis, id, tier, m HAVING count(*) >= {least})
"""


_AXES_SQL = ", ax(axis, feature) AS (VALUES " + ", ".join(f"('{a}', '{f}')" for a, fs in AXES.items() for f in fs) + ")\n"
QUERIES = {f.__name__: f for f in (peer_axes, peer_rank, peer_scopes, feature_stats)}
SQL = {
    "peer_axes": _AREAS + _AXES_SQL + _peers_sql("", "", 2) + "SELECT anchor, axis, id, (row_number() OVER (PARTITION BY anchor, axis ORDER BY distance, id))::INT AS rank, distance, n_features FROM g QUALIFY rank <= 10",
    "peer_rank": _AREAS + _AXES_SQL + _peers_sql("", "", 3) + "SELECT anchor, id, (row_number() OVER (PARTITION BY anchor ORDER BY distance, id))::INT AS rank, distance, tier, close FROM g WHERE axis = 'all' QUALIFY rank <= 5",
    "peer_scopes": _AREAS + _AXES_SQL + _peers_sql("", "", 2) + _peers_sql("h", "AND x.state = o.state", 2) + """, r AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY distance, id)::INT AS rank, 'nation' AS scope FROM g WHERE axis = 'price' QUALIFY rank <= 3),
rh AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY distance, id)::INT AS rank, 'state' AS scope FROM gh WHERE axis = 'price' QUALIFY rank <= 3), e AS (SELECT anchor FROM rh GROUP BY 1 HAVING count(*) >= 2)
SELECT anchor, axis, id, rank, distance, scope FROM rh WHERE anchor IN (SELECT anchor FROM e) UNION ALL SELECT anchor, axis, id, rank, distance, scope FROM r WHERE anchor NOT IN (SELECT anchor FROM e)""",
    "feature_stats": _AREAS + "SELECT feature, round(avg(x), 4) AS mean, round(CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1 END, 4) AS deviation, count(*) AS n FROM f GROUP BY 1",
}
