"""Spatial joins: a grid equi-join on covering cells, then an exact predicate.

Geometries are rings of points (arrays of x, y).  Each side is exploded to the grid cells its box touches, so that the
join is an equi-join on cells; a pair is kept in one cell only (the lowest that both touch), which needs no distinct.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import partitions, table
from .areas import place_overlap_kind


def ring_area(x: np.ndarray, y: np.ndarray) -> float:
    return 0.5 * float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))


def ring_centroid(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a = ring_area(x, y)
    if a == 0:
        return float(x.mean()), float(y.mean())
    c = x * np.roll(y, -1) - np.roll(x, -1) * y
    return float(((x + np.roll(x, -1)) * c).sum() / (6 * a)), float(((y + np.roll(y, -1)) * c).sum() / (6 * a))


def contains_point(x: np.ndarray, y: np.ndarray, px: float, py: float) -> bool:
    """Even-odd rule; a point on a lower or left edge counts as inside."""
    x2, y2 = np.roll(x, -1), np.roll(y, -1)
    crosses = (y > py) != (y2 > py)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = x + (py - y) / (y2 - y) * (x2 - x)
    return bool((crosses & (px < at)).sum() % 2)


def clip_convex(subject: np.ndarray, clip: np.ndarray) -> np.ndarray:
    """The part of a polygon of any shape inside a convex one (counter-clockwise)."""
    out = [tuple(p) for p in subject]
    for (ax, ay), (bx, by) in zip(clip, np.roll(clip, -1, axis=0), strict=True):
        side = lambda p, ax=ax, ay=ay, bx=bx, by=by: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)
        now, out = out, []
        for p, q in zip(now, now[1:] + now[:1], strict=True):
            sp, sq = side(p), side(q)
            if sp >= 0:
                out.append(p)
            if (sp > 0 > sq) or (sp < 0 < sq):
                t = sp / (sp - sq)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        if not out:
            break
    return np.array(out, dtype=np.float64).reshape(-1, 2)


def is_convex(ring: np.ndarray) -> bool:
    d = np.roll(ring, -1, axis=0) - ring
    e = np.roll(d, -1, axis=0)
    turn = d[:, 0] * e[:, 1] - d[:, 1] * e[:, 0]
    return bool((turn >= 0).all() or (turn <= 0).all())


def shared_area(a: np.ndarray, b: np.ndarray) -> float:
    """Area that two simple polygons of any shape and direction share.

    A convex one clips the other; of two concave ones each is a signed sum of triangles from a common point, and the
    shares of the triangles add up with their signs."""
    a, b = (r if ring_area(r[:, 0], r[:, 1]) >= 0 else r[::-1] for r in (a, b))
    for subject, clip in ((a, b), (b, a)):
        if is_convex(clip):
            c = clip_convex(subject, clip)
            return abs(ring_area(c[:, 0], c[:, 1])) if len(c) > 2 else 0.0
    o = a[0]
    total = 0.0
    fans = [[(s, t if s > 0 else t[::-1]) for p, q in zip(r, np.roll(r, -1, axis=0), strict=True) for t in [np.array([o, p, q])] for s in [np.sign(ring_area(t[:, 0], t[:, 1]))] if s] for r in (a, b)]
    for s, t in fans[0]:
        for r, u in fans[1]:
            c = clip_convex(t, u)
            total += s * r * abs(ring_area(c[:, 0], c[:, 1])) if len(c) > 2 else 0.0
    return abs(total)


def _point_segments(p: np.ndarray, line: np.ndarray) -> float:
    return min(segment_distance(x, y, line) for x, y in p)


def ring_distance(a: np.ndarray, b: np.ndarray, closed: bool = True) -> float:
    """Distance of two polygons, 0 where they touch or overlap; with ``closed`` false, of a line of points and a polygon."""
    la, lb = np.vstack([a, a[:1]]) if closed else a, np.vstack([b, b[:1]])
    if contains_point(b[:, 0], b[:, 1], *a[0]) or (closed and contains_point(a[:, 0], a[:, 1], *b[0])):
        return 0.0
    cross = lambda o, p, q: (p[..., 0] - o[..., 0]) * (q[..., 1] - o[..., 1]) - (p[..., 1] - o[..., 1]) * (q[..., 0] - o[..., 0])
    p, q, r, s = la[:-1, None], la[1:, None], lb[None, :-1], lb[None, 1:]
    if ((cross(p, q, r) * cross(p, q, s) < 0) & (cross(r, s, p) * cross(r, s, q) < 0)).any():
        return 0.0
    return min(_point_segments(a, lb), _point_segments(b, la))


def segment_distance(px: float, py: float, line: np.ndarray) -> float:
    """Distance of a point to a line of points."""
    a, b = line[:-1], line[1:]
    d = b - a
    n = (d * d).sum(axis=1)
    t = np.clip(((px - a[:, 0]) * d[:, 0] + (py - a[:, 1]) * d[:, 1]) / np.where(n > 0, n, 1), 0, 1)
    near = a + t[:, None] * d
    return float(np.sqrt(((near - (px, py)) ** 2).sum(axis=1)).min())


def _by_length(*cols: pd.Series):
    """Rows whose rings have as many points, together (as many rows as a table of 2^20 pairs of points allows): positions, rings of each column."""
    sizes = pd.DataFrame({k: c.str.len().to_numpy() for k, c in enumerate(cols)})
    for at in sizes.groupby(list(sizes)).indices.values():
        step = max(1, 2**20 // max(1, int(np.prod(sizes.iloc[at[0]] / 2 + 1))))
        for i in range(0, len(at), step):
            part = at[i : i + step]
            yield part, [np.stack(c.iloc[part].to_list()).astype(np.float64).reshape(len(part), -1, 2) for c in cols]


def contain_points(rings: np.ndarray, px: np.ndarray, py: np.ndarray) -> np.ndarray:
    """``contains_point`` of many rings, a point each."""
    x, y = rings[..., 0], rings[..., 1]
    x2, y2 = np.roll(x, -1, axis=1), np.roll(y, -1, axis=1)
    crosses = (y > py[:, None]) != (y2 > py[:, None])
    with np.errstate(divide="ignore", invalid="ignore"):
        at = x + (py[:, None] - y) / (y2 - y) * (x2 - x)
    return (crosses & (px[:, None] < at)).sum(axis=1) % 2 == 1


def _signed_areas(r: np.ndarray) -> np.ndarray:
    x, y = r[..., 0], r[..., 1]
    return 0.5 * ((x * np.roll(y, -1, axis=1)).sum(axis=1) - (y * np.roll(x, -1, axis=1)).sum(axis=1))


def _clipped_areas(p: np.ndarray, clip: np.ndarray) -> np.ndarray:
    """Areas of what ``clip_convex`` leaves of many polygons; where one has fewer points, its last stands for the rest."""
    for a, b in zip(clip.swapaxes(0, 1), np.roll(clip, -1, axis=1).swapaxes(0, 1), strict=True):
        d = b - a
        s = d[:, None, 0] * (p[..., 1] - a[:, None, 1]) - d[:, None, 1] * (p[..., 0] - a[:, None, 0])
        t, q = np.roll(s, -1, axis=1), np.roll(p, -1, axis=1)
        cut = ((s > 0) & (t < 0)) | ((s < 0) & (t > 0))
        share = np.where(cut, s, 0) / np.where(cut, s - t, 1)
        points = np.stack([p, p + share[..., None] * (q - p)], axis=2).reshape(len(p), -1, 2)
        keep = np.stack([s >= 0, cut], axis=2).reshape(len(p), -1)
        n = keep.sum(axis=1)
        at = np.minimum(np.arange(max(1, n.max())), np.maximum(n - 1, 0)[:, None])
        order = np.take_along_axis(np.argsort(~keep, axis=1, kind="stable"), at, axis=1)
        p = np.take_along_axis(points, order[..., None], axis=1)
    return np.abs(_signed_areas(p))


def shared_areas(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``shared_area`` of many pairs."""
    a, b = (np.where((_signed_areas(r) >= 0)[:, None, None], r, r[:, ::-1]) for r in (a, b))
    out, done = np.zeros(len(a)), np.zeros(len(a), dtype=bool)
    for subject, clip in ((a, b), (b, a)):
        d = np.roll(clip, -1, axis=1) - clip
        e = np.roll(d, -1, axis=1)
        turn = d[..., 0] * e[..., 1] - d[..., 1] * e[..., 0]
        at = np.nonzero(~done & ((turn >= 0).all(axis=1) | (turn <= 0).all(axis=1)))[0]
        if len(at):
            out[at], done[at] = _clipped_areas(subject[at], clip[at]), True
    for i in np.nonzero(~done)[0]:
        out[i] = shared_area(a[i], b[i])
    return out


def segment_distances(points: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """The least ``segment_distance`` of the points of each row to the row's line."""
    a, b = lines[:, None, :-1], lines[:, None, 1:]
    d, p = b - a, points[:, :, None]
    n = (d * d).sum(axis=-1)
    t = np.clip(((p[..., 0] - a[..., 0]) * d[..., 0] + (p[..., 1] - a[..., 1]) * d[..., 1]) / np.where(n > 0, n, 1), 0, 1)
    return np.sqrt(((a + t[..., None] * d - p) ** 2).sum(axis=-1)).min(axis=(1, 2))


def ring_distances(a: np.ndarray, b: np.ndarray, closed: bool = True) -> np.ndarray:
    """``ring_distance`` of many pairs."""
    la, lb = np.concatenate([a, a[:, :1]], axis=1) if closed else a, np.concatenate([b, b[:, :1]], axis=1)
    touch = contain_points(b, a[:, 0, 0], a[:, 0, 1])
    if closed:
        touch |= contain_points(a, b[:, 0, 0], b[:, 0, 1])
    cross = lambda o, p, q: (p[..., 0] - o[..., 0]) * (q[..., 1] - o[..., 1]) - (p[..., 1] - o[..., 1]) * (q[..., 0] - o[..., 0])
    p, q, r, s = la[:, :-1, None], la[:, 1:, None], lb[:, None, :-1], lb[:, None, 1:]
    touch |= ((cross(p, q, r) * cross(p, q, s) < 0) & (cross(r, s, p) * cross(r, s, q) < 0)).any(axis=(1, 2))
    return np.where(touch, 0.0, np.minimum(segment_distances(a, lb), segment_distances(b, la)))


def _upright(rings: np.ndarray) -> np.ndarray:
    """Which rings of four points are boxes along the axes: each side changes one coordinate only, in turn."""
    d = np.roll(rings, -1, axis=1) - rings == 0
    return (d[:, :, 0] ^ d[:, :, 1]).all(axis=1) & (d[:, :-1, 0] != d[:, 1:, 0]).all(axis=1)


@F.pandas_udf(T.DoubleType())
def overlap_area(a: pd.Series, b: pd.Series) -> pd.Series:
    """Area that two convex rings (flat arrays x1, y1, x2, y2, ...) share."""
    out = np.zeros(len(a))
    box = np.zeros(len(a), dtype=bool)
    quads = np.nonzero((a.str.len() == 8).to_numpy() & (b.str.len() == 8).to_numpy())[0]
    if len(quads):  # upright boxes, all at once
        p, q = (np.stack(s.iloc[quads].to_list()).astype(np.float64).reshape(-1, 4, 2) for s in (a, b))
        lo, hi = np.maximum(p.min(axis=1), q.min(axis=1)), np.minimum(p.max(axis=1), q.max(axis=1))
        upright = _upright(p) & _upright(q)
        box[quads[upright]] = True
        out[quads[upright]] = np.clip(hi - lo, 0, None).prod(axis=1)[upright]
    rest = np.nonzero(~box)[0]
    for at, (p, q) in _by_length(a.iloc[rest], b.iloc[rest]):
        out[rest[at]] = shared_areas(p, q)
    return pd.Series(out)


@F.pandas_udf(T.DoubleType())
def polygon_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Distance of two rings (flat arrays), 0 where they touch or overlap."""
    out = np.zeros(len(a))
    box = np.zeros(len(a), dtype=bool)
    quads = np.nonzero((a.str.len() == 8).to_numpy() & (b.str.len() == 8).to_numpy())[0]
    if len(quads):  # upright boxes, all at once
        p, q = (np.stack(s.iloc[quads].to_list()).astype(np.float64).reshape(-1, 4, 2) for s in (a, b))
        gap = np.clip(np.maximum(p.min(axis=1) - q.max(axis=1), q.min(axis=1) - p.max(axis=1)), 0, None)
        upright = _upright(p) & _upright(q)
        box[quads[upright]] = True
        out[quads[upright]] = np.sqrt((gap * gap).sum(axis=1))[upright]
    rest = np.nonzero(~box)[0]
    for at, (p, q) in _by_length(a.iloc[rest], b.iloc[rest]):
        out[rest[at]] = ring_distances(p, q)
    return pd.Series(out)


@F.pandas_udf(T.BooleanType())
def point_inside(px: pd.Series, py: pd.Series, ring: pd.Series) -> pd.Series:
    out = np.zeros(len(ring), dtype=bool)
    for at, (r,) in _by_length(ring):
        out[at] = contain_points(r, px.iloc[at].to_numpy(), py.iloc[at].to_numpy())
    return pd.Series(out)


@F.pandas_udf(T.DoubleType())
def path_distance(line: pd.Series, ring: pd.Series) -> pd.Series:
    """Distance of a line of points and a ring (flat arrays): a buffer around the line, kept as a line."""
    out = np.zeros(len(line))
    for at, (a, b) in _by_length(line, ring):
        out[at] = ring_distances(a, b, closed=False)
    return pd.Series(out)


def wkt_of(ring: Column) -> Column:
    """A flat ring as well-known text, closed."""
    n = F.size(ring) / 2
    pairs = F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.concat_ws(" ", *[F.element_at(ring, (i * 2 - k).cast("int")).cast("string") for k in (1, 0)]))
    return F.concat(F.lit("POLYGON (("), F.array_join(F.concat(pairs, F.slice(pairs, 1, 1)), ", "), F.lit("))"))


def ring_of(text: Column) -> Column:
    """The outer ring of a polygon in well-known text or of GeoJSON coordinates, as a flat array without the closing point."""
    outer = F.regexp_extract(text, r"(?:POLYGON\s*\(|\[\s*\[)([^()]*?\([^()]*|[^()]*?\]\s*(?=\]))", 0)
    numbers = F.transform(F.regexp_extract_all(outer, F.lit(r"(-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)"), F.lit(1)), lambda x: x.cast("double"))
    closed = (F.size(numbers) >= 6) & (F.slice(numbers, 1, 2) == F.slice(numbers, -2, 2))
    return F.when(closed, F.slice(numbers, 1, F.size(numbers) - 2)).otherwise(numbers)


def geojson_of(ring: Column) -> Column:
    """A flat ring as the coordinates of a GeoJSON polygon, closed."""
    n = (F.size(ring) / 2).cast("int")
    pairs = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("["), F.element_at(ring, i * 2 - 1).cast("string"), F.lit(","), F.element_at(ring, i * 2).cast("string"), F.lit("]")))
    return F.concat(F.lit("[["), F.array_join(F.concat(pairs, F.slice(pairs, 1, 1)), ","), F.lit("]]"))


@F.pandas_udf(T.DoubleType())
def line_distance(px: pd.Series, py: pd.Series, line: pd.Series) -> pd.Series:
    out = np.zeros(len(line))
    for at, (p,) in _by_length(line):
        out[at] = segment_distances(np.stack([px.iloc[at], py.iloc[at]], axis=1)[:, None], p)
    return pd.Series(out)


def on_grid(df: DataFrame, x0: str, y0: str, x1: str, y1: str, size: float, grow: float = 0.0) -> DataFrame:
    """A row per grid cell that the box, grown by ``grow``, touches: gx, gy."""
    at = lambda c, by: F.floor((F.col(c) + by) / size).cast("int")
    a = df.withColumn("gx", F.explode(F.sequence(at(x0, -grow), at(x1, grow))))
    return a.withColumn("gy", F.explode(F.sequence(at(y0, -grow), at(y1, grow))))


def grid_join(a: DataFrame, b: DataFrame, size: float, grow: float = 0.0) -> DataFrame:
    """Pairs whose boxes (ax0, ay0, ax1, ay1 and bx0, by0, bx1, by1) touch, each pair once."""
    l, r = on_grid(a, "ax0", "ay0", "ax1", "ay1", size, grow), on_grid(b, "bx0", "by0", "bx1", "by1", size)
    j = l.join(r, ["gx", "gy"])
    first = lambda p, q: F.floor(F.greatest(F.col(p) - grow, F.col(q)) / size).cast("int")
    touch = (F.col("ax0") - grow <= F.col("bx1")) & (F.col("bx0") <= F.col("ax1") + grow) & (F.col("ay0") - grow <= F.col("by1")) & (F.col("by0") <= F.col("ay1") + grow)
    return j.where(touch & (F.col("gx") == first("ax0", "bx0")) & (F.col("gy") == first("ay0", "by0"))).drop("gx", "gy")


def shape_join(a: DataFrame, b: DataFrame, found, size: float, grow: float = 0.0) -> DataFrame:
    """The columns besides the boxes of ``a``, of ``b`` and of ``found``: what this leaves of the pairs of distinct boxes.

    Shapes follow from boxes, so that ``found`` compares each pair of shapes once, however many rows share them; the rows
    meet by equality of the boxes, in as many tasks as the result needs rather than as few as its small input asks for."""
    n = max(partitions(a.sparkSession), 4 * a.sparkSession.sparkContext.defaultParallelism)
    ka, kb = ([f"{p}{s}" for s in ("x0", "y0", "x1", "y1")] for p in "ab")
    j = found(grid_join(a.select(*ka).distinct(), b.select(*kb).distinct(), size, grow).repartition(n))
    return j.join(a, ka).drop(*ka).repartition(n, *kb).join(b.repartition(n, *kb), kb).drop(*kb)


def box_ring(p: str) -> Column:
    c = lambda s: F.col(p + s)
    return F.array(c("x0"), c("y0"), c("x1"), c("y0"), c("x1"), c("y1"), c("x0"), c("y1"))


# queries: boxes laid out by key, since no geometry is registered


def _places(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("a"), (F.pmod(F.col("s_suppkey") * 7, F.lit(101)) * 1.0).alias("ax0"), (F.pmod(F.col("s_suppkey") * 13, F.lit(97)) * 1.0).alias("ay0"), (F.pmod(F.col("s_suppkey"), F.lit(5)) + 1.0).alias("w"))
    return s.select("a", "ax0", "ay0", (F.col("ax0") + F.col("w")).alias("ax1"), (F.col("ay0") + F.col("w")).alias("ay1"))


def _tracts(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("b"), (F.pmod(F.col("c_custkey"), F.lit(53)) * 2.0).alias("bx0"), (F.pmod(F.floor(F.col("c_custkey") / 53), F.lit(50)) * 2.0).alias("by0"))
    return c.select("b", "bx0", "by0", (F.col("bx0") + 2.0).alias("bx1"), (F.col("by0") + 2.0).alias("by1"))


def place_tract_overlap(spark, d):
    """Share of each tract that a place covers, with its kind; touching without area is no overlap."""
    j = grid_join(_places(spark, d), _tracts(spark, d), 4.0).withColumn("area", overlap_area(box_ring("a"), box_ring("b")))
    share = F.round(F.col("area") / ((F.col("bx1") - F.col("bx0")) * (F.col("by1") - F.col("by0"))), 4)
    return j.where("area > 0").select("a", "b", share.alias("share"), F.when(share >= 0.95, "contains").when(share >= 0.5, "majority").otherwise("intersects").alias("kind"))


def corner_ring(p: str) -> Column:
    """A box without its upper right quarter: a concave polygon."""
    c = lambda s: F.col(p + s)
    mx, my = (c("x0") + c("x1")) / 2, (c("y0") + c("y1")) / 2
    return F.array(c("x0"), c("y0"), c("x1"), c("y0"), c("x1"), my, mx, my, mx, c("y1"), c("x0"), c("y1"))


def polygon_overlap(spark, d):
    """Shares of tracts that places of a concave shape cover, and of the places that lie in the tract, with the kind of overlap."""
    own = (F.col("ax1") - F.col("ax0")) * (F.col("ay1") - F.col("ay0")) * 0.75
    tract, place = F.round(F.col("area") / 4, 4), F.round(F.col("area") / own, 4)
    found = lambda j: j.withColumn("area", overlap_area(corner_ring("a"), box_ring("b"))).withColumns({"tract_share": tract, "place_share": place, "kind": place_overlap_kind(tract, place)}).where("kind IS NOT NULL").drop("area")
    return shape_join(_places(spark, d), _tracts(spark, d), found, 4.0).select("a", "b", "tract_share", "place_share", "kind")


def point_in_shape(spark, d):
    """Middles of tracts inside each place of a concave shape."""
    t = _tracts(spark, d).select("b", (F.col("bx0") + 1).alias("bx0"), (F.col("by0") + 1).alias("by0")).withColumns({"bx1": F.col("bx0"), "by1": F.col("by0")})
    found = lambda j: j.where(point_inside("bx0", "by0", corner_ring("a")))
    return shape_join(_places(spark, d), t, found, 4.0).select("a", "b")


def near_tracts(spark, d):
    """Tracts within 1.5 of each place that they don't touch, with their distance."""
    found = lambda j: j.withColumn("dist", F.round(polygon_distance(box_ring("a"), box_ring("b")), 6)).where("dist > 0 AND dist <= 1.5")
    return shape_join(_places(spark, d), _tracts(spark, d), found, 4.0, grow=1.5).select("a", "b", "dist")


def trail_buffers(spark, d):
    """The least of four widths around each trail of three points (two sides of a place) that reaches a tract."""
    trail = F.array("ax0", "ay0", "ax1", "ay0", "ax1", "ay1")
    dist = F.round(path_distance(trail, box_ring("b")), 6)
    width = F.when(F.col("dist") <= 0.25, 0.25).when(F.col("dist") <= 0.5, 0.5).when(F.col("dist") <= 1, 1.0).when(F.col("dist") <= 2, 2.0)
    found = lambda j: j.withColumn("dist", dist).withColumn("width", width).where("width IS NOT NULL").drop("dist")
    return shape_join(_places(spark, d), _tracts(spark, d), found, 4.0, grow=2.0).select("a", "b", "width")


def polygon_texts(spark, d):
    """Rings to text and GeoJSON and back: their areas stay."""
    p = _places(spark, d).select("a", wkt_of(corner_ring("a")).alias("wkt"), geojson_of(corner_ring("a")).alias("json"))
    both = p.select("a", "wkt", ring_of(F.col("wkt")).alias("r"), ring_of(F.col("json")).alias("s"))
    return both.select("a", F.round(overlap_area("r", "s"), 6).alias("area"), F.size("r").alias("numbers"))


def point_in_polygon(spark, d):
    """The tract that holds the middle of each place: of several the first."""
    p = _places(spark, d).select("a", ((F.col("ax0") + F.col("ax1")) / 2).alias("ax0"), ((F.col("ay0") + F.col("ay1")) / 2).alias("ay0")).withColumns({"ax1": F.col("ax0"), "ay1": F.col("ay0")})
    j = grid_join(p, _tracts(spark, d), 4.0)
    return j.where("ax0 >= bx0 AND ax0 < bx1 AND ay0 >= by0 AND ay0 < by1").groupBy("a").agg(F.min("b").alias("b"))


def within_distance(spark, d):
    """Tract middles within 1.5 of a road, here the diagonal of each place."""
    road = F.array("ax0", "ay0", "ax1", "ay1")
    t = _tracts(spark, d).select("b", (F.col("bx0") + 1).alias("bx0"), (F.col("by0") + 1).alias("by0")).withColumns({"bx1": F.col("bx0"), "by1": F.col("by0")})
    found = lambda j: j.withColumn("dist", F.round(line_distance("bx0", "by0", road), 6)).where("dist <= 1.5")
    return shape_join(_places(spark, d), t, found, 4.0, grow=1.5).select("a", "b", "dist")


def adjacency(spark, d):
    """Places that touch, both ways, and each with itself."""
    a = _places(spark, d)
    b = a.select(F.col("a").alias("b"), *[F.col(f"a{s}").alias(f"b{s}") for s in ("x0", "y0", "x1", "y1")])
    return grid_join(a, b, 4.0).select("a", "b")


_PL = "(SELECT *, x0 + w AS x1, y0 + w AS y1 FROM (SELECT s_suppkey AS a, (s_suppkey * 7 % 101)::DOUBLE AS x0, (s_suppkey * 13 % 97)::DOUBLE AS y0, s_suppkey % 5 + 1.0::DOUBLE AS w FROM supplier))"
_TR = "(SELECT *, x0 + 2 AS x1, y0 + 2 AS y1 FROM (SELECT c_custkey AS b, (c_custkey % 53)::DOUBLE * 2 AS x0, ((c_custkey // 53) % 50)::DOUBLE * 2 AS y0 FROM customer))"
QUERIES = {f.__name__: f for f in (place_tract_overlap, point_in_polygon, within_distance, adjacency, polygon_overlap, point_in_shape, near_tracts, trail_buffers, polygon_texts)}
SQL = {
    "place_tract_overlap": f"SELECT a, b, s AS share, CASE WHEN s >= 0.95 THEN 'contains' WHEN s >= 0.5 THEN 'majority' ELSE 'intersects' END AS kind FROM (SELECT a, b, round((least(p.x1, t.x1) - greatest(p.x0, t.x0)) * (least(p.y1, t.y1) - greatest(p.y0, t.y0)) / 4, 4) AS s FROM {_PL} p JOIN {_TR} t ON p.x0 < t.x1 AND t.x0 < p.x1 AND p.y0 < t.y1 AND t.y0 < p.y1)",
    "point_in_polygon": f"SELECT a, min(b) AS b FROM (SELECT a, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM {_PL}) p JOIN {_TR} t ON x >= t.x0 AND x < t.x1 AND y >= t.y0 AND y < t.y1 GROUP BY 1",
    "within_distance": f"SELECT a, b, dist FROM (SELECT a, b, round(sqrt((px - x0 - u * w) ** 2 + (py - y0 - u * w) ** 2), 6) AS dist FROM (SELECT a, b, p.x0, p.y0, p.w, t.x0 + 1 AS px, t.y0 + 1 AS py, least(1, greatest(0, ((t.x0 + 1 - p.x0) + (t.y0 + 1 - p.y0)) / (2 * p.w))) AS u FROM {_PL} p, {_TR} t)) WHERE dist <= 1.5",
    "polygon_overlap": f"""WITH o AS (SELECT a, b, w, (greatest(0, least(p.x1, t.x1) - greatest(p.x0, t.x0)) * greatest(0, least(p.y1, t.y1) - greatest(p.y0, t.y0)) - greatest(0, least(p.x1, t.x1) - greatest(p.x0 + w / 2, t.x0)) * greatest(0, least(p.y1, t.y1) - greatest(p.y0 + w / 2, t.y0))) AS area
  FROM {_PL} p JOIN {_TR} t ON p.x0 <= t.x1 AND t.x0 <= p.x1 AND p.y0 <= t.y1 AND t.y0 <= p.y1), s AS (SELECT a, b, round(area / 4, 4) AS tract_share, round(area / (w * w * 0.75), 4) AS place_share FROM o)
SELECT *, CASE WHEN place_share >= 0.95 THEN 'contains' WHEN tract_share >= 0.5 THEN 'majority' ELSE 'intersects' END AS kind FROM s WHERE greatest(tract_share, place_share) >= 0.05""",
    "point_in_shape": f"SELECT a, b FROM {_PL} p JOIN {_TR} t ON t.x0 + 1 >= p.x0 AND t.x0 + 1 < p.x1 AND t.y0 + 1 >= p.y0 AND t.y0 + 1 < p.y1 WHERE NOT (t.x0 + 1 >= p.x0 + w / 2 AND t.y0 + 1 >= p.y0 + w / 2)",
    "near_tracts": f"SELECT a, b, d AS dist FROM (SELECT a, b, round(sqrt(greatest(0, p.x0 - t.x1, t.x0 - p.x1) ** 2 + greatest(0, p.y0 - t.y1, t.y0 - p.y1) ** 2), 6) AS d FROM {_PL} p JOIN {_TR} t ON p.x0 - 1.5 <= t.x1 AND t.x0 <= p.x1 + 1.5 AND p.y0 - 1.5 <= t.y1 AND t.y0 <= p.y1 + 1.5) WHERE d > 0 AND d <= 1.5",
    "trail_buffers": f"SELECT a, b, CASE WHEN d <= 0.25 THEN 0.25 WHEN d <= 0.5 THEN 0.5 WHEN d <= 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS width FROM (SELECT a, b, round(least(sqrt(greatest(0, p.x0 - t.x1, t.x0 - p.x1) ** 2 + greatest(0, p.y0 - t.y1, t.y0 - p.y0) ** 2), sqrt(greatest(0, p.x1 - t.x1, t.x0 - p.x1) ** 2 + greatest(0, p.y0 - t.y1, t.y0 - p.y1) ** 2)), 6) AS d FROM {_PL} p JOIN {_TR} t ON p.x0 - 2 <= t.x1 AND t.x0 <= p.x1 + 2 AND p.y0 - 2 <= t.y1 AND t.y0 <= p.y1 + 2) WHERE d <= 2",
    "polygon_texts": f"SELECT a, round(w * w * 0.75, 6) AS area, 12 AS numbers FROM {_PL}",
    "adjacency": f"SELECT p.a, q.a AS b FROM {_PL} p JOIN {_PL} q ON p.x0 <= q.x1 AND q.x0 <= p.x1 AND p.y0 <= q.y1 AND q.y0 <= p.y1",
}
