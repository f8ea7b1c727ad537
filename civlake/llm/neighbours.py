"""The most similar vectors of every vector.

Vectors are brought to length 1, rotated by a random orthogonal matrix and stored as half floats.  Centroids fitted on a
bounded sample (``SAMPLE`` rows) part them into short lists; every vector is at home in one list and visits the nearest
ones.  Lists are gathered into blocks of about ``BLOCK_ROWS`` rows, a visitor goes once to each block that holds a list it
visits, and blocks with many visitors are split.  In a visited list, distances are summed over blocks of rotated
columns; after each, a hypothesis test on the partial distance abandons candidates that can't come within the wanted
distance (with probability set by ``EPSILON``), and only the rest is carried on.  Equal vectors form one class,
searched once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..runtime import durable, salted_join, table

SAMPLE = 32_768
#: Lists of about so many rows; at most MOST_LISTS, as many as the sample supports (beyond, lists grow longer).
LIST_ROWS = 48
MOST_LISTS = 16_384
BLOCK_ROWS = 4096
BLOCK_VISITORS = 32_768
#: Vectors that are fetched by broadcast of their ids; more are fetched by shuffle.
BROADCAST_IDS = 200_000
#: Half floats are this near the cosine: what lies nearer to a threshold is computed from the vectors themselves.
HALF_ERROR = 0.003
EPSILON = 2.1
FIRST, STEP = 0.25, 0.25  # shares of the columns in the first and each later block
SEED = 20


def unit_rows(flat: np.ndarray, offsets: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The usable rows of one dimension (finite, not all zero) and these at length 1."""
    rows = np.nonzero(np.diff(offsets) == dim)[0]
    x = flat[offsets[rows][:, None] + np.arange(dim)].astype(np.float64)
    with np.errstate(all="ignore"):
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    ok = np.isfinite(x).all(axis=1)
    return rows[ok], x[ok]


def _by_dim(col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    col = col.cast(pa.list_(pa.float64()))
    sizes = np.where(col.is_null().to_numpy(zero_copy_only=False), 0, col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    flat, offsets = col.flatten().fill_null(np.nan).to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])
    for dim in np.unique(sizes[sizes > 0]):
        rows, x = unit_rows(flat, offsets, int(dim))
        if len(rows):
            yield int(dim), rows, x


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED + dim).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def prepared(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, dim, key (equal for equal directions), v (rotated unit vector in half floats); null, empty, all-zero and non-finite vectors drop out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for dim, rows, x in _by_dim(b.column(1)):
                turn = turns.setdefault(dim, rotation(dim)) if dim in turns else turns.setdefault(dim, rotation(dim))
                keys = [xxhash.xxh3_128_digest(r.tobytes()) for r in np.round(x * 2**20).astype(np.int32)]
                half = (x.astype(np.float32) @ turn).astype(np.float16)
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(np.full(len(rows), dim, dtype=np.int32)), pa.array(keys, pa.binary()), pa.array([r.tobytes() for r in half], pa.binary())], names=["id", "dim", "key", "v"])

    src = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("e")).where("id IS NOT NULL AND e IS NOT NULL")
    return src.mapInArrow(run, "id bigint, dim int, key binary, v binary")


def _centroids(x: np.ndarray, n: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: n directions and the one that each row is nearest to."""
    c = x[np.random.default_rng(SEED).choice(len(x), n, replace=False)]
    for left in range(rounds if n > 1 else 1, 0, -1):
        a = np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        if left > 1:
            total = np.zeros_like(c)
            np.add.at(total, a, x)
            norm = np.sqrt((total * total).sum(axis=1, keepdims=True))
            c = np.where(norm > 0, total / np.maximum(norm, 1e-12), c)
    return c, a


class Lists:
    """Centroids of the lists of one dimension, and how the lists lie in blocks.

    block: the (first) block of a list; parts: over how many blocks a long list is spread; splits: how many tasks share the
    visitors of a block."""

    def __init__(self, x: np.ndarray, rows: int, n: int, nprobe: float, least: int, seeking: float):
        n1 = max(1, round(math.sqrt(n)))
        coarse, a = _centroids(x, n1)
        fine = [_centroids(x[a == k], min(int((a == k).sum()), max(1, round(n * (a == k).mean()))))[0] for k in range(n1) if (a == k).any()]
        self.c = np.concatenate(fine)
        size = np.bincount(self.nearest(x, 1)[:, 0], minlength=len(self.c)) / len(x) * rows
        self.parts = np.maximum(1, np.ceil(size / BLOCK_ROWS)).astype(np.int64)
        self.block = np.zeros(len(size), dtype=np.int64)
        at, held = 0, 0.0
        for k, s in enumerate(size.tolist()):  # lists of one coarse centroid stand side by side
            if held and (held + s > BLOCK_ROWS or self.parts[k] > 1):
                at, held = at + 1, 0.0
            self.block[k] = at
            held += s
            if self.parts[k] > 1:
                at, held = at + int(self.parts[k]), 0.0
        self.probe = int(min(len(self.c), max(1, least, math.ceil(nprobe * len(self.c)))))
        some = x[:: max(1, len(x) // 4096)]
        seen = self.nearest(some, self.probe)
        hits = np.zeros(at + 1 + int(self.parts[-1]))
        for row in seen:
            hits[np.unique(self.block[row])] += 1
        self.splits = np.maximum(1, np.ceil(hits / len(some) * rows * seeking / BLOCK_VISITORS)).astype(np.int64)
        for k in np.nonzero(self.parts > 1)[0]:
            self.splits[self.block[k] : self.block[k] + self.parts[k]] = self.splits[self.block[k]]

    def nearest(self, x: np.ndarray, p: int) -> np.ndarray:
        out = []
        for i in range(0, len(x), 2048):
            near = -(x[i : i + 2048] @ self.c.T)
            part = np.argpartition(near, p - 1, axis=1)[:, :p] if p < len(self.c) else np.tile(np.arange(len(self.c)), (len(near), 1))
            out.append(np.take_along_axis(part, np.argsort(np.take_along_axis(near, part, 1), axis=1, kind="stable"), 1))
        return np.concatenate(out)


def fit_lists(vectors: DataFrame, id_col: str, vec_col: str, nprobe: float, least: int, list_rows: int, seeking: float) -> dict[int, Lists]:
    """The lists of each dimension, from a sample of about SAMPLE rows (by id hash; never more than twice that)."""
    total = vectors.count()
    share = F.pmod(F.xxhash64(id_col), F.lit(1 << 40)) <= int((1 << 40) * min(1.0, SAMPLE / max(1, total)))
    sample = vectors.where(F.col(vec_col).isNotNull() & share).select(F.col(vec_col).cast("array<float>").alias("e")).limit(2 * SAMPLE).toArrow()
    out = {}
    if not sample.num_rows:
        return out
    for dim, _, x in _by_dim(sample["e"].combine_chunks()):
        rows = max(1, total * len(x) // sample.num_rows)
        out[dim] = Lists(x.astype(np.float32) @ rotation(dim), rows, int(max(1, min(MOST_LISTS, rows // list_rows, len(x)))), nprobe, least, seeking)
    return out


def _placed(reps: DataFrame, lists: dict[int, Lists]) -> DataFrame:
    """A home row (kind 0, in each split of its block) for each vector, and where it seeks, a visiting row (kind 1) for each block
    that holds lists it visits.  lists: numbers of these lists, or of the one it is at home in, the nearest first."""
    shared = reps.sparkSession.sparkContext.broadcast(lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            ids, dims, seek = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
            for dim in np.unique(dims):
                at = np.nonzero(dims == dim)[0]
                vec = b.column(2).take(pa.array(at))
                x = np.frombuffer(b"".join(vec.to_pylist()), dtype=np.float16).reshape(len(at), dim).astype(np.float32)
                own = known.get(int(dim)) or Lists(x[:1], 1, 1, 1.0, 1, 1.0)
                mix = (ids[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                near = own.nearest(x, own.probe)
                home = near[:, 0]
                block = own.block[home] + (mix % own.parts[home].astype(np.uint64)).astype(np.int64)
                copies = own.splits[block]
                who = np.repeat(np.arange(len(at)), copies)
                split = np.arange(len(who)) - np.repeat(np.cumsum(copies) - copies, copies)
                rows = [(who, block[who], split, np.zeros(len(who), dtype=np.int32), np.ones(len(who), dtype=np.int64), home[who])]
                s = np.nonzero(seek[at])[0] if seek is not None else []
                if len(s):
                    q, l = np.repeat(s, own.probe), near[s].ravel()
                    parts = own.parts[l]
                    q, l2 = np.repeat(q, parts), np.repeat(l, parts)
                    blk = own.block[l2] + np.arange(len(q)) - np.repeat(np.cumsum(parts) - parts, parts)
                    order = np.lexsort((blk, q))  # stable: lists of a block stay in order of nearness
                    q, blk, l2 = q[order], blk[order], l2[order]
                    first = np.nonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (blk[1:] != blk[:-1])]))[0]
                    to = own.splits[blk[first]].astype(np.uint64)
                    rows.append((q[first], blk[first], (mix[q[first]] % to).astype(np.int64), np.ones(len(first), dtype=np.int32), np.diff(np.append(first, len(q))), l2))
                for who, blk, split, kind, size, numbers in rows:
                    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                    cols = [pa.array(np.full(len(who), dim, dtype=np.int32)), pa.array(blk.astype(np.int32)), pa.array(split.astype(np.int32)), pa.array(kind), pa.array(ids[at][who]), vec.take(pa.array(who)), pa.ListArray.from_arrays(pa.array(ends), pa.array(numbers.astype(np.int32)))]
                    yield pa.RecordBatch.from_arrays(cols, names=["dim", "block", "split", "kind", "id", "v", "lists"])

    return reps.select("id", "dim", "v", "seeks").mapInArrow(run, "dim int, block int, split int, kind int, id bigint, v binary, lists array<int>")


def scan(q: np.ndarray, h: np.ndarray, tau2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (row of q, row of h) whose squared distance stays within ``tau2`` (per row of q), found block by block of columns."""
    dim = q.shape[1]
    first = max(1, int(dim * FIRST))
    step = max(1, int(dim * STEP))
    d = (q[:, :first] ** 2).sum(1)[:, None] + (h[:, :first] ** 2).sum(1)[None] - 2 * (q[:, :first] @ h[:, :first].T)
    loose = (1 + EPSILON / np.sqrt(first)) ** 2 * first / dim if first < dim else 1.0
    i, j = np.nonzero(d <= (tau2 * min(1.0, loose) if first < dim else tau2)[:, None])
    d = d[i, j]
    at = first
    while at < dim and len(i):
        to = min(dim, at + step)
        d += ((q[i, at:to] - h[j, at:to]) ** 2).sum(1)
        loose = min(1.0, (1 + EPSILON / np.sqrt(to)) ** 2 * to / dim) if to < dim else 1.0
        keep = d <= tau2[i] * loose
        i, j, d, at = i[keep], j[keep], d[keep], to
    return i, j, d


def best(owner: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest d of each owner."""
    order = np.lexsort((d, owner))
    o = owner[order]
    start = np.searchsorted(o, o)
    return order[np.arange(len(o)) - start < k]


def _visit(hid: np.ndarray, h: np.ndarray, home: np.ndarray, qid: np.ndarray, q: np.ndarray, who: np.ndarray, lists: np.ndarray, first: np.ndarray, k: int, tau2: float | None, both_ways: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """Edges of visitors q with the residents h of the lists they visit: the k best of each.

    who, lists: a visit of q[who] to a list; first: is it the visitor's nearest in this block.  Without a distance to beat,
    the k-th best of that list (of all that the visitor has met so far) is it.
    """
    order = np.argsort(home, kind="stable")
    hid, h, home = hid[order], h[order], home[order]
    bound = np.full(len(q), 4.1 if tau2 is None else tau2 + 2e-3, dtype=np.float32)
    i_all, j_all, d_all = ([np.empty(0, dtype=t)] for t in (np.int64, np.int64, np.float32))
    for turn in (first, ~first) if tau2 is None else (np.ones(len(who), dtype=bool),):
        by = np.argsort(lists[turn], kind="stable")
        w, l = who[turn][by], lists[turn][by]
        cuts = np.nonzero(np.diff(l, prepend=-1))[0]
        for lo, hi in zip(cuts.tolist(), np.append(cuts, len(l))[1:].tolist(), strict=True):
            a, z = np.searchsorted(home, l[lo]), np.searchsorted(home, l[lo], side="right")
            for at in range(lo, hi, 1024):
                own = w[at : min(hi, at + 1024)]
                for part in range(a, z, BLOCK_ROWS):
                    to = min(z, part + BLOCK_ROWS)
                    i, j, d = scan(q[own], h[part:to], bound[own])
                    i, j = own[i], j + part
                    keep = qid[i] != hid[j]
                    i_all.append(i[keep])
                    j_all.append(j[keep])
                    d_all.append(d[keep])
        i, j, d = np.concatenate(i_all), np.concatenate(j_all), np.concatenate(d_all)
        use = best(i, d, k)
        if both_ways:
            back = best(j, d, k)
            yield hid[j[back]], qid[i[back]], d[back]
        i, j, d = i[use], j[use], d[use]
        i_all, j_all, d_all = [i], [j], [d]
        if tau2 is None and len(i):  # what k candidates reach, the rest has to beat
            n, worst = np.bincount(i, minlength=len(q)), np.zeros(len(q), dtype=np.float32)
            np.maximum.at(worst, i, d)
            bound = np.where(n >= k, worst + 1e-3, bound).astype(np.float32)
    yield qid[i], hid[j], d


def _search(placed: DataFrame, k: int, tau2: float | None, both_ways: bool) -> DataFrame:
    """Directed edges q, n, d2: of each probed block the k best of a visitor (and of a resident among the visitors)."""

    def vectors(b: pa.RecordBatch, dim: int) -> tuple[np.ndarray, ...]:
        x = np.frombuffer(b"".join(b.column(5).to_pylist()), dtype=np.float16).reshape(b.num_rows, dim).astype(np.float32)
        own = b.column(6)
        return b.column(4).to_numpy(), x, own.flatten().to_numpy(), own.value_lengths().to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, homes, held = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(4)], axis=1)
            cuts = np.concatenate([[0], np.nonzero((key[1:] != key[:-1]).any(axis=1))[0] + 1, [b.num_rows]])
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if tuple(key[lo, :3]) != now:
                    now, homes, held = tuple(key[lo, :3]), [], None
                part = vectors(b.slice(lo, hi - lo), int(key[lo, 0]))
                if key[lo, 3] == 0:
                    homes.append(part[:3])
                    continue
                if not homes:
                    continue
                if held is None:
                    held = tuple(np.concatenate([x[c] for x in homes]) for c in range(3))
                ids, x, numbers, size = part
                who = np.repeat(np.arange(len(ids)), size)
                first = np.arange(len(who)) == np.repeat(np.cumsum(size) - size, size)
                for qi, ni, d in _visit(*held, ids, x, who, numbers, first, k, tau2, both_ways):
                    if len(qi):
                        yield pa.RecordBatch.from_arrays([pa.array(qi), pa.array(ni), pa.array(d.astype(np.float32))], names=["q", "n", "d2"])

    grouped = placed.repartition("dim", "block", "split").sortWithinPartitions("dim", "block", "split", "kind")
    found = grouped.mapInArrow(run, "q bigint, n bigint, d2 float")
    near = found.groupBy("q", "n").agg(F.min("d2").alias("d2"))
    w = W.partitionBy("q").orderBy("d2", "n")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("q", "n", (1 - F.col("d2").cast("double") / 2).alias("cosine"), "rank")


def exact_cosines(pairs: DataFrame, vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """The pairs (id, neighbour, ...) with ``exact``, the cosine of the vectors as they were given."""
    ids = durable(pairs.select(F.explode(F.array("id", "neighbour")).alias("i")).distinct())
    v = vectors.select(F.col(id_col).cast("bigint").alias("i"), F.col(vec_col).cast("array<double>").alias("e")).where("e IS NOT NULL")
    v = v.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "i", "left_semi").dropDuplicates(["i"])
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda t, z: t + z)
    v = v.withColumn("n", F.sqrt(dot(F.col("e"), F.col("e"))))
    j = pairs.join(v.select(F.col("i").alias("id"), F.col("e").alias("ea"), F.col("n").alias("na")), "id").join(v.select(F.col("i").alias("neighbour"), F.col("e").alias("eb"), F.col("n").alias("nb")), "neighbour")
    return j.withColumn("exact", dot(F.col("ea"), F.col("eb")) / (F.col("na") * F.col("nb"))).drop("ea", "eb", "na", "nb")


def nearest(vectors: DataFrame, id_col: str, vec_col: str, k: int = 5, least: float | None = None, queries: Column | None = None, nprobe: float = 0.05, lists: int = 64, list_rows: int = LIST_ROWS) -> DataFrame:
    """The k most similar other vectors: id, neighbour, cosine, rank (1 = most similar; equal ones by id).

    ``least``: only neighbours of at least this cosine.  ``queries``: condition on ``id``; all vectors are searched
    in any case.  ``nprobe``: share of the lists to visit, at least ``lists`` of them, of about ``list_rows`` rows.  Vectors of different lengths are
    scaled to length 1; vectors of different dimension are never neighbours; null, empty, all-zero and non-finite
    ones take no part; a repeated id counts each time.  An empty table gives no rows.
    """
    fitted = fit_lists(vectors, id_col, vec_col, nprobe, lists, list_rows, 1.0 if queries is None else vectors.select(F.col(id_col).alias("id")).agg(F.avg(queries.cast("int"))).first()[0] or 0.0)
    v = prepared(vectors, id_col, vec_col)
    wanted = F.lit(True) if queries is None else queries
    by_key = W.partitionBy("key", "dim").orderBy("id")
    members = v.select("id", "key", "dim").distinct()
    sizes = members.groupBy("key", "dim").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("rep"), F.max(wanted.cast("int")).alias("wanted"))
    dup = durable(salted_join(members.withColumn("k2", F.hex("key")), sizes.where("n > 1").select(F.hex("key").alias("k2"), "n", "rep", F.col("wanted").alias("class_wanted")), "k2", "id", "inner").select("rep", "id", "n", "key", "class_wanted"))
    first = dup.withColumn("rn", F.row_number().over(W.partitionBy("rep").orderBy("id"))).where(F.col("rn") <= k + 1)
    heads = first.groupBy("rep").agg(F.max("n").alias("n"), F.sort_array(F.collect_list("id")).alias("ids"), F.max("class_wanted").alias("class_wanted"))
    reps = v.withColumn("rn", F.row_number().over(by_key)).where("rn = 1")
    if queries is None:
        reps = reps.withColumn("seeks", F.lit(True))
    else:
        reps = reps.join(heads.select(F.col("rep").alias("id"), "class_wanted"), "id", "left").withColumn("seeks", (F.coalesce(F.col("class_wanted") == 1, F.lit(False)) | wanted))
    tau2 = None if least is None else 2 - 2 * least
    found = _search(_placed(reps, fitted), k, tau2, both_ways=queries is None)
    if least is not None:
        found = found.where(F.col("cosine") >= least)
    # classes back to their vectors: a class of s equal vectors fills s - 1 places of each of its members
    a = found.join(heads.select(F.col("rep").alias("q"), F.col("n").alias("qn"), F.col("ids").alias("qids")), "q", "left").join(heads.select(F.col("rep").alias("n"), F.col("ids").alias("nids")), "n", "left")
    a = a.where(F.coalesce("qn", F.lit(1)) <= k).withColumn("neighbour", F.explode(F.coalesce(F.slice("nids", 1, k), F.array("n"))))
    a = a.withColumn("place", F.row_number().over(W.partitionBy("q").orderBy(F.desc("cosine"), "neighbour")) + F.coalesce("qn", F.lit(1)) - 1).where(F.col("place") <= k)
    far = a.withColumn("id", F.explode(F.coalesce("qids", F.array("q")))).select("id", "neighbour", "cosine", F.col("place").cast("int").alias("rank"))
    same = salted_join(dup.select("rep", "id"), heads.select("rep", "ids"), "rep", "id", "inner")
    others = F.slice(F.filter("ids", lambda x: x != F.col("id")), 1, k)
    same = same.select("id", F.posexplode(others).alias("p", "neighbour")).select("id", "neighbour", F.lit(1.0).alias("cosine"), (F.col("p") + 1).cast("int").alias("rank"))
    out = far.unionByName(same)
    return out if queries is None else out.where(wanted)


def p5_found(spark, d: str) -> DataFrame:
    u = table(spark, d, "universe_embeddings")
    e = nearest(u, "vec_id", "embedding", 5, least=0.85 - HALF_ERROR, nprobe=0.0, lists=6, list_rows=768)
    e = durable(e.select(F.least("id", "neighbour").alias("id"), F.greatest("id", "neighbour").alias("neighbour"), "cosine").distinct())
    near = F.col("cosine") < 0.85 + HALF_ERROR
    sure = e.where(~near).select("id", "neighbour")
    rest = exact_cosines(e.where(near).select("id", "neighbour").distinct(), u, "vec_id", "embedding").where("exact >= 0.85").select("id", "neighbour")
    return sure.unionByName(rest).select(F.col("id").alias("id_a"), F.col("neighbour").alias("id_b")).distinct()


def p5_nearest(spark, d: str) -> DataFrame:
    """The 5 nearest of every vector whose id is divisible by 20, among all vectors."""
    u = table(spark, d, "universe_embeddings")
    e = exact_cosines(durable(nearest(u, "vec_id", "embedding", 8, queries=F.col("id") % 20 == 0)), u, "vec_id", "embedding")
    w = W.partitionBy("id").orderBy(F.round("exact", 9).desc(), "neighbour")
    return e.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("id", "neighbour", F.round("exact", 3).alias("cosine"), "rank")


QUERIES = {"p5_found": p5_found, "p5_nearest": p5_nearest}
_SQL = """
WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM universe_embeddings WHERE embedding IS NOT NULL AND list_sum(list_transform(embedding::DOUBLE[], lambda x: abs(x))) > 0),
n AS (SELECT a.id, b.id AS neighbour, list_cosine_similarity(a.e, b.e) AS cosine FROM v a JOIN v b ON a.id <> b.id AND len(a.e) = len(b.e) {where}),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(cosine, 9) DESC, neighbour)::INT AS rank FROM n QUALIFY rank <= 5)
"""
SQL = {
    "p5_found": _SQL.format(where="") + "SELECT DISTINCT least(id, neighbour) AS id_a, greatest(id, neighbour) AS id_b FROM k WHERE cosine >= 0.85",
    "p5_nearest": _SQL.format(where="WHERE a.id % 20 = 0") + "SELECT id, neighbour, round(cosine, 3) AS cosine, rank FROM k",
}
