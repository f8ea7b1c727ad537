"""Filling fixed-capacity containers with texts.

Texts are measured in tokens; one that exceeds the largest capacity is cut into full pieces and a rest.  Buckets of
a bounded number of pieces are packed independently, by best fit in order of falling size.  For the largest piece left, the
permitted capacities are weighed against each other: for each, the best sum that the sizes still left can make of its room
is looked up, and the one with the least cost per token held is opened and filled with the pieces of that sum; of the mixes of
capacities that come of it, the cheapest in all is kept.  A
container of c tokens costs ``OPEN_COST + c + c * c / LONG``: long sequences cost more than their tokens, so that a small
container that comes out full is worth more than a large one.  Containers that are not nearly full are taken apart and
packed again with those of other buckets, in fewer and fewer buckets.  In the end each container shrinks to the smallest
permitted capacity that holds its contents.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import durable, table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published split pattern of the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CAPACITIES = (256, 512, 1024, 2048)
BUCKET_PIECES = 40_000
#: A container with at least this share filled is closed after its round.
FULL = 0.995
#: Cost of having one more container, in tokens, and the length at which a sequence costs twice its tokens.
OPEN_COST, LONG = 2, 131_072


def token_counts(docs: DataFrame, id_col: str, text_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id and n_tokens of every text; a null text has none."""

    with open(tokenizer, "rb") as f:  # the driver's copy goes to the executors
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32())], names=["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, "doc_id bigint, n_tokens int")


def pieces(sizes: DataFrame, largest: int) -> DataFrame:
    """doc_id, piece (from 0), first_token, n_tokens: full pieces and a rest for a text over ``largest``, else the text itself."""
    n = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / largest)).cast("int")
    p = sizes.where("doc_id IS NOT NULL").select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    return p.select("doc_id", "piece", (F.col("piece") * largest).alias("first_token"), F.least(F.lit(largest), F.col("n_tokens") - F.col("piece") * largest).cast("int").alias("n_tokens"))


def sums_of(sizes: list[int], largest: int) -> int:
    """Bit t is set if some of the sizes, each as often as one likes, add up to t (at most ``largest``)."""
    out, mask = 1, (2 << largest) - 1
    for s in sizes:
        step = s
        while step <= largest:
            out |= (out << step) & mask
            step *= 2
    return out


def best_fit(sizes: np.ndarray, capacities: tuple[int, ...], long: float = LONG) -> tuple[np.ndarray, np.ndarray]:
    """The container of each piece, and each container's capacity (not yet shrunk)."""
    largest = max(capacities)
    where = np.zeros(len(sizes), dtype=np.int64)
    order = np.argsort(sizes, kind="stable")
    begin = np.searchsorted(sizes[order], np.arange(largest + 2)).tolist()
    left = [begin[s + 1] - begin[s] for s in range(largest + 1)]  # the last so many pieces of each size are unpacked
    left[0] = 0
    there = np.array([s for s in range(largest, 0, -1) if left[s]], dtype=np.int64)
    caps: list[int] = []
    reach = sums_of(there.tolist(), largest)
    sums = np.array([reach >> t & 1 for t in range(largest + 1)], dtype=bool)

    def take(s: int) -> None:
        nonlocal there
        left[s] -= 1
        where[order[begin[s] + left[s]]] = len(caps) - 1
        if not left[s]:
            there = there[there != s]

    while len(there):
        s = int(there[0])
        # sizes that ran out since the sums were made are found out when a sum can't be paid; then they are made anew
        made = {c: (reach & ((2 << (c - s)) - 1)).bit_length() - 1 for c in capacities if c >= s}
        c = min(made, key=lambda c: ((OPEN_COST + c + c * c / long) / (s + made[c]), c))
        caps.append(c)
        take(s)
        room, due = c - s, made[c]
        while due > 0 and len(there):
            fits = there[np.searchsorted(-there, -due) :]
            good = np.nonzero(sums[due - fits])[0]
            if len(good):
                a = int(fits[good[0]])
                take(a)
                room, due = room - a, due - a
                continue
            reach = sums_of(there.tolist(), largest)
            sums = np.array([reach >> t & 1 for t in range(largest + 1)], dtype=bool)
            due = (reach & ((2 << room) - 1)).bit_length() - 1
    if not caps and len(sizes):
        caps.append(min(capacities))  # pieces without tokens only
    return where, np.array(caps, dtype=np.int64)


def cheapest_mix(sizes: np.ndarray, capacities: tuple[int, ...], long: float = LONG) -> tuple[np.ndarray, np.ndarray]:
    """The cheapest of the packings that may use the largest capacity, the two largest, and so on to all."""
    caps = sorted(set(capacities), reverse=True)
    tries = [best_fit(sizes, tuple(caps[:k]), long) for k in range(1, len(caps) + 1)]
    return min(tries, key=lambda x: float((OPEN_COST + x[1] + x[1] ** 2 / long).sum()))


def _round(items: DataFrame, buckets: int, number: int, capacities: tuple[int, ...], long: float) -> DataFrame:
    def pack(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["doc_id", "piece"], kind="stable").reset_index(drop=True)
        where, caps = cheapest_mix(g["n_tokens"].to_numpy(dtype=np.int64), capacities, long)
        g["filled"] = np.bincount(where, weights=g["n_tokens"], minlength=len(caps)).astype(np.int64)[where]
        g["opened"] = caps[where]
        g["container_id"] = [f"{number}-{b}-{w}" for b, w in zip(g["bucket"], where, strict=True)]
        return g[["doc_id", "piece", "first_token", "n_tokens", "container_id", "filled", "opened"]]

    b = items.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", F.lit(number)), F.lit(buckets)).cast("int"))
    return b.groupBy("bucket").applyInPandas(pack, "doc_id bigint, piece int, first_token int, n_tokens int, container_id string, filled bigint, opened bigint")


def fill_containers(sizes: DataFrame, capacities: tuple[int, ...] = CAPACITIES, bucket_pieces: int = BUCKET_PIECES, long: float = LONG) -> DataFrame:
    """doc_id, piece, first_token, n_tokens, container_id, filled, opened (its capacity at first), capacity for every piece of every text.

    ``sizes``: doc_id, n_tokens.  A text without tokens is a piece of size 0 in some container.  A repeated doc_id
    is packed each time it occurs.  An empty table gives no rows.
    """
    largest = max(capacities)
    todo = pieces(sizes, largest)
    todo = durable(todo)
    closed: list[DataFrame] = []
    number = 0
    while True:
        n = todo.count()
        buckets = max(1, -(-n // bucket_pieces))
        packed = durable(_round(todo, buckets, number, capacities, long))
        if buckets == 1:
            closed.append(packed)
            break
        done = F.col("filled") >= F.col("opened") * FULL
        closed.append(packed.where(done))
        rest = packed.where(~done).select("doc_id", "piece", "first_token", "n_tokens")
        if rest.count() > 0.9 * n:  # nothing more to gain from mixing
            closed.append(packed.where(~done))
            break
        todo, number = rest, number + 1
    out = closed[0]
    for c in closed[1:]:
        out = out.unionByName(c)
    shrunk = F.lit(largest)
    for c in sorted(capacities, reverse=True):
        shrunk = F.when(F.col("filled") <= c, c).otherwise(shrunk)
    return out.withColumn("capacity", shrunk)


def p7_containers(spark, d: str) -> DataFrame:
    return fill_containers(token_counts(table(spark, d, "documents"), "doc_id", "text"))


def p7_fill(spark, d: str) -> DataFrame:
    """How full the containers are, by capacity."""
    c = p7_containers(spark, d).groupBy("container_id", "capacity").agg(F.max("filled").alias("filled"), F.count(F.lit(1)).alias("pieces"))
    return c.groupBy("capacity").agg(F.count(F.lit(1)).alias("containers"), F.sum("pieces").alias("pieces"), F.sum("filled").alias("tokens"), F.round(F.sum("filled") / (F.count(F.lit(1)) * F.col("capacity")), 5).alias("fill"))


QUERIES = {"p7_containers": p7_containers, "p7_fill": p7_fill}
SQL = {}
