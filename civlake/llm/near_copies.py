"""Near-duplicate records with small edits.

A text is the set of its words.  Its fingerprint, a line of bits with a place for each word, is cut into segments, and
the segments' bit counts are its embedding: the Manhattan distance of two embeddings never exceeds the number of words
in which the texts differ, which a similarity of J bounds by (1-J)/(1+J) x (sum of their sizes).

The line has two zones: words of at most ``COMMON_FROM`` texts, hashed, and the common words, in order of frequency.
Pairs in range meet on the grid of one zone or the other, whatever words they share:

* A pair that shares an uncommon word meets in the first such cell (by hash), which holds at most ``COMMON_FROM`` texts;
  it is among the first n - ceil(J n) + 1 cells of either text of n words, as no more than n - ceil(J n) are not shared.
* A pair that shares none has spent the counts of all its uncommon words; what is left of the range, r, bounds the
  distance in the common zone.  That zone is cut into blocks of two segments; of more than r / 2 blocks one differs by 1
  at most, so that one of its segments is equal in both (the grid cell) and the other within a range of 1 (the range
  join inside the cell, see ``common_candidates``).

A coarse embedding over both zones has SEGMENTS counts of up to CAP, kept in unary as bit planes, so that its Manhattan
distance is a population count; it is tested for every pair that meets.  What lies within range is verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..runtime import durable, salted_join, table
from .components import components

SEGMENTS = 64
CAP = 2
#: A word is common if it occurs in more texts than this; the limit is doubled while there are over COMMON_MOST of them.
COMMON_FROM = 256
COMMON_MOST = 262_144
#: Numbers of common segments to choose from (twice the blocks).
LEVELS = np.array(sorted({2, 4, 6, 8, 10, 12, 14, *(k << e for e in range(2, 22) for k in (4, 5, 6, 7))}))
#: Twice the slack of a text is counted down to the negative of this.
LARGE = 1 << 20
#: Bits of the map that tells where the texts of a higher level can be met.
MAP_BITS = 1 << 24
#: Texts looked at to find cells that hold over a fiftieth of all texts; these are spread by what else must agree.
HOT_SAMPLE = 20_000
#: Rows and pairs handled at once in a task.
BLOCK_ROWS, BLOCK_PAIRS = 1_000_000, 2_000_000
#: Candidate ids up to this number are broadcast to fetch their texts; more are joined by shuffle.
BROADCAST_IDS = 200_000
#: Bytes of text taken apart, and hashes of words counted, at once in a task.
BLOCK_BYTES, BLOCK_HASHES = 1 << 24, 1 << 21

#: The letter or digit that a byte stands for, in lower case; 0 for all others.
_KIND = bytes(ord(c.lower()) if (c := chr(k)).isascii() and c.isalnum() else 0 for k in range(256))
#: Words of more letters are hashed one by one.
LONG_WORD = 512


def _blocks(b: pa.RecordBatch, *texts: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch by BLOCK_BYTES of the ``texts`` columns, one at least."""
    ends = np.cumsum(sum(pc.binary_length(b.column(k)).to_numpy(zero_copy_only=False).astype(np.int64) for k in texts))
    at = 0
    while at < b.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_BYTES, side="right")))
        yield b.slice(at, to - at)
        at = to


def _hashes(letters: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, eight letters at a time; those of up to eight letters have each its own."""
    eight = np.ndarray(len(letters) - 7, dtype="<u8", buffer=letters, strides=(1,))
    mask = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
    h = _mixed(_mixed((eight[start] & mask[np.minimum(size, 8)]) + np.uint64(0x9E6C63D0876A9A47)))
    at = np.flatnonzero(size > 8)
    for k in range(8, min(int(size.max(initial=0)), LONG_WORD), 8):
        at = at[size[at] > k]
        h[at] = _mixed(_mixed(h[at] ^ (eight[start[at] + k] & mask[np.minimum(size[at] - k, 8)])))
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        h[k] = xxhash.xxh3_64_intdigest(letters[start[k] : start[k] + size[k]].tobytes())
    return h.view(np.int64)


def word_sets(texts: pa.Array, hashed: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """row and code of each text's words, every word once, in order of row and code; the words, or their hashes, by code.

    A word is a run of a-z and 0-9 of the text in lower case.
    """
    texts = texts.cast(pa.large_string())
    if any(b is not None and (np.frombuffer(b, dtype=np.uint8) & 128).any() for b in texts.buffers()[2:]):
        texts = pa.array([t.lower() for t in texts.to_pylist()], pa.large_string())  # there are signs of which an ASCII letter is the lower case
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, dtype=np.int64)[texts.offset :][: len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    letters = np.frombuffer((data[int(ends[0]) : int(ends[-1])].to_pybytes() if data is not None else b"").translate(_KIND) + bytes(8), dtype=np.uint8)
    ends = ends - ends[0]
    there = letters > 0
    begins = there.copy()
    begins[1:] &= ~there[:-1]
    begins[ends[:-1]] = there[ends[:-1]]
    stops = there.copy()
    stops[:-1] &= ~there[1:] | begins[1:]
    start = np.flatnonzero(begins)
    size = np.flatnonzero(stops) - start + 1
    row = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, ends)))
    if hashed:
        words = pa.array(_hashes(letters, start, size))
    else:
        words = pa.LargeStringArray.from_buffers(len(row), pa.py_buffer(np.concatenate([[0], np.cumsum(size)])), pa.py_buffer(letters[there]))
    coded = words.dictionary_encode()
    pair = np.sort((row << 32) + coded.indices.to_numpy(zero_copy_only=False))
    pair = pair[np.diff(pair, prepend=-1) > 0]
    return pair >> 32, pair & 0xFFFFFFFF, coded.dictionary


def common_words(texts: DataFrame) -> np.ndarray:
    """Hashes of the common words, the rarest first; at most COMMON_MOST."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            h, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            return h, np.bincount(at, np.concatenate([x for _, x in held]), minlength=len(h)).astype(np.int64)

        def out(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["h", "n"])

        for batch in batches:
            for b in _blocks(batch, 0):
                _, code, words = word_sets(b.column(0), hashed=True)
                held.append((words.to_numpy(), np.bincount(code, minlength=len(words))))
                if sum(len(x) for x, _ in held) > BLOCK_HASHES:
                    held = [merged()]
                    if len(held[0][0]) * 2 > BLOCK_HASHES:
                        yield out(*held.pop())
        if held:
            yield out(*merged())

    counts = durable(texts.select("text").mapInArrow(count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")))
    least = COMMON_FROM
    while counts.where(F.col("n") > least).count() > COMMON_MOST:
        least *= 2
    often = counts.where(F.col("n") > least).select("n", "h").toPandas()
    return often.sort_values(["n", "h"])["h"].to_numpy(dtype=np.int64)


def sketches(texts: DataFrame, common: np.ndarray) -> DataFrame:
    """source_table, id, key (equal for equal word sets), n_words, planes p1 and p2, cells (hashes of the uncommon words, in one order for
    all texts), often (ranks of the common words), n_often; texts without a word drop out."""
    shared = texts.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_hash = np.argsort(shared.value)
        known = shared.value[by_hash]
        for b in (part for batch in batches for part in _blocks(batch, 2)):
            row, code, words = word_sets(b.column(2), hashed=True)
            if not len(row):
                continue
            hashes = words.to_numpy()
            by = np.argsort(hashes)  # codes in order of the hashes
            place = np.empty_like(by)
            place[by] = np.arange(len(by))
            hashes = hashes[by]
            at = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
            is_common = known[at] == hashes if len(known) else np.zeros(len(hashes), dtype=bool)
            ranks = by_hash[at] if len(known) else at
            size = np.bincount(row, minlength=b.num_rows)
            some = np.flatnonzero(size)
            size, row = size[some], (np.cumsum(size > 0) - 1)[row]
            pair = np.sort((row << 32) + place[code])
            code = pair & 0xFFFFFFFF
            h = hashes[code]
            ends = np.cumsum(size)
            raw = memoryview(h.tobytes())
            key = [xxhash.xxh3_128_digest(raw[8 * lo : 8 * hi]) for lo, hi in zip((ends - size).tolist(), ends.tolist(), strict=True)]
            counts = np.bincount(row * SEGMENTS + (h & (SEGMENTS - 1)), minlength=len(some) * SEGMENTS).reshape(len(some), SEGMENTS)
            planes = [np.packbits(counts >= k, axis=1, bitorder="little").view(np.int64).ravel() for k in (1, 2)]
            common = is_common[code]
            n_often = np.bincount(row[common], minlength=len(some))
            rank = np.sort((row[common] << 32) + ranks[code[common]]) & 0xFFFFFFFF
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(x.astype(np.int32))) for n, x in ((size - n_often, h[~common]), (n_often, rank))]
            ids = [b.column(k).take(pa.array(some)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(key, pa.binary()), pa.array(size.astype(np.int32)), *map(pa.array, planes), *lists, pa.array(n_often.astype(np.int32))], names=["source_table", "id", "key", "n_words", "p1", "p2", "cells", "often", "n_often"])

    return texts.mapInArrow(run, "source_table string, id bigint, key binary, n_words int, p1 bigint, p2 bigint, cells array<int>, often array<int>, n_often int")


def slack(least: float) -> Column:
    """What a text adds to the range in the common zone: two texts of similarity ``least`` or more that share no
    uncommon word differ in at most the sum of their slacks of common words."""
    return F.col("n_often") - F.col("n_words") * (2 * least / (1 + least)) + 1e-9


def _levels(count: dict[int, int]) -> list[int]:
    """Levels to use, of the least cost in cells, where ``count`` texts need each level or a higher one.

    A text has as many cells at its own level, and about as many at each higher one if a twentieth of the texts are
    there; a level over six times its need leaves too few words in its segments.
    """
    need = sorted(count)
    total = sum(count.values())
    best: list[tuple[float, list[int]]] = [(0.0, [])]
    for j, m in enumerate(need):
        below = [0]
        for k in need[: j + 1]:
            below.append(below[-1] + count[k])
        options = []
        for i in range(j + 1):
            own = sum(count[k] * max(1.0, m / (6 * k)) ** 2 for k in need[i : j + 1])
            options.append((best[i][0] + m * (own + below[i] * min(1.0, 20 * (below[j + 1] - below[i]) / total)), [*best[i][1], m]))
        best.append(min(options))
    return best[-1][1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _word_values(ranks: np.ndarray) -> np.ndarray:
    return _mixed(_mixed(ranks.astype(np.uint64) + np.uint64(0x165667B19E3779F9)))


def _segments(b: pa.RecordBatch, m: int, lower: bool, top: int) -> dict[str, np.ndarray] | None:
    """The cells of a batch's texts at level m: one for each segment of the blocks that are needed; of the last block, if
    it may not differ at all, for its first segment only.

    who: the text; cell; first: is it a block's first segment; key: of the cell and the block's other segment; row, rank:
    the words of that segment; less: the key without this word.  ``lower``: only texts of lower levels than m.  ``top``:
    the highest level below m.
    """
    names = b.schema.names
    room, reach = (b.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("slack", "reach"))
    cells = np.clip(np.floor(room + np.minimum(m / 2, reach)).astype(np.int64) + 1, 0, m)
    is_lower = room * 2 < top
    cells[~is_lower | (reach * 2 < top) if lower else (is_lower | (room * 2 >= m))] = 0
    use = np.nonzero(cells)[0]
    if not len(use):
        return None
    cells = cells[use]
    segments = cells + cells % 2
    often = b.column(names.index("often"))
    often = often.take(pa.array(use)) if len(use) < len(often) else often
    ranks = often.flatten().to_numpy(zero_copy_only=False).view(np.uint32)
    n_often = often.value_lengths().to_numpy(zero_copy_only=False)
    segment = ranks % np.uint32(m)
    keep = np.flatnonzero(segment < np.repeat(segments.astype(np.uint32), n_often))
    ranks, segment, owner = ranks[keep], segment[keep].astype(np.int64), np.repeat(np.arange(len(use)), n_often)[keep]
    begin = np.cumsum(segments) - segments
    value = _word_values(ranks)
    sums = np.zeros(int(segments.sum()), dtype=np.uint64)
    np.add.at(sums, begin[owner] + segment, value)
    who = np.repeat(np.arange(len(use)), cells)
    start = np.cumsum(cells) - cells
    k = np.arange(len(who)) - start[who]
    sid = b.column(names.index("sid")).to_numpy(zero_copy_only=False).view(np.uint64)[use[who]]
    cell = _mixed(_mixed(sums[begin[who] + k] ^ sid) + (k + (m << 32)).astype(np.uint64)) >> np.uint64(32)
    other = sums[begin[who] + (k ^ 1)]
    across = segment ^ 1
    meets = np.flatnonzero(across < cells[owner])  # the cell whose other segment holds the word
    row, rank, value = start[owner[meets]] + across[meets], ranks[meets], value[meets]
    return {"who": use[who], "cell": cell, "first": k % 2 == 0, "key": _key(cell, other), "row": row, "rank": rank, "less": _key(cell[row], other[row] - value)}


def _key(cell: np.ndarray, other: np.ndarray) -> np.ndarray:
    return _mixed(_mixed(other) + cell)


def _marked(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    p = key & np.uint64(MAP_BITS - 1)
    return (bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1


def _expand(lo: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) for every i and j in lo[i] .. lo[i] + n[i] - 1, at most about BLOCK_PAIRS at a time."""
    at = 0
    ends = np.cumsum(n)
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_PAIRS, side="right")))
        for part in range(0, int(n[at]) if to == at + 1 else 1, BLOCK_PAIRS):
            size = np.clip(n[at:to] - part, 0, BLOCK_PAIRS if to == at + 1 else None)
            i = np.repeat(np.arange(at, to), size)
            yield i, lo[i] + part + np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size)
        at = to


def common_candidates(s: DataFrame, least: float) -> DataFrame:
    """sid, a, b of the pairs that can be in range without sharing an uncommon word.

    Two such texts differ in at most r = floor(slack + slack) common words.  A text's level m is the first in use over twice
    its slack, hence over r for all partners of no higher level; of m / 2 blocks, one differs in a word at most.  A pair
    meets at the level of the higher of the two, for which the lower sends the cells of as many blocks as r can need; a
    bit map of what texts of this level can meet spares it the others.  Within a cell, the sums of word
    values of the block's other segment are compared with each other and with those that lack one of their words.
    """
    spark = s.sparkSession
    reach = F.col("n_words") * ((1 - least) / (1 + least) / least) + 1e-6  # the most slack that a partner can have
    s = s.select(F.xxhash64("source_table").alias("sid"), "id", "often", slack(least).cast("double").alias("slack"), reach.cast("double").alias("reach")).where("n_often > 0")
    # by whole numbers, of which there are at most some COMMON_MOST
    counts = {r["x"]: r["n"] for r in s.groupBy(F.greatest(F.floor(F.col("slack") * 2), F.lit(-LARGE)).alias("x")).agg(F.count(F.lit(1)).alias("n")).collect()}
    need: dict[int, int] = {}
    for x, k in counts.items():
        if x >= 0:
            m = int(LEVELS[np.searchsorted(LEVELS, x, side="right")])
            need[m] = need.get(m, 0) + k
    levels = _levels(need)
    if not levels:
        return spark.createDataFrame([], "sid bigint, a bigint, b bigint")
    tops = dict(zip(levels, [-2 * max(levels), *levels], strict=False))
    s = s.where(F.col("slack") > -max(levels) / 2)
    maps = {m: np.zeros(MAP_BITS // 64, dtype=np.uint64) for m in levels[1:]}

    def occupied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for m in levels[1:]:
                if (got := _segments(b, m, False, tops[m])) is not None:
                    p = np.unique(np.concatenate([got["key"], got["less"]]) & np.uint64(MAP_BITS - 1)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), m, dtype=np.int32)), pa.array(p)], names=["m", "p"])

    if maps:
        one = F.expr("shiftleft(1L, cast(p & 63 AS INT))")
        bits = s.where(F.col("slack") * 2 >= levels[0]).mapInArrow(occupied, "m int, p bigint").groupBy("m", F.shiftright("p", 6).alias("w")).agg(F.bit_or(one).alias("b")).toPandas()
        for m, g in bits.groupby("m"):
            maps[int(m)][g["w"].to_numpy(dtype=np.int64)] = g["b"].to_numpy(dtype=np.int64).view(np.uint64)

    def cells_of(b: pa.RecordBatch, bits: dict[int, np.ndarray]) -> Iterator[tuple[bool, dict[str, np.ndarray]]]:
        for m in levels:
            if (got := _segments(b, m, False, tops[m])) is not None:
                yield True, got
            if m in bits and (got := _segments(b, m, True, tops[m])) is not None:
                use = _marked(bits[m], got["key"])
                use[got["row"][_marked(bits[m], got["less"])]] = True
                if use.any():
                    word = use[got["row"]]
                    new = np.cumsum(use) - 1
                    yield False, {**{c: got[c][use] for c in ("who", "cell", "first", "key")}, "row": new[got["row"][word]], "rank": got["rank"][word], "less": got["less"][word]}

    total = sum(k for x, k in counts.items() if x >= -max(levels))
    share = F.pmod(F.xxhash64("id", "sid"), F.lit(1 << 30)) <= int((1 << 30) * min(1.0, HOT_SAMPLE / max(1, total)))
    sample = s.where(share).limit(2 * HOT_SAMPLE).toArrow()
    seen = [got["cell"] for b in sample.to_batches() for _, got in cells_of(b, maps)]
    cell, n = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64))
    # in a small collection no cell is worth spreading
    shared = spark.sparkContext.broadcast((maps, cell[n * 50 >= sample.num_rows] if total > HOT_SAMPLE else cell[:0]))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hot = shared.value
        for b in batches:
            names = b.schema.names
            often = b.column(names.index("often"))
            value = _word_values(often.flatten().to_numpy(zero_copy_only=False))
            parity = np.zeros(b.num_rows, dtype=np.uint64)
            np.bitwise_xor.at(parity, np.repeat(np.arange(b.num_rows), often.value_lengths().to_numpy(zero_copy_only=False)), np.uint64(1) << (value & np.uint64(63)))
            room = b.column(names.index("slack")).to_numpy(zero_copy_only=False).astype(np.float32)

            def rows(at, place, flags, size, words, b=b, names=names, parity=parity, room=room):
                ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32) * 4
                data = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(words.tobytes())])
                ids = [b.column(names.index(c)).take(pa.array(at)) for c in ("sid", "id")]
                place = (place << np.uint64(32)) + room[at].view(np.uint32)
                return pa.RecordBatch.from_arrays([pa.array(place.view(np.int64)), pa.array(flags.astype(np.int8)), *ids, pa.array(parity[at].view(np.int64)), data], names=_SENT)

            for own, got in cells_of(b, bits):
                is_hot = np.isin(got["cell"], hot)
                flags = OWN * own + FIRST * got["first"]
                cold = ~is_hot
                word = cold[got["row"]]
                held = np.sort((got["row"][word] << 32) + got["rank"][word])
                size = np.bincount(held >> 32, minlength=len(cold))[cold]
                yield rows(got["who"][cold], got["cell"][cold], flags[cold], size, (held & 0xFFFFFFFF).astype(np.uint32))
                if is_hot.any():  # where they meet depends on the other segment: as it is, and without each of its words
                    for row, key, extra in ((np.nonzero(is_hot)[0], got["key"][is_hot], HOT), (got["row"][~word], got["less"][~word], HOT + LACKS)):
                        yield rows(got["who"][row], key >> np.uint64(32), flags[row] + extra, np.full(len(row), 2), key)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        parts = -(-t.num_rows // BLOCK_ROWS)
        place = t["place"].to_numpy() >> 32
        for k in range(parts):
            for a, b, sid in _met(t.filter(pa.array(place % parts == k)) if parts > 1 else t):
                yield pa.RecordBatch.from_arrays([pa.array(sid), pa.array(a), pa.array(b)], names=["sid", "a", "b"])

    sent = s.mapInArrow(send, "place bigint, flags byte, sid bigint, id bigint, parity bigint, words binary")
    return sent.repartition(F.shiftright("place", 32)).mapInArrow(meet, "sid bigint, a bigint, b bigint")


#: place: the cell, then 32 bits of the slack; words: ranks of the other segment's words, for a hot cell the key in their stead.
_SENT = ["place", "flags", "sid", "id", "parity", "words"]
OWN, FIRST, HOT, LACKS = 1, 2, 4, 8


def _met(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows of a cell whose other segments are equal, or equal but for one word that one of them lacks."""
    col = {n: t[n].combine_chunks() for n in _SENT}
    sid, ids, flags = (col[n].to_numpy(zero_copy_only=False) for n in ("sid", "id", "flags"))
    place, parity = (col[n].to_numpy(zero_copy_only=False).view(np.uint64) for n in ("place", "parity"))
    room = place.astype(np.uint32).view(np.float32)
    lacks, first, own, hot = (flags & f > 0 for f in (LACKS, FIRST, OWN, HOT))
    _, ends, data = col["words"].buffers()
    ends = np.frombuffer(ends, dtype=np.int32)[col["words"].offset :][: len(ids) + 1].astype(np.int64) // 4
    ranks = np.frombuffer(data, dtype=np.uint32)[ends[0] : ends[-1]] if data is not None else np.empty(0, dtype=np.uint32)
    keys = ends[:-1][hot] - ends[0]
    keys = ranks[keys].astype(np.uint64) + (ranks[keys + 1].astype(np.uint64) << np.uint64(32))
    row = np.repeat(np.arange(len(ids)), np.diff(ends))
    if len(keys):
        cold = ~hot[row]
        row, ranks = row[cold], ranks[cold]
    value = _word_values(ranks)
    other = np.zeros(len(ids), dtype=np.uint64)
    np.add.at(other, row, value)
    cell = place >> np.uint64(32)
    key = _key(cell, other)
    key[hot] = keys
    whole = np.nonzero(~lacks)[0]
    whole = whole[np.argsort(key[whole], kind="stable")]
    there = key[whole]
    bounds = np.flatnonzero(np.diff(there)) + 1
    bounds = np.concatenate([[0], bounds, [len(there)]])
    end = np.repeat(bounds[1:], np.diff(bounds))  # of the rows with the same key
    sent = np.nonzero(lacks)[0]
    less_row = np.concatenate([row, sent])
    less = np.concatenate([_key(cell[row], other[row] - value), key[sent]])
    # most keys that lack a word are nobody's: a table of some bits of the keys tells, before they are looked up in order
    bits = np.uint64((1 << (8 * len(there)).bit_length()) - 1)
    some = np.zeros(int(bits) + 1, dtype=bool)
    some[there & bits] = True
    may = np.flatnonzero(some[less & bits])
    may = may[np.argsort(less[may])]
    less_row, less = less_row[may], less[may]
    lo = np.searchsorted(there, less)
    hit = np.flatnonzero(there[np.minimum(lo, max(0, len(there) - 1))] == less) if len(there) else lo[:0]
    less_row, lo = less_row[hit], lo[hit]
    equal = np.nonzero(first[whole])[0]  # equal blocks meet in the cell of their first segment only
    tasks = [(whole[equal], equal + 1, end[equal] - equal - 1), (less_row, lo, end[lo] - lo)]
    for left, lo, n in tasks:
        keep = n > 0
        left, lo, n = left[keep], lo[keep], n[keep]
        for i, j in _expand(lo, n):
            x, y = left[i], whole[j]
            ok = np.flatnonzero(np.bitwise_count(parity[x] ^ parity[y]) <= room[x] + room[y] + 1e-3)
            x, y = x[ok], y[ok]
            ok = (own[x] | own[y]) & (ids[x] != ids[y]) & (sid[x] == sid[y])
            x, y = x[ok], y[ok]
            if len(x):
                yield np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y]), sid[x]


def class_links(texts: DataFrame, least: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """Classes of equal word sets and the links between them.

    ``texts``: source_table, id, text.  Returns (members: source_table, id, rep) of the classes of more than one
    row, and (links: source_table, a, b, similarity) between representatives (smallest id) with similarity >= ``least``.
    """
    texts = texts.select("source_table", "id", "text").where("id IS NOT NULL AND text IS NOT NULL")
    s = durable(sketches(texts, common_words(texts)))
    sizes = durable(s.groupBy("source_table", "key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("rep")).where("n > 1"))
    if sizes.count() <= BROADCAST_IDS:
        same = s.select("source_table", "key", "id").join(F.broadcast(sizes), ["source_table", "key"])
    else:
        k = F.concat("source_table", F.hex("key")).alias("k")
        same = salted_join(s.select(k, "source_table", "id"), sizes.select(k, "rep"), "k", "id", "inner")
    members = durable(same.select("source_table", "id", "rep"))
    # one row stands for the copies of a class; a repeated id meets itself only, which x.id < y.id rules out
    reps = _without(s.drop("key"), members.where("id <> rep").select("source_table", "id").distinct())
    cand = durable(uncommon_candidates(reps, least).unionByName(common_candidates(reps, least)).distinct())
    return members, durable(_verified(texts, cand, least))


def first_cells(s: DataFrame, least: float) -> DataFrame:
    """cell (its hash, then 32 bits of n_words), sid, id, p1 and p2, for each cell in which a text may first meet another one."""
    n = F.col("n_words")
    most = (n - F.ceil(n * least - 1e-9) + 1).cast("int")
    sid = F.xxhash64("source_table")
    cell = F.shiftleft(F.hash("sid", "c").cast("bigint"), 32) + F.col("n_words")
    return s.select(sid.alias("sid"), "id", "n_words", "p1", "p2", F.explode(F.slice("cells", F.lit(1), most)).alias("c")).select(cell.alias("cell"), "sid", "id", "p1", "p2")


def uncommon_candidates(s: DataFrame, least: float) -> DataFrame:
    """sid, a, b of the pairs that share an uncommon word and are in range by their coarse embeddings."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        parts = -(-t.num_rows // BLOCK_ROWS)
        cell = t["cell"].to_numpy() >> 32
        for k in range(parts):
            for sid, a, b in _near(t.filter(pa.array(cell % parts == k)) if parts > 1 else t, least):
                yield pa.RecordBatch.from_arrays([pa.array(sid), pa.array(a), pa.array(b)], names=["sid", "a", "b"])

    return first_cells(s, least).repartition(F.shiftright("cell", 32)).mapInArrow(meet, "sid bigint, a bigint, b bigint")


def _near(t: pa.Table, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows of a cell that are in range by their sizes and planes."""
    key = t["cell"].to_numpy()
    order = np.argsort(key)
    key = key[order]
    n = key & 0xFFFFFFFF
    place = key - n
    sid, ids, p1, p2 = (t[c].to_numpy()[order] for c in ("sid", "id", "p1", "p2"))
    p1, p2 = p1.view(np.uint64), p2.view(np.uint64)
    # in a cell by size: each row meets those behind it up to the largest size in range
    largest = np.searchsorted(key, place + np.floor(n / least + 1e-6).astype(np.int64), side="right")
    lo = np.arange(1, len(key) + 1)
    for i, j in _expand(lo, largest - lo):
        apart = np.bitwise_count(p1[i] ^ p1[j]) + np.bitwise_count(p2[i] ^ p2[j])
        ok = np.flatnonzero(apart <= (n[i] + n[j]) * ((1 - least) / (1 + least)) + 1e-9)
        i, j = i[ok], j[ok]
        ok = (sid[i] == sid[j]) & (ids[i] != ids[j])
        i, j = i[ok], j[ok]
        if len(i):
            yield sid[i], np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])


def _verified(texts: DataFrame, cand: DataFrame, least: float) -> DataFrame:
    """source_table, a, b, similarity of the candidates whose words have a similarity of ``least`` or more."""
    ids = durable(cand.select("sid", F.explode(F.array("a", "b")).alias("id")).distinct())
    few = ids.count() <= BROADCAST_IDS
    own = durable(texts.withColumn("sid", F.xxhash64("source_table")).join(F.broadcast(ids) if few else ids, ["sid", "id"], "left_semi").select("sid", "id", "source_table", "text"))
    # all columns are kept on both sides, so that one exchange serves both
    x, y = (own.select(*[F.col(c).alias(f"{c}_{k}") for c in own.columns]) for k in "ab")
    pairs = cand.join(x, (F.col("sid") == F.col("sid_a")) & (F.col("a") == F.col("id_a"))).join(y, (F.col("sid") == F.col("sid_b")) & (F.col("b") == F.col("id_b")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in _blocks(batch, 3, 4)):
            row, code, words = word_sets(pa.concat_arrays([b.column(3), b.column(4)]))
            size = np.bincount(row, minlength=2 * b.num_rows)
            pair = np.sort((row % b.num_rows << 32) + code)
            both = np.bincount(pair[1:][np.diff(pair) == 0] >> 32, minlength=b.num_rows)
            similarity = both / np.maximum(1, size[: b.num_rows] + size[b.num_rows :] - both)
            ok = similarity >= least - 1e-12
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in (0, 1, 2)), pa.array(similarity)], names=["source_table", "a", "b", "similarity"]).filter(pa.array(ok))

    out = pairs.select(F.col("source_table_a").alias("source_table"), "a", "b", "text_a", "text_b", "sid_b", "id_b", "source_table_b")
    return out.mapInArrow(run, "source_table string, a bigint, b bigint, similarity double").distinct()


def _without(s: DataFrame, gone: DataFrame) -> DataFrame:
    gone = durable(gone)
    return s.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, ["source_table", "id"], "left_anti")


def similar_pairs(texts: DataFrame, least: float = 0.6) -> DataFrame:
    """Every pair of rows of one table (id_a < id_b) whose word sets have a similarity of at least ``least``.

    Rows without a word (null, blank or wordless texts) are in no pair; rows with one word set form pairs among
    themselves; an empty table gives none.  Complete, whatever words a pair shares (see ``common_candidates``).
    """
    members, links = class_links(texts, least)
    m = members.select("source_table", F.col("rep").alias("r"), F.col("id").alias("m"))
    x = links.select("source_table", F.col("a").alias("r"), "b").join(m, ["source_table", "r"], "left").select("source_table", F.coalesce("m", "r").alias("x"), F.col("b").alias("r"))
    x = x.join(m, ["source_table", "r"], "left").select("source_table", "x", F.coalesce("m", "r").alias("y"))
    across = x.select("source_table", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    k = F.concat_ws("\x1f", "source_table", "r").alias("k")
    within = salted_join(m.select("source_table", k, "m"), m.select(k, F.col("m").alias("m2")), "k", "m", "inner").where("m < m2").select("source_table", F.col("m").alias("id_a"), F.col("m2").alias("id_b"))
    return across.unionByName(within)


def similar_groups(texts: DataFrame, least: float = 0.6) -> DataFrame:
    """source_table, id, class_id, n_links, group_id for every row that is like another.

    class_id: smallest id with the same words; n_links: other classes within reach of the class; group_id: smallest
    class reachable over links.
    """
    members, links = class_links(texts, least)
    node = lambda c: F.concat_ws("\x1f", "source_table", F.lpad(F.col(c).cast("string"), 20, "0"))
    comp = components(links.select(node("a").alias("a"), node("b").alias("b")))
    comp = comp.select(F.substring_index("node", "\x1f", 1).alias("source_table"), F.substring_index("node", "\x1f", -1).cast("bigint").alias("class_id"), F.substring_index("component", "\x1f", -1).cast("bigint").alias("group_id"))
    degree = links.select("source_table", F.explode(F.array("a", "b")).alias("class_id")).groupBy("source_table", "class_id").agg(F.count(F.lit(1)).alias("n_links"))
    heads = links.select("source_table", F.explode(F.array("a", "b")).alias("id")).distinct().select("source_table", "id", F.col("id").alias("rep"))
    rows = members.unionByName(heads).distinct().withColumnRenamed("rep", "class_id")
    out = rows.join(degree, ["source_table", "class_id"], "left").join(comp, ["source_table", "class_id"], "left")
    return out.select("source_table", "id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("group_id", "class_id").alias("group_id"))


def domain_texts(spark, d: str) -> DataFrame:
    def of(name: str, i: str, t: str) -> DataFrame:
        return table(spark, d, name).select(F.lit(name).alias("source_table"), F.col(i).alias("id"), F.col(t).alias("text"))

    return of("table_questions", "question_id", "question_text").unionByName(of("variable_questions", "question_id", "question_text")).unionByName(of("cards", "rowid", "text"))


def p2_found(spark, d: str) -> DataFrame:
    return similar_pairs(domain_texts(spark, d), 0.6)


def p2_groups(spark, d: str) -> DataFrame:
    return similar_groups(domain_texts(spark, d), 0.6)


QUERIES = {"p2_found": p2_found, "p2_groups": p2_groups}
#: Every pair of similarity 0.6 shares one of the rarest ``n - ceil(0.6 n) + 1`` words of either text.
SQL = {
    "p2_found": """
WITH t AS (
  SELECT 'table_questions' AS source_table, question_id AS id, question_text AS x FROM table_questions
  UNION ALL SELECT 'variable_questions', question_id, question_text FROM variable_questions
  UNION ALL SELECT 'cards', rowid, text FROM cards
), w AS (SELECT source_table, id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(x), '[^a-z0-9]+'), lambda v: v <> ''))) AS w FROM t),
d AS (SELECT source_table, w, count(*) AS df FROM w GROUP BY ALL),
r AS (SELECT source_table, id, w, row_number() OVER (PARTITION BY source_table, id ORDER BY df, w) AS k, count(*) OVER (PARTITION BY source_table, id) AS n FROM w JOIN d USING (source_table, w)),
p AS (SELECT * FROM r WHERE k <= n - (6 * n + 9) // 10 + 1),
c AS (SELECT DISTINCT a.source_table, a.id AS id_a, b.id AS id_b FROM p a JOIN p b ON a.source_table = b.source_table AND a.w = b.w AND a.id < b.id AND 10 * a.n >= 6 * b.n AND 10 * b.n >= 6 * a.n),
l AS (SELECT source_table, id, list(w) AS ws, count(*) AS n FROM w GROUP BY ALL)
SELECT c.source_table, c.id_a, c.id_b FROM c JOIN l a ON a.source_table = c.source_table AND a.id = c.id_a JOIN l b ON b.source_table = c.source_table AND b.id = c.id_b
WHERE 5 * len(list_intersect(a.ws, b.ws)) >= 3 * (a.n + b.n - len(list_intersect(a.ws, b.ws)))
""",
}
