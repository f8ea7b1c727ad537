"""Evaluation texts leaking into training text.

Texts are canonicalised into templates: numbers and units become typed placeholders, and only ASCII letters and digits
are kept, as breaks, spaces and punctuation can fall anywhere.  Windows of the items' templates are hashed and joined
with the windows of the documents' templates; windows on one diagonal (same document, item and offset) are counted,
and where there are as many as a leaked passage must leave, the slots are compared: a passage whose slots are the
item's own is a leak, verified letter by letter in every alignment that a window of the diagonal gives.  A second template, over words, also types names; it finds questions
that were re-parameterised, whose slots were all exchanged consistently.

Items of up to ``ITEM_BYTES`` of text are indexed in each worker, once, and joined with the documents where these are.  More
items are joined by shuffle: the windows of both sides are hashed, those of the documents that a Bloom filter of the items'
windows rules out stay where they are, the others meet by hash, and the pairs that met are verified with their texts.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import durable, salted_join, table

WORDS = 13
GRAM = 24  # template characters in a hashed window
STRIDE = 4  # every so many an item's windows are indexed; a document's are all looked up
ITEM_BYTES = 64 << 20
#: Bits of the filter of the items' windows.
FILTER_BITS = 1 << 27
UNITS = (b"percentage", b"percent", b"dollars", b"miles", b"minutes", b"points")
_OTHER = bytes(c for c in range(256) if not (48 <= c <= 57 or 97 <= c <= 122))
_DIGITS = re.compile(rb"[0-9]+")
_SLOT = re.compile(rb"[0-9]+|" + rb"|".join(UNITS))
_MULT = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
SEP = b"|"


def stream(text: str) -> bytes:
    """The ASCII letters (lower case) and digits of a text."""
    return text.encode("ascii", "ignore").lower().translate(None, _OTHER)


def template(raw: bytes) -> bytes:
    """A stream with numbers (0) and units (1) as placeholders."""
    out = _DIGITS.sub(b"0", raw)
    for u in UNITS:
        out = out.replace(u, b"1")
    return out


def template_map(raw: bytes) -> tuple[bytes, np.ndarray]:
    """The template, and for each of its characters the place in the stream (for a placeholder, where it ends, less one)."""
    out, at, last = [], [], 0
    for m in _SLOT.finditer(raw):
        out.append(raw[last : m.start()] + (b"0" if m.group()[0] < 58 else b"1"))
        at += [*range(last, m.start()), m.end() - 1]
        last = m.end()
    out.append(raw[last:])
    return b"".join(out), np.array([*at, *range(last, len(raw))], dtype=np.int64)


def gram_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each window of GRAM bytes."""
    if len(data) < GRAM:
        return np.empty(0, dtype=np.uint64)
    a = np.frombuffer(data, dtype=np.uint8).astype(np.uint64)
    for s in (1, 2, 4):
        a = (a[:-s] << np.uint64(8 * s)) | a[s:]
    n = len(data) - GRAM + 1
    h = np.zeros(n, dtype=np.uint64)
    for k, m in enumerate(_MULT):
        h += a[8 * k : 8 * k + n] * m
        h ^= h >> np.uint64(29)
    return h * _MULT[0]


class Items:
    """A block of items with the hashed windows of their templates."""

    def __init__(self, ids: list[int], texts: list[str], words: int = WORDS):
        self.words = words
        self.ids, self.raw, self.at, self.starts, self.ends, self.need = [], [], [], [], [], []
        self.short: list[tuple[bytes, int]] = []
        self._automaton = None
        hashes, owner, place = [], [], []
        for i, t in zip(ids, texts, strict=True):
            parts = [p for p in (stream(w) for w in (t or "").split()) if p]
            if len(parts) < words:
                continue
            raw = b"".join(parts)
            ends = np.cumsum([len(p) for p in parts])
            starts = ends - [len(p) for p in parts]
            temp, at = template_map(raw)
            k = len(self.ids)
            need = []
            for a in range(len(parts) - words + 1):
                lo, hi = np.searchsorted(at, starts[a]), np.searchsorted(at, ends[a + words - 1] - 1, side="right")
                inside = (int(hi) - GRAM) // STRIDE - (int(lo) + STRIDE - 1) // STRIDE + 1
                if inside < 3:
                    self.short.append((raw[starts[a] : ends[a + words - 1]], k))
                else:
                    need.append(inside - 2)  # a unit or number may run on past either end of the passage
            self.ids.append(i)
            self.raw.append(raw)
            self.at.append(at)
            self.starts.append(starts)
            self.ends.append(ends)
            self.need.append(min(need, default=1))
            g = gram_hashes(temp)[::STRIDE]
            hashes.append(g)
            owner.append(np.full(len(g), k))
            place.append(np.arange(len(g)) * STRIDE)
        h = np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint64)
        order = np.argsort(h, kind="stable")
        self.h = h[order]
        self.owner = np.concatenate(owner)[order] if hashes else np.empty(0, dtype=np.int64)
        self.place = np.concatenate(place)[order] if hashes else np.empty(0, dtype=np.int64)
        self.mask = np.zeros(1 << 22, dtype=bool)
        self.mask[(self.h >> np.uint64(42)).astype(np.int64)] = True
        self.need = np.array(self.need, dtype=np.int64)
        self.at_all = np.concatenate(self.at) if self.at else np.empty(0, dtype=np.int64)
        self.at_from = np.cumsum([0, *(len(x) for x in self.at)])

    def verified(self, k: int, raw: bytes, place_doc: int, place_item: int) -> bool:
        """Does the document's stream, laid on the item's with these two places on each other, agree over enough whole words?"""
        item = self.raw[k]
        lo = max(-place_item, -place_doc)
        hi = min(len(item) - place_item, len(raw) - place_doc)
        a = np.frombuffer(item, dtype=np.uint8)[place_item + lo : place_item + hi]
        b = np.frombuffer(raw, dtype=np.uint8)[place_doc + lo : place_doc + hi]
        breaks = np.concatenate([[-1], np.nonzero(a != b)[0], [len(a)]]) + place_item + lo
        first = np.searchsorted(self.starts[k], breaks[:-1] + 1)
        last = np.searchsorted(self.ends[k], breaks[1:], side="right")
        return bool((last - first >= self.words).any())

    def find(self, raws: list[bytes]) -> list[tuple[int, int]]:
        """(row, item) of every stream that contains a passage of the item."""
        joined = SEP.join(raws)
        temp = template(joined)
        h = gram_hashes(temp)
        at = np.nonzero(self.mask[(h >> np.uint64(42)).astype(np.int64)])[0]
        lo, hi = np.searchsorted(self.h, h[at]), np.searchsorted(self.h, h[at], side="right")
        at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        found: set[tuple[int, int]] = set()
        if len(at):
            post = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pos = np.repeat(at, n)
            begins = np.concatenate([[0], np.nonzero(np.frombuffer(temp, dtype=np.uint8) == SEP[0])[0] + 1])
            item, diagonal = self.owner[post], pos - self.place[post]
            order = np.lexsort((diagonal, item))
            item, diagonal, pos, post = item[order], diagonal[order], pos[order], post[order]
            edge = np.nonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1])]))[0]
            count = np.diff(np.concatenate([edge, [len(item)]]))
            # every window of a diagonal with enough of them: numbers of another length shift what lies behind them
            use = np.nonzero(np.repeat(count >= self.need[item[edge]], count))[0]
            if len(use):
                doc = np.searchsorted(begins, pos[use], side="right") - 1
                by_doc = np.argsort(doc, kind="stable")
                use, doc = use[by_doc], doc[by_doc]
                cuts = np.nonzero(np.diff(doc, prepend=-1))[0]
                for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(doc)], strict=True):
                    r, w = int(doc[lo]), use[lo:hi]
                    t, place = template_map(raws[r])
                    # the first letter after the window's start is free of slots and ties the two streams together
                    local, step = pos[w] - begins[r], np.zeros(len(w), dtype=np.int64)
                    letters = np.nonzero(np.frombuffer(t, dtype=np.uint8) > 57)[0]
                    if len(letters):
                        ahead = letters[np.minimum(np.searchsorted(letters, local), len(letters) - 1)] - local
                        step = np.where((ahead >= 0) & (ahead < GRAM), ahead, 0)
                    own = self.place[post[w]] + step
                    on_doc, who = place[local + step], item[w]
                    on_item = self.at_all[self.at_from[who] + own]
                    _, one = np.unique(np.stack([who, on_doc - on_item]), axis=1, return_index=True)
                    for g in one.tolist():
                        k = int(who[g])
                        if (r, k) not in found and self.verified(k, raws[r], int(on_doc[g]), int(on_item[g])):
                            found.add((r, k))
        if self.short:
            automaton = self.automaton()
            for r, raw in enumerate(raws):
                for _, owners in automaton.iter(raw.decode("ascii")):
                    found.update((r, k) for k in owners)
        return sorted(found)

    def automaton(self):
        """Finds all short passages in one pass over a text."""
        if self._automaton is None:
            import ahocorasick

            owners: dict[str, set[int]] = {}
            for passage, k in self.short:
                owners.setdefault(passage.decode("ascii"), set()).add(k)
            self._automaton = ahocorasick.Automaton()
            for passage, who in owners.items():
                self._automaton.add_word(passage, tuple(who))
            self._automaton.make_automaton()
        return self._automaton


_KEPT: dict[str, object] = {}


def kept(token: str, make: Callable[[], object]) -> object:
    """What ``make`` gives, made once in a worker for the token; the last one is kept."""
    if token not in _KEPT:
        _KEPT.clear()
        _KEPT[token] = make()
    return _KEPT[token]


def _blocks_of(items: DataFrame) -> int:
    """In how many blocks of about ITEM_BYTES the items can be held."""
    return max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // max(1, ITEM_BYTES)))


def leaked_items(docs: DataFrame, items: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, item_id of every document that contains at least ``words`` consecutive words of the item.

    ``docs``: doc_id, text; ``items``: item_id, text.  Words are split at white space; those without an ASCII letter
    or digit do not count.  Items of fewer words leak never; null and empty texts contain nothing; a pair comes
    once, however often the row or the passage is repeated.
    """
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text <> ''")
    if _blocks_of(items) > 1:
        return _joined_by_shuffle(docs, items, words)
    rows = items.collect()  # of ITEM_BYTES at most
    shared, token = docs.sparkSession.sparkContext.broadcast(([r["item_id"] for r in rows], [r["text"] for r in rows])), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = kept(token, lambda: Items(*shared.value, words=words))
        for batch in batches:
            ids = batch.column(0).to_pylist()
            raws = [stream(t) for t in batch.column(1).to_pylist()]
            lo = 0
            while lo < len(raws):
                hi, size = lo, 0
                while hi < len(raws) and (hi == lo or size + len(raws[hi]) < 4_000_000):
                    size += len(raws[hi])
                    hi += 1
                hits = index.find(raws[lo:hi])
                yield pa.RecordBatch.from_arrays([pa.array([ids[lo + r] for r, _ in hits], pa.int64()), pa.array([index.ids[k] for _, k in hits], pa.int64())], names=["doc_id", "item_id"])
                lo = hi

    return docs.mapInArrow(run, "doc_id bigint, item_id bigint").distinct()


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def length_hashes(data: bytes, length: int) -> np.ndarray:
    """A 64-bit hash of each window of ``length`` bytes, of any length (sums of powers, brought to a common start)."""
    n = len(data) - length + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(data) - 1, _BASE)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((np.frombuffer(data, dtype=np.uint8).astype(np.uint64) + np.uint64(1)) * power)])
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _BACK)]))
    h = (sums[length:] - sums[:n]) * back
    h ^= h >> np.uint64(31)
    return h * _MULT[1] + np.uint64(length)


def _joined_by_shuffle(docs: DataFrame, items: DataFrame, words: int) -> DataFrame:
    """As ``leaked_items``; a short passage, which no window need lie in, is hashed whole, as are all windows of its length."""
    spark = docs.sparkSession

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index = Items(b.column(0).to_pylist(), b.column(1).to_pylist(), words=words)
            h, who, n = [index.h], [index.owner], [np.zeros(len(index.h), dtype=np.int32)]
            for passage, k in index.short:
                h.append(length_hashes(passage, len(passage)))
                who.append(np.array([k]))
                n.append(np.array([len(passage)], dtype=np.int32))
            ids = np.array(index.ids, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64)), pa.array(ids[np.concatenate(who)] if len(ids) else np.empty(0, dtype=np.int64)), pa.array(np.concatenate(n))], names=["h", "item_id", "length"])

    windows = durable(items.mapInArrow(of_items, "h bigint, item_id bigint, length int").distinct())
    lengths = [r["length"] for r in windows.where("length > 0").select("length").distinct().collect()]  # of passages under a few windows long
    at = F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1))
    bits = windows.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 AS INT))")).alias("b")).toPandas()
    filled = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    filled[bits["w"].to_numpy(dtype=np.int64)] = bits["b"].to_numpy(dtype=np.int64).view(np.uint64)
    shared = spark.sparkContext.broadcast(filled)

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = stream(t)
                h = np.unique(np.concatenate([gram_hashes(template(raw)), *[length_hashes(raw, n) for n in lengths]]))
                p = h & np.uint64(FILTER_BITS - 1)
                h = h[(known[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1]
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), i))], names=["h", "doc_id"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, index = None, None
        for b in batches:
            hits: list[tuple[int, int]] = []
            for i, own, d, t in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if i != item:
                    item, index = i, Items([i], [own], words=words)
                if index.find([stream(t)]):
                    hits.append((d, i))
            yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in hits], pa.int64()) for k in (0, 1)], names=["doc_id", "item_id"])

    met = durable(salted_join(docs.mapInArrow(of_docs, "h bigint, doc_id bigint"), windows.select("h", "item_id"), "h", "doc_id", "inner").select("doc_id", "item_id").distinct())
    pairs = met.join(items.withColumnRenamed("text", "item_text"), "item_id").join(docs, "doc_id").select("item_id", "item_text", "doc_id", "text")
    return pairs.sortWithinPartitions("item_id").mapInArrow(verify, "doc_id bigint, item_id bigint").distinct()


# Re-parameterised questions: templates over words, with names typed as well.

_TOKEN = re.compile(r"[A-Za-z]+(?:'[a-z]+)?|[0-9][0-9,]*(?:\.[0-9]+)?")
_UNIT_WORDS = frozenset(u.decode() for u in UNITS)


def typed_words(text: str) -> tuple[list[str], list[str]]:
    """Template tokens and their slot values ('' for plain words); neighbouring names are one slot."""
    kinds, values = [], []
    for m in _TOKEN.finditer(text.replace("’", "'")):
        w = m.group()
        low = w.lower()
        if w[0].isdigit():
            k, v = "<n>", w.replace(",", "")
        elif low in _UNIT_WORDS:
            k, v = "<u>", low
        elif w[0].isupper():
            k, v = "<p>", low
            if kinds and kinds[-1] == "<p>":
                values[-1] += " " + low
                continue
        else:
            k, v = low, ""
        kinds.append(k)
        values.append(v)
    return kinds, values


def consistent(a: list[str], b: list[str]) -> bool:
    """Are the slots of ``b`` those of ``a`` exchanged one for one, at least one of them for another?"""
    there: dict[str, str] = {}
    back: dict[str, str] = {}
    return all(there.setdefault(x, y) == y and back.setdefault(y, x) == x for x, y in zip(a, b, strict=True) if x or y) and any(x != y for x, y in zip(a, b, strict=True))


def reparameterised_items(docs: DataFrame, items: DataFrame, words: int = WORDS, plain: int = 6) -> DataFrame:
    """doc_id, item_id, windows: how many template windows of ``words`` tokens (at least ``plain`` of them plain words) the
    document shares with the item under a consistent exchange of slots.  Literal passages are not counted."""
    items = items.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text <> ''")
    blocks = _blocks_of(items)
    out = []
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        shared = docs.sparkSession.sparkContext.broadcast([(int(r["item_id"]), r["text"]) for r in rows])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index: dict[tuple[str, ...], dict[tuple[str, ...], set[int]]] = {}
            starts: set[tuple[str, str]] = set()
            for i, t in shared.value:
                kinds, values = typed_words(t)
                for a in range(len(kinds) - words + 1):
                    w = tuple(kinds[a : a + words])
                    if sum(not v for v in values[a : a + words]) >= plain:
                        index.setdefault(w, {}).setdefault(tuple(values[a : a + words]), set()).add(i)
                        starts.add(w[:2])
            for batch in batches:
                hits: dict[tuple[int, int], int] = {}
                for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    kinds, values = typed_words(t)
                    for a in range(len(kinds) - words + 1):
                        if (kinds[a], kinds[a + 1]) not in starts:
                            continue
                        for slots, who in index.get(tuple(kinds[a : a + words]), {}).items():
                            if consistent(list(slots), values[a : a + words]):
                                for i in who:
                                    hits[d, i] = hits.get((d, i), 0) + 1
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in hits], pa.int64()), pa.array([k[1] for k in hits], pa.int64()), pa.array(list(hits.values()), pa.int64())], names=["doc_id", "item_id", "windows"])

        out.append(docs.mapInArrow(run, "doc_id bigint, item_id bigint, windows bigint"))
    return reduce(DataFrame.unionByName, out).groupBy("doc_id", "item_id").agg(F.sum("windows").alias("windows"))


def p8_found(spark, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_reparameterised(spark, d: str) -> DataFrame:
    """Per document: how many items it repeats with other names and numbers, and in how many windows.  Literal leaks are in p8_found."""
    r = reparameterised_items(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return r.groupBy("doc_id").agg(F.count(F.lit(1)).alias("items"), F.max("windows").alias("most_windows"), F.min("item_id").alias("first_item"))


QUERIES = {"p8_found": p8_found, "p8_reparameterised": p8_reparameterised}
SQL = {}
