"""Garbled text from wrong character encoding.

Each passage (a sentence or line) has a latent encoding chain: clean, or UTF-8 read as one of several code pages (once
or repeatedly), or one single-byte page read as another.  Expectation-maximisation over all records learns how often
each character stands between its neighbours in clean text, and how often each chain occurs in each pool of sources,
so that weak evidence in one record is judged by what its source does elsewhere.  A record is repaired passage by
passage by the chain with the greatest posterior.

What the driver holds is bounded: counts over a fixed alphabet (the characters of the code pages) between at most 62
neighbour symbols, and POOLS x chains shares.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import durable, table

PAGES = ("cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "mac_roman", "cp437", "cp850", "iso8859_2")
ORIGINS = ("cp1252", "mac_roman", "cp437", "cp850")
#: Further pages that UTF-8 may have been read as: single bytes and, the last three, characters of two bytes.
MORE_PAGES = ("koi8_r", "cp866", "gbk", "big5", "shift_jis")
#: Pages of which UTF-8 may have been read as one and then, written as UTF-8 again, as another.
TWICE = ("cp1252", "mac_roman", "cp437", "cp850")
CHAINS = tuple(
    [("utf8", p) for p in PAGES]
    + [(o, p) for o in ORIGINS for p in PAGES if p != o]
    + [("utf8", p) for p in MORE_PAGES]
    + [("utf8", f"{a}>utf8>{b}") for a in TWICE for b in TWICE if a != b]
)
NAMES = tuple(f"{o}>{p}" for o, p in CHAINS)
#: Sources and fields are pooled by hash; two that share a pool share their prior.
POOLS = 65_536
#: The estimation ends when less than SETTLED of the passages' weight changes its chain, after MOST_ROUNDS at the latest.
SETTLED, MOST_ROUNDS = 5e-3, 12
KEPT = -4.0  # log cost of a word that a single-byte chain can't have produced and leaves alone
NEARLY = -0.5
BACKED, RARE, NEVER = 2e-3, 1e-4, 1e-5
_SPACE = re.compile(r"[ \t\n\r\f\v]+")
_PASSAGE = re.compile(r"\n+|(?<=[.!?;]) +")
_NON_ASCII = re.compile(r"[^\x00-\x7f]")
_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf4][\x80-\xbf]{3}")


def _page_bytes(page: str) -> dict[str, int]:
    """The byte of each character of a page; bytes that the page leaves open stand for the control of that number."""
    out = {chr(b): b for b in range(0x80, 0xA0)} if page.startswith("cp125") else {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(page)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


BYTES = {p: _page_bytes(p) for p in (*PAGES, *MORE_PAGES[:2])}
CHARS = {p: {b: c for c, b in BYTES[p].items() if not (0x80 <= ord(c) < 0xA0 and p != "iso8859_2")} for p in PAGES}
ALPHABET = frozenset(c for p in BYTES for c in BYTES[p]) | {"�"}
#: What begins a character of several bytes of UTF-8 read as a page; a word without it was not.
_BEGINS = {p: re.compile("[" + re.escape("".join(c for c, b in t.items() if 0xC2 <= b <= 0xF4)) + "][" + re.escape("".join(c for c, b in t.items() if 0x80 <= b <= 0xBF)) + "]") for p, t in BYTES.items()}
_TURNED = {(o, p): {ord(c): CHARS[o][b] for c, b in BYTES[p].items() if b in CHARS[o]} for o in ORIGINS for p in PAGES if o != p}
_LOST_SPACE = re.compile(r"[a-z](.)$")


def _utf8_once(word: str, page: str) -> str:
    """Undo one reading of UTF-8 as ``page`` wherever the bytes form a character."""
    table_ = BYTES[page]
    out, run = [], bytearray()
    held: list[str] = []

    def close() -> None:
        data, at = bytes(run), 0
        for m in _UTF8.finditer(data):
            try:
                c = m.group().decode("utf-8")
            except UnicodeDecodeError:
                continue
            if ord(c) < 0xA0 and ord(c) != 0x85 and not table_.get(c):
                continue
            out.extend(held[at : m.start()])
            out.append(c)
            at = m.end()
        out.extend(held[at:])
        run.clear()
        held.clear()

    for c in word:
        b = table_.get(c)
        if b is None:
            close()
            out.append(c)
        else:
            run.append(b)
            held.append(c)
    close()
    return "".join(out)


def _utf8_undone(word: str, page: str) -> str:
    """The word before UTF-8 was read as the page, once or up to three times; the word itself if it was not."""
    if page not in BYTES:  # a page of two bytes: all of the word or nothing
        try:
            data = word.encode(page)
            now = data.decode("utf-8")
        except UnicodeError:
            return word
        return now if len(data) == len(word) + len(_NON_ASCII.findall(word)) and not now.isascii() else word
    now = word
    for _ in range(3):
        if not _BEGINS[page].search(now):
            break
        nxt = _utf8_once(now, page)
        if nxt == now:
            break
        now = nxt
    # a letter whose second byte was a no-break space has lost it to what parts words
    last = _LOST_SPACE.search(now)
    lead = BYTES[page].get(last[1]) if last else BYTES[page].get(now) if now == "Ã" and page == "cp1252" else None
    return now[:-1] + chr((lead & 0x1F) << 6 | 0x20) if lead in (0xC3, 0xC5) and now[-1] in "Ã\u221a├Å" else now


def undo(word: str, chain: tuple[str, str]) -> str | None:
    """The word before it went through the chain; None if the chain can't have produced it."""
    origin, page = chain
    if origin == "utf8":
        if ">" in page:
            first, last = page.split(">utf8>")
            between = _utf8_undone(word, last)
            now = _utf8_undone(between, first)
            return now if between not in (word, now) else None
        now = _utf8_undone(word, page)
        return now if now != word else None
    turned = _TURNED[chain]
    if any(c >= "\x80" and ord(c) not in turned for c in word):
        return None
    got = word.translate(turned)
    return got if got != word else None


@lru_cache(400_000)
def readings(word: str) -> tuple[tuple, tuple]:
    """The contexts of a word's characters, as it stands and under each chain that can have produced it.

    They do not depend on the model: a worker keeps them over all rounds."""
    return tuple(contexts(word)), tuple((z, tuple(contexts(u))) for z, chain in enumerate(CHAINS) if (u := undo(word, chain)) is not None)


def _symbol(c: str) -> str:
    if c < "\x80":
        return c if c.isalpha() else "0" if c.isdigit() else " " if c == " " else "."
    return "ä" if c.islower() else "Ä" if c.isupper() else "¤"


def _class(s: str) -> str:
    return "a" if s.islower() else "A" if s.isupper() else s


def contexts(word: str) -> list[tuple[str, str, str]]:
    """Each character beyond ASCII with its neighbours' symbols."""
    w = f" {word} "
    return [(_symbol(w[i - 1]), w[i] if w[i] in ALPHABET else "\x00", _symbol(w[i + 1])) for i in range(1, len(w) - 1) if w[i] >= "\x80"]


class Model:
    """Character counts of clean text and chain shares per pool."""

    def __init__(self, counts: dict[tuple[str, str, str], float], shares: dict[tuple[int, int], float]):
        self.n3 = counts
        self.n2: Counter = Counter()
        self.n1: Counter = Counter()
        for (a, c, b), n in counts.items():
            self.n2[_class(a), c, _class(b)] += n
            self.n1[c] += n
        self.total = sum(self.n1.values()) + 1.0
        self.shares = shares
        everywhere: Counter = Counter()
        for (_, z), n in shares.items():
            everywhere[z] += n
        self.all = everywhere
        self.n = sum(everywhere.values()) + 1.0
        self.pool_n: Counter = Counter()
        for (p, _), n in shares.items():
            self.pool_n[p] += n
        self.judge = lru_cache(200_000)(self._judge)
        self.cost = lru_cache(200_000)(self._cost)
        self.first = lru_cache(200_000)(lambda pool, words: self.posterior(words, self.priors(pool)))
        self.priors = lru_cache(4096)(lambda pool: {z: self.prior(pool, z) for z in range(-1, len(CHAINS))})

    def _cost(self, k: tuple[str, str, str]) -> float:
        a, c, b = k
        return math.log((self.n3.get(k, 0.0) + BACKED * self.n2.get((_class(a), c, _class(b)), 0.0) + RARE * self.n1.get(c, 0.0) + NEVER) / self.total)

    def log_p(self, ctx: tuple) -> float:
        return sum(map(self.cost, ctx))

    def prior(self, pool: int, z: int) -> float:
        """Log share of chain z (-1: clean) in the pool, drawn towards its share everywhere."""
        base = (self.all.get(z, 0.0) + (0.02 if z >= 0 else 1.0)) / self.n
        return math.log((self.shares.get((pool, z), 0.0) + 20 * base) / (self.pool_n.get(pool, 0.0) + 20))

    def _judge(self, word: str) -> dict[int, float]:
        """For the chains that can have produced a word: how much likelier it was before, as a log ratio."""
        own, other = readings(word)
        if not other:
            return {}
        p = self.log_p(own)
        return {z: self.log_p(c) - p for z, c in other}

    def posterior(self, words: tuple[str, ...], prior: dict[int, float]) -> dict[int, float]:
        """Posterior of the chains (-1: clean) of a passage with these words beyond ASCII."""
        gain: dict[int, float] = {}
        for w in words:
            for z, x in self.judge(w).items():
                # all words are taken as left alone first; one that the chain can have produced takes its ratio instead
                gain[z] = gain.get(z, 0.0) + x - (NEARLY if CHAINS[z][0] == "utf8" else KEPT)
        if not gain:
            return {-1: 1.0}
        score = {-1: prior[-1]}
        for z, x in gain.items():
            score[z] = prior[z] + x + len(words) * (NEARLY if CHAINS[z][0] == "utf8" else KEPT)
        top = max(score.values())
        e = {z: math.exp(s - top) for z, s in score.items()}
        t = sum(e.values())
        return {z: x / t for z, x in e.items()}


def passages(text: str) -> list[list[str]]:
    """The words beyond ASCII of each passage that has any."""
    out = []
    for p in _PASSAGE.split(text):
        if _NON_ASCII.search(p):
            out.append([w for w in _SPACE.split(p) if _NON_ASCII.search(w)])
    return out


def judge_record(model: Model, pool: int, parts: list[list[str]]) -> list[dict[int, float]]:
    """Posteriors of a record's passages: first with its pool's shares, then with those and its own."""
    prior = model.priors(pool)
    first = [model.first(pool, tuple(w)) for w in parts]
    if all(len(p) == 1 for p in first):
        return first
    own: Counter = Counter()
    for p in first:
        own.update(p)
    mixed = {z: math.log(0.5 * math.exp(prior[z]) + 0.5 * own.get(z, 0.0) / len(parts)) for z in prior}
    return [model.posterior(w, mixed) if len(f) > 1 else f for w, f in zip(parts, first, strict=True)]


def pool_of(source: str | None, field: str = "text") -> int:
    return xxhash.xxh3_64_intdigest(f"{field}\x1f{source or ''}".encode()) % POOLS


def certain(word: str) -> bool:
    """Does the word hold UTF-8 read as a code page, by its bytes alone?  Only used to start the estimation."""
    return "�" in word or any((u := undo(word, c)) is not None and all(ord(x) < 0x180 or 0x2010 <= ord(x) <= 0x2122 for x in u if x >= "\x80") for c in CHAINS[: len(PAGES)])


def fit(suspects: DataFrame, rounds: int = MOST_ROUNDS) -> Model:
    """Estimate the model over all records (doc_id, pool, words: array of arrays), until it settles."""
    model: Model | None = None
    for _ in range(rounds):
        before = model
        shared = suspects.sparkSession.sparkContext.broadcast(None if model is None else (model.n3, model.shares))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            now = None if shared.value is None else Model(*shared.value)
            counts: Counter = Counter()
            shares: Counter = Counter()
            clean: Counter = Counter()  # weight of each word as clean text
            sure = lru_cache(200_000)(certain)
            for b in batches:
                for pool, parts in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    if now is None:
                        for words in parts:
                            bad = any(sure(w) for w in words)
                            shares[pool, -1] += not bad
                            if not bad:
                                clean.update(words)
                        continue
                    for words, post in zip(parts, judge_record(now, pool, parts), strict=True):
                        for z, p in post.items():
                            if p > 1e-4:
                                shares[pool, z] += p
                        weight = post.get(-1, 0.0)
                        if weight > 0.01 and not any("�" in w for w in words):
                            for w in words:
                                clean[w] += weight
            for w, n in clean.items():
                for k in readings(w)[0]:
                    counts[k] += n
            rows = [("".join(k), -2, -2, float(n)) for k, n in counts.items()] + [("", p, z, float(n)) for (p, z), n in shares.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.float64()))], names=["k", "pool", "z", "n"])

        got = suspects.mapInArrow(run, "k string, pool int, z int, n double").groupBy("k", "pool", "z").agg(F.sum("n").alias("n")).where("n > 1e-3").toArrow()
        rows = list(zip(*(got[c].to_pylist() for c in ("k", "pool", "z", "n")), strict=True))
        model = Model({tuple(k): n for k, pool, _, n in rows if pool == -2}, {(pool, z): n for _, pool, z, n in rows if pool != -2})
        if before is not None and sum(abs(n - before.all.get(z, 0.0)) for z, n in model.all.items()) <= SETTLED * model.n:
            break
    return model


def suspects(docs: DataFrame) -> DataFrame:
    """doc_id, pool and the words beyond ASCII by passage, of the records that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, pools, words = [], [], []
            for i, source, t in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if not t.isascii() and (p := passages(t)):
                    ids.append(i)
                    pools.append(pool_of(source))
                    words.append(p)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pools, pa.int32()), pa.array(words, pa.list_(pa.list_(pa.string())))], names=["doc_id", "pool", "words"])

    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    return src.mapInArrow(run, "doc_id bigint, pool int, words array<array<string>>")


def spread(s: DataFrame) -> DataFrame:
    """A small table of much work in as many partitions as there are cores."""
    cores = s.sparkSession.sparkContext.defaultParallelism
    return s.repartition(cores) if s.rdd.getNumPartitions() < cores else s


def lost(words: list[str]) -> bool:
    """Replacement characters, or control characters that no encoding of text gives."""
    return any(c == "�" or "\x80" <= c < "\xa0" for w in words for c in w)


def garbled_records(docs: DataFrame) -> DataFrame:
    """doc_id, chains (names, most frequent first; ``lost`` where nothing can be won back), passages of every affected record.

    ``docs``: doc_id, source, text.  Null and empty texts are never affected; a repeated doc_id comes each time; other
    columns are ignored; an empty table gives no rows.
    """
    s = spread(durable(suspects(docs)))
    model = fit(s)
    shared = docs.sparkSession.sparkContext.broadcast((model.n3, model.shares))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for b in batches:
            rows = []
            for i, pool, parts in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                names: Counter = Counter()
                for words, post in zip(parts, judge_record(m, pool, parts), strict=True):
                    z = max(post, key=post.get)
                    if z >= 0 and post.get(-1, 0.0) < 0.5:
                        names[NAMES[z]] += 1
                    elif lost(words):
                        names["lost"] += 1
                if names:
                    rows.append((i, [n for n, _ in names.most_common()], sum(names.values())))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.string())), pa.array([r[2] for r in rows], pa.int32())], names=["doc_id", "chains", "passages"])

    return s.mapInArrow(run, "doc_id bigint, chains array<string>, passages int")


def repaired_text(m: Model, pool: int, text: str) -> str:
    """The text with each garbled passage restored by its chain; what can't be won back stays."""
    parts = passages(text)
    if not parts:
        return text
    todo = iter(judge_record(m, pool, parts))
    out, at = [], 0
    cuts = [(x.start(), x.end()) for x in _PASSAGE.finditer(text)] + [(len(text), len(text))]
    for lo, hi in cuts:
        p = text[at:lo]
        if _NON_ASCII.search(p):
            post = next(todo)
            z = max(post, key=post.get)
            if z >= 0 and post.get(-1, 0.0) < 0.5:
                p = re.sub(r"[^ \t\n\r\f\v]+", lambda w, z=z: undo(w.group(), CHAINS[z]) or w.group() if _NON_ASCII.search(w.group()) else w.group(), p)
        out.append(p + text[lo:hi])
        at = hi
    return "".join(out)


def repaired_records(docs: DataFrame) -> DataFrame:
    """doc_id and repaired text of every record that a repair changes."""
    model = fit(spread(durable(suspects(docs))))
    shared = docs.sparkSession.sparkContext.broadcast((model.n3, model.shares))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for b in batches:
            got = [(i, r) for i, s, t in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True) if not t.isascii() and (r := repaired_text(m, pool_of(s), t)) != t]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in got], pa.int64()), pa.array([r for _, r in got], pa.string())], names=["doc_id", "text"])

    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    return src.mapInArrow(run, "doc_id bigint, text string")


def p9_found(spark, d: str) -> DataFrame:
    return garbled_records(table(spark, d, "documents")).select("doc_id").distinct()


def p9_chains(spark, d: str) -> DataFrame:
    return garbled_records(table(spark, d, "documents"))


def p9_repaired(spark, d: str) -> DataFrame:
    return repaired_records(table(spark, d, "documents"))


QUERIES = {"p9_found": p9_found, "p9_chains": p9_chains, "p9_repaired": p9_repaired}
SQL = {}
