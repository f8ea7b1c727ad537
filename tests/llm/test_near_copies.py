import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from civlake.llm import near_copies as n
from civlake.llm.components import components

S = "source_table string, id bigint, text string, key string, n_words string"


def words(t):
    return frozenset(re.findall("[a-z0-9]+", t.lower()))


def brute(rows, least=0.6):
    out = set()
    for s, i, t in rows:
        for s2, j, u in rows:
            if s == s2 and i < j and t and u and words(t) and words(u) and len(words(t) & words(u)) / len(words(t) | words(u)) >= least - 1e-12:
                out.add((s, i, j))
    return out


def corpus(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows, i = [], 0
    for s in ("a", "b"):
        for _ in range(40):
            base = rng.sample(vocab, rng.randint(3, 25))
            for _ in range(rng.choice([1, 1, 2, 4])):
                t = [w for w in base if rng.random() > 0.12] + rng.sample(vocab, rng.randint(0, 2))
                rng.shuffle(t)
                rows.append((s, i, rng.choice([" ", ", ", "\n"]).join(t).upper()))
                i += 1
    return rows + [("a", 900, None), ("a", 901, ""), ("a", 902, "éß — !"), ("b", 903, "x"), ("b", 904, "X."), ("b", 905, "x x"), ("a", 903, "x"), ("a", 906, "long " + " ".join(f"z{k}" for k in range(9000))), ("a", 907, " ".join(f"z{k}" for k in range(8000)))]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", "c") for r in rows], S)


def test_pairs_against_brute_force(spark):
    rows = corpus()
    got = [tuple(r) for r in n.similar_pairs(frame(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_few_uncommon_words(spark, monkeypatch):
    rows = [("a", i, f"the same words in every text number{i % 30}") for i in range(90)]
    monkeypatch.setattr(n, "COMMON_FROM", 20)
    assert {tuple(r) for r in n.similar_pairs(frame(spark, rows)).collect()} == brute(rows)


def test_lower_bound_and_join_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(n, "BROADCAST_IDS", 0)
    rows = corpus(5)
    assert {tuple(r) for r in n.similar_pairs(frame(spark, rows)).collect()} == brute(rows)


def test_groups(spark):
    rows = [("a", 1, "one two three four"), ("a", 2, "four three two one"), ("a", 3, "one two three four five"), ("a", 4, "one two three four five six"), ("a", 5, "nothing alike here"), ("b", 1, "one two three four")]
    got = {(r.source_table, r.id): (r.class_id, r.n_links, r.group_id) for r in n.similar_groups(frame(spark, rows)).collect()}
    assert got == {("a", 1): (1, 2, 1), ("a", 2): (1, 2, 1), ("a", 3): (3, 2, 1), ("a", 4): (4, 2, 1)}


def test_empty(spark):
    e = frame(spark, [])
    assert n.similar_pairs(e).count() == 0 and n.similar_groups(e).count() == 0


def test_components_of_a_long_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.component for r in components(e).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_hot_template_with_words_of_their_own(spark):
    template = [f"t{k}" for k in range(25)]
    rows = [("a", i, " ".join(template + [f"own{i}x{k}" for k in range(5)])) for i in range(90)]
    rows += [("a", 200 + i, " ".join(template[i % 4 :] + [f"few{i}"])) for i in range(8)] + [("b", 1, " ".join(template))]
    assert {tuple(r) for r in n.similar_pairs(frame(spark, rows)).collect()} == brute(rows) and len(brute(rows)) > 4_005


def test_common_words_only_in_many_mixtures(spark, monkeypatch):
    monkeypatch.setattr(n, "COMMON_FROM", 4)
    rng = random.Random(8)
    vocab = [f"v{k}" for k in range(60)]
    rows = []
    for g in range(12):
        base = rng.sample(vocab, rng.choice([2, 3, 5, 9, 20, 40]))
        for k in range(12):
            text = [w for w in base if rng.random() > 0.1] + rng.sample(vocab, rng.randint(0, len(base) // 4)) + [f"o{g}x{k}x{j}" for j in range(rng.randint(0, 1 + len(base) // 5))]
            rows.append(("a", 100 * g + k, " ".join(text)))
    assert {tuple(r) for r in n.similar_pairs(frame(spark, rows)).collect()} == brute(rows)


def test_words_of_whole_batches(spark):
    rng = random.Random(5)
    texts = ["", "Hello, WORLD-wide world", "\u212aelvin \u0130x ab", "é", "", " ".join("q" * k for k in (7, 8, 9, 16, 17, 511, 512, 513, 600)), *("".join(rng.choice("aB1 -éK\u0130z") for _ in range(rng.randint(0, 30))) for _ in range(500))]
    hashes = {}
    for some in (pa.array(texts), pa.array(texts).slice(3, 40), pa.array([t for t in texts if t.isascii()]), pa.array(["ab", "cd"]), pa.array(["", ""]), pa.array([], pa.string())):
        want = [words(t) for t in some.to_pylist()]
        row, code, known = n.word_sets(some)
        got = sorted(zip(row.tolist(), known.take(pa.array(code)).to_pylist(), strict=True))
        assert got == sorted((k, w) for k, t in enumerate(want) for w in t)
        row, code, known = n.word_sets(some, hashed=True)
        assert [int((row == k).sum()) for k in range(len(want))] == [len(t) for t in want]
        for w, h in ((min(t), known[int(code[row == k][0])].as_py()) for k, t in enumerate(want) if len(t) == 1):
            assert hashes.setdefault(w, h) == h
    assert len(set(hashes.values())) == len(hashes) > 30


def test_cells_end_where_a_first_shared_word_can_stand(spark):
    rows = [("a", k, " ".join(f"u{k // 2}x{j}" for j in range(k % 2 * 2, 20))) for k in range(8)]
    reps = n.sketches(frame(spark, rows).select("source_table", "id", "text"), n.common_words(frame(spark, rows)))
    sent = {r["id"]: r["count"] for r in n.first_cells(reps, 0.6).groupBy("id").count().collect()}
    assert sent == {k: 8 if k % 2 else 9 for k in range(8)}  # of 18 and of 20
    assert {tuple(r) for r in n.similar_pairs(frame(spark, rows)).collect()} == brute(rows) == {("a", k, k + 1) for k in range(0, 8, 2)}


def test_texts_are_read_once_for_words_for_sketches_and_for_candidates(spark):
    rows = corpus(6)
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    texts = frame(spark, rows).select("source_table", "id", "text").mapInArrow(counted, "source_table string, id bigint, text string")
    assert {tuple(r) for r in n.similar_pairs(texts).collect()} == brute(rows)
    assert reads.value == 3 * len(rows)
