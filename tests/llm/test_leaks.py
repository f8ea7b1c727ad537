import random

import pytest

from civlake.llm import leaks as k

D = "doc_id bigint, text string, item_id string"
I = "item_id bigint, text string, doc_id string"
WORDS = [f"{a}{b}" for a in ("lor", "ips", "dol", "sit", "ame", "con", "tet") for b in ("em", "um", "or", "is", "t", "ula")]


def brute(docs, items):
    out = set()
    for i, t in items:
        w = [x for x in (k.stream(x) for x in (t or "").split()) if x]
        for d, text in docs:
            s = k.stream(text or "")
            if any(b"".join(w[a : a + 13]) in s for a in range(len(w) - 12)):
                out.add((d, i))
    return out


def run(spark, docs, items):
    rows = [tuple(r) for r in k.leaked_items(spark.createDataFrame([(*d, "x") for d in docs], D), spark.createDataFrame([(*i, "x") for i in items], I)).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("most", [k.ITEM_BYTES, 1])
def test_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(k, "ITEM_BYTES", most)
    monkeypatch.setattr(k, "FILTER_BITS", 1 << 16)
    rng = random.Random(1)
    items = [(i, " ".join(rng.choice(WORDS + ["12", "3,456", "percent", "—", "7.5"]) for _ in range(rng.choice([5, 13, 14, 40])))) for i in range(60)] + [(90, None), (91, ""), (92, "a b c d e f g h i j k l m"), (93, "1 2 3 4 5 6 7 8 9 10 11 12 13 14")]
    docs = []
    for d in range(150):
        i, t = rng.choice(items)
        w = (t or "").split()
        n = rng.choice([9, 12, 13, 20, 60])
        a = rng.randint(0, max(0, len(w) - n))
        part = w[a : a + n]
        if rng.random() < 0.3 and len(part) > 4:
            part[3] = "other"
        style = rng.randint(0, 3)
        s = ["".join(part), " \n".join(part).upper(), "-".join(part), " ".join(" ".join(x) for x in part)][style]
        docs.append((d, f"{rng.choice(WORDS)} 5{s}6 {rng.choice(WORDS)}"))
    docs += [(900, ""), (901, None), (902, "x a b c d e f g h i j k l m y"), (903, "12345678910111213141516"), (904, " ".join(WORDS * 900) + items[3][1] * 2)]
    assert run(spark, docs, items) == brute(docs, items) and len(brute(docs, items)) > 40


def test_empty(spark):
    assert run(spark, [], [(1, "a " * 20)]) == set() and run(spark, [(1, "a " * 20)], []) == set()


def test_windows_of_any_length():
    data = b"abcabcabdabc"
    for n in (1, 3, 12):
        h = k.length_hashes(data, n)
        assert len(h) == len(data) - n + 1 and all((h[i] == h[j]) == (data[i : i + n] == data[j : j + n]) for i in range(len(h)) for j in range(len(h)))
    assert len(k.length_hashes(b"ab", 3)) == 0


def test_number_changed_in_length_before_the_passage(spark):
    item = "among the households that were asked in spring about 5 of the rooms they rented out we counted every single window facing north and wrote down whether neighbours could see it from there"
    other = "before this stands a document of its own with nothing in it that would be found"
    docs = [(1, item.replace(" 5 ", " 12 ")), (2, other), (3, item.replace(" 5 ", " 1234 ") + " tail"), (4, item.replace(" 5 ", " 12 ").replace("window", "door").replace("neighbours", "people").replace("asked", "told"))]
    assert run(spark, docs, [(7, item)]) == brute(docs, [(7, item)]) == {(1, 7), (3, 7)}


def test_diagonal_shared_with_the_preceding_document(spark):
    item = " ".join(f"{a}{b}word" for a in "abcdef" for b in "ghijkl")
    whole = k.stream(item)
    cut = k.stream(" ".join(item.split()[:9]))
    raws = [whole[: len(cut)], whole[len(cut) + 1 :]]
    index = k.Items([7], [item])
    assert index.find(raws) == [(1, 0)] and index.find(raws[1:]) == [(0, 0)]


def test_reparameterised(spark):
    item = "How many of the 12,500 people in Zorba Flats were counted in 2019 by the survey of 2019 and why"
    docs = [(1, item.replace("2019", "2021").replace("Zorba Flats", "Mirt")), (2, item), (3, item.replace("2019", "2021", 1)), (4, ""), (5, None)]
    got = {r.doc_id for r in k.reparameterised_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(7, item)], "item_id bigint, text string"), plain=5).collect()}
    assert 1 in got and 2 not in got
