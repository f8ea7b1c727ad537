import random

from civlake.llm import garbled as g

S = "doc_id bigint, source string, text string, pool string"
CLEAN = {
    "es": "La población creció más rápido según el índice. ¿Qué pasó en España después de la revisión?",
    "de": "Die Schätzung für größere Häuser enthält Straßen und Übersichten. Später fehlt das Büro.",
    "fr": "Le taux de pauvreté est passé à 38 % après la révision des îlots. Où se situe la médiane ?",
    "pt": "Não há informações sobre domicílios após a ampliação do ônibus. A pesquisa contou habitações.",
    "en": "It’s the panel’s own estimate for Îlemart … ± 48 points – “corridor” at § 7.",
}
ODD = ["α = 0.05, π ≈ 3, Ω index", "├── tract\n└── county", "№ 7 — Жилой фонд, таблица 2", "EDUCAÇÃO E HABITAÇÃO", "Price in £ and ¥ — see Σ row", "GRÖẞE UND ÄNDERUNG", "Δ income ≥ 0", "caf\xe9\xa0noir"]


def garble(t, origin, page):
    out = []
    for c in t:
        try:
            b = c.encode(origin)
        except UnicodeEncodeError:
            out.append(c)
            continue
        try:
            out.append(b.decode(page))
        except UnicodeDecodeError:
            out.append("".join(chr(x) if x > 127 else bytes([x]).decode() for x in b) if page.startswith("cp125") else c)
    return "".join(out)


def corpus():
    rng = random.Random(4)
    rows, bad = [], {}
    for i in range(600):
        lang = rng.choice(list(CLEAN))
        rows.append((i, f"s{i % 3}", " ".join([CLEAN[lang], f"Row {i}."] * rng.randint(1, 3))))
    for k, odd in enumerate(ODD * 3):
        rows.append((700 + k, "s1", f"Plain words before. {odd} and after"))
    kinds = [("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp1251"), ("cp1252", "mac_roman"), ("cp1252", "cp437")]
    i = 800
    for o, p in kinds:
        for lang in ("es", "de", "fr", "pt"):
            t = f"Row {i} is fine. " + garble(CLEAN[lang], o, p)
            bad[i] = f"Row {i} is fine. " + CLEAN[lang]
            rows.append((i, "s2", t))
            i += 1
    twice = garble(garble(CLEAN["fr"], "utf-8", "cp1252"), "utf-8", "cp1252")
    rows.append((i, "s2", twice))
    bad[i] = CLEAN["fr"]
    rows.append((i + 1, "s2", "The �corridor� is lost."))
    bad[i + 1] = None
    return rows + [(990, None, None), (991, None, ""), (992, None, "plain"), (993, None, "é" * 20000)], bad


def test_found_and_repaired(spark):
    rows, bad = corpus()
    df = spark.createDataFrame([(*r, "x") for r in rows], S)
    found = {r.doc_id: r.chains for r in g.garbled_records(df).collect()}
    assert set(found) == set(bad)
    fixed = {r.doc_id: r.text for r in g.repaired_records(df).collect()}
    wrong = [i for i, t in bad.items() if t is not None and fixed.get(i) != t]
    assert len(wrong) <= 2 and set(fixed) <= set(bad)


def test_empty(spark):
    e = spark.createDataFrame([], S)
    assert g.garbled_records(e).count() == 0 and g.repaired_records(e).count() == 0


def test_undo_is_exact_where_bytes_decide():
    for t in CLEAN.values():
        for page in ("cp1252", "mac_roman", "cp437", "cp1251", "cp850"):
            words = [w for w in t.split(" ") if not w.isascii()]
            for w in words:
                bad = garble(w, "utf-8", page)
                assert g.undo(bad, ("utf8", page)) == w, (w, page, bad)
