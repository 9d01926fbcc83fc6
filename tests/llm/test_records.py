"""Vectors, look-alikes, scans, languages."""

import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmesh.llm import language, lookalike, scans, vectors

VEC = "vec_id long, embedding_version string, vector struct<values:array<double>,dimensions:long>, ingested_at timestamp, extra string"


def vec_table(spark, rows):
    return spark.createDataFrame([(i, v, None if x is None else (x, d), None, "x") for i, v, x, d in rows], VEC)


def brute(rows, k, least=-1):
    out = {}
    for i, v, x, _ in rows:
        own = []
        for j, w, y, _ in rows:
            if i != j and v == w and len(x) == len(y):
                a, b = np.array(x), np.array(y)
                own.append((-float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), j))
        out[i] = [(j, -s) for s, j in sorted(own)[:k] if -s >= least]
    return out


def test_neighbours_have_recall(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 64))
    rows = [(i, "v", (centres[i % 12] + rng.normal(size=64) * 0.8).tolist(), 64) for i in range(500)]
    rows += [(1000 + i, "w", rng.normal(size=32).tolist(), 32) for i in range(150)]
    truth = brute(rows, 10)
    got = {}
    for r in vectors.similar(vec_table(spark, rows)).collect():
        got.setdefault(r.vec_a, []).append(r.vec_b)
    assert max(map(len, got.values())) <= 10
    exact = vectors.nearest_exactly(vec_table(spark, rows), "vec_id % 50 = 0", block=64)
    checked = {}
    for r in exact.orderBy("vec_a", F.desc("cosine")).collect():
        checked.setdefault(r.vec_a, []).append(r.vec_b)
    assert checked == {i: [j for j, _ in truth[i]] for i in truth if i % 50 == 0}
    assert vectors.recall(vectors.similar(vec_table(spark, rows)), exact).first().recall >= 0.9
    recall = np.mean([len(set(got.get(i, [])) & {j for j, _ in t}) / len(t) for i, t in truth.items()])
    assert recall >= 0.9


@pytest.mark.parametrize("block", [8192, 16])
def test_close_pairs_copies_and_unusable(spark, block):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    rows = [(i, "v", base[i].tolist(), 16) for i in range(40)] + [(100 + i, "v", (base[i] * 7 + rng.normal(size=16) * 0.05).tolist(), 16) for i in range(40)]
    rows += [(200, "v", base[0].tolist(), 16), (201, "v", (base[0] * 2).tolist(), 16), (300, "w", base[0].tolist(), 16)]
    bad = [(400, "v", None, 16), (401, "v", [1.0] * 15, 16), (402, "v", [0.0] * 16, 16), (403, "v", [float("nan")] * 16, 16), (404, "v", [1e308] * 16, 16)]
    df = vec_table(spark, rows + bad + rows[:5])
    goal = vectors.Goal(0.9999, least=0.95, block=block)
    got = {(r.vec_a, r.vec_b) for r in vectors.close_pairs(df, goal=goal).collect()}
    truth = {(min(i, j), max(i, j)) for i, t in brute(rows, 10, 0.95).items() for j, _ in t}
    assert got == truth
    assert vectors.close_pairs(df.limit(0)).count() == 0


def test_many_copies_stay_whole(spark):
    rows = [(i, "v", [1.0, 2.0, 3.0, 4.0], 4) for i in range(60)] + [(99, "v", [-1.0, 2.0, 0.0, 1.0], 4)]
    got = {}
    for r in vectors.similar(vec_table(spark, rows), k=5).collect():
        got.setdefault(r.vec_a, []).append(round(r.cosine, 6))
    assert all(got[i] == [1.0] * 5 for i in range(60)) and len(got[99]) == 5


def test_more_close_partners_than_k_stay_whole(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "v", (np.ones(16) + rng.normal(size=16) * 0.02).tolist(), 16) for i in range(30)] + [(50 + i, "v", [2.0] * 16, 16) for i in range(12)]
    assert vectors.close_pairs(vec_table(spark, rows)).count() == 42 * 41 // 2
    links, members = vectors.close_links(vec_table(spark, rows))
    assert links.count() == 31 * 30 // 2  # copies are one class
    assert {(r.copies, r.links) for r in vectors.linked(vec_table(spark, rows)).collect()} == {(1, 41), (12, 30)}
    assert {(r.rep, r.copies) for r in members.where("vec_id >= 50").collect()} == {(50, 12)} and members.count() == 42


def test_index_grows_with_the_space():
    small, large = (vectors.planned(64, m, vectors.NEIGHBOURS) for m in (10, 20))
    assert small.regions == 1 and large.regions == 1024 and large.hashes > small.hashes
    x = np.random.default_rng(1).normal(size=(50, 64)).astype(np.float32)
    region, cell = vectors.probed_cells(x, large, 0)
    assert len({*zip(region[0].tolist(), cell[0].tolist())}) == large.probes  # no cell twice


def test_rotation_keeps_lengths():
    x = np.random.default_rng(3).normal(size=(5, 48)).astype(np.float32)
    y = vectors.rotate(x, 1, 0, 0)
    assert y.shape == (5, 64) and np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1), rtol=1e-4)


TEXT = "record_kind string, id string, text string"
LONG = "The receiving host forwards every incoming datagram to the next node."


def test_plain_forms():
    assert lookalike.plain("ＡＢ１ ﬁx é ｶﾞ ⽅ ⻓​") == "AB1 fix é ガ 方 长"
    for kept in ("r²", "É", "A、B", "：", "…"):
        assert lookalike.plain(kept) == kept


def test_pairs(spark):
    cyr = LONG.replace("o", "о").replace("The", "Тhe")
    russian = "Каждый узел проверяет сумму, а затем он шлёт пакет TCP дальше по сети."
    rows = [
        ("block", "a", LONG), ("block", "b", cyr), ("block", "c", LONG.replace(" ", " ", 3)), ("block", "d", LONG), ("block", "e", LONG.upper()), ("block", "f", LONG.replace("every", "évery")),
        ("chunk", "g", cyr), ("block", "h", russian), ("block", "i", russian.replace("а", "a").replace("о", "o").replace("е", "e")), ("block", "s", "short"), ("block", "t", "sh​ort"), ("block", None, LONG), ("block", "u", None), ("block", "v", ""),
        ("block", "b", cyr), ("chunk", "w", "2 to the 8² is more than what is written in here at all, ok"), ("chunk", "x", "2 to the 82 is more than what is written in here at all, ok"),
    ]
    df = spark.createDataFrame(rows, TEXT)
    got = {tuple(r) for r in lookalike.lookalike_pairs(df).collect()}
    assert got == {("block", x, y) for x, y in (("a", "b"), ("a", "c"), ("b", "c"), ("b", "d"), ("c", "d"), ("h", "i"))}
    linked = {r.id: (r.forms, r.links) for r in lookalike.classes(df).collect()}
    assert linked == {"a": (3, 2), "d": (3, 2), "b": (3, 3), "c": (3, 3), "h": (2, 1), "i": (2, 1)}
    norm = {r.id: r.text for r in lookalike.normalized(df.where("record_kind = 'block'")).collect()}
    assert norm["b"] == LONG and norm["i"] == russian and norm["e"] == LONG.upper() and norm["v"] == ""
    assert lookalike.lookalike_pairs(df.limit(0)).count() == 0


def test_repair_needs_the_vocabulary(spark):
    df = spark.createDataFrame([("block", "a", "xоzzyq " * 8), ("block", "b", "xozzyk " * 8)], TEXT)
    assert {r.id: r.text for r in lookalike.normalized(df).collect()}["a"] == ("xоzzyq " * 8)


BLOCK = "block_id string, document_id string, text string, block_type string, heading_path array<string>, page_start long, page_end long, ordinal long, source_path string, ingested_at timestamp"


def book(spark):
    body = ["Der Rechner sendet jeden Rahmen und speichert die Nachricht.", "Das Fenster bleibt offen, weil der Puffer leer ist."]
    rows, n = [], 0

    def add(text, page, kind="paragraph", end=None, id_=None):
        nonlocal n
        n += 1
        rows.append((id_ or f"b{n}", "d", text, kind, ["Kapitel 1 Netze"], page, end or page, n, "scans/0/a.json", None))

    for page in range(1, 13):
        add("LESEBUCH KLEINE NETZE" if page != 7 else "LESEBUCH KLcINE NETZE", page)
        if page == 6:
            add("speichert die Nachricht.", page)
        add("\n".join(body * 2), page)
        if page == 3:
            add("Der Rech-\nner speichert die Nachricht. Der TCP-\nAbsender sendet.", page, id_="hyphen")
            add("Der TCP-Absender sendet. Der TCP-Absender bleibt.", page)
        if page == 4:
            add("Das Fcnster bleibt offen.", page, id_="misread")
            add("Das Fenster bleibt\n14/99\noffen, weil der Puffer leer ist.", page, id_="inline")
        if page == 5:
            add("send(seg_1)\nrecv(seg_2)", page, "code", id_="code")
            add("Der Rechner sendet jeden Rahmen und", page, id_="continued")
        add(f"{page + 10}/99", page)
    rows.append(rows[4])
    rows.append(("null", "d", None, "paragraph", None, 12, 12, 99, None, None))
    rows.append(("other", "e", "12/99", "paragraph", ["x"], 1, 1, 1, "books/1.json", None))
    return spark.createDataFrame(rows, BLOCK)


def test_scans(spark):
    df = book(spark)
    got = {tuple(r) for r in scans.findings(df).collect()}
    kinds = {b: k for b, k in got if k != "furniture"}
    assert kinds == {"hyphen": "hyphen", "misread": "misread", "inline": "inline", "continued": "continued"}
    furniture = {b for b, k in got if k == "furniture"}
    want = {r.block_id for r in df.where("document_id = 'd'").collect() if r.text and "\n" not in r.text and ("LESEBUCH" in r.text or r.text.endswith("/99"))}
    assert furniture == want
    text = [r.text for r in scans.paragraphs(df).collect()]
    assert "Der Rechner speichert die Nachricht. Der TCP-Absender sendet." in text and "Das Fenster bleibt offen." in text
    assert "Der Rechner sendet jeden Rahmen und speichert die Nachricht." in text and not any("/99" in t or "LESEBUCH" in t for t in text)
    assert scans.findings(df.where("document_id = 'e'")).count() == 0


def group(rows):
    names = ("block_id", "document_id", "text", "block_type", "head", "page_start", "page_end", "ordinal", "ingested_at", "home", "part")
    whole = [(f"b{i}", "d", text, kind, "Kapitel", page, page, i, None, 0, 0) for i, (text, kind, page) in enumerate(rows)]
    return scans.in_order(pa.table(dict(zip(names, map(list, zip(*whole, strict=True)), strict=True))), {"lesebuch kleine netze"})


def pages(last="der Rechner sendet jeden Rahmen"):
    """Pages with a header, paragraphs and a number; ``last`` ends the last block of page 5, goes on there on page 6."""
    rows = []
    for page in range(1, 41):
        rows.append(("LESEBUCH KLEINE NETZE", "paragraph", page))
        if page % 5 == 1 and page > 1:
            rows.append(("und speichert die Nachricht im Puffer.\nDas Fenster bleibt offen.", "paragraph", page))
        rows.append(("Der Rechner sendet den Rahmen über die\nLeitung und wartet auf die Antwort.", "paragraph", page))
        rows.append((f"Tabelle {page}", "section_heading", page))
        rows.append(("Das Fenster bleibt offen, bis der Puffer\n" + (last if page % 5 == 0 else "leer ist und die Nachricht ankommt."), "paragraph", page))
        rows.append((f"{page + 10}", "paragraph", page))
    return rows


def test_context_decides_between_equal_lines():
    """Two lines with the same features: the one after which the paragraph goes on over the page is body, the other one a break."""
    lines = scans.observed(group(pages()))
    model = scans.Model.trained([([r.seen for r in lines], [r.weak for r in lines])])
    rows = pages()
    at = next(i for i, r in enumerate(rows) if r[2] == 36 and r[0].startswith("und speichert"))
    rows[at] = ("Am Morgen ist der Puffer wieder so\nleer wie am Abend.", "paragraph", 36)
    f = group(rows)
    lines = scans.observed(f)
    labels = [scans.LABELS[s] for s in model.path([r.seen for r in lines])]
    ends = {f["page_start"][r.row]: (r.seen, label) for r, label in zip(lines, labels, strict=True) if r.text.startswith("der Rechner sendet")}
    assert ends[35][0] == ends[30][0] and ends[30][1] == scans.BODY and ends[35][1] == scans.BREAK
    assert [r.weak for r in lines if r.text.startswith("der Rechner sendet")].count(scans.BODY) == 8  # the first guess knew no better
    assert {r.text for r, label in zip(lines, labels, strict=True) if label == scans.HEADER} == {"LESEBUCH KLEINE NETZE", *(str(p + 10) for p in range(1, 41))}


def test_paths_are_the_likeliest():
    rng = np.random.default_rng(7)
    lines = scans.observed(group(pages()[:40]))
    model = scans.Model.trained([([r.seen for r in lines], [r.weak for r in lines])])
    for _ in range(5):
        seen = [lines[i].seen for i in rng.integers(0, len(lines), 5)]

        def worth(path, seen=seen):
            total, before = 0.0, scans.END
            for s, o in zip(path, seen, strict=True):
                total += model.move[o[0], before, s] + model.score(o)[s]
                before = s
            return total

        best = max(worth(p) for p in itertools.product(range(scans.STATES), repeat=5))
        assert worth(model.path(seen)) == pytest.approx(best)


def test_cleaned_text_keeps_what_is_printed():
    fix = [{"kind": "misread", "word": "3:^乙丙", "right": "^戊丙"}]
    assert scans.cleaned(["甲乙丙。丁乙丙。乙丙"], [2], "paragraph", fix) == ("甲乙丙。丁乙丙。戊丙", False)  # only where the run begins with it
    assert scans.cleaned(["Wir gehen zum TCP-"], [1], "paragraph", [], "Absender der Daten") == ("Wir gehen zum TCP-", True)
    broken = [{"kind": "hyphen", "word": "Rech-ner", "right": "Rechner"}]
    assert scans.cleaned(["Wir sehen den Rech-"], [1], "paragraph", broken, "ner dort.") == ("Wir sehen den Rech", True)
    assert scans.cleaned(["Wir sehen -"], [1], "paragraph", [], None) == ("Wir sehen -", False)


def test_page_numbers():
    for t in ("12", "- 7 -", "[l2]", "27/3lO", "Page 7O", "xiv", "第 3 页", "p. 4", "· 8 ·", "— 9 —"):
        assert scans.is_number(t), t
    for t in ("3.14", "Fig. 3", "82 ms", "", "R1", "12 Netze", "civil war"):
        assert not scans.is_number(t), t


WORDS = {
    "en": "the host sends every frame to the next node and waits for an answer because this link is slow",
    "de": "der rechner sendet jeden rahmen an den nächsten knoten und wartet auf eine antwort weil die leitung langsam ist",
    "es": "el equipo envía cada trama al siguiente nodo y espera una respuesta porque el enlace es muy lento",
    "ru": "узел передаёт каждый кадр следующему узлу и ждёт ответа потому что этот канал очень медленный",
}


def sentence(code, rng):
    return " ".join(rng.sample(WORDS[code].split(), 10)).capitalize() + "."


def test_languages(spark):
    rng = random.Random(5)
    rows = []
    for i in range(240):
        code = list(WORDS)[i % 4]
        label = code if i % 10 else {"en": "de", "de": "es", "es": "ru", "ru": "en"}[code]
        rows.append((i, " ".join(sentence(code, rng) for _ in range(6)), label, code))
    rows += [(900, " ".join(sentence("de", rng) for _ in range(5)), None, "de"), (901, " ".join(sentence("es", rng) for _ in range(5)), "und", "es"), (902, " ".join(sentence("en", rng) for _ in range(4)), "en-US", "en")]
    mixed = " ".join([*(sentence("de", rng) for _ in range(5)), *(sentence("ru", rng) for _ in range(2)), *(sentence("de", rng) for _ in range(3))])
    rows += [(903, mixed, "de", "de"), (904, "0x4d 12.5 99\n0x11 3.4", "en", None), (905, None, None, None), (906, "", "en", None), (907, "   ", "", None), (908, "send(buf_1)\nrecv(buf_2)", "en", None)]
    df = spark.createDataFrame([(i, t, lab) for i, t, lab, _ in rows], "doc_id long, text string, lang string").withColumn("extra", F.lit(1))
    main = {r.doc_id: r.lang for r in language.languages(df).collect()}
    assert main == {i: code for i, _, _, code in rows}
    got = {tuple(r) for r in language.label_cases(df).collect()}
    wrong = {(i, "wrong", code) for i, _, lab, code in rows if i < 240 and lab != code}
    assert got == wrong | {(900, "missing", "de"), (901, "missing", "es"), (903, "mixed", "ru")}
    stretches = language.segments(df.where("doc_id = 903 or doc_id < 240")).where("doc_id = 903").orderBy("start_pos").collect()
    assert [r.lang for r in stretches] == ["de", "ru", "de"] and [r.sentences for r in stretches] == [5, 2, 3]
    assert all(mixed[r.start_pos : r.end_pos].endswith(".") and 0 < r.confidence <= 1 for r in stretches)


def test_cosines_are_those_of_the_bundles():
    protos = np.random.default_rng(1).normal(size=(3, language.DIMENSIONS)).astype(np.float32)
    space = language.Space(protos)
    words = [language.letters_of(t) for t in ("The quick brown fox jumps.", "", "Другой узел ждёт ответа.", "网络 网络")]
    got = space.cosines(words)
    assert np.allclose(got, space.cosines(words)) and not got[1].any()
    for w, cos in zip(words, got, strict=True):
        grams = Counter(g for n in (1, 2, 3) for i in range(len(w) + 3 - n) if (g := f" {w} "[i : i + n]) != " " and w)
        bundle = np.zeros(language.DIMENSIONS)
        for g, n in grams.items():
            v = space.letter(g[0])
            for c in g[1:]:
                v = np.roll(v, 1) * space.letter(c)
            bundle += n * v.astype(float)
        if grams:
            assert np.allclose(cos, protos @ bundle / np.sqrt(language.DIMENSIONS * sum(n * n for n in grams.values())), atol=1e-3)


def test_full_table_of_products_stays_right(monkeypatch):
    monkeypatch.setattr(language, "SLOT_BITS", 4)
    monkeypatch.setattr(language, "SLOTS", 16)
    protos = np.random.default_rng(1).normal(size=(3, language.DIMENSIONS)).astype(np.float32)
    small = language.Space(protos)
    codes = np.unique(language.gram_codes(["the sliding window waits for every frame"])[1])
    want = small._met(codes)
    for _ in range(3):
        assert np.allclose(small.products(codes), want)


def test_mixed_tokens_are_confirmed_by_texts_of_any_script(spark):
    latin = [("block", f"l{i}", "el sistema envia datos por la red") for i in range(4)]
    cyrillic = "передача данных идёт быстро через другой узел "
    df = spark.createDataFrame([*latin, ("block", "c", cyrillic + "\u0455i\u0455t\u0435ma")], "record_kind string, id string, text string")
    assert {r.id: r.text for r in lookalike.normalized(df).collect()}["c"] == cyrillic + "sistema"
