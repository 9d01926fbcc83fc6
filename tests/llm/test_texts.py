"""Encoding, mixing, pieces, terms, sentences."""

import base64
import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmesh.llm import encode, mixing, pieces, sentences, terms

DOCS = "doc_id long, source string, text string"


@pytest.fixture(scope="module")
def reference_encoder():
    import tiktoken

    ranks = encode.read_ranks(Path(encode.TOKENIZERS, "byte_bpe_50k.tiktoken").read_bytes())
    return ranks, tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_equals_the_public_tokenizer(spark, reference_encoder):
    texts = ["Hello world's 123  tokens\n\n", "网络协议，传输层。", "<|endoftext|> is text", "   ", "a" * 900 + "é😀" * 300, "\t\x00mixed ไทย हिन्दी", "", None]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, extra string")
    got = {r.doc_id: r.ids for r in encode.encode_column(df).collect()}
    assert got == {i: reference_encoder[1].encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    n = encode.encode_column(df, out="n", lengths_only=True)
    assert {r.doc_id: r.n for r in n.collect()} == {k: len(v) for k, v in got.items()} and n.columns == ["doc_id", "extra", "n"]
    with pytest.raises(ValueError):
        encode.encode_column(df, out="extra")
    assert encode.encode_column(df.limit(0)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.text(min_size=1, max_size=200))
def test_long_words_merge_alike(word):
    ranks = encode.read_ranks(Path(encode.TOKENIZERS, "byte_bpe_50k.tiktoken").read_bytes())
    data = word.encode("utf-8", "replace")
    if data in ranks:
        return
    assert encode.merge_word(data, ranks) == encode._merge_long(data, ranks) if len(data) <= encode.LONG_WORD else True


def test_ranks_are_read():
    line = base64.b64encode(b"ab") + b" 7\n"
    assert encode.read_ranks(line) == {b"ab": 7}


def test_cut_poisson_has_the_mean():
    for rate, most in ((0.3, 1), (0.9, 3), (2.7, 3), (5.0, 8)):
        below = mixing.cut_poisson(rate, most)
        assert most - sum(below) == pytest.approx(rate, abs=1e-6) and below == sorted(below)
    below = mixing.cut_poisson(1000.0, 2000)  # far beyond what exp(-rate) can hold
    assert 2000 - sum(below) == pytest.approx(1000, rel=1e-6)
    assert mixing.cut_poisson(3, 3) == [0.0] * 3 and mixing.cut_poisson(0, 2) == [1.0] * 2


def test_mix_reaches_shares(spark):
    rows = [(i, "a", "one two three four") for i in range(1500)] + [(2000 + i, "b", "one two") for i in range(300)] + [(9000, None, "x"), (9001, "other", "x"), (9002, "c", None), (9003, "c", "")]
    docs = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([("a", 0.8, 3), ("b", 0.15, 3), ("c", 0.02, 5), ("d", 0.03, 2)], "source string, target_share double, max_repeats long")
    report = {r.source: r for r in mixing.report(docs, targets).collect()}
    assert report["a"].actual_share == pytest.approx(0.8 / 0.95, abs=0.04) and report["b"].actual_share == pytest.approx(0.15 / 0.95, abs=0.04)
    assert report["c"].short and report["d"].short and report["d"].tokens == 0 and report["a"].most_uses <= 3
    assert {r.source for r in mixing.short_sources(docs, targets).collect()} == {"c", "d"}
    first, second = mixing.mix(docs, targets).collect(), mixing.mix(docs.repartition(7), targets).collect()
    assert sorted(first) == sorted(second) and [r.shuffle_key for r in first] == sorted(r.shuffle_key for r in first)
    assert max(Counter(r.doc_id for r in first if r.source == "a").values()) <= 3


def test_mix_holds_whole_records(spark):
    docs = spark.createDataFrame([(i, "a", f"text {i}", i % 7) for i in range(60)], DOCS + ", extra int")
    targets = spark.createDataFrame([("a", 1.0, 3)], "source string, target_share double, max_repeats long")
    got = mixing.mix(docs, targets)
    assert got.columns == ["doc_id", "source", "text", "extra", "n_tokens", "copy_no", "shuffle_key"]
    rows = got.collect()
    assert rows and all((r.text, r.extra) == (f"text {r.doc_id}", r.doc_id % 7) for r in rows)


LIMITS = "field_name string, max_chars long, overlap_chars long"


def test_pieces_join_to_the_text(spark):
    random.seed(4)
    texts = ["".join(random.choice(["word ", "字", "。", "x" * 40, "\n\n", ", ", "é", "😀"]) for _ in range(n)) for n in (0, 30, 400, 3000)]
    rows = [("f", str(i), t) for i, t in enumerate(texts)] + [("f", "3", texts[3]), ("g", "n", "a" * 500), ("f", "null", None), ("f", None, "a" * 500)]
    df = spark.createDataFrame(rows, "field_name string, record_id string, text string")
    limits = spark.createDataFrame([("f", 100, 10)], LIMITS)
    for size in (1 << 20, 1500):
        got = pieces.split(df, limits, size).orderBy("record_id", "piece_no").collect()
        by = {}
        for r in got:
            by.setdefault(r.record_id, []).append(r)
        assert set(by) == {str(i) for i, t in enumerate(texts) if len(t) > 100}
        for k, rs in by.items():
            text, at = texts[int(k)], 0
            assert [r.piece_no for r in rs] == list(range(1, len(rs) + 1))
            for r in rs:
                assert text[r.start_pos : r.end_pos] == r.text and len(r.text) <= 100 and 0 <= r.overlap <= 10 and r.start_pos + r.overlap == at
                at = r.end_pos
            assert at == len(text)


def test_cut_kinds_over_range_borders(spark):
    limits = spark.createDataFrame([("f", 100, 10)], LIMITS)
    rows = [("f", "run", "a " * 300 + "b" * 101 + " c" * 300), ("f", "just", "a " * 300 + "b" * 100 + " c" * 300), ("f", "marks", "。".join("字" * 100 for _ in range(9)))]
    df = spark.createDataFrame(rows, "field_name string, record_id string, text string")
    for size in (1 << 20, 650, 333):
        assert {r.record_id: r.cut_kind for r in pieces.cut_kinds(df, limits, size).collect()} == {"run": "forced", "just": "natural", "marks": "natural"}
    assert pieces.cut_kinds(df.limit(0), limits).count() == 0


def test_cut_kinds_come_from_stitched_pieces(spark):
    random.seed(6)
    texts = ["".join(random.choice(["word ", "字" * 30, "。", "x" * 60, "\n\n", "é", "😀" * 25]) for _ in range(n)) for n in [9] * 30 + [60] * 10] + ["x" * 2000, " " * 2000, "😀" * 101 + " ", "." + "y" * 2000]
    df = spark.createDataFrame([("f", str(i), t) for i, t in enumerate(texts)] + [("f", "0", texts[0])], "field_name string, record_id string, text string")
    stop = "[" + re.escape(pieces.MARKS + pieces.SPACES) + "]"
    wanted = {str(i): "forced" if max(map(len, re.split(stop, t))) > 100 else "natural" for i, t in enumerate(texts) if len(t) > 100}
    assert set(wanted.values()) == {"forced", "natural"}
    limits = spark.createDataFrame([("f", 100, 10)], LIMITS)
    for size in (1 << 20, 333, 150):
        got = pieces.cut_kinds(df, limits, size)
        assert {r.record_id: r.cut_kind for r in got.collect()} == wanted
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "posexplode(pieces" in plan and "sum(chars" in plan  # pieces, placed by prefix sums
    for overlap in (None, 100, 300):
        assert {r.record_id: r.cut_kind for r in pieces.cut_kinds(df, spark.createDataFrame([("f", 100, overlap)], LIMITS), 333).collect()} == wanted


def test_natural_texts_are_cut_at_natural_places(spark):
    texts = ["ab " * 40 + "x" * 95 + " " + "cd " * 40, "a " * 100 + "b" * 100 + " c" * 100, "。".join("字" * 100 for _ in range(9)), "y" * 99 + "?!" + " " * 150 + "z" * 100]
    df = spark.createDataFrame([("f", str(i), t) for i, t in enumerate(texts)], "field_name string, record_id string, text string")
    limits = spark.createDataFrame([("f", 100, 10)], LIMITS)
    stops = set(pieces.MARKS + pieces.SPACES)
    for size in (1 << 20, 333, 60):
        assert {r.cut_kind for r in pieces.cut_kinds(df, limits, size).collect()} == {"natural"}
        for r in pieces.split(df, limits, size).collect():
            text = texts[int(r.record_id)]
            assert len(r.text) <= 100 and (r.end_pos == len(text) or stops & set(text[r.end_pos - 1 : r.end_pos + 1]))


def test_neighbours_fix_the_same_anchor(spark):
    text = "word " * 100 + "\n\n" + " " * 600 + "ab, " + "word " * 200  # the empty line lies before what the right neighbour sees
    df = spark.createDataFrame([("f", "1", text)], "field_name string, record_id string, text string")
    got = pieces.split(df, spark.createDataFrame([("f", 100, 10)], LIMITS), 1150).orderBy("piece_no").collect()
    assert "".join(r.text[r.overlap :] for r in got) == text


def test_different_texts_of_a_record_are_not_mixed(spark):
    texts = ["one two " * 100, "drei, vier " * 300]
    df = spark.createDataFrame([("f", "1", t) for t in texts], "field_name string, record_id string, text string").coalesce(1)
    limits = spark.createDataFrame([("f", 100, 10)], LIMITS)
    got = pieces.split(df, limits, 400).orderBy("piece_no").collect()
    assert "".join(r.text[r.overlap :] for r in got) in texts
    assert [tuple(r) for r in pieces.cut_kinds(df, limits, 400).collect()] == [("f", "1", "natural")]


def test_limit_must_exceed_the_overlap():
    with pytest.raises(ValueError):
        pieces.work_range(b"x" * 300, 0, 0, False, False, 50, 60)


def test_files_are_split_by_offset(spark, tmp_path):
    text = "Ein Satz mit Wörtern. " * 2000
    (tmp_path / "big.txt").write_text(text, encoding="utf-8")
    got = pieces.split_file(spark, str(tmp_path / "big.txt"), 200, 20, range_bytes=5000).orderBy("piece_no").collect()
    assert "".join(r.text[r.overlap :] for r in got) == text and max(len(r.text) for r in got) <= 200


def records(spark, rows):
    return spark.createDataFrame(rows, "record_id string, text string")


def test_terms_of_a_vocabulary_and_formula(spark):
    rows = [("1", "TCP tcp window 网络网络"), ("2", "ＴＣＰ router xTCPx tcp_1"), ("3", None), ("4", ""), ("1", "TCP tcp window 网络网络")]
    vocabulary = spark.createDataFrame([("tcp",), ("网络",), ("nothing",)], "term string")
    few = {(r.record_id, r.term): (r.tf, round(r.score, 9)) for r in terms.scores(records(spark, rows), vocabulary).collect()}
    assert {k: v[0] for k, v in few.items()} == {("1", "tcp"): 2, ("1", "网络"): 2, ("2", "tcp"): 2}
    lengths = [terms.units(terms.fold(t or "")) for t in (rows[0][1], rows[1][1], "", "")]
    n, avgdl, lam = 4, sum(lengths) / 4, 4 / 4
    tfn = 2 * math.log2(1 + avgdl / lengths[0])
    assert few["1", "tcp"][1] == pytest.approx((tfn * math.log2((1 + lam) / lam) + math.log2(1 + lam)) / (tfn + 1))
    assert n == 4


def test_filter_finds_every_substring_of_the_vocabulary():
    rng = random.Random(3)
    text = "".join(rng.choice("ab字é ") for _ in range(400))
    words = {text[i : i + n] for n in (1, 2, 5, 17, 60) for i in range(0, 300, 7)}
    roller = terms.Roller()
    bits = np.zeros(terms.FILTER_BITS // 32, np.uint32)
    for w in words:
        for h in [terms.hash_of(w, roller), *([terms.hash_of(w[: terms.FIRST], roller) ^ terms._FIRST_SALT] if len(w) >= terms.FIRST else [])]:
            for place in terms._spread_bits(np.array([h], np.uint64)):
                at = int(place(slice(None))[0])
                bits[at >> 5] |= np.uint32(1 << (at & 31))
    other, got, last = terms.filtered([text[:200], text, ""], sorted({len(w) for w in words}), bits, roller)
    assert not last and all(other[w] <= got[w] for w in words)
    for w in words:
        want = sum(text.startswith(w, i) and terms.stands_alone(text, i, i + len(w)) for i in range(len(text)))
        assert got[w] == want
    assert set(got) <= words  # false positives are rare in a filter so empty


def test_distinctive_prefers_rare_shared_terms(spark):
    rows = [(str(i), f"the network sends data number {i} " + ("zorfle zorfle" if i < 3 else "")) for i in range(30)]
    probes = spark.createDataFrame([(1, "0", ["network", "Zorfle", "data", None, "absent"]), (1, "0", ["network"]), (2, "9", ["absent"]), (3, "nope", ["data"]), (4, "5", None)], "probe_id long, record_id string, candidates array<string>")
    got = terms.distinctive(probes.limit(1).union(probes.where("probe_id > 1")), records(spark, rows)).collect()
    assert [(r.probe_id, r.term) for r in got] == [(1, "Zorfle")]


def test_all_terms(spark):
    assert terms.all_terms("ab 网络层", (2,)) == Counter({"ab": 1, "网络": 1, "络层": 1})
    assert terms.fold("ﾊﾟｹｯﾄ ＡＢ") == "パケット ab"


def test_words_keep_their_marks_and_unspaced_runs_all_lengths(spark):
    assert terms.all_terms("नमूने मिलीसेकंड கணினி ❤\ufe0f") == Counter({"नमूने": 1, "मिलीसेकंड": 1, "கணினி": 1}) and terms.units("नमूने मिलीसेकंड") == 2
    run = "动态主机配置协议服务器地址池分配表格"
    assert terms.all_terms("帧") == Counter({"帧": 1}) and len(run) == 18
    assert set(terms.all_terms(run)) == {run[i:j] for i in range(18) for j in range(i + 1, 19) if j - i != 17}
    got = terms.scores(records(spark, [("a", "帧 नमूने โปรโตคอล"), ("b", "x")])).collect()
    assert {"帧", "नमूने", "โปรโตคอล"} <= {r.term for r in got if r.record_id == "a"} and all(r.score > 0 for r in got)


def split(text):
    return [text[a:b] for a, b in sentences.sentence_spans(text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Some links, e.g. No. 23, carry approx. 64.86 Mbit/s vs. 70.74. Next one.", 2),
        ("It keeps timers, etc. As a result it works. It is i.e. fine.", 3),
        ('"Does it?" asked Prof. Korvane. It does.', 2),
        ("It is full. eBGP runs. 802.11 also runs.", 3),
        ("„Gut?“, fragte Dr. X. Am 9. Mai gilt z. B. dies, d. h. 5 Prozent. Siehe Abb. 4.2. Ende", 4),
        ("«¿Cada?», preguntó la Sra. B. ¡Cuidado! Véase pág. 4.", 3),
        ("«Узел?» — спросил он. Хранит счётчики и т. д. Поэтому т. е. так. См. рис. 3.", 4),
        ("日志写道：“好。”然后开始。“真的吗？”助教问道。一直等……然后停。真的吗？！", 5),
        ("「破棄する。」と講師は述べた。次。", 2),
        ("เซิร์ฟเวอร์ทิ้งข้อมูล ค่าเท่ากับ59.94มิลลิวินาที จริงหรือไม่? โหนด", 4),
        ("एक है। दो 3.5 था। क्या?", 3),
        ("Head\n\nText without end\n \nMore (see it.) Done.", 4),
        ("   ", 0),
        ("", 0),
    ],
)
def test_sentences(text, want):
    got = split(text)
    assert len(got) == want, got
    assert all(s == s.strip() for s in got)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB1. \n。？”“\"'…!แ字と问,-(", max_size=300), st.integers(1, 40))
def test_chunk_functions_compose(text, size):
    symbols = sentences.classes(text)
    state, found = 0, []
    for i in range(0, len(symbols), size):
        part = symbols[i : i + size]
        got, after = sentences.events(part, state)
        assert sentences.function(part)[state] == after
        found += [(i + p, w) for p, w in got]
        state = after
    assert sentences.ends_of(text, found) == sentences.sentence_ends(text)


def test_long_texts_split_as_short_ones(spark):
    random.seed(3)
    texts = ["".join(random.choice(["Wort ", "Ende. ", "字。", "\n\n", " \n", "z. B. ", '"Was?" fragte ', "…", "Dr. X", "eBGP "]) for _ in range(n)) for n in (0, 5, 80, 300)]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)] + [("null", None)], "key string, text string")
    for chunk in (1 << 16, 37, 200):
        got = {r.key: r.ends for r in sentences.once_each(sentences.sentence_table(df, chunk)).collect()}
        assert {k: v for k, v in got.items() if v} == {str(i): e for i, t in enumerate(texts) if (e := sentences.sentence_ends(t))}, chunk


def test_marks_at_chunk_borders(spark):
    texts = ["ระบบส่งข้อมูล เครือข่ายทำงาน แล้วหยุด ครับ จบแล้ว", "ก ข ค ง", " ส่งข้อมูลครับ รับข้อมูลแล้ว Wort. Ende 字。"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "key string, text string")
    for chunk in (1, 3, 7, texts[0].index(" "), texts[2].index(" ", 1)):
        got = {r.key: r.ends for r in sentences.once_each(sentences.sentence_table(df, chunk)).collect()}
        assert got == {str(i): sentences.sentence_ends(t) for i, t in enumerate(texts)}, chunk


def test_probes(spark):
    blocks = spark.createDataFrame([("a", "Eins. Zwei."), ("a", "Eins. Zwei."), ("b", None)], "id string, text string")
    chunks = spark.createDataFrame([("a", "Drei.")], "id string, text string")
    probes = spark.createDataFrame([(1, "block", "a"), (2, "chunk", "a"), (3, "block", "b"), (4, "block", "zz"), (1, "block", "a")], "probe_id long, record_kind string, record_id string")
    got = sorted((r.probe_id, r.end_pos) for r in sentences.probed(probes, blocks, chunks).collect())
    assert got == [(1, 5), (1, 11), (2, 5)]
