"""Restoration, normalization, segments and review on golden cases."""

import json

import pytest
from pyspark.sql import functions as F

from textloom.operators import normalize, restore, review, segments
from textloom.operators.dictionary import Snapshot, phrase_table
from textloom.plans import text_queries
from textloom.sources import assets as assets_of


@pytest.fixture(scope="module")
def snapshot(spark):
    frame = spark.createDataFrame
    abbreviations = frame([("bh", "bây giờ"), ("dc", "được"), ("cx", "cũng"), ("hong", "không"), ("ng", "người"), ("ny", "người yêu")], "abbr string, expanded string")
    details = frame([("ct", ["công ty", "chia tay"])], "abbr string, options array<string>")
    words = frame([("mai",), ("vui",), ("họp",), ("vừa",), ("buồn",), ("ở",)], "word string")
    phrases = phrase_table([frame([("tg bd", "thời gian bắt đầu", "override", "1.0"), ("tg bd sớm", "thời gian sớm", "mined", "1.0")], "phrase string, expanded string, source string, confidence string")])
    return Snapshot(1, abbreviations, details, words, phrases)


def test_normalize(spark, snapshot):
    cases = {
        1: ("bh cx dc mai", "Bây giờ cũng được mai", ["ABBR"]),
        2: ("hong🎈vuiiii", "Không vui", ["ABBR", "ELONGATION", "EMOJI"]),
        3: ("dc :p", "Được", ["ABBR", "EMOJI"]),
        4: (":D <3", "", ["EMOJI"]),
        5: ("vừa ct ny buồn", "Vừa chia tay người yêu buồn", ["ABBR"]),
        6: ("họp ở ct mai", "Họp ở công ty mai", ["ABBR"]),
        7: ("mai tg, bd qx abc", "Mai thời gian bắt đầu qx abc", ["PHRASE"]),
        8: (None, None, []),
        9: ("", "", []),
        10: ("tg bd sớm", "Thời gian sớm", ["PHRASE"]),
        11: ("ct . ny", "Ct. Người yêu", ["ABBR"]),
    }
    frame = spark.createDataFrame([(i, c[0], "clash") for i, c in cases.items()], "doc_id long, text string, value string")
    out = {r.doc_id: r for r in normalize.normalize(frame, snapshot).collect()}
    assert {i: (r.normalized_text, r.error_types) for i, r in out.items()} == {i: c[1:] for i, c in cases.items()}
    assert out[7].pending_keys == ["qx", "qx_abc", "abc"]
    for r in out.values():
        assert all(r.normalized_text[e.start : e.end] == e.expanded for e in r.expanded_abbreviations or [])
    assert [(a.id, a.selected) for a in out[5].ambiguities] == [("ct:0", "chia tay")]


def test_live(spark, snapshot):
    """Typos, lost separators and question marks; expansions are where the finished text has them."""
    frame = spark.createDataFrame([(1, "vì sao ng ta buôồn"), (2, "mai tg bd, hong vui"), (3, "họp dc, cx dc"), (4, "mai tg, bd hong vui")], "doc_id long, text string")
    out = {r.doc_id: r for r in normalize.normalize(frame, snapshot, typos={"buôồn": "buồn"}, live=True).collect()}
    assert {i: r.normalized_text for i, r in out.items()} == {1: "Vì sao người ta buồn?", 2: "Mai thời gian bắt đầu, không vui", 3: "Họp được, cũng được", 4: "Mai thời gian, bắt đầu không vui"}
    said = {i: [(e.abbr, e.expanded) for e in r.expanded_abbreviations] for i, r in out.items()}
    assert said == {1: [("ng", "người")], 2: [("tg bd", "thời gian bắt đầu"), ("hong", "không")], 3: [("dc", "được"), ("cx", "cũng"), ("dc", "được")], 4: [("tg bd", "thời gian, bắt đầu"), ("hong", "không")]}
    for r in out.values():
        assert all(r.normalized_text[e.start : e.end] == e.expanded for e in r.expanded_abbreviations)


@pytest.fixture(scope="module")
def assets(spark):
    forms = spark.createDataFrame([("nghe", 1, "nghệ"), ("nghe", 2, "nghe"), ("nghe", 3, "nghè"), ("toi", 1, "tôi"), ("noi", 1, "nói")], "nd string, rank int, form string")
    bigrams = spark.createDataFrame([("nghe", "nói", 10), ("nghệ", "thuật", 16), ("tôi", "nghe", 3)], "w1 string, w2 string, cnt long")
    phrases = spark.createDataFrame([(["su", "kien"], ["sự", "kiện"]), (["su", "kien", "lon"], ["sự", "kiện", "lớn"])], "key array<string>, val array<string>")
    return forms, bigrams, phrases


def test_restore(spark, assets):
    cases = {1: ("Toi nghe noi, su kien lon.", "Tôi nghe nói, sự kiện lớn."), 2: ("su kiên nhẫn day", "sự kiên nhẫn day"), 3: ("ngan", "ngan"), 4: ("NVIDIA  nghe\txyz abc", "NVIDIA  nghệ\txyz abc"), 5: ("nghe thuật đó", "nghệ thuật đó")}
    frame = spark.createDataFrame([(i, c[0]) for i, c in cases.items()], "doc_id long, text string")
    out = {r.doc_id: r for r in restore.restore(frame, *assets).collect()}
    assert {i: r.restored for i, r in out.items()} == {i: c[1] for i, c in cases.items()}
    assert all(0 <= r.coverage <= 1 for r in out.values())
    proposals = spark.createDataFrame([(2, "sự kiện", 0.8)], "doc_id long, verified_text string, confidence double")
    mixed = {r.doc_id: r.engine for r in restore.hybrid(restore.restore(frame, *assets), proposals).collect()}
    assert mixed[2] == "hybrid" and mixed[1] == "rule" and mixed[3] == "skip"


def test_greedy_matches(spark):
    grams = spark.createDataFrame([(1, 0, 2, "ko bt"), (1, 1, 2, "bt nay"), (1, 3, 2, "a b"), (1, 3, 3, "a b c")], "doc_id int, start int, n int, key string")
    phrases = spark.createDataFrame([("ko bt", "x"), ("bt nay", "y"), ("a b", "z"), ("a b c", "w")], "key string, v string")
    assert sorted((r.start, r.v) for r in restore.greedy_matches(grams, phrases, "key").collect()) == [(0, "x"), (3, "w")]


def test_budget_and_variants(spark):
    keys = spark.createDataFrame([(1, f"k{i}", i) for i in range(5)] + [(1, "k0", 9)], "doc_id int, key string, first_pos int")
    assert sorted((r.key, r.allowed) for r in normalize.within_budget(keys, 3).collect()) == [(f"k{i}", i < 3) for i in range(5)]
    options = F.array(F.array(F.lit("a"), F.lit("b")), F.array(*map(F.lit, "xyz")))
    out = spark.range(1).select(normalize.variants(options, F.array(F.lit("b"), F.lit("x")), 4)).first()[0]
    assert out == [["b", "x"], ["a", "x"], ["a", "y"], ["a", "z"]]


def test_segments(spark):
    texts = ["", "  a b ", " ".join(f"w{i}" + "." * (i % 50 == 49) for i in range(300)) + "\n", "x\n\ny " * 200]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    chunks = segments.explode_chunks(frame)
    assert {r.doc_id: r.text for r in segments.join_chunks(chunks).collect()} == {i: t for i, t in enumerate(texts) if t.strip()}
    assert max(r.end_word - r.start_word for r in chunks.collect()) <= 120
    assert [c[:2] for c in segments.cut(texts[2])] == [(0, 100), (100, 200), (200, 300)]


def test_review_policy():
    assert review.accept("chời mưa to", "trời mưa to", 0.9)[0] == "trời mưa to"
    assert review.accept("hong vui", "không vui", 0.3, {"hong": ["không"]})[0] == "không vui"
    for source, proposed in [("nó chưa về", "nó sắp về"), ("mua 20 quả", "mua 25 quả"), ("xem www.kho.vn nhé", "xem www.kha.vn nhé"), ("chị Hoà tới", "chị Hòa tới"), ("mưa to", "mưa to. Lạnh lắm")]:
        assert review.accept(source, proposed, 0.9)[0] == source
    assert review.accept("trời nang", "trời nắng", 0.5)[0] == "trời nang"
    assert review.edit_budget(10) == 4 and review.edit_budget(1000) == 24
    assert review.Windows("mai tg bd nha", "mai thời gian bắt đầu nha").window(5, 6, 1) == ("nha", "bd", "")


def test_review_guards():
    """Each guard turns down an edit that passes all before it."""
    cases = {
        "words": ("mưa", "mưa to", {"edit": (3, "", " to")}),
        "confidence": ("nang to", "nắng to", {"confidence": 0.0}),
        "literal": ("xem www.kho", "xem www.khô", {}),
        "facts": ("số b", "số 4", {}),
        "unsure": ("nang to", "nắng to", {"confidence": 0.4}),
        "growth": ("đi nha", "đi nha trang", {"edit": (3, "nha", "nha trang")}),
        "similarity": ("đi bơi", "đi ngủ", {}),
        "lost accents": ("trời nắng", "trời nang", {}),
        "negation": ("đi không", "đi hồng", {}),
        "word map": ("trời nang", "trời năng", {"forms": {"nang": ["nắng"]}}),
        "name": ("gặp Lan", "gặp Lân", {}),
    }
    assert list(cases) == list(review.GUARDS)
    for name, (source, proposed, more) in cases.items():
        at = next((i for i, (a, b) in enumerate(zip(source, proposed, strict=False)) if a != b), 0)
        at = source.rfind(" ", 0, at + 1) + 1
        start, before, after = more.get("edit", (at, source[at:], proposed[at:]))
        setting = review.Setting(source, more.get("confidence", 0.9), {}, more.get("forms", {}), [(4, 11)] if name == "literal" else [], [])
        assert review.refusal(review.Edit(start, before, after, setting), setting) == name


def test_review_has_licences_and_originals(spark):
    """Options, word-map forms and originals reach the policy by the tables of a chunk's words."""
    cases = [(1, "Ko di", "không di", 0.3, None), (2, "tôi ăn ca", "tôi ăn cá", 0.9, None), (3, "tôi ăn ca", "tôi ăn cà", 0.9, None), (4, "em đăng ky nha", "em đăng ký học phần nha", 0.9, "em dk nha"), (5, "x di", "không di", 0.3, None)]
    chunks = spark.createDataFrame([(i, 0, "", text, "", original) for i, text, _, _, original in cases], "doc_id int, chunk int, lead string, text string, tail string, original string")
    proposals = spark.createDataFrame([(i, 0, new, conf, "ok") for i, _, new, conf, _ in cases], "doc_id int, chunk int, proposed string, confidence double, status string")
    options = spark.createDataFrame([("KO", ["không"]), ("zz", ["x"])], "abbr string, options array<string>")
    forms = spark.createDataFrame([("ca", "cá"), ("ca", "cả"), ("khac", "khác")], "nd string, form string")
    out = {r.doc_id: r.reviewed for r in review.review(chunks, proposals, options, forms).collect()}
    whole = {i: review.accept(text, new, conf, {"ko": ["không"]}, {"ca": ["cá", "cả"]}, original or "")[0] for i, text, new, conf, original in cases}
    assert out == whole and [out[i] for i in range(1, 6)] == ["không di", "tôi ăn cá", "tôi ăn ca", "em đăng ký học phần nha", "x di"]


def test_review_status(spark):
    rows = [(1, 0, "verified"), (1, 1, "verified"), (2, 0, "verified"), (2, 1, "error"), (3, 0, "quota"), (4, 0, "uncertain"), (5, 0, "not_checked")]
    frame = spark.createDataFrame([(*r, 0.9) for r in rows], "doc_id int, chunk int, status string, confidence double")
    assert {r.doc_id: r.status for r in review.document_status(frame).collect()} == {1: "verified", 2: "partial", 3: "quota", 4: "uncertain", 5: "not_checked"}


def test_replies(spark):
    texts = ['{"choice": "a", "confidence": 0.5}', '```json\n{"choice": " z "}\n```', "none", 'x {"choice": "b"} y', "{broken", None]
    frame = spark.createDataFrame([(i, t, ["a", "b"]) for i, t in enumerate(texts)], "i int, reply string, options array<string>")
    out = {r.i: (r.choice, r.is_new) for r in review.disambiguated(frame).collect()}
    assert out == {0: ("a", False), 1: ("z", True), 2: (None, None), 3: ("b", False), 4: (None, None), 5: (None, None)}


def test_turns_of_long_conversations_stay_apart(spark, tmp_path):
    """Turn 1000 of a conversation isn't turn 0 of the next."""
    turns = [(1, 0), (1, 1), (1, 999), (1, 1000), (1, 1001), (1, 2001), (2, 0), (2, 1), (3, 1)]
    rows = [(*t, f"{w} turn") for t, w in zip(turns, ["alpha", "bravo", "carol", "delta", "echo", "fox", "golf", "hotel", "india"], strict=True)]
    tables = {"conversations": (rows, "conv_id long, turn int, text string"), "benchmark": ([(1, "one two")], "item_id long, text string"), "part": ([("qqq wide",)], "p_name string"), "documents": ([(1, "fr", "voilà l'été")], "doc_id long, lang string, text string")}
    for name, (given, schema) in tables.items():
        spark.createDataFrame(given, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    out = [(r.conv_id, r.turn, r.normalized_text) for r in text_queries.normalize_conversations(spark, str(tmp_path)).collect()]
    assert sorted((c, t, text.lower().rstrip(".?")) for c, t, text in out) == sorted(rows)


def test_assets(spark, tmp_path):
    """Files over built-in entries: the word map's file wins, built-in phrases win; a missing file is empty."""
    files = {"words": {"thi": ["thi"], "da": "đã"}, "pairs": {"tôi_đi": 3, "odd": 1}, "phrases": {"Di hoc": "đi học", "a b": "x", "one": "một", "su kien": "sứ kiện"}}
    for name, value in files.items():
        (tmp_path / name).write_text(json.dumps(value, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "shots").write_text(json.dumps([{"no_diacritics": str(i), "with_diacritics": "x"} for i in range(5)]), encoding="utf-8")
    found = assets_of.word_map(spark, str(tmp_path / "words")).collect()
    assert {(r.nd, r.rank, r.form) for r in found if r.nd in ("thi", "da", "met", "vai")} == {("thi", 1, "thi"), ("da", 1, "đã"), ("met", 1, "mệt"), ("vai", 1, "vài"), ("vai", 2, "vai")}
    assert [tuple(r) for r in assets_of.bigrams(spark, str(tmp_path / "pairs")).collect()] == [("tôi", "đi", 3)]
    builtin = spark.createDataFrame([(["su", "kien"], ["sự", "kiện"])], "key array<string>, val array<string>")
    phrases = assets_of.context_phrases(spark, str(tmp_path / "phrases"), builtin)
    assert sorted(map(tuple, phrases.collect())) == [(["di", "hoc"], ["đi", "học"]), (["su", "kien"], ["sự", "kiện"])]
    assert [r.no_diacritics for r in assets_of.few_shot(spark, str(tmp_path / "shots"), 2).collect()] == ["0", "1"]
    gone = str(tmp_path / "none")
    assert assets_of.word_map(spark, gone, {}).count() == assets_of.bigrams(spark, gone).count() == assets_of.few_shot(spark, gone).count() == 0
    texts = spark.createDataFrame([(1, "su kien thi di hoc")], "doc_id long, text string")
    out = restore.restore(texts, assets_of.word_map(spark, str(tmp_path / "words")), assets_of.bigrams(spark, str(tmp_path / "pairs")), phrases).first()
    assert out.restored == "sự kiện thi đi học"
