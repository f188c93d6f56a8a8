"""Text functions: golden cases and agreement of native and Python forms."""

import pytest
from pyspark.sql import functions as F

from textloom.functions import spans
from textloom.functions import text as T


def column(spark, texts, expression):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(expression).collect()]


@pytest.mark.parametrize(
    "source, expected",
    [
        ("mưa🌧rồi", "mưa rồi"),
        ("mệt quá :( về thôi", "mệt quá về thôi"),
        ("gh:pq", "gh:pq"),
        ("ăn kem ;-)) nhé", "ăn kem nhé"),
        ("trang  bìa🎉\n\ntrang  cuối", "trang  bìa\n\ntrang  cuối"),
        ("<3 =D :P", ""),
        ("một hai", "một hai"),
    ],
)
def test_emoji(spark, source, expected):
    assert column(spark, [source], spans.without_emoji("t")) == [expected]


def test_sentence_case():
    assert spans.sentence_case("trời mưa to… ở nhà đọc sách! mai tính tiếp") == "Trời mưa to… Ở nhà đọc sách! Mai tính tiếp"
    assert spans.sentence_case("(máy in HP hỏng.) eBay còn bán. gọi lại sau") == "(Máy in HP hỏng.) eBay còn bán. Gọi lại sau"
    assert spans.sentence_case("7 quả cam. 8 quả táo? chín") == "7 quả cam. 8 quả táo? Chín"


def test_literals():
    text = "www.kho.vn F# 14:05 7,5% GDP iPhone"
    assert [text[a:b] for a, b in spans.protected(text)] == text.split()
    assert spans.names("sáng qua Lê Thị Hoa ghé chợ\nHoa Mai nở") == [(9, 19), (28, 35)]
    assert spans.names("An\nBình") == [] and spans.names("Hà Nội_Huế Đà Nẵng") == [(0, 6), (7, 18)]
    assert spans.is_literal("[GDP];") and not spans.is_literal("gdp") and not spans.is_literal("()")
    assert [text[a:b] for text in ("ghé www.kho.vn/a).", "AB@CD.vn") for a, b in spans.protected(text)] == ["www.kho.vn/a", "AB", "CD"]


def test_layout_keeps_every_character():
    for text in ("日本 x", "100_000 a@b.co, https://x.y/z?q=1", "a\nb\r\n\n c", "  ", "C++ ok…"):
        tokens, suffix = spans.scan_layout(text)
        assert "".join(before + token for token, before, *_ in tokens) + suffix == text


def test_scan_tokens_agree(spark):
    texts = ["tôi đi học, 100_000 a@b.co https://x.y z", "日本 x\n\ny", "a_b-c… 😀"]
    assert column(spark, texts, T.scan_tokens("t")) == [[t[0] for t in spans.scan_layout(x)[0]] for x in texts]


def test_folding(spark):
    texts = ["Đường Ặ ề Ước", "ÀÉ ỹ đ", "plain"]
    assert column(spark, texts, T.fold("t")) == ["duong a e uoc", "ae y d", "plain"] == [spans.fold(x) for x in texts]
    assert column(spark, texts, T.strip_diacritics("t")) == ["Duong A e Uoc", "AE y d", "plain"]
    assert column(spark, ["chu tra"], T.phonetic_fold("t")) == ["tru tra"]


def test_detection(spark):
    texts = ["sang nay em quen mang ao mua", "trẻ nhỏ ở đó vẫn chờ mẹ về", "123456789", "bcd fgh jkl", "ngan"]
    assert column(spark, texts, T.lacks_diacritics("t")) == [True, False, False, False, False]
    assert column(spark, ["", "123 !@#"], T.all_vowels("t")) == [0, 0]
    assert column(spark, ["dk", "ny", "bxh", "em", "d"], T.suspected_abbreviation(F.col("t"))) == [True, False, True, False, True]


def test_questions(spark):
    asked = ["tại sao em buồn", "Vì sao thế  ", "a b\nbao giờ về\n"]
    assert column(spark, asked, T.append_question_mark("t")) == ["tại sao em buồn?", "Vì sao thế?  ", "a b\nbao giờ về?\n"]
    same = ["tại sao", "tôi biết tại sao", "tại sao em buồn?", "bao nhiêu 3 cái", "vì sao NVIDIA tăng"]
    assert column(spark, same, T.append_question_mark("t")) == same


def test_elongation_patterns(spark):
    assert column(spark, ["ngonnnn", "xxoo", "aab"], T.collapse_repeats(F.col("t"), 3)) == ["ngon", "xxoo", "aab"]
    assert column(spark, ["ngonnnn", "xxoo"], T.collapse_repeats(F.col("t"), 2)) == ["ngon", "xo"]


def test_changes(spark):
    pairs = [("a", ""), ("toi", "tôi"), ("Toi", "toi"), ("Toi", "tôi"), ("a b", "ab"), ("abc", "xyz"), ("abcd", "bc")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    kinds = [r[0] for r in rows.orderBy("i").select(T.change_kinds(F.col("a"), F.col("b"))).collect()]
    assert kinds == [["deletion"], ["diacritic", "case"], ["case"], ["diacritic", "case"], ["whitespace"], ["spelling"], ["deletion"]]


def test_lists(spark):
    texts = ['["a", " b ", ""]', '"x"', "plain", "", None, "[broken"]
    assert column(spark, texts, T.string_list(F.col("t"))) == [["a", "b"], ["x"], ["plain"], [], [], ["[broken"]]
    assert column(spark, ["0", "7", "x", None, "-1"], T.confidence(F.col("t"))) == [0.0, 1.0, 1.0, 1.0, 0.0]


def test_spelling_and_punctuation():
    fix = spans.speller({"ngừoi": "người", "ngừoi ta": "người khác", "Sài Gn": "Sài Gòn", "gn": "gần"})
    assert fix("ngừoi ta ở gn") == ("người ta ở gần", [(0, 5, "người"), (11, 13, "gần")])
    assert fix("xngừoi gn_ Bà Sài Gn gn")[0] == "xngừoi gn_ Bà Sài Gn gần"  # part of a word, part of a name
    assert spans.speller({})("gn") == ("gn", [])
    assert spans.lost_punctuation("một; hai", "một hai") == "một; hai" and spans.lost_punctuation("một hai", "một; hai") == "một; hai"
    assert spans.lost_punctuation("mot, hai.", "một hai") == "một, hai."


def test_ngrams(spark):
    assert column(spark, ["a b c", "a", ""], T.ngrams(T.space_tokens("t"), 2)) == [[["a", "b"], ["b", "c"]], [], []]
