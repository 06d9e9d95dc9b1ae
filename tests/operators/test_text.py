import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.sources import files

Z = "‌"


def value(spark, text, f):
    return spark.createDataFrame([(text,)], "x string").select(f("x").alias("y")).first()["y"]


@pytest.mark.parametrize("raw,expected", [
    ("كتاب عربي", "کتاب عربی"), ("سال ۱۴۰۲ و ٣", "سال 1402 و 3"), ("کتـــاب", "کتاب"), ("مُحَمَّد", "محمد"), ("!!! چرا؟؟", "! چرا؟"), ("صبر.....", "صبر..."), ("صبر…", "صبر..."),
    ("می" + Z + Z + "شود", "می" + Z + "شود"), (Z + "سلام" + Z, "سلام"), ("الف" + Z + " ب", "الف ب"), ("a\r\nb\rc", "a\nb\nc"), ("  a  \t b  \n\n c ", "a b\n\nc"), ("“x” ‘y’", "\"x\" 'y'"),
    ("a b﻿​", "a b"), ("é", "é"), ("a\x01b", "ab"), ("هٔ", "هٔ"), ("", ""), (None, None)])
def test_normalize(spark, raw, expected):
    once = value(spark, raw, T.normalize)
    assert once == expected and value(spark, once, T.normalize) == once


def test_markdown(spark):
    assert value(spark, "# T\n![a](b) [c](d) `e` **f** _g_\n```\nx\n```\n## h", T.strip_markdown) == "T\na c e f g\n\nh"


def test_language(spark):
    texts = ["کوتاه", "این یک متن فارسی بلند برای آزمایش است", "this is a longer English sentence", "1234567890 1234567890 12"]
    assert [value(spark, t, T.language) for t in texts] == ["unknown", "fa", "en", "unknown"]


def test_tokens(spark):
    assert value(spark, "پیش" + Z + "نیاز Straße آیا؟ x", T.lexical_tokens) == ["پیشنیاز", "strasse", "آیا", "x"]
    assert value(spark, "پیش" + Z + "نیاز و چیست؟ the X ab", T.content_tokens) == ["پیش", "نیاز", "چیست؟", "ab"]
    assert value(spark, "یک کتاب است کتاب خوب", T.keywords) == ["کتاب", "خوب"]
    assert value(spark, "a b c d", T.phrases) == ["a b c", "b c d", "a b", "b c", "c d"]
    assert value(spark, "Chrome 12 مرورگر http ab", T.entities) == ["chrome", "مرورگر", "http"]


def test_questions_and_numbers(spark):
    assert value(spark, "چرا؟\nمتن بلند است؟ بعد\nچرا؟\nno", T.question_lines) == ["چرا؟", "متن بلند است؟"]
    assert value(spark, "سال 0012 و ۷ و 12345 x9", T.short_numbers) == ["12", "7"]
    assert value(spark, "One. Two? سه؟ چهار", T.sentences) == ["One.", "Two?", "سه؟", "چهار"]


def test_variants(spark):
    assert value(spark, "کتاب های خوب؟", T.with_half_spaces) == "کتاب" + Z + "های خوب؟"
    assert value(spark, "خوب؟", T.noisy_punctuation) == "خوب؟؟!!" and value(spark, "۱2", T.to_arabic_digits) == "١٢"
    assert value(spark, "ي ۱2  x", T.surface_issues) == ["arabic_yeh_or_kaf", "whitespace", "mixed_digits", "differs_from_production_normalize"]
    assert value(spark, "- a\nb |x|y|", T.looks_like_list) and value(spark, "a|b|c|d", T.looks_like_table)
    assert value(spark, "wrapped\nline. next\n- item\n- two", T.reflow) == "wrapped line. next\n- item\n- two"
    assert value(spark, "کتاب ، خوب", T.repair_glyphs) == "کتاب، خوب"
    assert value(spark, "Ａb " + Z + "ß", T.marker_key) == "abss"


def test_jaccard(spark):
    row = spark.sql("select array('a','b') a, array('b','c') b, cast(array() as array<string>) n").select(T.jaccard(F.col("a"), F.col("b")).alias("x"), T.jaccard(F.col("a"), F.col("n")).alias("y")).first()
    assert abs(row["x"] - 1 / 3) < 1e-12 and row["y"] == 0


def test_html():
    assert files.visible_text("<p>a<script>x</script> &amp; b</p><style>y</style><div>c</div>") == "a\n& b\nc"


def test_margins(spark):
    pages = [(1, k, f"Header\nbody {k}\nmore\nrest\nPage {k}") for k in range(1, 4)] + [(2, 1, "Header\nx")]
    got = {(r["doc_id"], r["page"]): r["text"] for r in files.without_margins(spark.createDataFrame(pages, "doc_id int, page int, text string")).collect()}
    assert got[(1, 2)] == "more"
    assert got[(2, 1)] == "Header\nx"


def test_language_whole(spark):
    """The whole text counts; a prefix is a parameter."""
    df = spark.range(1).selectExpr("concat(repeat('a', 10000), repeat('س', 30000)) as t")
    assert tuple(df.select(T.language("t"), T.language("t", first=10_000)).first()) == ("fa", "en")
