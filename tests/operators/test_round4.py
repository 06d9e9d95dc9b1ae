from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.sources import files


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_extraction_normalises_once(spark):
    """rejects are told from the texts as they are; records take one way through the normaliser and no list of single letters."""
    texts = ["", " \n\t ", None, "‌ ­", "ـً  \x07", "ۥ‌ۦ", "﻿ 　", "x", " . ", "́", "‌س‌", "سلام، این متن فارسی است", "An English text of é letters", "İ", "7"]
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id int, text string")
    good, bad = files.extraction(docs)
    assert sorted(r["doc_id"] for r in bad.collect()) == list(range(7)) and bad.first()["error_code"] == "empty_content"
    got = {r["doc_id"]: (r["text"], r["char_count"], r["language"], r["warnings"]) for r in good.collect()}
    own = {r["doc_id"]: r["t"] for r in docs.select("doc_id", T.normalize("text").alias("t")).where(~T.blank("t")).collect()}
    assert {n: x[0] for n, x in got.items()} == own and sorted(got) == list(range(7, len(texts)))
    assert got[11][2:] == ("fa", []) and got[12][1:] == (28, "en", []) and got[7][1:] == (1, "unknown", ["language_detection_uncertain"])
    small = plan(good.select("doc_id", "char_count", "language"))
    assert small.count("ArrowEvalPython") == 1 and "ArrowEvalPython" not in plan(bad) and "extract_all" not in small


def test_letters_counted_by_runs(spark):
    """the shares are those of single characters, of ASCII texts, of letters beyond it and of marks and digits among Arabic ones."""
    texts = ["a" * 19, "a" * 20, "1" * 20, "é" * 20, "é" * 8 + "b" * 12, "é" * 9 + "b" * 11, "س" * 12 + "b" * 8, "س" * 11 + "b" * 9, "۱" * 12 + "b" * 20, "۱" * 12 + "b" * 18 + "é", "𝒜" * 8 + "b" * 12, "b 1é. " * 5, None]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    one = lambda p: F.regexp_count("t", F.lit(p))
    shares = rows.select("n", "t", (one(r"[\x{0600}-\x{06FF}]") / F.greatest(one(r"\p{L}"), F.lit(1))).alias("fa"), (one("[A-Za-z]") / F.greatest(one(r"\p{L}"), F.lit(1))).alias("en"))
    want = F.when(F.length("t") < 20, "unknown").when(F.col("fa") >= 0.6, "fa").when(F.col("en") >= 0.6, "en").otherwise("unknown")
    got = [(r["a"], r["b"]) for r in shares.orderBy("n").select(want.alias("a"), T.language("t").alias("b")).collect()]
    assert [b for _, b in got] == ["unknown", "en", "unknown", "unknown", "en", "unknown", "fa", "unknown", "fa", "fa", "en", "unknown", "unknown"] and all(a == b for a, b in got)
    assert "extract_all" not in plan(rows.select(T.language("t")))
