import math

import numpy as np
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import context, evidence, ranking
from docloom.operators import retrieval as R


def chunks(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, document_id string, chunk_index int, heading string, text string")


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, query string").withColumn("tokens", T.lexical_tokens("query"))


FAQ = [("a", "d1", 0, None, "رمز عبور اولیه چیست؟\nرمز اولیه کد ملی است.\nرمز را فراموش کردم؟\nبازیابی رمز از سامانه."), ("b", "d1", 1, "مرورگر", "مرورگر مناسب Chrome نسخه 90 است."), ("c", "d2", 0, None, "ساعت کار کتابخانه 8 تا 16 است.")]


def test_segments(spark):
    got = R.segments(chunks(spark, FAQ)).groupBy("chunk_id").count().collect()
    assert {r["chunk_id"]: r["count"] for r in got} == {"a": 3, "b": 1, "c": 1}


def test_bm25_by_hand(spark):
    docs = chunks(spark, [("x", "d", 0, None, "a b b"), ("y", "d", 1, None, "a c"), ("z", "d", 2, None, "c")])
    got = {r["chunk_id"]: r["score"] for r in R.bm25(R.segments(docs), asked(spark, "b a b")).collect()}
    idf = lambda df: math.log(1 + (3 - df + 0.5) / (df + 0.5))
    part = lambda tf, n: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / 2))
    assert abs(got["x"] - (2 * idf(1) * part(2, 3) + idf(2) * part(1, 3))) < 1e-9 and abs(got["y"] - idf(2) * part(1, 2)) < 1e-9 and "z" not in got


def test_boosts(spark):
    q, k = asked(spark, "رمز عبور اولیه چیست؟", "مرورگر Chrome"), chunks(spark, FAQ)
    plain = {(r["query_id"], r["chunk_id"]): r["score"] for r in R.bm25(R.segments(k), q).collect()}
    boosted = {(r["query_id"], r["chunk_id"]): r["score"] for r in R.boost(R.bm25(R.segments(k), q), q, k).collect()}
    assert abs(boosted[(0, "a")] / plain[(0, "a")] - 2.2 * 1.25) < 1e-9
    assert abs(boosted[(1, "b")] / plain[(1, "b")] - 1.25 * 1.25) < 1e-9 or abs(boosted[(1, "b")] / plain[(1, "b")] - 1.25) < 1e-9


def test_fusion(spark):
    one = spark.createDataFrame([(0, "a", 1, .9), (0, "b", 2, .8)], "query_id int, chunk_id string, rank int, score double")
    two = spark.createDataFrame([(0, "b", 1, 5.), (0, "c", 2, 4.)], "query_id int, chunk_id string, rank int, score double")
    got = [(r["chunk_id"], round(r["rrf"], 6)) for r in R.fuse(one, two).orderBy("rank").collect()]
    assert got == [("b", round(1 / 62 + 1 / 61, 6)), ("a", round(1 / 61, 6)), ("c", round(1 / 62, 6))]
    v = spark.range(1).select(R.blend(F.lit(.5), F.lit(.01), F.lit(.02)).alias("x"), R.blend(F.lit(1.5), F.lit(0.), F.lit(0.)).alias("y"), R.pool_size(F.lit(5)).alias("p"), R.pool_size(F.lit(40)).alias("r")).first()
    assert (round(v["x"], 6), v["y"], v["p"], v["r"]) == (0.5, 1.0, 13, 50)


def test_cosine_and_backfill(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, vector array<double>")
    held = spark.createDataFrame([("a", "d", 0, [1.0, 1.0]), ("b", "d", 1, [-1.0, 0.0]), ("z", "d", 2, [0.0, 0.0])], "chunk_id string, document_id string, chunk_index int, vector array<double>")
    got = {r["chunk_id"]: round(r["score"], 6) for r in R.dense_top_k(rows, held, 3).collect()}
    assert got == {"a": 0.707107, "b": 0.0, "z": 0.0}
    fused = spark.createDataFrame([(0, "a"), (0, "q")], "query_id int, chunk_id string")
    dense = spark.createDataFrame([(0, "b", 1.0)], "query_id int, chunk_id string, score double")
    assert {r["chunk_id"]: round(r["cosine"], 3) for r in R.cosine_backfill(fused, dense, rows, held).collect()} == {"a": 0.707, "q": 0.0}


def hits(spark, query, *rows):
    data = [(0, query, i, c, d, k, t, h, s, i + 1) for i, (c, d, k, t, h, s) in enumerate(rows)]
    return spark.createDataFrame(data, "query_id int, query string, i int, chunk_id string, document_id string, chunk_index int, text string, heading string, score double, rank int")


def test_calibration(spark):
    h = hits(spark, "رمز عبور اولیه چیست؟", ("a", "d", 0, "رمز عبور اولیه چیست؟\nکد ملی", "", 0.60), ("b", "d", 1, "فراموشی رمز؟\nاز سامانه", "", 0.62))
    got = ranking.reasons(ranking.final_order(ranking.calibrate(h), 2)).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == ["a", "b"] and set(got[0]["bonuses"]) >= {"faq_question_overlap", "exact_phrase", "body_token_overlap"}
    assert "distractor_faq" in got[1]["penalties"] and abs(got[0]["adjusted"] - 0.78) < 1e-9
    assert got[0]["reasons_won"][0].startswith("highest_adjusted_score; top_bonus=faq_question_overlap") and got[1]["reasons_lost"][0].startswith("behind_rank1_by=")


def test_evidence(spark):
    h = hits(spark, "شهریه ترم 2 چقدر است؟", ("a", "d", 0, "شهریه ترم 2 چقدر است؟\nشهریه 500 است.", "شهریه", .9), ("b", "d", 1, "کتابخانه باز است", "", .5), ("c", "e", 7, "xyz", "", .1))
    got = {r["chunk_id"]: r for r in evidence.select(h).collect()}
    assert got["a"]["label"] == "PRIMARY" and got["c"]["label"] == "IRRELEVANT" and got["a"]["section_proximity"] == 1.0 and got["b"]["section_proximity"] == 0.7
    assert got["a"]["reason"].startswith("faq_match+exact_phrase+numeric_agreement")
    d = evidence.diagnostics(evidence.select(h)).first()
    assert d["primary_ids"] == ["a"] and d["original_chars"] == sum(len(x) for x in ("شهریه ترم 2 چقدر است؟\nشهریه 500 است.", "کتابخانه باز است", "xyz"))


def test_conflict(spark):
    h = hits(spark, "ظرفیت 7 چند است", ("a", "d", 0, "ظرفیت 10 نفر", "", .9), ("b", "d", 1, "ظرفیت 12 نفر", "", .9)).withColumns({"label": F.lit("PRIMARY"), "selection_score": F.lit(.5)})
    r = evidence.conflicts(h).first()
    assert (r["conflict"], r["conflict_reason"]) == (True, "numeric_disagreement_among_primary")


def test_context(spark):
    long = " ".join(f"w{k}" for k in range(60))
    h = hits(spark, "q", ("a", "d", 1, "hello world again", "H", .9), ("b", "d", 2, "world again and more", "H", .8), ("c", "e", 5, long, None, .7), ("x", "e", 9, long + " tail", None, .6)).withColumn("document_version_id", F.col("document_id"))
    d = context.deduplicate(h)
    assert [r["chunk_id"] for r in d.where("duplicate").collect()] == ["x"]
    b = context.blocks(d.where("not duplicate")).orderBy("block").collect()
    assert b[0]["text"] == "hello world again and more" and b[0]["chunk_ids"] == ["a", "b"] and b[0]["heading"] == "H" and b[1]["primary_id"] == "c"
    m = [(r["marker"], r["chunk_id"]) for r in context.markers(context.blocks(d.where("not duplicate"))).orderBy("marker").collect()]
    assert m == [(1, "a"), (2, "b"), (3, "c")]
    q = spark.createDataFrame([(0, "q")], "query_id int, query string")
    hist = spark.createDataFrame([(0, k, "user", "t" * 50) for k in range(4)], "query_id int, seq int, role string, content string")
    made = context.blocks(d.where("not duplicate"))
    p = context.prompts(q, hist, made, budget=420, fixed=10).first()
    assert p["dropped_blocks"] == 0 and 0 < p["dropped_turns"] < 4 and p["error_code"] is None
    assert context.prompts(q, hist, made, budget=20, fixed=10).first()["error_code"] == "prompt_too_large"


def test_answers(spark):
    def f(col, *texts):
        return [r["y"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").orderBy("i").select(col(F.col("x")).alias("y")).collect()]

    assert f(context.abstention, "ABSTAIN", "abstain: low_score [1]", "ABSTAIN:\nno_data", "An answer with ABSTAIN inside that is long enough", "ok", None)[:2] == ["insufficient_evidence", "low_score"]
    assert f(context.abstention, "An answer with ABSTAIN inside that is long enough", "ok", None) == [None, None, None]
    assert f(context.citation_markers, "x [2] y [1] [2]") == [["2", "1"]]
    assert f(context.substantive, "[1] [2] short", "long enough text [1]") == [False, True]
    assert f(lambda c: context.without_echo(F.lit("What is it?"), c), "What  is it? - A thing", "What is it?", "Other") == ["A thing", "What is it?", "Other"]


def test_outcomes(spark):
    h = hits(spark, "q", ("a", "d", 1, "some text here", "", .9)).withColumn("document_version_id", F.col("document_id"))
    more = h.withColumn("query_id", F.lit(1)).withColumn("score", F.lit(.1)).unionByName(h).unionByName(h.withColumn("query_id", F.lit(2))).unionByName(h.withColumn("query_id", F.lit(3)))
    m = context.markers(context.blocks(more))
    a = spark.createDataFrame([(0, "q", "a good answer [1]", None), (1, "q", "a good answer", None), (2, "q", "a good answer", None), (3, "q", "x", "timeout")], "query_id int, query string, answer string, failure string")
    got = {r["query_id"]: (r["status"], r["reason"], r["final_answer"], r["cited_ids"]) for r in context.outcomes(a, more, m, more).collect()}
    assert got[0] == ("completed", None, "a good answer [1]", ["a"]) and got[1] == ("abstained", "insufficient_evidence", None, None)
    assert got[2] == ("completed", None, "a good answer [1]", ["a"]) and got[3][:2] == ("failed", "timeout")


def test_dense_blocks(spark):
    """Queries in several blocks give the exact lists of a plain computation."""
    r = np.random.default_rng(3)
    x = r.standard_normal((400, 16))
    x[7] = x[8]
    held = spark.createDataFrame([(i, i // 2, i % 2, v.tolist()) for i, v in enumerate(x)], "chunk_id int, document_id int, chunk_index int, vector array<double>")
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 400, 20)] + [(999, [0.0] * 16), (998, [1.0])], "query_id int, vector array<double>")
    got = {}
    for row in R.dense_top_k(q, held, 5, block=6).collect():
        got.setdefault(row["query_id"], {})[row["rank"]] = (row["chunk_id"], round(row["score"], 9))
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    for i in range(0, 400, 20):
        s = np.clip(unit @ unit[i], 0, 1)
        want = sorted(range(400), key=lambda k: (-round(s[k], 12), k // 2, k % 2))[:5]
        assert [got[i][n + 1][0] for n in range(5)] == want
    assert [got[999][n + 1] for n in range(5)] == [(n, 0.0) for n in range(5)] == [got[998][n + 1] for n in range(5)]
