import re
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import chunking, context, diagnostics, lexical, metrics, questions, retrieval
from docloom.plans import queries as plans
from docloom.streaming import index_stream


def test_lines_keep_digits_of_their_number(spark):
    """the number of a line, or of a block, is not what is trimmed from it."""
    rows = spark.createDataFrame([("end 170 \n 11 mice. \n2 cats 2",)], "text string")
    assert rows.select(T.reflow("text")).first()[0] == "end 170 11 mice.\n2 cats 2"
    assert rows.select(chunking.block_kind(F.lit("0. a\n1. b\n"))).first()[0] == "list"
    blocks = chunking.paragraphs(spark.createDataFrame([(1, "x 0 \n\n1 y")], "doc_id int, text string"))
    assert [r["text"] for r in blocks.orderBy("block").collect()] == ["x 0", "1 y"]


def test_blocks_of_equal_scores_stand_by_document(spark):
    """Scores that differ in their last bits alone are equal, as search has it."""
    rows = [(1, n, n, n, 0, "", s, f"text {n}", rank) for rank, (n, s) in enumerate([(3, 12.3), (7, 12.3 + 4e-15), (9, 15.0)])]
    hits = spark.createDataFrame(rows, "query_id int, chunk_id int, document_id int, document_version_id int, chunk_index int, heading string, score double, text string, rank int")
    assert [r["primary_id"] for r in context.blocks(hits).orderBy("block").collect()] == [9, 3, 7]
    assert [r["chunk_id"] for r in context.presentation(hits).orderBy("place").collect()] == [9, 3, 7]


@pytest.mark.parametrize("value", [0.2 - 3e-17, 0.2, 0.2 + 3e-17])
def test_limits_hold_to_nine_places(spark, value):
    """the order in which a mean was summed decides no limit, and no half of a last place."""
    m = spark.createDataFrame([("a", value), ("b", 0.1999)], "experiment_id string, mrr double")
    o = spark.createDataFrame([("a", "ok"), ("b", "ok")], "experiment_id string, status string")
    assert {r["experiment_id"]: r["failing"] for r in metrics.gates(m, o, {"mrr": 0.2}).collect()} == {"a": [], "b": ["mrr"]}
    assert {r["experiment_id"]: r["trusted"] for r in diagnostics.trust_rows(m, {"mrr": 0.2}).collect()} == {"a": True, "b": False}
    assert {spark.range(1).select(plans.half_up(F.lit(x))).first()[0] for x in (0.2328125, 0.23281249999999998)} == {0.232813}


def test_questions_once_each(spark):
    """the first of equal questions stays, in its place, in time that grows with the text."""
    text = "\n".join(f"Question number {n % 1500}?" if n % 2 else f"QUESTION NUMBER {n % 1500}?" for n in range(3000, 0, -1))
    rows = spark.createDataFrame([(text,), (None,)], "text string").select(T.question_lines("text").alias("q"))
    own, none = (r["q"] for r in rows.collect())
    assert none is None and own == [x for n, x in enumerate(text.split("\n")) if n < 1500]


def test_shards_end_at_their_tokens(spark):
    """F6-F9 and others: one Arrow batch of many tokens becomes many shards, each of whole chunks, which together hold every posting."""
    rows = spark.createDataFrame([(n // 3, n % 3, [f"w{n % 7}", "all", "all"]) for n in range(600)], "chunk_id bigint, segment int, tokens array<string>").coalesce(1)
    made = lexical.blocks(rows, shard_tokens=90).collect()
    heads = [r for r in made if r["token"] == ""]
    assert len(heads) == 20 and all(sum(r["counts"]) == 90 for r in heads) and sorted(x for r in heads for x in r["chunk_ids"]) == list(range(200))
    assert sum(sum(r["counts"]) for r in made if r["token"] == "all") == 1200
    assert len([r for r in lexical.blocks(rows, shard=30).collect() if r["token"] == ""]) == 20
    q = spark.createDataFrame([(1, ["all", "w3"])], "query_id int, tokens array<string>")
    few, many = ([tuple(r) for r in retrieval.ranked_hits(lexical.search(b, lexical.size(b), q, 5), 5).select("chunk_id", "rank").collect()] for b in (lexical.blocks(rows), lexical.blocks(rows, shard_tokens=90)))
    assert sorted(few) == sorted(many)


def test_pieces_leave_by_few_texts(spark, monkeypatch):
    """pieces of a batch leave it a few texts at a time, with texts without pieces on demand."""
    monkeypatch.setattr(T, "AT_ONCE", 2)
    texts = ["one. two.", None, "", "x" * 3000, " ", "last"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    want = {(n, k, p["text"]) for n, t in enumerate(texts) for k, p in enumerate(chunking.split_document(t))}
    assert {(r["doc_id"], r["sequence_number"], r["text"]) for r in chunking.pieces(docs).collect()} == want
    assert {(r["doc_id"], r["sequence_number"], r["text"]) for r in chunking.pieces(docs, outer=True).collect()} == want | {(1, None, None), (2, None, None), (4, None, None)}


@pytest.mark.parametrize("many", [0, 1, 256, 257, 1000])
def test_values_pass_in_parts(many):
    """the parts of an Arrow batch come back whole and in order."""
    values = pa.array([None if n % 10 == 3 else f"é{n}" for n in range(many)], pa.string())
    assert T.each(values, lambda x: x and x.upper()).to_pylist() == [x and x.upper() for x in values.to_pylist()]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_questions_take_two_shuffles(spark):
    """one shuffle of a short row for each sentence, one of the chunks; questions, choices and passages take none."""
    rows = [("a", f"a-{n}", n, f"سیاست شماره {n} باید تا مهلت {n} روز توسط مدیر واحد تکمیل شود.") for n in range(90)] + [("b", "b-0", 0, "a head without sentence")]
    out = questions.ground_truth(spark.createDataFrame(rows, "document_id string, chunk_id string, chunk_index int, text string"), 5, 7)
    assert exchanges(out) == 2
    got = sorted((r["document_id"], r["ordinal"], r["category"]) for r in out.collect())
    n = len([g for g in got if g[0] == "a"])
    assert 5 <= n <= 7 and [g[1] for g in got[:n]] == list(range(1, n + 1)) and len({g[2] for g in got[:n]}) == n
    assert {g[2] for g in got[n:]} == {"factual"} and 5 <= len(got) - n <= 7


def test_process_reads_texts_once(spark):
    """outcomes come from the chunks as written; nothing is normalised or split again for them, and versions without chunks stand there too."""
    v = spark.createDataFrame([(n, f"d{n}", f"v{n}", t) for n, t in enumerate(["one text.", None, " \n ", "one text.", "bad one.", "", "another."])], "doc_id long, document_id string, document_version_id string, text string")

    def make():
        def embed(texts):
            if any("bad" in t for t in texts):
                raise ValueError
            return [[float(len(t))] for t in texts]
        return embed

    rows, outcome = index_stream.process(v, make, "m", 1)
    plan = outcome._jdf.queryExecution().optimizedPlan().toString()
    assert "nfc" not in plan and "MapInArrow" not in plan and not re.search(r"\btext#", re.sub(r"Relation \[[^]]*\]", "", plan))
    got = {r["document_id"]: (r["created"], r["skipped"], r["failed"], r["failure_reason"], r["processing_status"]) for r in outcome.collect()}
    empty, good = (0, 0, 0, "empty_content", "failed"), (1, 0, 0, None, "indexed")
    assert got == {"d0": good, "d1": empty, "d2": empty, "d3": good, "d4": (0, 0, 1, "partial_embedding_failure", "failed"), "d5": empty, "d6": good}
    assert sorted((r["chunk_id"], r["text"], r["vector"]) for r in rows.collect()) == [("0-0", "one text.", [9.0]), ("3-0", "one text.", [9.0]), ("6-0", "another.", [8.0])]
    _, again = index_stream.process(v.where("doc_id in (0, 4, 6)").withColumn("text", F.when(F.col("doc_id") == 6, "new.").otherwise(F.col("text"))), make, "m", 1, rows)
    assert {r["document_id"]: (r["created"], r["skipped"], r["failed"]) for r in again.collect()} == {"d0": (0, 1, 0), "d4": (0, 0, 1), "d6": (1, 0, 0)}


def test_normaliser_leaves_what_needs_no_step(spark):
    """of texts of plain letters only those that a step can change go through the steps; the answer is the steps' own."""
    texts = ["plain text, é.", " a\nb ", "a!!", "a??b", "x,,,y", "a;;", "a::", "a....b", "a  b", "a\tb", "a \nb", "a\n b", "a\rb", "a\x07b", "a\x7f", "a\t\nb", "", None, "يك!!", "a​b"]
    got = [r[0] for r in spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string").orderBy("n").select(T.normalize("t")).collect()]
    assert got == ["plain text, é.", "a\nb", "a!", "a?b", "x,y", "a;", "a:", "a...b", "a b", "a b", "a\nb", "a\nb", "a\nb", "ab", "a", "a\nb", "", None, "یک!", "ab"]
    blank = spark.createDataFrame([(t,) for t in ["", " \n 　", None, "a", " a "]], "t string").select(T.blank("t")).collect()
    assert [r[0] for r in blank] == [True, True, True, False, False]


def test_frequencies_are_counted_where_texts_are_read(spark):
    """one pass gives the segments of each token and, with the empty token, of all; postings are not shuffled."""
    chunks = spark.createDataFrame([(1, "", "a b a\nc"), (2, "h", "b? is it c d"), (3, "", " \n "), (4, None, None), (5, "", "B")], "chunk_id long, heading string, text string")
    df = retrieval.document_frequency(retrieval.segments(chunks))
    assert exchanges(df) == 1
    own = [set(r["tokens"]) for r in retrieval.segments(chunks).collect()]
    assert {r["token"]: r["df"] for r in df.collect()} == {"": len(own)} | {t: sum(t in o for o in own) for o in own for t in o}
    assert {"a", "b", "c"} in own and {"b"} in own


def test_style_folds_only_what_may_be_an_echo(spark, monkeypatch):
    """answers whose first words are not their question's take no key; sigmas, markers and short answers are folded as the whole is."""
    seen = spark.sparkContext.accumulator(0)

    @F.arrow_udf("string")
    def counted(s: pa.Array) -> pa.Array:
        seen.add(sum(len(x) for x in s.to_pylist() if x))
        return T.each(s, lambda x: x if x is None else unicodedata.normalize("NFKC", x))

    monkeypatch.setattr(T, "nfkc", counted)
    words = " ".join(f"word{n}" for n in range(5000))
    pairs = [("other words", words, False), (words[:200], words.upper(), True), ("ΟΔΟΣ", "οδός. ΟΔΟΣ", False), ("ΟΔΟΣΑ", "[1] οδοσ α", True), ("ΟΔΟΣ", "ΟΔΟΣ a b c d e f g h i", True),
             ("a b c d e f g h i j", "a b c d e f g h i j k", True), ("a b c d e f g h i z", "a b c d e f g h i j k", False), (None, words, False), ("", words, False), ("?", words, False), ("x", None, False)]
    t = spark.createDataFrame([(n, q, a, False, []) for n, (q, a, _) in enumerate(pairs)], "query_id int, query string, answer string, abstained boolean, markers array<string>")
    want = {n: bool(q and key(q)) and key(re.sub(r"\[\d+\]", "", a or "")).startswith(key(q)) for n, (q, a, _) in enumerate(pairs)}
    assert {r["query_id"]: r["echo"] for r in metrics.style(t.where("query_id > 0")).collect()} == {n: e for n, e in want.items() if n}
    before = seen.value
    assert [r["echo"] for r in metrics.style(t.where("query_id = 0")).collect()] == [False] and seen.value - before < 300


def key(text):
    return re.sub(r"[^\w]|_", "", unicodedata.normalize("NFKC", text)).lower().replace("ß", "ss")
