import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import catalog, chunking, context, diagnostics, indexing, metrics, questions
from docloom.sources import files
from docloom.streaming import index_stream

DOCS = ["", "   ", "کوتاه", "# Title\nbody text here.\n\n- a\n- b\n\n- c\n\nQ: why?\n\nBecause it is so.\n\n|a|b|\n\n|c|d|", "ماده 1: هدف\nمتن ماده یک.\n\n" + "جمله بلند فارسی است. " * 200, "x" * 5000, "Dr. A. B. said 3.14 is pi. " * 120]


@pytest.mark.parametrize("text", DOCS)
def test_splitter(text):
    p = chunking.split_document(text)
    assert bool(p) == bool(text.strip())
    assert all(text[x["start"] : x["end"]] == x["text"] and 0 < len(x["text"]) <= 1200 for x in p)
    seen = {i for x in p for i in range(x["start"], x["end"])}
    assert all(i in seen for i, ch in enumerate(text) if not ch.isspace())


def test_splitter_structure():
    p = chunking.split_document(DOCS[3])
    assert p[0]["heading"] == "Title" and p[0]["strategy"] == "heading"
    long = chunking.split_document(DOCS[4])
    assert len(long) > 3 and [x["overlap"] for x in long[:3]] == [0, 0, 125] and all(x["text"].endswith(".") for x in long[:-1])
    assert [u.kind for u in chunking.coalesced(chunking.units(DOCS[3]))] == ["heading", "prose", "list", "faq", "table"]


def test_breaks():
    """A break stands behind each line and sentence, not behind decimals, abbreviations and single letters."""
    assert chunking.break_offsets("3.14 is pie. x") == [13] and chunking.break_offsets("Dr. A. x e.g. y") == []
    assert chunking.break_offsets("One! Two\nthree etc.\nend.") == [5, 9, 20, 24]
    assert list(chunking.cuts("aaaa bbbb cccc", most=6, overlap=2)) == [(0, 5, 0), (3, 5, 2), (4, 10, 1), (8, 14, 2)]
    assert [x[:2] for x in chunking.cuts("x" * 10, most=4, overlap=1)] == [(0, 4), (3, 7), (6, 10)]


def test_spans():
    unit = chunking.Unit
    plain = [unit(0, 600, "prose"), unit(602, 1100, "prose"), unit(1102, 1190, "list")]
    assert list(chunking.spans(plain, 1200, 50, 1000)) == [(0, 1100), (1102, 1190)]  # something structured behind the target
    assert list(chunking.spans([unit(0, 30, "prose"), unit(32, 2000, "prose"), unit(2002, 2010, "prose")], 1200, 50, 1000)) == [(0, 30), (32, 2000), (2000, 2010)]


def test_chunk_rows(spark):
    docs = spark.createDataFrame(list(enumerate(DOCS)), "doc_id int, text string")
    rows = chunking.chunk_rows(docs)
    status = {r["doc_id"]: r["failure_reason"] for r in chunking.chunk_status(docs, rows).collect()}
    assert status[0] == status[1] == "empty_chunk_list" and status[3] is None
    kinds = [chunking.kind_of(x.split("\n")) for x in ("a|b|c", "- a\n- b", "why?", "## H", "ماده 1: x\ny", "plain")]
    df = spark.createDataFrame(list(enumerate(["a|b|c", "- a\n- b", "why?", "## H", "ماده 1: x\ny", "plain"])), "i int, t string")
    assert kinds == ["table", "list", "faq", "heading", "clause", "prose"] == [r["k"] for r in df.orderBy("i").select(chunking.block_kind(F.col("t")).alias("k")).collect()]
    assert chunking.replace_chunks(rows, rows.where("doc_id = 3")).count() == rows.count()


def test_embedding_batches(spark):
    def failing(texts):
        if any("bad" in t for t in texts):
            raise ValueError
        return [[1.0, 0.0] for _ in texts]

    rows = spark.createDataFrame([(str(k), "bad" if k == 40 else "t" * 2000) for k in range(90)], "chunk_id string, text string")
    got = indexing.embed(rows, lambda: failing).collect()
    assert len(got) == 90 and [r["chunk_id"] for r in got if r["failure"]] == ["40"]
    v = indexing.hash_vector("x", 64)
    assert abs(sum(x * x for x in v) - 1) < 1e-9 and v == indexing.hash_vector("x", 64) != indexing.hash_vector("y", 64)


def test_supersede(spark):
    v = spark.createDataFrame([("d", "v1", "indexed"), ("d", "v2", "indexing"), ("e", "v3", "indexed")], "document_id string, document_version_id string, processing_status string")
    c = spark.createDataFrame([("v1", "c1", "indexed"), ("v3", "c3", "indexed")], "document_version_id string, chunk_id string, status string")
    e = spark.createDataFrame([("c1", "indexed"), ("c3", "indexed")], "chunk_id string, index_status string")
    a, b, i = indexing.supersede(v, c, e, spark.createDataFrame([("d", "v2")], "document_id string, document_version_id string"))
    assert {r["document_version_id"]: r["processing_status"] for r in a.collect()} == {"v1": "superseded", "v2": "indexing", "v3": "indexed"}
    assert {r["chunk_id"]: r["status"] for r in b.collect()} == {"c1": "superseded", "c3": "indexed"} and {r["chunk_id"]: r["index_status"] for r in i.collect()} == {"c1": "stale", "c3": "indexed"}
    t = indexing.transitions(v, spark.createDataFrame([("v3", "index"), ("v1", "resume"), ("v9", "index")], "document_version_id string, request string"))
    assert {r["document_version_id"]: (r["next"], r["error_code"]) for r in t.collect()} == {"v3": ("already_indexed", None), "v1": (None, "version_not_resumable"), "v9": (None, "version_not_found")}


def test_folders(spark):
    f = spark.createDataFrame([("1", None, "/a", 0, "a"), ("2", "1", "/a/b", 1, "b"), ("3", "2", "/a/b/c", 2, "c"), ("4", None, "/ab", 0, "ab"), ("5", None, "/z", 0, "z"), ("6", "5", "/z/b", 1, "b")], "folder_id string, parent_folder_id string, path string, depth int, name string").withColumn("deleted_at", F.lit(None).cast("timestamp"))
    sub = catalog.subtree(f, f.where("folder_id = '1'"))
    assert {r["folder_id"] for r in sub.collect()} == {"1", "2", "3"}
    moved, wrong = catalog.move_folders(f, spark.createDataFrame([("2", "4"), ("1", "3"), ("6", "1")], "folder_id string, target_id string"))
    assert {r["folder_id"]: r["error_code"] for r in wrong.collect()} == {"1": "cycle", "6": "name_conflict"}
    assert {r["folder_id"]: (r["path"], r["depth"], r["parent_folder_id"]) for r in moved.collect() if r["folder_id"] in "23"} == {"2": ("/ab/b", 1, "4"), "3": ("/ab/b/c", 2, "2")}


def test_uploads(spark):
    now = dt.datetime(2024, 1, 2)
    rows = spark.createDataFrame([("a.txt", 1, 1, "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb", bytearray(b"a"), now), ("a.exe", 1, 1, "", bytearray(b"a"), now), ("a.md", 1, 2, "", bytearray(b"a"), now), ("a.md", 1, 1, "00", bytearray(b"a"), now), ("a.md", 1, 1, "00", bytearray(b"a"), dt.datetime(2023, 1, 1))], "file_name string, size_bytes long, declared_size long, checksum string, content binary, created_at timestamp")
    assert [r["error_code"] for r in catalog.admit(rows, F.lit(now)).collect()] == [None, "unsupported_format", "size_mismatch", "checksum_mismatch", "upload_expired"]


def test_metrics_by_hand(spark):
    rows = [("x", "1", "ok", False, ["a"], ["b", "a"], ["a"], "completed", False, 10.0, 1), ("x", "2", "ok", False, ["a", "b"], ["c"], [], "completed", False, 30.0, None), ("x", "3", "ok", True, [], [], [], "abstained", True, 20.0, 3), ("x", "4", "error", False, ["a"], ["a"], [], None, False, 99.0, 3)]
    o = spark.createDataFrame(rows, "experiment_id string, question_id string, status string, expect_abstention boolean, expected_ids array<string>, retrieved_ids array<string>, cited_ids array<string>, generation_status string, abstained boolean, e2e_ms double, total_tokens int").withColumns({"retrieval_ms": F.lit(1.0), "generation_ms": F.lit(2.0)})
    m = metrics.report(o).first()
    assert (m["recall_at_k"], m["mrr"], m["groundedness"], m["citation_precision_mean"], m["citation_accuracy"]) == (0.5, 0.25, 0.5, 1.0, 0.5)
    assert (m["abstention_precision"], m["abstention_recall"], m["e2e_p50"], m["e2e_p95"], m["tokens_missing"]) == (1.0, 1.0, 20.0, 30.0, 1)
    g = metrics.gates(metrics.report(o), o, {"recall_at_k": 0.6, "mrr": 0.2}).first()
    assert g["failing"] == ["recall_at_k", "aggregate_incomplete"] and not g["passed"]
    s = diagnostics.sweep_k(o, [1, 2]).where("recommended").first()
    assert s["k"] == 1 or s["k"] == 2


def test_gold(spark):
    q = spark.createDataFrame([("1", "کد ۱۲ است"), ("2", "یک دو سه چهار پنج شش هفت"), ("3", "nothing here")], "question_id string, passage string")
    k = spark.createDataFrame([("c1", "d", 0, "این کد 12 است بله"), ("c2", "d", 1, "شش پنج چهار سه دو یک"), ("c0", "d", 2, "این کد 12 است")], "chunk_id string, document_id string, chunk_index int, text string")
    assert {r["question_id"]: (r["chunk_id"], r["bound_by"]) for r in questions.bind_gold(q, k).collect()} == {"1": ("c1", "passage"), "2": ("c2", "tokens"), "3": (None, None)}


def test_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    for name, raw in (("a.txt", "سلام".encode()), ("b.md", b"\xef\xbb\xbfx"), ("c.txt", "é".encode("utf-16")), ("d.zzz", b"\xff\x00\xff")):
        (tmp_path / "t" / name).write_bytes(raw)
    got = {r["path"][-5:]: (r["parser"], r["text"]) for r in files.text_files(spark, str(tmp_path / "t")).collect()}
    assert got["a.txt"] == ("text", "سلام") and got["b.md"[-5:] if len("b.md") > 4 else "/b.md"] == ("markdown", "x") and got["c.txt"] == ("text", "é") and got["d.zzz"] == (None, None)


def test_stream(spark, tmp_path):
    make = lambda: indexing.hash_embedder(8)
    put = lambda rows, n: spark.createDataFrame(rows, index_stream.VERSION).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put([(1, "d1", "v1", "text one is here."), (2, "d2", "v2", "  ")], 1)
    run = lambda: index_stream.run_stream(spark, str(tmp_path / "in"), str(tmp_path / "ix"), str(tmp_path / "cp"), make, "m", 8)
    run()
    put([(3, "d1", "v3", "text one is new.")], 2)
    run()
    assert [(r["document_version_id"], r["text"]) for r in index_stream.current(spark, str(tmp_path / "ix")).collect()] == [("v3", "text one is new.")]
    assert {r["failure_reason"] for r in spark.read.parquet(str(tmp_path / "ix/versions")).collect()} == {None, "empty_content"}


def test_stream_skips_content(spark, tmp_path):
    """A batch whose contents the index holds calls the embedder for none of its texts; new contents are embedded once."""
    calls = spark.sparkContext.accumulator(0)

    def make():
        def embed(texts):
            calls.add(len(texts))
            return [indexing.hash_vector(t, 8) for t in texts]
        return embed

    put = lambda rows: spark.createDataFrame(rows, index_stream.VERSION).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: index_stream.run_stream(spark, str(tmp_path / "in"), str(tmp_path / "ix"), str(tmp_path / "cp"), make, "m", 8)
    put([(1, "d1", "v1", "text one is here."), (2, "d2", "v2", "text two is here."), (3, "d3", "v3", "text two is here.")])
    run()
    assert calls.value == 2
    put([(4, "d1", "v4", "text one is here."), (5, "d2", "v5", "text two is here.")])
    run()
    assert calls.value == 2
    done = {r["document_version_id"]: (r["created"], r["skipped"]) for r in spark.read.parquet(str(tmp_path / "ix/versions")).collect()}
    assert done["v4"] == done["v5"] == (0, 1) and done["v1"] == (1, 0)
    rows = index_stream.current(spark, str(tmp_path / "ix")).collect()
    assert sorted(r["document_version_id"] for r in rows) == ["v3", "v4", "v5"] and all(len(r["vector"]) == 8 for r in rows)


def stream_of(spark, tmp_path, make):
    put = lambda rows: spark.createDataFrame(rows, index_stream.VERSION).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return put, lambda how=make: index_stream.run_stream(spark, str(tmp_path / "in"), str(tmp_path / "ix"), str(tmp_path / "cp"), how, "m", 8)


def test_stream_reads_no_earlier_chunks_or_vectors(spark, tmp_path):
    """With the earlier chunks and vectors out of reach, a batch still knows which contents are new."""
    put, run = stream_of(spark, tmp_path, lambda: indexing.hash_embedder(8))
    put([(n, f"d{n}", f"v{n}", f"text number {n} is here.") for n in range(30)])
    run()
    for table in ("chunks", "vectors", "versions"):
        (tmp_path / "ix" / table).rename(tmp_path / f"away-{table}")
    put([(n, f"d{n}", f"w{n}", f"text number {n} is here.") for n in range(27, 33)])
    run()
    done = {r["document_version_id"]: (r["created"], r["skipped"], r["failed"]) for r in spark.read.parquet(str(tmp_path / "ix/versions")).collect()}
    assert done == {f"w{n}": ((0, 1, 0) if n < 30 else (1, 0, 0)) for n in range(27, 33)}
    assert spark.read.parquet(str(tmp_path / "ix/vectors")).count() == 3


def test_stream_restarts_after_a_crash(spark, tmp_path):
    """A batch that died half way is repeated: the same contents are new, and nothing stands twice."""
    put, run = stream_of(spark, tmp_path, lambda: indexing.hash_embedder(8))

    def dies():
        raise RuntimeError("lost")

    put([(1, "d1", "v1", "text one is here."), (2, "d2", "v2", "text one is here.")])
    run()
    put([(3, "d3", "v3", "text one is here."), (4, "d4", "v4", "text two is here."), (5, "d5", "v5", None)])
    with pytest.raises(Exception):
        run(dies)
    run()
    done = {r["document_version_id"]: (r["created"], r["skipped"], r["failure_reason"]) for r in spark.read.parquet(str(tmp_path / "ix/versions")).collect()}
    assert done["v3"] == (0, 1, None) and done["v4"] == (1, 0, None) and done["v5"] == (0, 0, "empty_content") and sorted([done["v1"][:2], done["v2"][:2]]) == [(0, 1), (1, 0)]
    rows = index_stream.current(spark, str(tmp_path / "ix")).collect()
    assert sorted(r["document_version_id"] for r in rows) == ["v1", "v2", "v3", "v4"] and spark.read.parquet(str(tmp_path / "ix/vectors")).count() == 2
    run()  # nothing new
    assert spark.read.parquet(str(tmp_path / "ix/versions")).count() == 5


def test_stream_tries_failed_contents_again(spark, tmp_path):
    def failing():
        def embed(texts):
            if any("two" in t for t in texts):
                raise ValueError("refused")
            return [indexing.hash_vector(t, 8) for t in texts]
        return embed

    put, run = stream_of(spark, tmp_path, failing)
    put([(1, "d1", "v1", "text one is here."), (2, "d2", "v2", "text two is here.")])
    run()
    put([(3, "d3", "v3", "text two is here.")])
    run(lambda: indexing.hash_embedder(8))
    done = {r["document_version_id"]: (r["created"], r["skipped"], r["failed"], r["failure_reason"]) for r in spark.read.parquet(str(tmp_path / "ix/versions")).collect()}
    assert done == {"v1": (1, 0, 0, None), "v2": (0, 0, 1, "partial_embedding_failure"), "v3": (0, 1, 0, None)}
    assert sorted(r["document_version_id"] for r in index_stream.current(spark, str(tmp_path / "ix")).collect()) == ["v1", "v3"]


def test_overlap_in_linear_time():
    import time

    cases = [("abcabc", "abcx", 3), ("aaaa", "aaa", 3), ("ab", "cd", 0), ("", "a", 0), ("xaba", "ababa", 3), ("é1é", "é1é2", 3)]
    assert [context.overlap(a, b) for a, b, _ in cases] == [n for *_, n in cases]
    left, right = "x" + "ab" * 50_000, "ab" * 49_000 + "c" * 2000
    began = time.time()
    assert context.overlap(left, right) == 98_000 and context.overlap(left, "b" + right) == 98_001 and context.overlap(left, "c" + right) == 0 and context.overlap("a" * 100_000 + "b", "a" * 100_000) == 0 and context.overlap("q" + "a" * 100_000, "a" * 100_000 + "z") == 100_000
    assert time.time() - began < 3
    brute = lambda a, b: next((n for n in range(min(len(a), len(b)), 0, -1) if a.endswith(b[:n])), 0)
    r = random.Random(2)
    for _ in range(500):
        a, b = ("".join(r.choice("ab") for _ in range(r.randrange(9))) for _ in range(2))
        assert context.overlap(a, b) == brute(a, b)


def test_question_variants(spark):
    q = "مدیر سازمان چند روز مرخصی است؟"
    got = {r["kind"]: r["text"] for r in questions.variants(spark.createDataFrame([(1, q)], "question_id int, question string"), keep=13).collect()}
    assert got["formal"] == questions.FORMAL + q and got["informal"] == "مدیر سازمان چند روز مرخصی ه؟"
    assert got["synonym"] in {q.replace(a, b, 1) for a, b in questions.SYNONYMS if a in q} and got["punctuation"].endswith("؟؟!!")
    assert got["paraphrase"] in {q.replace("چند", "چه تعداد"), questions.PLEASE + q} if "paraphrase" in got else True
    assert "digit_latin" not in got and "whitespace" not in got and q not in got.values()


def test_accepted_files(spark, tmp_path):
    for name, data in (("a.TXT", "متن".encode()), ("b.md", "\ufefftext".encode("utf-16")), ("c.exe", b"x"), ("d.pdf", b"%PDF"), ("e.txt", b"\xff\x00\xfe")):
        (tmp_path / name).write_bytes(data)
    good, bad = files.accepted(files.text_files(spark, str(tmp_path)))
    assert {r["text"] for r in good.collect()} == {"متن", "text"}
    assert sorted((r["suffix"], r["error_code"]) for r in bad.collect()) == [("exe", "unsupported_format"), ("pdf", "unsupported_format"), ("txt", "undecodable_text")]
