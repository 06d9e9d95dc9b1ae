"""Hand-made tables; the expected values come from reading the rules, each branch of which is met."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import catalog, diagnostics, indexing, metrics, questions


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


@pytest.mark.parametrize("request_, want", [
    ("index", {"chunked": "indexing", "indexing": "indexing", "failed": "indexing", "indexed": "already_indexed", "uploaded": None, "superseded": None}),
    ("reindex", {"chunked": "indexing", "indexing": "indexing", "failed": "indexing", "indexed": "indexing", "uploaded": None, "superseded": None}),
    ("resume", {"chunked": "indexing", "indexing": "indexing", "failed": "indexing", "indexed": None, "uploaded": None, "superseded": None}),
])
def test_transitions(spark, request_, want):
    v = spark.createDataFrame([(s, s) for s in want], "document_version_id string, processing_status string")
    asked = v.select("document_version_id").union(spark.createDataFrame([("none",)], "document_version_id string")).withColumn("request", F.lit(request_))
    got = {r["document_version_id"]: (r["next"], r["error_code"]) for r in indexing.transitions(v, asked).collect()}
    code = {"index": "version_not_indexable", "reindex": "version_not_indexable", "resume": "version_not_resumable"}[request_]
    assert got == {s: (n, None if n else code) for s, n in want.items()} | {"none": (None, "version_not_found")}
    empty = {r["document_version_id"]: (r["next"], r["failure_reason"]) for r in indexing.transitions(v, asked, v.where("false")).collect()}
    assert empty["chunked"] == ("failed", "empty_chunk_list") and empty["indexed"] == {"index": ("already_indexed", None), "reindex": ("failed", "empty_chunk_list"), "resume": (None, None)}[request_]


def tree(spark, *more):
    base = [("a", None, "/a", 0, "a", "active"), ("b", "a", "/a/b", 1, "b", "active"), ("c", "b", "/a/b/c", 2, "c", "active"), ("d", None, "/d", 0, "d", "active"), ("e", "d", "/d/b", 1, "b", "active"), ("x", None, "/x", 0, "x", "archived"), ("ab", None, "/ab", 0, "ab", "active")]
    return spark.createDataFrame([*base, *more], "folder_id string, parent_folder_id string, path string, depth int, name string, status string").withColumn("deleted_at", F.lit(None).cast("timestamp"))


@pytest.mark.parametrize("folder, target, want", [
    ("zz", "d", "folder_not_found"), ("x", "d", "folder_not_found"), ("a", "a", "into_itself"), ("a", "zz", "target_not_found"), ("a", "x", "target_not_found"), ("a", "c", "cycle"), ("b", "d", "name_conflict"), ("c", "d", None), ("a", "ab", None), ("b", None, None),
])
def test_folder_moves(spark, folder, target, want):
    moved, errors = catalog.move_folders(tree(spark), spark.createDataFrame([(folder, target)], "folder_id string, target_id string"))
    assert rows(errors, "folder_id", "error_code") == ([(folder, want)] if want else [])
    got = {r["folder_id"]: (r["parent_folder_id"], r["path"], r["depth"]) for r in moved.collect()}
    before = {r["folder_id"]: (r["parent_folder_id"], r["path"], r["depth"]) for r in tree(spark).collect()}
    changed = {k: v for k, v in got.items() if v != before[k]}
    assert changed == {("c", "d"): {"c": ("d", "/d/c", 1)}, ("a", "ab"): {"a": ("ab", "/ab/a", 1), "b": ("a", "/ab/a/b", 2), "c": ("b", "/ab/a/b/c", 3)}, ("b", None): {"b": (None, "/b", 0), "c": ("b", "/b/c", 1)}}.get((folder, target), {})


def test_folder_depth_limit_counts_the_subtree(spark):
    deep = [(f"k{n}", f"k{n - 1}" if n else None, "/" + "/".join(f"k{m}" for m in range(n + 1)), n, f"k{n}", "active") for n in range(18)]
    move = lambda folder, to: catalog.move_folders(tree(spark, *deep), spark.createDataFrame([(folder, to)], "folder_id string, target_id string"))[1]
    assert rows(move("b", "k16"), "error_code") == []
    assert rows(move("a", "k16"), "error_code") == [] and rows(move("a", "k17"), "error_code") == [("too_deep",)]


def test_uploads(spark):
    body, other = b"abc", "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    cases = [
        ("a.txt", 3, body, other, 1, None, "completed"), ("a.TXT", 3, body, None, 1, None, "completed"), ("a.txt", 3, body, "", 1, None, "completed"), ("a.txt", 0, body, None, 1, "empty_file", "rejected"), ("a.txt", -1, body, None, 1, "empty_file", "rejected"),
        ("a.txt", catalog.MAX_BYTES + 1, body, None, 1, "file_too_large", "rejected"), ("a.exe", 3, body, None, 1, "unsupported_format", "rejected"), ("txt", 3, body, None, 1, "unsupported_format", "rejected"), ("a.txt.", 3, body, None, 1, "unsupported_format", "rejected"),
        ("a.md", 3, body, None, 25, "upload_expired", "expired"), ("a.md", 3, None, None, 1, "content_required", "rejected"), ("a.md", 4, body, None, 1, "size_mismatch", "rejected"), ("a.md", 3, body, other.upper(), 1, "checksum_mismatch", "rejected"),
    ]
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    t = spark.createDataFrame([(n, *x) for n, x in enumerate(cases)], "n int, file_name string, declared_size bigint, content binary, checksum string, age int, want string, wanted string").withColumn("created_at", now - F.make_interval(hours="age"))
    assert [(r["error_code"], r["status"]) for r in catalog.admit(t, now).orderBy("n").collect()] == [(x[5], x[6]) for x in cases]


def test_binding(spark):
    docs = spark.createDataFrame([("d", "draft", "v0"), ("e", "active", None), ("x", "archived", None), ("y", "deleted", None)], "document_id string, status string, current_version_id string")
    versions = spark.createDataFrame([("d", "v0", "u0", 3)], "document_id string, document_version_id string, upload_session_id string, version_number int")
    up = spark.createDataFrame([
        ("u1", "d", "v1", "completed", "s", "h"), ("u2", "d", "v2", "completed", "s", "h"), ("u1", "e", "v9", "completed", "s", "h"), ("u0", "d", "v3", "completed", "s", "h"), ("u3", "d", "v4", "pending", "s", "h"),
        ("u4", "x", "v5", "completed", "s", "h"), ("u5", "y", "v6", "completed", "s", "h"), ("u6", "zz", "v7", "completed", "s", "h"), ("u7", "e", "v8", "completed", None, "h"),
    ], "upload_session_id string, document_id string, document_version_id string, status string, staging_key string, checksum string")
    bound, now, rejected = catalog.bind_versions(versions, docs, up)
    assert rows(bound, "document_version_id", "version_number") == [("v0", 3), ("v1", 4), ("v2", 5)]
    assert rows(now.where("document_id = 'd'"), "status", "current_version_id") == [("active", "v2")] and rows(now.where("document_id = 'e'"), "status", "current_version_id") == [("active", None)]
    assert rows(rejected, "document_version_id", "error_code") == [("v3", "upload_already_used"), ("v4", "upload_not_completed"), ("v5", "document_not_mutable"), ("v6", "document_not_mutable"), ("v7", "document_not_found"), ("v8", "upload_without_content"), ("v9", "upload_already_used")]


def test_metadata(spark):
    ok, size = ("fa", "t", ["x"], {"k": "v"}), catalog.MAX_METADATA
    cases = [(ok, []), (("FA", "t", ["x"], {}), ["invalid_language"]), (("f", "t", ["x"], {}), ["invalid_language"]), (("fa-Arab-IR", "t", [], {}), []), ((None, " \n", ["x"], {}), ["invalid_title"]), (("en", None, ["x"], {}), ["invalid_title"]),
             (("en", " " + "t" * 500 + " ", ["x"] * 50, {}), []), (("en", "t" * 501, ["x"] * 51, {}), ["invalid_title", "invalid_tags"]), (("en", "t", ["x", "\t"], {}), ["invalid_tags"]),
             (("en", "t", [], {"k": "a" * (size - 8)}), []), (("en", "t", [], {"k": "a" * (size - 7)}), ["metadata_too_large"]), (("en", "t", [], {"k": "é" * 2729}), []), (("en", "t", [], {"k": "é" * 2730}), ["metadata_too_large"]), (("en", "t", [], {"k": "😀" * 1364}), []), (("en", "t", [], {"k": "😀" * 1365}), ["metadata_too_large"])]
    t = spark.createDataFrame([(n, *x) for n, (x, _) in enumerate(cases)], "document_id int, declared_language string, title string, tags array<string>, metadata map<string,string>")
    assert {r["document_id"]: r["errors"] for r in catalog.metadata_errors(t).collect()} == {n: e for n, (_, e) in enumerate(cases) if e}
    names = spark.createDataFrame([(1, "n"), (2, "  "), (3, "n" * 201), (4, None), (5, " " + "n" * 200)], "id int, name string")
    assert rows(catalog.name_errors(names, "id"), "id") == [(2,), (3,), (4,)]


def test_answer_scores(spark):
    t = spark.createDataFrame([
        (1, "Leave is  ۱۲ days", "leave IS 12 days", "c", ["c"], "permission"), (2, "leave is 12 days", None, "c", ["c"], "permission"), (3, "leave is 12 days", "", "c", ["c"], "procedure"),
        (4, "leave is 12 days", "بله ۱۲", "c", ["x"], "procedure"), (5, "a b c d e f g h i j k l m n o p q r s t u", "a z", "c", ["x"], "factual"), (6, "no numbers", "سلام  ab", "", ["x"], "multi_step"), (7, "x", "y", "c", None, "responsibility"),
    ], "question_id int, gold string, predicted string, expected_chunk_id string, cited_ids array<string>, category string")
    got = {r["question_id"]: r for r in diagnostics.answer_scores(t).collect()}
    pick = lambda n, *names: tuple(got[n][x] for x in names)
    assert pick(1, "exact_match", "lexical_overlap", "entity_match", "procedure_match", "grounded", "risk", "citation_accuracy", "numeric_accuracy") == (True, 1.0, 1.0, None, True, False, True, 1.0)
    for n in (2, 3):
        assert pick(n, "exact_match", "lexical_overlap", "fluency", "entity_match", "procedure_match", "grounded", "risk", "citation_accuracy", "numeric_accuracy") == (False, 0.0, 0.0, None, None, False, True, False, None)
    assert pick(4, "lexical_overlap", "fluency", "procedure_match", "grounded", "risk", "numeric_accuracy") == (0.2, 1.0, 0.2, False, False, 1.0)
    assert pick(5, "grounded", "risk", "numeric_accuracy") == (False, True, None) and got[5]["lexical_overlap"] == pytest.approx(1 / 22)
    assert got[6]["fluency"] == pytest.approx(4 / 6 * 0.82) and pick(6, "numeric_accuracy", "procedure_match", "citation_accuracy") == (None, 0.0, False)
    assert pick(7, "risk", "entity_match") == (True, 0.0)
    scored = diagnostics.answer_scores(t).withColumns({"cohort": F.lit("b"), "abstained": F.col("question_id") == 3})
    row = diagnostics.answers_by_cohort(scored).first()
    assert (row["n"], row["abstention_rate"], row["entity_match_mean"], row["numeric_accuracy_mean"]) == (6, pytest.approx(1 / 6), 0.5, 1.0)


def test_sweep_and_false_abstains(spark):
    t = spark.createDataFrame([
        ("1", ["a", "b"], 0.4, "b", True, "g", False, True, True), ("2", ["a"], 0.2, "a", True, "g", True, True, True), ("3", ["a"], 0.2, "z", False, "g", True, True, True), ("4", [], None, "a", False, "g", False, True, True), ("5", ["a"], 0.1, "a", True, None, False, True, False), ("6", ["a"], 0.5, None, False, "g", True, False, True),
    ], "question_id string, retrieved_ids array<string>, top_score double, expected_id string, hit boolean, gold_answer string, risk boolean, measured boolean, abstained boolean")
    got = {r["min_evidence_score"]: r for r in diagnostics.sweep_thresholds(t).collect()}
    assert len(got) == 7 and got[0.0]["hit_at_k"] == pytest.approx(0.6) and got[0.0]["mrr"] == pytest.approx(0.5)
    assert [got[x]["false_abstain_count"] for x in (0.0, 0.2, 0.25, 0.3)] == [0, 0, 1, 1] and got[0.25]["false_abstain_rate"] == pytest.approx(1 / 6)
    assert [got[x]["answer_count"] for x in (0.0, 0.15, 0.25)] == [5, 4, 2] and [got[x]["hallucination_count"] for x in (0.0, 0.25)] == [3, 1] and got[0.25]["hallucination_rate"] == 0.5
    assert [x for x in got if got[x]["recommended"]] == [0.2]
    assert [r["min_evidence_score"] for r in diagnostics.sweep_thresholds(t.where("question_id = '1'")).collect() if r["recommended"]] == [0.25]
    never = t.where("question_id = '2'").withColumn("top_score", F.lit(-1.0))
    assert [r["min_evidence_score"] for r in diagnostics.sweep_thresholds(never).collect() if r["recommended"]] == [0.25]  # none is safe: the first preferred
    cases, total = diagnostics.false_abstains(t, 0.25)
    assert rows(cases, "question_id", "max_score", "threshold_triggered") == [("1", 0.4, False), ("2", 0.2, True)]
    assert tuple(total.first()) == (2, pytest.approx(2 / 6), 1)
    assert tuple(diagnostics.false_abstains(t.where("false"), 0.25)[1].first()) == (0, 0.0, 0)


def test_sweep_k(spark):
    t = spark.createDataFrame([(["a"], ["x", "a"]), (["b"], ["b"]), (["c"], ["x"] * 9 + ["c"]), ([], ["a"])], "expected_ids array<string>, retrieved_ids array<string>")
    got = {r["k"]: (r["n"], round(r["hit_rate"], 6), round(r["mrr"], 6), r["recommended"]) for r in diagnostics.sweep_k(t).collect()}
    assert got[1] == (3, 0.333333, 0.333333, False) and got[3] == (3, 0.666667, 0.5, False) and got[10] == (3, 1.0, 0.533333, True) and not got[12][3]


def test_completeness(spark):
    t = spark.createDataFrame([(1, ["۱۲ روز", "مرخصی"], "مرخصي 12-روز", False), (2, ["a", "b"], "A.", False), (3, ["a"], "b", False), (4, ["a"], "a", True), (5, ["a"], None, False), (6, ["!", "ﬁ"], "FI", False), (7, ["a", "b", "c"], "a b", False)], "query_id int, facts array<string>, answer string, abstained boolean")
    assert rows(metrics.completeness(t), "query_id", "completeness", "verdict") == [(1, 1.0, "pass"), (2, 0.5, "partial"), (3, 0.0, "fail"), (4, 1.0, "fail"), (5, 0.0, "fail"), (6, 1.0, "pass"), (7, 0.6667, "partial")]


def test_style(spark):
    fa = "این یک پاسخ روشن است"
    t = spark.createDataFrame([
        (1, "q?", f"{fa} [1]\n\n{fa}\n{fa}", False, ["[1]"]), (2, "q?", f"[1] ab\n\n{fa} [3]", False, ["[1]"]), (3, "سوال من", f"سؤال من {fa}", False, ["[1]"]), (4, "سوال من؟", f"[2] سوال، من: {fa} [2]", False, ["[2]"]), (5, "q", f" بر اساس اطلاعات موجود {fa}", False, None), (6, "q", f"پرسش شما {fa}", False, None),
        (7, "q", f"{fa}\n1. {fa} [1]\n۲) {fa}\n 3. {fa} [2]", False, ["[1]", "[2]"]), (8, "q", "plain words here", False, []), (9, "q", fa, True, []), (10, "q", fa + "�", False, []), (11, "q", None, False, []), (12, "", "10. ده مورد", False, []),
    ], "query_id int, query string, answer string, abstained boolean, markers array<string>")
    got = {r["query_id"]: tuple(r)[1:] for r in metrics.style(t).collect()}
    #      markers_valid, coverage, echo, robotic, fluent, numbered
    assert got[1] == (True, 0.5, False, False, True, False) and got[2] == (False, 1.0, False, False, True, False)
    assert got[3][2] is False and got[4] == (True, 1.0, True, False, False, False)
    assert got[5] == (False, 0.0, False, True, True, False) and got[6] == (False, 0.0, True, True, False, False)
    assert got[7] == (True, 0.5, False, False, True, True) and got[8] == (False, 0.0, False, False, False, False)
    assert got[9][4] is False and got[10][4] is False and got[11] == (False, 0.0, False, False, False, False) and got[12][5] is False


def test_gold_summary(spark):
    ranks = spark.createDataFrame([(1, 1), (2, 4), (3, None), (4, 2)], "query_id int, gold_rank int")
    answers = spark.createDataFrame([(1, "It is: Ten-Days!", False, "ten days"), (2, "no", True, "ten"), (3, "no", True, "ten"), (4, "eleven", False, "ten")], "query_id int, answer string, abstained boolean, marker string")
    wrong = spark.createDataFrame([(3,), (4,), (4,)], "query_id int")
    r = metrics.gold_summary(ranks, answers, wrong).first().asDict()
    assert r == {"n": 4, "hit_1": 0.25, "hit_3": 0.5, "hit_5": 0.75, "mrr": pytest.approx((1 + 0.25 + 0.5) / 4), "wrong_retrieval": 1, "passed": 1, "abstains": 2, "wrong_answers": 1, "false_abstains": 1}


def test_categories(spark):
    t = spark.createDataFrame([(1, ["x", "travel", "abstain"]), (2, ["abstain", "travel"]), (3, ["Leave"]), (4, []), (5, None), (6, ["handbook"])], "id int, tags array<string>")
    assert rows(questions.category(t), "id", "category") == [(1, "policy_lookup"), (2, "factual"), (3, "factual"), (4, "factual"), (5, "factual"), (6, "factual")]


def test_models_and_documents(spark):
    t = lambda *r: diagnostics.compare_models(spark.createDataFrame(list(r), "model string, hit_rate double, mrr double"), "now").first()["recommended"]
    assert t(("now", 0.5, 0.1), ("a", 0.54, 0.9)) == "now" and t(("now", 0.5, 0.1), ("a", 0.5625, 0.1), ("b", 0.5625, 0.2)) == "b" and t(("a", 0.1, 0.1)) == "a" and t(("now", None, None)) == "now"
    d = spark.createDataFrame([("d", "baseline", True, True), ("d", "baseline", True, None), ("d", "robustness", False, True), (None, "robustness", True, False)], "document_id string, cohort string, measured boolean, hit boolean")
    assert rows(diagnostics.per_document(d), "document_id", "baseline_n", "baseline_hit", "robustness_n", "robustness_hit") == [("d", 2, 1.0, 0, None), ("unknown", 0, None, 1, 0.0)]


def test_chunk_flags_and_stats(spark):
    rows_ = [("d", 0, "d0", "a short\nline\n\n" + "x" * 100, 0, 120), ("d", 1, "d1", "1. item\n2. item", 100, 115), ("d", 2, "d2", "a|b|c|d  " + "y" * 2500, 130, 2640), ("e", 0, "e0", "", 0, 0), ("e", 1, "e1", "z" * 80, 0, 80)]
    chunks = spark.createDataFrame(rows_, "doc_id string, sequence_number int, chunk_id string, text string, start int, end int")
    hits = spark.createDataFrame([("d0",), ("d0",), ("e1",), ("gone",)], "chunk_id string")
    out = diagnostics.chunk_stats(chunks, hits)
    got = {r["chunk_id"]: r for r in out.collect()}
    assert [got[k]["flags"] for k in ("d0", "d1", "d2", "e0", "e1")] == [["fragmented_short_lines"], ["fragmented_short_lines", "list_like", "very_short"], ["double_spaces", "table_like", "very_long"], ["very_short"], []]
    assert [got[k]["overlap_previous"] for k in ("d0", "d1", "d2", "e0", "e1")] == [0, 20, 0, 0, 0] and [got[k]["retrieved"] for k in ("d0", "d1", "e1")] == [2, 0, 1]
    assert [got[k]["paragraphs"] for k in ("d0", "e0")] == [2, 1] and got["e0"]["sentences"] == 0
    r = diagnostics.corpus_summary(out).first()
    assert (r["chunks"], r["documents"], r["avg_chunks_per_document"], r["never_retrieved"], r["avg_overlap_size"]) == (5, 2, 2.5, 3, 4.0)
    assert tuple(diagnostics.corpus_summary(out.where("false")).first())[:2] == (0, 0.0)
    assert rows(diagnostics.frequently_retrieved(hits, 2), "chunk_id", "n") == [("d0", 2), ("e1", 1)]
    h = spark.createDataFrame([(0,), (199,), (200,), (1500,), (99_999,)], "v int")
    assert rows(diagnostics.histogram(h, "v", diagnostics.SIZE_EDGES), "bucket", "n") == [(0, 2), (1, 1), (7, 2)]
