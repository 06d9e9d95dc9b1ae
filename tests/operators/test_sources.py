import json

import pytest
from pyspark.sql import functions as F

from docloom.sources import datasets, files, runs

GOOD = {"id": "1", "question": "q", "expected_answer": "a", "expected_citations": [{"chunk_id": "c"}], "knowledge_base_id": "k", "difficulty": "easy", "language": "fa", "tags": ["t"]}


def put(path, *rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows) + "\n")
    return str(path)


def test_questions_name_the_line(spark, tmp_path):
    at = put(tmp_path / "q.jsonl", GOOD, "", "broken", GOOD | {"question": " ", "tags": []}, {k: v for k, v in GOOD.items() if k != "expected_answer"}, GOOD | {"tags": "x"}, GOOD | {"difficulty": "odd", "expect_abstention": True}, GOOD | {"language": "de"}, GOOD | {"expected_citations": [{"document_id": "d"}]}, "null", GOOD | {"id": "2", "expect_abstention": True})
    good, faults = datasets.questions(spark, at)
    assert sorted((r["id"], r["expect_abstention"]) for r in good.collect()) == [("1", False), ("2", True)]
    got = {r["line"]: (r["error_code"], r["details"]) for r in faults.collect()}
    assert got[3] == ("malformed_line", []) and got[4] == ("invalid_question", ["blank_question", "empty_tags"]) and got[5][1] == ["missing_expected_answer"]
    assert "wrong_type" in got[6][1] and got[7][1] == ["unknown_difficulty"] and got[8][1] == ["unknown_language"] and got[9][1] == ["missing_chunk_id"]
    assert got[10][0] == "invalid_question" and set(got) == {3, 4, 5, 6, 7, 8, 9, 10}
    assert all(r["file"].endswith("/q.jsonl") for r in faults.collect())


def test_lines_of_a_split_file(spark, tmp_path):
    """A file that several tasks read: the faults' lines are those of the file."""
    rows = [("bad" if n % 37 == 5 else "" if n % 11 == 0 else GOOD | {"id": str(n), "question": "é" * (n % 50 + 1)}) for n in range(3000)]
    (tmp_path / "d").mkdir()
    at = str(tmp_path / "d")
    put(tmp_path / "d" / "a.jsonl", *rows)
    put(tmp_path / "d" / "b.jsonl", "bad", *rows[:40])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        _, faults = datasets.questions(spark, at)
        assert spark.read.text(at).rdd.getNumPartitions() > 10
        got = {(r["file"][-7:], r["line"]) for r in faults.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {("a.jsonl", n + 1) for n in range(3000) if n % 37 == 5} | {("b.jsonl", 1), ("b.jsonl", 7)}


def test_manifest(spark, tmp_path):
    good, _ = datasets.questions(spark, put(tmp_path / "q.jsonl", GOOD, GOOD | {"id": "2", "knowledge_base_id": "z"}))
    at = put(tmp_path / "m.json", {"dataset_id": "d", "dataset_version": "1", "knowledge_base_id": "k", "question_count": 5})
    assert {(r["error_code"], r["detail"]) for r in datasets.manifest_errors(spark, at, good).collect()} == {("question_count_mismatch", "5 != 2"), ("several_knowledge_bases", "2")}
    assert [r["error_code"] for r in datasets.manifest_errors(spark, put(tmp_path / "n.json", {"dataset_id": "d"}), good.where("false")).collect()] == ["invalid_manifest", "no_questions"]
    datasets.write_dataset(str(tmp_path / "out"), good, "d", "k", F.col("id") == "1")
    said = spark.read.json(str(tmp_path / "out" / "manifest")).first()
    assert (said["question_count"], said["measured_eligible_count"]) == (2, 1)
    again, faults = datasets.questions(spark, str(tmp_path / "out" / "questions"))
    assert sorted(again.collect()) == sorted(good.collect()) and faults.count() == 0


def run_tables(spark, mrr, **more):
    row = {"experiment_id": "1", "workspace_id": "w", "name": "n", "knowledge_base_id": "k", "dataset_id": "d", "dataset_version": "1", "created_at": "2024-01-01", "top_k": 8} | more
    config = spark.createDataFrame([tuple(row.values())], list(row)).withColumn("created_at", F.col("created_at").cast("timestamp"))
    i = row["experiment_id"]
    return config, spark.createDataFrame([(i, "q", mrr)], "experiment_id string, question_id string, value double"), spark.createDataFrame([(i, 0.5, mrr)], "experiment_id string, recall_at_k double, mrr double"), spark.createDataFrame([(i, "passed", [], 1, 0)], runs.SUMMARY)


def test_runs_are_committed_whole(spark, tmp_path):
    at = str(tmp_path / "runs")
    runs.write(at, *run_tables(spark, 0.1))
    runs.write(at, *run_tables(spark, 0.2, experiment_id="2", created_at="2024-02-01", dataset_id="e"))
    runs.write(at, *run_tables(spark, 0.9, experiment_id="3", workspace_id="other"))
    assert [(r["experiment_id"], r["mrr"]) for r in runs.catalogue(spark, at, "w").collect()] == [("2", 0.2), ("1", 0.1)]
    config, results, metrics, summary = run_tables(spark, 0.7)
    with pytest.raises(Exception):  # the summary's write dies: the old attempt stands
        runs.write(at, config, results, metrics, summary.withColumn("status", F.raise_error(F.lit("lost"))))
    assert [(r["experiment_id"], r["mrr"]) for r in runs.catalogue(spark, at, "w", dataset_id="d").collect()] == [("1", 0.1)]
    runs.write(at, config, results, metrics, summary)
    assert [r["mrr"] for r in runs.catalogue(spark, at, "w", knowledge_base_id="k").collect()] == [0.2, 0.7]
    assert [r["value"] for r in runs.results(spark, at, "w", "1").collect()] == [0.7]
    assert sorted(r["dataset_id"] for r in runs.dataset_ids(spark, at, "w").collect()) == ["d", "e"]
    assert runs.catalogue(spark, at, "w", limit=1).count() == 1 and runs.catalogue(spark, at, "none").count() == 0


def test_reads_open_only_the_attempts_asked_for(spark, tmp_path):
    at = str(tmp_path / "runs")
    for n in range(4):
        runs.write(at, *run_tables(spark, 0.1 * n, experiment_id=str(n), workspace_id=f"w{n % 2}", created_at=f"2024-01-0{n + 1}"))
    plan = runs.catalogue(spark, at, "w1", limit=1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "attempt" in plan.split("PartitionFilters", 1)[1]
    files_ = {f.split("attempt=")[1].split("/")[0] for f in runs.results(spark, at, "w1", "3").inputFiles() if "attempt=" in f}
    assert len(files_) <= 4 and [r["value"] for r in runs.results(spark, at, "w1", "3").collect()] == [pytest.approx(0.3)]


def test_flat_report(spark, tmp_path):
    q = spark.createDataFrame([("1", ["a", "b"], {"x": 1}, None)], "id string, citations array<string>, m map<string,int>, n int")
    files.write_diagnostics(str(tmp_path / "d"), q.select("id"), q, q.select("id"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "d" / "questions")).collect()] == [("1", "a|b", '{"x":1}', None)]
