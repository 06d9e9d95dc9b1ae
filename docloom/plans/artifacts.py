"""Queries that write the given tables as the reference's files and read them back: datasets, runs, reports, stored indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import lexical
from docloom.operators import retrieval as R
from docloom.plans.queries import _BM25, asked, c, corpus, query, r6
from docloom.sources import datasets, files, runs
from docloom.sources.shared import fresh_path, table

#: Turns as lines of a dataset: every seventh turn is broken, every eleventh blank, and some questions lack what they need.
_LINES = """t AS (SELECT conv_id, turn, text, conv_id % 4 AS part, row_number() OVER (PARTITION BY conv_id % 4 ORDER BY conv_id, turn) AS line FROM conversations),
k AS (SELECT *, (conv_id + turn) % 7 = 3 AS broken, (conv_id + turn) % 11 = 5 AS blank_ FROM t)"""


def _write_lines(spark, sf_dir) -> str:
    """The dataset's lines in four files; lines of a file in the order of conversations."""
    t = table(spark, sf_dir, "conversations").withColumn("part", c("conv_id") % 4)
    n = c("conv_id") + c("turn")
    cited = F.array(F.struct(F.concat(F.lit("c"), c("turn").cast("string")).alias("chunk_id")))
    good = F.to_json(F.struct(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.when(n % 13 == 0, "  ").otherwise(c("text")).alias("question"), F.lit("a").alias("expected_answer"), cited.alias("expected_citations"),
        F.when(n % 17 != 0, "k1").alias("knowledge_base_id"), F.when(n % 5 == 0, "odd").otherwise("easy").alias("difficulty"), F.lit("en").alias("language"),
        F.when(n % 19 == 0, F.array().cast("array<string>")).otherwise(F.array(c("role"))).alias("tags")))
    line = F.when(n % 7 == 3, F.concat(F.lit('{"id": '), c("conv_id").cast("string"))).when(n % 11 == 5, "").otherwise(good)
    path = fresh_path(spark, "dataset")
    t.withColumn("value", line).repartition(4, "part").sortWithinPartitions("part", "conv_id", "turn").select("part", "value").write.partitionBy("part").text(path)
    return path


@query(f"""WITH {_LINES}, f AS (SELECT part, line, CASE WHEN broken THEN 'malformed_line' ELSE 'invalid_question' END AS error_code,
 CASE WHEN broken THEN '' ELSE array_to_string(list_filter([CASE WHEN (conv_id + turn) % 17 = 0 THEN 'missing_knowledge_base_id' END, CASE WHEN (conv_id + turn) % 13 = 0 THEN 'blank_question' END, CASE WHEN (conv_id + turn) % 19 = 0 THEN 'empty_tags' END, CASE WHEN (conv_id + turn) % 5 = 0 THEN 'unknown_difficulty' END], lambda x: x IS NOT NULL), ',') END AS details, blank_, broken FROM k)
SELECT part, line, error_code, details FROM f WHERE broken OR (NOT blank_ AND details <> '')""")
def dataset_faults(spark, sf_dir):
    """The file and line of every line that is no JSON or breaks the schema."""
    _, faults = datasets.questions(spark, _write_lines(spark, sf_dir))
    return faults.select(F.regexp_extract("file", r"part=(\d+)", 1).cast("bigint").alias("part"), "line", "error_code", F.array_join("details", ",").alias("details"))


@query(f"""WITH {_LINES}, g AS (SELECT count(*) AS n FROM k WHERE NOT broken AND NOT blank_ AND (conv_id + turn) % 17 <> 0 AND (conv_id + turn) % 13 <> 0 AND (conv_id + turn) % 19 <> 0 AND (conv_id + turn) % 5 <> 0)
SELECT 'd' AS dataset_id, 'question_count_mismatch' AS error_code, (n + 1) || ' != ' || n AS detail FROM g""")
def dataset_manifest(spark, sf_dir):
    """What stays of the lines is written with a manifest that counts one too many; scanned again, the manifest is found wrong."""
    good, _ = datasets.questions(spark, _write_lines(spark, sf_dir))
    path = fresh_path(spark, "dataset")
    datasets.write_dataset(path, good, "d", "k1", ~c("expect_abstention"))
    again, faults = datasets.questions(spark, f"{path}/questions")
    said = spark.read.schema(datasets.MANIFEST).json(f"{path}/manifest").withColumn("question_count", c("question_count") + 1 + faults.count())
    said.write.json(f"{path}/other")
    return datasets.manifest_errors(spark, f"{path}/other", again)


def _as_runs(spark, sf_dir, path: str) -> None:
    """Users as experiments of five workspaces; every seventh is run again with other metrics; every ninth has no summary, every fourth no metrics."""
    e = table(spark, sf_dir, "events").withColumns({"experiment_id": c("user_id").cast("string"), "hit": (c("value") > 20).cast("double")})
    u = e.groupBy("experiment_id", "user_id").agg(F.min("ts").alias("created_at"), F.avg("value").alias("mrr"), F.avg("hit").alias("recall_at_k"), F.count("*").alias("question_count"), F.count_if(c("event_type") == "error").alias("error_count"))
    name = lambda x: x.cast("string")
    for rows, shift in ((u, 0.0), (u.where("user_id % 7 = 0"), 1.0)):
        config = rows.select("experiment_id", name(c("user_id") % 5).alias("workspace_id"), F.concat(F.lit("run "), "experiment_id").alias("name"), name(c("user_id") % 3).alias("knowledge_base_id"), name(c("user_id") % 11).alias("dataset_id"), F.lit("1").alias("dataset_version"), "created_at", F.lit(8).alias("top_k"))
        failing = F.array_compact(F.array(F.when(c("recall_at_k") < 0.5, "recall_at_k")))
        summary = rows.where("user_id % 9 <> 0").select("experiment_id", F.when(F.size(failing) > 0, "failed").otherwise("passed").alias("status"), failing.alias("failing_metrics"), "question_count", "error_count")
        runs.write(path, config, e.join(rows.select("experiment_id"), "experiment_id", "left_semi").select("experiment_id", c("event_id").alias("question_id"), "value"), rows.where("user_id % 4 <> 0").select("experiment_id", (c("recall_at_k") + shift).alias("recall_at_k"), "mrr"), summary)


@query("""WITH u AS (SELECT user_id, min(ts) AS created_at, avg(value) AS mrr, avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END) AS recall, count(*) AS question_count, count(*) FILTER (event_type = 'error') AS error_count FROM events GROUP BY 1)
SELECT CAST(user_id AS VARCHAR) AS experiment_id, CAST(user_id % 11 AS VARCHAR) AS dataset_id, CASE WHEN recall < 0.5 THEN 'failed' ELSE 'passed' END AS status, question_count, error_count,
 CASE WHEN user_id % 4 <> 0 THEN round(recall + CASE WHEN user_id % 7 = 0 THEN 1 ELSE 0 END, 6) END AS recall_at_k, CASE WHEN user_id % 4 <> 0 THEN round(mrr, 6) END AS mrr
FROM u WHERE user_id % 5 = 2 AND user_id % 3 = 1 AND user_id % 9 <> 0 ORDER BY created_at DESC, CAST(user_id AS VARCHAR) LIMIT 50""")
def run_catalogue(spark, sf_dir):
    """Runs of one workspace and knowledge base, the newest first, the last attempt of each."""
    path = fresh_path(spark, "runs")
    _as_runs(spark, sf_dir, path)
    out = runs.catalogue(spark, path, "2", 50, knowledge_base_id="1")
    return out.select("experiment_id", "dataset_id", "status", "question_count", "error_count", r6(c("recall_at_k")).alias("recall_at_k"), r6(c("mrr")).alias("mrr"))


@query("""SELECT DISTINCT CAST(user_id % 11 AS VARCHAR) AS dataset_id FROM events WHERE user_id % 5 = 3 AND user_id % 9 <> 0""")
def run_datasets(spark, sf_dir):
    """The datasets of a workspace's runs."""
    path = fresh_path(spark, "runs")
    _as_runs(spark, sf_dir, path)
    return runs.dataset_ids(spark, path, "3")


@query("""SELECT event_id AS question_id, 'baseline' AS cohort, round(value, 4) AS score, CAST(event_id AS VARCHAR) || '|x' AS citations FROM events""")
def diagnostics_files(spark, sf_dir):
    """The flat file of a report, a row for each question, read back."""
    e = table(spark, sf_dir, "events")
    path = fresh_path(spark, "diagnostics")
    q = e.select(c("event_id").alias("question_id"), F.lit("baseline").alias("cohort"), F.round("value", 4).alias("score"), F.array(c("event_id").cast("string"), F.lit("x")).alias("citations"))
    files.write_diagnostics(path, e.agg(F.count("*").alias("n")), q, e.groupBy("event_type").agg(F.count("*").alias("n")))
    return spark.read.schema("question_id bigint, cohort string, score double, citations string").option("header", True).csv(f"{path}/questions")


@query(f"WITH {_BM25} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM lex WHERE rank <= 30")
def stored_lexical_search(spark, sf_dir):
    """Documents stored as a lexical index in two batches, and searched without reading them again."""
    path, k = fresh_path(spark, "lexical"), corpus(spark, sf_dir)
    for half in (0, 1):
        lexical.add(R.segments(k.where(c("chunk_id") % 2 == half)), path, "b", "m")
    index, size, wrong = lexical.load(spark, path, "b", "m")
    if wrong.count():
        raise ValueError("the stored index has lost blocks")
    return R.ranked_hits(lexical.search(index, size, asked(spark, sf_dir), 30), 30).select("query_id", "chunk_id", "rank", r6(c("score")).alias("score"))
