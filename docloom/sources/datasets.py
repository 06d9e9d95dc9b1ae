"""Golden-question datasets: JSON lines with a manifest, every fault with its file and line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

c = F.col
QUESTION = "id string, question string, expected_answer string, expected_citations array<struct<chunk_id:string,document_id:string,document_version_id:string,rank_hint:int>>, knowledge_base_id string, difficulty string, language string, tags array<string>, expect_abstention boolean, notes string"
MANIFEST = "dataset_id string, dataset_version string, knowledge_base_id string, question_count int, languages array<string>, created_at string, notes string, language_default string"
REQUIRED = ["id", "question", "expected_answer", "expected_citations", "knowledge_base_id", "difficulty", "language", "tags"]
#: Fixed values.
DIFFICULTIES = ["easy", "medium", "hard"]
LANGUAGES = ["fa", "en"]


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file, block (where the split of the file begins), at (grows by one from line to line of a split)."""
    return spark.read.text(path).select("value", c("_metadata.file_path").alias("file"), c("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))


def line_numbers(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """rows of `text_lines` with `line`, from 1 in each file, however the scan splits it: lines before the split, and before the row in it.

    What is shuffled is a row for each split, and the rows asked for."""
    splits = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.join(splits.select("file", "block", "first", before.alias("before")), ["file", "block"]).withColumn("line", c("before") + c("at") - c("first") + 1).drop("first", "before")


def _blank(x: Column | str) -> Column:
    return F.coalesce(F.trim(x), F.lit("")) == ""


def questions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(questions, faults: file, line, error_code, details). Blank lines are passed over, but count as lines.

    A line that is no JSON is a malformed_line; one that breaks the schema is an invalid_question, with what is wrong."""
    schema = T.StructType.fromDDL(QUESTION).add("_bad", T.StringType())
    lines = text_lines(spark, path)
    read = F.from_json("value", schema, {"columnNameOfCorruptRecord": "_bad"})
    rows = lines.where(~_blank("value")).withColumns({"q": read, "json": F.try_parse_json("value").isNotNull()})
    field = lambda name: c(f"q.{name}")
    wrong = F.array_compact(F.array(
        F.when(c("q._bad").isNotNull(), "wrong_type"), *(F.when(field(n).isNull(), f"missing_{n}") for n in REQUIRED),
        *(F.when(field(n).isNotNull() & _blank(field(n)), f"blank_{n}") for n in ("id", "question")), F.when(F.size(field("tags")) == 0, "empty_tags"),
        F.when(~field("difficulty").isin(DIFFICULTIES), "unknown_difficulty"), F.when(~field("language").isin(LANGUAGES), "unknown_language"),
        F.when(F.exists(F.coalesce(field("expected_citations"), F.array().cast("array<struct<chunk_id:string,document_id:string,document_version_id:string,rank_hint:int>>")), lambda x: x["chunk_id"].isNull()), "missing_chunk_id")))
    checked = rows.withColumn("details", F.when(c("json"), wrong).otherwise(F.array().cast("array<string>")))
    good = checked.where(c("json") & (F.size("details") == 0)).select("q.*").drop("_bad").withColumn("expect_abstention", F.coalesce("expect_abstention", F.lit(False)))
    faults = checked.where(~c("json") | (F.size("details") > 0)).select("file", "block", "at", F.when(c("json"), "invalid_question").otherwise("malformed_line").alias("error_code"), "details")
    return good, line_numbers(faults, lines).select("file", "line", "error_code", "details")


def manifest_errors(spark: SparkSession, path: str, found: DataFrame) -> DataFrame:
    """dataset_id, error_code, detail: what the manifest (a file of JSON) and the questions disagree on."""
    m = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    n = found.agg(F.count("*").alias("n"), F.count_distinct("knowledge_base_id").alias("bases"), F.min("knowledge_base_id").alias("base"))
    fault = lambda when, code, detail: F.when(when, F.struct(F.lit(code).alias("error_code"), detail.alias("detail")))
    errors = F.array_compact(F.array(
        fault(c("dataset_id").isNull() | c("dataset_version").isNull() | c("knowledge_base_id").isNull(), "invalid_manifest", F.lit("")),
        fault(c("n") == 0, "no_questions", F.lit("")),
        fault(c("question_count").isNotNull() & (c("question_count") != c("n")), "question_count_mismatch", F.concat_ws(" != ", c("question_count").cast("string"), c("n").cast("string"))),
        fault(c("bases") > 1, "several_knowledge_bases", c("bases").cast("string"))))
    return m.join(n).select("dataset_id", F.explode(errors).alias("e")).select("dataset_id", "e.error_code", "e.detail")


def write_dataset(path: str, rows: DataFrame, dataset_id: str, knowledge_base_id: str, measured: Column) -> None:
    """Questions as JSON lines, then a manifest with their number and how many of them count as measured."""
    spark = rows.sparkSession
    rows.select([f.name for f in T.StructType.fromDDL(QUESTION)]).write.json(f"{path}/questions")
    n = rows.agg(F.count("*").cast("int").alias("question_count"), F.count_if(measured).alias("measured_eligible_count"))
    said = n.select(F.lit(dataset_id).alias("dataset_id"), F.lit("1.0.0").alias("dataset_version"), F.lit(knowledge_base_id).alias("knowledge_base_id"), "question_count", "measured_eligible_count", F.array(F.lit("fa")).alias("languages"), F.lit("fa").alias("language_default"))
    said.coalesce(1).write.json(f"{path}/manifest")
