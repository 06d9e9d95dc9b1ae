"""Artifacts of experiment runs, committed whole, and their catalogue.

An attempt writes config, results, metrics and summary into a folder of its own, then one line for each experiment into
the commits of its workspace. Only commits are read: an attempt that died leaves nothing, and of several attempts of an
experiment the last committed one counts. Readers find the attempts of a workspace first and then open no others.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

c = F.col
CONFIG = "experiment_id string, workspace_id string, name string, knowledge_base_id string, dataset_id string, dataset_version string, created_at timestamp, top_k int"
SUMMARY = "experiment_id string, status string, failing_metrics array<string>, question_count bigint, error_count bigint"
COMMIT = "experiment_id string, attempt string, committed_at timestamp, knowledge_base_id string, dataset_id string, created_at timestamp"


def write(path: str, config: DataFrame, results: DataFrame, metrics: DataFrame, summary: DataFrame) -> str:
    """One attempt of any number of experiments; its name. Every table has experiment_id."""
    attempt = uuid.uuid4().hex
    config, summary = (rows.select([c(f.name).cast(f.dataType) for f in T.StructType.fromDDL(ddl)]) for rows, ddl in ((config, CONFIG), (summary, SUMMARY)))
    for name, rows in (("config", config), ("results", results), ("metrics", metrics), ("summary", summary)):
        rows.write.parquet(f"{path}/{name}/attempt={attempt}")
    lines = config.join(summary.select("experiment_id"), "experiment_id", "left_semi")  # a run without a summary is none
    lines.select("experiment_id", "workspace_id", F.lit(attempt).alias("attempt"), F.current_timestamp().alias("committed_at"), "knowledge_base_id", "dataset_id", "created_at").write.mode("append").partitionBy("workspace_id").parquet(f"{path}/commits")
    return attempt


def committed(spark: SparkSession, path: str, workspace: str) -> DataFrame:
    """The last commit of each experiment of a workspace; other workspaces are not read."""
    rows = spark.read.schema(COMMIT + ", workspace_id string").parquet(f"{path}/commits").where(c("workspace_id") == workspace)
    newest = F.row_number().over(W.partitionBy("experiment_id").orderBy(F.desc("committed_at"), F.desc("attempt")))
    return rows.withColumn("_n", newest).where("_n = 1").drop("_n")


def _of(spark: SparkSession, path: str, table: str, chosen: DataFrame, attempts: list[str], schema: str | None = None) -> DataFrame:
    """Rows of a table that the chosen commits name, from the folders of their attempts alone."""
    reader = spark.read.schema(schema + ", attempt string") if schema else spark.read
    return reader.parquet(f"{path}/{table}").where(c("attempt").isin(attempts)).join(chosen.select("experiment_id", "attempt"), ["experiment_id", "attempt"], "left_semi")


def catalogue(spark: SparkSession, path: str, workspace: str, limit: int = 50, knowledge_base_id: str | None = None, dataset_id: str | None = None, metrics: str = "recall_at_k double, mrr double") -> DataFrame:
    """The newest runs, with config, summary and metrics (null where a run has none)."""
    chosen = committed(spark, path, workspace)
    chosen = chosen.where(c("knowledge_base_id") == knowledge_base_id) if knowledge_base_id else chosen
    chosen = chosen.where(c("dataset_id") == dataset_id) if dataset_id else chosen
    chosen = chosen.orderBy(F.desc("created_at"), "experiment_id").limit(limit)
    attempts = [r["attempt"] for r in chosen.select("attempt").distinct().collect()]  # at most limit
    of = lambda table, schema: _of(spark, path, table, chosen, attempts, schema).drop("attempt")
    rows = of("config", CONFIG).join(of("summary", SUMMARY), "experiment_id").join(of("metrics", f"experiment_id string, {metrics}"), "experiment_id", "left")
    return rows.orderBy(F.desc("created_at"), "experiment_id")


def results(spark: SparkSession, path: str, workspace: str, experiment_id: str) -> DataFrame:
    """The per-question results of one run, of its last committed attempt."""
    chosen = committed(spark, path, workspace).where(c("experiment_id") == experiment_id)
    return _of(spark, path, "results", chosen, [r["attempt"] for r in chosen.select("attempt").collect()])


def dataset_ids(spark: SparkSession, path: str, workspace: str) -> DataFrame:
    """The datasets of a workspace's runs."""
    return committed(spark, path, workspace).where("dataset_id is not null").select("dataset_id").distinct()
