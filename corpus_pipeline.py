"""From raw documents to packed training sequences, in five stages.

Each stage's result is written as Parquet in the shared folder and read back as the documents of
the next. SQL cannot express the learnt grammar or the tokenizer, so ORACLE_SQL is None and the
stages are tested against brute force in tests/llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import scratch, stages

STAGES = [
    ("toxicity", stages.toxicity_stage),
    ("line dedup", stages.line_stage),
    ("n-gram Jaccard join", stages.jaccard_stage),
    ("benchmark decontamination", stages.decontamination_stage),
    ("best-fit packing", stages.packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scratch.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
