"""Tables of a folder, and tables written between steps in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables with long texts: a scan of fewer tasks than cores is dealt out before the work on texts begins.
TEXTS = {"documents", "pages", "benchmark"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXTS else df


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores; a larger scan stays as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder named by spark.checkpoint.dir.

    A folder of this machine is used only where Spark runs in one process and names none."""
    context = spark.sparkContext
    at = context.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="docloom-")
    return f"{at}/docloom-{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, for steps that are read more than once."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
