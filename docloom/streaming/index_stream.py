"""Process and index (X13) as one job, and as a stream of new versions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import chunking, indexing
from docloom.sources import files
from docloom.sources.shared import settle

VERSION = "doc_id long, document_id string, document_version_id string, text string"


def process(versions: DataFrame, make: Callable, model: str, dimensions: int, held: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(embeddings with their chunks, outcome of each version): extract, chunk, embed; failures are rows.

    `held` (content_hash, embedding_model_id, vector) are embeddings made before: chunks of a content and model that it holds
    take its vector, and only the others are embedded, each content once. Texts are read once: chunks, with a row for each version
    without any, are written as they are made, and vectors once; counts need no texts and no vectors."""
    every = settle(chunk_stream(versions), "chunks")
    chunks = every.where("chunk_id is not null")
    known = chunks.sparkSession.createDataFrame([], "content_hash string, vector array<double>")
    if held is not None:
        mine = held.where((F.col("embedding_model_id") == model) & (F.size("vector") == dimensions)).select("content_hash", "vector")
        known = mine.join(chunks.select("content_hash").distinct(), "content_hash", "left_semi").dropDuplicates(["content_hash"])
    new = chunks.select("content_hash", "text").join(known.select("content_hash"), "content_hash", "left_anti") if held is not None else chunks.select("content_hash", "text").repartition("content_hash")
    new = new.dropDuplicates(["content_hash"]).select(F.col("content_hash").alias("chunk_id"), "text")
    made = indexing.embed(new, make).select(F.col("chunk_id").alias("content_hash"), "vector", "failure", F.lit(False).alias("skipped"))
    vectors = made.unionByName(known.select("content_hash", "vector", F.lit(None).cast("string").alias("failure"), F.lit(True).alias("skipped")))
    vectors = settle(vectors.withColumn("good", F.col("failure").isNull() & F.coalesce(F.size("vector") == dimensions, F.lit(False))), "vectors")
    counted = chunks.select("document_id", "document_version_id", "content_hash").join(vectors.select("content_hash", "good", "skipped"), "content_hash")
    counts = counted.groupBy("document_id", "document_version_id").agg(F.count_if(F.expr("good and not skipped")).alias("created"), F.count_if(F.expr("good and skipped")).alias("skipped"), F.count_if(F.expr("not good")).alias("failed"))
    done = counts.withColumn("failure_reason", F.when(F.col("failed") > 0, "partial_embedding_failure"))
    none = every.where("chunk_id is null").select("document_id", "document_version_id", *(F.lit(0).cast("bigint").alias(n) for n in ("created", "skipped", "failed")), F.col("content_hash").alias("failure_reason"))
    outcome = done.unionByName(none).withColumn("processing_status", F.when(F.col("failure_reason").isNull(), "indexed").otherwise("failed"))
    rows = chunks.join(vectors.where("good").select("content_hash", "vector"), "content_hash").withColumn("embedding_model_id", F.lit(model))
    return rows.select("document_id", "document_version_id", "chunk_id", "sequence_number", "text", "content_hash", "embedding_model_id", "vector"), outcome


IDS = ["doc_id", "document_id", "document_version_id"]
_CHUNK = "doc_id long, document_id string, document_version_id string, chunk_id string, sequence_number int, text string, content_hash string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def chunk_stream(versions: DataFrame) -> DataFrame:
    """Versions as chunks, row by row: the columns of _CHUNK; a version without chunks is a row with the hash of an empty or a blank text."""
    records = versions.withColumn("text", T.normalize("text"))
    keyed = records.select(F.struct(*IDS, T.blank("text").alias("blank")).alias("doc_id"), F.when(~T.blank("text"), F.col("text")).otherwise("").alias("text"))
    rows = chunking.pieces(keyed, outer=True)
    number = F.concat_ws("-", "doc_id.doc_id", "sequence_number")
    code = F.when(F.col("doc_id.blank"), "empty_content").otherwise("empty_chunk_list")
    return rows.select(*(f"doc_id.{c}" for c in IDS), F.when(F.col("text").isNotNull(), number).alias("chunk_id"), "sequence_number", "text", F.when(F.col("text").isNotNull(), F.sha2("text", 256)).otherwise(code).alias("content_hash"))


def marked(chunks: DataFrame) -> DataFrame:
    """Every chunk as a row with first=false, and once more, with first=true, where its content was never seen before.

    Which contents were seen is the keyed state of the stream: a batch looks up its own contents, whatever the index holds."""
    seen = chunks.where("chunk_id is not null").dropDuplicates(["content_hash"])
    return chunks.withColumn("first", F.lit(False)).unionByName(seen.withColumn("first", F.lit(True)))


def _before(spark: SparkSession, path: str, number: int) -> DataFrame | None:
    """A table of the index as it was before a batch; None where there is none yet."""
    try:
        return spark.read.parquet(path).where(F.col("batch_id") < number)
    except AnalysisException:
        return None


def run_stream(spark: SparkSession, source: str, index: str, checkpoint: str, make: Callable, model: str, dimensions: int) -> None:
    """New versions, as they come, become chunks; contents seen for the first time are embedded, each once.

    The index is four tables by batch: chunks (of versions; once more, under first, for new contents), vectors (of contents),
    failures and versions; what was embedded for a batch lies beside them (made). Which contents are new is the stream's keyed state (RocksDB), so a batch reads no earlier chunks or vectors, only earlier failures of contents
    that came again, which are tried again. A batch that is repeated after a crash sees the state it saw before, and writes
    over its own folders."""
    def batch(rows: DataFrame, number: int) -> None:
        at = lambda table: f"{index}/{table}/batch_id={number}"
        rows.write.mode("overwrite").partitionBy("first").option("compression", "zstd").parquet(at("chunks"))
        both = spark.read.schema(_CHUNK + ", first boolean").parquet(at("chunks"))
        key = ["document_version_id", "chunk_id", "content_hash"]
        new = both.where("first").select(*key, F.lit(True).alias("is_new")).dropDuplicates()
        own = both.where("not first").select(*IDS, "chunk_id", "content_hash").join(new, key, "left").withColumn("is_new", F.coalesce("is_new", F.lit(False)))
        todo = both.where("first").select("content_hash", "text")
        failed = _before(spark, f"{index}/failures", number)
        if failed is not None:
            again = both.where("not first and chunk_id is not null").join(todo.select("content_hash"), "content_hash", "left_anti")
            todo = todo.unionByName(again.join(failed.select("content_hash").distinct(), "content_hash", "left_semi").select("content_hash", "text"))
        made = indexing.embed(todo.dropDuplicates(["content_hash"]).select(F.col("content_hash").alias("chunk_id"), "text"), make)
        good = F.col("failure").isNull() & (F.size("vector") == dimensions)
        made.select(F.col("chunk_id").alias("content_hash"), F.lit(model).alias("embedding_model_id"), "vector", F.when(good, None).otherwise(F.coalesce("failure", F.lit("dimension_mismatch"))).alias("failure")).write.mode("overwrite").parquet(at("made"))
        done = spark.read.parquet(at("made"))
        done.where("failure is null").drop("failure").write.mode("overwrite").parquet(at("vectors"))
        done.where("failure is not null").select("content_hash", "failure").write.mode("overwrite").parquet(at("failures"))
        results = own.join(done.select("content_hash", "failure", F.lit(True).alias("tried")), "content_hash", "left")
        lost, some = F.col("failure").isNotNull(), F.col("chunk_id").isNotNull()
        n = lambda when, name: F.count_if(when).alias(name)
        counts = results.groupBy(*IDS[1:]).agg(n(some & F.col("is_new") & ~lost, "created"), n(some & ~F.col("is_new") & ~lost, "skipped"), n(some & lost, "failed"), F.max(F.when(~some, F.col("content_hash"))).alias("empty"))
        code = F.coalesce("empty", F.when(F.col("failed") > 0, "partial_embedding_failure"))
        outcome = counts.select(*IDS[1:], "created", "skipped", "failed", code.alias("failure_reason"), F.when(code.isNull(), "indexed").otherwise("failed").alias("processing_status"))
        outcome.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(at("versions"))

    stream = marked(chunk_stream(spark.readStream.schema(VERSION).parquet(source)))
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def current(spark: SparkSession, index: str) -> DataFrame:
    """The embeddings of the newest indexed version of each document; older versions are superseded."""
    done = spark.read.parquet(f"{index}/versions").where("processing_status = 'indexed'")
    newest = done.groupBy("document_id").agg(F.max_by("document_version_id", F.struct("batch", "document_version_id")).alias("document_version_id"))
    rows = spark.read.parquet(f"{index}/chunks").where("not first and chunk_id is not null").drop("first").join(newest, ["document_id", "document_version_id"], "left_semi")
    once = files.latest(rows.withColumn("_key", F.concat_ws("/", "document_version_id", "chunk_id")), "_key", "batch_id").drop("_key")
    vectors = spark.read.parquet(f"{index}/vectors").drop("batch_id").dropDuplicates(["content_hash"])
    return once.join(vectors, "content_hash")
