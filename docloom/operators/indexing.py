"""Maintenance of the embedding index (X01-X13): whole snapshots in, whole snapshots out.

Embeddings: chunk_id, embedding_model_id, content_hash, generation, index_status, vector.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import retrieval as R

BATCH_TEXTS, BATCH_CHARS, RETRIES = 32, 50_000, 3
KEY = ["chunk_id", "embedding_model_id"]


def hash_vector(text: str, dimensions: int) -> list[float]:
    """A unit vector from a chain of SHA-256 digests."""
    digest, numbers = hashlib.sha256(text.encode()).digest(), []
    while len(numbers) < dimensions:
        numbers += np.frombuffer(digest, ">u4").tolist()
        digest = hashlib.sha256(digest).digest()
    v = np.array(numbers[:dimensions]) / 0xFFFFFFFF * 2 - 1
    return (v / (np.linalg.norm(v) or 1.0)).tolist()


def hash_embedder(dimensions: int = 64) -> Callable[[list[str]], list[list[float]]]:
    return lambda texts: [hash_vector(t, dimensions) for t in texts]


def query_text(column: str):
    return F.concat(F.lit("query::"), column)


def _batches(rows: list[tuple]) -> Iterator[list[tuple]]:
    batch, size = [], 0
    for row in rows:
        if batch and (len(batch) >= BATCH_TEXTS or size + len(row[1]) > BATCH_CHARS):
            yield batch
            batch, size = [], 0
        batch.append(row)
        size += len(row[1])
    if batch:
        yield batch


def _embedded(batch: list[tuple], embed: Callable) -> list[tuple]:
    """A failing batch is halved, a single text tried again; what still fails has no vector."""
    for _ in range(1 if len(batch) > 1 else RETRIES):
        try:
            return [(i, v, None) for (i, _), v in zip(batch, embed([t for _, t in batch]), strict=True)]
        except Exception as e:  # the embedder is the user's: any error is a row's failure
            failure = type(e).__name__
    if len(batch) == 1:
        return [(batch[0][0], None, failure)]
    half = len(batch) // 2
    return _embedded(batch[:half], embed) + _embedded(batch[half:], embed)


def embed(chunks: DataFrame, make: Callable[[], Callable[[list[str]], list[list[float]]]]) -> DataFrame:
    """chunk_id, vector, failure. `make` builds the embedder, once for each task."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embedder = make()
        for frame in frames:
            rows = list(zip(frame["chunk_id"], frame["text"].fillna("")))
            for b in _batches(rows):  # the vectors of few texts are Python's at a time
                yield pd.DataFrame(_embedded(b, embedder), columns=["chunk_id", "vector", "failure"])

    return chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), "text").mapInPandas(run, "chunk_id string, vector array<double>, failure string")


def pending(chunks: DataFrame, index: DataFrame, model: str) -> DataFrame:
    """Chunks without an indexed embedding of this model and content."""
    have = index.where((F.col("index_status") == "indexed") & (F.col("embedding_model_id") == model)).select("chunk_id", "content_hash")
    return chunks.join(have, ["chunk_id", "content_hash"], "left_anti")


def wrong_dimensions(rows: DataFrame, dimensions: int) -> DataFrame:
    """X04."""
    return rows.where(F.size("vector") != dimensions).select("chunk_id", F.size("vector").alias("dimensions"), F.lit("dimension_mismatch").alias("error_code"))


def upsert(index: DataFrame, new: DataFrame) -> DataFrame:
    """New embeddings as the next generation of their chunk and model; earlier ones become stale."""
    last = index.groupBy(*KEY).agg(F.max("generation").alias("last"))
    rows = new.join(last, KEY, "left").withColumns({"generation": (F.coalesce("last", F.lit(0)) + 1).cast("int"), "index_status": F.lit("indexed")}).drop("last")
    touched = new.select(*KEY).distinct().withColumn("_new", F.lit(True))
    old = index.join(touched, KEY, "left").withColumn("index_status", F.when(F.col("_new") & (F.col("index_status") == "indexed"), "stale").otherwise(F.col("index_status"))).drop("_new")
    return old.unionByName(rows)


def supersede(versions: DataFrame, chunks: DataFrame, index: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Other versions of the documents of `current` (document_id, document_version_id), their chunks and embeddings."""
    keep = current.select("document_id", F.col("document_version_id").alias("_keep"))
    v = versions.join(keep, "document_id", "left")
    gone = F.col("_keep").isNotNull() & (F.col("document_version_id") != F.col("_keep")) & F.col("processing_status").isin("indexed", "chunked", "indexing")
    marked = v.withColumn("processing_status", F.when(gone, "superseded").otherwise(F.col("processing_status"))).drop("_keep")
    ids = v.where(gone).select("document_version_id").withColumn("_gone", F.lit(True))
    c = chunks.join(ids, "document_version_id", "left")
    out = c.withColumn("status", F.when(F.col("_gone"), "superseded").otherwise(F.col("status"))).drop("_gone")
    dead = c.where("_gone").select("chunk_id").distinct().withColumn("_gone", F.lit(True))
    stale = index.join(dead, "chunk_id", "left").withColumn("index_status", F.when(F.col("_gone") & (F.col("index_status") == "indexed"), "stale").otherwise(F.col("index_status"))).drop("_gone")
    return marked, out, stale


def incomplete(chunks: DataFrame, index: DataFrame, model: str) -> DataFrame:
    """Versions with chunks left without an embedding."""
    return pending(chunks, index, model).groupBy("document_version_id").agg(F.count("*").alias("remaining")).withColumn("failure_reason", F.lit("partial_embedding_failure"))


#: X08, fixed values: states from which a version can be indexed or reindexed, and resumed.
INDEXABLE = ["chunked", "indexing", "failed", "indexed"]
RESUMABLE = ["failed", "indexing", "chunked"]


def transitions(versions: DataFrame, requests: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """document_version_id, request (index, reindex, resume), next (state, or already_indexed), failure_reason, error_code.

    What can be indexed goes on to indexing, from a failure or an interruption too; an indexed version is left as it is
    unless it is to be reindexed, and cannot be resumed. With chunks given, a version without any fails as an empty_chunk_list."""
    rows = requests.join(versions.select("document_version_id", "processing_status"), "document_version_id", "left")
    have = F.lit(True)
    if chunks is not None:
        rows = rows.join(chunks.select("document_version_id").distinct().withColumn("_some", F.lit(True)), "document_version_id", "left")
        have = F.coalesce(F.col("_some"), F.lit(False))
    state, request = F.col("processing_status"), F.col("request")
    code = (F.when(~request.isin("index", "reindex", "resume"), "unknown_request").when(state.isNull(), "version_not_found")
            .when((request == "resume") & ~state.isin(RESUMABLE), "version_not_resumable").when(~state.isin(INDEXABLE), "version_not_indexable"))
    held = (request == "index") & (state == "indexed")
    after = F.when(code.isNotNull(), None).when(held, "already_indexed").when(have, "indexing").otherwise("failed")
    reason = F.when(code.isNull() & ~held & ~have, "empty_chunk_list")
    return rows.select("document_version_id", "request", after.alias("next"), reason.alias("failure_reason"), code.alias("error_code"))


def summary(results: DataFrame) -> DataFrame:
    """Created, skipped and failed per version. Results: document_version_id, outcome."""
    n = lambda what: F.count_if(F.col("outcome") == what).alias(what)
    return results.groupBy("document_version_id").agg(n("created"), n("skipped"), n("failed"))


def indexed_count(index: DataFrame, model: str) -> DataFrame:
    """X10."""
    return index.where((F.col("embedding_model_id") == model) & (F.col("index_status") == "indexed")).agg(F.count("*").alias("indexed"))


def alignment(index: DataFrame, chunks: DataFrame, make: Callable, dimensions: int, least: float = 0.98, sample: int = 20) -> DataFrame:
    """X11: one row: models, dimensions, smallest cosine of a sample embedded anew, reindex_required."""
    part = index.where("index_status = 'indexed'").orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).select(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("vector").alias("held"))
    again = embed(chunks.join(part.select("chunk_id"), "chunk_id", "left_semi"), make).join(part, "chunk_id")
    worst = again.agg(F.min(R.cosine(F.col("vector"), F.col("held"))).alias("least_cosine"))
    kinds = index.where("index_status = 'indexed'").agg(F.sort_array(F.collect_set("embedding_model_id")).alias("models"), F.sort_array(F.collect_set(F.size("vector"))).alias("dimensions"))
    bad = (F.size("models") > 1) | (F.size("dimensions") > 1) | (F.element_at("dimensions", 1) != dimensions) | (F.coalesce("least_cosine", F.lit(1.0)) < least)
    return kinds.join(worst).withColumn("reindex_required", F.coalesce(bad, F.lit(False)))


def storage_bytes(index: DataFrame) -> DataFrame:
    """X12."""
    return index.agg((F.count("*") * F.coalesce(F.avg(F.size("vector")), F.lit(0.0)) * 4).cast("bigint").alias("bytes"))
