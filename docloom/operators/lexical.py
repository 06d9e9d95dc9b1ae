"""A lexical index of posting blocks, stored and added to, and MaxScore search over it.

A shard is at most about twenty thousand neighbouring segments and a million tokens, so that building one takes the same
memory for any size of the corpus. Of each of its tokens a block holds the places of the segments in
the shard and the token's counts there; the block of the empty token is the shard's head: chunk and length of each place,
and the chunk ids in order. Blocks are written by the tasks that read the texts, without a shuffle.

A stored index is a folder of batches. A batch becomes part of it with its line in the manifest, which is written last
and says how many blocks it has; adding documents adds a batch and rewrites nothing. Counts over all documents come from
the manifest and from the blocks of the tokens that are asked for.

Search sends the query tokens to the tasks (at most about MANY entries at a time) and each block that they need to the
task of its shard, once for all queries. There, lists whose largest contributions together stay below the k-th score
found so far open no segment; they are probed for segments that others open, while those can still reach that score.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docloom.functions import constants as K

#: Segments, and tokens, of a shard, about; segments that are scored at a time; entries of queries that are sent at once.
SHARD, SHARD_TOKENS, STEP, MANY = 20_000, 1_000_000, 4096, 50_000
#: Scores are ranked to nine places, so bounds are left this much room.
ROOM = 2e-9


def _blocks_of(batches: list[pa.RecordBatch], shard: int, vocabulary: pa.Array | None, names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    t = pa.Table.from_batches(batches)
    t = t.take(pc.sort_indices(t, sort_keys=[("chunk_id", "ascending"), ("segment", "ascending")])).combine_chunks()
    lists, ids = t.column("tokens").combine_chunks(), t.column("chunk_id").combine_chunks()
    sizes = pc.list_value_length(lists).to_numpy()
    known = pc.unique(ids)
    ordinal = pc.index_in(ids, known).to_numpy()  # in the order of chunk ids, as rows are sorted
    tokens, place = lists.flatten(), np.repeat(np.arange(len(sizes)), sizes)
    if vocabulary is not None:
        mine = pc.is_in(tokens, vocabulary)
        tokens, place = tokens.filter(mine), place[mine.to_numpy(zero_copy_only=False)]
    coded = tokens.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    key, count = np.unique(rank[coded.indices.to_numpy()] * len(sizes) + place, return_counts=True) if len(tokens) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    first = np.searchsorted(key // max(len(sizes), 1), np.arange(len(order) + 1))
    at = pa.array(np.concatenate([[0], len(sizes) + first]).astype(np.int32))
    ends = np.zeros(len(order) + 2, np.int32)
    ends[1:] = len(known)
    columns = [
        pa.array(np.full(len(order) + 1, shard), pa.int64()), pa.concat_arrays([pa.array([""]), coded.dictionary.take(pa.array(order)).cast(pa.string())]),
        pa.ListArray.from_arrays(at, pa.array(np.concatenate([ordinal, key % max(len(sizes), 1)]).astype(np.int32))),
        pa.ListArray.from_arrays(at, pa.array(np.concatenate([sizes, count]).astype(np.int32))), pa.ListArray.from_arrays(pa.array(ends), known),
    ]
    return pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(columns, kinds)], names=names)


def blocks(found: DataFrame, vocabulary: DataFrame | None = None, shard: int = SHARD, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """shard, token, places, counts, chunk_ids (heads alone), of segments: chunk_id, segment, tokens (all or those of `vocabulary`, a bounded table).

    The segments of a chunk are those that stand together, as `segments` gives them. Segments without tokens and rows
    without chunk_id take no part."""
    spark = found.sparkSession
    sent = spark.sparkContext.broadcast(vocabulary.select("token").distinct().toArrow().column("token").combine_chunks() if vocabulary is not None else None)
    kind = found.schema["chunk_id"].dataType
    names = ["shard", "token", "places", "counts", "chunk_ids"]
    kinds = [pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(to_arrow_type(kind))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held, rows, tokens = TaskContext.get().partitionId(), 0, [], 0, 0
        for batch in batches:
            ids, at, many = batch.column("chunk_id"), 0, batch.num_rows
            upto = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column("tokens")).to_numpy(zero_copy_only=False), dtype=np.int64)])
            starts = np.nonzero(pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False))[0] + 1  # a shard ends where a chunk does
            if held and many and held[-1].column("chunk_id")[-1] != ids[0]:
                starts = np.concatenate([[0], starts])
            while at < many:
                full = max(at, min(at + shard - rows, int(np.searchsorted(upto, upto[at] + shard_tokens - tokens))))
                after = starts[np.searchsorted(starts, full) :]
                cut = int(after[0]) if len(after) else many
                if cut > at:
                    held.append(batch.slice(at, cut - at))
                rows, tokens, at = rows + cut - at, tokens + int(upto[cut] - upto[at]), cut
                if len(after):
                    yield _blocks_of(held, (task << 24) + made, sent.value, names, kinds)
                    made, held, rows, tokens = made + 1, [], 0, 0
        if held:
            yield _blocks_of(held, (task << 24) + made, sent.value, names, kinds)

    rows = found.where("chunk_id is not null").where(F.size("tokens") > 0).select("chunk_id", "segment", "tokens")
    return rows.mapInArrow(run, f"shard bigint, token string, places array<int>, counts array<int>, chunk_ids array<{kind.simpleString()}>")


def size(heads: DataFrame) -> DataFrame:
    """segments, length (tokens of all segments)."""
    return heads.where("token = ''").agg(F.coalesce(F.sum(F.size("places")), F.lit(0)).alias("segments"), F.coalesce(F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda s, x: s + x)), F.lit(0)).alias("length"))


def add(found: DataFrame, path: str, base: str, model: str, shard: int = SHARD) -> str:
    """Add segments to the stored index of a knowledge base and model as one batch; its name.

    Blocks first, then the line of the manifest: a job that dies in between leaves the index as it was."""
    spark, batch = found.sparkSession, uuid.uuid4().hex
    at = f"{path}/blocks/base={base}/model={model}/batch={batch}"
    blocks(found, shard=shard).write.option("compression", "zstd").parquet(at)
    held = spark.read.parquet(at)
    line = size(held).join(held.agg(F.count("*").alias("blocks")))
    line.select(F.lit(base).alias("base"), F.lit(model).alias("model"), F.lit(batch).alias("batch"), "segments", "length", "blocks").write.mode("append").json(f"{path}/manifest")
    return batch


MANIFEST = "base string, model string, batch string, segments bigint, length bigint, blocks bigint"


def load(spark: SparkSession, path: str, base: str, model: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks, size, mismatch: batches that hold other numbers of blocks than the manifest says). Batches without a line are not read."""
    mine = (F.col("base") == base) & (F.col("model") == model)
    said = spark.read.schema(MANIFEST).json(f"{path}/manifest").where(mine)
    names = [r["batch"] for r in said.select("batch").collect()]  # one for each time that documents were added
    rows = spark.read.option("basePath", f"{path}/blocks").parquet(f"{path}/blocks").where(mine & F.col("batch").isin(names))
    counted = rows.groupBy("batch").agg(F.count("*").alias("found"))
    wrong = said.join(counted, "batch", "left").withColumn("found", F.coalesce("found", F.lit(0))).where("found != blocks").select("batch", "blocks", "found")
    number = F.create_map(*(x for n, name in enumerate(names) for x in (F.lit(name), F.lit(n)))) if names else F.create_map()
    own = rows.withColumn("shard", F.col("shard") + F.try_element_at(number, F.col("batch")).cast("bigint") * (1 << 44))
    total = said.agg(F.coalesce(F.sum("segments"), F.lit(0)).alias("segments"), F.coalesce(F.sum("length"), F.lit(0)).alias("length"))
    return own.select("shard", "token", "places", "counts", "chunk_ids"), total, wrong


class _Shard:
    """The lists of one shard: of each token the places and what the token adds there to a score, for a weight of 1."""

    def __init__(self, head: tuple[np.ndarray, np.ndarray], average: float, k1: float, b: float):
        self.chunk, lengths = head
        self.norm = k1 * (1 - b + b * lengths / max(average, 1e-9))
        self.k1, self.lists = k1, {}

    def add(self, token: str, places: np.ndarray, counts: np.ndarray) -> None:
        part = counts * (self.k1 + 1) / (counts + self.norm[places])
        self.lists[token] = places, part, float(part.max())

    def search(self, weights: list[tuple[str, float]], floor: float, k: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Chunks (by their number in the shard) that may be among the k best, with the score of their best segment."""
        held = sorted(((w * self.lists[t][2], w, t) for t, w in weights if t in self.lists and w > 0))
        below = np.cumsum([0.0] + [bound for bound, *_ in held])
        chunks, scores, least, at, n = np.zeros(0, np.int64), np.zeros(0), floor, 0, len(self.chunk)
        while at < n:
            opening = int(np.searchsorted(below[1:], least - ROOM, side="left"))  # lists from here on open segments
            if opening >= len(held):
                break
            until = min(n, at + STEP)
            sums = np.zeros(until - at)
            for _, w, t in held[opening:]:
                places, part, _ = self.lists[t]
                a, b = np.searchsorted(places, (at, until))
                sums[places[a:b] - at] += w * part[a:b]
            here = np.nonzero(sums)[0]
            score = sums[here]
            here += at
            for m in range(opening - 1, -1, -1):  # probe the others, the largest first
                may = score + below[m + 1] >= least - ROOM
                here, score = here[may], score[may]
                if not len(here):
                    break
                _, w, t = held[m]
                places, part, _ = self.lists[t]
                own = np.minimum(np.searchsorted(places, here), len(places) - 1)
                score = score + np.where(places[own] == here, w * part[own], 0.0)
            good = score >= least - ROOM
            chunks, scores = np.concatenate([chunks, self.chunk[here[good]]]), np.concatenate([scores, score[good]])
            order = np.lexsort((-scores, chunks))
            chunks, scores = chunks[order], scores[order]
            best = np.concatenate([[True], chunks[1:] != chunks[:-1]]) if len(chunks) else np.zeros(0, bool)
            chunks, scores = chunks[best], scores[best]
            if k is not None and len(chunks) >= k:
                order = np.lexsort((chunks, -np.round(scores, 9)))[:k]
                chunks, scores = chunks[order], scores[order]
                least = max(least, float(scores.min()))
            at = until
        return chunks, scores


def search(index: DataFrame, counts: DataFrame, queries: DataFrame, limit: int | None, k1: float = K.BM25_K1, b: float = K.BM25_B, many: int = MANY) -> DataFrame:
    """query_id, chunk_id, score; of every task at least what belongs to a query's `limit` best (None: all hits above 0).

    index: blocks; queries: query_id, tokens. Repeated query tokens count repeatedly. A query's distinct tokens stay together."""
    spark = index.sparkSession
    entries = queries.where("query_id is not null").select("query_id", F.explode("tokens").alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))
    total = counts.first()
    parts = max(1, -(-entries.count() // many))
    every = None
    for n in range(parts):
        own = entries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == n)
        found = _search_part(spark, index, total["segments"], total["length"], own, limit, k1, b)
        every = found if every is None else every.unionByName(found)
    return every


def _search_part(spark: SparkSession, index: DataFrame, n: int, length: int, entries: DataFrame, limit: int | None, k1: float, b: float) -> DataFrame:
    asked = entries.toArrow()  # about MANY rows
    tokens = pc.unique(asked.column("token").combine_chunks()) if len(asked) else pa.array([], pa.string())
    wanted = spark.createDataFrame(pa.table({"token": pa.concat_arrays([pa.array([""]), tokens.cast(pa.string())])}))
    needed = index.join(F.broadcast(wanted), "token", "left_semi")
    df = {r["token"]: r["df"] for r in needed.where("token != ''").groupBy("token").agg(F.sum(F.size("places")).alias("df")).collect()}  # as many as tokens
    weight = {t: float(np.log(1 + (n - d + 0.5) / (d + 0.5))) for t, d in df.items()}
    ids = pc.unique(asked.column("query_id").combine_chunks()) if len(asked) else asked.column("query_id").combine_chunks()
    of: list[list[tuple[str, float]]] = [[] for _ in range(len(ids))]
    for q, t, times in zip(pc.index_in(asked.column("query_id"), ids).to_pylist(), asked.column("token").to_pylist(), asked.column("times").to_pylist()):
        if t in weight:
            of[q].append((t, weight[t] * times))
    sent = spark.sparkContext.broadcast((ids, of))
    average = length / max(n, 1)
    kind = index.schema["chunk_ids"].dataType.elementType
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, of = sent.value
        least = np.zeros(len(of))
        tops: list[np.ndarray] = [np.zeros(0)] * len(of)

        def close(shard: _Shard, chunks: pa.Array) -> pa.RecordBatch | None:
            who, which, scores = [], [], []
            for q, weights in enumerate(of):
                found, score = shard.search(weights, least[q], limit)
                if len(found):
                    who.append(np.full(len(found), q))
                    which.append(found)
                    scores.append(score)
                    if limit is not None:
                        tops[q] = -np.sort(-np.concatenate([tops[q], score]))[:limit]
                        least[q] = tops[q][-1] if len(tops[q]) == limit else 0.0
            if not who:
                return None
            return pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(who))), chunks.take(pa.array(np.concatenate(which))), pa.array(np.concatenate(scores))], names=["query_id", "chunk_id", "score"])

        now, shard, chunks = None, None, None
        for batch in batches:
            shards, tokens = batch.column("shard").to_pylist(), batch.column("token").to_pylist()
            places, counts = batch.column("places"), batch.column("counts")
            for row, (at, token) in enumerate(zip(shards, tokens)):
                a, c = places[row].values.to_numpy().astype(np.int64), counts[row].values.to_numpy().astype(float)
                if at != now:
                    out = close(shard, chunks) if shard is not None else None
                    if out is not None:
                        yield out
                    now, shard, chunks = at, _Shard((a, c), average, k1, b), batch.column("chunk_ids")[row].values.cast(arrow)
                else:
                    shard.add(token, a, c)
        out = close(shard, chunks) if shard is not None else None
        if out is not None:
            yield out

    dealt = needed.select("shard", "token", "places", "counts", "chunk_ids").repartition("shard").sortWithinPartitions("shard", "token")
    return dealt.mapInArrow(run, f"query_id {entries.schema['query_id'].dataType.simpleString()}, chunk_id {kind.simpleString()}, score double")
