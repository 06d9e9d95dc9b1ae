"""Joins with the live corpus, dense and lexical retrieval, fusion, over tables of queries.

Chunks: chunk_id, document_id, chunk_index, text, heading (nullable). Queries: query_id, query,
and, for dense search, vector. Hits: query_id, chunk_id, rank, score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docloom.functions import constants as K
from docloom.functions import text as T
from docloom.operators import lexical
from docloom.sources.shared import settle

#: Query tokens, and query vectors, that are sent to the tasks at once; more take a shuffle, or further passes.
MANY, QUERY_BLOCK = 50_000, 4096


def ranked(hits: DataFrame, *order: Column, by: str = "query_id", rank: str = "rank", limit: int | None = None) -> DataFrame:
    out = hits.withColumn(rank, F.row_number().over(W.partitionBy(by).orderBy(*order)))
    return out.where(F.col(rank) <= limit) if limit else out


# Corpus joins

def scope(rows: DataFrame, **tenant: str) -> DataFrame:
    """Rows of a tenant; conditions reach the scan."""
    for name, value in tenant.items():
        rows = rows.where(F.col(name) == value)
    return rows


def live_corpus(embeddings: DataFrame, chunks: DataFrame, documents: DataFrame, versions: DataFrame, document_ids: DataFrame | None = None, language: str | None = None) -> DataFrame:
    """Embeddings with their chunk, document and version, all of them live."""
    live = documents.where("status = 'active' and deleted_at is null").select("document_id", "title")
    current = versions.where("processing_status = 'indexed'").select("document_version_id")
    kept = chunks.where("status = 'indexed'")
    kept = kept.where(F.col("language") == language) if language else kept
    out = embeddings.where("index_status = 'indexed'").join(kept, "chunk_id").join(live, "document_id").join(current, "document_version_id")
    return out.join(document_ids.select("document_id"), "document_id", "left_semi") if document_ids is not None else out


def lexical_corpus(live: DataFrame) -> DataFrame:
    """What lexical search reads. Readers that need the order of documents and chunks sort by document_id, chunk_index."""
    return live.select("document_id", "chunk_id", "chunk_index", "heading", "language", "text")


def chunk_snapshot(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with the title of their document, without deleted ones."""
    return chunks.join(documents.where("deleted_at is null").select("document_id", "title"), "document_id")


def gate(queries: DataFrame, bases: DataFrame, model: str) -> DataFrame:
    """query_id, error_code (null: may be searched), empty (allowed, but may read no documents)."""
    joined = queries.join(bases.select("knowledge_base_id", F.col("status").alias("kb_status")), "knowledge_base_id", "left")
    may = lambda p: F.array_contains("permissions", p)
    code = (F.when(F.coalesce(F.trim("query"), F.lit("")) == "", "blank_query").when(~F.coalesce(may("knowledge_base:read"), F.lit(False)), "forbidden")
            .when(F.col("kb_status").isNull(), "knowledge_base_not_found").when(F.col("kb_status") != "active", "knowledge_base_inactive")
            .when(F.coalesce(F.col("model"), F.lit(model)) != model, "model_mismatch"))
    return joined.select("query_id", code.alias("error_code"), (code.isNull() & ~F.coalesce(may("document:read"), F.lit(False))).alias("empty"))


# Dense retrieval

def cosine(a: Column, b: Column) -> Column:
    """Clipped to 0..1; 0 for zero norms or different lengths."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), F.least(F.greatest(dot(a, b) / norm, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def _matrix(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors filled up with zeros, their norms (0 where there is none to use), their lengths."""
    sizes = np.array(pc.fill_null(pc.list_value_length(lists), -1))
    x = np.zeros((len(sizes), max(1, sizes.max(initial=0))))
    for n, v in enumerate(lists):
        if sizes[n] > 0 and not v.values.null_count:
            x[n, : sizes[n]] = v.values.to_numpy(zero_copy_only=False)
    with np.errstate(all="ignore"):
        norms = np.sqrt(_in_order(x, x))
    return x, np.where(np.isfinite(norms), norms, 0.0), sizes


def dense_top_k(queries: DataFrame, corpus: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """Exact. A block of at most `block` queries is sent to the tasks, each of which scans its part of the corpus once
    by matrix products and gives k hits of a query for a batch; further queries take further scans.

    Products choose the hits (with a margin for rounding); their scores are then summed in the order of cosine()."""
    left = queries.where("query_id is not null").select("query_id", "vector")
    blocks = max(1, -(-left.count() // block))
    kinds = {c: corpus.schema[c].dataType.simpleString() for c in ("chunk_id", "document_id", "chunk_index")}
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, {', '.join(f'{c} {t}' for c, t in kinds.items())}, score double"
    every = None
    for n in range(blocks):
        part = left.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n).toArrow()  # about `block` rows
        sent = queries.sparkSession.sparkContext.broadcast((part.column("query_id").combine_chunks(), *_matrix(part.column("vector").combine_chunks())))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q, qn, qs = sent.value
            for batch in batches:
                x, xn, xs = _matrix(batch.column("vector"))
                width = max(q.shape[1], x.shape[1])
                mine, asked = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, q))
                for at in range(0, len(ids), 256):
                    fits = (qs[at : at + 256, None] == xs[None, :]) & (qn[at : at + 256, None] > 0) & (xn[None, :] > 0)
                    with np.errstate(all="ignore"):
                        about = np.where(fits, np.clip(asked[at : at + 256] @ mine.T / (qn[at : at + 256, None] * xn[None, :]), 0, 1), 0.0)
                    least = np.partition(about, -k, axis=1)[:, -k] if about.shape[1] > k else np.full(len(about), -1.0)
                    rows, cols = np.nonzero(about >= least[:, None] - 1e-9)
                    with np.errstate(all="ignore"):
                        exact = _in_order(asked[at + rows], mine[cols]) / (qn[at + rows] * xn[cols])
                    score = np.where(fits[rows, cols], np.clip(np.nan_to_num(exact), 0, 1), 0.0)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at + rows)), *(batch.column(c).take(pa.array(cols)) for c in kinds), pa.array(score)], names=["query_id", *kinds, "score"])

        found = corpus.select(*kinds, "vector").mapInArrow(run, schema)
        every = found if every is None else every.unionByName(found)
    return ranked(every, F.desc("score"), F.asc("document_id"), F.asc("chunk_index"), limit=k)


#: Vectors in a block of every_pair, about, and those of it that are multiplied at a time.
PAIR_BLOCK, PAIR_ROWS = 8192, 512


def every_pair(vectors: DataFrame, k: int = 10, block: int = PAIR_BLOCK) -> DataFrame:
    """D04 for tables with fewer than k pairs above 0 (see vectors.nearest_pairs): all pairs, by products of blocks with the k best of a task.

    Products choose the pairs; the scores are then summed in the order of cosine()."""
    rows = vectors.where("chunk_id is not null").select("chunk_id", "vector")
    blocks = max(1, -(-rows.count() // block))
    of = rows.withColumn("block", F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)).cast("int")).groupBy("block").agg(F.collect_list(F.struct("chunk_id", "vector")).alias("rows"))
    left = of.select(F.col("block").alias("i"), F.explode(F.sequence("block", F.lit(blocks - 1))).alias("j"), F.col("rows").alias("a"))
    right = of.select(F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"), F.col("rows").alias("b"))
    kind = rows.schema["chunk_id"].dataType.simpleString()

    def side(rows: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, vectors filled up with zeros, norms (0 where there is none), lengths."""
        ids, lists = rows.values.field("chunk_id").to_numpy(zero_copy_only=False), rows.values.field("vector")
        sizes = np.array(pc.fill_null(pc.list_value_length(lists), -1))
        x = np.zeros((len(ids), max(1, sizes.max(initial=0))))
        for n, v in enumerate(lists):
            if sizes[n] > 0:
                x[n, : sizes[n]] = [np.nan if y is None else y for y in v.as_py()] if v.values.null_count else v.values.to_numpy()
        lacks = np.array([bool(v.is_valid and v.values.null_count) for v in lists], bool)
        x[lacks] = 0.0
        return ids, x, np.sqrt(_in_order(x, x)), sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple] = []  # (-score, left, right), k at most
        for batch in batches:
            for i, j, p, q in zip(*(batch.column(n) for n in ("i", "j", "a", "b"))):
                (all_ids, all_x, all_xn, all_xs), (jds, y, yn, ys) = side(p), side(q)
                width = max(all_x.shape[1], y.shape[1])
                all_x, y = (np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in (all_x, y))
                for first in range(0, len(all_ids), PAIR_ROWS):
                    ids, x, xn, xs = (v[first : first + PAIR_ROWS] for v in (all_ids, all_x, all_xn, all_xs))
                    fits = (xs[:, None] == ys[None, :]) & ~(xn == 0)[:, None] & ~(yn == 0)[None, :]
                    with np.errstate(all="ignore"):
                        about = np.where(fits, np.clip(np.nan_to_num(x @ y.T / (xn[:, None] * yn[None, :]), nan=1.0), 0, 1), 0.0)
                    apart = ids[:, None] < jds[None, :] if i.as_py() == j.as_py() else ids[:, None] != jds[None, :]
                    about = np.where(apart, about, -1.0)
                    least = np.partition(about.ravel(), -k)[-k] if about.size > k else -1.0
                    least = max(least, -best[-1][0] if len(best) == k else -1.0)
                    rows, cols = np.nonzero((about >= least - 1e-9) & apart)
                    for at in range(0, len(rows), 1 << 16):
                        r, c = rows[at : at + (1 << 16)], cols[at : at + (1 << 16)]
                        with np.errstate(all="ignore"):
                            score = np.where(fits[r, c], np.clip(np.nan_to_num(_in_order(x[r], y[c]) / (xn[r] * yn[c]), nan=1.0), 0, 1), 0.0)
                        low, high = np.where(ids[r] < jds[c], ids[r], jds[c]), np.where(ids[r] < jds[c], jds[c], ids[r])
                        take = np.lexsort((high, low, -score))[:k]
                        best = sorted([*best, *zip((-score[take]).tolist(), low[take].tolist(), high[take].tolist())])[:k]
        if best:
            scores, low, high = zip(*best)
            yield pa.RecordBatch.from_pydict({"left_id": low, "right_id": high, "score": [-s for s in scores]}, schema=pa.schema([("left_id", id_type), ("right_id", id_type), ("score", pa.float64())]))

    id_type = to_arrow_type(rows.schema["chunk_id"].dataType)
    found = left.join(right, ["i", "j"]).mapInArrow(run, f"left_id {kind}, right_id {kind}, score double")
    return found.orderBy(F.desc("score"), "left_id", "right_id").limit(k)


def _in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of rows, summed from the first place to the last."""
    out = np.zeros(len(x))
    for n in range(x.shape[1]):
        out += x[:, n] * y[:, n]
    return out


def cosine_backfill(fused: DataFrame, dense: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Cosines of fused hits, computed where the dense list lacks them; 0 without a vector."""
    known = fused.join(dense.select("query_id", "chunk_id", F.col("score").alias("cosine")), ["query_id", "chunk_id"], "left")
    missing = known.where("cosine is null").join(queries.select("query_id", F.col("vector").alias("q")), "query_id", "left").join(corpus.select("chunk_id", F.col("vector").alias("v")), "chunk_id", "left")
    filled = missing.withColumn("cosine", F.coalesce(cosine(F.col("q"), F.col("v")), F.lit(0.0))).drop("q", "v")
    return known.where("cosine is not null").unionByName(filled)


# Lexical retrieval

def faq_segments(text: Column, is_question=T.ends_in_question) -> Column:
    """Question-led segments of normalised text, and the whole text too if there are several.

    A segment is the lines from one question, or the first line, to the next: each line is joined once."""
    def parts(lines: Column) -> Column:
        last = F.size(lines) - 1
        leads = F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | is_question(F.get(lines, i)))
        return T.let(leads, lambda own: F.transform(own, lambda i, n: F.array_join(F.slice(lines, i + 1, F.coalesce(F.get(own, n + 1), last + 1) - i), "\n")))

    found = T.let(T.text_lines(text), lambda lines: F.when(F.size(lines) > 0, parts(lines)).otherwise(F.array().cast("array<string>")))
    return T.let(found, lambda own: F.when(F.size(own) > 1, F.concat(own, F.array(text))).otherwise(own))


def segments(chunks: DataFrame, normal: bool = False, is_question=T.ends_in_question) -> DataFrame:
    """chunk_id, segment, tokens of each segment of a chunk's heading and text. Segments without tokens go."""
    source = F.when(F.coalesce("heading", F.lit("")) != "", F.concat_ws("\n", "heading", "text")).otherwise(F.col("text"))
    whole = source if normal else T.normalize(source)
    rows = chunks.select("chunk_id", whole.alias("text"))
    if is_question is T.ends_in_question:  # lines of a text without question marks are one segment, whose tokens are the text's
        own = F.when(F.col("text").rlike("[؟?]"), faq_segments(F.col("text") if normal else T.strip("text"))).otherwise(F.array("text"))
    else:
        own = faq_segments(F.col("text") if normal else T.strip("text"), is_question)
    rows = rows.select("chunk_id", F.posexplode(own).alias("segment", "text"))
    # A generator of one row or none, not a filter: a filter would be pushed below the tokeniser and run it twice.
    tokens = F.array(T.lexical_tokens("text", normal=True))
    return rows.select("chunk_id", "segment", F.explode(tokens).alias("tokens")).where(F.size("tokens") > 0)


def postings(found: DataFrame) -> DataFrame:
    """chunk_id, segment, length, token, tf."""
    rows = found.select("chunk_id", "segment", F.size("tokens").alias("length"), F.explode("tokens").alias("token"))
    return rows.groupBy("chunk_id", "segment", "length", "token").agg(F.count("*").alias("tf"))


def document_frequency(found: DataFrame) -> DataFrame:
    """Token, df: the segments that hold it, counted where they are read; of the empty token the number of all segments."""
    rows = found.select(F.explode(F.array_append(F.array_distinct("tokens"), F.lit(""))).alias("token"))
    return rows.groupBy("token").agg(F.count("*").alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(found: DataFrame, queries: DataFrame, limit: int | None = K.POOL, k1: float = K.BM25_K1, b: float = K.BM25_B) -> DataFrame:
    """Hits by the best segment of each chunk, by an index of the tokens that the queries hold, made for these segments.

    Texts are tokenised once; above MANY query tokens the index takes all tokens."""
    asked = queries.select(F.explode("tokens").alias("token")).distinct()
    held = settle(lexical.blocks(found, asked if asked.count() <= MANY else None), "blocks")
    return ranked_hits(lexical.search(held, lexical.size(held), queries, limit, k1, b), limit)


def ranked_hits(hits: DataFrame, limit: int | None) -> DataFrame:
    return ranked(hits, F.desc(F.round("score", 9)), F.asc("chunk_id"), limit=limit)


def _contains_any(parts: Column, text: Column) -> Column:
    return F.exists(parts, lambda p: (p != "") & F.contains(text, p))


def near_exact(query: Column, line: Column) -> Column:
    """Equal or contained, spaces, half-spaces and question marks aside."""
    a, b = (F.regexp_replace(T.casefold(x), r"[\s؟?\x{200C}]+", "") for x in (query, line))
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def coverage(tokens: Column, line: Column) -> Column:
    """Share of the query's tokens that a line holds."""
    own = T.lexical_tokens(line, normal=True)
    return F.when(F.size(tokens) > 0, F.size(F.filter(tokens, lambda t: F.array_contains(own, t))) / F.size(tokens)).otherwise(0.0)


def boost(hits: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits re-ranked by their score times the boosts that apply. Queries and chunks hold normalised text."""
    rows = hits.join(queries.select("query_id", "query", "tokens"), "query_id").join(chunks.select("chunk_id", "text", "heading"), "chunk_id")
    lines, phrases = F.filter(T.text_lines("text"), T.ends_in_question), T.fusion_phrases("query")
    numbers = lambda c: T.find_all(c, K.NUMBER)
    content = F.filter("tokens", lambda t: F.length(t) >= 3)
    own = T.lexical_tokens("text", normal=True)
    factor = F.when(F.exists(lines, lambda x: near_exact(F.col("query"), x)), 2.2).when(F.exists(lines, lambda x: coverage(F.col("tokens"), x) >= 0.75), 1.55).otherwise(1.0)
    for condition, by in (
        (_contains_any(phrases, F.col("text")), 1.25),
        (F.coalesce(_contains_any(phrases, F.col("heading")), F.lit(False)), 1.15),
        (F.arrays_overlap(numbers("query"), numbers("text")), 1.30),
        (F.col("query").rlike(K.BROWSER) & F.col("text").rlike(K.BROWSER), 1.25),
        (F.col("query").rlike(K.COURSE_CODE) & F.col("text").rlike(K.COURSE_CODE), 1.20),
        ((F.size(content) == 1) & F.arrays_overlap(content, own), 1.20),
    ):
        factor = factor * F.when(condition, by).otherwise(1.0)
    out = rows.withColumn("score", F.col("score") * factor).select("query_id", "chunk_id", "score")
    return ranked(out, F.desc(F.round("score", 9)), F.asc("chunk_id"))


# Fusion (R01-R03, R08, R09)

def fuse(*lists: DataFrame, k: int = K.RRF_K) -> DataFrame:
    """Reciprocal rank fusion of hit lists; ties by chunk_id."""
    every = lists[0].select("query_id", "chunk_id", "rank")
    for x in lists[1:]:
        every = every.unionByName(x.select("query_id", "chunk_id", "rank"))
    total = every.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"))
    return ranked(total, F.desc(F.round("rrf", 12)), F.asc("chunk_id"))


def fuse_limited(dense: DataFrame, lexical: DataFrame, limit: int = K.FUSED) -> DataFrame:
    """The best of the fused list, with the largest score of the whole list."""
    out = fuse(dense, lexical).withColumn("max_rrf", F.max("rrf").over(W.partitionBy("query_id")))
    return out.where(F.col("rank") <= F.greatest(F.lit(1), F.lit(limit)))


def blend(cos: Column, rrf: Column, max_rrf: Column) -> Column:
    """R03."""
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return F.when(max_rrf <= 0, clip(cos)).otherwise(clip(K.COSINE_WEIGHT * cos + K.RRF_WEIGHT * rrf / max_rrf))


def fusion_diagnostics(dense: DataFrame, lexical: DataFrame) -> DataFrame:
    """Pool sizes and the first ten of each list, scores to 6 places."""
    def top(hits: DataFrame, name: str, score: str) -> DataFrame:
        entry = F.struct("rank", "chunk_id", F.round(score, 6).alias("score"))
        return hits.groupBy("query_id").agg(F.count("*").alias(f"{name}_pool"), F.array_sort(F.collect_list(F.when(F.col("rank") <= 10, entry))).alias(f"{name}_top"))
    return top(dense, "dense", "score").join(top(lexical, "bm25", "score"), "query_id", "full_outer").join(top(fuse(dense, lexical), "rrf", "rrf"), "query_id", "full_outer")


def pool_size(k: Column, most: int = 50) -> Column:
    """R09."""
    return F.greatest(k, F.least(F.lit(most), F.greatest(2 * k, k + 8)))
