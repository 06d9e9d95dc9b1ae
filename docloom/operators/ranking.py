"""Calibration of fused hits by questions, headings and phrases (R04-R07) and hybrid search.

Hits: query_id, query, chunk_id, document_id, chunk_index, text, heading, score; query, text and
heading are normalised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import constants as K
from docloom.functions import text as T
from docloom.sources.shared import settle

from . import retrieval as R


def distracted(pairs: list[tuple[str, str]], query: Column, text: Column, faq: Column) -> Column:
    """The query wants one sense, the chunk has only the misleading one; the first pair that applies counts."""
    hit = F.lit(False)
    for target, wrong in pairs:
        t, w = T.words(target), T.words(wrong)
        hit = hit | (F.arrays_overlap(query, t) & (F.arrays_overlap(text, w) | F.arrays_overlap(faq, w)) & ~F.arrays_overlap(faq, t) & ~F.arrays_overlap(text, t))
    return hit


def best_question(lines: Column, query: Column, stopwords: list[str]) -> Column:
    """(overlap, line) of the question line most like the query, the first of equals; null line if none overlaps."""
    start = F.struct(F.lit(0.0).alias("overlap"), F.lit(None).cast("string").alias("line"))
    each = F.transform(lines, lambda x: F.struct(T.jaccard(T.content_tokens(x, stopwords), query).alias("overlap"), x.alias("line")))
    return F.aggregate(each, start, lambda a, b: F.when(b["overlap"] > a["overlap"], b).otherwise(a))


def _some(*entries: tuple[str, Column]) -> Column:
    """A map of the entries that are not null."""
    return F.map_from_entries(F.array_compact(F.array(*(F.when(v.isNotNull(), F.struct(F.lit(k).alias("k"), v.alias("v"))) for k, v in entries))))


def signals(hits: DataFrame, stopwords: list[str] = K.RANKING_STOPWORDS) -> DataFrame:
    """Adds q, q_all, t, t_all (token sets and lists), faq (best question) and phrases."""
    rows = hits.withColumns({"heading": F.coalesce("heading", F.lit("")), "q_all": T.all_tokens("query"), "t_all": T.all_tokens("text"), "phrases": F.filter(T.phrases("query"), lambda p: F.length(p) >= 4)})
    rows = rows.withColumns({"q": T.content_of(F.col("q_all"), stopwords), "t": T.content_of(F.col("t_all"), stopwords), "h": T.content_tokens("heading", stopwords)})
    return rows.withColumn("faq", best_question(T.question_lines("text"), F.col("q"), stopwords))


def calibrate(hits: DataFrame) -> DataFrame:
    """Bonuses and penalties as maps, and the adjusted score."""
    rows = signals(hits)
    line, overlap = F.coalesce("faq.line", F.lit("")), F.col("faq.overlap")
    heading = T.jaccard(F.col("h"), F.col("q"))
    body = T.jaccard(F.col("t"), F.col("q"))
    phrase = F.exists("phrases", lambda p: F.contains(line, p) | F.contains(F.col("heading"), p) | F.contains(F.col("text"), p))
    pairs = T.bigrams(F.col("q_all"))
    hits_ = F.size(F.filter(pairs, lambda g: F.contains(line, g)))
    positive = lambda w, x: F.when(x > 0, w * x)
    bonuses = _some(
        ("faq_question_overlap", positive(K.W_FAQ, overlap)), ("heading_overlap", positive(K.W_HEADING, heading)), ("exact_phrase", F.when(phrase, K.W_PHRASE)),
        ("bigram_faq", F.when(~phrase & (F.size("q") >= 2) & (hits_ > 0), K.W_PHRASE * 0.5 * hits_ / F.greatest(F.size(pairs), F.lit(1)))), ("body_token_overlap", positive(K.W_BODY, body)))
    generic = (F.size("q") > 0) & ~F.arrays_overlap("t", "q") & (overlap == 0) & F.arrays_overlap("t_all", "q_all")
    penalties = _some(("generic_only_overlap", F.when(generic, K.W_GENERIC)), ("distractor_faq", F.when(distracted(K.RANKING_DISTRACTORS, F.col("q"), F.col("t"), T.content_tokens(line)), K.W_DISTRACTOR)))
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda a, b: a + b)
    rows = rows.withColumns({"bonuses": bonuses, "penalties": penalties})
    adjusted = F.col("score") + F.least(F.lit(K.MAX_BONUS), total("bonuses")) - F.least(F.lit(K.MAX_PENALTY), total("penalties"))
    rows = rows.withColumns({"adjusted": F.greatest(F.lit(0.0), F.least(F.lit(1.0), adjusted)), "best_question": F.col("faq.line")})
    return rows.drop("q", "q_all", "t", "t_all", "h", "faq", "phrases")


def final_order(rows: DataFrame, k: int) -> DataFrame:
    """R06."""
    return R.ranked(rows, F.desc(F.round("adjusted", 12)), F.desc(F.round("score", 12)), F.asc("document_id"), F.asc("chunk_index"), F.asc("chunk_id"), limit=max(1, k))


def _largest(m: Column) -> Column:
    """name:value of the largest entry, the first of equals."""
    start = F.struct(F.lit("").alias("key"), F.lit(-1.0).alias("value"))
    top = F.aggregate(F.map_entries(m), start, lambda a, b: F.when(b["value"] > a["value"], b).otherwise(a))
    return F.concat(top["key"], F.lit(":"), F.format_string("%.3f", top["value"]))


def reasons(rows: DataFrame) -> DataFrame:
    """Why the first of a query won and the others lost."""
    lead = W.partitionBy("query_id").orderBy("rank")
    rows = rows.withColumns({"_a": F.first("adjusted").over(lead), "_b": F.first("bonuses").over(lead)})
    own = F.col("bonuses")
    missing = F.map_keys(F.map_filter("_b", lambda k, v: v > F.coalesce(F.try_element_at(own, k), F.lit(0.0)) + 0.01))
    won = F.array_compact(F.array(
        F.concat(F.lit("highest_adjusted_score; "), F.when(F.size(own) > 0, F.concat(F.lit("top_bonus="), _largest(own))).otherwise("cosine_led")),
        F.when(F.col("best_question").isNotNull(), F.concat(F.lit("best_faq_line="), F.substring("best_question", 1, 80)))))
    lost = F.array_compact(F.array(
        F.concat(F.lit("behind_rank1_by="), F.format_string("%.3f", F.col("_a") - F.col("adjusted"))),
        F.when(F.size(missing) > 0, F.concat(F.lit("weaker_bonuses="), F.array_join(missing, ","))),
        F.when(F.size("penalties") > 0, F.concat(F.lit("penalty="), _largest(F.col("penalties"))))))
    none = F.array().cast("array<string>")
    first = F.col("rank") == 1
    return rows.withColumns({"reasons_won": F.when(first, won).otherwise(none), "reasons_lost": F.when(first, none).otherwise(lost)}).drop("_a", "_b")


def hybrid_search(queries: DataFrame, chunks: DataFrame, k: int = 8, pool: int = K.POOL) -> DataFrame:
    """The whole path over a table of queries (query_id, query, vector) and live chunks (with vector).

    Dense and lexical pools, fusion, missing cosines, blend, calibration, the k best."""
    k = min(50, max(1, k))
    asked = queries.withColumn("query", T.strip(T.normalize("query"))).withColumn("tokens", T.lexical_tokens("query", normal=True))
    normal = lambda rows: rows.withColumns({"text": T.normalize("text"), "heading": T.normalize(F.coalesce("heading", F.lit("")))})
    dense = settle(R.dense_top_k(asked, chunks, pool).select("query_id", "chunk_id", "rank", "score"), "dense")
    found = settle(R.bm25(R.segments(normal(chunks), normal=True), asked, pool), "lexical")
    # What follows reads the chunks of the two pools alone, normalised once.
    pooled = dense.select("chunk_id").unionByName(found.select("chunk_id")).distinct()
    held = settle(normal(chunks.join(pooled, "chunk_id", "left_semi")), "pool")
    lexical = R.boost(found, asked, held)
    fused = R.cosine_backfill(R.fuse_limited(dense, lexical).drop("rank"), dense, asked, held)
    rows = fused.withColumn("score", R.blend(F.col("cosine"), F.col("rrf"), F.col("max_rrf"))).join(asked.select("query_id", "query"), "query_id").join(held.drop("vector"), "chunk_id")
    return final_order(calibrate(rows), k)


def search_warnings(queries: DataFrame, hits: DataFrame, indexed: int) -> DataFrame:
    """query_id, warning of queries without an answer."""
    lone = queries.select("query_id").join(hits.select("query_id").distinct(), "query_id", "left_anti")
    return lone.withColumn("warning", F.lit("no_indexed_content" if indexed == 0 else "no_results"))
