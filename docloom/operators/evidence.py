"""Evidence selection over ranked hits.

Hits: query_id, query, chunk_id, document_id, chunk_index, text, heading, score, rank; query,
text and heading normalised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import constants as K
from docloom.functions import text as T

from .ranking import distracted, signals

STOP = K.EVIDENCE_STOPWORDS


def phrase_score(query: Column, targets: Column) -> Column:
    """1 if a phrase stands in a target, else half the share of pairs that do."""
    found = F.exists(F.filter(T.phrases(query), lambda p: F.length(p) >= 4), lambda p: F.exists(targets, lambda t: F.contains(t, p)))
    pairs = T.bigrams(T.all_tokens(query))
    blob = F.array_join(targets, " ")
    share = F.size(F.filter(pairs, lambda g: F.contains(blob, g))) / F.greatest(F.size(pairs), F.lit(1))
    return F.when(found, 1.0).otherwise(0.5 * share)


def numeric_agreement(query: Column, text: Column) -> Column:
    """Share of the query's numbers that the text has."""
    return agreement(T.short_numbers(query), T.short_numbers(text))


def agreement(a: Column, b: Column) -> Column:
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)


def combined(names: dict[str, Column], penalty: Column) -> Column:
    """V02."""
    total = F.lit(0.0)
    for name, weight in K.EVIDENCE_WEIGHTS.items():
        total = total + weight * names[name]
    return F.greatest(F.lit(0.0), total - penalty)


def evidence_signals(hits: DataFrame) -> DataFrame:
    """The ten signals, the penalty and the selection score."""
    rows = signals(hits, STOP)
    line = F.coalesce("faq.line", F.lit(""))
    every = F.concat(T.all_tokens("heading"), F.col("t_all"))
    # token sets become columns once; what is compared below are columns
    rows = rows.withColumns({"kq": T.persian_of(F.col("q")), "kt": T.persian_of(F.array_union("h", "t")), "eq": T.entities_of(F.col("q_all")), "et": T.entities_of(every), "nq": T.short_numbers("query"), "nt": T.short_numbers("text")})
    query = W.partitionBy("query_id")
    top = F.max("score").over(query)
    penalty = F.when(distracted(K.EVIDENCE_DISTRACTORS, F.col("q"), F.col("t"), T.content_tokens(line, STOP)), K.EVIDENCE_PENALTY).otherwise(0.0)
    rows = rows.withColumns({
        "lexical_overlap": T.jaccard(F.col("q"), F.col("t")),
        "persian_keyword_overlap": T.jaccard(F.col("kq"), F.col("kt")),
        "heading_similarity": T.jaccard(F.col("q"), F.col("h")),
        "faq_question_similarity": F.col("faq.overlap"),
        "exact_phrase": phrase_score(F.col("query"), F.array(line, F.col("heading"), F.col("text"))),
        "numeric_agreement": agreement(F.col("nq"), F.col("nt")),
        "named_entities": T.jaccard(F.col("eq"), F.col("et")),
        "rc32_ranking_score": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") / F.when(top == 0, 1.0).otherwise(top))),
        "hybrid_rank_score": 1.0 / F.col("rank"),
        "penalty": penalty,
    }).drop("q", "q_all", "t", "t_all", "h", "faq", "phrases", "kq", "kt", "eq", "et", "nq", "nt")
    names = {n: F.col(n) for n in K.EVIDENCE_WEIGHTS if n != "section_proximity"}
    rows = rows.withColumn("provisional", combined(names | {"section_proximity": F.lit(0.0)}, F.col("penalty")))
    best = W.partitionBy("query_id").orderBy(F.desc(F.round("provisional", 12)), "rank")
    rows = rows.withColumn("anchor", F.first(F.struct("chunk_id", "document_id", "chunk_index")).over(best))
    away = F.abs(F.col("chunk_index") - F.col("anchor.chunk_index"))
    near = (F.when(F.col("chunk_id") == F.col("anchor.chunk_id"), 1.0).when(F.col("document_id") != F.col("anchor.document_id"), 0.0)
            .when(away == 0, 0.9).when(away == 1, 0.7).when(away == 2, 0.4).when(away <= 4, 0.2).otherwise(0.0))
    rows = rows.withColumn("section_proximity", near)
    return rows.withColumn("selection_score", combined(names | {"section_proximity": F.col("section_proximity")}, F.col("penalty"))).drop("provisional", "anchor")


def classified(rows: DataFrame) -> DataFrame:
    """Label and reason before the caps."""
    c = F.col
    score = F.round("selection_score", 12)
    direct = ((c("faq_question_similarity") >= 0.45) | (c("exact_phrase") >= 0.75) | ((c("numeric_agreement") >= 1.0) & (c("lexical_overlap") >= 0.15)) | ((c("heading_similarity") >= 0.5) & (c("lexical_overlap") >= 0.2)))
    primary = (score >= K.PRIMARY_AT) | (direct & (score >= K.SUPPLEMENTARY_AT))
    label = F.when(primary, "PRIMARY").when(score >= K.SUPPLEMENTARY_AT, "SUPPLEMENTARY").otherwise("IRRELEVANT")
    mark = F.when(c("penalty") > 0, "distractor_penalty=distractor")
    why = lambda default, *rules: F.array_join(_or(F.array_compact(F.array(mark, *(F.when(a, b) for a, b in rules))), default), "+")
    reason = (F.when(label == "PRIMARY", why("high_evidence_score", (c("faq_question_similarity") >= 0.45, "faq_match"), (c("exact_phrase") >= 0.75, "exact_phrase"), (c("numeric_agreement") >= 1.0, "numeric_agreement"), (c("heading_similarity") >= 0.5, "heading_match")))
              .when(label == "SUPPLEMENTARY", why("moderate_evidence_score", (c("section_proximity") > 0, "section_neighbor"), (c("lexical_overlap") >= 0.2, "lexical_support"), (c("persian_keyword_overlap") >= 0.25, "persian_keywords")))
              .otherwise(F.array_join(F.array_compact(F.array(mark, F.lit("below_threshold"))), "+")))
    return rows.withColumns({"label": label, "reason": reason})


def _or(values: Column, default: str) -> Column:
    return F.when(F.size(values) > 0, values).otherwise(F.array(F.lit(default)))


def select(hits: DataFrame, max_primary: int = K.MAX_PRIMARY, max_supplementary: int = K.MAX_SUPPLEMENTARY) -> DataFrame:
    """Caps, promotion of the best when nothing is primary, and what fell behind the caps."""
    rows = classified(evidence_signals(hits))
    query = W.partitionBy("query_id")
    order = (F.desc(F.round("selection_score", 12)), F.asc("rank"))
    rows = rows.withColumn("_best", F.row_number().over(query.orderBy(*order)))
    promote = (F.max(F.when(F.col("label") == "PRIMARY", 1).otherwise(0)).over(query) == 0) & (F.col("_best") == 1) & (F.round("selection_score", 12) >= K.FLOOR)
    rows = rows.withColumn("_promote", promote)
    rows = rows.withColumns({"label": F.when(F.col("_promote"), "PRIMARY").otherwise(F.col("label")), "reason": F.when(F.col("_promote"), "promoted_best_available").otherwise(F.col("reason"))})
    rows = rows.withColumn("_place", F.row_number().over(W.partitionBy("query_id", "label").orderBy(*order)))
    kept = ((F.col("label") == "PRIMARY") & (F.col("_place") <= max(1, max_primary))) | ((F.col("label") == "SUPPLEMENTARY") & (F.col("_place") <= max(0, max_supplementary)))
    fallen = ~kept & (F.col("label") != "IRRELEVANT")
    return rows.withColumns({"reason": F.when(fallen, F.concat(F.lit("truncated_after_cap:"), "reason")).otherwise(F.col("reason")), "label": F.when(fallen, "IRRELEVANT").otherwise(F.col("label"))}).drop("_best", "_promote", "_place")


def conflicts(selected: DataFrame) -> DataFrame:
    """query_id, conflict, conflict_reason among the primaries (three at most)."""
    lines = T.text_lines("text")
    answer = F.when(F.size(T.question_lines("text")) > 0, F.try_element_at(F.filter(lines, lambda x: ~T.ends_in_question(x) & (F.length(x) >= 8)), F.lit(1)))
    raw = F.col("raw_text") if "raw_text" in selected.columns else F.col("text")
    entry = F.struct((-F.round("selection_score", 12)).alias("s"), "rank", T.short_numbers(raw).alias("numbers"), answer.alias("answer"))
    primary = selected.where("label = 'PRIMARY'").groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("p"), F.first("query").alias("query"))
    numbers = F.filter(F.transform("p", lambda x: F.array_sort(x["numbers"])), lambda n: F.size(n) > 0)
    shared = F.aggregate(numbers, F.try_element_at(numbers, F.lit(1)), lambda a, b: F.array_intersect(a, b))
    asked = T.short_numbers("query")
    numeric = (F.size("p") >= 2) & (F.size(asked) > 0) & (F.size(numbers) >= 2) & ~F.arrays_overlap(asked, shared) & (F.size(F.array_distinct(numbers)) > 1)
    answers = F.filter(F.transform("p", lambda x: x["answer"]), lambda a: a.isNotNull())
    side = lambda k: T.content_tokens(F.coalesce(F.try_element_at(answers, F.lit(k)), F.lit("")), STOP)
    spans = (F.size("p") >= 2) & (F.size(answers) >= 2) & (F.size(side(1)) > 0) & (F.size(side(2)) > 0) & ~F.arrays_overlap(side(1), side(2))
    why = F.when(F.coalesce(numeric, F.lit(False)), "numeric_disagreement_among_primary").when(spans, "primary_answer_spans_disagree")
    return primary.select("query_id", why.isNotNull().alias("conflict"), why.alias("conflict_reason"))


def diagnostics(selected: DataFrame) -> DataFrame:
    """Ids of each label and character counts per query."""
    ids = lambda label: F.transform(F.array_sort(F.collect_list(F.when(F.col("label") == label, F.struct((-F.round("selection_score", 12)).alias("s"), "rank", "chunk_id")))), lambda x: x["chunk_id"])
    size = F.length("text")
    out = selected.groupBy("query_id").agg(ids("PRIMARY").alias("primary_ids"), ids("SUPPLEMENTARY").alias("support_ids"), ids("IRRELEVANT").alias("discarded_ids"), F.sum(F.when(F.col("label") != "IRRELEVANT", size).otherwise(0)).alias("prompt_chars"), F.sum(size).alias("original_chars"))
    return out.withColumn("reduction", F.when(F.col("original_chars") > 0, 1 - F.col("prompt_chars") / F.col("original_chars")))


def pass_through(hits: DataFrame) -> DataFrame:
    """Every hit as primary evidence."""
    return hits.withColumns({"label": F.lit("PRIMARY"), "reason": F.lit("passthrough"), "selection_score": F.col("score")})
