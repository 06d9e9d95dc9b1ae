"""Diagnostics of corpus, vectors, retrieval and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import text as T

from . import metrics as M

c = F.col


def quality_flags(text: Column) -> Column:
    """What is odd about a chunk, in a fixed order."""
    lines = F.filter(F.split(text, r"\R"), lambda x: F.length(T.strip(x)) > 0)
    short = F.size(F.filter(lines, lambda x: F.length(x) < 12))
    return F.array_compact(F.array(
        F.when((F.size(lines) > 0) & (short > 0.45 * F.size(lines)), "fragmented_short_lines"), F.when(F.contains(text, F.lit("  ")), "double_spaces"), F.when(T.looks_like_table(text), "table_like"), F.when(T.looks_like_list(text), "list_like"),
        F.when(F.length(text) < 80, "very_short"), F.when(F.length(text) > 2500, "very_long")))


def chunk_stats(chunks: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Sizes, overlap with the chunk before, flags and, with hits (chunk_id), how often a chunk was retrieved."""
    before = F.lag("end").over(W.partitionBy("doc_id").orderBy("sequence_number"))
    paragraphs = F.greatest(F.size(F.filter(F.split("text", "\n\n"), lambda p: F.length(T.strip(p)) > 0)), F.lit(1))
    out = chunks.withColumns({"chars": F.length("text"), "tokens": T.token_estimate("text"), "sentences": F.size(T.sentences("text")), "paragraphs": paragraphs, "overlap_previous": F.greatest(F.coalesce(before - c("start"), F.lit(0)), F.lit(0)), "flags": quality_flags(c("text"))})
    if hits is None:
        return out
    return out.join(hits.groupBy("chunk_id").agg(F.count("*").alias("retrieved")), "chunk_id", "left").withColumn("retrieved", F.coalesce("retrieved", F.lit(0)))


#: G02, fixed values: edges of the histograms.
SIZE_EDGES, OVERLAP_EDGES, SENTENCE_EDGES = [0, 200, 400, 600, 800, 1000, 1200, 1500, 10_000], [0, 1, 50, 100, 125, 150, 200, 10_000], [0, 1, 2, 3, 5, 8, 13, 100]


def corpus_summary(stats: DataFrame) -> DataFrame:
    """One row of counts and means over the chunks (of `chunk_stats` with hits), 0 where there are none."""
    mean = lambda name, out: F.coalesce(F.avg(name), F.lit(0.0)).alias(out)
    per = stats.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("documents"), mean("n", "avg_chunks_per_document"))
    own = stats.agg(F.count("*").alias("chunks"), mean("chars", "avg_chunk_chars"), mean("tokens", "avg_estimated_tokens"), mean("sentences", "avg_sentence_count"), mean("paragraphs", "avg_paragraph_count"), mean("overlap_previous", "avg_overlap_size"), F.count_if(c("retrieved") == 0).alias("never_retrieved"))
    return own.join(per)


def frequently_retrieved(hits: DataFrame, limit: int = 10) -> DataFrame:
    """The chunks that come most often (a report); ties by id."""
    return hits.groupBy("chunk_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "chunk_id").limit(limit)


def histogram(values: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """Counts between fixed edges; what lies beyond falls in the last bucket."""
    bucket = F.lit(len(edges) - 2)
    for i in range(len(edges) - 3, -1, -1):
        bucket = F.when(c(column) < edges[i + 1], i).otherwise(bucket)
    return values.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def equal_width(values: DataFrame, column: str, buckets: int = 10) -> DataFrame:
    """Equal buckets between the extremes; the largest value falls in the last."""
    ends = values.agg(F.min(column).cast("double").alias("low"), F.max(column).cast("double").alias("high"))
    at = F.when(c("high") > c("low"), F.least(F.floor((c(column) - c("low")) / (c("high") - c("low")) * buckets), F.lit(buckets - 1))).otherwise(0)
    return values.join(F.broadcast(ends)).groupBy(at.cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def binned(values: DataFrame, column: str, width: float = 0.05) -> DataFrame:
    """Counts of bins of one width."""
    return values.groupBy(F.floor(c(column) / width).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def vector_stats(vectors: DataFrame) -> DataFrame:
    """Norms, outliers and the share of vectors that equal another at 6 decimals."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    rows = vectors.select(norm.alias("norm"), F.xxhash64(F.transform("vector", lambda x: F.round(x.cast("double"), 6))).alias("h"))
    all_ = rows.agg(F.count("*").alias("n"), F.avg("norm").alias("mean"), F.stddev_pop("norm").alias("stdev"), F.min("norm").alias("least"), F.max("norm").alias("most"), F.count_distinct("h").alias("distinct"))
    out = rows.join(F.broadcast(all_.select("mean", "stdev"))).agg(F.count_if((c("norm") > c("mean") + 3 * c("stdev")) | (c("norm") < 0.1)).alias("outliers"))
    return all_.join(out).select("n", "mean", "stdev", "least", "most", "outliers", F.try_divide(c("n") - c("distinct"), c("n")).alias("duplicate_rate"))


def instability(hits: DataFrame) -> DataFrame:
    """parent_id, variants, tops (different first chunks). Hits carry parent_id and rank."""
    return hits.where("rank = 1").groupBy("parent_id").agg(F.count("*").alias("variants"), F.count_distinct("chunk_id").alias("tops"))


def rate_by(rows: DataFrame, key: str, flag: str = "hit") -> DataFrame:
    """Share of hits of each kind."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.avg(c(flag).cast("double")).alias("rate"))


def by_cohort(rows: DataFrame, k: int) -> DataFrame:
    """Ranked metrics and successes of each cohort. Rows are outcomes with cohort."""
    each = M.ranked_metrics(rows, k).join(rows.select("question_id", "cohort"), "question_id")
    return each.groupBy("cohort").agg(F.count("*").alias("n"), F.avg("hit_at_k").alias("hit_at_k"), F.avg("recall_at_k").alias("recall_at_k"), F.avg("precision_at_k").alias("precision_at_k"), F.avg("mrr").alias("mrr"), F.count_if(c("hit_at_k") > 0).alias("successes"))


def score_stats(rows: DataFrame, column: str, *by: str) -> DataFrame:
    """Least, mean, most and median score."""
    return rows.groupBy(*by).agg(F.min(column).alias("least"), F.avg(column).alias("mean"), F.max(column).alias("most"), F.median(column).alias("median"))


def rank_histogram(ranks: DataFrame) -> DataFrame:
    """How many golds came at each rank; 0 where none came."""
    return ranks.groupBy(F.coalesce("gold_rank", F.lit(0)).alias("rank")).agg(F.count("*").alias("n"))


def false_abstains(rows: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(cases, one row with their count, rate over all rows and how many the threshold explains).

    A case is a measured question whose expected chunk came (hit) and that was abstained all the same. Rows: question_id,
    measured, expected_id, hit, abstained, top_score (null without hits)."""
    top = F.coalesce("top_score", F.lit(0.0))
    is_case = F.coalesce(c("measured") & (F.coalesce("expected_id", F.lit("")) != "") & c("hit") & c("abstained"), F.lit(False))
    cases = rows.where(is_case).select("question_id", top.alias("max_score"), F.lit(least).alias("min_evidence_score"), (top < least).alias("threshold_triggered"))
    return cases, rows.agg(F.count_if(is_case).alias("n"), F.coalesce(F.try_divide(F.count_if(is_case), F.count("*")), F.lit(0.0)).alias("rate"), F.count_if(is_case & (top < least)).alias("triggered"))


#: G10, fixed values: thresholds of the sweep, and the order in which a safe one is preferred.
THRESHOLDS = [0.00, 0.05, 0.10, 0.15, 0.20, 0.25, 0.30]
PREFERRED = [0.25, 0.20, 0.15, 0.30, 0.10, 0.05, 0.00]


def sweep_thresholds(rows: DataFrame, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """What each least evidence score would do, one of them recommended.

    Rows: retrieved_ids, top_score, expected_id (null: none), hit, gold_answer, risk. Hits do not change with the
    threshold; a false abstention is a hit with a gold answer that would be abstained; risks count among the answers.
    Recommended is the first preferred threshold without false abstentions, or of all if every one has some."""
    t = rows.sparkSession.createDataFrame([(x, PREFERRED.index(x) if x in PREFERRED else len(PREFERRED)) for x in thresholds], "min_evidence_score double, _order int")
    top, ids = F.coalesce("top_score", F.lit(0.0)), F.coalesce("retrieved_ids", F.array().cast("array<string>"))
    expected = F.coalesce("expected_id", F.lit("")) != ""
    place = F.array_position(ids, c("expected_id"))
    held = rows.select(top.alias("top"), (F.size(ids) == 0).alias("none"), expected.alias("expected"), F.when(expected, (place > 0).cast("double")).alias("hit"), F.when(expected, F.when(place > 0, 1.0 / place).otherwise(0.0)).alias("rr"),
                       (expected & F.coalesce("hit", F.lit(False)) & (F.coalesce("gold_answer", F.lit("")) != "")).alias("answerable"), F.coalesce("risk", F.lit(False)).alias("risk"))
    silent = (c("top") < c("min_evidence_score")) | c("none")
    out = held.join(F.broadcast(t)).groupBy("min_evidence_score", "_order").agg(
        F.avg("hit").alias("hit_at_k"), F.avg("rr").alias("mrr"), F.count_if(silent & c("answerable")).alias("false_abstain_count"), (F.count_if(silent & c("answerable")) / F.count("*")).alias("false_abstain_rate"),
        F.count_if(~silent & c("risk")).alias("hallucination_count"), F.coalesce(F.try_divide(F.count_if(~silent & c("risk")), F.count_if(~silent)), F.lit(0.0)).alias("hallucination_rate"), F.count_if(~silent).alias("answer_count"))
    rank = F.struct((c("false_abstain_count") > 0).cast("int"), c("_order"), c("false_abstain_rate"), c("hallucination_rate"), -c("min_evidence_score"))
    best = out.agg(F.min_by("min_evidence_score", rank).alias("best"))
    return out.join(F.broadcast(best)).withColumn("recommended", c("min_evidence_score") == c("best")).drop("best", "_order")


#: G11, fixed values.
TOP_KS = [1, 3, 5, 8, 10, 12]


def sweep_k(rows: DataFrame, ks: list[int] = TOP_KS) -> DataFrame:
    """Hits and mean reciprocal rank of the lists cut at each k, over rows that expect something; the smallest k of the best hit rate is recommended."""
    table = rows.sparkSession.createDataFrame([(k,) for k in ks], "k int")
    places = F.filter(F.transform("expected_ids", lambda x: F.array_position("retrieved_ids", x)), lambda p: p > 0)
    first = rows.where(F.size("expected_ids") > 0).select(F.array_min(places).alias("first"))
    hit = F.coalesce(c("first") <= c("k"), F.lit(False))
    out = first.join(F.broadcast(table)).groupBy("k").agg(F.count("*").alias("n"), F.avg(hit.cast("double")).alias("hit_rate"), F.avg(F.when(hit, 1.0 / c("first")).otherwise(0.0)).alias("mrr"))
    best = out.agg(F.min_by("k", F.struct(-c("hit_rate"), c("k"))).alias("best"))
    return out.join(F.broadcast(best)).withColumn("recommended", c("k") == c("best")).drop("best")


def miss_labels(misses: DataFrame) -> DataFrame:
    """question_id, labels (sorted): how the wording of a missed question departs. Misses: question_id, query, kind (of variant, or null), top_text, gold_text (null where not retrieved)."""
    kind = lambda *names: F.coalesce(c("kind").isin(*names), F.lit(False))
    q, top, gold = T.all_tokens("query"), F.array_distinct(T.all_tokens("top_text")), T.all_tokens("gold_text")
    own = F.array_distinct(q)
    apart = (F.size(own) > 0) & (F.size(top) > 0) & (F.size(F.array_intersect(own, top)) < F.greatest(F.lit(1), F.floor(F.size(own) / 4)))
    turned = (F.size(gold) > 0) & (F.size(own) > 0) & (F.sort_array(own) == F.sort_array(F.array_distinct(gold))) & (q != gold)
    labels = F.array_compact(F.array(
        F.when(kind("synonym", "paraphrase", "formal", "informal"), "synonyms_or_paraphrase"), F.when(kind("spelling"), "morphology_or_spelling"),
        F.when(F.contains("query", F.lit("اختصار")) | F.contains(F.lower("query"), F.lit("acronym")), "acronyms"),
        F.when(kind("paraphrase", "formal", "informal") | F.coalesce(apart, F.lit(False)), "different_wording"), F.when(F.coalesce(turned, F.lit(False)), "word_order"),
        F.when(kind("halfspace", "arabic_yeh_kaf", "digit_latin", "digit_persian", "digit_arabic_indic"), "surface_normalization")))
    return misses.select("question_id", F.when(F.size(labels) > 0, F.sort_array(labels)).otherwise(F.array(F.lit("unspecified_semantic_gap"))).alias("labels"))


def miss_gaps(misses: DataFrame) -> DataFrame:
    """Label, n, percent of the misses."""
    labels = miss_labels(misses)
    total = misses.agg(F.count("*").alias("total"))
    return labels.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n")).join(F.broadcast(total)).select("label", "n", (100.0 * c("n") / c("total")).alias("percent"))


def root_causes(rows: DataFrame) -> DataFrame:
    """question_id, causes (up to five structs of cause and confidence, the surest first), passed.

    Rows: question_id, probe (made from the corpus), measured, expected_id, cohort, hit, correct_document, correct_chunk,
    retrieved (number), mean_score, issues (number), answered, cited (the expected chunk), risk, abstained, has_gold_answer."""
    robust = c("cohort") == "robustness"
    miss = c("measured") & (F.coalesce("hit", F.lit(0.0)) < 1)
    low = F.coalesce(c("mean_score") < 0.15, F.lit(False))
    wrong_chunk, wrong_document = c("correct_document") & ~c("correct_chunk"), ~c("correct_document") & (c("retrieved") > 0)
    cause = F.when(low, "LIKELY_LOW_RETRIEVAL_SCORE").when(wrong_chunk, "LIKELY_WRONG_CHUNK_OR_CHUNKING").when(wrong_document, "LIKELY_WRONG_DOCUMENT_OR_EMBEDDING").otherwise("RETRIEVAL_MISS")
    sure = F.when(wrong_chunk, 0.65).when(wrong_document, 0.6).otherwise(0.55)
    sure = F.round(F.least(F.when(low, F.greatest(sure, F.lit(0.7))).otherwise(sure) + F.when(robust, 0.1).otherwise(0.0), F.lit(1.0)), 6)
    judged = c("answered") & c("measured")
    hit = F.coalesce("hit", F.lit(0.0)) >= 1
    found = [
        (c("probe"), F.lit("AUTO_CORPUS_PROBE_NOT_MEASURED"), F.lit(1.0)), (miss, cause, sure),
        (c("issues") > 0, F.lit("LIKELY_QUERY_SURFACE_NORMALIZATION_GAP"), F.when(robust, 0.45).otherwise(0.35)),
        (judged & ~c("cited") & c("expected_id").isNotNull(), F.lit("LIKELY_CITATION_MISMATCH"), F.lit(0.75)), (judged & c("risk"), F.lit("LIKELY_GENERATION_DRIFT"), F.lit(0.4)),
        (judged & c("abstained") & c("has_gold_answer"), F.when(hit, "FALSE_ABSTAIN_EVIDENCE_THRESHOLD").otherwise("LIKELY_ABSTENTION_POLICY"), F.when(hit, 0.85).otherwise(0.7))]
    each = F.array_compact(F.array(*(F.when(when, F.struct((-confidence).alias("s"), F.lit(i).alias("i"), name.alias("cause"))) for i, (when, name, confidence) in enumerate(found))))
    causes = F.transform(F.slice(F.array_sort(each), 1, 5), lambda x: F.struct(x["cause"].alias("cause"), (-x["s"]).alias("confidence")))
    passed = F.when(~c("measured"), False).when(c("expected_id").isNull(), c("abstained") | ~c("answered")).when(~hit, False).when(~c("answered"), True).otherwise(~c("risk"))
    return rows.select("question_id", causes.alias("causes"), passed.alias("passed"))


def pass_rate(causes: DataFrame, rows: DataFrame) -> DataFrame:
    """Cohort, pass_rate of its measured questions."""
    return rows.where("measured").select("question_id", "cohort").join(causes.select("question_id", "passed"), "question_id").groupBy("cohort").agg(F.avg(c("passed").cast("double")).alias("pass_rate"))


def answer_scores(rows: DataFrame) -> DataFrame:
    """Rows with exact_match, lexical_overlap, fluency, entity_match, procedure_match, grounded, risk, citation_accuracy, numeric_accuracy.

    Rows: question_id, gold, predicted, expected_chunk_id, cited_ids, category. Words are those between white space, in lower
    case, digits as Latin ones. An answer is grounded if it cites the chunk and shares 0.15 of the words, and a risk if it
    does not cite it and shares less than 0.05. Without an answer nothing matches and the risk is there."""
    key = lambda x: F.lower(F.regexp_replace(F.regexp_replace(T.to_latin_digits(x), r"(?U)\s+", " "), "^ | $", ""))
    words = lambda x: F.array_distinct(F.filter(F.split(x, " "), lambda w: w != ""))
    some = F.coalesce("predicted", F.lit("")) != ""
    gold, said = key(F.coalesce("gold", F.lit(""))), key(c("predicted"))
    lexical = T.jaccard(words(gold), words(said))
    cites = F.coalesce((c("expected_chunk_id") != "") & F.array_contains("cited_ids", c("expected_chunk_id")), F.lit(False))
    numbers = lambda x: F.array_distinct(F.transform(T.number_runs(x), T.to_latin_digits))
    wanted = numbers(F.coalesce("gold", F.lit("")))
    letters, persian = F.regexp_count("predicted", F.lit(r"[\p{L}\x{0600}-\x{06FF}]")), F.regexp_count("predicted", F.lit(r"[\x{0600}-\x{06FF}]"))
    fluency = F.when(letters > 0, persian / letters).otherwise(0.0) * F.when(F.contains("predicted", F.lit("  ")), 0.7 + 0.3 * 0.4).otherwise(1.0)
    known = rows.withColumns({"_some": some, "_lexical": F.when(some, lexical).otherwise(0.0), "_cites": some & cites})
    only = lambda *names: F.when(c("_some") & c("category").isin(*names), c("_lexical"))
    return known.withColumns({
        "exact_match": F.coalesce(c("_some") & (gold == said), F.lit(False)), "lexical_overlap": c("_lexical"), "fluency": F.when(c("_some"), fluency).otherwise(0.0),
        "entity_match": only("responsibility", "permission"), "procedure_match": only("procedure", "multi_step"),
        "grounded": c("_cites") & (c("_lexical") >= 0.15), "risk": ~c("_some") | ((c("_lexical") < 0.05) & ~c("_cites")), "citation_accuracy": c("_cites"),
        "numeric_accuracy": F.when(c("_some") & (F.size(wanted) > 0), F.size(F.array_intersect(wanted, numbers(c("predicted")))) / F.size(wanted)),
    }).drop("_some", "_lexical", "_cites")


def answers_by_cohort(scored: DataFrame, key: str = "cohort") -> DataFrame:
    """Rates and means of `answer_scores` over the rows that have an answer (even an empty one), of each cohort."""
    flag = lambda name, out: F.avg(F.coalesce(c(name), F.lit(False)).cast("double")).alias(out)
    return scored.where("predicted is not null").groupBy(key).agg(
        F.count("*").alias("n"), flag("exact_match", "exact_match_rate"), F.avg("lexical_overlap").alias("lexical_overlap_mean"), F.avg("fluency").alias("fluency_mean"), F.avg("entity_match").alias("entity_match_mean"),
        F.avg("procedure_match").alias("procedure_match_mean"), flag("grounded", "groundedness_rate"), flag("citation_accuracy", "citation_accuracy_rate"), F.avg("numeric_accuracy").alias("numeric_accuracy_mean"), flag("abstained", "abstention_rate"))


def context_averages(statistics: DataFrame) -> DataFrame:
    """One row of means and totals over the assembled contexts."""
    removed = F.size("removed_ids")
    return statistics.agg(
        F.count("*").alias("n"), F.avg("original_chunks").alias("avg_original_chunks"), F.avg("blocks").alias("avg_final_blocks"), F.avg(removed).alias("avg_duplicate_removals"), F.avg("removed_chars").alias("avg_duplicated_chars_removed"),
        F.avg("context_chars").alias("avg_context_chars"), F.avg("estimated_tokens").alias("avg_estimated_tokens"), F.coalesce(F.sum(removed), F.lit(0)).alias("total_duplicate_removals"), F.coalesce(F.sum("removed_chars"), F.lit(0)).alias("total_duplicated_chars_removed"))


def surface_report(texts: DataFrame) -> DataFrame:
    """Issue, n, rate over all texts."""
    total = texts.agg(F.count("*").alias("total"))
    rows = texts.select(F.explode(T.surface_issues("text")).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))
    return rows.join(F.broadcast(total)).select("issue", "n", (c("n") / c("total")).alias("rate"))


def per_document(rows: DataFrame, cohorts: tuple[str, ...] = ("baseline", "robustness")) -> DataFrame:
    """document_id, and of each cohort the number of its measured questions and their hit rate. Rows: document_id (null: unknown), cohort, measured, hit (null: not known)."""
    of = lambda name: c("cohort") == name
    named = [x for n in cohorts for x in (F.count_if(of(n)).alias(f"{n}_n"), F.avg(F.when(of(n), c("hit").cast("double"))).alias(f"{n}_hit"))]
    return rows.where("measured").groupBy(F.coalesce(c("document_id").cast("string"), F.lit("unknown")).alias("document_id")).agg(*named)


def trust_rows(metrics: DataFrame, limits: dict[str, float]) -> DataFrame:
    """experiment_id, metric, value, limit, trusted: one row for each metric. Values are compared to nine places (see metrics.settled)."""
    wide = metrics.select("experiment_id", *(c(n).cast("double").alias(n) for n in limits))
    rows = wide.unpivot("experiment_id", list(limits), "metric", "value")
    table = metrics.sparkSession.createDataFrame(list(limits.items()), "metric string, least double")
    return rows.join(F.broadcast(table), "metric").withColumn("trusted", F.coalesce(M.settled(c("value")) >= c("least"), F.lit(False)))


#: G19, fixed values: metrics of the trust report, how far each may be trusted, and of which table it is.
TRUST = [("hit_at_k", "measured"), ("recall_at_k", "measured"), ("precision_at_k", "measured"), ("mrr", "measured"), ("pass_rate", "measured"), ("retrieval_score", "estimated"), ("exact_match", "measured"), ("citation_accuracy", "measured"), ("numeric_accuracy", "measured"), ("lexical_overlap", "estimated"), ("groundedness_estimate", "estimated")]
#: G19, fixed values: scores of subsystems, a hundred times a metric.
SUBSYSTEMS = {"retrieval_hit_at_k": "hit_at_k", "retrieval_mrr": "mrr", "citation_accuracy": "citation_accuracy"}


def trust_report(by_cohort_: DataFrame) -> DataFrame:
    """Metric, trust, baseline_value, robustness_value: a row for each metric that the table (cohort, metrics) holds."""
    names = [(n, t) for n, t in TRUST if n in by_cohort_.columns]
    tall = by_cohort_.select("cohort", *(c(n).cast("double").alias(n) for n, _ in names)).unpivot("cohort", [n for n, _ in names], "metric", "value")
    value = lambda cohort: F.max(F.when(c("cohort") == cohort, c("value"))).alias(f"{cohort}_value")
    table = by_cohort_.sparkSession.createDataFrame(names, "metric string, trust string")
    return tall.groupBy("metric").agg(value("baseline"), value("robustness")).join(F.broadcast(table), "metric").select("metric", "trust", "baseline_value", "robustness_value")


def subsystem_scores(by_cohort_: DataFrame) -> DataFrame:
    """Cohort, name, score (0 to 100, null without the metric)."""
    have = {k: v for k, v in SUBSYSTEMS.items() if v in by_cohort_.columns}
    return by_cohort_.select("cohort", *((100.0 * c(v)).alias(k) for k, v in have.items())).unpivot("cohort", list(have), "name", "score")


def compare_models(rows: DataFrame, current: str, gain: float = 0.05) -> DataFrame:
    """The model to use: the best by hit rate, then by mrr, if its hit rate is larger by `gain`. Rows: model, hit_rate, mrr (null: 0).

    Without a row of the current model the best is recommended; without rows the current one."""
    rate, order = F.coalesce("hit_rate", F.lit(0.0)), F.struct(F.coalesce("hit_rate", F.lit(0.0)), F.coalesce("mrr", F.lit(0.0)), "model")
    now = F.max(F.when(c("model") == current, rate))
    out = rows.agg(F.max_by("model", order).alias("best"), F.max(rate).alias("best_rate"), now.alias("current_rate"))
    better = c("current_rate").isNull() | ((c("best") != current) & (c("best_rate") - c("current_rate") >= gain))
    return out.withColumn("recommended", F.when(c("best").isNotNull() & better, c("best")).otherwise(current))


def share_of(flag: Column) -> Column:
    return F.avg(flag.cast("double"))
