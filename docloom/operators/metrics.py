"""Evaluation metrics (M01-M17) over tables of question outcomes.

Outcomes: experiment_id, question_id, status, expect_abstention, expected_ids, retrieved_ids, cited_ids (arrays of
string), generation_status, abstained, e2e_ms, retrieval_ms, generation_ms, total_tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.sources.shared import settle

c = F.col
E, R, C = "expected_ids", "retrieved_ids", "cited_ids"


def eligible(include_abstain: bool = False) -> Column:
    some = F.size(E) > 0
    return some if include_abstain else some & ~c("expect_abstention")


def reciprocal_rank(retrieved: str = R, expected: str = E) -> Column:
    """1 / rank of the first expected id, 0 without one."""
    hits = F.filter(F.transform(retrieved, lambda x, i: F.when(F.array_contains(expected, x), i + 1)), lambda x: x.isNotNull())
    return F.coalesce(1.0 / F.try_element_at(hits, F.lit(1)), F.lit(0.0))


def overlap(a: str = C, b: str = E) -> Column:
    return F.size(F.array_intersect(a, b))


def citation_precision() -> Column:
    """Null without citations."""
    return F.when(F.size(C) > 0, overlap() / F.size(F.array_distinct(C)))


def citation_recall() -> Column:
    return F.when(F.size(E) > 0, overlap() / F.size(F.array_distinct(E)))


def citation_accurate() -> Column:
    return F.when(F.size(E) > 0, F.coalesce((citation_precision() >= 1) & (citation_recall() >= 1), F.lit(False)))


def grounded() -> Column:
    """M04."""
    inside = F.size(F.array_except(C, R)) == 0
    return F.coalesce((c("generation_status") == "completed") & inside & (F.arrays_overlap(C, E) | F.arrays_overlap(C, R)), F.lit(False))


def _abstained() -> Column:
    return c("abstained") | F.coalesce(c("generation_status") == "abstained", F.lit(False))


def _share(good: Column, of: Column) -> Column:
    return F.try_divide(F.count_if(of & good), F.count_if(of))


def _octave(v: Column, parts: int = 256) -> Column:
    """A bucket that never falls as v grows: the parts of octaves, those of negative numbers in reverse."""
    log = lambda x: F.floor(F.log2(x) * parts) + 2000 * parts
    return F.when(v > 0, log(v)).when(v < 0, -log(-v)).otherwise(0).cast("bigint")


def nearest_ranks(rows: DataFrame, by: str, column: str, **ranks: float) -> DataFrame:
    """Exact nearest-rank percentiles of a column per group, as the columns named by `ranks`.

    Counts of buckets first, which tell the bucket that holds each rank; then the distinct values of those buckets alone.
    Both counts are aggregated before they are shuffled, so a group of any size stays spread. Nulls do not count."""
    values = rows.where(c(column).isNotNull()).select(by, c(column).cast("double").alias("v"))
    buckets = values.groupBy(by, _octave(c("v")).alias("bucket")).agg(F.count("*").alias("n"))
    upto = W.partitionBy(by).orderBy("bucket")
    table = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p")) for n, p in ranks.items()))
    counted = buckets.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(W.partitionBy(by))})
    wanted = counted.withColumn("r", F.explode(table)).where((c("upto") >= c("r.p") * c("total")) & (c("upto") - c("n") < F.greatest(c("r.p") * c("total"), F.lit(1e-300))))
    wanted = wanted.select(by, "bucket", c("r.name").alias("name"), (c("r.p") * c("total")).alias("rank"), (c("upto") - c("n")).alias("before"))
    inside = values.withColumn("bucket", _octave(c("v"))).join(wanted.select(by, "bucket").distinct(), [by, "bucket"], "left_semi").groupBy(by, "bucket", "v").agg(F.count("*").alias("n"))
    placed = inside.withColumn("own", F.sum("n").over(W.partitionBy(by, "bucket").orderBy("v"))).join(wanted, [by, "bucket"])
    found = placed.where(c("before") + c("own") >= c("rank")).groupBy(by).agg(*(F.min(F.when(c("name") == n, c("v"))).alias(n) for n in ranks))
    return found


def positions(rows: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """rows numbered from 1 in a global order: sorted in ranges, each of which adds the counts of the ranges before it."""
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    held = settle(sorted_.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "positions")
    parts = held.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("first")).orderBy("_part").collect()  # a row for each partition
    before, table = 0, []
    for r in parts:
        table.append((r["_part"], before - r["first"] + 1))
        before += r["n"]
    offsets = rows.sparkSession.createDataFrame(table, "_part int, offset bigint")
    return held.join(F.broadcast(offsets), "_part").withColumn(name, c("_at") + c("offset")).drop("_part", "_at", "offset")


def report(outcomes: DataFrame, include_abstain: bool = False, by: str = "experiment_id") -> DataFrame:
    """One row of metrics per experiment over its outcomes that are ok: one aggregation, and the percentiles."""
    ok = outcomes.where("status = 'ok'")
    can = eligible(include_abstain)
    done = ~c("expect_abstention") & (c("generation_status") == "completed") & (F.size(E) > 0)
    whole = ok.groupBy(by).agg(
        _share(F.arrays_overlap(E, R), can).alias("recall_at_k"), F.avg(F.when(can, reciprocal_rank())).alias("mrr"), F.count_if(can).alias("n_retrieval"),
        F.try_divide(F.count_if(done & grounded()), F.count_if(~c("expect_abstention"))).alias("groundedness"),
        F.avg(F.when(done, citation_precision())).alias("citation_precision_mean"), F.avg(F.when(done, citation_accurate().cast("int"))).alias("citation_accuracy"),
        _share(c("expect_abstention"), _abstained()).alias("abstention_precision"), _share(_abstained(), c("expect_abstention")).alias("abstention_recall"),
        F.count_if(~c("expect_abstention")).alias("n_answerable"), F.count_if(c("expect_abstention")).alias("n_abstain_cases"),
        F.avg("e2e_ms").alias("e2e_mean"),
        F.avg("retrieval_ms").alias("retrieval_mean"), F.avg("generation_ms").alias("generation_mean"),
        F.avg("total_tokens").alias("tokens_mean"), F.count_if(c("total_tokens").isNull()).alias("tokens_missing"))
    return whole.join(nearest_ranks(ok, by, "e2e_ms", e2e_p50=0.5, e2e_p95=0.95), by, "left")


def by_language(outcomes: DataFrame, questions: DataFrame) -> DataFrame:
    """M08."""
    rows = outcomes.join(questions.select("question_id", "language"), "question_id", "left").withColumn("language", F.coalesce("language", F.lit("unknown")))
    return rows.groupBy("language").agg(F.count("*").alias("n"), F.count_if(c("status") == "ok").alias("ok"), F.count_if(c("status") != "ok").alias("error"), F.count_if(_abstained()).alias("abstained"))


def settled(v: Column) -> Column:
    """v as it is compared with limits: to nine places, so that the order in which a mean was summed decides nothing."""
    return F.round(v, 9)


def gates(metrics: DataFrame, outcomes: DataFrame, thresholds: dict[str, float], most_errors: float = 0.10) -> DataFrame:
    """experiment_id, failing (names of metrics under their threshold), error_rate, passed."""
    errors = outcomes.groupBy("experiment_id").agg((F.count_if(c("status") != "ok") / F.count("*")).alias("error_rate"))
    low = [F.when(settled(c(name)) < limit, name) for name, limit in thresholds.items()]
    rows = metrics.join(errors, "experiment_id").withColumn("failing", F.array_compact(F.array(*low, F.when(c("error_rate") > most_errors, "aggregate_incomplete"))))
    return rows.select("experiment_id", "failing", "error_rate", (F.size("failing") == 0).alias("passed"))


def experiment(questions: DataFrame, hits: DataFrame, outcomes_of_answers: DataFrame) -> DataFrame:
    """Outcomes of an experiment: questions with what was retrieved and answered; errors are rows."""
    found = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"].cast("string")).alias(R))
    rows = questions.join(found.withColumnRenamed("query_id", "question_id"), "question_id", "left").join(outcomes_of_answers.withColumnRenamed("query_id", "question_id").withColumnRenamed("status", "generation_status"), "question_id", "left")
    none = F.array().cast("array<string>")
    return rows.withColumns({"status": F.when(c("generation_status").isNull(), "error").otherwise("ok"), R: F.coalesce(R, none), C: F.coalesce(c("cited_ids").cast("array<string>"), none), "abstained": F.coalesce(c("generation_status") == "abstained", F.lit(False))})


def ranked_metrics(rows: DataFrame, k: int) -> DataFrame:
    """Per question with exact denominators: hit, recall, precision at k, reciprocal rank."""
    hit = F.size(F.array_intersect(F.slice(R, 1, k), E))
    return rows.select("question_id", (hit > 0).cast("double").alias("hit_at_k"), F.coalesce(F.try_divide(hit, F.size(F.array_distinct(E))), F.lit(0.0)).alias("recall_at_k"), (hit / k).alias("precision_at_k"), reciprocal_rank().alias("mrr"))


def mean_ranked(rows: DataFrame, *by: str) -> DataFrame:
    names = ["hit_at_k", "recall_at_k", "precision_at_k", "mrr"]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *(F.avg(n).alias(n) for n in names))


def gold_ranks(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """query_id, gold_rank: the first hit that holds the gold marker (normalised alike), null without one."""
    best = hits.join(gold, "query_id").where(F.contains("text", "marker")).groupBy("query_id").agg(F.min("rank").alias("gold_rank"))
    return gold.select("query_id").distinct().join(best, "query_id", "left")


def gold_summary(ranks: DataFrame, answers: DataFrame | None = None, wrong: DataFrame | None = None) -> DataFrame:
    """Hits and mean reciprocal rank; with answers (query_id, answer, abstained, marker) also passes, abstentions, wrong
    answers and false abstentions; with `wrong` (query_id of those that got another question's passage) their number."""
    hit = lambda k: F.avg(F.coalesce((c("gold_rank") <= k).cast("int"), F.lit(0))).alias(f"hit_{k}")
    named = [F.count("*").alias("n"), hit(1), hit(3), hit(5), F.avg(F.coalesce(1.0 / c("gold_rank"), F.lit(0.0))).alias("mrr")]
    if wrong is not None:
        ranks = ranks.join(wrong.select("query_id").distinct().withColumn("_wrong", F.lit(True)), "query_id", "left")
        named.append(F.count_if(c("_wrong") & c("gold_rank").isNotNull()).alias("wrong_retrieval"))
    if answers is not None:
        verdict = F.when(c("abstained"), "abstain").when(F.contains(T.answer_key("answer"), T.answer_key("marker")), "pass").otherwise("wrong")
        ranks = ranks.join(answers.select("query_id", "abstained", verdict.alias("verdict")), "query_id")
        named += [F.count_if(c("verdict") == "pass").alias("passed"), F.count_if(c("verdict") == "abstain").alias("abstains"), F.count_if(c("verdict") == "wrong").alias("wrong_answers"), F.count_if(c("abstained") & c("gold_rank").isNotNull()).alias("false_abstains")]
    return ranks.agg(*named)


def completeness(rows: DataFrame) -> DataFrame:
    """Share of the facts (array) that an answer holds, letters and digits compared alone, and the verdict. An abstention fails."""
    keyed = rows.withColumns({"_answer": T.answer_key(F.coalesce("answer", F.lit(""))), "_facts": T.answer_keys("facts")})
    share = F.when(F.size("facts") > 0, F.size(F.filter("_facts", lambda f: F.contains("_answer", f))) / F.size("facts")).otherwise(0.0)
    verdict = F.when(F.coalesce("abstained", F.lit(False)) | (share == 0), "fail").when(share == 1, "pass").otherwise("partial")
    return keyed.select("query_id", F.round(share, 4).alias("completeness"), verdict.alias("verdict"))


#: Openings of an answer that sound like a machine; the first two are fit for a grounded answer.
ROBOTIC = ["براساس اطلاعات موجود", "بر اساس اطلاعات موجود", "پرسش شما", "سؤال درباره", "سوال درباره"]
CITATION = r"\[(\d+)\]"


def style(rows: DataFrame) -> DataFrame:
    """query_id, markers_valid, paragraph_coverage, echo, robotic, fluent_script, numbered_steps. Rows: query_id, query, answer, abstained, markers (those of its citations, as [1]).

    Paragraphs end at blank lines and before numbered items, and count from 8 characters without their markers."""
    a = F.coalesce("answer", F.lit(""))
    bare = lambda x: F.when(F.contains(x, F.lit("[")), F.regexp_replace(x, CITATION, "")).otherwise(x)
    long = lambda x: x.rlike(r"(?Us)\S.{6,}\S")  # noqa: E731  8 characters or more between white space
    parts = F.split(a, r"(?dmU)\n\s*\n|(?=^\s*[۱-۹1-9][.)]\s+)")
    cites = T.let(parts, lambda own: F.transform(F.filter(own, lambda p: long(bare(p))), lambda p: p.rlike(CITATION)))
    coverage = T.let(cites, lambda own: F.when(F.size(own) > 0, F.round(F.size(F.filter(own, lambda p: p)) / F.size(own), 4)).otherwise(0.0))
    start = T.casefold(F.regexp_extract(a, r"(?Us)^\s*(.{0,60})", 1))  # longer than any opening
    begins = lambda prefixes: F.exists(T.words(prefixes), lambda p: F.startswith(start, T.casefold(p)))
    # An answer begins with its question only if its first words, cut before a space, do, or are the question's own; others need no key.
    rows = rows.withColumns({"_q": T.answer_key("query"), "_h": T.answer_key(bare(F.substring_index(a, " ", 8)))})
    q, h = (F.translate(x, "ς", "σ") for x in ("_q", "_h"))  # lower case tells the last sigma of a word
    rows = rows.withColumn("_may", (c("_q") != "") & (F.startswith(h, q) | F.startswith(q, h)))
    rows = rows.withColumn("_a", T.answer_key(F.when(F.coalesce("_may", F.lit(True)), bare(a))))
    echo = F.when(~c("_may"), False).otherwise(F.startswith("_a", "_q")) | begins(ROBOTIC[2:])
    persian = F.length(a) - F.length(F.regexp_replace(a, r"[\x{0600}-\x{06FF}]+", ""))
    letters = F.length(F.regexp_replace(a, r"[^\p{L}\p{Nl}\p{No}]+", ""))
    fluent = ~F.coalesce("abstained", F.lit(False)) & ~echo & ~F.contains(a, F.lit("\ufffd")) & (letters > 0) & (persian >= 0.55 * letters)
    marks = F.array_distinct(F.regexp_extract_all(a, F.lit(r"\[\d+\]"), F.lit(0)))
    return rows.select(
        "query_id", ((F.size(marks) > 0) & (F.size(F.array_except(marks, F.coalesce("markers", F.array().cast("array<string>")))) == 0)).alias("markers_valid"),
        coverage.alias("paragraph_coverage"), F.coalesce(echo, F.lit(False)).alias("echo"), begins(ROBOTIC).alias("robotic"),
        F.coalesce(fluent, F.lit(False)).alias("fluent_script"), a.rlike(r"(?dmU)^\s*[۱-۹1-9][.)]\s+\S").alias("numbered_steps"))


def evidence_summary(diagnostics: DataFrame, gold: DataFrame) -> DataFrame:
    """Gold kept, mean numbers selected and discarded, mean reduction. Gold: query_id, chunk_id."""
    rows = diagnostics.join(gold, "query_id", "left")
    chosen = F.concat("primary_ids", "support_ids")
    return rows.agg(F.avg(F.when(c("chunk_id").isNotNull(), F.array_contains(chosen, c("chunk_id")).cast("int"))).alias("gold_retained"), F.avg(F.size(chosen)).alias("selected"), F.avg(F.size("discarded_ids")).alias("discarded"), F.avg("reduction").alias("reduction"))


def trend(runs: DataFrame, metric: str) -> DataFrame:
    """A metric over the runs in order of time."""
    return positions(runs.select("experiment_id", "created_at", metric), "created_at", "experiment_id")
