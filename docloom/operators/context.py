"""Context assembly and prompts (P01-P10), answers and citations (A01-A08), history."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docloom.functions import constants as K
from docloom.functions import text as T


def near_duplicate(a: Column, b: Column) -> Column:
    """Of folded texts: equal, contained in most of the other, or of nearly the same words."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    words = lambda x: F.array_distinct(F.split(x, " "))
    inside = F.contains(long, short) & (F.length(short) / F.length(long) >= K.CONTAINMENT)
    return (a != "") & (b != "") & ((a == b) | inside | (T.jaccard(words(a), words(b)) >= K.TOKEN_JACCARD))


def deduplicate(hits: DataFrame) -> DataFrame:
    """Greedy in the order of rank, over the hits of a query (50 at most). Adds duplicate."""
    folded = T.casefold(T.collapse_spaces("text"))
    rows = hits.withColumn("_f", folded)
    lists = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("_f").alias("f")))).alias("l"))
    kept = F.aggregate("l", F.array().cast("array<struct<rank:int,f:string>>"), lambda acc, x: F.when(F.exists(acc, lambda k: near_duplicate(x["f"], k["f"])), acc).otherwise(F.concat(acc, F.array(F.struct(x["rank"].cast("int").alias("rank"), x["f"].alias("f"))))))
    marks = lists.select("query_id", F.transform(kept, lambda k: k["rank"]).alias("_kept"))
    return rows.join(marks, "query_id").withColumn("duplicate", ~F.array_contains("_kept", F.col("rank").cast("int"))).drop("_f", "_kept")


def presentation(hits: DataFrame) -> DataFrame:
    """Place in the order of presentation; scores are compared to nine places, as search ranks them."""
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), T.casefold(F.coalesce("heading", F.lit(""))), "document_version_id", "chunk_index", "chunk_id")
    return hits.withColumn("place", F.row_number().over(order))


def overlap(left: str, right: str) -> int:
    """Length of the longest end of left that right begins with, by the prefix function of right: in time linear in both."""
    n = min(len(left), len(right))
    fall, k = [0] * n, 0
    for i in range(1, n):
        while k and right[i] != right[k]:
            k = fall[k - 1]
        k += right[i] == right[k]
        fall[i] = k
    k = 0
    for x in left[len(left) - n :]:
        while k and (k == n or x != right[k]):
            k = fall[k - 1]
        k += n > 0 and x == right[k]
    return k


def join_adjacent(left: str, right: str) -> str:
    """Right behind left without the longest overlap; a line break if there is none."""
    if not left or not right:
        return left or right
    n = overlap(left, right)
    return left + right[n:] if n else f"{left}\n{right}"


@F.arrow_udf(StringType())
def _merged(texts: pa.Array) -> pa.Array:
    return T.each(texts, lambda own: reduce(join_adjacent, own))


def blocks(kept: DataFrame) -> DataFrame:
    """Runs of neighbouring chunks of a version as blocks, in their order per query; scores are compared to nine places, as search ranks them."""
    run = F.col("chunk_index") - F.row_number().over(W.partitionBy("query_id", "document_version_id").orderBy("chunk_index", "chunk_id"))
    member = F.struct("chunk_index", "chunk_id", F.trim("text").alias("text"), "score", "heading", "document_id")
    made = kept.withColumn("_run", run).groupBy("query_id", "document_version_id", "_run").agg(F.array_sort(F.collect_list(member)).alias("members"))
    merged = _merged(F.transform("members", lambda m: F.coalesce(m["text"], F.lit(""))))
    best = F.array_max(F.transform("members", lambda m: F.struct(F.round(m["score"], 9).alias("rounded"), (-m["chunk_index"]).alias("i"), m["chunk_id"].alias("chunk_id"), m["heading"].alias("heading"), m["document_id"].alias("document_id"))))
    most = F.array_max(F.transform("members", lambda m: m["score"]))
    same = F.size(F.array_distinct(F.transform("members", lambda m: T.casefold(F.trim(F.coalesce(m["heading"], F.lit(""))))))) == 1
    shared = F.try_element_at(F.filter(F.transform("members", lambda m: m["heading"]), lambda h: h.isNotNull() & (h != "")), F.lit(1))
    out = made.withColumns({"text": merged, "best": best}).withColumns({"heading": F.when(same, shared).otherwise(F.col("best.heading")), "primary_id": F.col("best.chunk_id"), "max_score": most, "min_index": F.col("members")[0]["chunk_index"], "document_id": F.col("best.document_id"), "chunk_ids": F.transform("members", lambda m: m["chunk_id"])})
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("max_score", 9)), T.casefold(F.coalesce("heading", F.lit(""))), "document_version_id", "min_index", "primary_id")
    return out.withColumn("block", F.row_number().over(order)).select("query_id", "block", "document_version_id", "document_id", "heading", "primary_id", "max_score", "min_index", "chunk_ids", "text")


def statistics(deduplicated: DataFrame, made: DataFrame) -> DataFrame:
    """P06."""
    size = F.sum(F.length("text"))
    of = made.groupBy("query_id").agg(F.count("*").alias("blocks"), size.alias("context_chars"), F.sum(F.when(F.size("chunk_ids") > 1, F.size("chunk_ids")).otherwise(0)).alias("merged_chunks"))
    ids = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("chunk_id"))))
    dup = F.col("duplicate")
    chunks = deduplicated.groupBy("query_id").agg(F.count("*").alias("original_chunks"), ids(~dup).alias("kept_ids"), ids(dup).alias("removed_ids"), F.sum(F.when(dup, F.length(F.trim("text"))).otherwise(0)).alias("removed_chars"))
    return chunks.join(of, "query_id").withColumn("estimated_tokens", F.floor((F.col("context_chars") + 3) / 4))


def markers(made: DataFrame) -> DataFrame:
    """query_id, marker, chunk_id, block: a block's primary chunk first, then its others."""
    rows = made.select("query_id", "block", "primary_id", F.posexplode("chunk_ids").alias("pos", "chunk_id")).withColumn("second", F.col("chunk_id") != F.col("primary_id"))
    return rows.select("query_id", F.row_number().over(W.partitionBy("query_id").orderBy("block", "second", "pos")).alias("marker"), "chunk_id", "block", "second")


def response_language(query: Column, hint: Column) -> Column:
    """P10."""
    return F.when(hint.isin("fa", "en"), hint).when(query.rlike(r"[\x{0600}-\x{06FF}]"), "fa").otherwise("en")


def clipped(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def prompts(queries: DataFrame, history: DataFrame, made: DataFrame, budget: int = K.PROMPT_CHARS, fixed: int = 400) -> DataFrame:
    """query_id, prompt, dropped turns and blocks, error_code.

    The oldest turns go first, then the blocks of the lowest score; one block must stay. `fixed`
    is the size of what every prompt holds besides. History: query_id, seq, role, content."""
    turn = F.concat_ws(": ", "role", F.trim("content"))
    h = history.withColumn("line", turn).withColumn("size", F.sum(F.length("line") + 1).over(W.partitionBy("query_id").orderBy(F.desc("seq"))))
    marked = markers(made).where("not second").select("query_id", "block", "marker")
    part = F.concat(F.lit("["), "marker", F.lit("] "), F.coalesce("heading", F.lit("(none)")), F.lit("\n"), clipped(F.trim("text"), K.BLOCK_CHARS))
    b = made.join(marked, ["query_id", "block"]).withColumn("line", part).withColumn("size", F.sum(F.length("line") + 1).over(W.partitionBy("query_id").orderBy("block")))
    room = queries.select("query_id", "query", (F.lit(budget - fixed) - F.length("query")).alias("room"))
    total = b.groupBy("query_id").agg(F.max("size").alias("used"))
    base = room.join(total, "query_id", "left").withColumn("left", F.col("room") - F.coalesce("used", F.lit(0)))
    kept_h = h.join(base, "query_id").where("size <= left")
    kept_b = b.join(base.select("query_id", "room"), "query_id").where("size <= room or block = 1")
    lines = lambda df, key, name: df.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "line"))), lambda x: x["line"]), "\n").alias(name), F.count("*").alias(f"n_{name}"))
    counts = history.groupBy("query_id").agg(F.count("*").alias("turns")).join(made.groupBy("query_id").agg(F.count("*").alias("all_blocks")), "query_id", "full_outer")
    first = b.where("block = 1").select("query_id", F.col("size").alias("least"))
    out = base.join(lines(kept_h, "seq", "history"), "query_id", "left").join(lines(kept_b, "block", "evidence"), "query_id", "left").join(counts, "query_id", "left").join(first, "query_id", "left")
    large = F.coalesce(F.col("least") > F.col("room"), F.lit(False))
    return out.select("query_id", F.when(~large, F.concat_ws("\n\n", "history", "evidence", "query")).alias("prompt"), F.coalesce(F.col("turns") - F.coalesce("n_history", F.lit(0)), F.lit(0)).alias("dropped_turns"), F.coalesce(F.col("all_blocks") - F.coalesce("n_evidence", F.lit(0)), F.lit(0)).alias("dropped_blocks"), F.when(large, "prompt_too_large").alias("error_code"))


# Answers (A01-A08)

_WORD = r"(?i)\bABSTAIN\b\s*:?\s*([A-Za-z][\w-]*)?"


def abstention(answer: Column) -> Column:
    """The reason for which a model abstained, null if it answered."""
    text = T.strip(F.coalesce(answer, F.lit("")))
    first = F.substring_index(text, "\n", 1)
    rest = T.strip(F.substr(text, F.length(first) + 1, F.length(text)))
    some = lambda x: F.lower(F.when(x == "", "insufficient_evidence").otherwise(x))
    own = F.regexp_extract(first, r"(?i)^\s*ABSTAIN\b\s*:?\s*([A-Za-z][\w-]*)?", 1)
    without = F.regexp_replace(F.regexp_replace(text, _WORD, " "), r"\[\d+\]|\s+", "")
    return (F.when(first.rlike(r"(?i)^\s*ABSTAIN\b"), some(own))
            .when(text.rlike(r"(?i)\bABSTAIN\b") & (F.length(without) <= 24), some(F.regexp_extract(text, _WORD, 1))))


def citation_markers(answer: Column) -> Column:
    """A03."""
    return F.array_distinct(T.find_all(answer, r"\[(\d+)\]", 1))


def without_echo(question: Column, answer: Column) -> Column:
    """A04."""
    q, a = T.strip(F.coalesce(question, F.lit(""))), T.strip(F.coalesce(answer, F.lit("")))
    qc, ac = T.collapse_spaces(q), T.collapse_spaces(a)
    cut = T.strip(F.regexp_replace(F.substr(ac, F.length(qc) + 1, F.length(ac)), r"^[ :\-–—\n\t]+", ""))
    first = F.substring_index(a, "\n", 1)
    rest = T.strip(F.substr(a, F.length(first) + 1, F.length(a)))
    return F.when((q == "") | (a == ""), a).when(F.startswith(F.lower(ac), F.lower(qc)), F.when(cut != "", cut).otherwise(a)).when(T.strip(first) == q, F.when(rest != "", rest).otherwise(a)).otherwise(a)


def substantive(answer: Column) -> Column:
    """A05."""
    return F.length(T.collapse_spaces(F.regexp_replace(F.coalesce(answer, F.lit("")), r"\[\d+\]", " "))) >= 8


def citations(answers: DataFrame, marked: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, marker, rank (of the marker in the answer), chunk_id, score, excerpt."""
    asked = answers.select("query_id", F.posexplode(citation_markers(F.col("answer"))).alias("rank", "marker")).withColumns({"rank": F.col("rank") + 1, "marker": F.col("marker").cast("bigint")})
    found = asked.join(marked.select("query_id", F.col("marker").cast("bigint").alias("marker"), "chunk_id"), ["query_id", "marker"]).join(chunks.select("query_id", "chunk_id", "score", "text"), ["query_id", "chunk_id"])
    return found.select("query_id", "marker", "rank", "chunk_id", "score", clipped(F.trim("text"), K.EXCERPT_CHARS).alias("excerpt"))


def salvage(marked: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, chunk_id: that of marker 1, else of the largest score."""
    best = chunks.groupBy("query_id").agg(F.max_by("chunk_id", F.struct("score", (-F.col("rank")).alias("r"))).alias("best"))
    one = marked.where("marker = 1").select("query_id", F.col("chunk_id").alias("one")).join(chunks.select("query_id", F.col("chunk_id").alias("one")), ["query_id", "one"], "left_semi")
    return best.join(one, "query_id", "left").select("query_id", F.coalesce("one", "best").alias("chunk_id"))


def sufficient(hits: DataFrame, least: float = K.MIN_EVIDENCE) -> DataFrame:
    """query_id of queries whose best hit reaches the least score."""
    return hits.groupBy("query_id").agg(F.max("score").alias("top")).where(F.col("top") >= least).select("query_id")


def outcomes(answers: DataFrame, hits: DataFrame, marked: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, status, reason, final_answer, cited ids. Answers: query_id, query, answer, failure (nullable)."""
    ok = sufficient(hits).withColumn("enough", F.lit(True))
    cleaned = answers.withColumn("answer", F.col("answer")).withColumn("clean", without_echo(F.col("query"), F.col("answer")))
    cited = citations(cleaned.select("query_id", F.col("clean").alias("answer")), marked, chunks).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("cited"))
    rows = cleaned.join(ok, "query_id", "left").join(cited, "query_id", "left").join(salvage(marked, chunks).withColumnRenamed("chunk_id", "salvaged"), "query_id", "left")
    refused = abstention(F.col("answer"))
    ids = F.coalesce("cited", F.when(F.col("salvaged").isNotNull(), F.array("salvaged")))
    reason = (F.when(F.col("enough").isNull(), "insufficient_evidence").when(F.col("failure").isNotNull(), F.col("failure")).when(refused.isNotNull(), refused)
              .when(~substantive(F.col("clean")), "empty_or_echo_answer").when(ids.isNull(), "citation_validation_failed"))
    status = F.when(reason.isNull(), "completed").when(F.col("enough").isNotNull() & F.col("failure").isNotNull(), "failed").otherwise("abstained")
    final = F.when(F.size(citation_markers(F.col("clean"))) > 0, F.trim("clean")).otherwise(F.concat(F.trim("clean"), F.lit(" [1]")))
    return rows.select("query_id", status.alias("status"), reason.alias("reason"), F.when(reason.isNull(), final).alias("final_answer"), F.when(reason.isNull(), ids).alias("cited_ids"))


# History (H01-H04). Messages: conversation_id, seq, role, content.

def recent_turns(messages: DataFrame, n: int) -> DataFrame:
    """The last n (5 to 10) turns of user and assistant that are not blank, in order."""
    n = min(10, max(5, n))
    rows = messages.where(F.col("role").isin("user", "assistant") & (F.trim("content") != ""))
    last = rows.withColumn("_r", F.row_number().over(W.partitionBy("conversation_id").orderBy(F.desc("seq")))).where(F.col("_r") <= n)
    return last.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("seq", "role", "content"))).alias("turns"))


def append_turns(messages: DataFrame, pairs: DataFrame) -> DataFrame:
    """Messages with a question and an answer each (conversation_id, question, answer) behind the last."""
    last = messages.groupBy("conversation_id").agg(F.max("seq").alias("last"))
    rows = pairs.join(last, "conversation_id", "left").withColumn("at", F.coalesce(F.col("last") + 1, F.lit(0)))
    rows = rows.withColumn("at", F.col("at") + 2 * (F.row_number().over(W.partitionBy("conversation_id").orderBy("question")) - 1))
    more = rows.select("conversation_id", F.inline(F.array(F.struct(F.col("at").cast("bigint").alias("seq"), F.lit("user").alias("role"), F.col("question").alias("content")), F.struct((F.col("at") + 1).cast("bigint").alias("seq"), F.lit("assistant").alias("role"), F.col("answer").alias("content")))))
    return messages.select("conversation_id", F.col("seq").cast("bigint").alias("seq"), "role", "content").unionByName(more)


def transcript(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """The messages of active conversations; each conversation's are in order within one partition."""
    return messages.join(conversations.where("status = 'active'").select("conversation_id"), "conversation_id", "left_semi").repartition("conversation_id").sortWithinPartitions("conversation_id", "seq")
