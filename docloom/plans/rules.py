"""Queries of rules that decide by case: states, moves, uploads, scores of answers, sweeps. The SQL states the rules anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import catalog, context, diagnostics, indexing, metrics, questions
from docloom.plans.derived import _FA, fa
from docloom.plans.queries import _BM25, _KEPT, _OUT, _TOP, c, folders, hits_for_evidence, lexical_hits, outcomes, query, r6
from docloom.sources.shared import table


# --- index and catalogue

@query("""WITH v AS (SELECT o_orderkey, (['uploaded', 'extracting', 'chunked', 'indexing', 'failed', 'indexed', 'superseded'])[o_orderkey % 7 + 1] AS state, (['index', 'reindex', 'resume'])[(o_orderkey // 7) % 3 + 1] AS request, o_orderkey % 10 = 0 AS absent, o_orderkey % 9 = 0 AS without FROM orders),
r AS (SELECT *, CASE WHEN absent THEN 'version_not_found' WHEN request = 'resume' AND state IN ('uploaded', 'extracting', 'indexed', 'superseded') THEN 'version_not_resumable' WHEN state IN ('uploaded', 'extracting', 'superseded') THEN 'version_not_indexable' END AS error_code FROM v)
SELECT CASE WHEN absent THEN '' ELSE state END AS state, request, CASE WHEN error_code IS NOT NULL THEN NULL WHEN request = 'index' AND state = 'indexed' THEN 'already_indexed' WHEN without THEN 'failed' ELSE 'indexing' END AS next,
 CASE WHEN error_code IS NULL AND NOT (request = 'index' AND state = 'indexed') AND without THEN 'empty_chunk_list' END AS failure_reason, error_code, count(*) AS n FROM r GROUP BY 1, 2, 3, 4, 5""")
def index_transitions(spark, sf_dir):
    """Orders as versions of seven states; each asked for one of three requests; some are absent, some without chunks."""
    o = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("document_version_id"))
    i = c("document_version_id")
    states = F.array(*map(F.lit, ["uploaded", "extracting", "chunked", "indexing", "failed", "indexed", "superseded"]))
    v = o.where(i % 10 != 0).withColumn("processing_status", F.element_at(states, (i % 7 + 1).cast("int")))
    requests = o.withColumn("request", F.element_at(F.array(*map(F.lit, ["index", "reindex", "resume"])), (F.floor(i / 7) % 3 + 1).cast("int")))
    out = indexing.transitions(v, requests, o.where(i % 9 != 0)).join(v, "document_version_id", "left")
    return out.groupBy(F.coalesce("processing_status", F.lit("")).alias("state"), "request", "next", "failure_reason", "error_code").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT CASE WHEN n_nationkey % 6 = 3 THEN 'x' || n_nationkey ELSE 'n' || n_nationkey END AS folder_id, n_nationkey % 6 AS k FROM nation)
SELECT folder_id, CASE k WHEN 0 THEN 'into_itself' WHEN 1 THEN 'target_not_found' WHEN 2 THEN 'target_not_found' WHEN 3 THEN 'folder_not_found' WHEN 5 THEN 'folder_not_found' END AS error_code FROM m WHERE k <> 4
UNION ALL SELECT 'r' || n_regionkey, CASE WHEN min(n_nationkey) % 6 = 5 THEN 'target_not_found' ELSE 'cycle' END FROM nation GROUP BY n_regionkey""")
def folder_move_errors(spark, sf_dir):
    """Nations moved into themselves, to a folder that is absent or archived, and such as are absent or archived themselves; regions moved into a nation of their own."""
    f = folders(spark, sf_dir).withColumn("status", F.when(c("folder_id").startswith("n") & (F.substring("folder_id", 2, 9).try_cast("int") % 6 == 5), "archived").otherwise("active"))
    n, k = table(spark, sf_dir, "nation"), c("n_nationkey") % 6
    name = F.concat(F.lit("n"), "n_nationkey")
    moves = n.select(F.when(k == 3, F.concat(F.lit("x"), "n_nationkey")).otherwise(name).alias("folder_id"), F.when(k == 0, name).when(k == 1, "absent").when(k == 2, "n5").otherwise("r1").alias("target_id"))
    regions = n.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("n")).select(F.concat(F.lit("r"), "n_regionkey").alias("folder_id"), F.concat(F.lit("n"), "n").alias("target_id"))
    return catalog.move_folders(f, moves.unionByName(regions))[1].where("error_code <> 'name_conflict'")


@query("""SELECT CASE WHEN page_id % 11 = 0 THEN 'empty_file' WHEN page_id % 13 = 0 THEN 'file_too_large' WHEN page_id % 7 = 0 THEN 'unsupported_format' WHEN page_id % 17 = 0 THEN 'upload_expired' WHEN page_id % 19 = 0 OR html IS NULL THEN 'content_required'
 WHEN page_id % 5 = 0 THEN 'size_mismatch' WHEN page_id % 3 = 0 THEN 'checksum_mismatch' END AS error_code, CASE WHEN page_id % 11 = 0 OR page_id % 13 = 0 OR page_id % 7 = 0 THEN 'rejected' WHEN page_id % 17 = 0 THEN 'expired'
 WHEN page_id % 19 = 0 OR html IS NULL OR page_id % 5 = 0 OR page_id % 3 = 0 THEN 'rejected' ELSE 'completed' END AS status, count(*) AS n FROM pages GROUP BY 1, 2""")
def upload_admission(spark, sf_dir):
    """Pages as uploads, some empty, too large, with a wrong suffix, late, without content, or of another size or checksum."""
    i, content = c("page_id"), F.encode("html", "UTF-8")
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    size = F.when(i % 11 == 0, 0).when(i % 13 == 0, catalog.MAX_BYTES + 1).when(i % 5 == 0, F.length(content) + 1).otherwise(F.coalesce(F.length(content), F.lit(1)))
    rows = table(spark, sf_dir, "pages").select(
        F.when(i % 7 == 0, F.when(i % 2 == 0, "a.exe").otherwise("html")).otherwise("a.b.HTML").alias("file_name"), size.alias("declared_size"), F.when(i % 19 != 0, content).alias("content"),
        F.when(i % 3 == 0, "00").when(i % 2 == 0, F.sha2(content, 256)).alias("checksum"), (now - F.when(i % 17 == 0, F.expr("interval 25 hours")).otherwise(F.expr("interval 23 hours"))).alias("created_at"))
    return catalog.admit(rows, now).groupBy("error_code", "status").agg(F.count("*").alias("n"))


#: Orders as uploads to their customers' documents, of four states; the first of each was bound already, some are asked for twice.
_UPLOADS = """u AS (SELECT o_custkey AS d, o_orderkey AS u, o_orderkey AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders),
q AS (SELECT d, u, v, r FROM u UNION ALL SELECT d, u, -v, r FROM u WHERE u % 7 = 0),
e AS (SELECT *, CASE WHEN d % 10 = 0 THEN 'document_not_found' WHEN d % 5 IN (3, 4) THEN 'document_not_mutable' WHEN u % 4 = 0 THEN 'upload_not_completed' WHEN r = 1 THEN 'upload_already_used' WHEN u % 13 = 0 THEN 'upload_without_content' END AS e0 FROM q),
g AS (SELECT *, coalesce(e0, CASE WHEN row_number() OVER (PARTITION BY u, e0 ORDER BY v) > 1 THEN 'upload_already_used' END) AS error_code FROM e)"""


def _bound(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(c("o_custkey").alias("document_id"), c("o_orderkey").alias("document_version_id"), c("o_orderkey").alias("upload_session_id"))
    first = o.groupBy("document_id").agg(F.min("document_version_id").alias("document_version_id"))
    versions = first.select("document_id", "document_version_id", c("document_version_id").alias("upload_session_id"), F.lit(1).alias("version_number"))
    status = F.element_at(F.array(*map(F.lit, ["draft", "active", "draft", "archived", "deleted"])), (c("document_id") % 5 + 1).cast("int"))
    docs = first.where(c("document_id") % 10 != 0).select("document_id", status.alias("status"), c("document_version_id").alias("current_version_id"))
    i = c("upload_session_id")
    more = o.where(i % 7 == 0).withColumn("document_version_id", -c("document_version_id"))
    uploads = o.unionByName(more).withColumns({"status": F.when(i % 4 == 0, "pending").otherwise("completed"), "staging_key": F.when((i % 13 != 0) | (i % 2 == 0), F.concat(F.lit("s"), i)), "checksum": F.when((i % 13 != 0) | (i % 2 == 1), F.md5(i.cast("string")))})
    return catalog.bind_versions(versions, docs, uploads)


@query(f"""WITH {_UPLOADS}, n AS (SELECT d, count(*) AS n, max_by(v, u) AS last FROM g WHERE error_code IS NULL GROUP BY 1), f AS (SELECT d, min(u) AS first FROM u WHERE d % 10 <> 0 GROUP BY 1)
SELECT d AS document_id, 1 + coalesce(n, 0) AS versions, coalesce(last, first) AS current_version_id, CASE WHEN n > 0 AND d % 5 IN (0, 2) THEN 'active' ELSE (['draft', 'active', 'draft', 'archived', 'deleted'])[d % 5 + 1] END AS status FROM f LEFT JOIN n USING (d)""")
def version_binding(spark, sf_dir):
    """The documents afterwards, with the number of their versions, which must be that of the last."""
    bound, now, _ = _bound(spark, sf_dir)
    n = bound.groupBy("document_id").agg(F.count("*").alias("versions"), F.max("version_number").alias("last")).where(c("versions") == c("last"))
    return now.join(n, "document_id").select("document_id", "versions", "current_version_id", "status")


@query(f"""WITH {_UPLOADS} SELECT error_code, count(*) AS n FROM g WHERE error_code IS NOT NULL GROUP BY 1""")
def version_binding_errors(spark, sf_dir):
    """What was not bound."""
    return _bound(spark, sf_dir)[2].groupBy("error_code").agg(F.count("*").alias("n"))


@query(r"""WITH d AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents)
SELECT doc_id AS document_id, array_to_string(list_filter([CASE WHEN doc_id % 3 IN (0, 1) THEN 'invalid_language' END, CASE WHEN length(t) NOT BETWEEN 1 AND 500 THEN 'invalid_title' END, CASE WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 THEN 'invalid_tags' END, CASE WHEN doc_id % 13 = 0 THEN 'metadata_too_large' END], lambda x: x IS NOT NULL), ',') AS errors
FROM d WHERE doc_id % 3 IN (0, 1) OR length(t) NOT BETWEEN 1 AND 500 OR doc_id % 7 = 0 OR doc_id % 11 = 0 OR doc_id % 13 = 0""")
def metadata_errors(spark, sf_dir):
    """Whole texts as titles; codes in capitals or too long, blank tags or one too many, metadata that is too large only with its escapes."""
    i = c("doc_id")
    tags = F.when(i % 7 == 0, F.array("source", F.lit(" "))).when(i % 11 == 0, F.array_repeat("source", 51)).otherwise(F.array_repeat("source", 50))
    code = F.when(i % 3 == 0, F.upper("lang")).when(i % 3 == 1, "english").otherwise(F.concat("lang", F.lit("-Latn-IR")))
    note = F.when(i % 13 == 0, F.repeat(F.lit("é"), 2729)).otherwise(F.repeat(F.lit("é"), 2728))  # {"k":"…"}: 8 characters and 6 for each letter, against 16,384
    rows = table(spark, sf_dir, "documents").select(i.alias("document_id"), code.alias("declared_language"), c("text").alias("title"), tags.alias("tags"), F.create_map(F.lit("k"), F.concat(note, F.lit("abcdefgh"))).alias("metadata"))
    return catalog.metadata_errors(rows).select("document_id", F.array_join("errors", ",").alias("errors"))


# --- answers

@query(f"""WITH {_BM25}, g AS (SELECT b.item_id AS q, min(l.rank) AS gold FROM benchmark b LEFT JOIN (SELECT lex.*, d.text FROM lex JOIN documents d ON d.doc_id = lex.chunk_id WHERE rank <= 30) l ON l.query_id = b.item_id AND contains(l.text, b.text) GROUP BY 1)
SELECT count(*) AS n, round(avg(coalesce(1.0 / gold, 0)), 6) AS mrr, count(*) FILTER (q % 5 = 1 AND gold IS NOT NULL) AS wrong_retrieval, count(*) FILTER (q % 4 <> 0 AND q % 3 <> 0) AS passed, count(*) FILTER (q % 4 = 0) AS abstains, count(*) FILTER (q % 4 <> 0 AND q % 3 = 0) AS wrong_answers, count(*) FILTER (q % 4 = 0 AND gold IS NOT NULL) AS false_abstains FROM g""")
def gold_verdicts(spark, sf_dir):
    """Items as markers; answers that hold them in capitals and with other marks, that do not, and abstentions."""
    docs = table(spark, sf_dir, "documents").select(c("doc_id").alias("chunk_id"), "text")
    b, q = table(spark, sf_dir, "benchmark"), c("query_id")
    gold = b.select(c("item_id").alias("query_id"), c("text").alias("marker"))
    answers = gold.select("query_id", F.when(q % 3 == 0, "no").otherwise(F.concat(F.lit("so: "), F.regexp_replace("marker", "[ .,]", "-"))).alias("answer"), "marker", (q % 4 == 0).alias("abstained"))
    out = metrics.gold_summary(metrics.gold_ranks(lexical_hits(spark, sf_dir, 30).join(docs, "chunk_id"), gold), answers, gold.where(q % 5 == 1))
    return out.select("n", r6(c("mrr")).alias("mrr"), "wrong_retrieval", "passed", "abstains", "wrong_answers", "false_abstains")


_KEY = r"replace(lower(regexp_replace({0}, '[^\p{{L}}\p{{N}}]+', '', 'g')), 'ß', 'ss')"


@query(rf"""WITH x AS (SELECT item_id, list_transform(string_split(b.text, ' ')[1:4], lambda f: {_KEY.format('f')}) AS facts, {_KEY.format('d.text')} AS answer FROM benchmark b JOIN documents d ON d.doc_id = b.item_id),
y AS (SELECT item_id, round(len(list_filter(facts, lambda f: contains(answer, f))) / len(facts), 4) AS s FROM x)
SELECT item_id AS query_id, s AS completeness, CASE WHEN item_id % 5 = 0 OR s = 0 THEN 'fail' WHEN s = 1 THEN 'pass' ELSE 'partial' END AS verdict FROM y""")
def fact_completeness(spark, sf_dir):
    """An item's first words, in capitals, as facts, the document of its number as the answer; every fifth abstained."""
    facts = table(spark, sf_dir, "benchmark").select(c("item_id").alias("query_id"), F.slice(F.split(F.upper("text"), " "), 1, 4).alias("facts"))
    rows = facts.join(table(spark, sf_dir, "documents").select(c("doc_id").alias("query_id"), c("text").alias("answer")), "query_id")
    return metrics.completeness(rows.withColumn("abstained", c("query_id") % 5 == 0))


@query(rf"""WITH d AS (SELECT doc_id, text FROM documents WHERE NOT regexp_matches(text, '\[\d+\]|\d[.)]')),
a AS (SELECT doc_id, (['براساس اطلاعات موجود ', 'پرسش شما ', '', ''])[doc_id % 4 + 1] || CASE WHEN doc_id % 3 = 0 THEN text ELSE {_FA.format('text')} END || chr(10) || '1. ' || 'پاسخ نخست است [1]' || chr(10) || '2) no' || chr(10) || chr(10) || 'پایان پاسخ بدون نشان' AS a FROM d),
s AS (SELECT doc_id, a, split_part(a, chr(10) || '1. ', 1) AS head, doc_id % 4 IN (1) OR (doc_id % 4 <> 0 AND doc_id % 5 = 0) AS echo FROM a),
p AS (SELECT *, list_filter(regexp_split_to_array(head, '\n\s*\n'), lambda x: length(regexp_replace(x, '^\s+|\s+$', '', 'g')) >= 8) AS p FROM s)
SELECT doc_id AS query_id, doc_id % 2 = 0 AS markers_valid, round(1 / (len(p) + 2), 4) AS paragraph_coverage, echo, doc_id % 4 IN (0, 1) AS robotic,
 NOT echo AND doc_id % 6 <> 1 AND len(regexp_extract_all(a, '[\x{{0600}}-\x{{06FF}}]')) / len(regexp_extract_all(a, '[\p{{L}}]')) >= 0.55 AS fluent_script, true AS numbered_steps FROM p""")
def answer_style(spark, sf_dir):
    """Documents in Persian letters (some in their own), after three openings, before a numbered item that cites, one too short to count, and a paragraph that does not cite; some echo their question."""
    d = table(spark, sf_dir, "documents").where(~c("text").rlike(r"\[\d+\]|\d[.)]"))
    i = c("doc_id")
    opening = F.when(i % 4 == 0, "براساس اطلاعات موجود ").when(i % 4 == 1, "پرسش شما ").otherwise("")
    a = F.concat(opening, F.when(i % 3 == 0, c("text")).otherwise(fa("text")), F.lit("\n1. پاسخ نخست است [1]\n2) no\n\nپایان پاسخ بدون نشان"))
    own = F.concat(F.when(i % 3 == 0, F.upper("text")).otherwise(fa("text")), F.lit("\n1."))
    rows = d.select(i.alias("query_id"), a.alias("answer"), F.when((i % 5 == 0) & (i % 4 != 0), own).otherwise("x y z q").alias("query"), (i % 6 == 1).alias("abstained"), F.when(i % 2 == 0, F.array(F.lit("[1]"), F.lit("[2]"))).otherwise(F.array(F.lit("[2]"))).alias("markers"))
    return metrics.style(rows)


#: Documents as answers to the items of their number: a third are the item itself, a third its document, some are empty or lacking.
_SCORED = r"""x AS (SELECT b.item_id AS i, b.text || ' ۱۲ 7' AS gold, CASE WHEN b.item_id % 11 = 0 THEN NULL WHEN b.item_id % 13 = 0 THEN '' WHEN b.item_id % 3 = 0 THEN replace(b.text, 'e', 'E') || ' 12 ۷' WHEN b.item_id % 3 = 1 THEN d.text ELSE b.text || '  پاسخ 12' END AS said,
  b.item_id % 2 = 0 AS cited, (['responsibility', 'procedure', 'factual', 'multi_step', 'permission'])[b.item_id % 5 + 1] AS category FROM benchmark b JOIN documents d ON d.doc_id = b.item_id),
k AS (SELECT *, lower(trim(regexp_replace(translate(gold, '۰۱۲۳۴۵۶۷۸۹', '0123456789'), '\s+', ' ', 'g'))) AS g, lower(trim(regexp_replace(translate(said, '۰۱۲۳۴۵۶۷۸۹', '0123456789'), '\s+', ' ', 'g'))) AS s, coalesce(said, '') <> '' AS has FROM x),
j AS (SELECT *, CASE WHEN has THEN len(list_intersect(string_split(g, ' '), string_split(s, ' '))) / len(list_distinct(list_concat(string_split(g, ' '), string_split(s, ' ')))) ELSE 0 END AS lex,
  list_distinct(list_transform(regexp_extract_all(gold, '([۰-۹0-9][٬,]?)+'), lambda n: translate(n, '۰۱۲۳۴۵۶۷۸۹', '0123456789'))) AS gn, list_distinct(list_transform(regexp_extract_all(said, '([۰-۹0-9][٬,]?)+'), lambda n: translate(n, '۰۱۲۳۴۵۶۷۸۹', '0123456789'))) AS sn FROM k),
sc AS (SELECT i, category, cited, said, i % 4 = 0 AS abstained, CASE WHEN i % 2 = 0 THEN 'baseline' ELSE 'robustness' END AS cohort, has AND g = s AS exact_match, lex, has AND cited AS citation_accuracy, has AND cited AND lex >= 0.15 AS grounded, NOT has OR (lex < 0.05 AND NOT cited) AS risk,
  CASE WHEN has AND len(gn) > 0 THEN len(list_intersect(gn, sn)) / len(gn) END AS numeric_accuracy, CASE WHEN has AND category IN ('responsibility', 'permission') THEN lex END AS entity_match, CASE WHEN has AND category IN ('procedure', 'multi_step') THEN lex END AS procedure_match,
  CASE WHEN has AND len(regexp_extract_all(said, '[\p{L}\x{0600}-\x{06FF}]')) > 0 THEN len(regexp_extract_all(said, '[\x{0600}-\x{06FF}]')) / len(regexp_extract_all(said, '[\p{L}\x{0600}-\x{06FF}]')) * CASE WHEN contains(said, '  ') THEN 0.82 ELSE 1 END ELSE 0 END AS fluency FROM j)"""


def _scored(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(c("item_id").alias("question_id"), "text")
    d = table(spark, sf_dir, "documents").select(c("doc_id").alias("question_id"), c("text").alias("own"))
    i, name = c("question_id"), F.concat(F.lit("c"), "question_id")
    said = F.when(i % 11 == 0, None).when(i % 13 == 0, "").when(i % 3 == 0, F.concat(F.replace("text", F.lit("e"), F.lit("E")), F.lit(" 12 ۷"))).when(i % 3 == 1, c("own")).otherwise(F.concat("text", F.lit("  پاسخ 12")))
    kinds = F.array(*map(F.lit, ["responsibility", "procedure", "factual", "multi_step", "permission"]))
    rows = b.join(d, "question_id").select("question_id", F.concat("text", F.lit(" ۱۲ 7")).alias("gold"), said.alias("predicted"), name.alias("expected_chunk_id"), F.when(i % 2 == 0, F.array(F.lit("x"), name)).otherwise(F.array(F.lit("x"))).alias("cited_ids"),
                                           F.element_at(kinds, (i % 5 + 1).cast("int")).alias("category"), (i % 4 == 0).alias("abstained"), F.when(i % 2 == 0, "baseline").otherwise("robustness").alias("cohort"))
    return diagnostics.answer_scores(rows)


@query(f"""WITH {_SCORED} SELECT i AS question_id, exact_match, round(lex, 6) AS lexical_overlap, round(fluency, 6) AS fluency, round(entity_match, 6) AS entity_match, round(procedure_match, 6) AS procedure_match, grounded, risk, citation_accuracy, round(numeric_accuracy, 6) AS numeric_accuracy FROM sc""")
def answer_scores(spark, sf_dir):
    """G14"""
    s = _scored(spark, sf_dir)
    return s.select("question_id", "exact_match", *(r6(c(n)).alias(n) for n in ("lexical_overlap", "fluency", "entity_match", "procedure_match")), "grounded", "risk", "citation_accuracy", r6(c("numeric_accuracy")).alias("numeric_accuracy"))


@query(f"""WITH {_SCORED} SELECT cohort, count(*) AS n, round(avg(CASE WHEN exact_match THEN 1 ELSE 0 END), 6) AS exact_match_rate, round(avg(lex), 6) AS lexical_overlap_mean, round(avg(fluency), 6) AS fluency_mean, round(avg(entity_match), 6) AS entity_match_mean, round(avg(procedure_match), 6) AS procedure_match_mean,
 round(avg(CASE WHEN grounded THEN 1 ELSE 0 END), 6) AS groundedness_rate, round(avg(CASE WHEN citation_accuracy THEN 1 ELSE 0 END), 6) AS citation_accuracy_rate, round(avg(numeric_accuracy), 6) AS numeric_accuracy_mean, round(avg(CASE WHEN abstained THEN 1 ELSE 0 END), 6) AS abstention_rate FROM sc WHERE said IS NOT NULL GROUP BY 1""")
def cohort_means(spark, sf_dir):
    """G15"""
    out = diagnostics.answers_by_cohort(_scored(spark, sf_dir))
    return out.select("cohort", "n", *(r6(c(n)).alias(n) for n in out.columns[2:]))


@query(f"""WITH {_TOP}, {_KEPT}, g AS (SELECT query_id, count(*) AS o, count(*) FILTER (list_contains(kept, rank)) AS b, count(*) FILTER (NOT list_contains(kept, rank)) AS r, sum(CASE WHEN list_contains(kept, rank) THEN 0 ELSE length(trim(t)) END) AS rc, sum(CASE WHEN list_contains(kept, rank) THEN length(trim(t)) ELSE 0 END) AS cc FROM h JOIN ke USING (query_id) GROUP BY 1)
SELECT count(*) AS n, round(avg(o), 6) AS avg_original_chunks, round(avg(b), 6) AS avg_final_blocks, round(avg(r), 6) AS avg_duplicate_removals, round(avg(rc), 6) AS avg_duplicated_chars_removed, round(avg(cc), 6) AS avg_context_chars, round(avg(floor((cc + 3) / 4)), 6) AS avg_estimated_tokens,
 CAST(sum(r) AS BIGINT) AS total_duplicate_removals, CAST(sum(rc) AS BIGINT) AS total_duplicated_chars_removed FROM g""")
def context_averages(spark, sf_dir):
    """G17 over P06"""
    d = context.deduplicate(hits_for_evidence(spark, sf_dir))
    out = diagnostics.context_averages(context.statistics(d, context.blocks(d.where(~c("duplicate")))))
    return out.select("n", *(r6(c(n)).alias(n) for n in out.columns[1:7]), *out.columns[7:])


# --- sweeps and rates

_RUN = """w AS (SELECT question_id, CASE WHEN len(e) > 0 THEN e[1] END AS x, r, CASE WHEN CAST(question_id AS INT) % 17 = 0 THEN NULL ELSE value / 300 END AS top, len(list_intersect(r, e)) > 0 AS hit, abstained, CAST(question_id AS INT) % 3 <> 0 AS measured, CASE WHEN CAST(question_id AS INT) % 4 <> 0 THEN 'g' END AS gold, CAST(question_id AS INT) % 5 = 0 AS risk, event_type, user_id FROM o JOIN (SELECT event_id, event_type, user_id FROM events) ON CAST(event_id AS VARCHAR) = question_id)"""


def _results(spark, sf_dir):
    """Events as results of questions: the ids and flags of `outcomes`, a top score by value, and some without hits."""
    i = c("question_id").cast("int")
    return outcomes(spark, sf_dir).withColumns({
        "expected_id": F.try_element_at("expected_ids", F.lit(1)), "top_score": F.when(i % 17 != 0, c("e2e_ms") / 300), "hit": F.arrays_overlap("expected_ids", "retrieved_ids"), "measured": i % 3 != 0, "gold_answer": F.when(i % 4 != 0, "g"), "risk": i % 5 == 0})


@query(f"""WITH {_OUT}, {_RUN} SELECT count(*) FILTER (k) AS n, round(count(*) FILTER (k) / count(*), 6) AS rate, count(*) FILTER (k AND coalesce(top, 0) < 0.1) AS triggered FROM (SELECT *, measured AND x IS NOT NULL AND hit AND abstained AS k FROM w)""")
def false_abstains(spark, sf_dir):
    """G09"""
    return diagnostics.false_abstains(_results(spark, sf_dir), 0.1)[1].withColumn("rate", r6(c("rate")))


@query(f"""WITH {_OUT}, {_RUN}, t AS (SELECT unnest([0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3])::DOUBLE AS t), y AS (SELECT *, coalesce(top, 0) < t AS silent, CASE WHEN x IS NOT NULL THEN CASE WHEN list_contains(r, x) THEN 1 ELSE 0 END END AS h, CASE WHEN x IS NOT NULL THEN CASE WHEN list_contains(r, x) THEN 1 / list_position(r, x) ELSE 0 END END AS rr FROM w, t),
s AS (SELECT t, avg(h) AS hit, avg(rr) AS mrr, count(*) FILTER (silent AND x IS NOT NULL AND hit AND gold IS NOT NULL) AS fa, count(*) AS n, count(*) FILTER (NOT silent AND risk) AS ha, count(*) FILTER (NOT silent) AS an FROM y GROUP BY 1),
b AS (SELECT min_by(t, list_position([0.25, 0.2, 0.15, 0.3, 0.1, 0.05, 0.0], t) + CASE WHEN fa > 0 THEN 100 ELSE 0 END) AS best FROM s)
SELECT t AS min_evidence_score, round(hit, 6) AS hit_at_k, round(mrr, 6) AS mrr, fa AS false_abstain_count, round(fa / n, 6) AS false_abstain_rate, ha AS hallucination_count, round(coalesce(ha / nullif(an, 0), 0), 6) AS hallucination_rate, an AS answer_count, t = best AS recommended FROM s, b""")
def threshold_sweep(spark, sf_dir):
    """G10"""
    out = diagnostics.sweep_thresholds(_results(spark, sf_dir))
    return out.select("min_evidence_score", *(r6(c(n)).alias(n) for n in ("hit_at_k", "mrr", "false_abstain_rate", "hallucination_rate")), "false_abstain_count", "hallucination_count", "answer_count", "recommended")


@query(f"""WITH {_OUT}, k AS (SELECT unnest([1, 3, 5, 8, 10, 12]) AS k), f AS (SELECT CASE WHEN list_contains(r, e[1]) THEN list_position(r, e[1]) END AS p FROM o WHERE len(e) > 0),
s AS (SELECT k, count(*) AS n, avg(CASE WHEN p <= k THEN 1 ELSE 0 END) AS hit, avg(CASE WHEN p <= k THEN 1 / p ELSE 0 END) AS mrr FROM f, k GROUP BY 1)
SELECT k, n, round(hit, 6) AS hit_rate, round(mrr, 6) AS mrr, k = (SELECT min(k) FROM s WHERE hit = (SELECT max(hit) FROM s)) AS recommended FROM s""")
def k_sweep(spark, sf_dir):
    """G11"""
    out = diagnostics.sweep_k(outcomes(spark, sf_dir))
    return out.select("k", "n", r6(c("hit_rate")).alias("hit_rate"), r6(c("mrr")).alias("mrr"), "recommended")


@query("""SELECT CASE WHEN doc_id % 6 = 0 THEN 'unknown' ELSE source END AS document_id, count(*) FILTER (lang = 'en') AS baseline_n, round(avg(CASE WHEN lang = 'en' AND doc_id % 7 > 0 THEN CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END END), 6) AS baseline_hit, count(*) FILTER (lang <> 'en') AS robustness_n,
 round(avg(CASE WHEN lang <> 'en' AND doc_id % 7 > 0 THEN CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END END), 6) AS robustness_hit FROM documents WHERE doc_id % 4 > 0 GROUP BY 1""")
def per_document_rates(spark, sf_dir):
    """Sources as documents, English texts as the baseline; some are not measured, some have no document or no hit."""
    i = c("doc_id")
    rows = table(spark, sf_dir, "documents").select(F.when(i % 6 != 0, c("source")).alias("document_id"), F.when(c("lang") == "en", "baseline").otherwise("robustness").alias("cohort"), (i % 4 > 0).alias("measured"), F.when(i % 7 > 0, c("n_chars") > 1000).alias("hit"))
    out = diagnostics.per_document(rows)
    return out.select("document_id", "baseline_n", r6(c("baseline_hit")).alias("baseline_hit"), "robustness_n", r6(c("robustness_hit")).alias("robustness_hit"))


@query("""WITH r AS (SELECT event_type AS m, avg(CASE WHEN value > 20 THEN 1 ELSE 0 END) AS h, avg(value) AS v FROM events GROUP BY 1), t AS (SELECT m, h, v FROM r UNION ALL SELECT 'tied', h, v + 1 FROM r WHERE h = (SELECT max(h) FROM r)), b AS (SELECT max_by(m, (h, v, m)) AS best, max(h) AS best_rate, max(h) FILTER (m = 'view') AS cur FROM t)
SELECT best, round(best_rate, 6) AS best_rate, CASE WHEN cur IS NULL OR (best <> 'view' AND best_rate - cur >= 0.05) THEN best ELSE 'view' END AS recommended FROM b""")
def model_choice(spark, sf_dir):
    """Event types as embedding models, the best once more with a larger mrr."""
    rows = table(spark, sf_dir, "events").groupBy(c("event_type").alias("model")).agg(F.avg(F.coalesce(c("value") > 20, F.lit(False)).cast("double")).alias("hit_rate"), F.avg("value").alias("mrr"))
    most = rows.agg(F.max("hit_rate").alias("hit_rate"))
    tied = rows.join(F.broadcast(most), "hit_rate").select(F.lit("tied").alias("model"), "hit_rate", (c("mrr") + 1).alias("mrr"))
    return diagnostics.compare_models(rows.unionByName(tied), "view").select("best", r6(c("best_rate")).alias("best_rate"), "recommended")


@query("""SELECT doc_id AS question_id, CASE WHEN source = 'web' THEN CASE WHEN doc_id % 2 = 0 THEN 'policy_lookup' ELSE 'factual' END WHEN lang = 'en' THEN 'policy_lookup' ELSE 'factual' END AS category FROM documents""")
def question_categories(spark, sf_dir):
    """Q02: the first tag that has a category decides; tags in capitals have none."""
    tags = F.when(c("source") == "web", F.array(F.lit("TRAVEL"), F.when(c("doc_id") % 2 == 0, "leave").otherwise("handbook"), F.lit("remote"))).when(c("lang") == "en", F.array(F.lit("other"), F.lit("remote"), F.lit("abstain"))).otherwise(F.array("lang"))
    return questions.category(table(spark, sf_dir, "documents").select(c("doc_id").alias("question_id"), tags.alias("tags"))).select("question_id", "category")


@query()
def question_probes(spark, sf_dir):
    """Q03, Q04: questions of every document in Persian letters, each cut into chunks of a line."""
    d = table(spark, sf_dir, "documents").select(c("doc_id").alias("document_id"), F.posexplode(F.split(fa("text"), "\n")).alias("chunk_index", "text"))
    k = d.where(F.trim("text") != "").withColumn("chunk_id", F.concat_ws("-", "document_id", "chunk_index"))
    out = questions.ground_truth(k)
    return out.select("id", "document_id", "chunk_id", "ordinal", "category", "difficulty", F.md5("question").alias("question_md5"), F.md5("passage").alias("passage_md5"))


# --- chunks

#: Documents as chunks of a line (empty ones too) with the places of their characters; those of odd documents begin five characters earlier.
_LINES = r"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
p AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM l),
k AS (SELECT doc_id, i, text, pos - CASE WHEN doc_id % 2 = 1 AND i > 0 THEN 5 ELSE 0 END AS s, pos + length(text) AS e FROM p),
st AS (SELECT doc_id, i, length(text) AS chars, greatest(1, len(regexp_extract_all(text, '\S+'))) AS tokens, CASE WHEN length(trim(text)) = 0 THEN 0 ELSE len(list_filter(list_transform(string_split(regexp_replace(text, '([.!?؟。\n])\s+', '\1' || chr(30), 'g'), chr(30)), lambda x: trim(x)), lambda x: x <> '')) END AS sentences, 1 AS paragraphs,
 greatest(0, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY i) - s, 0)) AS overlap_previous, array_to_string(list_filter([CASE WHEN length(trim(text)) > 0 AND length(text) < 12 THEN 'fragmented_short_lines' END, CASE WHEN contains(text, '  ') THEN 'double_spaces' END,
 CASE WHEN (len(text) - len(replace(text, '|', ''))) >= 3 OR (len(text) - len(replace(text, chr(9), ''))) >= 3 THEN 'table_like' END, CASE WHEN regexp_matches(text, '(^|\n)\s*([0-9۰-۹]+[.)-]|[-•▪])\s+') THEN 'list_like' END, CASE WHEN length(text) < 80 THEN 'very_short' END, CASE WHEN length(text) > 2500 THEN 'very_long' END], lambda x: x IS NOT NULL), ',') AS flags,
 CASE WHEN i = 0 AND doc_id % 3 = 0 THEN doc_id % 4 ELSE 0 END AS retrieved FROM k)"""


def _line_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    ends = F.transform("l", lambda x, i: F.aggregate(F.slice("l", F.lit(1), i), F.lit(0), lambda s, y: s + F.length(y) + 1))
    rows = d.select("doc_id", F.posexplode(F.arrays_zip(c("l").alias("text"), ends.alias("at"))).alias("sequence_number", "x")).select("doc_id", "sequence_number", "x.text", c("x.at").alias("at"))
    chunks = rows.select("doc_id", "sequence_number", F.concat_ws("-", "doc_id", "sequence_number").alias("chunk_id"), "text", (c("at") - F.when((c("doc_id") % 2 == 1) & (c("sequence_number") > 0), 5).otherwise(0)).alias("start"), (c("at") + F.length("text")).alias("end"))
    hits = table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(F.concat_ws("-", "doc_id", F.lit(0)).alias("chunk_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("n"), "doc_id").where(c("n") < c("doc_id") % 4)
    return chunks, hits


@query(f"WITH {_LINES} SELECT doc_id, i AS sequence_number, chars, tokens, sentences, paragraphs, CAST(overlap_previous AS BIGINT) AS overlap_previous, flags, retrieved FROM st")
def chunk_statistics(spark, sf_dir):
    """G01"""
    out = diagnostics.chunk_stats(*_line_chunks(spark, sf_dir))
    return out.select("doc_id", "sequence_number", "chars", "tokens", "sentences", "paragraphs", "overlap_previous", F.array_join("flags", ",").alias("flags"), "retrieved")


@query(f"""WITH {_LINES} SELECT count(*) AS chunks, round(avg(chars), 6) AS avg_chunk_chars, round(avg(tokens), 6) AS avg_estimated_tokens, round(avg(sentences), 6) AS avg_sentence_count, round(avg(paragraphs), 6) AS avg_paragraph_count, round(avg(overlap_previous), 6) AS avg_overlap_size,
 count(*) FILTER (retrieved = 0) AS never_retrieved, count(DISTINCT doc_id) AS documents, round(count(*) / count(DISTINCT doc_id), 6) AS avg_chunks_per_document FROM st""")
def corpus_summary(spark, sf_dir):
    """G02"""
    out = diagnostics.corpus_summary(diagnostics.chunk_stats(*_line_chunks(spark, sf_dir)))
    return out.select(*(r6(c(n)).alias(n) if n.startswith("avg") else c(n) for n in out.columns))


@query(f"""WITH {_LINES}, b AS (SELECT 'size' AS of, CASE WHEN chars < 200 THEN 0 WHEN chars < 400 THEN 1 WHEN chars < 600 THEN 2 WHEN chars < 800 THEN 3 WHEN chars < 1000 THEN 4 WHEN chars < 1200 THEN 5 WHEN chars < 1500 THEN 6 ELSE 7 END AS bucket FROM st
UNION ALL SELECT 'overlap', CASE WHEN overlap_previous < 1 THEN 0 WHEN overlap_previous < 50 THEN 1 ELSE 9 END FROM st UNION ALL SELECT 'sentences', CASE WHEN sentences < 1 THEN 0 WHEN sentences < 2 THEN 1 WHEN sentences < 3 THEN 2 WHEN sentences < 5 THEN 3 WHEN sentences < 8 THEN 4 WHEN sentences < 13 THEN 5 ELSE 6 END FROM st)
SELECT of, bucket, count(*) AS n FROM b GROUP BY 1, 2""")
def chunk_histograms(spark, sf_dir):
    """G02"""
    stats = diagnostics.chunk_stats(*_line_chunks(spark, sf_dir))
    out = None
    for name, column, edges in (("size", "chars", diagnostics.SIZE_EDGES), ("overlap", "overlap_previous", diagnostics.OVERLAP_EDGES), ("sentences", "sentences", diagnostics.SENTENCE_EDGES)):
        one = diagnostics.histogram(stats, column, edges).withColumn("of", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT doc_id || '-0' AS chunk_id, doc_id % 4 AS n FROM documents WHERE doc_id % 3 = 0 AND doc_id % 4 > 0 ORDER BY 2 DESC, 1 LIMIT 10""")
def frequently_retrieved(spark, sf_dir):
    """A top-10 report."""
    return diagnostics.frequently_retrieved(_line_chunks(spark, sf_dir)[1])
