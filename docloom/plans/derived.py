"""More queries over the driver's tables, for operators whose inputs are derived from them; each with its SQL where SQL can say it.

The tables hold no Arabic script, so some queries first write Latin letters as Persian ones, letter by letter, in both languages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import constants as K
from docloom.functions import text as T
from docloom.operators import catalog, context, diagnostics, indexing, metrics, questions
from docloom.operators import retrieval as R
from docloom.plans.queries import _OUT, c, folders, outcomes, query, r6
from docloom.sources import files
from docloom.sources.shared import fresh_path, settle, table
from docloom.streaming import index_stream

LATIN, PERSIAN = "abcdefghijklmnopqrstuvwxyz", "ابپتثجچحخدذرزژسشصضطظعغفقکگ"
_FA = f"translate(lower({{0}}), '{LATIN}', '{PERSIAN}')"
_STRIP = "trim({0}, ' ' || chr(10) || chr(9) || chr(13))"
_ALL = r"list_transform(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_\x{{0600}}-\x{{06FF}}]+'), lambda x: replace(lower(x), 'ß', 'ss'))"


def fa(text: str):
    return F.translate(F.lower(text), LATIN, PERSIAN)


def quoted(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


# --- text

@query(rf"""SELECT doc_id, md5(regexp_replace(regexp_replace(replace({_FA.format('text')}, ',', ' ،'), '[ \t]+([،؛؟:.!])', '\1', 'g'), '([،؛])([^\s\d])', '\1 \2', 'g')) AS repaired_md5 FROM documents""")
def glyph_repair(spark, sf_dir):
    """Commas as right-to-left marks with a space on the wrong side."""
    x = F.replace(fa("text"), F.lit(","), F.lit(" ،"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.repair_glyphs(x)).alias("repaired_md5"))


@query(r"""SELECT doc_id, md5(list_reduce(list_prepend('', list_transform(string_split(text, chr(10)), lambda x: trim(x))), lambda a, x: CASE WHEN a = '' THEN x WHEN x = '' THEN a
 WHEN regexp_matches(a, '[.!?؟۔:]$') OR regexp_matches(x, '^([-•▪●○*]|[0-9۰-۹]{1,3}[.)])\s') THEN a || chr(10) || x ELSE a || ' ' || x END)) AS flowed_md5 FROM documents""")
def line_reflow(spark, sf_dir):
    """T09"""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.reflow("text")).alias("flowed_md5"))


@query(rf"""WITH w AS (SELECT doc_id, regexp_extract_all({_FA.format('text')}, '[\x{{0600}}-\x{{06FF}}\x{{200C}}]{{2,}}') AS w FROM documents)
SELECT doc_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i AND NOT list_contains({quoted(K.KEYWORD_STOPWORDS)}, x))[1:8], ' ') AS keywords FROM w""")
def keyword_lists(spark, sf_dir):
    """T15"""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.keywords(fa("text")), " ").alias("keywords"))


@query(rf"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, '.', '?'), chr(10)), lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS l FROM documents),
q AS (SELECT doc_id, flatten(list_transform(l, lambda x: CASE WHEN x LIKE '%?' THEN [x] ELSE list_filter(list_transform(regexp_extract_all(x, '[^?]*[?]'), lambda y: {_STRIP.format('y')}), lambda y: length(y) >= 8) END)) AS q FROM l),
f AS (SELECT doc_id, q, list_transform(q, lambda x: replace(lower(x), 'ß', 'ss')) AS f FROM q)
SELECT doc_id, len(list_filter(q, lambda x, i: list_position(f, f[i]) = i)) AS questions, md5(array_to_string(list_filter(q, lambda x, i: list_position(f, f[i]) = i), '|')) AS questions_md5 FROM f""")
def question_lines(spark, sf_dir):
    """Full stops as question marks."""
    q = table(spark, sf_dir, "documents").select("doc_id", T.question_lines(F.replace("text", F.lit("."), F.lit("?"))).alias("q"))
    return q.select("doc_id", F.size("q").alias("questions"), F.md5(F.array_join("q", "|")).alias("questions_md5"))


@query(f"""WITH t AS (SELECT item_id, {_ALL.format('text')} AS t FROM benchmark),
p AS (SELECT item_id, list_concat(CASE WHEN len(t) >= 3 THEN [array_to_string(t[1:3], ' '), array_to_string(t[len(t) - 2:], ' ')] ELSE [] END, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS p FROM t)
SELECT item_id, array_to_string(list_transform(list_sort(list_transform(p, lambda x, i: {{'n': -length(x), 'i': i, 'p': x}})), lambda s: s.p), '|') AS phrases FROM p""")
def phrase_candidates(spark, sf_dir):
    """T21"""
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.phrases("text"), "|").alias("phrases"))


@query(rf"""SELECT doc_id, md5(array_to_string(list_sort(list_distinct(list_filter({_ALL.format('text')}, lambda x: (regexp_matches(x, '^[a-z0-9][a-z0-9._-]{{2,}}$') OR contains(x, 'http')) AND NOT list_contains({quoted(K.EVIDENCE_STOPWORDS)}, x)))), ' ')) AS entities_md5 FROM documents""")
def entity_tokens(spark, sf_dir):
    """T23"""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(F.array_sort(T.entities("text")), " ")).alias("entities_md5"))


@query(r"""SELECT item_id, regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '[\s\x{200C}]+', '', 'g') AS key, regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '[^\p{L}\p{N}_]+', '', 'g') AS word_key FROM benchmark""")
def marker_keys(spark, sf_dir):
    """T24"""
    return table(spark, sf_dir, "benchmark").select("item_id", T.marker_key("text").alias("key"), T.marker_key("text", words_only=True).alias("word_key"))


@query(rf"""WITH n AS (SELECT doc_id, regexp_extract_all(text, '(?:[۰-۹٠-٩0-9][٬,]?)+') AS a, regexp_extract_all(replace(text, '1', '2'), '(?:[۰-۹٠-٩0-9][٬,]?)+') AS b, text FROM documents)
SELECT doc_id, len(list_filter(range(1, len(a) + 1), lambda i: a[i] <> b[i])) AS number_mismatches, len(regexp_extract_all(text, '\|')) AS bars FROM n""")
def extraction_quality(spark, sf_dir):
    """T10 against a reference (the text with its ones read as twos), with table bars as artifacts that letters do not touch."""
    q = T.quality("text", F.replace("text", F.lit("1"), F.lit("2")), [r"\|"])
    rows = table(spark, sf_dir, "documents").withColumn("text", F.regexp_replace("text", r"\|", " | "))
    own = table(spark, sf_dir, "documents").select("doc_id", q["number_mismatches"].alias("number_mismatches"))
    return own.join(rows.select("doc_id", q["artifacts"].alias("bars")), "doc_id")


@query(r"""WITH f AS (SELECT page_id, lower(regexp_extract(url || CASE page_id % 4 WHEN 0 THEN '.TXT' WHEN 1 THEN '.md' WHEN 2 THEN '.pdf' ELSE '.exe' END, '\.([^./]+)$', 1)) AS suffix, html FROM pages)
SELECT suffix, CASE WHEN suffix IN ('txt', 'md') AND html IS NOT NULL THEN 'accepted' ELSE 'unsupported_format' END AS outcome, count(*) AS n FROM f GROUP BY 1, 2""")
def file_routing(spark, sf_dir):
    """Pages as files of four suffixes; what has no reader is a reject."""
    suffix = F.lower(F.get(F.array(*(F.lit(x) for x in ("TXT", "md", "pdf", "exe"))), (c("page_id") % 4).cast("int")))
    parsers = F.create_map(*(F.lit(x) for p in files.PARSERS.items() for x in p))
    rows = table(spark, sf_dir, "pages").select(c("url").alias("path"), suffix.alias("suffix"), F.try_element_at(parsers, suffix).alias("parser"), files.decoded(F.encode("html", "UTF-8")).alias("text"))
    good, bad = files.accepted(rows)
    return good.select("suffix", F.lit("accepted").alias("outcome")).unionByName(bad.select("suffix", c("error_code").alias("outcome"))).groupBy("suffix", "outcome").agg(F.count("*").alias("n"))


def _dataset(spark, sf_dir) -> DataFrame:
    """Conversations' first user turns as questions of a dataset, some of them flawed."""
    t = table(spark, sf_dir, "conversations").where("role = 'user'")
    return t.select(F.when(c("turn") > 2, F.concat(F.lit("q"), c("conv_id"))).otherwise(F.concat_ws("-", F.lit("q"), "conv_id", "turn")).alias("id"), F.when(c("turn") % 5 == 3, "").otherwise(c("text")).alias("question"), F.when(c("conv_id") % 3 > 0, "an answer").alias("expected_answer"),
                    F.array().cast("array<struct<chunk_id:string,document_id:string,document_version_id:string,rank_hint:int>>").alias("expected_citations"), F.when(c("conv_id") % 4 > 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("tags"), (c("conv_id") % 6 == 0).alias("expect_abstention"), F.lit("kb").alias("knowledge_base_id"))


@query("""WITH q AS (SELECT CASE WHEN turn > 2 THEN 'q' || conv_id ELSE 'q-' || conv_id || '-' || turn END AS id, CASE WHEN turn % 5 = 3 THEN '' ELSE text END AS question, conv_id FROM conversations WHERE role = 'user'),
e AS (SELECT id, 'duplicate_id' AS error_code FROM q GROUP BY id HAVING count(*) > 1 UNION ALL SELECT id, 'blank_question' FROM q WHERE trim(question) = '' UNION ALL SELECT id, 'empty_tags' FROM q WHERE conv_id % 4 = 0 UNION ALL SELECT id, 'answer_or_citations_required' FROM q WHERE conv_id % 3 = 0 AND conv_id % 6 <> 0)
SELECT error_code, count(*) AS n FROM e GROUP BY 1""")
def dataset_errors(spark, sf_dir):
    """S05"""
    return files.question_errors(_dataset(spark, sf_dir)).groupBy("error_code").agg(F.count("*").alias("n"))


# --- corpus and index

def _live(spark, sf_dir):
    """Order lines as chunks of parts, with the parts as documents and versions."""
    lines = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("chunk_id"), c("l_partkey").alias("document_id"), c("l_partkey").alias("document_version_id"), c("l_linenumber").alias("chunk_index"), F.lit(None).cast("string").alias("heading"),
                                                    c("l_returnflag").alias("language"), c("l_returnflag").alias("text"), F.when(c("l_linestatus") == "F", "indexed").otherwise("chunked").alias("status"))
    index = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("chunk_id"), F.when(c("l_orderkey") % 3 == 0, "stale").otherwise("indexed").alias("index_status")).distinct()
    p = table(spark, sf_dir, "part")
    docs = p.select(c("p_partkey").alias("document_id"), c("p_name").alias("title"), F.when(c("p_size") > 40, "archived").otherwise("active").alias("status"), F.when(c("p_size") < 3, F.lit("2024-01-01")).cast("timestamp").alias("deleted_at"))
    versions = p.select(c("p_partkey").alias("document_version_id"), F.when(c("p_size") % 2 == 0, "indexed").otherwise("failed").alias("processing_status"))
    return index, lines, docs, versions


@query("""SELECT l_partkey AS document_id, count(*) AS chunks, min(l_linenumber) AS first_index FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE l_linestatus = 'F' AND l_orderkey % 3 <> 0 AND p_size <= 40 AND p_size >= 3 AND p_size % 2 = 0 AND l_returnflag = 'A' AND p_partkey % 3 = 0 GROUP BY 1""")
def scoped_corpus(spark, sf_dir):
    """The live corpus of some documents and one language (return flags as languages)."""
    wanted = table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(c("p_partkey").alias("document_id"))
    rows = R.lexical_corpus(R.live_corpus(*_live(spark, sf_dir), document_ids=wanted, language="A"))
    return rows.groupBy("document_id").agg(F.count("*").alias("chunks"), F.min("chunk_index").alias("first_index"))


@query("""SELECT p_name AS title, count(*) AS chunks FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size >= 3 GROUP BY 1""")
def chunk_snapshot(spark, sf_dir):
    """J06"""
    _, chunks, docs, _ = _live(spark, sf_dir)
    return R.chunk_snapshot(chunks, docs).groupBy("title").agg(F.count("*").alias("chunks"))


@query("""SELECT vec_id AS chunk_id, 64 - label % 3 AS dimensions, 'dimension_mismatch' AS error_code FROM embeddings WHERE label % 3 > 0""")
def dimension_errors(spark, sf_dir):
    """Vectors that lost components."""
    rows = table(spark, sf_dir, "embeddings").select(c("vec_id").alias("chunk_id"), F.slice("embedding", F.lit(1), 64 - c("label") % 3).alias("vector"))
    return indexing.wrong_dimensions(rows, 64)


@query("""WITH keep AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY 1), v AS (SELECT o_orderkey, o_custkey, CASE o_orderstatus WHEN 'F' THEN 'indexed' WHEN 'O' THEN 'chunked' ELSE 'failed' END AS s, o_orderkey <> k AND o_orderstatus IN ('F', 'O') AS gone FROM orders JOIN keep USING (o_custkey)),
l AS (SELECT gone, l_linestatus FROM lineitem JOIN v ON o_orderkey = l_orderkey)
SELECT 'versions' AS entity, CASE WHEN gone THEN 'superseded' ELSE s END AS status, count(*) AS n FROM v GROUP BY 1, 2 UNION ALL SELECT 'chunks', CASE WHEN gone THEN 'superseded' ELSE 'indexed' END, count(*) FROM l GROUP BY 1, 2
UNION ALL SELECT 'embeddings', CASE WHEN gone OR l_linestatus = 'O' THEN 'stale' ELSE 'indexed' END, count(*) FROM l GROUP BY 1, 2""")
def index_supersede(spark, sf_dir):
    """The orders of a customer as versions of a document, the last of them current."""
    o = table(spark, sf_dir, "orders")
    versions = o.select(c("o_custkey").alias("document_id"), c("o_orderkey").alias("document_version_id"), F.when(c("o_orderstatus") == "F", "indexed").when(c("o_orderstatus") == "O", "chunked").otherwise("failed").alias("processing_status"))
    lines = table(spark, sf_dir, "lineitem")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber").alias("chunk_id")
    chunks = lines.select(c("l_orderkey").alias("document_version_id"), key, F.lit("indexed").alias("status"))
    index = lines.select(key, F.when(c("l_linestatus") == "O", "stale").otherwise("indexed").alias("index_status"))
    v, k, i = indexing.supersede(versions, chunks, index, versions.groupBy("document_id").agg(F.max("document_version_id").alias("document_version_id")))
    count = lambda rows, name, status: rows.groupBy(F.lit(name).alias("entity"), c(status).alias("status")).agg(F.count("*").alias("n"))
    return count(v, "versions", "processing_status").unionByName(count(k, "chunks", "status")).unionByName(count(i, "embeddings", "index_status"))


@query("""SELECT label AS document_version_id, count(*) AS remaining, 'partial_embedding_failure' AS failure_reason FROM embeddings WHERE vec_id % 4 = 0 GROUP BY 1""")
def index_incomplete(spark, sf_dir):
    """One vector of four was not embedded; labels as versions."""
    e = table(spark, sf_dir, "embeddings").select(c("vec_id").alias("chunk_id"), c("label").alias("document_version_id"), F.lit("h").alias("content_hash"), F.lit("m").alias("embedding_model_id"), F.lit("indexed").alias("index_status"))
    return indexing.incomplete(e, e.where("chunk_id % 4 <> 0"), "m")


@query("""SELECT unnest(['as it was', 'a second model', 'other vectors', 'other dimensions']) AS index, unnest(['m', 'm,n', 'm', 'm']) AS models, unnest(['16', '16', '16', '8,16']) AS dimensions, unnest([1.0, 1.0, 0.0, 0.0]::DOUBLE[]) AS least_cosine, unnest([false, true, true, true]) AS reindex_required FROM (SELECT count(*) AS n FROM documents) WHERE n > 0""")
def index_alignment(spark, sf_dir):
    """X11: an index of hash vectors, a sample of it embedded again: sound, and with each fault that asks for a new index."""
    docs = table(spark, sf_dir, "documents").select(c("doc_id").cast("string").alias("chunk_id"), "text")
    make, turned = lambda: indexing.hash_embedder(16), F.transform("vector", lambda x: -x)
    made = settle(indexing.embed(docs, make).select("chunk_id", "vector", F.lit("m").alias("embedding_model_id"), F.lit("indexed").alias("index_status")), "index")
    other = F.when(F.xxhash64("chunk_id") % 2 == 0, "n").otherwise("m")
    out = None
    for name, index in (("as it was", made), ("a second model", made.withColumn("embedding_model_id", other)), ("other vectors", made.withColumn("vector", turned)), ("other dimensions", made.withColumn("vector", F.when(F.xxhash64("chunk_id") % 2 == 0, F.slice("vector", 1, 8)).otherwise(c("vector"))))):
        one = indexing.alignment(index, docs, make, 16).withColumn("index", F.lit(name))
        out = one if out is None else out.unionByName(one)
    sizes = F.array_join(F.transform(F.array_sort("dimensions"), lambda d: d.cast("string")), ",")
    return out.select("index", F.array_join("models", ",").alias("models"), sizes.alias("dimensions"), r6(c("least_cosine")).alias("least_cosine"), "reindex_required")


@query(rf"""WITH d AS (SELECT doc_id, {_STRIP.format('text')} = '' AS blank FROM documents)
SELECT CASE WHEN blank THEN 'failed' ELSE 'indexed' END AS processing_status, CASE WHEN blank THEN 'empty_content' END AS failure_reason, count(*) AS n FROM d GROUP BY 1, 2""")
def process_and_index(spark, sf_dir):
    """All documents extracted, chunked and embedded as one job."""
    v = table(spark, sf_dir, "documents").select("doc_id", c("doc_id").cast("string").alias("document_id"), c("doc_id").cast("string").alias("document_version_id"), "text")
    _, outcome = index_stream.process(v, lambda: indexing.hash_embedder(8), "m", 8)
    return outcome.groupBy("processing_status", "failure_reason").agg(F.count("*").alias("n"))


_AGAIN = """d AS (SELECT doc_id, trim(text, ' ' || chr(10) || chr(9) || chr(13)) = '' OR text IS NULL AS blank FROM documents)"""


def _versions(spark, sf_dir, second: bool = False):
    """Documents as versions; the second ones of even documents hold other words at the end."""
    d, i = table(spark, sf_dir, "documents"), c("doc_id")
    name = i.cast("string")
    text = F.when(F.lit(second) & (i % 2 == 0) & (T.strip("text") != ""), F.concat("text", F.lit("\n\nSecond version of "), name, F.lit("."))).otherwise(c("text"))
    return d.select("doc_id", name.alias("document_id"), F.concat(F.lit("w" if second else "v"), name).alias("document_version_id"), text.alias("text"))


@query(f"""WITH {_AGAIN} SELECT CAST(doc_id AS VARCHAR) AS document_id, CASE WHEN blank THEN 'failed' ELSE 'indexed' END AS processing_status, NOT blank AND doc_id % 2 = 0 AS embeds FROM d""")
def index_skip(spark, sf_dir):
    """Second versions against the vectors of the first: only documents whose words changed are embedded."""
    make = lambda: indexing.hash_embedder(8)
    rows, _ = index_stream.process(_versions(spark, sf_dir), make, "m", 8)
    _, again = index_stream.process(_versions(spark, sf_dir, True), make, "m", 8, rows.select("content_hash", "embedding_model_id", "vector"))
    return again.select("document_id", "processing_status", (c("created") > 0).alias("embeds"))


@query(f"""WITH {_AGAIN} SELECT 'v' || doc_id AS document_version_id, CASE WHEN blank THEN 'failed' ELSE 'indexed' END AS processing_status, CASE WHEN blank THEN 'empty_content' END AS failure_reason, NULL AS embeds FROM d
UNION ALL SELECT 'w' || doc_id, CASE WHEN blank THEN 'failed' ELSE 'indexed' END, CASE WHEN blank THEN 'empty_content' END, NOT blank AND doc_id % 2 = 0 FROM d""")
def index_stream_versions(spark, sf_dir):
    """All documents through the stream, then their second versions through the stream started anew."""
    at = fresh_path(spark, "stream")
    for second in (False, True):
        _versions(spark, sf_dir, second).write.mode("append").parquet(f"{at}/in")
        index_stream.run_stream(spark, f"{at}/in", f"{at}/index", f"{at}/checkpoint", lambda: indexing.hash_embedder(8), "m", 8)
    done = spark.read.parquet(f"{at}/index/versions")
    return done.select("document_version_id", "processing_status", "failure_reason", F.when(F.startswith("document_version_id", F.lit("w")), c("created") > 0).alias("embeds"))


@query("""WITH d AS (SELECT doc_id, replace(text, ' ', '_') AS t, length(text) AS n FROM documents WHERE length(text) >= 40)
SELECT doc_id, 1 AS blocks, md5(t[1:n // 4] || '<1>' || t[n // 4 + 1:n // 2] || '<2>' || t[n // 2 + 1:n]) AS text_md5 FROM d""")
def context_neighbours(spark, sf_dir):
    """Documents cut into three chunks that share some text, from a mark on, with the next, put together again."""
    d = table(spark, sf_dir, "documents").where(F.length("text") >= 40).withColumn("t", F.replace("text", F.lit(" "), F.lit("_")))
    n, at = F.length("t"), lambda k: F.floor(F.length("t") / k).cast("int")
    part = lambda a, b: F.substr("t", a + 1, b - a)
    cut = lambda i, *x: F.struct(F.lit(i).alias("chunk_index"), F.concat(*x).alias("text"))
    one, two = F.concat(F.lit("<1>"), part(at(4), at(3))), F.concat(F.lit("<2>"), part(at(2), F.floor(n * 2 / 3).cast("int")))
    parts = d.select(c("doc_id").alias("query_id"), F.inline(F.array(cut(0, part(F.lit(0), at(4)), one), cut(1, one, part(at(3), at(2)), two), cut(2, two, part(F.floor(n * 2 / 3).cast("int"), n)))))
    rows = parts.select("query_id", "chunk_index", "text", F.concat_ws("-", "query_id", "chunk_index").alias("chunk_id"), c("query_id").alias("document_id"), c("query_id").alias("document_version_id"), F.lit("").alias("heading"), F.lit(0.5).alias("score"))
    made = context.blocks(rows)
    return made.groupBy(c("query_id").alias("doc_id")).agg(F.count("*").alias("blocks"), F.md5(F.max("text")).alias("text_md5"))


@query("""SELECT p_size AS k, max(greatest(p_size, least(50, greatest(2 * p_size, p_size + 8)))) AS pool FROM part GROUP BY 1""")
def pool_sizes(spark, sf_dir):
    """R09"""
    return table(spark, sf_dir, "part").groupBy(c("p_size").alias("k")).agg(F.max(R.pool_size(c("p_size"))).alias("pool"))


# --- history and catalogue

@query("""SELECT conv_id AS conversation_id, count(*) AS n, md5(string_agg(role || ':' || text, '|' ORDER BY turn)) AS turns_md5 FROM conversations WHERE conv_id % 3 <> 0 GROUP BY 1""")
def history_transcript(spark, sf_dir):
    """Two conversations of three are active."""
    m = table(spark, sf_dir, "conversations").select(c("conv_id").alias("conversation_id"), c("turn").alias("seq"), "role", c("text").alias("content"))
    talks = m.select("conversation_id").distinct().withColumn("status", F.when(c("conversation_id") % 3 == 0, "archived").otherwise("active"))
    rows = context.transcript(m, talks).groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("seq", "role", "content"))).alias("t"))
    return rows.select("conversation_id", F.size("t").alias("n"), F.md5(F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|")).alias("turns_md5"))


@query("""SELECT 'r' || r_regionkey AS folder_id, '/' || r_name AS path, 0 AS depth FROM region UNION ALL
SELECT 'n' || n_nationkey, CASE WHEN n_nationkey % 2 = 0 AND n_regionkey <> 1 THEN (SELECT '/' || r_name FROM region WHERE r_regionkey = 1) ELSE '/' || r_name END || '/' || n_name, 1 FROM nation JOIN region ON r_regionkey = n_regionkey""")
def folder_moves(spark, sf_dir):
    """Every second nation moves to the second region."""
    f = folders(spark, sf_dir)
    moves = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0 and n_regionkey <> 1").select(F.concat(F.lit("n"), "n_nationkey").alias("folder_id"), F.lit("r1").alias("target_id"))
    return catalog.move_folders(f, moves)[0].select("folder_id", "path", "depth")


@query("""SELECT 'bases' AS entity, CASE WHEN r_regionkey IN (0, 2) THEN 'archived' ELSE 'active' END AS status, count(*) AS n FROM region GROUP BY 1, 2 UNION ALL
SELECT 'folders', CASE WHEN n_regionkey IN (0, 2) THEN 'archived' ELSE 'active' END, count(*) FROM nation GROUP BY 1, 2 UNION ALL
SELECT 'documents', CASE WHEN c_mktsegment = 'BUILDING' THEN 'draft' WHEN n_regionkey IN (0, 2) THEN 'archived' ELSE 'active' END, count(*) FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2""")
def catalogue_archive(spark, sf_dir):
    """Regions as knowledge bases, nations as folders, customers as documents, those of one segment drafts."""
    bases = table(spark, sf_dir, "region").select(c("r_regionkey").alias("knowledge_base_id"), F.lit("active").alias("status"))
    f = table(spark, sf_dir, "nation").select(c("n_regionkey").alias("knowledge_base_id"), F.lit("active").alias("status"))
    d = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), c("c_nationkey") == c("n_nationkey")).select(c("n_regionkey").alias("knowledge_base_id"), F.when(c("c_mktsegment") == "BUILDING", "draft").otherwise("active").alias("status"))
    out = catalog.archive(bases, f, d, bases.where("knowledge_base_id in (0, 2)"))
    count = lambda rows, name: rows.groupBy(F.lit(name).alias("entity"), "status").agg(F.count("*").alias("n"))
    return count(out[0], "bases").unionByName(count(out[1], "folders")).unionByName(count(out[2], "documents"))


@query("""WITH gone AS (SELECT o_orderkey, o_custkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 3 OR c_nationkey = 5 OR o_orderkey % 50 = 7)
SELECT 'documents' AS entity, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM gone) UNION ALL SELECT 'chunks', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM gone)
UNION ALL SELECT 'folders', count(*) FROM customer WHERE c_nationkey <> 3 AND c_nationkey <> 5 UNION ALL SELECT 'knowledge_bases', count(*) FROM nation WHERE n_nationkey <> 3
UNION ALL SELECT 'conversations', count(*) FROM conversations WHERE conv_id % 25 <> 3 AND turn = 0 UNION ALL SELECT 'messages', count(*) FROM conversations WHERE conv_id % 25 <> 3""")
def catalogue_delete_targets(spark, sf_dir):
    """A knowledge base (a nation), a folder subtree (another nation's customers) and single documents (orders) are deleted with all below."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(c("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    docs = o.select(c("o_orderkey").cast("string").alias("document_id"), c("c_nationkey").cast("string").alias("knowledge_base_id"), F.concat(F.lit("c"), "o_custkey").alias("folder_id"), F.lit(False).alias("legal_hold"))
    tree = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("folder_id"), F.concat(F.lit("/"), "c_nationkey", F.lit("/"), "c_custkey").alias("path"), c("c_nationkey").cast("string").alias("knowledge_base_id"))
    top = table(spark, sf_dir, "nation").where("n_nationkey = 5").select(F.concat(F.lit("n"), "n_nationkey").alias("folder_id"), F.concat(F.lit("/"), "n_nationkey").alias("path"), c("n_nationkey").cast("string").alias("knowledge_base_id"))
    tree = tree.unionByName(top)
    bases = table(spark, sf_dir, "nation").select(c("n_nationkey").cast("string").alias("knowledge_base_id"))
    versions = o.select(c("o_orderkey").cast("string").alias("document_id"), c("o_orderkey").alias("document_version_id"), c("o_orderkey").alias("upload_session_id"))
    chunks = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("document_version_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("chunk_id"))
    m = table(spark, sf_dir, "conversations").select(c("conv_id").alias("conversation_id"), "turn")
    talks = m.where("turn = 0").select("conversation_id", (c("conversation_id") % 25).cast("string").alias("knowledge_base_id"))
    single = o.where("o_orderkey % 50 = 7").select(c("o_orderkey").cast("string").alias("id"), F.lit("document").alias("kind"))
    targets = bases.where("knowledge_base_id = '3'").select(c("knowledge_base_id").alias("id"), F.lit("knowledge_base").alias("kind")).unionByName(top.select(c("folder_id").alias("id"), F.lit("folder").alias("kind"))).unionByName(single).withColumn("target_id", F.concat_ws(":", "kind", "id"))
    ids, _ = catalog.deletable(docs, catalog.delete_targets(docs, tree, targets))
    left = catalog.delete_cascade({"documents": docs, "versions": versions, "chunks": chunks, "folders": tree, "knowledge_bases": bases, "conversations": talks, "messages": m}, ids, targets)
    return catalog.inventory(**{k: v for k, v in left.items() if k != "versions"})


@query("""SELECT count(*) AS keys FROM (SELECT 'o' || o_orderkey AS k FROM orders WHERE o_orderstatus = 'P' UNION SELECT 'x' || o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 2 = 0 UNION SELECT 's' || o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def orphaned_keys(spark, sf_dir):
    """B11"""
    o = table(spark, sf_dir, "orders")
    v = o.select(c("o_orderkey").alias("document_id"), F.concat(F.lit("o"), "o_orderkey").alias("original_key"), F.when(c("o_orderkey") % 2 == 0, F.concat(F.lit("x"), "o_orderkey")).alias("extracted_key"), c("o_custkey").alias("upload_session_id"))
    uploads = table(spark, sf_dir, "customer").select(c("c_custkey").alias("upload_session_id"), F.concat(F.lit("s"), "c_custkey").alias("staging_key"))
    return catalog.orphaned_keys(v, uploads, o.where("o_orderstatus = 'P'").select(c("o_orderkey").alias("document_id"))).agg(F.count("*").alias("keys"))


@query("""SELECT CASE WHEN n_nationkey IS NULL THEN 'folder_not_found' ELSE 'folder_not_active' END AS error_code, count(*) AS n FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey < 20 WHERE n_nationkey IS NULL OR n_regionkey = 2 GROUP BY 1""")
def placement_errors(spark, sf_dir):
    """Nations up to 19 as folders, those of one region archived; customers move to their nation."""
    f = table(spark, sf_dir, "nation").where("n_nationkey < 20").select(c("n_nationkey").alias("folder_id"), F.when(c("n_regionkey") == 2, "archived").otherwise("active").alias("status"))
    moves = table(spark, sf_dir, "customer").select(c("c_custkey").alias("document_id"), c("c_nationkey").alias("folder_id"))
    return catalog.placement_errors(moves, f).groupBy("error_code").agg(F.count("*").alias("n"))


# --- evaluation

@query(f"""WITH {_OUT} SELECT status, count(*) AS n, CAST(sum(len(r)) AS BIGINT) AS retrieved, count(*) FILTER (g = 'abstained' AND status = 'ok') AS abstained FROM (SELECT * REPLACE (CASE WHEN event_type_error THEN 'error' ELSE 'ok' END AS status) FROM (SELECT *, status = 'error' AS event_type_error FROM o)) GROUP BY 1""")
def experiment_run(spark, sf_dir):
    """Questions with what was retrieved and answered; events of one kind have no answer and become error rows."""
    o = outcomes(spark, sf_dir)
    hits = o.select(c("question_id").alias("query_id"), F.posexplode("retrieved_ids").alias("rank", "chunk_id"))
    answers = o.where("status = 'ok'").select(c("question_id").alias("query_id"), c("generation_status").alias("status"), "cited_ids")
    q = o.select("question_id", "expected_ids", "expect_abstention")
    return metrics.experiment(q, hits, answers).groupBy("status").agg(F.count("*").alias("n"), F.sum(F.size("retrieved_ids")).alias("retrieved"), F.count_if("abstained").alias("abstained"))




@query("""WITH r AS (SELECT user_id AS id, min(ts) AS t, round(avg(value), 6) AS v FROM events GROUP BY 1) SELECT CAST(id AS VARCHAR) AS experiment_id, v AS mrr, row_number() OVER (ORDER BY t, CAST(id AS VARCHAR)) AS position FROM r""")
def run_trend(spark, sf_dir):
    """Users as runs, by the time of their first event."""
    runs = table(spark, sf_dir, "events").groupBy(c("user_id").cast("string").alias("experiment_id")).agg(F.min("ts").alias("created_at"), r6(F.avg("value")).alias("mrr"))
    return metrics.trend(runs, "mrr").select("experiment_id", "mrr", "position")


# --- diagnostics

@query("""SELECT event_type AS kind, count(*) AS n, round(avg(CASE WHEN value > 20 THEN 1 ELSE 0 END), 6) AS rate FROM events GROUP BY 1""")
def rates_by_kind(spark, sf_dir):
    """G06"""
    rows = table(spark, sf_dir, "events").select(c("event_type").alias("kind"), F.coalesce(c("value") > 20, F.lit(False)).alias("hit"))
    return diagnostics.rate_by(rows, "kind").withColumn("rate", r6(c("rate")))


@query(f"""WITH {_OUT}, x AS (SELECT CASE WHEN len(e) = 0 THEN 0 WHEN r[1] = e[1] THEN 1 WHEN r[2] = e[1] THEN 2 WHEN r[3] = e[1] THEN 3 ELSE 0 END AS rank FROM o) SELECT rank, count(*) AS n FROM x GROUP BY 1""")
def gold_rank_histogram(spark, sf_dir):
    """G08"""
    at = F.array_position("retrieved_ids", F.get("expected_ids", F.lit(0))).cast("int")
    return diagnostics.rank_histogram(outcomes(spark, sf_dir).select(F.when(at > 0, at).alias("gold_rank")))


_KINDS = "[NULL, 'paraphrase', 'spelling', 'halfspace', 'synonym']"


@query(rf"""WITH m AS (SELECT item_id, text AS q, ({_KINDS})[CAST(item_id % 5 AS INTEGER) + 1] AS k FROM benchmark), t AS (SELECT m.*, {_ALL.format('q')} AS qt, {_ALL.format('d.text')} AS tt, {_ALL.format("CASE WHEN item_id % 2 = 0 THEN array_to_string(list_reverse(string_split(q, ' ')), ' ') END")} AS gt FROM m JOIN documents d ON d.doc_id = item_id),
f AS (SELECT *, len(list_distinct(qt)) > 0 AND len(list_distinct(tt)) > 0 AND len(list_intersect(list_distinct(qt), list_distinct(tt))) < greatest(1, floor(len(list_distinct(qt)) / 4)) AS apart, coalesce(len(gt) > 0 AND list_sort(list_distinct(qt)) = list_sort(list_distinct(gt)) AND qt <> gt, false) AS turned FROM t),
l AS (SELECT item_id, list_filter([CASE WHEN k IN ('paraphrase') OR apart THEN 'different_wording' END, CASE WHEN k = 'spelling' THEN 'morphology_or_spelling' END, CASE WHEN k = 'halfspace' THEN 'surface_normalization' END, CASE WHEN k IN ('synonym', 'paraphrase') THEN 'synonyms_or_paraphrase' END, CASE WHEN turned THEN 'word_order' END], lambda x: x IS NOT NULL) AS l FROM f),
u AS (SELECT unnest(CASE WHEN len(l) = 0 THEN ['unspecified_semantic_gap'] ELSE l END) AS label FROM l)
SELECT label, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM l), 6) AS percent FROM u GROUP BY 1""")
def miss_classes(spark, sf_dir):
    """Items as missed questions of several kinds, the document of their number on top, their words backwards as gold of every second."""
    q = table(spark, sf_dir, "benchmark").select(c("item_id").alias("question_id"), c("text").alias("query"), F.get(F.array(F.lit(None).cast("string"), *(F.lit(x) for x in ("paraphrase", "spelling", "halfspace", "synonym"))), (c("item_id") % 5).cast("int")).alias("kind"))
    rows = q.join(table(spark, sf_dir, "documents").select(c("doc_id").alias("question_id"), c("text").alias("top_text")), "question_id")
    rows = rows.withColumn("gold_text", F.when(c("question_id") % 2 == 0, F.array_join(F.reverse(F.split("query", " ")), " ")))
    return diagnostics.miss_gaps(rows).withColumn("percent", r6(c("percent")))


def _judged(spark, sf_dir) -> DataFrame:
    """Events as judged questions."""
    i, v = c("event_id"), F.coalesce("value", F.lit(0.0))
    return table(spark, sf_dir, "events").select(i.alias("question_id"), (i % 13 == 0).alias("probe"), (i % 5 != 0).alias("measured"), F.when(i % 4 != 0, i.cast("string")).alias("expected_id"), F.when(i % 2 == 0, "baseline").otherwise("robustness").alias("cohort"),
                                                 (v > 30).cast("double").alias("hit"), (i % 3 == 0).alias("correct_document"), (i % 6 == 0).alias("correct_chunk"), (i % 7).cast("int").alias("retrieved"), (v / 100).alias("mean_score"), (i % 8).cast("int").alias("issues"), (i % 9 != 0).alias("answered"), (i % 10 < 5).alias("cited"), (i % 11 == 0).alias("risk"), (c("event_type") == "view").alias("abstained"), (i % 4 != 0).alias("has_gold_answer"))


_JUDGED = """j AS (SELECT event_id AS i, event_id % 13 = 0 AS probe, event_id % 5 <> 0 AS measured, event_id % 4 <> 0 AS gold, event_id % 2 = 1 AS robust, coalesce(value, 0) > 30 AS hit, event_id % 3 = 0 AS doc, event_id % 6 = 0 AS chunk, event_id % 7 AS retrieved, coalesce(value, 0) / 100 AS mean, event_id % 8 AS issues, event_id % 9 <> 0 AS answered, event_id % 10 < 5 AS cited, event_id % 11 = 0 AS risk, event_type = 'view' AS abstained FROM events),
k AS (SELECT *, CASE WHEN NOT measured THEN false WHEN NOT gold THEN abstained OR NOT answered WHEN NOT hit THEN false WHEN NOT answered THEN true ELSE NOT risk END AS passed,
 CASE WHEN doc AND NOT chunk THEN 0.65 WHEN NOT doc AND retrieved > 0 THEN 0.6 ELSE 0.55 END AS s0 FROM j),
h AS (SELECT i, passed, list_filter([CASE WHEN probe THEN {'s': -1.0::DOUBLE, 'i': 0, 'c': 'AUTO_CORPUS_PROBE_NOT_MEASURED'} END,
 CASE WHEN measured AND NOT hit THEN {'s': -round(least((CASE WHEN mean < 0.15 THEN greatest(s0, 0.7) ELSE s0 END) + CASE WHEN robust THEN 0.1 ELSE 0 END, 1), 6)::DOUBLE, 'i': 1, 'c': CASE WHEN mean < 0.15 THEN 'LIKELY_LOW_RETRIEVAL_SCORE' WHEN doc AND NOT chunk THEN 'LIKELY_WRONG_CHUNK_OR_CHUNKING' WHEN NOT doc AND retrieved > 0 THEN 'LIKELY_WRONG_DOCUMENT_OR_EMBEDDING' ELSE 'RETRIEVAL_MISS' END} END,
 CASE WHEN issues > 0 THEN {'s': CASE WHEN robust THEN -0.45 ELSE -0.35 END::DOUBLE, 'i': 2, 'c': 'LIKELY_QUERY_SURFACE_NORMALIZATION_GAP'} END,
 CASE WHEN answered AND measured AND NOT cited AND gold THEN {'s': -0.75::DOUBLE, 'i': 3, 'c': 'LIKELY_CITATION_MISMATCH'} END, CASE WHEN answered AND measured AND risk THEN {'s': -0.4::DOUBLE, 'i': 4, 'c': 'LIKELY_GENERATION_DRIFT'} END,
 CASE WHEN answered AND measured AND abstained AND gold THEN {'s': CASE WHEN hit THEN -0.85 ELSE -0.7 END::DOUBLE, 'i': 5, 'c': CASE WHEN hit THEN 'FALSE_ABSTAIN_EVIDENCE_THRESHOLD' ELSE 'LIKELY_ABSTENTION_POLICY' END} END], lambda x: x IS NOT NULL) AS f FROM k)"""


@query(f"WITH {_JUDGED} SELECT i AS question_id, array_to_string(list_transform(list_sort(f)[1:5], lambda x: x.c), ',') AS causes, passed FROM h")
def root_causes(spark, sf_dir):
    """G13"""
    return diagnostics.root_causes(_judged(spark, sf_dir)).select("question_id", F.array_join(F.transform("causes", lambda x: x["cause"]), ",").alias("causes"), "passed")


@query(f"WITH {_JUDGED} SELECT CASE WHEN robust THEN 'robustness' ELSE 'baseline' END AS cohort, round(avg(CASE WHEN passed THEN 1 ELSE 0 END), 6) AS pass_rate FROM k WHERE measured GROUP BY 1")
def measured_pass_rates(spark, sf_dir):
    """G19, Q06"""
    rows = _judged(spark, sf_dir)
    return diagnostics.pass_rate(diagnostics.root_causes(rows), rows).withColumn("pass_rate", r6(c("pass_rate")))


_COHORTS = f"""x AS (SELECT CASE WHEN CAST(question_id AS BIGINT) % 2 = 0 THEN 'baseline' ELSE 'robustness' END AS cohort, len(list_intersect(r[1:3], e)) AS h, len(e) AS n, CASE WHEN len(e) = 0 THEN 0 WHEN r[1] = e[1] THEN 1.0 WHEN r[2] = e[1] THEN 0.5 WHEN r[3] = e[1] THEN 1.0 / 3 ELSE 0 END AS rr FROM o),
m AS (SELECT cohort, avg(CASE WHEN h > 0 THEN 1 ELSE 0 END) AS hit_at_k, avg(CASE WHEN n > 0 THEN h / n ELSE 0 END) AS recall_at_k, avg(h / 3) AS precision_at_k, avg(rr) AS mrr FROM x GROUP BY 1)"""


def _by_cohort(spark, sf_dir) -> DataFrame:
    o = outcomes(spark, sf_dir).withColumn("cohort", F.when(c("question_id").cast("bigint") % 2 == 0, "baseline").otherwise("robustness"))
    return diagnostics.by_cohort(o, 3)


@query(f"""WITH {_OUT}, {_COHORTS}, u AS (UNPIVOT m ON hit_at_k, recall_at_k, precision_at_k, mrr INTO NAME metric VALUE v)
SELECT metric, 'measured' AS trust, round(max(v) FILTER (cohort = 'baseline'), 6) AS baseline_value, round(max(v) FILTER (cohort = 'robustness'), 6) AS robustness_value FROM u GROUP BY 1""")
def trust_report(spark, sf_dir):
    """G19"""
    out = diagnostics.trust_report(_by_cohort(spark, sf_dir))
    return out.select("metric", "trust", r6(c("baseline_value")).alias("baseline_value"), r6(c("robustness_value")).alias("robustness_value"))


@query(f"""WITH {_OUT}, {_COHORTS} SELECT cohort, 'retrieval_hit_at_k' AS name, round(100 * hit_at_k, 4) AS score FROM m UNION ALL SELECT cohort, 'retrieval_mrr', round(100 * mrr, 4) FROM m""")
def subsystem_scores(spark, sf_dir):
    """G19"""
    return diagnostics.subsystem_scores(_by_cohort(spark, sf_dir)).withColumn("score", F.round("score", 4))



_CONTENT = "list_distinct(list_filter(" + _ALL + ", lambda x: length(x) > 1 and not list_contains(['the','a','an','is','are','of','to','in','for','and','or','on'], x)))"


@query("""SELECT CASE WHEN item_id % 3 = 0 THEN 'baseline' ELSE 'robustness' END AS cohort, count(*) FILTER (item_id % 4 > 0 AND item_id % 5 > 0) AS measured, count(*) AS n FROM benchmark GROUP BY 1""")
def question_cohorts(spark, sf_dir):
    """Q06"""
    rows = table(spark, sf_dir, "benchmark").select(c("item_id").alias("question_id"), F.when(c("item_id") % 3 > 0, "spelling").alias("kind"), F.when(c("item_id") % 4 > 0, c("item_id")).alias("chunk_id"), F.when(c("item_id") % 7 > 0, c("item_id") % 5 == 0).otherwise(F.when(c("item_id") % 5 == 0, True)).alias("expect_abstention"))
    return questions.cohorts(rows).groupBy("cohort").agg(F.count_if("measured").alias("measured"), F.count("*").alias("n"))
