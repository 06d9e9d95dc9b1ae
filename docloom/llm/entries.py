"""The queries of this subpackage over the tables in sf_dir, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, jaccard, lines, neighbours, packing, pii, prefixes, ranked, substrings, suffixes, toxicity, warc
from .scratch import fresh_path, read


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trial = "</s>[INST] ok [/INST]"
    more = spark.range(1).select(F.lit(-1).cast("bigint").alias("conv_id"), F.inline(F.array(
        F.struct(F.lit(0).cast("bigint").alias("turn"), F.lit("user").alias("role"), F.lit(trial).alias("text")),
        F.struct(F.lit(1).cast("bigint").alias("turn"), F.lit("assistant").alias("role"), F.lit(trial).alias("text")))))
    return chat.report(turns.unionByName(more))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read(spark, sf_dir, "embeddings"), every=20, k=20)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write(read(spark, sf_dir, "pages"), path)
    return warc.report(spark, path)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(read(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    """The vocabulary of the packing queries; operators take its path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(read(spark, sf_dir, "documents"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(read(spark, sf_dir, "documents"))


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.report(read(spark, sf_dir, "conversations"))


def op12_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


_CONTROL = r"</?s>|\[/?INST\]|<</?SYS>>|<</?ROLE>>|<<SAYS>>"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
#: Digits of a column with a sound Luhn sum; letters and digits with a remainder of 1 by 97.
_LUHN = "(list_sum(list_transform(range(1, length({0}) + 1), lambda q: CASE WHEN q % 2 = 1 THEN ascii(reverse({0})[q]) - 48 ELSE (2 * (ascii(reverse({0})[q]) - 48)) // 10 + (2 * (ascii(reverse({0})[q]) - 48)) % 10 END)) % 10 = 0)"
_MOD97 = """(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(substr({0}, 5) || substr({0}, 1, 4), ''), lambda q: CAST(CASE WHEN q <= '9' THEN ascii(q) - 48 ELSE ascii(q) - 55 END AS BIGINT))),
  lambda x, y: (x * CASE WHEN y > 9 THEN 100 ELSE 10 END + y) % 97) = 1)"""
_NEARBY = "CASE kind " + " ".join(f"WHEN {n} THEN regexp_matches({{0}}, '(?i)\\b(?:{pii.FOR[k]})\\b')" for n, k in enumerate(pii.KINDS)) + " END"
_SPEAKS_AGAINST = "CASE kind " + " ".join(f"WHEN {pii.KINDS.index(k)} THEN regexp_matches({{0}}, '(?i)\\b(?:{v})\\b')" for k, v in pii.AGAINST.items()) + " ELSE false END"

#: SQL for the answers that it can give over whole tables.
SQL = {
    "op1_chat_formatting": rf"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length(text) + len(regexp_extract_all(text, '{_CONTROL}')) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 WHEN 'system' THEN 17 ELSE 28 + length(role) END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id""",
    "op3_benchmark_decontamination": rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM benchmark),
iw AS (SELECT item_id, least(13, len(l)) AS k, unnest(list_transform(range(1, len(l) - least(13, len(l)) + 2), lambda x: array_to_string(l[x:x + least(13, len(l)) - 1], ' '))) AS s FROM i WHERE len(l) > 0),
dw AS (SELECT doc_id, k, unnest(range(1, len(l) - k + 2)) AS at_, unnest(list_transform(range(1, len(l) - k + 2), lambda x: array_to_string(l[x:x + k - 1], ' '))) AS s FROM d, (SELECT DISTINCT k FROM iw) WHERE len(l) >= k),
h AS (SELECT doc_id, at_, iw.k AS k, CAST(item_id AS VARCHAR) AS item FROM dw JOIN iw ON dw.k = iw.k AND dw.s = iw.s),
n AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(at_, at_ + k)) AS w FROM h) GROUP BY 1),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(l), false) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op4_ngram_jaccard_join": rf"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS l FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(l) - 3, 2)), lambda x: array_to_string(l[x:x + 4], ' '))) AS g FROM d WHERE len(l) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY 1, 2""",
    "op6_warc_archive": """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), k AS (SELECT h, max(page_id) AS kept FROM p WHERE octet_length(encode(h)) >= 1000 GROUP BY 1)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN kept IS NOT NULL AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> kept THEN kept END AS refers_to
FROM p LEFT JOIN k USING (h)""",
    "op7_line_dedup": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT doc_id, l, list_filter(range(1, len(l) + 1), lambda i: trim(l[i], ' ' || chr(9) || chr(13)) <> '') AS own FROM d),
p AS (SELECT doc_id, unnest(list_transform(range(1, len(own)), lambda k: {'a': own[k], 'b': own[k + 1], 's': array_to_string(l[own[k]:own[k + 1]], chr(10))}), recursive := true) FROM x),
r AS (SELECT doc_id, a, b, row_number() OVER (PARTITION BY s ORDER BY doc_id, a) > 1 AS gone FROM p),
g AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i, true AS gone FROM r WHERE gone),
t AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM d),
k AS (SELECT doc_id, count(gone) AS n_removed, string_agg(CASE WHEN gone IS NULL THEN line END, chr(10) ORDER BY i) AS kept FROM t LEFT JOIN g USING (doc_id, i) GROUP BY 1)
SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE len(l) END AS n_lines, n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d JOIN k USING (doc_id)""",
    "op9_substring_dedup": rf"""WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS l FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(l) - 18)) AS i, unnest(list_transform(range(1, len(l) - 18), lambda x: array_to_string(l[x:x + 19], ' '))) AS s FROM d WHERE len(l) >= 20),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1 AS gone FROM w),
t AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS word FROM d),
m AS (SELECT doc_id, t.i, word, coalesce(bool_or(gone) OVER (PARTITION BY doc_id ORDER BY t.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone FROM t LEFT JOIN f USING (doc_id, i)),
a AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(CASE WHEN NOT gone THEN word END, ' ' ORDER BY i) AS kept FROM m GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)""",
    "op11_conversation_prefix_trie": r"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id AS c, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda q: CAST(ascii(q) AS BIGINT))),
  lambda x, y: list_reduce(list_prepend(xor(x, y), range(8)), lambda z, i: xor(z >> 1, (z & 1) * 3988292384))), 4294967295) % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
b AS (SELECT c, 0 AS part, p, role, text FROM c JOIN t ON conv_id = c - c % 5 AND p <= h UNION ALL SELECT c, 1, p, role, text FROM c JOIN t ON conv_id = c AND p > h),
n AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, p) AS d, sha256(length(role) || ':' || role || text) AS x, octet_length(encode(text)) AS bytes FROM b),
f AS (SELECT c, 0 AS d, '' AS k, 0 AS bytes FROM c UNION ALL SELECT c, d, string_agg(x, '') OVER (PARTITION BY c ORDER BY d), bytes FROM n),
v AS (SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saves FROM f GROUP BY k, d),
e AS (SELECT DISTINCT a.k AS up, a.d AS up_d, z.k AS k, z.d AS d FROM f a JOIN f z ON a.c = z.c AND a.d <= z.d),
g AS (SELECT up AS k, count(*) FILTER (d = up_d + 1) AS n_children FROM e GROUP BY 1),
s AS (SELECT up AS k, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saves) AS BIGINT) AS saved_tokens FROM e JOIN g USING (k) JOIN v USING (k) GROUP BY 1),
u AS (SELECT e.k, v.conv_id AS parent_conv_id FROM e JOIN v ON v.k = up WHERE e.d = up_d + 1),
m AS (SELECT k, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ends FROM f WHERE d = (SELECT max(o.d) FROM f o WHERE o.c = f.c) GROUP BY k)
SELECT conv_id, CAST(d AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256 FROM v JOIN g USING (k) JOIN s USING (k) LEFT JOIN u USING (k) LEFT JOIN m USING (k)""",
    "op12_ranked_lexical_search": rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS l FROM documents),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY 1, 2),
z AS (SELECT count(*) AS n, CAST(sum(len(l)) AS BIGINT) AS l FROM d WHERE len(l) > 0),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(l) AS n, unnest(l) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * z.n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, z GROUP BY term, z.n),
s AS (SELECT q.item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * p.n * z.n) // z.l)))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN p USING (term), z GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10""",
    "op13_pii": rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
c AS (SELECT r, 0 AS kind, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS m, regexp_split_to_array(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS g FROM d
  UNION ALL SELECT r, 1, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), regexp_split_to_array(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') FROM d
  UNION ALL SELECT r, 2, regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), regexp_split_to_array(t, '[0-9]([\x20-]?[0-9])+') FROM d
  UNION ALL SELECT r, 3, regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), regexp_split_to_array(t, '\+[0-9][\x20().0-9-]+[0-9]') FROM d
  UNION ALL SELECT r, 4, regexp_extract_all(t, '[A-Z][A-Z][0-9][0-9]( ?[A-Z0-9]){{11,30}}'), regexp_split_to_array(t, '[A-Z][A-Z][0-9][0-9]( ?[A-Z0-9]){{11,30}}') FROM d
  UNION ALL SELECT r, 5, regexp_extract_all(t, '\(?[0-9][0-9][0-9]\)?[ .-][0-9][0-9][0-9][ .-][0-9][0-9][0-9][0-9]'), regexp_split_to_array(t, '\(?[0-9][0-9][0-9]\)?[ .-][0-9][0-9][0-9][ .-][0-9][0-9][0-9][0-9]') FROM d),
a AS (SELECT r, kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'s': length(array_to_string(g[1:i], '')) + length(array_to_string(m[1:i - 1], '')), 'x': m[i]}}), recursive := true) FROM c WHERE len(m) > 0),
b AS (SELECT r, kind, s, s + length(x) AS e, x, regexp_replace(x, '[^0-9]', '', 'g') AS n FROM a),
ok AS (SELECT *, CASE kind WHEN 0 THEN true WHEN 1 THEN regexp_full_match(x, '0*([0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])(\.0*([0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5]))(\.0*([0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5]))(\.0*([0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5]))')
  WHEN 2 THEN length(n) BETWEEN 13 AND 19 AND {_LUHN.format("n")} WHEN 3 THEN length(n) BETWEEN 9 AND 15 ELSE false END AS own FROM b),
base AS (SELECT r, kind, s, e, CASE kind WHEN 0 THEN 0 WHEN 2 THEN 40 ELSE 20 END AS sure, true AS base FROM ok WHERE own),
gl AS (SELECT r, s, regexp_split_to_array(x, '[ -]') AS l FROM ok WHERE kind = 2 AND NOT own AND length(n) >= 13),
gi AS (SELECT r, s, l, unnest(range(1, len(l) + 1)) AS i FROM gl),
gn AS (SELECT r, s, s + length(array_to_string(l[1:i - 1], '')) + i - 1 AS a, l[i] AS one, array_to_string(l[i:i + 3], '') AS four, list_transform(l[i:i + 3], lambda q: length(q)) AS sizes4, array_to_string(l[i:i + 2], '') AS three, list_transform(l[i:i + 2], lambda q: length(q)) AS sizes3 FROM gi),
ge AS (SELECT r, s, a, a + CASE WHEN length(one) BETWEEN 13 AND 19 AND {_LUHN.format("one")} THEN length(one) WHEN sizes4 = [4, 4, 4, 4] AND {_LUHN.format("four")} THEN 19 WHEN sizes3 = [4, 6, 5] AND {_LUHN.format("three")} THEN 17 END AS e FROM gn),
gc AS (SELECT r, a, e, coalesce(max(e) OVER (PARTITION BY r, s ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS last_ FROM ge WHERE e IS NOT NULL),
cards AS (SELECT r, 2 AS kind, a AS s, e, 40 AS sure, false AS base FROM gc WHERE a >= last_),
lim AS (SELECT r, list(s) AS starts FROM (SELECT r, s FROM base WHERE kind IN (1, 2) UNION ALL SELECT r, s FROM cards) GROUP BY r),
ph AS (SELECT ok.r, s, x, coalesce(list_min(list_filter(starts, lambda q: q > s)), s + length(x)) - s AS room FROM ok LEFT JOIN lim USING (r) WHERE kind = 3 AND length(n) > 15),
phones AS (SELECT r, 3 AS kind, s, s + list_max(list_filter(range(1, length(x) + 1), lambda i: i <= room AND x[i] BETWEEN '0' AND '9' AND NOT (i < length(x) AND x[i + 1] BETWEEN '0' AND '9') AND length(regexp_replace(x[1:i], '[^0-9]', '', 'g')) BETWEEN 9 AND 15)) AS e, 20 AS sure, false AS base FROM ph),
ib AS (SELECT r, s, x, list_filter(range(1, length(x) + 1), lambda i: (i = length(x) OR x[i + 1] = ' ') AND length(replace(x[1:i], ' ', '')) BETWEEN 15 AND 34) AS ends FROM ok WHERE kind = 4),
ie AS (SELECT r, s, q, replace(x[1:q], ' ', '') AS code FROM (SELECT r, s, x, unnest(ends) AS q FROM ib)),
ibans AS (SELECT r, 4 AS kind, s, s + max(q) AS e, 40 AS sure, false AS base FROM ie WHERE {_MOD97.format("code")} GROUP BY r, s),
found AS (SELECT * FROM base UNION ALL SELECT * FROM cards UNION ALL SELECT * FROM phones WHERE e IS NOT NULL UNION ALL SELECT * FROM ibans),
nat AS (SELECT ok.r, 3 AS kind, s, e, 0 AS sure, false AS base FROM ok JOIN d USING (r) WHERE kind = 5 AND NOT regexp_matches(substr(t, s, CASE WHEN s > 0 THEN 1 ELSE 0 END), '[+0-9]') AND NOT regexp_matches(substr(t, e + 1, 1), '[0-9]')
  AND NOT EXISTS (SELECT 1 FROM found o WHERE o.r = ok.r AND o.s < ok.e AND ok.s < o.e)),
w AS (SELECT r, kind, s, e, sure, base, CASE WHEN s > 40 THEN substr(t, s - 39, 40) ELSE substr(t, 1, s) END AS x1, substr(t, e + 1, 40) AS x2 FROM (SELECT * FROM found UNION ALL SELECT * FROM nat) JOIN d USING (r)),
k AS (SELECT r, kind, base, concat(list_extract(['email', 'ip', 'card', 'phone', 'iban'], kind + 1), ':', s, ':', e) AS span, s, 40 + sure + CASE WHEN {_NEARBY.format("x1")} OR {_NEARBY.format("x2")} THEN 20 ELSE 0 END - CASE WHEN {_SPEAKS_AGAINST.format("x1")} OR {_SPEAKS_AGAINST.format("x2")} THEN 30 ELSE 0 END AS points FROM w),
o AS (SELECT r, count(*) FILTER (base AND kind = 0) AS e, count(*) FILTER (base AND kind = 1) AS i, count(*) FILTER (base AND kind = 2) AS c, count(*) FILTER (base AND kind = 3) AS p,
  string_agg(span, ',' ORDER BY kind, s) FILTER (base) AS b, string_agg(span, ',' ORDER BY kind, s) AS a FROM k WHERE base OR points >= 60 GROUP BY r)
SELECT doc_id, coalesce(e, 0) AS n_email, coalesce(i, 0) AS n_ip, coalesce(c, 0) AS n_card, coalesce(p, 0) AS n_phone, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans FROM d LEFT JOIN o USING (r)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
