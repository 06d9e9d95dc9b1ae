"""Line dedup by content-defined chunks of lines, in DataFrame functions only.

Each text is split once into lines, of which those that are not blank are hashed. A cyclic
polynomial rolls over the hashes of two lines; where its value meets the mask (one line of four)
and did not at the line before, a chunk ends. So the end of a chunk depends on its last three
lines alone, an insertion moves no other boundary, and chunks have two lines at least; a chunk of
over `GREATEST` lines is cut into such of that size.

Chunks of equal hash are found over all documents, and every one but the first is taken as a
repeat. What is left is compared again in the smallest chunks, of two neighbouring lines: those of
the chunks that are no repeats, and those across the seams of chunks. Each repeated passage of two
lines is so found wherever boundaries fall, while a copied text costs as many rows as it has chunks.
The bytes of all repeats are then cut out of their texts and grouped: only what is equal byte for
byte counts, and all but its first occurrence (smallest doc_id, then smallest line) is removed.

Results: the lines removed are those of all passages of two lines that are not blank (with the
blank lines between them) that also stand earlier. Blank lines alone are never compared. A line that
follows itself many times stays once. Null texts and texts of one line stay as they are, and
a text that loses all its lines is empty. Long texts are arrays of one row and need no other limit. Ties and
repeated rows: rows of one doc_id with equal texts are one document and keep their lines;
rows of one doc_id with other texts are judged by their own lines. Rows without doc_id take no
part and stay whole. Other columns pass unchanged, whatever their names; an empty table gives
an empty table. Two chunks of one 64-bit hash and different bytes are both kept whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import settle

#: Bits of the rolling hash that are 0 at a boundary.
MASK = 3
GREATEST = 16
_KEY = ["doc_id", "t"]


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, t (the text's hash), at (numbers of the lines that are not blank), h (their hashes): texts of two such lines."""
    lines = F.split("text", "\n", -1)
    own = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), F.trim(x, F.lit(" \t\r")).alias("trimmed"), F.xxhash64(x).alias("h"))), lambda s: s["trimmed"] != "")
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("t"), own.alias("own")).where("size(own) > 1")
    return rows.select(*_KEY, F.col("own.at").alias("at"), F.col("own.h").alias("h"))


def boundaries(rows: DataFrame, mask: int = MASK, greatest: int = GREATEST) -> DataFrame:
    """rows of `hashed` with `starts`, the first place (in h) of each chunk."""
    rolled = lambda a, b: F.shiftleft(a, 1).bitwiseOR(F.shiftrightunsigned(a, 63)).bitwiseXOR(b)
    n = F.size("h")
    hits = F.transform(F.sequence(F.lit(1), n - 1), lambda i: rolled(F.get("h", i - 1), F.get("h", i)).bitwiseAND(F.lit(mask)) == 0)
    out = rows.withColumn("hits", hits)
    cut = F.transform("hits", lambda hit, j: F.when(hit & ((j == 0) | ~F.get("hits", j - 1)) & (j + 2 <= n - 2), j + 2))
    cut = F.filter(cut, lambda x: x.isNotNull())
    out = out.withColumn("cut", cut).drop("hits")
    parts = F.zip_with(F.concat(F.array(F.lit(0)), "cut"), F.concat("cut", F.array(n)), lambda a, b: F.sequence(a, b - 2, F.lit(greatest)))
    return out.withColumn("starts", F.flatten(parts)).drop("cut")


def _rows(of: Column) -> list:
    """Columns of a table with one row for each (lo, hi) of `of`, places in h: its lines (first, end) and its hash."""
    each = F.transform(of, lambda s: F.struct(
        s["lo"].alias("lo"), s["hi"].alias("hi"), F.get("at", s["lo"]).alias("first"), (F.get("at", s["hi"] - 1) + 1).alias("end"),
        F.xxhash64(F.slice("h", s["lo"] + 1, s["hi"] - s["lo"])).alias("hash")))
    return [*_KEY, F.inline(each)]


def chunks(rows: DataFrame, mask: int = MASK, greatest: int = GREATEST) -> DataFrame:
    """doc_id, t, lo, hi (places in h), first, end (lines), hash: the content-defined chunks."""
    found = boundaries(rows, mask, greatest)
    return found.select(*_rows(F.transform("starts", lambda a, k: F.struct(a.alias("lo"), F.coalesce(F.get("starts", k + 1), F.size("h")).alias("hi")))))


def smallest(rows: DataFrame, repeats: DataFrame) -> DataFrame:
    """The chunks of two lines outside `repeats` (doc_id, t, lo, hi), seams included, in the columns of `chunks`."""
    spans = repeats.groupBy(*_KEY).agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("spans"))  # a document's own chunks
    left = rows.join(spans, _KEY, "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<lo:int,hi:int>>")))
    firsts, lasts = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["hi"] - 1)), F.concat(F.transform("spans", lambda s: s["lo"] - 1), F.array(F.size("h") - 2))
    between = F.flatten(F.zip_with(firsts, lasts, lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))))
    return left.select(*_rows(F.transform(between, lambda a: F.struct(a.alias("lo"), (a + 2).alias("hi")))))


def _met(rows: DataFrame, name: str) -> DataFrame:
    """Rows whose hash comes again, with `later`: whether another comes first."""
    rows = settle(rows, name)
    again = settle(rows.groupBy("hash").agg(F.min(F.struct(*_KEY, "lo")).alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n"), f"{name}-again")
    return rows.join(again, "hash").withColumn("later", F.struct(*_KEY, "lo") != F.col("kept")).drop("kept", "hash")


def removed(docs: DataFrame, mask: int = MASK, greatest: int = GREATEST) -> DataFrame:
    """doc_id, t, first, end of the lines to remove, in runs that lie apart."""
    docs = docs.select("doc_id", "text")
    rows = settle(hashed(docs), "lines")
    large = settle(_met(chunks(rows, mask, greatest), "chunks"), "repeats")
    small = _met(smallest(rows, large.where("later").select(*_KEY, "lo", "hi")), "pairs")
    marks = large.select(*_KEY, "first", "end").unionByName(small.select(*_KEY, "first", "end")).groupBy(*_KEY).agg(F.collect_set(F.struct("first", "end")).alias("marks"))
    # the bytes of repeats alone, cut out of their texts
    texts = docs.where("doc_id is not null").withColumn("t", F.xxhash64("text")).dropDuplicates(_KEY).join(marks, _KEY).select(*_KEY, F.split("text", "\n", -1).alias("lines"), "marks")
    named = settle(texts.select(*_KEY, F.inline(F.transform("marks", lambda m: F.struct(
        m["first"].alias("first"), m["end"].alias("end"), F.array_join(F.slice("lines", m["first"] + 1, m["end"] - m["first"]), "\n").alias("chunk"))))), "bytes")
    # grouping by the chunk itself compares bytes; its first occurrence stays
    kept = named.groupBy(F.xxhash64("chunk").alias("h"), "chunk").agg(F.min(F.struct(*_KEY, "first", "end")).alias("kept")).select("kept.*")
    gone = named.select(*_KEY, "first", "end").join(kept, [*_KEY, "first", "end"], "left_anti")
    order = W.partitionBy(*_KEY).orderBy("first", "end")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    run = F.count(F.when(F.coalesce(F.col("first") > F.col("reach"), F.lit(True)), 1)).over(order.rowsBetween(W.unboundedPreceding, 0))
    return gone.withColumn("reach", reach).withColumn("run", run).groupBy(*_KEY, "run").agg(F.min("first").alias("first"), F.max("end").alias("end")).drop("run")


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _cleaned(docs: DataFrame, **options) -> tuple[DataFrame, str, str]:
    """docs with text without the lines removed and two columns more, whose names follow: lines before, lines removed."""
    key, gone, lines, before, less = (_free(docs, x) for x in ("_key", "_gone", "_split", "_before", "_less"))
    spans = removed(docs, **options).groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("first", "end"))).alias("spans"))
    spans = spans.select(F.struct("doc_id", "t").alias(key), F.col("spans").alias(gone))
    rows = docs.withColumn(key, F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.xxhash64("text").alias("t"))))
    rows = rows.join(spans, key, "left").withColumn(lines, F.split("text", "\n", -1))
    starts, ends = F.concat(F.col(f"{gone}.first"), F.array(F.size(lines))), F.concat(F.array(F.lit(0)), F.col(f"{gone}.end"))
    between = F.zip_with(ends, starts, lambda a, b: F.slice(lines, a + 1, F.greatest(b - a, F.lit(0))))
    out = rows.withColumns({
        before: F.when(F.col("text").isNull() | (F.col("text") == ""), 0).otherwise(F.size(lines)),
        less: F.coalesce(F.aggregate(gone, F.lit(0), lambda a, g: a + g["end"] - g["first"]), F.lit(0)),
        "text": F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.flatten(between), "\n")),
    })
    return out.drop(key, gone, lines), before, less


def dedup(docs: DataFrame, size: str | None = None, **options) -> DataFrame:
    """The documents in their own columns, text without the lines removed; `size` names a column that follows the text's length."""
    out, before, less = _cleaned(docs, **options)
    if size in docs.columns:
        out = out.withColumn(size, F.when(F.col(less) > 0, F.length("text")).otherwise(F.col(size)).cast(docs.schema[size].dataType))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256."""
    out, before, less = _cleaned(docs.select("doc_id", "text"), **options)
    return out.select("doc_id", F.col(before).cast("bigint").alias("n_lines"), F.col(less).cast("bigint").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
