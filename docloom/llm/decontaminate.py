"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every 13-word window of a benchmark item is a pattern (an item of fewer words is one pattern
of its own length). Per pattern length, a shift table over blocks of words says how far the
search may jump, a bucket per last block selects the patterns to try, and a direct comparison
of the words confirms each occurrence. The documents are scanned in place, without a shuffle;
only the pattern tables travel, at most `max_pattern_bytes` of benchmark text at a time. A
larger benchmark is cut into blocks of items, each block is searched over all documents, and
the spans found are merged per document (the default keeps the tables of a block, about a hundred times its text, in the
memory of a worker).

Nulls: a null text has no words; a null item or an item without words has no patterns; the words of an item without
item_id are hit, but it is not listed. Empty tables give empty results or documents without hits. Texts are scanned
whole. Rows are judged one by one, however many blocks there are: rows of one doc_id and other texts by their own words,
repeated rows once per row. Columns of other names pass `decontaminate` unchanged.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 13
BLOCK = 3
MAX_PATTERN_BYTES = 4 << 20

#: A-Z become a-z; other ASCII but letters and digits separates words; bytes of other characters stay.
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32) for c in range(256))


def fold_words(text: str | None) -> list[bytes]:
    """Words of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class WuManber:
    """Shift tables and suffix buckets for word patterns, one set per pattern length."""

    def __init__(self, items: Iterable[tuple[object, str | None]], window: int = WINDOW):
        patterns: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            found = fold_words(text)
            width = min(window, len(found))
            for i in range(len(found) - width + 1) if width else ():
                patterns[width][tuple(found[i : i + width])].add(item)
        self.tables = []
        for width, group in sorted(patterns.items()):
            size = min(BLOCK, width)
            shift: dict[tuple, int] = {}
            buckets: dict[tuple, list[tuple]] = defaultdict(list)
            for p in group:
                for end in range(size, width + 1):
                    block = p[end - size : end]
                    shift[block] = min(shift.get(block, width), width - end)
                buckets[p[-size:]].append(p)
            self.tables.append((width, size, width - size + 1, shift, dict(buckets), dict(group)))

    def spans(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Word spans of all occurrences, and the items they come from."""
        out, items, n = [], set(), len(found)
        for width, size, far, shift, buckets, group in self.tables:
            get, end = shift.get, width
            while end <= n:
                block = tuple(found[end - size : end])
                jump = get(block, far)
                if jump:
                    end += jump
                    continue
                start = end - width
                for p in buckets[block]:
                    if tuple(found[start:end]) == p:
                        out.append((start, end))
                        items |= group[p]
                end += 1
        return out, items


def covered(spans: list[tuple[int, int]]) -> int:
    total, reach = 0, 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, reach))
        reach = max(reach, b)
    return total


def _blocks(items: DataFrame, max_bytes: int) -> list[Column]:
    """Conditions that split the items into blocks of about max_bytes at most; one if all fit."""
    size = items.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    n = -(-size // max_bytes) if size > max_bytes else 1
    return [F.lit(True)] if n == 1 else [F.pmod(F.xxhash64("item_id"), F.lit(2 * n)) == k for k in range(2 * n)]


_FOUND = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])


def _key() -> list[Column]:
    return [F.col("doc_id"), F.xxhash64("text").alias("t")]


def _scan(docs: DataFrame, searcher: WuManber) -> DataFrame:
    """doc_id, t (the text's hash), _found."""
    shared = docs.sparkSession.sparkContext.broadcast(searcher)
    rows = docs.select(*_key(), "text")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for batch in batches:
            found_ = []
            for text in batch.column("text"):
                found = fold_words(text.as_py())
                spans, items = tables.spans(found)
                found_.append({"n_words": len(found), "spans": spans, "items": sorted(str(x) for x in items if x is not None)})
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), pa.array(found_, type=_FOUND)], names=["doc_id", "t", "_found"])

    return rows.mapInArrow(search, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, t bigint, _found struct<n_words: bigint, spans: array<array<bigint>>, items: array<string>>")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_pattern_bytes: int = MAX_PATTERN_BYTES) -> DataFrame:
    """Per document: doc_id, t (the text's hash), n_words, spans (word ranges of every occurrence), items (as sorted strings)."""
    docs, items = docs.select("doc_id", "text"), items.select("item_id", "text")
    parts = []
    for condition in _blocks(items, max_pattern_bytes):
        rows = items.where(condition).collect()  # about max_pattern_bytes, see _blocks
        parts.append(_scan(docs, WuManber(((r["item_id"], r["text"]) for r in rows), window)))
    if len(parts) == 1:
        return parts[0].select("doc_id", "t", "_found.*")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    merged = every.groupBy("doc_id", "t").agg(
        F.max("_found.n_words").alias("n_words"),
        F.flatten(F.collect_list("_found.spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_found.items")))).alias("items"),
    )
    merged = merged.withColumnsRenamed({"doc_id": "_id", "t": "_t"})
    return docs.select(*_key()).join(merged, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t"))).drop("_id", "_t")


def _n_hit(spans) -> int:
    return covered([tuple(x) for x in spans])


def _with_hits(found: DataFrame) -> DataFrame:
    @F.pandas_udf("bigint")
    def n_hit(spans):
        return spans.map(_n_hit)

    return found.withColumn("n_hit", n_hit("spans"))


def report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Per document the hit words, the items found and the verdict."""
    out = _with_hits(contamination(docs, items, **options))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_pattern_bytes: int = MAX_PATTERN_BYTES) -> DataFrame:
    """The documents, in their own columns, that are not contaminated: fewer than 1 word in 20 is hit."""
    items = items.select("item_id", "text")
    conditions = _blocks(items, max_pattern_bytes)
    if len(conditions) > 1:
        found = _with_hits(contamination(docs, items, window, max_pattern_bytes))
        bad = found.where("n_hit > 0 and 20 * n_hit >= n_words").select(F.struct(F.col("doc_id").alias("_id"), F.col("t").alias("_t")).alias("_bad")).distinct()
        own = F.struct(docs["doc_id"].alias("_id"), F.xxhash64(docs["text"]).alias("_t"))
        return docs.join(bad, own.eqNullSafe(bad["_bad"]), "left_anti")
    rows = items.collect()  # at most max_pattern_bytes, checked above
    shared = docs.sparkSession.sparkContext.broadcast(WuManber(((r["item_id"], r["text"]) for r in rows), window))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for text in batch.column("text"):
                found = fold_words(text.as_py())
                n = covered(shared.value.spans(found)[0])
                keep.append(not (n > 0 and 20 * n >= len(found)))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def sha256_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
