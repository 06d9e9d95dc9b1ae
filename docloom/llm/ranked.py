"""Ranked lexical search: term-at-a-time for short lists, document-at-a-time over the long ones.

Documents are read once: of each, its length and its query terms with their counts go to a table in the shared folder.
Counts over all documents give N, L and the weight of every query term. Then each task searches its own part of the
table, shard by shard, for every item, and keeps the item's best `k` so far:

* lists of at most a 16th of a shard's documents are added up term at a time into accumulators, which from then on are
  one list more, bounded by its largest sum;
* that list and the long ones are walked in document order, a block of documents at a time. Lists whose bounds together
  stay below the k-th score so far open no document; they are probed by binary search for documents that others open,
  and only while the document can still reach that score (ties go on, for the smaller doc_id).

The k best of each task meet in a window with a group limit. Items come in blocks of about `entries` terms, each with
a vocabulary that is sent to the tasks; a block reads the documents once, so a larger benchmark takes more passes.

Results: rows that share an item_id are one item with all their terms; a null item_id is an item as well; an item
without terms, or whose terms no document holds, has no rows. Each row of docs is a document, repeated rows too; a null
doc_id comes first among equals. Null and empty texts have no terms and count in nothing. Texts are read whole; what is
kept of one is bounded by the vocabulary. Empty tables give an empty result. Other columns are left behind.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import fresh_path

TOP = 10
#: Terms of items that one pass sends to the tasks, about.
ENTRIES = 1_000_000
#: Documents, and postings, of a shard at most; documents in a block of the walk.
SHARD_DOCS, SHARD_POSTINGS, BLOCK = 40_000, 8_000_000, 4096
#: Lists of at most this share of a shard's documents are short.
SHORT = 16

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text: str | None) -> list[str]:
    return _TERM.findall((text or "").translate(_LOWER))


def _entries(items: DataFrame) -> DataFrame:
    """item_id, term, times."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [Counter(terms(t.as_py())) for t in batch.column("text")]
            ids = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(ids)), pa.array([t for c in counts for t in c], pa.string()), pa.array([n for c in counts for n in c.values()], pa.int64())], names=["item_id", "term", "times"])

    rows = items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, term string, times bigint")
    return rows.groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def _read(docs: DataFrame, vocabulary, path: str) -> DataFrame:
    """Written at path: doc_id, n (terms of the text), terms and counts (of the vocabulary, by their number)."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n bigint, terms array<int>, counts array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        for batch in batches:
            sizes, ids, counts = [], [], []
            at = [0]
            for t in batch.column("text"):
                found = terms(t.as_py())
                own = Counter(filter(number.__contains__, found))
                sizes.append(len(found))
                ids += [number[w] for w in own]
                counts += own.values()
                at.append(len(ids))
            at = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(at, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(at, pa.array(counts, pa.int32()))], names=["doc_id", "n", "terms", "counts"])

    docs.select("doc_id", "text").mapInArrow(run, schema).where("n > 0").write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


class Shard:
    """Inverted lists of a few documents: of each term the documents (by place) with what the term adds to their score."""

    def __init__(self, n: np.ndarray, sizes: np.ndarray, ids: np.ndarray, tf: np.ndarray, weights: np.ndarray, total: int, words: int):
        self.size = len(n)
        doc = np.repeat(np.arange(self.size), sizes)
        m = 25 + (75 * n * total) // words
        part = weights[ids] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        order = np.argsort(ids, kind="stable")  # documents stay in order within a term
        self.doc, self.part = doc[order], part[order]
        self.first = np.searchsorted(ids[order], np.arange(len(weights) + 1))

    def of(self, term: int, times: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.first[term], self.first[term + 1]
        return self.doc[a:b], self.part[a:b] * times

    def search(self, entries: list[tuple[int, int]], floor: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that may be among the k best, with their scores, given that k of at least `floor` are known (-1: not)."""
        lists = [x for x in (self.of(t, n) for t, n in entries) if len(x[0])]
        short = [x for x in lists if len(x[0]) * SHORT <= self.size]
        walked = [x for x in lists if len(x[0]) * SHORT > self.size]
        if short:  # term at a time
            sums = np.zeros(self.size, np.int64)
            for docs, part in short:
                sums[docs] += part
            docs = np.nonzero(sums)[0]
            walked.append((docs, sums[docs]))
        walked = sorted(((d, s, int(s.max())) for d, s in walked if len(d)), key=lambda x: x[2])
        below = np.cumsum([0] + [bound for *_, bound in walked])  # what the lists before one can add
        found_docs, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, least = 0, max(floor, 1)
        while at < self.size:
            opening = int(np.searchsorted(below[1:], least, side="left"))  # lists from here on open documents
            if opening >= len(walked):
                break
            until = min(self.size, at + BLOCK)
            sums = np.zeros(until - at, np.int64)
            for docs, part, _ in walked[opening:]:
                a, b = np.searchsorted(docs, (at, until))
                sums[docs[a:b] - at] += part[a:b]
            docs = np.nonzero(sums)[0]
            score = sums[docs]
            docs += at
            for n in range(opening - 1, -1, -1):  # probe the others, the largest bound first
                may = score + below[n + 1] >= least
                docs, score = docs[may], score[may]
                if not len(docs):
                    break
                own, part, _ = walked[n]
                place = np.minimum(np.searchsorted(own, docs), len(own) - 1)
                score = score + np.where(own[place] == docs, part[place], 0)
            keep = score >= least
            found_docs, found = np.concatenate([found_docs, docs[keep]]), np.concatenate([found, score[keep]])
            if len(found) > k:
                best = np.lexsort((found_docs, -found))[:k]
                found_docs, found = found_docs[best], found[best]
            if len(found) >= k:
                least = max(least, int(found.min()))
            at = until
        return found_docs, found


def _pass(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Per task and item the k best: item (by number), doc_id, score. asked: item, term, times of a block of items."""
    spark = docs.sparkSession
    words = [r["term"] for r in asked.select("term").distinct().orderBy("term").collect()]  # about ENTRIES at most
    vocabulary = spark.sparkContext.broadcast({w: n for n, w in enumerate(words)})
    path = fresh_path(spark, "terms")
    held = _read(docs, vocabulary, path)
    size = held.agg(F.count("*").alias("total"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    total, length = size["total"], size["words"]
    df = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weigh = F.floor(1000 * F.log(F.lit(2.0 * total + 2) / (2 * F.col("df") + 1))).cast("bigint")
    weights = np.zeros(len(words), np.int64)
    for r in df.select("term", weigh.alias("w")).collect():  # as many as words
        weights[r["term"]] = r["w"]
    entries: dict[int, list[tuple[int, int]]] = {}
    number = vocabulary.value
    for r in asked.collect():
        if weights[number[r["term"]]] > 0:
            entries.setdefault(r["item"], []).append((number[r["term"]], r["times"]))
    sent = spark.sparkContext.broadcast((entries, weights))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, weights = sent.value
        best: dict[int, list[tuple[int, object]]] = {}

        def order(x: tuple) -> tuple:
            return -x[0], x[1] is not None, x[1] or 0

        def shard(held: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(held)
            table = table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending")], null_placement="at_start")).combine_chunks()
            ids, lists, counts = (table.column(c).combine_chunks() for c in ("doc_id", "terms", "counts"))
            made = Shard(table.column("n").to_numpy(), pc.list_value_length(lists).to_numpy(), lists.flatten().to_numpy(), counts.flatten().to_numpy().astype(np.int64), weights, total, length)
            for item, asked in entries.items():
                known = best.get(item, [])
                places, scores = made.search(asked, known[-1][0] if len(known) >= k else -1, k)
                if len(places):
                    best[item] = sorted([*known, *zip(scores.tolist(), ids.take(pa.array(places)).to_pylist())], key=order)[:k]

        waiting, docs_held, postings = [], 0, 0
        for batch in batches:
            waiting.append(batch)
            docs_held += batch.num_rows
            postings += len(batch.column("terms").flatten())
            if docs_held >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                shard(waiting)
                waiting, docs_held, postings = [], 0, 0
        if docs_held:
            shard(waiting)
        rows = [(item, d, s) for item, found in best.items() for s, d in found]
        for at in range(0, len(rows), 10_000):
            item, doc, score = zip(*rows[at : at + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    found = held.select(F.col("doc_id").cast("bigint").alias("doc_id"), "n", "terms", "counts").mapInArrow(run, "item bigint, doc_id bigint, score bigint")
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))


def search(docs: DataFrame, items: DataFrame, k: int = TOP, entries: int = ENTRIES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k highest scores above 0, equal ones by doc_id."""
    spark = docs.sparkSession
    at, numbered = fresh_path(spark, "entries"), fresh_path(spark, "items")
    _entries(items).write.parquet(at)
    asked = spark.read.parquet(at)
    # A number for each item: items may have no id, and numbers are what the tasks carry.
    asked.select("item_id").distinct().withColumn("item", F.monotonically_increasing_id()).write.parquet(numbered)
    names = spark.read.parquet(numbered)
    asked = asked.withColumnRenamed("item_id", "own").join(names, F.col("own").eqNullSafe(F.col("item_id"))).select("item", "term", "times")
    blocks = max(1, -(-spark.read.parquet(at).count() // entries))
    every = None
    for n in range(blocks):
        found = _pass(docs, asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == n), k)
        every = found if every is None else every.unionByName(found)
    best = every.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))).where(F.col("rank") <= k)
    return best.join(names, "item").select("item_id", "rank", "doc_id", "score")
