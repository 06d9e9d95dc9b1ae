"""Substring dedup by words, with a log-structured index of window fingerprints.

Each document keeps the fingerprints of some of its 6-word windows: of every 15 neighbours the
one of the smallest hash, so that each 20-word window holds one that depends on its own words
alone. The index is a log of immutable runs, tables sorted by fingerprint and bucketed alike, in the shared folder.
A new batch becomes a run, is merge-joined with the runs before it, and full runs are compacted
into one; a log kept from earlier jobs takes further batches (`dedup(new, log=..., old=...)`). Only windows around fingerprints that come again are looked at: they are verified by
a 128-bit digest of all their words, and every window that is not the first of its words is
removed. Copies of a whole text are answered from the text's digest and are not indexed.

Results: windows are judged on the input, not on what is left. Null texts have no words. A row
without doc_id takes no part and is returned whole. Rows sharing a doc_id share what is removed
from that id. Fewer than 20 words: nothing is removed. Texts of any length are read whole, each in one task. An
empty table gives an empty result. Other columns are left behind, so none can clash.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rolling as R
from .scratch import drop_path, fresh_path, settle

WINDOW = 20
GRAM = 6
BATCHES = 3
FANOUT = 2
#: Occurrences of a fingerprint that one group compares; more are salted by document and place.
GROUP = 500


_RUN = "fp BIGINT, doc_id BIGINT, n INT"


class RunLog:
    """Immutable sorted runs (fp, doc_id, n) in a folder: bucketed tables, whose merge joins need no shuffle.

    The folder is in spark.checkpoint.dir or wherever `at` says. It outlives the job: a later one opens it by its path and
    adds batches. A run counts from the moment a manifest names it; a job that fails leaves the manifest before as it was."""

    def __init__(self, spark: SparkSession, at: str | None = None, buckets: int | None = None, fanout: int = FANOUT):
        self.spark, self.at, self.fanout = spark, at or fresh_path(spark, "runs"), fanout
        self.buckets, self.runs, self.version = buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), [], 0
        try:
            manifest = spark.read.parquet(f"{self.at}/manifest")
        except AnalysisException:
            return  # a new log
        self.version = manifest.agg(F.max("version")).first()[0]
        for r in manifest.where(F.col("version") == self.version).orderBy("place").collect():
            self.buckets = r["buckets"]
            self.runs.append((r["run"], self._table(r["run"])))

    def _table(self, run: str) -> str:
        name = f"docloom_{run}_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} ({_RUN}) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {self.buckets} BUCKETS LOCATION '{self.at}/{run}'")
        return name

    def _write(self, rows: DataFrame) -> tuple[str, str]:
        run = f"run_{uuid.uuid4().hex}"
        name = f"docloom_{run}"
        (rows.select("fp", "doc_id", "n").repartition(self.buckets, "fp").write.format("parquet").option("compression", "zstd").option("path", f"{self.at}/{run}")
         .bucketBy(self.buckets, "fp").sortBy("fp").saveAsTable(name))
        return run, name

    def _commit(self, runs: list[tuple[str, str]]) -> None:
        rows = [(i, run, self.buckets) for i, (run, _) in enumerate(runs)]
        self.spark.createDataFrame(rows, "place int, run string, buckets int").coalesce(1).write.parquet(f"{self.at}/manifest/version={self.version + 1}")
        old = [x for x in self.runs if x not in runs]
        self.version, self.runs = self.version + 1, runs
        for run, name in old:
            self.spark.sql(f"DROP TABLE {name}")
            drop_path(self.spark, f"{self.at}/{run}")

    def append(self, rows: DataFrame) -> DataFrame:
        """Write the rows as a run; returns it."""
        run = self._write(rows)
        self._commit([*self.runs, run])
        return self.spark.table(run[1])

    def compact(self) -> None:
        """Merge all runs into one once there are more than `fanout`."""
        if len(self.runs) > self.fanout:
            self._commit([self._write(self.history())])

    def history(self) -> DataFrame | None:
        out = None
        for _, name in self.runs:
            run = self.spark.table(name)
            out = run if out is None else out.unionByName(run)
        return out

    def add(self, batch: DataFrame) -> DataFrame:
        """Index a batch (doc_id, fps); returns (fp, n), the fingerprints of the batch that stand twice at least in all, with their count."""
        history = self.history()
        run = self.append(spread(batch))
        again = settle(repeated(run, history), "again")
        self.compact()
        return again

    def close(self) -> None:
        """Forget the tables; the folder stays."""
        for _, name in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def drop(self) -> None:
        self.close()
        self.runs = []
        drop_path(self.spark, self.at)


def _marks(data, offsets, window, gram):
    """Per row: fingerprints (hashes of its chosen grams), the owning place of each window, the word bounds."""
    for a, b in R.pieces(offsets):
        base = offsets[a]
        part, offs = data[base : offsets[b]], offsets[a : b + 1] - base
        starts, ends, first = R.words(part, offs)
        hashes = R.Sums(part).of(starts, ends)
        for i in range(b - a):
            lo, hi = first[i], first[i + 1]
            g = R.grams(hashes[lo:hi], gram) if hi - lo >= window else np.zeros(0, np.uint64)
            own = R.owners(g, window - gram + 1)
            yield a + i, g, own, part, starts[lo:hi], ends[lo:hi]


def fingerprints(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, whole (SHA-256 of the text), fps (binary, 8 bytes each: one per chosen gram)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = R.utf8(batch.column("text"))
            fps = [g[own[np.flatnonzero(np.diff(own, prepend=-1))]].tobytes() for _, g, own, _, _, _ in _marks(data, offsets, window, gram)]
            whole = [hashlib.sha256(data[offsets[i] : offsets[i + 1]]).digest() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(whole, pa.binary()), pa.array(fps, pa.binary())], names=["doc_id", "whole", "fps"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, whole binary, fps binary")


def spread(rows: DataFrame) -> DataFrame:
    """(doc_id, fps) to rows (fp, doc_id, n), n times that fp stands in the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                out = [[], [], []]
                for doc, fps in zip(part.column("doc_id").to_numpy(zero_copy_only=False), part.column("fps")):
                    found, n = np.unique(np.frombuffer(fps.as_py(), np.int64), return_counts=True)
                    out[0].append(found)
                    out[1].append(np.full(len(found), doc, np.int64))
                    out[2].append(n.astype(np.int32))
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["fp", "doc_id", "n"])

    return rows.mapInArrow(run, "fp bigint, doc_id bigint, n int")


def repeated(batch: DataFrame, history: DataFrame | None) -> DataFrame:
    """(fp, n): the fingerprints that stand in the batch and twice at least in all, with their count."""
    own = batch.groupBy("fp").agg(F.sum("n").alias("n"))
    if history is None:
        return own.where("n > 1")
    past = history.groupBy("fp").agg(F.sum("n").alias("m"))
    return own.join(past.hint("merge"), "fp", "left").select("fp", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n")).where("n > 1")


def candidates(unique: DataFrame, log: RunLog, batches: int = BATCHES) -> DataFrame:
    """Index the documents batch by batch; per document of the log the fingerprints that came again, with their counts."""
    cuts = sorted(set(unique.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01))) if batches > 1 else []
    edges = [None, *map(int, cuts), None]
    again = None
    for low, high in zip(edges, edges[1:]):
        part = unique
        part = part.where(F.col("doc_id") > low) if low is not None else part
        part = part.where(F.col("doc_id") <= high) if high is not None else part
        found = log.add(part)
        again = found if again is None else again.unionByName(found)
    again = again.groupBy("fp").agg(F.max("n").alias("n"))
    pairs = log.history().select("fp", "doc_id").join(again.hint("merge"), "fp")
    return settle(pairs.groupBy("doc_id").agg(F.collect_list("fp").alias("fps"), F.collect_list("n").alias("ns")), "candidates")


def _windows(marked: DataFrame, window: int, gram: int, group: int) -> DataFrame:
    """Documents with their repeated fingerprints to rows (fp, salted, salt, doc_id, start, keys): one for
    each chosen gram that comes again, with the digests of the windows that own it, from `start` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.flatnonzero(batch.column("fps").is_valid().to_numpy(zero_copy_only=False))
            batch = batch.take(pa.array(keep))
            data, offsets = R.utf8(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            out: list[list] = [[] for _ in _ROWS]
            size = 0
            for i, g, own, part, starts, ends in _marks(data, offsets, window, gram):
                if not len(own):
                    continue
                fps = np.array(batch.column("fps")[i].as_py(), np.int64)
                ns = np.array(batch.column("ns")[i].as_py(), np.int64)
                order = np.argsort(fps)
                fps, ns = fps[order], ns[order]
                edge = np.flatnonzero(np.diff(own, prepend=-1))
                mine = g[own[edge]].view(np.int64)
                at = np.minimum(np.searchsorted(fps, mine), len(fps) - 1)
                hit = np.flatnonzero(fps[at] == mine)
                if not len(hit):
                    continue
                upto = np.append(edge[1:], len(own))
                raw = part.tobytes()
                text = b" ".join([raw[s:e] for s, e in zip(starts.tolist(), ends.tolist())])
                cut = np.concatenate([[0], np.cumsum(ends - starts + 1)]).tolist()
                for k in hit.tolist():
                    a, b = int(edge[k]), int(upto[k])
                    n = int(ns[at[k]])
                    keys = b"".join([hashlib.blake2b(text[cut[s] : cut[s + window] - 1], digest_size=16).digest() for s in range(a, b)])
                    for x, v in zip(out, (int(mine[k]), n > group, (ids[i] * 1_000_003 + a) % -(-n // group), ids[i], a, keys)):
                        x.append(v)
                    size += 16 * (b - a)
                if size > 4 << 20:
                    yield _batch(out, _ROWS)
                    out, size = [[] for _ in _ROWS], 0
            if out[0]:
                yield _batch(out, _ROWS)

    return marked.mapInArrow(run, "fp bigint, salted boolean, salt bigint, doc_id bigint, start int, keys binary")


_ROWS = {"fp": pa.int64(), "salted": pa.bool_(), "salt": pa.int64(), "doc_id": pa.int64(), "start": pa.int32(), "keys": pa.binary()}
_FOUND = {"doc_id": pa.int64(), "lo": pa.int32(), "hi": pa.int32(), "key": pa.binary()}


def _batch(columns: list[list], kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds.values())], names=list(kinds))


def _later(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, lo, hi, key), from rows that come sorted within (fp, salt): windows lo..hi-1 of which
    the group holds an earlier one (key null); of salted groups also the first of each key, alone with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, seen = None, set()
        for batch in batches:
            out: list[list] = [[], [], [], []]

            def put(*values):
                for x, v in zip(out, values):
                    x.append(v)

            for fp, salted, salt, doc, start, keys in zip(*(batch.column(c).to_pylist() for c in _ROWS)):
                if (fp, salt) != group:
                    group, seen = (fp, salt), set()
                low, end = None, start + len(keys) // 16
                for at in range(start, end):
                    key = keys[16 * (at - start) : 16 * (at - start) + 16]
                    if key in seen:
                        low = at if low is None else low
                        continue
                    seen.add(key)
                    if low is not None:
                        put(doc, low, at, None)
                        low = None
                    if salted:
                        put(doc, at, at + 1, key)
                if low is not None:
                    put(doc, low, end, None)
            yield _batch(out, _FOUND)

    return rows.mapInArrow(run, "doc_id bigint, lo int, hi int, key binary")


def removed(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, group: int = GROUP, log: RunLog | None = None, old: DataFrame | None = None) -> DataFrame:
    """doc_id, lo, hi: the starts lo..hi-1 of windows whose words start earlier too.

    With a log kept from earlier jobs, docs are one more batch, and `old` are the documents indexed before, of smaller
    ids, of which only those that share a fingerprint are read for words. Ranges are given for docs alone."""
    docs = docs.select("doc_id", "text")
    spark = docs.sparkSession
    firsts = settle(fingerprints(docs.where("doc_id is not null"), window, gram).groupBy("whole").agg(F.min(F.struct("doc_id", "fps")).alias("first")).select("whole", "first.*"), "firsts")
    unique = firsts.where(F.length("fps") > 0).select("doc_id", "fps")
    whole = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    copies = (docs.where(F.length("text") >= 2 * window - 1).select("doc_id", whole.alias("whole"))
              .join(firsts.select("whole", F.col("doc_id").alias("first")), "whole")
              .where("doc_id > first").select("doc_id", F.lit(0).alias("lo"), F.lit(2**31 - 1).alias("hi")))
    own = log or RunLog(spark)
    try:
        found = candidates(unique, own, batches)
    finally:
        own.close() if log else own.drop()
    every = docs if old is None else docs.unionByName(old.select("doc_id", "text").join(found.select("doc_id"), "doc_id", "left_semi"))
    marked = every.join(found, "doc_id", "left")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _windows(marked, window, gram, group).repartition(n, "fp", "salt").sortWithinPartitions("fp", "salt", "doc_id", "start")
    later = _later(rows)
    between = (later.where("key is not null").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("doc_id", "lo"))).alias("at"))  # one of each salt
               .select(F.explode(F.slice("at", F.lit(2), F.size("at"))).alias("at")).select("at.doc_id", "at.lo", (F.col("at.lo") + 1).alias("hi")))
    ranges = later.where("key is null").select("doc_id", "lo", "hi").unionByName(between)
    if old is not None:
        ranges = ranges.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    return ranges.unionByName(copies)


def _kept(found: list[bytes], ranges, window: int) -> list[bytes]:
    if not ranges or len(found) < window:
        return found
    edge, last = np.zeros(len(found) + 1, np.int32), len(found) - window + 1
    for r in ranges:
        if r["lo"] < last:
            edge[r["lo"]] += 1
            edge[min(r["hi"], last) + window - 1] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    return [w for w, g in zip(found, gone.tolist()) if not g]


def dedup(docs: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words joined by one space)."""
    docs = docs.select("doc_id", "text")
    ranges = removed(docs, window, **options).groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, kept = [], [], []
            for text, r in zip(batch.column("text"), batch.column("ranges")):
                found = (text.as_py() or "").encode("utf-8").split()
                left = _kept(found, r.as_py(), window)
                sizes.append(len(found))
                gone.append(len(found) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])

    return docs.join(ranges, "doc_id", "left").mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept binary").withColumn("kept", F.col("kept").cast("string"))


def report(docs: DataFrame, **options) -> DataFrame:
    return dedup(docs, **options).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
