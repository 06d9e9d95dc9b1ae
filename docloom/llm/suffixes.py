"""Substring dedup by bytes: suffix arrays made by two-stage sorting, over content-routed pieces.

A string that stands twice is found where its two places meet. Of every 225 neighbouring 32-byte
grams the one of the smallest hash is kept, so that each 256-byte string owns a gram that depends
on its own bytes alone; equal strings own equal grams. For each gram that stands twice or more, the
strings that own it, and what follows them to 400 bytes, form a segment. Equal segments are counted
and kept once, then the segments of a gram meet in one task, which sorts their suffixes in two
stages: those smaller than their successor directly, the rest by bucket scans from their successors.
Neighbours with a common prefix of 400 bytes stand twice and are removed; those with one of 256 bytes
(about 50 words) are reported as repeated and stay.

A gram whose distinct segments exceed `GROUP_BYTES` does not go to one task: the digests of its
strings are counted by Spark instead, which gives the same answer. Copies of a whole text are
answered from its digest; one of them takes part in the search.

Results: strings are judged on the input. Null texts count as empty. Rows without doc_id take
no part and stay whole; rows that share a doc_id share what is removed from that id. Texts of any length are cut
into segments whole, each in one task. An empty table gives an empty result. Other columns are left behind, so none can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling as R
from .scratch import settle
from .substrings import _batch, spread

LENGTH = 400
#: Bytes of the strings that are reported as repeated, though they stay where they have fewer than LENGTH.
NEAR = 256
GRAM = 32
BATCH_BYTES = 1 << 20
GROUP_BYTES = 16 << 20


def suffix_order(raw: bytes, starts: np.ndarray, counts: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of raw that begin at starts[k] .. starts[k]+counts[k]-1, sorted by their first `depth` bytes.

    Each piece ends in a byte that begins no suffix asked for. Suffixes smaller than their
    successor are sorted directly; every other suffix is induced from its successor, bucket by
    bucket. For this, each piece is sorted on to the next suffix of the first kind."""
    text = np.frombuffer(raw, np.uint8)
    n = len(text)
    differs = np.append(text[:-1] != text[1:], True)
    places = np.where(differs, np.arange(n), n)
    ahead = np.minimum.accumulate(places[::-1])[::-1]  # the end of each run of one byte
    small = np.append(text[1:], 255)[ahead] > text[ahead]
    small[-1] = True
    seeds_from = np.where(small, np.arange(n), n)
    next_small = np.minimum.accumulate(seeds_from[::-1])[::-1]
    ends = next_small[starts + counts]  # the last suffix sorted of each piece, always of the first kind
    chosen = np.zeros(n + 1, np.int32)
    np.add.at(chosen, starts, 1)
    np.add.at(chosen, ends + 1, -1)
    chosen = np.cumsum(chosen[:-1]) > 0
    direct = np.array(sorted(np.flatnonzero(chosen & small).tolist(), key=lambda i: raw[i : i + depth]), dtype=np.int64)
    induced = np.append(chosen & ~small, False)  # the last stands for the place before the first
    buckets: list[list[np.ndarray]] = [[] for _ in range(256)]
    cuts = np.searchsorted(text[direct], np.arange(257))

    def induce(found: np.ndarray) -> None:
        before = found - 1
        before = before[induced[before]]
        if len(before):
            byte = text[before]
            order = np.argsort(byte, kind="stable")
            before, byte = before[order], byte[order]
            edges = np.flatnonzero(np.diff(byte)) + 1
            for part in np.split(before, edges):
                buckets[text[part[0]]].append(part)

    out = []
    for c in range(256):
        k = 0
        while k < len(buckets[c]):  # grows while runs of c are induced
            induce(buckets[c][k])
            k += 1
        out += buckets[c]
        mine = direct[cuts[c] : cuts[c + 1]]
        induce(mine)
        out.append(mine)
    order = np.concatenate(out)
    wanted = np.zeros(n + 1, np.int32)
    np.add.at(wanted, starts, 1)
    np.add.at(wanted, starts + counts, -1)
    return order[(np.cumsum(wanted[:-1]) > 0)[order]]


def common_prefixes(raw: bytes, order: np.ndarray, length: int) -> np.ndarray:
    """Whether neighbours in the order share their first `length` bytes, compared eight at a time."""
    padded = raw + bytes(8)
    eights = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    same = np.arange(len(order) - 1)
    for at in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        same = same[eights[order[same] + at] == eights[order[same + 1] + at]]
    out = np.zeros(max(len(order) - 1, 0), bool)
    out[same] = True
    return out


def repeated_starts(segments: list[bytes], counts: list[int], near: int, length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each segment, which of its first `counts` strings of `near` bytes also begin elsewhere in the list, and which of `length` bytes."""
    raw = b"".join(s + b"\0" for s in segments)
    sizes, counts = np.array([len(s) + 1 for s in segments]), np.array(counts)
    starts = np.cumsum(sizes) - sizes
    order = suffix_order(raw, starts, counts, length)
    reach = np.repeat(starts + sizes - 1, sizes)  # where the segment of each place ends
    flags = []
    for size, some in ((near, order), (length, order[order + length <= reach[order]])):
        equal = common_prefixes(raw, some, size)
        flag = np.zeros(len(raw), bool)
        flag[some[:-1][equal]] = True
        flag[some[1:][equal]] = True
        flags.append(flag)
    return [tuple(flag[s : s + c] for flag in flags) for s, c in zip(starts, counts)]


def runs(flag: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flag.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _marks(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Per row the hashes of its grams and the owned place of each string."""
    for a, b in R.pieces(offsets):
        sums = R.Sums(data[offsets[a] : offsets[b]])
        for i in range(a, b):
            lo, hi = offsets[i] - offsets[a], offsets[i + 1] - offsets[a]
            if hi - lo < length:
                yield i, np.zeros(0, np.uint64), np.zeros(0, np.int64)
                continue
            at = np.arange(lo, hi - gram + 1)
            g = sums.of(at, at + gram)
            yield i, g, R.owners(g, length - gram + 1)


def fingerprints(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """doc_id, whole (SHA-256 of the text), fps (8 bytes for each owned gram)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = R.utf8(batch.column("text"))
            fps = [g[own[np.flatnonzero(np.diff(own, prepend=-1))]].tobytes() for _, g, own in _marks(data, offsets, length, gram)]
            whole = [hashlib.sha256(data[offsets[i] : offsets[i + 1]]).digest() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(whole, pa.binary()), pa.array(fps, pa.binary())], names=["doc_id", "whole", "fps"])

    return docs.mapInArrow(run, "doc_id bigint, whole binary, fps binary")


_SEGMENT = {"fp": pa.int64(), "digest": pa.binary(), "doc_id": pa.int64(), "at": pa.int32(), "starts": pa.int32(), "segment": pa.binary()}
_FLAGGED = {"fp": pa.int64(), "digest": pa.binary(), "lo": pa.int32(), "hi": pa.int32(), "size": pa.int32()}
_STRING = {"key": pa.binary(), "fp": pa.int64(), "digest": pa.binary(), "lo": pa.int32(), "size": pa.int32()}


def segments(marked: DataFrame, near: int, length: int, gram: int) -> DataFrame:
    """Documents with their repeated grams to the segments of strings that own one: `starts` strings begin in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.take(pa.array(np.flatnonzero(batch.column("fps").is_valid().to_numpy(zero_copy_only=False))))
            data, offsets = R.utf8(batch.column("text"))
            out, size = [[] for _ in _SEGMENT], 0
            for i, g, own in _marks(data, offsets, near, gram):
                if not len(own):
                    continue
                fps = np.sort(np.array(batch.column("fps")[i].as_py(), np.int64))
                edge = np.flatnonzero(np.diff(own, prepend=-1))
                upto = np.append(edge[1:], len(own))
                mine = g[own[edge]].view(np.int64)
                hit = np.flatnonzero(fps[np.minimum(np.searchsorted(fps, mine), len(fps) - 1)] == mine)
                doc = batch.column("doc_id")[i].as_py()
                for k in hit.tolist():
                    a, b = int(edge[k]), int(upto[k])
                    s = data[offsets[i] + a : min(offsets[i] + b - 1 + length, offsets[i + 1])].tobytes()
                    for x, v in zip(out, (int(mine[k]), hashlib.blake2b(s, digest_size=16).digest(), doc, a, b - a, s)):
                        x.append(v)
                    size += len(s)
                if size > 4 << 20:
                    yield _batch(out, _SEGMENT)
                    out, size = [[] for _ in _SEGMENT], 0
            if out[0]:
                yield _batch(out, _SEGMENT)

    return marked.mapInArrow(run, "fp bigint, digest binary, doc_id bigint, at int, starts int, segment binary")


def _sorted_groups(rows: DataFrame, near: int, length: int) -> DataFrame:
    """Distinct segments, sorted by fp, to the ranges of strings of each size that stand in two of them."""

    def flagged(group: list) -> pa.RecordBatch:
        out: list[list] = [[] for _ in _FLAGGED]
        for (fp, digest, _, _), flags in zip(group, repeated_starts([x[3] for x in group], [x[2] for x in group], near, length)):
            for size, flag in zip((near, length), flags):
                for lo, hi in runs(flag):
                    for x, v in zip(out, (fp, digest, lo, hi, size)):
                        x.append(v)
        return _batch(out, _FLAGGED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, size, last = [], 0, None
        for batch in batches:
            for fp, digest, starts, segment in zip(*(batch.column(c).to_pylist() for c in ("fp", "digest", "starts", "segment"))):
                if size > BATCH_BYTES and fp != last:
                    yield flagged(group)
                    group, size = [], 0
                group.append((fp, digest, starts, segment))
                size += len(segment)
                last = fp
        if group:
            yield flagged(group)

    return rows.mapInArrow(run, "fp bigint, digest binary, lo int, hi int, size int")


def _counted(rows: DataFrame, near: int, length: int) -> DataFrame:
    """The same ranges for grams with too many segments for one task, from counts of string digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fp, digest, starts, s in zip(*(batch.column(c).to_pylist() for c in ("fp", "digest", "starts", "segment"))):
                for size in (near, length):
                    n = min(starts, max(0, len(s) - size + 1))
                    yield _batch([[hashlib.blake2b(s[k : k + size], digest_size=16).digest() for k in range(n)], [fp] * n, [digest] * n, list(range(n)), [size] * n], _STRING)

    strings = rows.mapInArrow(run, "key binary, fp bigint, digest binary, lo int, size int")
    twice = strings.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    return strings.join(twice, "key", "left_semi").select("fp", "digest", "lo", (F.col("lo") + 1).alias("hi"), "size")


def repeated(docs: DataFrame, length: int = LENGTH, near: int = NEAR, gram: int = GRAM, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, lo, hi, size: bytes lo..hi-1 are covered by strings of `size` bytes (near or length) that also begin elsewhere."""
    docs = docs.select("doc_id", "text")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = docs.where("doc_id is not null")
    firsts = settle(fingerprints(known, near, gram).groupBy("whole").agg(F.min(F.struct("doc_id", "fps")).alias("first"), F.count("*").alias("copies")).select("whole", "first.*", "copies"), "texts")
    bytes_ = F.octet_length(F.coalesce("text", F.lit("")))
    copied = (known.where(bytes_ >= near).select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("whole"), F.when(bytes_ >= length, length).otherwise(near).alias("size"))
              .join(firsts.where("copies > 1").select("whole"), "whole").select("doc_id", F.lit(0).alias("lo"), F.lit(2**31 - 1).alias("hi"), "size"))
    pairs = spread(firsts.where(F.length("fps") > 0).select("doc_id", "fps"))
    again = pairs.groupBy("fp").agg(F.sum("n").alias("n")).where("n > 1").select("fp")
    wanted = pairs.join(again, "fp", "left_semi").groupBy("doc_id").agg(F.collect_list("fp").alias("fps"))
    parts = settle(segments(docs.join(wanted, "doc_id", "left"), near, length, gram), "segments")
    # equal bytes own equal grams, so equal segments have equally many starts
    distinct = settle(parts.groupBy("fp", "digest").agg(F.count("*").alias("copies"), F.first("starts").alias("starts"), F.first("segment").alias("segment")), "distinct")
    sizes = distinct.groupBy("fp").agg(F.sum(F.length("segment")).alias("size"), F.count("*").alias("members")).where("members > 1")
    apart = distinct.join(sizes, "fp")
    columns = ["fp", "digest", "starts", "segment"]
    meet = apart.where(F.col("size") <= group_bytes).select(columns).repartition(n, "fp").sortWithinPartitions("fp")
    many = apart.where(F.col("size") > group_bytes).select(columns)
    upto = lambda size: F.struct(F.lit(0).alias("lo"), F.least("starts", F.length("segment") - size + 1).alias("hi"), F.lit(size).alias("size"))
    same = distinct.where("copies > 1").select("fp", "digest", F.inline(F.array(upto(near), upto(length)))).where("hi > 0")
    flagged = _sorted_groups(meet, near, length).unionByName(_counted(many, near, length)).unionByName(same)
    found = parts.select("fp", "digest", "doc_id", "at").join(flagged, ["fp", "digest"])
    return found.select("doc_id", (F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi") + F.col("size") - 1).alias("hi"), "size").unionByName(copied)


def _merged(ranges, end: int) -> list[list[int]]:
    """Ranges cut at the end of the text, and joined where they meet."""
    spans: list[list[int]] = []
    for lo, hi in sorted((lo, min(hi, end)) for lo, hi in ranges):
        if hi <= lo:
            continue
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], hi)
        else:
            spans.append([lo, hi])
    return spans


def dedup(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, n_repeated (bytes in repeated strings of `near` bytes at least), kept (the remaining bytes)."""
    docs = docs.select("doc_id", "text")
    ranges = repeated(docs, length, **options).groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi", "size")).alias("ranges"))
    kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "n_repeated": pa.int64(), "kept": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            for doc, text, found in zip(*(batch.column(c) for c in ("doc_id", "text", "ranges"))):
                raw, kept, reach = (text.as_py() or "").encode("utf-8"), [], 0
                found = found.as_py() or ()
                spans = _merged(((r["lo"], r["hi"]) for r in found if r["size"] == length), len(raw))
                for lo, hi in spans:
                    kept.append(raw[reach:lo])
                    reach = hi
                kept.append(raw[reach:])
                left = b"".join(kept)
                seen = sum(hi - lo for lo, hi in _merged(((r["lo"], r["hi"]) for r in found), len(raw)))
                for x, v in zip(out, (doc.as_py(), len(raw), len(raw) - len(left), len(spans), seen, left)):
                    x.append(v)
            yield _batch(out, kinds)

    return docs.join(ranges, "doc_id", "left").mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, n_repeated bigint, kept binary")


def report(docs: DataFrame, **options) -> DataFrame:
    return dedup(docs, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_repeated")
