"""N-gram Jaccard join: T-occurrence search with DivideSkip over inverted lists of word shingles.

Two texts link when 100 * |intersection| >= 80 * |union| of their sets of distinct 5-word
shingles. Texts with equal sets are one class, found by a digest of the set. Classes can link
only if they share m shingles (or all that they must share, if fewer) of their first
n - ceil(0.8 n) + m in any one order of all shingles, for any m; the order used puts the most
common ones last, counted over all documents.

First, each class is compared with the smallest class of the shingles that they share with
m = 3; what links becomes one component. Then only classes of different components are
compared. Those that share three shingles of few classes are found by a join. Those that share
one of many classes meet, in blocks, with longer beginnings (m is an eighth of the set), and
only those that share m are compared in full; such groups never give all their pairs. No link between components is lost, and within a group of copies the
work is in proportion to its members, not to their pairs.

The comparison is a T-occurrence search. A query set meets a block of sets: each of its
shingles has an inverted list of the sets that hold it. The longest lists are laid aside, the
short ones are merged by a heap, and sets that can still reach the required overlap T are
looked up in the long lists by binary search.

Results: null or empty texts and texts without words have no shingles and link with nothing.
Rows without doc_id have no component (null). Rows that share a doc_id share a component. Texts of any length
are cut into shingles whole, each in one task. An empty table gives an empty result. `classes` leaves other columns behind;
`keep_one` gives back docs' own columns, whatever their names. A set holds 64-bit hashes of shingles, never compared as
words; a link needs many equal ones, so a chance collision alone makes none.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import groupby
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling as R
from .components import components
from .scratch import discard, settle
from .substrings import _batch

SHINGLE = 5
PERCENT = 80
#: The most common shingles that the order knows by count, at most; a count below LEAST needs no place there.
COMMON = 1 << 16
LEAST = 50
#: Shingles that linked sets must share among their first ones: coincidences of one or two are not looked at.
SHARED = 3
#: Classes that share a shingle and are paired by a join; of more, the beginnings are searched in blocks of GROUP.
FEW = 16
GROUP = 4000
#: Ids that may be broadcast to pick documents (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Sets that one search compares with a query at once.
BLOCK = 500


_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def sets(data: np.ndarray, offsets: np.ndarray, k: int):
    """Per row the sorted hashes of its distinct shingles, of words with A-Z in lower case."""
    for a, b in R.pieces(offsets):
        base = offsets[a]
        part = _LOWER[data[base : offsets[b]]]
        starts, ends, first = R.words(part, offsets[a : b + 1] - base)
        hashes = R.Sums(part).of(starts, ends)
        for i in range(b - a):
            own = hashes[first[i] : first[i + 1]]
            yield np.unique(R.grams(own, min(k, len(own)))) if len(own) else own


def _least_overlap(n, m, percent: int):
    """The smallest intersection of sets of n and m that link."""
    return -(-percent * (n + m) // (100 + percent))


def _shared(n):
    """m for a set of n: what two linked sets share of their beginnings, at least, is m of the smaller."""
    return np.maximum(SHARED, np.asarray(n) // 8)


def common_shingles(docs: DataFrame, k: int, most: int = COMMON, least: int = LEAST) -> np.ndarray:
    """The most common shingles (the upper 32 bits of their hashes), the rarer first.

    Every document counts. Tasks send sorted values in buckets, as packed differences."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = 4 * n

    def pack(values: list[np.ndarray]) -> pa.RecordBatch:
        v = np.sort(np.concatenate(values))
        cuts = np.searchsorted(v.astype(np.uint64) * np.uint64(many) >> np.uint64(32), np.arange(many + 1))
        out: list[list] = [[], [], []]
        for b in range(many):
            if cuts[b] < cuts[b + 1]:
                step = np.diff(v[cuts[b] : cuts[b + 1]], prepend=np.uint32(0))
                planes = step.view(np.uint8).reshape(-1, 4).T.tobytes()
                for x, y in zip(out, (b, len(step), pa.compress(planes, codec="zstd", asbytes=True))):
                    x.append(y)
        return _batch(out, {"bucket": pa.int32(), "size": pa.int32(), "packed": pa.binary()})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for s in sets(*R.utf8(batch.column("text")), k):
                held.append((s >> np.uint64(32)).astype(np.uint32))
                size += len(s)
                if size > 2 << 20:
                    yield pack(held)
                    held, size = [], 0
        if size:
            yield pack(held)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((b, s, p) for batch in batches for b, s, p in zip(*(batch.column(c).to_pylist() for c in ("bucket", "size", "packed"))))
        for _, group in groupby(rows, key=lambda x: x[0]):
            every = [np.cumsum(np.ascontiguousarray(np.frombuffer(pa.decompress(p, 4 * s, codec="zstd", asbytes=True), np.uint8).reshape(4, -1).T).view(np.uint32).ravel(), dtype=np.uint32) for _, s, p in group]
            v, c = np.unique(np.concatenate(every), return_counts=True)
            keep = c >= least
            yield _batch([v[keep].astype(np.int64), c[keep]], {"v": pa.int64(), "c": pa.int64()})

    packed = docs.select("text").mapInArrow(count, "bucket int, size int, packed binary")
    found = packed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(total, "v bigint, c bigint")
    rows = found.orderBy(F.desc("c"), "v").limit(most).collect()
    return np.array([r["v"] for r in reversed(rows)], np.uint32)


def _in_order(s: np.ndarray, common: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """The first n shingles of a set in the order of all shingles."""
    if len(common):
        high = (s >> np.uint64(32)).astype(np.uint32)
        at = np.minimum(np.searchsorted(common, high), len(common) - 1)
        late = common[at] == high
        if late.any():
            rare = s[~late]
            if len(rare) >= n:
                return rare[:n]
            rest = np.lexsort((s[late], place[at[late]]))
            return np.concatenate([rare, s[late][rest]])[:n]
    return s[:n]


def fingerprints(docs: DataFrame, common: np.ndarray, k: int, percent: int) -> DataFrame:
    """doc_id, n, digest of the set, prefix (4 bytes for each of the first shingles)."""
    order = np.argsort(common)
    shared = docs.sparkSession.sparkContext.broadcast((common[order], order))  # COMMON entries at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, place = shared.value
        for batch in batches:
            out: list[list] = [[], [], []]
            for s in sets(*R.utf8(batch.column("text")), k):
                n = len(s)
                first = _in_order(s, values, place, n - -(-percent * n // 100) + _shared(n)) if n else s
                for x, v in zip(out, (n, hashlib.blake2b(s.tobytes(), digest_size=16).digest(), first.astype(np.uint32).tobytes())):
                    x.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.binary(), pa.binary())))], names=["doc_id", "n", "digest", "prefix"])

    return docs.mapInArrow(run, "doc_id bigint, n int, digest binary, prefix binary")


def _tokens(classes: DataFrame, percent: int) -> DataFrame:
    """(token, doc_id): the shingles of each beginning for m = SHARED."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                prefixes = [np.frombuffer(x.as_py(), np.int32)[: n - -(-percent * n // 100) + SHARED] for x, n in zip(part.column("prefix"), part.column("n").to_pylist())]
                sizes = [len(x) for x in prefixes]
                docs = part.column("doc_id").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(prefixes)), pa.array(np.repeat(docs, sizes))], names=["token", "doc_id"])

    return classes.mapInArrow(run, "token int, doc_id bigint")


def _found_in(ids: list, sizes: list, labels: list, sides: list, beginnings: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of different components that can still link; of two sides only across them.

    Their beginnings share enough, and what they share there with all that is left behind the
    last shared shingle reaches the overlap that their sizes require."""
    n, label, side = np.array(sizes), np.array(labels), np.array(sides)
    lengths = [len(b) for b in beginnings]
    _, token, held = np.unique(np.concatenate(beginnings), return_inverse=True, return_counts=True)
    common = held[token] > 1  # what one set alone holds here pairs nothing
    token = np.unique(token[common], return_inverse=True)[1]
    member = np.repeat(np.arange(len(ids)), lengths)[common]
    place = np.concatenate([np.arange(k) for k in lengths])[common]
    order = np.argsort(token, kind="stable")
    ends = np.cumsum(np.bincount(token))[:-1]
    lists, places = np.split(member[order], ends), np.split(place[order], ends)
    ownership = np.split(np.arange(len(token)), np.searchsorted(member, np.arange(1, len(ids))))
    several = side.min() != side.max()
    last, other_last = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    for i in range(len(ids) - 1):
        mine = ownership[i]
        if len(mine) < min(SHARED, n[i]):
            continue
        own = token[mine]
        met = np.concatenate([lists[t] for t in own])
        last[met] = np.repeat(place[mine], [len(lists[t]) for t in own])  # the last of equal members stays
        other_last[met] = np.concatenate([places[t] for t in own])
        count = np.bincount(met, minlength=len(ids))[i + 1 :]
        rest = n[i + 1 :]
        m, large = np.minimum(n[i], rest), np.maximum(n[i], rest)
        reach = count + np.minimum(n[i] - 1 - last[i + 1 :], rest - 1 - other_last[i + 1 :])
        good = (count >= np.minimum(_shared(m), -(-percent * large // 100))) & (label[i + 1 :] != label[i]) & (100 * m >= percent * large) & (reach >= _least_overlap(n[i], rest, percent))
        if several:
            good &= side[i + 1 :] != side[i]
        for j in np.flatnonzero(good).tolist():
            yield ids[i], ids[i + 1 + j]


def _crowded(rows: DataFrame, percent: int, group: int = GROUP) -> DataFrame:
    """(token, members, doc_id, component, n, prefix) of tokens of many classes to candidate pairs (q, d)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = F.ceil(F.col("members") / group).cast("int")
    placed = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("token", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "doc_id", "component", "n", "prefix")
    met = met.repartition(parts, "token", "a", "b").sortWithinPartitions("token", "a", "b", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (x for batch in batches for x in zip(*(batch.column(c).to_pylist() for c in ("token", "a", "b", "own", "doc_id", "component", "n", "prefix"))))
        for _, members in groupby(each, key=lambda x: x[:3]):
            members = list(members)  # two blocks at most
            pairs = list(_found_in([x[4] for x in members], [x[6] for x in members], [x[5] for x in members], [x[3] for x in members], [np.frombuffer(x[7], np.int32) for x in members], percent))
            if pairs:
                yield _batch(list(map(list, zip(*pairs))), {"q": pa.int64(), "d": pa.int64()})

    return met.mapInArrow(run, "q bigint, d bigint").distinct()


def full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """doc_id, n, shingles (8 bytes each, sorted) of the wanted documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            data, offsets = R.utf8(batch.column("text"))
            out: list[list] = [[], [], []]
            size = 0
            for i, s in enumerate(sets(data, offsets, k)):
                for x, v in zip(out, (ids[i].as_py(), len(s), s.tobytes())):
                    x.append(v)
                size += len(s)
                if size > 1 << 20:
                    yield _batch(out, {"doc_id": pa.int64(), "n": pa.int32(), "shingles": pa.binary()})
                    out, size = [[], [], []], 0
            yield _batch(out, {"doc_id": pa.int64(), "n": pa.int32(), "shingles": pa.binary()})

    wanted = settle(wanted, "wanted")
    picked = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    return docs.join(picked, "doc_id", "left_semi").mapInArrow(run, "doc_id bigint, n int, shingles binary")


def divide_skip(query: np.ndarray, block: list[np.ndarray], percent: int = PERCENT) -> list[int]:
    """The places in the block of the sets that link with the query."""
    sizes = np.array([len(s) for s in block])
    need = _least_overlap(len(query), sizes, percent)
    # inverted lists of the query's shingles over the block
    every = np.concatenate(block)
    at = np.minimum(np.searchsorted(query, every), len(query) - 1)
    held = query[at] == every
    lists, members = at[held], np.repeat(np.arange(len(block)), sizes)[held]
    order = np.lexsort((members, lists))
    lists, members = lists[order], members[order]
    lengths = np.bincount(lists, minlength=len(query))
    starts = np.cumsum(lengths) - lengths
    t = int(need.min())
    longest = int(lengths.max(initial=0))
    if not longest:
        return []
    aside = min(t - 1, int(t / (0.01 * log2(longest + 1) + 1)))
    by_length = np.argsort(-lengths, kind="stable")
    long, short = by_length[:aside], by_length[aside:]
    found, counts = [], []
    for member, run in groupby(heapq.merge(*(members[starts[x] : starts[x] + lengths[x]].tolist() for x in short if lengths[x]))):
        c = sum(1 for _ in run)
        if c + aside >= need[member]:
            found.append(member)
            counts.append(c)
    if not found:
        return []
    keys = lists * len(block) + members  # sorted: binary search in all long lists at once
    probe = (long[:, None] * len(block) + np.array(found)[None, :]).ravel()
    where = np.minimum(np.searchsorted(keys, probe), len(keys) - 1)
    more = (keys[where] == probe).reshape(len(long), len(found)).sum(axis=0)
    return [m for m, c, x in zip(found, counts, more) if c + x >= need[m]]


def linked(pairs: DataFrame, docs: DataFrame, k: int, percent: int, block: int = BLOCK) -> DataFrame:
    """The pairs (q, d) of documents whose sets link; a query of many pairs is searched in blocks."""
    held = settle(full_sets(docs, pairs.select(F.col("q").alias("doc_id")).union(pairs.select("d")).distinct(), k), "sets")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = pairs.groupBy("q").agg(F.ceil(F.count("*") / block).cast("int").alias("salts"))
    salted = pairs.join(sizes, "q").select("q", "d", F.pmod(F.xxhash64("d"), F.col("salts")).alias("salt"))
    right = salted.join(held, salted.d == held.doc_id).select("q", "salt", F.lit(1).alias("kind"), "d", "shingles")
    left = (sizes.select("q", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts").cast("bigint") - 1)).alias("salt"))
            .join(held, F.col("q") == F.col("doc_id")).select("q", "salt", F.lit(0).alias("kind"), F.col("q").alias("d"), "shingles"))
    rows = left.unionByName(right).repartition(n, "q", "salt").sortWithinPartitions("q", "salt", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (x for batch in batches for x in zip(*(batch.column(c).to_pylist() for c in ("q", "salt", "kind", "d", "shingles"))))
        out: list[list] = [[], []]
        for (q, _), group in groupby(each, key=lambda x: x[:2]):
            query, ids, held_sets = None, [], []

            def search():
                for m in divide_skip(query, held_sets, percent) if ids else ():
                    out[0].append(q)
                    out[1].append(ids[m])

            for _, _, kind, d, s in group:
                if kind == 0:
                    query = np.frombuffer(s, np.uint64)
                    continue
                ids.append(d)
                held_sets.append(np.frombuffer(s, np.uint64))
                if len(ids) >= block:
                    search()
                    ids, held_sets = [], []
            search()
            if len(out[0]) > 10000:
                yield _batch(out, {"u": pa.int64(), "v": pa.int64()})
                out = [[], []]
        yield _batch(out, {"u": pa.int64(), "v": pa.int64()})

    return rows.mapInArrow(run, "u bigint, v bigint")


def classes(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    docs = docs.select("doc_id", "text")
    prints = settle(fingerprints(docs, common_shingles(docs, shingle), shingle, percent), "prints")
    some = prints.where("n > 0 and doc_id is not null")
    sizes = some.groupBy("doc_id").agg(F.max("n").alias("n"))
    firsts = some.groupBy("digest").agg(F.min(F.struct("doc_id", "n", "prefix")).alias("f")).select("f.*")
    tokens = settle(_tokens(firsts, percent), "tokens")
    held = settle(tokens.groupBy("token").agg(F.count("*").alias("members"), F.min("doc_id").alias("first")).where("members > 1"), "held")
    shared = settle(tokens.join(held, "token"), "shared")  # two written tables: Spark can split the join at a common token
    discard(tokens, held)
    large = F.greatest("n", "m")
    near = (100 * F.least("n", "m") >= percent * large) & (F.col("c") >= F.least(F.lit(SHARED), F.ceil(percent * large / 100)))
    stars = shared.where("doc_id <> first").groupBy(F.col("first").alias("q"), F.col("doc_id").alias("d")).agg(F.count("*").alias("c"))
    stars = stars.join(sizes.select(F.col("doc_id").alias("q"), "n"), "q").join(sizes.select(F.col("doc_id").alias("d"), F.col("n").alias("m")), "d")
    stars = settle(stars.where(near).select("q", "d"), "pairs")
    found = settle(linked(stars, docs, shingle, percent), "found")
    joined = settle(components(found), "joined")
    label = shared.select("token", "members", "doc_id").join(joined.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    open_ = label.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("token")
    label = settle(label.join(open_, "token", "left_semi").join(sizes, "doc_id"), "open")
    few, many = label.where(F.col("members") <= FEW), label.where(F.col("members") > FEW)
    x = few.select("token", F.col("doc_id").alias("q"), "component", "n")
    y = few.select("token", F.col("doc_id").alias("d"), F.col("component").alias("other"), F.col("n").alias("m"))
    pairs = x.join(y, "token").where((F.col("q") < F.col("d")) & (F.col("component") != F.col("other")) & (100 * F.least("n", "m") >= percent * large))
    pairs = pairs.groupBy("q", "d", "n", "m").agg(F.count("*").alias("c")).where(near).select("q", "d")
    crowded = many.join(some.select("doc_id", "prefix").join(many.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id")
    pairs = pairs.union(_crowded(crowded, percent)).distinct().join(stars, ["q", "d"], "left_anti")
    more = settle(linked(settle(pairs, "pairs"), docs, shingle, percent), "found")
    final = components(found.unionByName(more))
    member = some.groupBy("digest").agg(F.min("doc_id").alias("id")).join(final, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    return (prints.join(member, "digest", "left")
            .select("doc_id", F.col("n").cast("bigint").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))).alias("component_id")))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents, in their own columns, less those that link (in steps) to one of a smaller doc_id."""
    gone = classes(docs, **options).where("component_id <> doc_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
