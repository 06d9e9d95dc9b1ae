"""Conversations as a trie of their prefixes, by collapsing whole sequences.

`rebuild` replays each conversation: the first h turns of the conversation that its group of five begins with, then its
own turns after the first h. A node is a distinct beginning of a rebuilt conversation and is named by a chain of SHA-256
over its turns, so equal beginnings meet by name. Then

1. identical conversations collapse into one weighted sequence each, with the list of those that end there;
2. sequences whose name is the parent of a node are proper prefixes and leave by an anti join: the rest are the leaves;
3. the prefixes of the collapsed sequences, one row each with the sequence's weight, are aggregated by node.

A node belongs to the sequence with its smallest conversation; of a sequence these are the deepest nodes of its path.
So what a node passes up is a running sum along one path, and sums over subtrees need no rows beyond the prefixes.

Turns stream through sorted partitions, group of five by group of five; no conversation is held whole, but each is read
in one task, as its chain demands. A hot node (the root, a common first turn) is pre-aggregated before it is shuffled;
children look their parent up under a salt. Lists of ends are put together in blocks of neighbouring ids; the digest of
a list reads its blocks in order, one after the other, in one task, as SHA-256 demands.

Results: rows without conv_id belong to no conversation and take no part; a null turn comes first, equal turns go by
role and text, repeated rows stay turns of their own; null role and text are empty; texts of any length are hashed
whole. A conversation that is left without turns ends at the root. An empty table has no nodes. Other columns of the
table are left behind, so none can clash.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import settle

GROUP, LONGEST = 5, 9
#: Parts of a hot parent's children; ids in a block of ends.
SALTS, END_BITS = 64, 10
ROOT = hashlib.sha256(b"").digest()


def shared_turns(conv: int) -> int:
    """How many turns a conversation takes from the one its group begins with."""
    return zlib.crc32(str(conv).encode()) % LONGEST


def turn_digest(role: str | None, text: str | None) -> tuple[bytes, int]:
    """The name of a turn, and the bytes of its text."""
    role, text = (role or "").encode(), (text or "").encode()
    return hashlib.sha256(len(role).to_bytes(8, "big") + role + text).digest(), len(text)


class _Chain:
    """The nodes along one rebuilt conversation."""

    def __init__(self, conv: int):
        self.conv, self.rows, self.node = conv, [(conv, 0, ROOT, None, 0)], ROOT
        self.depth = 0

    def add(self, name: bytes, size: int) -> None:
        parent, self.depth = self.node, self.depth + 1
        self.node = hashlib.sha256(parent + name).digest()
        self.rows.append((self.conv, self.depth, self.node, parent, size))

    def take(self, last: bool) -> list[tuple]:
        """Rows so far; the newest waits until it is known whether the conversation ends there."""
        out = [(*r, False) for r in self.rows[:-1]]
        if last:
            return [*out, (*self.rows[-1], True)]
        del self.rows[:-1]
        return out


_PATHS = {"conv_id": pa.int64(), "depth": pa.int64(), "node": pa.binary(), "parent": pa.binary(), "bytes": pa.int64(), "last": pa.bool_()}


def rebuild(turns: DataFrame) -> DataFrame:
    """conv_id, depth, node, parent (null: root), bytes (of the last text), last (the conversation ends here)."""
    conv = F.col("conv_id").cast("bigint")
    rows = turns.where("conv_id is not null").select(conv.alias("conv_id"), (conv - conv % GROUP).alias("base"), "turn", "role", "text")
    dealt = rows.repartition("base").sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.asc_nulls_first("turn"), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, base, head, shared, own = None, None, [], 0, 0
        done: list[tuple] = []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), _PATHS.values())], names=list(_PATHS))

        for batch in batches:
            for conv, of, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "base", "role", "text"))):
                if chain is None or conv != chain.conv:
                    if chain is not None:
                        done += chain.take(True)
                    if of != base:
                        base, head = of, []
                    chain, own, shared = _Chain(conv), 0, 0 if conv == base else shared_turns(conv)
                    for turn in head[:shared]:
                        chain.add(*turn)
                own += 1
                if conv == base or own > shared:
                    turn = turn_digest(role, text)
                    if conv == base and own < LONGEST:
                        head.append(turn)
                    chain.add(*turn)
                if len(chain.rows) > 1000:
                    done += chain.take(False)
                if len(done) > 10_000:
                    yield flush()
                    done = []
        if chain is not None:
            done += chain.take(True)
        if done:
            yield flush()

    return dealt.select("conv_id", "base", "role", "text").mapInArrow(run, "conv_id bigint, depth bigint, node binary, parent binary, bytes bigint, last boolean")


def collapse(paths: DataFrame) -> DataFrame:
    """The distinct sequences: node, conv_id (smallest), weight, leaf (1, or 0 for a proper prefix of another)."""
    sequences = paths.where("last").groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("weight"))
    longer = paths.where("depth > 0").select(F.col("parent").alias("node")).distinct()
    leaves = sequences.join(longer, "node", "left_anti").select("node", F.lit(1).alias("leaf"))
    return sequences.join(leaves, "node", "left").withColumn("leaf", F.coalesce("leaf", F.lit(0)))


def end_digests(paths: DataFrame) -> DataFrame:
    """node, ends_sha256 of the sequences: blocks of ids in order, read one after the other."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = paths.where("last").groupBy("node", F.shiftright("conv_id", END_BITS).alias("block")).agg(listed.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            nodes, digests = [], []
            for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                if node == now:
                    digest.update(b",")
                elif digest:
                    nodes.append(now)
                    digests.append(digest.hexdigest())
                if node != now:
                    now, digest = node, hashlib.sha256()
                digest.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(digests, pa.string())], names=["node", "ends_sha256"])
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=["node", "ends_sha256"])

    return blocks.repartition("node").sortWithinPartitions("node", "block").select("node", "ids").mapInArrow(run, "node binary, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """Per node: node (its name), parent, and the columns of `report`."""
    paths = settle(rebuild(turns), "paths")
    weighed = paths.join(collapse(paths).select("conv_id", "weight", "leaf"), "conv_id")
    nodes = settle(weighed.groupBy("node", "parent", "depth", "bytes").agg(F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves")), "nodes")
    # A sequence's path and the nodes that are its own, in one sort: below each prefix, what its own nodes save, and whether the next is its own.
    own = nodes.select("conv_id", "depth", F.lit(None).cast("binary").alias("node"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saves"))
    along = weighed.select("conv_id", "depth", "node", F.lit(None).cast("bigint").alias("saves")).unionByName(own)
    down = W.partitionBy("conv_id").orderBy(F.desc("depth"))
    passed = along.select("node", F.sum("saves").over(down.rangeBetween(W.unboundedPreceding, W.currentRow)).alias("below"), F.count("saves").over(down.rangeBetween(-1, -1)).alias("next"))
    sums = passed.where("node is not null").groupBy("node").agg(F.coalesce(F.sum("below"), F.lit(0)).alias("saved_tokens"), F.sum("next").alias("n_children"))
    salted = nodes.withColumn("salt", F.pmod("conv_id", F.lit(SALTS)))
    asked = salted.where("parent is not null").select("parent", "salt").distinct()
    parents = asked.join(nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent")
    out = salted.join(parents, ["parent", "salt"], "left").join(sums, "node").join(end_digests(paths), "node", "left")
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))


def report(turns: DataFrame) -> DataFrame:
    return trie(turns).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
