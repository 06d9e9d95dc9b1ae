"""Approximate nearest neighbours by stable projections, kd-trees and a chi-square stopping test.

The largest inner product is the smallest distance once every vector gets one more component
that brings all to the norm of the longest. Projected on m Gaussian directions, the square of a
distance over its projection's follows chi-square with m degrees. So points are visited in the
order of their projected distance, from the leaves of a kd-tree, and verified by their true
inner product, until the test says that a point better than the k-th found would have come
earlier with probability `CONFIDENCE`.

The rows are cut into cells by a kd-tree over the projections, its splits fitted on at most
`SAMPLE` rows (every row is indexed), and large cells into blocks of about `BLOCK` rows, each
with a tree of its own. A query first visits the cell it lies in; the distance to its k-th
neighbour there decides by the same test which other cells it visits. Equal vectors are one
entry with their k + 1 smallest ids, and queries of equal vectors are one search.

Results: null, empty or zero vectors and those with null or non-finite components take no part,
nor do rows without id. Vectors of different lengths are no candidates for each other. Ties go to the
smaller id. Fewer candidates than k: all of them. Repeated rows of one id count once. An empty table gives an empty
result. Other columns of the table are left behind, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import settle
from .substrings import _batch

DIRECTIONS = 12
CONFIDENCE = 0.99
SAMPLE = 8192
BLOCK = 20_000
CELLS = 1024
LEAF = 32


def chi_square_limit(m: int, p: float) -> float:
    """x such that chi-square with m (even) degrees stays below x with probability p."""
    def below(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        return 1 - exp(-x / 2) * total

    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def kd_leaves(points: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers of the leaves: halved at the median of the widest dimension down to `size` rows."""
    leaves, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            leaves.append(rows)
            continue
        part = points[rows]
        by = np.argmax(part.max(axis=0) - part.min(axis=0))
        order = np.argpartition(part[:, by], len(rows) // 2)
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return leaves


class Tree:
    """A kd-tree of projections that gives verified neighbours."""

    def __init__(self, vectors: np.ndarray, projected: np.ndarray):
        leaves = kd_leaves(projected, LEAF)
        order = np.concatenate(leaves)
        self.vectors, self.order = vectors[order], order
        self.ends = np.cumsum([len(x) for x in leaves])
        self.low = np.array([projected[x].min(axis=0) for x in leaves])
        self.high = np.array([projected[x].max(axis=0) for x in leaves])

    def search(self, query: np.ndarray, projected: np.ndarray, k: int, base: float, limit: float, best: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and inner products of the k best (ties at the last place included); base - 2 * product is
        the square of a distance, best the square of the k-th distance known so far."""
        away = ((np.maximum(self.low - projected, 0) + np.maximum(projected - self.high, 0)) ** 2).sum(axis=1)
        near = np.argsort(away, kind="stable")
        rows, products, at, step = [], [], 0, 4
        floor = -np.inf
        while at < len(near) and away[near[at]] <= limit * best:
            visit = near[at : at + step]
            visit = visit[away[visit] <= limit * best]
            places = np.concatenate([np.arange(self.ends[x - 1] if x else 0, self.ends[x]) for x in visit.tolist()])
            product = (self.vectors[places] * query).sum(axis=1)
            keep = product >= floor
            rows.append(places[keep])
            products.append(product[keep])
            every = np.concatenate(products)
            if len(every) >= k:
                floor = np.partition(every, len(every) - k)[len(every) - k]
                best = min(best, max(base - 2 * floor, 0.0))
            at, step = at + step, min(step * 2, 64)
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0)
        rows, products = np.concatenate(rows), np.concatenate(products)
        keep = products >= floor
        return self.order[rows[keep]], products[keep]


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of double): what takes part. Of rows that share an id the vector that sorts first counts."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def entries(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors: entry (the smallest id), ids (the k + 1 smallest), v."""
    ranked = rows.withColumn("r", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    return ranked.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("entry"), "ids", "v")


def _project(found: DataFrame, directions: np.ndarray, longest: float, splits) -> DataFrame:
    """Adds p (projection), cell."""
    shared = found.sparkSession.sparkContext.broadcast((directions, splits))  # CELLS splits at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions, splits = shared.value
        for batch in batches:
            v = np.array(batch.column("v").to_pylist(), float).reshape(batch.num_rows, -1)
            if not len(v):
                continue
            p, q = project(v, directions, longest)
            out = [*batch.columns, pa.array(p.tolist(), pa.list_(pa.float64())), pa.array(q.tolist(), pa.list_(pa.float64())), pa.array(cell_of(p, splits)), pa.array(cell_of(q, splits))]
            yield pa.RecordBatch.from_arrays(out, names=["entry", "ids", "v", "p", "q", "cell", "home"])

    return found.mapInArrow(run, "entry bigint, ids array<bigint>, v array<double>, p array<double>, q array<double>, cell bigint, home bigint")


def project(v: np.ndarray, directions: np.ndarray, longest: float) -> tuple[np.ndarray, np.ndarray]:
    """Projections as a point (brought to the longest norm) and as a query (brought there by a factor)."""
    norm = np.sqrt((v * v).sum(axis=1))
    rest = np.sqrt(np.maximum(longest**2 - norm**2, 0))
    return v @ directions[:-1] + rest[:, None] * directions[-1], (v * (longest / norm)[:, None]) @ directions[:-1]


def fit_splits(points: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """A complete kd-tree of `depth` levels as (dimension, value) in heap order."""
    splits, level = [], [points]
    for _ in range(depth):
        below = []
        for part in level:
            by = int(np.argmax(part.max(axis=0) - part.min(axis=0))) if len(part) else 0
            value = float(np.median(part[:, by])) if len(part) else 0.0
            splits.append((by, value))
            left = part[:, by] < value if len(part) else np.zeros(0, bool)
            below += [part[left], part[~left]]
        level = below
    return splits


def cell_of(points: np.ndarray, splits: list[tuple[int, float]]) -> np.ndarray:
    at = np.zeros(len(points), np.int64)
    if splits:
        by, value = np.array([s[0] for s in splits]), np.array([s[1] for s in splits])
        for _ in range((len(splits) + 1).bit_length() - 1):
            at = 2 * at + 1 + (points[np.arange(len(points)), by[at]] >= value[at])
    return at - len(splits)


_FOUND = {"query": pa.int64(), "entry": pa.int64(), "ids": pa.list_(pa.int64()), "score": pa.float64()}


def _visit(points: DataFrame, visits: DataFrame, blocks: DataFrame, k: int, longest: float, limit: float) -> DataFrame:
    """Queries (query, v, q, cell, best) against the blocks of their cells: query, entry, ids, score."""
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = points.join(blocks, "cell").select("cell", F.pmod(F.xxhash64("entry"), F.col("blocks")).alias("block"), F.lit(0).alias("kind"), F.col("entry").alias("id"), "ids", "v", F.col("p").alias("p"), F.lit(0.0).alias("best"))
    asked = visits.join(blocks, "cell").select("cell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), F.col("query").alias("id"), F.lit(None).cast("array<bigint>").alias("ids"), "v", F.col("q").alias("p"), "best")
    rows = own.unionByName(asked).repartition(n, "cell", "block").sortWithinPartitions("cell", "block", "kind", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (x for batch in batches for x in zip(*(batch.column(c).to_pylist() for c in ("cell", "block", "kind", "id", "ids", "v", "p", "best"))))
        out: list[list] = [[] for _ in _FOUND]
        for _, group in groupby(each, key=lambda x: x[:2]):
            held, tree = [], None
            for _, _, kind, i, ids, v, p, best in group:
                if kind == 0:
                    held.append((i, ids, v, p))
                    continue
                if not held:
                    break
                if tree is None:
                    tree = Tree(np.array([x[2] for x in held]), np.array([x[3] for x in held]))
                v = np.array(v)
                factor = longest / np.sqrt((v * v).sum())
                # distances of the query brought to the longest norm: 2 * longest**2 - 2 * product
                found, products = tree.search(v * factor, np.array(p), k, 2 * longest**2, limit, best)
                scores = (np.array([held[x][2] for x in found.tolist()]).reshape(-1, len(v)) * v).sum(axis=1)
                top = sorted(zip((-scores).tolist(), (held[x][0] for x in found.tolist()), found.tolist()))[:k]
                for score, entry, x in top:
                    for col, value in zip(out, (i, entry, held[x][1], -score)):
                        col.append(value)
                if len(out[0]) > 20_000:
                    yield _batch(out, _FOUND)
                    out = [[] for _ in _FOUND]
        yield _batch(out, _FOUND)

    return rows.mapInArrow(run, "query bigint, entry bigint, ids array<bigint>, score double")


def search(vectors: DataFrame, every: int, k: int, directions: int = DIRECTIONS, confidence: float = CONFIDENCE, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row whose id `every` divides.

    A product needs vectors of one length; each length that occurs is searched by itself."""
    rows = settle(valid(vectors), "vectors")
    lengths = [r["d"] for r in rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()]  # a few
    if len(lengths) < 2:
        return _search(rows, every, k, directions, confidence, block, seed)
    out = None
    for d in lengths:
        found = _search(rows.where(F.size("v") == d), every, k, directions, confidence, block, seed)
        out = found if out is None else out.unionByName(found)
    return out


def _search(rows: DataFrame, every: int, k: int, directions: int, confidence: float, block: int, seed: int) -> DataFrame:
    found = settle(entries(rows, k), "entries")
    info = found.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("s"), F.max(F.size("v")).alias("d")).first()
    n, dim = info["n"], info["d"] or 1
    longest = float(np.sqrt(info["s"] or 1.0))
    matrix = np.random.default_rng(seed).standard_normal((dim + 1, directions))
    sample = np.array([r["v"] for r in found.orderBy(F.xxhash64("entry")).limit(SAMPLE).select("v").collect()]).reshape(-1, dim)
    depth = int(np.log2(min(CELLS, max(1, n / block))))
    splits = fit_splits(project(sample, matrix, longest)[0], depth)
    points = settle(_project(found, matrix, longest, splits), "points")
    box = [F.min(F.col("p")[i]).alias(f"l{i}") for i in range(directions)] + [F.max(F.col("p")[i]).alias(f"h{i}") for i in range(directions)]
    cells = settle(points.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("bigint").alias("blocks"), *box), "cells")  # CELLS rows at most
    blocks = cells.select("cell", "blocks")
    limit = chi_square_limit(directions, confidence)
    wanted = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    asked = settle(wanted.join(points.select("entry", "ids", "v", "q", "home"), "v").select(F.col("vec_id").alias("query_id"), "entry", "v", "q", "home"), "asked")
    one = asked.groupBy("entry").agg(F.first("v").alias("v"), F.first("q").alias("q"), F.first("home").alias("home")).withColumnRenamed("entry", "query")
    far = float("inf")
    first = settle(_visit(points, one.select("query", "v", "q", F.col("home").alias("cell"), F.lit(far).alias("best")), F.broadcast(blocks), k + 1, longest, limit), "first")
    kth = first.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "entry"))).where(F.col("r") == k + 1).select("query", "score")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    bound = one.join(kth, "query", "left").withColumn("best", F.coalesce(F.greatest(2 * longest**2 - 2 * longest * F.col("score") / norm, F.lit(0.0)) * (1 + 1e-9) + 1e-12, F.lit(far)))
    away = sum((F.greatest(F.col(f"l{i}") - F.col("q")[i], F.col("q")[i] - F.col(f"h{i}"), F.lit(0.0)) ** 2 for i in range(directions)), F.lit(0.0))
    others = bound.join(F.broadcast(cells), F.col("cell") != F.col("home")).where(away <= limit * F.col("best")).select("query", "v", "q", "cell", "best")
    second = _visit(points, others, F.broadcast(blocks), k + 1, longest, limit)
    merged = first.unionByName(second).withColumn("r", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "entry"))).where(F.col("r") <= k + 1)
    listed = merged.select("query", "score", F.explode("ids").alias("vec_id")).withColumn("r", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    lists = listed.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("best"))
    answers = asked.select("query_id", F.col("entry").alias("query")).join(lists, "query")
    own = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return answers.select("query_id", F.posexplode(own).alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", "x.score")
