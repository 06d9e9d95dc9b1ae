"""Dense search that reads a part of the index (D03), and the nearest pairs of all vectors.

`inverted_file` deals vectors out to cells around centroids, each with its radius, and keeps of each vector a byte for each
component of what the centroid leaves, with the exact length of the rounding error. `search` picks a query's cells by
distance, scans their codes, and reads the vectors only of rows whose upper bound reaches the k-th lower bound.

`nearest_pairs` first finds k good pairs in sorted neighbourhoods, then all pairs as near as the k-th: a tree over a
bounded sample cuts the space where vectors spread most, vectors within that distance of a cut go to both sides, and only
vectors of one leaf are compared. Equal vectors are one entry with its k + 1 smallest ids.

Vectors that are null, zero, hold nulls or are of another length than the index take no part in searches. In pairs their
cosine is 0, as in D01.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docloom.operators import retrieval as R
from docloom.sources.shared import settle

#: Rows that centroids and cuts are fitted on at most; cells at most.
SAMPLE, CELLS = 16_384, 1024
#: Share of the vectors whose codes a query scans, unless bounds end its search before.
SCAN = 0.7
QUERY_BLOCK = 4096
IDS = ("chunk_id", "document_id", "chunk_index")


def _usable(rows: DataFrame, column: str = "vector") -> DataFrame:
    return rows.where(F.col(column).isNotNull() & ~F.exists(column, lambda v: v.isNull() | F.isnan(v.cast("double"))) & F.exists(column, lambda v: v != 0))


def _sampled(rows: DataFrame, dimensions: int, n: int) -> np.ndarray:
    """Unit vectors of at most n rows, in the order of a hash."""
    part = rows.where(F.size("vector") == dimensions).orderBy(F.xxhash64("vector")).limit(n).select("vector").toArrow()
    return _unit(part.column("vector").combine_chunks())[1]


def _unit(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    x = R._matrix(lists)[0]
    return x, x / np.sqrt((x * x).sum(1, keepdims=True)) if len(x) else x


@dataclass
class InvertedFile:
    """rows: chunk_id, document_id, chunk_index, vector, cell, code, scale, error; and of each cell its centre, radius and size."""

    rows: DataFrame
    centres: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray

    @property
    def n(self) -> int:
        return int(self.sizes.sum())


def centroids(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Means of unit vectors by Lloyd's rounds, for a sample that fits."""
    if not len(x):
        return np.zeros((0, x.shape[1]))
    c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        of = np.argmax(2 * x @ c.T - (c * c).sum(1), axis=1)
        n = np.bincount(of, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, of, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def inverted_file(corpus: DataFrame, dimensions: int, cells: int | None = None, sample: int = SAMPLE) -> InvertedFile:
    """Index every usable vector of that length; only the centroids come from a sample. Rows stand sorted by cell."""
    spark = corpus.sparkSession
    rows = _usable(corpus).where(F.size("vector") == dimensions).select(*IDS, "vector")
    x = _sampled(rows, dimensions, sample)
    sent = spark.sparkContext.broadcast(centroids(x, cells or min(CELLS, max(1, len(x) // 16))))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (*IDS, "vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for batch in batches:
            _, u = _unit(batch.column("vector"))
            cell = np.argmax(2 * u @ c.T - (c * c).sum(1), axis=1) if len(u) else np.zeros(0, int)
            left = u - c[cell]
            scale = np.maximum(np.abs(left).max(1, initial=0.0), 1e-30) / 127
            code = np.rint(left / scale[:, None]).astype(np.int8)
            error = np.sqrt(((left - code * scale[:, None]) ** 2).sum(1))
            far = np.sqrt((left * left).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array([x.tobytes() for x in code], pa.binary()), pa.array(scale), pa.array(error), pa.array(far)],
                                             names=[*batch.schema.names, "cell", "code", "scale", "error", "far"])

    coded = rows.mapInArrow(run, f"{kinds}, cell int, code binary, scale double, error double, far double")
    held = settle(coded.repartitionByRange(F.col("cell"), F.xxhash64("chunk_id")).sortWithinPartitions("cell"), "inverted")
    n = len(sent.value)
    radii, sizes = np.zeros(n), np.zeros(n, np.int64)
    for r in held.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect():  # CELLS rows at most
        radii[r["cell"]], sizes[r["cell"]] = r["far"], r["n"]
    return InvertedFile(held.drop("far"), sent.value, radii, sizes)


def probes(index: InvertedFile, q: np.ndarray, k: int, scan: float) -> list[np.ndarray]:
    """Cells of each unit query, the nearest first: up to that share of the vectors, and none that is farther than k vectors must be."""
    far = np.sqrt(np.maximum((q * q).sum(1)[:, None] - 2 * q @ index.centres.T + (index.centres * index.centres).sum(1), 0))
    out = []
    for d in far:
        order = np.argsort(d, kind="stable")
        order = order[index.sizes[order] > 0]
        held = np.cumsum(index.sizes[order])
        sure = order[: np.searchsorted(held, k) + 1]
        reach = (d[sure] + index.radii[sure]).max(initial=0.0) if len(held) and held[-1] >= k else np.inf
        within = order[: np.searchsorted(held, scan * index.n) + 1]
        out.append(within[d[within] - index.radii[within] <= reach + 1e-9])
    return out


def search(queries: DataFrame, index: InvertedFile, k: int, scan: float = SCAN) -> tuple[DataFrame, DataFrame]:
    """(D03: hits as dense_top_k gives them; per query the shares of vectors scanned by code and verified).

    With scan=1 the hits are exact. Queries are sent in blocks of about QUERY_BLOCK."""
    spark = queries.sparkSession
    asked = _usable(queries).where((F.size("vector") == index.centres.shape[1]) & F.col("query_id").isNotNull()).select("query_id", "vector")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    found = [_candidates(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n), index, k, scan) for n in range(blocks)]
    near, costs = found[0]
    for more, cost in found[1:]:
        near, costs = near.unionByName(more), costs.unionByName(cost)
    near = settle(near, "candidates")
    least = near.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("lower")))).where(F.col("place") == k).select("query_id", F.col("lower").alias("least"))
    kept = near.join(least, "query_id", "left").where(F.col("upper") >= F.coalesce("least", F.lit(0.0))).select("query_id", *IDS)
    kept = settle(kept.join(asked.withColumnRenamed("vector", "_q"), "query_id"), "verified")
    few = kept.count() <= R.MANY
    rows = index.rows.select("chunk_id", "document_id", "chunk_index", "vector")
    exact = rows.join(F.broadcast(kept) if few else kept, list(IDS)).select("query_id", *IDS, R.cosine(F.col("_q"), F.col("vector")).alias("score"))
    verified = kept.groupBy("query_id").agg((F.count("*") / max(index.n, 1)).alias("verified"))
    return R.ranked(exact, F.desc("score"), F.asc("document_id"), F.asc("chunk_index"), limit=k), costs.join(verified, "query_id", "left").fillna(0.0, ["verified"])


def _candidates(asked: DataFrame, index: InvertedFile, k: int, scan: float) -> tuple[DataFrame, DataFrame]:
    """Rows that may be among the k nearest by the bounds of their codes: query_id, ids, lower, upper; query_id, scanned."""
    spark = asked.sparkSession
    part = asked.toArrow()  # about QUERY_BLOCK
    _, q = _unit(part.column("vector").combine_chunks())
    chosen = probes(index, q, k, scan) if len(q) else []
    of: dict[int, list[int]] = {}
    for n, cells in enumerate(chosen):
        for cell in cells.tolist():
            of.setdefault(cell, []).append(n)
    ids = part.column("query_id").combine_chunks()
    sent = spark.sparkContext.broadcast((ids, q, {c: np.array(v) for c, v in of.items()}, index.centres))
    rows = index.rows.select(*IDS, "cell", "code", "scale", "error")
    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, {', '.join(f'{c} {rows.schema[c].dataType.simpleString()}' for c in IDS)}, lower double, upper double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, of, centres = sent.value
        best = np.full((len(q), k), -1.0)  # the largest lower bounds so far
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.int8).reshape(len(cells), -1)
            scale, error = batch.column("scale").to_numpy(), batch.column("error").to_numpy() + 1e-9
            out: list[tuple[np.ndarray, ...]] = []
            for cell in np.unique(cells):
                who = of.get(int(cell))
                if who is None:
                    continue
                here = np.nonzero(cells == cell)[0]
                about = (q[who] @ centres[cell])[:, None] + (q[who] @ codes[here].T.astype(float)) * scale[here]
                lower, upper = np.clip(about - error[here], 0, 1), np.clip(about + error[here], 0, 1)
                best[who] = -np.partition(-np.concatenate([best[who], lower], axis=1), k - 1, axis=1)[:, :k]
                a, b = np.nonzero(upper >= best[who].min(1)[:, None])
                out.append((who[a], here[b], lower[a, b], upper[a, b]))
            if out:
                w, h, lower, upper = map(np.concatenate, zip(*out))
                good = upper >= best[w].min(1)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(w[good])), *(batch.column(c).take(pa.array(h[good])) for c in IDS), pa.array(lower[good]), pa.array(upper[good])], names=["query_id", *IDS, "lower", "upper"])

    shares = pa.table({"query_id": ids, "scanned": pa.array([float(index.sizes[c].sum()) / max(index.n, 1) for c in chosen], pa.float64())})
    costs = spark.createDataFrame(shares) if len(ids) else asked.select("query_id", F.lit(0.0).alias("scanned"))
    return rows.mapInArrow(run, schema), costs


# Nearest pairs

#: Rows of a leaf, about; of a block that is compared at once; neighbours that are tried to find good pairs, in so many orders.
LEAF, PAIR_BLOCK, AHEAD, ORDERS = 4096, 8192, 24, 5


class Cuts:
    """A tree of cuts across directions: vectors within `reach` above a cut go to both sides, so no nearer pair is parted."""

    def __init__(self, sample: np.ndarray, reach: float, leaf: int):
        spread = sample - sample.mean(0)
        self.axes = np.linalg.svd(spread, full_matrices=False)[2].T if len(sample) > 1 else np.eye(sample.shape[1])
        self.reach, self.leaves = reach, 0
        self.root = self._grow(sample @ self.axes, max(1, leaf))

    def _grow(self, x: np.ndarray, leaf: int):
        if len(x) > leaf:
            middle = np.median(x, axis=0)
            low, high = (x <= middle + self.reach).mean(0), (x > middle).mean(0)
            axis = int(np.argmin(low**2 + high**2))
            if low[axis] ** 2 + high[axis] ** 2 < 0.9:
                at = middle[axis]
                return axis, at, self._grow(x[x[:, axis] <= at + self.reach], leaf), self._grow(x[x[:, axis] > at], leaf)
        self.leaves += 1
        return self.leaves - 1

    def deal(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of unit vectors, for every leaf that a vector goes to."""
        x, out, todo = u @ self.axes, [], [(self.root, np.arange(len(u)))]
        while todo:
            node, rows = todo.pop()
            if isinstance(node, int):
                out.append((rows, np.full(len(rows), node)))
            else:
                axis, at, low, high = node
                todo += [(low, rows[x[rows, axis] <= at + self.reach]), (high, rows[x[rows, axis] > at])]
        return np.concatenate([r for r, _ in out]), np.concatenate([n for _, n in out])


class _Best:
    """The k best pairs so far: score, and the smallest ids of both sides, which order ties."""

    def __init__(self, k: int, least: float):
        self.k, self.least, self.rows = k, least, []

    def add(self, x: np.ndarray, y: np.ndarray, xn: np.ndarray, yn: np.ndarray, a: np.ndarray, b: np.ndarray, left: list, right: list) -> None:
        """Pairs of places (a in x, b in y) whose cosine reaches the least; left and right are (id, entry) of the rows."""
        for at in range(0, len(a), 1 << 16):
            r, c = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
            score = np.clip(R._in_order(x[r], y[c]) / (xn[r] * yn[c]), 0, 1)
            for s, i, j in zip(score.tolist(), r.tolist(), c.tolist()):
                if s >= self.least:
                    p, q = sorted((left[i], right[j]))
                    self.rows.append((-s, p[0], q[0], p[1], q[1]))
            self.trim()

    def trim(self) -> None:
        self.rows = sorted(set(self.rows))[: self.k]
        if len(self.rows) == self.k:
            self.least = max(self.least, -self.rows[-1][0])


def nearest_pairs(vectors: DataFrame, k: int = 10, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """left_id, right_id, score of the k most alike pairs of all vectors (a report); ties by ids."""
    spark = vectors.sparkSession
    rows = vectors.where("chunk_id is not null").select("chunk_id", "vector")
    usable = _usable(rows)
    first = usable.withColumn("n", F.row_number().over(W.partitionBy("vector").orderBy("chunk_id"))).where(F.col("n") <= k + 1)
    entries = settle(first.groupBy("vector").agg(F.sort_array(F.collect_list("chunk_id")).alias("ids")).select(F.monotonically_increasing_id().alias("entry"), "ids", F.element_at("ids", 1).alias("first"), "vector"), "entries")
    sizes = [(r["d"], r["n"]) for r in entries.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).collect()]  # a row for each length
    alike = entries.where(F.size("ids") > 1).select(R.cosine(F.col("vector"), F.col("vector")).alias("score"), F.col("first").alias("p"), F.element_at("ids", 2).alias("q"), F.col("entry").alias("a"), F.col("entry").alias("b"))
    every = None
    for d, n in sizes:
        own = entries.where(F.size("vector") == d)
        known = alike.where("false") if n < 2 else _good_pairs(own, d, n, k)
        top = [r["score"] for r in known.unionByName(alike).orderBy(F.desc("score")).limit(k).collect()]
        found = _within(own, d, top[-1] if len(top) == k else 0.0, k, sample, leaf)
        every = found if every is None else every.unionByName(found)
    best = alike if every is None else every.unionByName(alike)
    best = best.orderBy(F.desc("score"), "p", "q").limit(k)
    side = lambda name: entries.select(F.col("entry").alias(name), F.col("ids").alias(f"{name}_ids"))
    pairs = side("a").join(F.broadcast(best), "a").join(side("b"), "b").select("score", F.col("a_ids").alias("l"), F.explode("b_ids").alias("y")).select("score", F.explode("l").alias("x"), "y").where("x != y")
    out = pairs.select(F.least("x", "y").alias("left_id"), F.greatest("x", "y").alias("right_id"), "score").distinct().orderBy(F.desc("score"), "left_id", "right_id").limit(k)
    out = settle(out, "pairs")
    if out.where("score > 0").count() < k:  # pairs of cosine 0, or of vectors without a direction, fill the report
        return R.every_pair(rows, k)
    return out.orderBy(F.desc("score"), "left_id", "right_id")


def _pair_schema(entries: DataFrame) -> tuple[str, pa.Schema]:
    kind = entries.schema["first"].dataType
    arrow = pa.schema([("score", pa.float64()), ("p", to_arrow_type(kind)), ("q", to_arrow_type(kind)), ("a", pa.int64()), ("b", pa.int64())])
    return f"score double, p {kind.simpleString()}, q {kind.simpleString()}, a bigint, b bigint", arrow


def _rows_of(best: _Best, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if best.rows:
        yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*((-s, *r) for s, *r in best.rows)))), schema=schema)


def _good_pairs(entries: DataFrame, dimensions: int, n: int, k: int) -> DataFrame:
    """k pairs, for a first bound: in several orders, each vector against the few that follow it among those with its signs."""
    bits = max(0, int(np.log2(max(n / 256, 1))))
    schema, arrow = _pair_schema(entries)
    every = None
    for turn in range(ORDERS):
        axes = np.linalg.qr(np.random.default_rng(turn).normal(size=(dimensions, dimensions)))[0][:, : bits + 1]
        width = axes.shape[1] - 1

        def sketch(batches: Iterator[pa.RecordBatch], axes=axes, width=width) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = _unit(batch.column("vector"))[1] @ axes
                signs = (at[:, :width] > 0) @ (1 << np.arange(width)) if width else np.zeros(len(at), np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(signs.astype(np.int64)), pa.array(at[:, width])], names=[*batch.schema.names, "signs", "place"])

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, held = _Best(k, 0.0), None
            for batch in batches:
                batch = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
                x = R._matrix(batch.column("vector"))[0]
                norm, names = np.sqrt(R._in_order(x, x)), list(zip(batch.column("first").to_pylist(), batch.column("entry").to_pylist()))
                signs, u = batch.column("signs").to_numpy(), x / norm[:, None]
                for step in range(1, min(AHEAD, len(x) - 1) + 1):
                    about = np.where(signs[step:] == signs[:-step], (u[step:] * u[:-step]).sum(1), -1.0)
                    a = np.argpartition(-about, min(k, len(about)) - 1)[:k]
                    a = a[about[a] >= best.least - 1e-9]
                    best.add(x, x, norm, norm, a, a + step, names, names)
                held = batch.slice(max(0, batch.num_rows - AHEAD))
            yield from _rows_of(best, arrow)

        kinds = ", ".join(f"{c} {entries.schema[c].dataType.simpleString()}" for c in ("entry", "first", "vector"))
        dealt = entries.select("entry", "first", "vector").mapInArrow(sketch, f"{kinds}, signs bigint, place double").repartitionByRange("signs", "place").sortWithinPartitions("signs", "place")
        found = dealt.mapInArrow(compare, schema)
        every = found if every is None else every.unionByName(found)
    return every.dropDuplicates(["a", "b"]).orderBy(F.desc("score")).limit(k)


def _within(entries: DataFrame, dimensions: int, least: float, k: int, sample: int, leaf: int) -> DataFrame:
    """The k best pairs of at least that cosine: each leaf against itself, in pairs of blocks where it is large."""
    spark = entries.sparkSession
    schema, arrow = _pair_schema(entries)
    x, n = _sampled(entries, dimensions, sample), entries.count()
    cuts = Cuts(x, np.sqrt(max(2 - 2 * least, 0)) + 1e-6, max(16, len(x) * leaf // max(n, 1)))
    sent = spark.sparkContext.broadcast(cuts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows, leaves = sent.value.deal(_unit(batch.column("vector"))[1])
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in batch.columns), pa.array(leaves, pa.int32())], names=[*batch.schema.names, "leaf"])

    kinds = ", ".join(f"{c} {entries.schema[c].dataType.simpleString()}" for c in ("entry", "first", "vector"))
    dealt = entries.select("entry", "first", "vector").mapInArrow(deal, f"{kinds}, leaf int")
    blocks = {r["leaf"]: -(-r["n"] // PAIR_BLOCK) for r in dealt.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row for each leaf
    many = F.create_map(*(F.lit(v) for x in blocks.items() if x[1] > 1 for v in x)) if any(b > 1 for b in blocks.values()) else None
    of = F.coalesce(F.try_element_at(many, F.col("leaf")), F.lit(1)) if many is not None else F.lit(1)
    placed = dealt.withColumn("nb", of).withColumn("block", F.pmod(F.xxhash64("entry"), F.col("nb")).cast("int"))
    # Block i is compared with itself and with every j above it: its rows stand once in each of those pairs.
    pairs = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    keyed = placed.withColumn("pair", F.explode(pairs)).select("leaf", "pair.i", "pair.j", "block", "entry", "first", "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held = _Best(k, least - 1e-12), []

        def close() -> None:
            if not held:
                return
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            x = R._matrix(t.column("vector").combine_chunks())[0]
            norm, names = np.sqrt(R._in_order(x, x)), list(zip(t.column("first").to_pylist(), t.column("entry").to_pylist()))
            block, inner = t.column("block").to_numpy(), t.column("i")[0].as_py() == t.column("j")[0].as_py()
            u = (x / norm[:, None]).astype(np.float32)
            mine = np.nonzero(block == t.column("i")[0].as_py())[0]
            other = mine if inner else np.nonzero(block != t.column("i")[0].as_py())[0]
            for at in range(0, len(mine), 512):
                about = u[mine[at : at + 512]] @ u[other].T
                a, b = np.nonzero(about >= best.least - 1e-5)
                a += at
                if inner:
                    a, b = a[a < b], b[a < b]
                best.add(x, x, norm, norm, mine[a], other[b], names, names)

        now = None
        for batch in batches:
            keys = np.array(list(zip(*(batch.column(c).to_pylist() for c in ("leaf", "i", "j")))))
            edges = [0, *(np.nonzero((keys[1:] != keys[:-1]).any(1))[0] + 1).tolist(), len(keys)] if len(keys) else [0]
            for a, b in zip(edges, edges[1:]):
                if now is not None and tuple(keys[a]) != now:
                    close()
                now = tuple(keys[a])
                held.append(batch.slice(a, b - a))
        close()
        yield from _rows_of(best, arrow)

    grouped = keyed.repartition("leaf", "i", "j").sortWithinPartitions("leaf", "i", "j")
    return grouped.mapInArrow(run, schema).dropDuplicates(["a", "b"])
