import numpy as np
from pyspark.sql import functions as F

from docloom.operators import retrieval as R
from docloom.operators import vectors as V


def corpus(spark, x, more=()):
    rows = [(i, i // 2, i % 2, [float(v) for v in row]) for i, row in enumerate(x)] + list(more)
    return spark.createDataFrame(rows, "chunk_id bigint, document_id bigint, chunk_index int, vector array<float>")


def lists(hits):
    return {(r["query_id"], r["rank"]): (r["chunk_id"], round(r["score"], 9)) for r in hits.collect()}


def clustered(n, seed, groups=40, spread=0.05):
    r = np.random.default_rng(seed)
    return r.standard_normal((groups, 16))[r.integers(0, groups, n)] + spread * r.standard_normal((n, 16))


def test_inverted_file(spark):
    """With every open cell the lists are exact; where vectors stand in groups, bounds alone leave most cells closed."""
    x = clustered(3000, 3)
    held = corpus(spark, x, [(9000, 1, 1, None), (9001, 1, 1, [0.0] * 16), (9002, 1, 1, [1.0]), (9003, 1, 1, [float("nan")] * 16)])
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 3000, 50)] + [(-1, [0.0] * 16), (-2, None), (-3, [1.0])], "query_id bigint, vector array<double>")
    index = V.inverted_file(held, 16)
    assert index.n == 3000 and index.rows.count() == 3000
    exact = lists(R.dense_top_k(q.where("query_id >= 0"), held.where("chunk_id < 3000"), 10))
    hits, costs = V.search(q, index, 10, scan=1.0)
    assert lists(hits) == exact
    share = costs.agg(F.avg("scanned"), F.avg("verified"), F.max("verified")).first()
    assert share[0] < 0.15 and share[1] < 0.02 and share[2] < 0.15
    near = lists(V.search(q, index, 10, scan=0.05)[0])
    assert len(set(near.items()) & set(exact.items())) >= 0.95 * len(exact)


def test_recall_without_groups(spark):
    x = np.random.default_rng(1).standard_normal((2000, 64))
    held = corpus(spark, x)
    q = held.where("chunk_id % 40 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    exact = lists(R.dense_top_k(q, held, 10))
    hits, costs = V.search(q, V.inverted_file(held, 64), 10)
    got = lists(hits)
    assert sum(got.get(k) == v for k, v in exact.items()) >= 0.95 * len(exact) or len({(k[0], v[0]) for k, v in got.items()} & {(k[0], v[0]) for k, v in exact.items()}) >= 0.95 * len(exact)
    assert costs.agg(F.max("verified")).first()[0] < 0.15


def test_empty_index(spark):
    none = corpus(spark, []).where("false")
    hits, costs = V.search(spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, vector array<double>"), V.inverted_file(none, 2), 3)
    assert hits.count() == 0
    held = V.inverted_file(corpus(spark, [[1.0, 0.0], [0.0, 1.0]]), 2)
    assert V.search(spark.createDataFrame([], "query_id bigint, vector array<double>"), held, 3)[0].count() == 0
    assert V.search(spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, vector array<double>"), held, 3, scan=1.0)[0].count() == 2


def plain(df, k):
    a, b = df.selectExpr("chunk_id as left_id", "vector as a"), df.selectExpr("chunk_id as right_id", "vector as b")
    scored = a.join(b, F.col("left_id") < F.col("right_id")).select("left_id", "right_id", R.cosine(F.col("a"), F.col("b")).alias("score"))
    return [tuple(r) for r in scored.orderBy(F.desc("score"), "left_id", "right_id").limit(k).collect()]


def test_nearest_pairs(spark):
    """Against all pairs: vectors of two lengths, equal ones, near copies, and some without a direction; ties go by id."""
    r = np.random.default_rng(3)
    x = r.normal(size=(590, 6))
    rows = [(k, [float(v) for v in y]) for k, y in enumerate(x)] + [(600 + k, [float(v) for v in x[k] + 0.001 * r.normal(size=6)]) for k in range(9)]
    rows += [(650 + k, [1.0, 2.0, 3.0, 0.0, 0.0, 0.0]) for k in range(5)] + [(700, None), (701, [0.0] * 6), (702, [1.0, 2.0, 3.0]), (703, [1.0, 2.0, 3.5])]
    df = spark.createDataFrame(rows, "chunk_id bigint, vector array<float>")
    for k in (4, 30):
        want = plain(df, k)
        for got in (V.nearest_pairs(df, k), V.nearest_pairs(df, k, leaf=40)):
            assert [tuple(g) for g in got.collect()] == want
    few = df.where("chunk_id between 700 and 702")
    assert [tuple(x) for x in V.nearest_pairs(few, 5).collect()] == [(700, 701, 0.0), (700, 702, 0.0), (701, 702, 0.0)]
    assert V.nearest_pairs(df.where("false")).count() == 0


def test_cuts_part_no_near_pair():
    x = clustered(4000, 9, groups=4000)
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    cuts = V.Cuts(u[:1000], 0.2, 64)
    rows, leaves = cuts.deal(u)
    together = {}
    for n, leaf in zip(rows.tolist(), leaves.tolist()):
        together.setdefault(n, set()).add(leaf)
    near = np.argwhere(np.triu(u @ u.T, 1) >= 1 - 0.2**2 / 2)
    assert cuts.leaves > 4 and len(near) and all(together[a] & together[b] for a, b in near.tolist())


def test_pairs_of_a_large_leaf_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "PAIR_BLOCK", 50)
    x = np.random.default_rng(8).normal(size=(300, 4))
    df = corpus(spark, x).select("chunk_id", "vector")
    assert [tuple(g) for g in V.nearest_pairs(df, 20).collect()] == plain(df, 20)
