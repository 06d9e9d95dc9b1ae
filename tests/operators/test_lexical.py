import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import lexical, metrics
from docloom.operators import retrieval as R


def made(seed=1, n=400):
    r = random.Random(seed)
    word = lambda: f"w{min(199, int(r.paretovariate(0.7)) - 1)}"
    rows = [(c, s, [word() for _ in range(r.choice([1, 6, 60]))]) for c in range(n) for s in range(r.choice([1, 1, 3]))]
    return rows, [(q, [word() for _ in range(9)]) for q in range(12)] + [(90, ["w0", "w0", "nowhere"]), (91, ["nowhere"])]


def brute(rows, queries, k):
    n, average = len(rows), sum(len(t) for *_, t in rows) / len(rows)
    df = Counter(w for *_, t in rows for w in set(t))
    out = []
    for q, asked in queries:
        best = defaultdict(float)
        for c, _, tokens in rows:
            tf, length = Counter(tokens), len(tokens)
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * length / average)) for w in asked if tf[w])
            best[c] = max(best[c], s)
        ranked = sorted(((-round(s, 9), c) for c, s in best.items() if s > 0))[:k]
        out += [(q, rank, c, round(-s, 6)) for rank, (s, c) in enumerate(ranked, 1)]
    return sorted(out)


def rows_of(hits):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 6)) for r in hits.collect())


@pytest.mark.parametrize("step, shard, many", [(7, 40, 10), (4096, 20_000, 50_000)])
def test_search_equals_every_score(spark, monkeypatch, step, shard, many):
    """Small steps, shards and passes as well as large ones; in several tasks."""
    monkeypatch.setattr(lexical, "STEP", step)
    rows, queries = made()
    found = spark.createDataFrame(rows, "chunk_id bigint, segment int, tokens array<string>").coalesce(1)
    asked = spark.createDataFrame(queries, "query_id bigint, tokens array<string>")
    held = lexical.blocks(found, shard=shard).cache()
    for k in (3, 30, None):
        hits = R.ranked_hits(lexical.search(held, lexical.size(held), asked, k, many=many), k)
        assert rows_of(hits) == brute(rows, queries, k)
    assert rows_of(R.bm25(found, asked, 5)) == brute(rows, queries, 5)


def test_bounds_spare_most_of_the_long_lists():
    """In one shard: with a known floor, the lists of common words open nothing."""
    rows, queries = made(4, 3000)
    lengths = np.array([float(len(t)) for *_, t in rows])
    shard = lexical._Shard((np.arange(len(rows)), lengths), lengths.mean(), 1.5, 0.75)
    places = defaultdict(list)
    for n, (*_, t) in enumerate(rows):
        for w, k in Counter(t).items():
            places[w].append((n, k))
    for w, p in places.items():
        shard.add(w, np.array([a for a, _ in p]), np.array([float(b) for _, b in p]))
    weights = [(w, math.log(1 + len(rows) / len(p))) for w, p in list(places.items())[:12]]
    chunks, scores = shard.search(weights, 0.0, 10)
    assert len(chunks) == 10
    again, same = shard.search(weights, float(scores.min()), 10)
    assert dict(zip(again.tolist(), same.round(9).tolist())) == dict(zip(chunks.tolist(), scores.round(9).tolist()))
    assert len(shard.search(weights, sum(w * shard.lists[t][2] for t, w in weights) + 1, 10)[0]) == 0


def test_stored_index(spark, tmp_path):
    rows, queries = made(7, 120)
    at = str(tmp_path / "ix")
    asked = spark.createDataFrame(queries, "query_id bigint, tokens array<string>")
    table = lambda part: spark.createDataFrame(part, "chunk_id bigint, segment int, tokens array<string>").coalesce(1)
    first = [r for r in rows if r[0] < 50]
    lexical.add(table(first), at, "b", "m", shard=30)
    lexical.add(table([(0, 0, ["other"])]), at, "b", "n")
    search = lambda: R.ranked_hits(lexical.search(*lexical.load(spark, at, "b", "m")[:2], asked, 5), 5)
    assert rows_of(search()) == brute(first, queries, 5)
    held = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    batch = lexical.add(table([r for r in rows if r[0] >= 50]), at, "b", "m")
    assert all(p.stat().st_mtime_ns == t for p, t in held.items())  # nothing was rewritten
    assert rows_of(search()) == brute(rows, queries, 5)
    lexical.blocks(table([(999, 0, ["w0"])])).write.parquet(f"{at}/blocks/base=b/model=m/batch=unfinished")
    assert rows_of(search()) == brute(rows, queries, 5)  # a batch without its line is not read
    assert lexical.load(spark, at, "b", "m")[2].count() == 0
    next(p for p in (tmp_path / "ix" / "blocks" / "base=b" / "model=m" / f"batch={batch}").glob("*.parquet")).unlink()
    assert [r["batch"] for r in lexical.load(spark, at, "b", "m")[2].collect()] == [batch]


def test_odd_segments(spark):
    rows = [(1, 0, []), (2, 0, None), (None, 0, ["a"]), (3, 0, ["a", "a"]), (3, 1, ["a"])]
    found = spark.createDataFrame(rows, "chunk_id bigint, segment int, tokens array<string>")
    asked = spark.createDataFrame([(1, ["a"]), (2, []), (None, ["a"])], "query_id bigint, tokens array<string>")
    assert [(r["query_id"], r["chunk_id"]) for r in R.bm25(found, asked, 5).collect()] == [(1, 3)]
    assert R.bm25(found.where("false"), asked, 5).count() == 0 and R.bm25(found, asked.where("false"), 5).count() == 0


def test_query_blocks_are_shuffled_once(spark):
    """What a search shuffles is a row for each block and hit, not one for each query and segment."""
    rows, queries = made(2)
    found = spark.createDataFrame(rows, "chunk_id bigint, segment int, tokens array<string>").coalesce(2)
    held = lexical.blocks(found).cache()
    hits = lexical.search(held, lexical.size(held), spark.createDataFrame(queries, "query_id bigint, tokens array<string>"), 3)
    pairs = sum(bool(set(t) & set(q)) for *_, t in rows for _, q in queries)
    assert held.count() + hits.count() < 0.2 * pairs


def test_percentiles(spark):
    r = random.Random(3)
    values = [("a", v) for v in [0.0, -1.5, -1.5, 2.0, 1e300, 5e-324, 3.0]] + [("b", r.choice([7.0, r.lognormvariate(0, 3)])) for _ in range(999)] + [("c", None), ("d", 4.0)]
    rows = spark.createDataFrame(values, "g string, v double")
    got = {x["g"]: x for x in metrics.nearest_ranks(rows, "g", "v", p50=0.5, p95=0.95, p0=0.0, p100=1.0).collect()}
    for g in "abd":
        own = sorted(v for k, v in values if k == g)
        for name, p in (("p50", 0.5), ("p95", 0.95), ("p0", 0.0), ("p100", 1.0)):
            assert got[g][name] == own[max(math.ceil(p * len(own)), 1) - 1], (g, name)
    assert "c" not in got
    plan = metrics.nearest_ranks(rows, "g", "v", p50=0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan


def test_positions(spark):
    r = random.Random(5)
    rows = [(r.randrange(50), n) for n in range(500)]
    table = spark.createDataFrame(rows, "a int, b int").repartition(7)
    got = sorted((x["position"], x["a"], x["b"]) for x in metrics.positions(table, "a", "b").collect())
    assert got == [(n, a, b) for n, (a, b) in enumerate(sorted(rows), 1)]
    plan = metrics.positions(table, "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan
    assert metrics.positions(table.where("false"), "a").count() == 0
