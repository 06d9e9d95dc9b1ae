import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from docloom.llm import ranked


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    held = [(i, Counter(w), len(w)) for i, w in ((i, words(t)) for i, t in docs) if w]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, Counter()).update(words(text))
    out = []
    for item, own in asked.items():
        hits = []
        for doc, counts, length in held:
            m = 25 + 75 * length * n // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * counts[t] // (1000 * counts[t] + 8 * m)) for t, q in own.items() if counts[t])
            if s > 0:
                hits.append((-s, doc is not None, doc or 0))
        out += [(item, r, d if has else None, -s) for r, (s, has, d) in enumerate(sorted(hits)[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("n", "terms", "item", "score")})
    i = spark.createDataFrame(items, "item_id bigint, text string").withColumns({c: F.lit(1) for c in ("term", "times", "doc_id", "own")})
    return sorted(map(tuple, ranked.search(d, i, **options).collect()), key=str)


def made(n, seed=3):
    r = random.Random(seed)
    names = [f"w{x}" for x in range(300)]
    text = lambda size: " ".join(names[min(299, int(r.paretovariate(0.6)) - 1)] for _ in range(size))
    return [(x, text(r.choice([1, 5, 40, 200]))) for x in range(n)], [(x, text(12)) for x in range(15)]


def test_against_all_scores(spark, monkeypatch):
    docs, items = made(600)
    docs += [(1000 + x, docs[7][1]) for x in range(30)]  # ties
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, items, entries=20) == brute(docs, items)  # several passes


def test_shards_and_blocks_prune(monkeypatch):
    """Small shards and blocks, in one process: the same documents, and bounds that close lists."""
    docs, items = made(2000, 5)
    held = [Counter(words(t)) for _, t in docs]
    df = Counter(t for c in held for t in c)
    number = {t: n for n, t in enumerate(sorted(df))}
    sizes = np.array([sum(c.values()) for c in held])
    weights = np.array([math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[t] + 1))) for t in sorted(df)])
    shard = ranked.Shard(sizes, np.array([len(c) for c in held]), np.array([number[t] for c in held for t in c]), np.array([n for c in held for n in c.values()]), weights, len(docs), int(sizes.sum()))
    want = brute(docs, items)
    for block in (16, 4096):
        monkeypatch.setattr(ranked, "BLOCK", block)
        for item, text in items:
            places, scores = shard.search([(number[t], n) for t, n in Counter(words(text)).items() if t in number], -1, 10)
            best = sorted(zip((-scores).tolist(), places.tolist()))[:10]
            assert [(item, r, d, -s) for r, (s, d) in enumerate(best, 1)] == sorted((x for x in want if x[0] == item), key=lambda x: x[1])
            floor = -best[-1][0]
            places, scores = shard.search([(number[t], n) for t, n in Counter(words(text)).items() if t in number], floor, 10)
            assert {(-s, d) for s, d in zip(scores.tolist(), places.tolist())} == set(best)  # ties with the floor stay


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "- -"), (None, "Äpfel alpha"), (5, "ALPHA alpha beta"), (5, "ALPHA alpha beta"), (6, "ﬀ gamma " * 40_000), (7, "delta_epsilon")]
    items = [(1, "alpha"), (1, "beta beta"), (None, "gamma"), (3, None), (4, "nowhere"), (5, "Äpfel äpfel epsilon"), (6, "")]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, [], items) == [] and run(spark, docs, []) == []
