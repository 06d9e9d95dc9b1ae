import random

import numpy as np
import pytest

from docloom.llm import jaccard

from .brute import WORD, lower
from .test_text_dedup import corpus, frame


def brute(docs):
    found = {}
    for d, t in docs:
        w = WORD.findall(lower(t))
        k = min(5, len(w))
        found[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    up = {d: d for d in found}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(found)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(found[a] & found[b])
            if n and 100 * n >= 80 * len(found[a] | found[b]):
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return {d: (len(s), root(d)) for d, s in found.items()}


def chains(seed):
    """Texts that drift apart by small edits, with a passage common to all."""
    r = random.Random(seed)
    common = [f"c{k}" for k in range(40)]
    out, doc = [], 0
    for g in range(8):
        w = [f"w{r.randint(0, 3000)}" for _ in range(r.choice([4, 9, 60, 150]))] + common[: r.choice([0, 40])]
        for _ in range(r.choice([1, 2, 30])):
            w = list(w)
            for _ in range(r.choice([0, 1, 1, 2])):
                w[r.randrange(len(w))] = f"w{r.randint(0, 3000)}"
            if r.random() < 0.1:
                w.append("more")
            out.append((doc * 7 % 1009, " ".join(w)))
            doc += 1
    return out


@pytest.mark.parametrize("seed,few,group", [(1, 16, 4000), (2, 2, 7), (3, 1, 4000)])
def test_classes(spark, seed, few, group, monkeypatch):
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "_crowded", lambda rows, percent, f=jaccard._crowded: f(rows, percent, group))
    monkeypatch.setattr(jaccard, "common_shingles", lambda d, k, f=jaccard.common_shingles: f(d, k, most=500, least=3))
    rows = chains(seed) + [(k + 2000, t) for k, t in corpus(seed, 80)]
    assert {r[0]: tuple(r)[1:] for r in jaccard.classes(frame(spark, rows)).collect()} == brute([(k, lower(t)) for k, t in rows])


def test_classes_odd_rows(spark):
    assert jaccard.classes(frame(spark, [])).count() == 0
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (2, "A b c d e f"), (5, None), (6, ""), (7, None)]
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in jaccard.classes(frame(spark, rows)).collect())
    assert got == [(0, None), (2, 2), (3, 2), (3, 2), (5, 5), (6, 6), (7, 7)]
    kept = jaccard.keep_one(frame(spark, rows))
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 2, 5, 6, 7]


def test_divide_skip():
    r = np.random.default_rng(3)
    for _ in range(200):
        q = np.unique(r.integers(0, 60, r.integers(1, 50))).astype(np.uint64)
        block = [np.unique(np.concatenate([r.choice(q, r.integers(0, len(q) + 1)), r.integers(0, 60, r.integers(1, 9)).astype(np.uint64)])) for _ in range(r.integers(1, 12))]
        want = [k for k, s in enumerate(block) if 100 * len(set(q.tolist()) & set(s.tolist())) >= 80 * len(set(q.tolist()) | set(s.tolist()))]
        assert sorted(jaccard.divide_skip(q, block)) == want
