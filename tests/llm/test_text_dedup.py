import random

import pytest

from docloom.llm import decontaminate, substrings

from . import brute


def corpus(seed, n=120, vocabulary=400):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 5))) for _ in range(vocabulary)]
    text = lambda k: " ".join(r.choice(words) for _ in range(k))
    shared = [text(60) for _ in range(4)]
    out = []
    for i in range(n):
        x = text(r.choice([0, 3, 19, 20, 21, 80, 200]))
        if r.random() < 0.5:
            x = x + "\n" + r.choice(shared) + "\t " + text(r.randint(0, 30))
        if r.random() < 0.2 and out:
            x = r.choice(out)[1]
        if r.random() < 0.2 and out and out[-1][1]:
            w = out[-1][1].split(" ")
            w[len(w) // 2] = "edit"
            x = " ".join(w)
        out.append((i, x))
    return out + [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, shared[0] + " " + shared[0]), (n + 4, text(30000)), (n + 5, "a " * 100), (n + 6, "a " * 100)]


def frame(spark, rows, **extra):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    from pyspark.sql import functions as F

    for c in ("fp", "n", "salt", "lo", "n_words", "first", "whole"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.mark.parametrize("group", [3, 500])
def test_substrings(spark, group):
    rows = corpus(1)
    got = {r[0]: tuple(r)[1:] for r in substrings.report(frame(spark, rows), group=group).collect()}
    assert got == brute.substrings(rows)


def test_substrings_two_jobs(spark):
    """A log kept in a folder takes a second job's batch, with the words of the first read where they are needed."""
    rows = corpus(4)
    old, new = frame(spark, rows[:60]), frame(spark, rows[60:])
    log = substrings.RunLog(spark)
    first = {r["doc_id"]: r["kept"] for r in substrings.dedup(old, log=log).collect()}
    again = substrings.RunLog(spark, log.at)
    assert again.version == log.version > 2 and [x[0] for x in again.runs] == [x[0] for x in log.runs] and len(again.runs) <= substrings.FANOUT + 1
    second = {r["doc_id"]: r["kept"] for r in substrings.dedup(new, log=again, old=old, batches=1).collect()}
    want = brute.substrings(rows)
    assert {d: brute.sha(t) for d, t in (first | second).items()} == {d: v[2] for d, v in want.items()}
    assert sum(v[1] for d, v in want.items() if d >= 60) > 500


def test_substrings_empty(spark):
    assert substrings.report(frame(spark, [])).count() == 0


def test_substrings_without_id(spark):
    rows = [(None, "a b " * 30), (1, "c d " * 30), (1, "c d " * 30)]
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substrings.report(frame(spark, rows)).collect())
    assert got[0] == (0, 60, 0) and len(got) == 3


@pytest.mark.parametrize("limit", [32 << 20, 400])
def test_contamination(spark, limit):
    rows = corpus(2)
    items = [(k, " ".join((t or "").split()[5:45])) for k, t in rows[:40:3]] + [(900, None), (901, ""), (902, "one two"), (903, "One TWO"), (904, "... !")]
    rows = rows + [(1000, "x One, two! y"), (1001, "one two"), (1002, None)]
    df = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r[0]: tuple(r)[1:] for r in decontaminate.report(frame(spark, rows), df, max_pattern_bytes=limit).collect()}
    want = brute.contamination(rows, items)
    assert got == want
    kept = {r[0] for r in decontaminate.decontaminate(frame(spark, rows), df, max_pattern_bytes=limit).collect()}
    assert kept == {k for k, v in want.items() if not v[4]}


def test_contamination_empty(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.report(frame(spark, [(1, "a b")]), none).collect()[0]["n_hit"] == 0
    assert decontaminate.report(frame(spark, []), none).count() == 0
