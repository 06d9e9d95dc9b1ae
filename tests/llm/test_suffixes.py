import random

import numpy as np
import pytest

from docloom.llm import suffixes

from .brute import sha
from .test_text_dedup import corpus, frame


def brute(docs, length, near):
    """The contract's fields, and the bytes covered by strings of `near` bytes that stand twice."""
    whole, covered = _brute(docs, length), _brute(docs, near)
    return {d: (*v, covered[d][1]) for d, v in whole.items()}


def _brute(docs, length):
    seen = {}
    raws = {d: (t or "").encode() for d, t in docs}
    for d, b in raws.items():
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = {}
    for d, b in raws.items():
        gone = np.zeros(len(b) + 1, np.int8)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = 1
        gone[-1] = 0
        spans = int((np.diff(np.concatenate([[0], gone])) == 1).sum())
        out[d] = (len(b), int(gone.sum()), spans, sha(bytes(x for x, g in zip(b, gone) if not g)))
    return out


@pytest.mark.parametrize("alphabet", [b"ab", b"abcdefgh", b"a", b"\0\1"])
def test_two_stage_order(alphabet):
    r = random.Random(4)
    for k in range(40):
        raw = bytes(r.choice(alphabet) for _ in range(r.randint(1, 90))) + b"\0"
        starts, counts = np.array([0]), np.array([len(raw) - 1])
        got = suffixes.suffix_order(raw, starts, counts, 100).tolist()
        assert [raw[i:] for i in got] == sorted(raw[i:] for i in range(len(raw) - 1))


@pytest.mark.parametrize("group_bytes", [1 << 24, 300])
def test_bytes(spark, group_bytes):
    rows = [x for x in corpus(5, 70) if len(x[1] or "") < 5000]
    rows += [(500, "xy" * 300), (501, "é" * 200 + "z"), (502, "q" * 399), (503, "\0" * 500), (504, "\0" * 400)]
    got = {r[0]: tuple(r)[1:] for r in suffixes.report(frame(spark, rows), length=60, near=40, gram=8, group_bytes=group_bytes).collect()}
    assert got == brute(rows, 60, 40)


def test_bytes_400(spark):
    rows = [x for x in corpus(6, 60) if len(x[1] or "") < 5000]
    got = {r[0]: tuple(r)[1:] for r in suffixes.report(frame(spark, rows)).collect()}
    assert got == brute(rows, 400, suffixes.NEAR)


def test_bytes_odd_rows(spark):
    assert suffixes.report(frame(spark, [])).count() == 0
    rows = [(None, "ab" * 400), (1, "cd" * 400), (1, "cd" * 400)]
    assert sorted(((r["doc_id"] or 0), r["n_removed"]) for r in suffixes.report(frame(spark, rows)).collect()) == [(0, 0), (1, 800), (1, 800)]
