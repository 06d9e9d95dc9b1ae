import hashlib
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from docloom.llm import prefixes

COLUMNS = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    """conv_id, turn, role, text -> rows of report."""
    held = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            held[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in held.items()}
    nodes = defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        first = c - int(c / 5) * 5
        built = turns.get(c - first, [])[:h] + own[h:]
        for d in range(len(built) + 1):
            nodes[tuple(built[:d])].append((c, d == len(built)))
    out = []
    for node, members in nodes.items():
        under = [n for n in nodes if n[: len(node)] == node]
        childless = [n for n in under if not any(m[:-1] == n and m for m in nodes)]
        saved = sum((len(nodes[n]) - 1) * len(n[-1][1].encode()) for n in under if n)
        ends = ",".join(str(c) for c in sorted(c for c, end in members if end))
        parent = min(c for c, _ in nodes[node[:-1]]) if node else None
        out.append((min(c for c, _ in members), len(node), parent, len(members), sum(len(n) == len(node) + 1 for n in under), len(childless), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows):
    table = spark.createDataFrame(rows, COLUMNS).withColumns({c: F.lit("clash") for c in ("node", "base", "depth", "weight", "leaf", "salt", "last")})
    return sorted(map(tuple, prefixes.report(table).collect()), key=str)


def test_shared_beginnings(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"é{t}" if t < 3 else f"{c % 3} at {t}") for c in range(40) for t in range(c % 11)]
    rows += [(c, t, "user", f"same {t}") for c in range(100, 130) for t in range(4)]
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (None, 1, "user", "nobody's"), (3, None, None, None), (3, 1, "user", "b"), (3, 1, "user", "a"), (3, 1, "user", "a"),  # base 0 is absent
        (-7, 1, "user", "left"), (-5, 1, "user", "left"), (-5, 2, "user", "right"), (-9, 5, "system", ""),
        (2**62, 0, "user", "x" * 200_000), (2**62, 1, "assistant", ""),
    ]
    assert run(spark, rows) == brute(rows)


def test_deep_conversation(spark):
    rows = [(10, t, "user", str(t)) for t in range(3000)] + [(11, t, "user", str(t)) for t in range(2500)]
    got = {(c, d): r for c, d, *r in prefixes.report(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert len(got) == 3001
    assert got[10, 0][:4] == [None, 2, 1, 1] and got[10, 2500][1:4] == [2, 1, 1] and got[10, 3000][1:4] == [1, 0, 1]
    assert got[10, 0][4] == sum(len(str(t)) for t in range(2500))


def test_many_that_are_equal(spark):
    """A third of all conversations are one sequence; its list of ends spans several blocks."""
    rows = [(c, t, "user", f"t{t}") for c in range(0, 15_000, 5) for t in range(2)] + [(c, 0, "user", str(c)) for c in range(1, 6000, 5)]
    got = {(c, d): tuple(r) for c, d, *r in prefixes.report(spark.createDataFrame(rows, COLUMNS)).collect()}
    alike = sorted([*range(0, 15_000, 5), *(c for c in range(1, 6000, 5) if prefixes.shared_turns(c) >= 2)])
    assert got[0, 2] == (0, len(alike), 0, 1, 2 * (len(alike) - 1), hashlib.sha256(",".join(map(str, alike)).encode()).hexdigest())


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(None, 0, "user", "x")]) == []
