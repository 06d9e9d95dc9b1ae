import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import neighbours, warc
from docloom.llm.scratch import fresh_path


def test_warc(spark):
    big, small = "é" * 600, "x" * 999
    rows = [(1, "http://a/", big), (5, "http://b/\r\nX: y", big), (3, None, big), (7, "u", small), (8, "u", small), (9, "u", None), (10, "u", ""), (None, "n", big), (None, "n", "z" * 2000), (11, "u", "only" * 400), (12, "u", "y" * 1000), (12, "u", "y" * 1000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"sha256": F.lit(1), "payload": F.lit(2), "kept": F.lit(3)})
    path = fresh_path(spark, "warc")
    warc.write(pages, path)
    got = sorted(map(tuple, warc.report(spark, path).collect()), key=str)
    want = []
    for page, _, html in rows:
        b = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == b and p is not None]
        kept = max(same) if same and len(b) >= 1000 else None
        revisit = kept is not None and page != kept
        want.append((page, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", kept if revisit else None))
    assert got == sorted(want, key=str)
    assert spark.read.parquet(f"{path}/payloads").count() == len({(h or "") for _, _, h in rows})
    full = {r["page_id"]: r for r in warc.reconstruct(spark, path).collect()}
    assert bytes(full[5]["payload"]) == big.encode() and bytes(full[5]["record"]).count(b"\r\n\r\n") == 2 and b"%0D%0AX: y" in bytes(full[5]["record"])
    assert bytes(full[1]["record"]).endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n")
    empty = fresh_path(spark, "warc")
    warc.write(pages.where("false"), empty)
    assert warc.report(spark, empty).count() == 0


def brute(rows, every, k):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], float)
    out = {}
    for i, q in zip(ids, x):
        if i % every == 0:
            s = (x * q).sum(axis=1)
            out[int(i)] = [(int(v), -float(p)) for p, v in sorted(zip(-s, ids)) if v != i][:k]
    return out


@pytest.mark.parametrize("block", [20_000, 150])
def test_neighbours(spark, block):
    r = np.random.default_rng(5)
    centres = r.normal(size=(12, 24))
    x = (centres[r.integers(0, 12, 1500)] + 0.6 * r.normal(size=(1500, 24))) * r.choice([0.5, 1.0, 2.0], (1500, 1))
    x[100:400] = x[100]
    rows = [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]
    odd = [(2000, None), (2020, []), (2040, [0.0] * 24), (2060, [1.0] * 23 + [None]), (2080, [float("nan")] * 24), (2100, [float("inf")] * 24), (2120, [1.0] * 3), (None, [1.0] * 24), (0, rows[0][1])]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>").withColumns({"v": F.lit(1), "entry": F.lit(2), "cell": F.lit("x")})
    got = {}
    for q in neighbours.search(df, 20, 20, block=block).orderBy("query_id", "rank").collect():
        got.setdefault(q["query_id"], []).append((q["vec_id"], q["score"]))
        assert q["rank"] == len(got[q["query_id"]])
    want = brute(rows, 20, 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hits = sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) > 0.95
    assert all(abs(s - dict(want[q]).get(v, s)) < 1e-9 for q in got for v, s in got[q])
    assert [v for v, _ in got[200]] == [v for v, _ in want[200]]


def test_neighbours_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (20, [1.0, 1.0])], "vec_id bigint, embedding array<float>")
    got = sorted(map(tuple, neighbours.search(df, 20, 20).collect()))
    assert got == [(0, 1, 20, 1.0), (0, 2, 1, 0.0), (20, 1, 0, 1.0), (20, 2, 1, 1.0)]
    assert neighbours.search(df.where("false"), 20, 20).count() == 0


def test_chi_square():
    assert abs(neighbours.chi_square_limit(12, 0.95) - 21.026) < 1e-3
