import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from docloom.llm import entries, pii

#: The base patterns as they are stated; `re` takes the leftmost matches without overlaps.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TEXTS = [
    None, "", "nothing here", "a@b", "é x.y@a-b.c.d.. and a@@b.c, z@q.r@s.t", "..@..", "1.2.3.4.5.6.7.8 and 1.2.3.256 1.2.3.0255", "é 4111 1111 1111 1111 and 4111111111111112",
    "+1 (269) 555-3296 4524132264652876 end", "+49 30 1234567, +1234567 +12 345 678 901 234 567 89", "order 4111111111111111 12", "credit 4111111111111111 12",
    "phone: 212 555 1234, 2125551234, 212-555-1234", "no word 212-555-1234", "GB82 WEST 1234 5698 7654 32 IS MY account", "GB82WEST12345698765433", "DE89370400440532013000",
    "1234567890123456 4111-1111-1111-1111-1111", "3782 822463 10005 77", "+1 (884) 555-3918 63.51.224.77", "call (212) 555-1234 and 4111 1111 1111 1111", "x" * 120_000 + "@a.b " + "1" * 50_000, "+" * 300 + "1@1.2.3.4",
]


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            total = sum(int(x) for n, c in enumerate(d[::-1]) for x in str(int(c) * (1 + n % 2))) if kind == "card" else 0
            if kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))) or (kind == "card" and 13 <= len(d) <= 19 and total % 10 == 0) or (kind == "phone" and 9 <= len(d) <= 15):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_are_the_patterns(spark):
    rows = [(n, t) for n, t in enumerate(TEXTS) if len(t or "") < 1000] + [(None, "a@b.c"), (3, "a@b.c"), (3, "a@b.c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("spans", "n_email", "kind", "start")})
    got = [tuple(r) for r in pii.report(docs).collect()]
    want = []
    for n, t in rows:
        b = base_spans(t)
        want.append((n, *(sum(x.startswith(k + ":") for x in b) for k in BASE), hashlib.sha256(",".join(b).encode()).hexdigest()))
    assert sorted((g[:6] for g in got), key=str) == sorted(want, key=str)
    for n, t in rows:
        assert any(g[0] == n and set(base_spans(t)) <= set(g[6].split(",")) | set() for g in got) or not base_spans(t)
    assert pii.report(docs.where("false")).count() == 0


def test_equals_its_sql(spark):
    rows = [(n, t) for n, t in enumerate(TEXTS) if len(t or "") < 1000]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    cursor = con.execute(entries.SQL["op13_pii"])
    names = [c[0] for c in cursor.description]
    want = sorted(map(tuple, cursor.fetchall()))
    got = sorted(tuple(r[c] for c in names) for r in pii.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == want


def added(text):
    return [(k, text[a:b]) for k, a, b, _, base in pii.spans(text) if not base]


@pytest.mark.parametrize("text, want", [
    ("+1 (269) 555-3296 4524132264652876 end", [("card", "4524132264652876"), ("phone", "+1 (269) 555-3296")]),
    ("+1 (884) 555-3918 63.51.224.77", [("phone", "+1 (884) 555-3918")]),
    ("order 4111111111111111 12", []), ("credit 4111111111111111 12345", [("card", "4111111111111111")]), ("3782 822463 10005 77777", [("card", "3782 822463 10005")]),
    ("phone: 212 555 1234", [("phone", "212 555 1234")]), ("no word 212-555-1234", []), ("call 1212 555 1234", []),
    ("GB82 WEST 1234 5698 7654 32 IS MY account", [("iban", "GB82 WEST 1234 5698 7654 32")]), ("GB82WEST12345698765433", []),
])
def test_added_spans(text, want):
    assert added(text) == want


def test_checks():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765423")


def test_words_move_scores():
    score = lambda text: pii.spans(text)[0][3]
    assert score("host 10.0.0.1") == 80 and score("10.0.0.1") == 60 and score("version 10.0.0.1") == 30


def test_long_texts_take_linear_time():
    import time

    began = time.time()
    for text in ("a" * 500_000 + "@", "1" * 500_000, "1." * 200_000, "a@" * 200_000, "+1" * 200_000, "4 " * 200_000, "A" * 300_000):
        pii.spans(text)
    assert time.time() - began < 30


def test_mask(spark):
    rows = [(1, "mail é a@b.c or call +1 (269) 555-3296 4524132264652876."), (2, None), (3, "clean")]
    got = {r["doc_id"]: r["text"] for r in pii.mask(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: "mail é <EMAIL> or call <PHONE> <CARD>.", 2: None, 3: "clean"}
