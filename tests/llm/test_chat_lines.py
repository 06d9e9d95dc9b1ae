import random

from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import chat, lines

from .brute import sha
from .test_text_dedup import frame

PART = st.sampled_from([*chat.CONTROL, chat.MARK, chat.MARK * 2, " ", "x", "\n", "é", "<", "[", "<" + chat.MARK + "s>", "[INST", "/INST]"])
TEXT = st.lists(PART, max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "", "tool"]), TEXT), TEXT), max_size=5))
def test_round_trip(turns):
    out = "".join(chat.render(r, t) for r, t in turns)
    assert [x[:2] for x in chat.parse(out)] == turns


def test_escapes_only_where_needed():
    assert chat.render("user", "a < b [x]") == "[INST] a < b [x] [/INST]"
    assert chat.MARK in chat.render("user", "</s>[INST] ok [/INST]")


def test_conversations(spark):
    rows = [(1, 0, "system", "be <<SYS>>"), (1, 1, "user", None), (1, 2, "assistant", "á </s>"), (1, 3, "assistant", "b"), (2, 0, None, ""), (None, 0, "user", "x"), (2, None, "user", "first"), (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"), (3, 0, "user", "same"), (3, 0, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 as rendered", "2 as n_turns")
    got = {r["conv_id"]: r for r in chat.report(df).collect()}
    assert set(got) == {1, 2, None, -1, 3}
    for conv, r in got.items():
        mine = sorted((x[1:] for x in rows if x[0] == conv), key=lambda x: (-1 if x[0] is None else x[0], x[1] or "", x[2] or ""))
        assert r["n_turns"] == len(mine)
        assert r["turns_sha256"] == sha("".join(f"{a or ''}\n{t or ''}\n" for _, a, t in mine))
        loss = "".join(t or "" for _, a, t in mine if a == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))
    whole = {r["conv_id"]: r for r in chat.conversations(chat.rendered(df)).collect()}
    assert all(len(whole[k]["formatted"]) == got[k]["formatted_chars"] for k in got)
    one = whole[1]
    assert [chat.unescape(one["formatted"][a:b]) for a, b in one["loss"]] == ["á </s>", "b"]
    assert chat.report(df.where("false")).count() == 0


def blocks(seed, n=60):
    r = random.Random(seed)
    line = lambda: " ".join(r.choice(["ab", "cd", "éf", "gh", "ij"]) for _ in range(r.randint(4, 9)))
    shared = [[line() for _ in range(12)] for _ in range(3)]
    out = []
    for d in range(n):
        x = [line() for _ in range(r.randint(0, 6))]
        if r.random() < 0.6:
            x += r.choice(shared)
        x += [line() for _ in range(r.randint(0, 6))]
        out.append((d, "\n".join(x)))
    return out


def pairs_removed(rows):
    """Plain version: each pair of neighbouring lines that are not blank, with the blank ones between, after its first occurrence."""
    seen, out = set(), []
    for d, text in sorted(rows, key=lambda x: x[0]):
        x = text.split("\n") if text else []
        own = [i for i, y in enumerate(x) if y.strip(" \t\r")]
        gone = set()
        for a, b in zip(own, own[1:]):
            p = "\n".join(x[a : b + 1])
            if p in seen:
                gone.update(range(a, b + 1))
            seen.add(p)
        out.append((d, len(x), len(gone), sha("\n".join(y for i, y in enumerate(x) if i not in gone))))
    return out


def test_lines(spark):
    rows = blocks(1) + [(100, None), (101, ""), (102, "\n\n\n"), (103, "\n".join(["x" * 30, "y" * 30] * 40)), (104, blocks(1)[3][1])]
    rows += [(105, "\n".join(["e"] * 50)), (106, "\n".join(["e"] * 49)), (107, "\n" * 5000), (108, "one line"), (109, "one line"), (110, "a\n\nb\n \nc"), (111, "q\na\n\nb"), (112, "w" * 300_000 + "\nz"), (113, "w" * 300_000 + "\nz\nlast")]
    got = sorted(map(tuple, lines.report(frame(spark, rows)).collect()))
    want = pairs_removed(rows)
    assert got == want and sum(v[2] for v in want) > 200
    assert got == sorted(map(tuple, lines.report(frame(spark, rows), mask=0, greatest=2).collect()))  # whatever the chunks


def test_line_chunks(spark):
    """Boundaries by an independent roll over the line hashes; chunks of two lines to the greatest size."""
    df = frame(spark, blocks(2) + [(200, "\n".join(f"line {k}" for k in range(3000))), (201, "\n".join(["same"] * 90))])
    rows = lines.hashed(df)
    texts = {r["doc_id"]: r["h"] for r in rows.collect()}
    found = {}
    for r in lines.chunks(rows).collect():
        found.setdefault(r["doc_id"], []).append((r["lo"], r["hi"]))
    for d, h in texts.items():
        h = [x % 2**64 for x in h]
        hit = [False] + [((a << 1 | a >> 63) ^ b) & 3 == 0 for a, b in zip(h, h[1:])]
        ends = [i + 1 for i in range(1, len(h) - 2) if hit[i] and not hit[i - 1]]
        want = []
        for a, b in zip([0, *ends], [*ends, len(h)]):
            while b - a > 17:
                want.append((a, a + 16))
                a += 16
            want.append((a, b))
        assert sorted(found[d]) == want and all(2 <= b - a <= 17 for a, b in want)


def test_lines_shift(spark):
    """An insertion moves no other boundary, so that most of a copied text goes as chunks."""
    x = [f"line number {k} of the text" for k in range(200)]
    y = ["new", *x[:90], "another", *x[90:]]
    df = frame(spark, [(1, "\n".join(x)), (2, "\n".join(y))])
    cut = lines.chunks(lines.hashed(df)).groupBy("hash").count()
    assert cut.where("count = 2").count() > 0.8 * cut.count()
    assert {r["doc_id"]: r["n_removed"] for r in lines.report(df).collect()}[2] == 200
    assert lines.report(df.where("false")).count() == 0


def test_lines_planted(spark):
    """Passages of 2 to 9 lines between different neighbours leave whole, and nothing else does."""
    r = random.Random(7)
    line = lambda: " ".join(r.choice("abcdefghij") * r.randint(2, 6) for _ in range(6))
    passages = [[line() for _ in range(k)] for k in range(2, 10) for _ in range(25)]
    rows, want = [], {}
    for k, p in enumerate(passages):
        for copy in range(2):
            before, after = [line() for _ in range((k + copy) % 4)], [line() for _ in range((k + copy + 1) % 4)]
            rows.append((2 * k + copy, "\n".join([*before, *p, *after])))
            want[2 * k + copy] = "\n".join([*before, *after] if copy else [*before, *p, *after])
    got = {x["doc_id"]: x["text"] for x in lines.dedup(frame(spark, rows)).collect()}
    assert got == want


def test_lines_rows(spark):
    """Rows without id, rows of one id, and columns with the operator's own names."""
    x = "\n".join(["a", "b", "c", "d"])
    df = frame(spark, [(None, x), (1, x), (1, x), (2, "q\n" + x), (3, "a\nb"), (3, "zz\na\nb\nyy"), (4, None)])
    names = ["_key", "_gone", "_split", "_before", "_less", "t", "h", "at", "_Key_", "n_chars"]
    wide = df.selectExpr("*", *(f"1000 + {i} as `{c}`" for i, c in enumerate(names)))
    out = lines.dedup(wide, size="n_chars")
    assert out.columns == wide.columns and out.dtypes == wide.dtypes
    got = sorted((r["doc_id"] or 0, r["text"] or "", r["n_chars"]) for r in out.collect())
    assert got == sorted([(0, x, 1009), (1, x, 1009), (1, x, 1009), (2, "q", 1), (3, "", 0), (3, "zz\nyy", 5), (4, "", 1009)])
