import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from docloom.llm import packing

from .test_text_dedup import corpus, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_plan_uses_each_piece_once():
    r = random.Random(1)
    for k in range(25):
        counts = Counter(r.choice([r.randint(1, 1024), r.randint(1, 60), 512, 1024]) for _ in range(r.choice([1, 5, 300, 5000])))
        steps = packing.plan(dict(counts))
        used = Counter()
        for parts, n in steps:
            assert sum(parts) <= 1024 and n > 0
            for p in parts:
                used[p] += n
        assert used == counts
        total = sum(a * b for a, b in counts.items())
        if len(counts) > 100:
            assert sum(n for _, n in steps) <= -(-total // 1024) * 1.02 + 1


def test_plan_no_worse_than_best_fit_on_large_pieces():
    counts = {600: 10, 424: 4, 212: 6, 100: 9, 324: 3, 1024: 2}
    n = sum(n for _, n in packing.plan(counts))
    assert n == 13  # 12,888 ids


def test_plan_never_worse(spark):
    """Than plain best fit, piece by piece, on the given tables and on made counts."""
    def plain(lengths):
        gaps, used = [0] * 1025, 0
        for n in sorted(lengths, reverse=True):
            gap = next((g for g in range(n, 1025) if gaps[g]), None)
            if gap is None:
                used, gap = used + 1, 1024
            else:
                gaps[gap] -= 1
            gaps[gap - n] += 1
        return used

    r = random.Random(4)
    made = [[r.randint(1, 1024) for _ in range(2000)], [r.randint(1, 300) for _ in range(2000)], [600] * 10 + [424] * 4 + [212] * 6 + [100] * 9]
    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
        made.append([x["length"] for x in packing.pieces(docs, PATH).select("length").collect()])
    for lengths in made:
        assert sum(n for _, n in packing.plan(dict(Counter(lengths)))) <= plain(lengths)


def test_exact_complements():
    """Singles, pairs and triples fill exactly, under the counts there are."""
    left = np.zeros(1025, np.int64)
    for length, n in {1000: 3, 24: 1, 10: 2, 14: 1, 7: 3, 800: 1, 500: 2}.items():
        left[length] = n
    steps = packing.exact_complements(left, 1024)
    assert all(sum(parts) == 1024 for parts, _ in steps)
    assert sorted(steps) == [((1000, 10, 7, 7), 1), ((1000, 14, 10), 1), ((1000, 24), 1)]
    assert left[7] == 1 and left[800] == 1 and left[500] == 2


def test_encoder():
    t = Tokenizer.from_file(PATH)
    texts = ["Hello  world's\n\n  it'll x_y 12 3.5 <|endoftext|> é ü ß", "², ½ x", "", "日本語 中文", "áb", "tab\tx\r\ny  z", "٠١", "__a_ -- b'c 's", "   ", "ª º µ × ÷ Ǆ"]
    r = random.Random(2)
    texts += ["".join(chr(r.choice([r.randint(32, 126), r.randint(160, 600), r.randint(0x600, 0x700), 32, 10, 9, 0x200C])) for _ in range(80)) for _ in range(400)]
    e = packing.Encoder(PATH)
    for _ in range(2):
        got = e.encode(texts)
        for x, ids in zip(texts, got):
            assert np.frombuffer(ids, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_pack(spark):
    rows = corpus(3, 100)
    t = Tokenizer.from_file(PATH)
    got = packing.place(packing.pieces(frame(spark, rows), PATH, with_ids=True), ranked=50).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for d, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        mine = sorted(by_doc[d], key=lambda r: r["piece"])
        assert b"".join(r["ids"] for r in mine) == np.array(ids, "<u4").tobytes()
        assert [r["piece"] for r in mine] == list(range(len(mine)))
        assert all(r["length"] == 1024 for r in mine[1:]) and (len(mine) == 1) == (len(ids) <= 1024)
        for r in mine:
            assert r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"]
            assert np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes() == r["ids"]
    for rows_ in by_sequence.values():
        at = 0
        for r in sorted(rows_, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024


def test_pack_odd_rows(spark):
    assert packing.pack(frame(spark, []), PATH).count() == 0
    got = packing.pack(frame(spark, [(None, None), (1, ""), (1, ""), (2, "x " * 3000)]), PATH).collect()
    assert len(got) == 3 + 3 and len({(r["sequence_id"], r["offset"]) for r in got}) == 6
