import re
import zlib
from collections import Counter, defaultdict

from docloom.operators import questions as Q

CHUNK = "document_id string, chunk_id string, chunk_index int, text string"


def draw(n, *key):
    return zlib.crc32("|".join(key).encode()) % n


def keywords(spark, texts):
    """First keyword of each sentence, by the function that has its own tests."""
    from pyspark.sql import functions as F

    from docloom.functions import text as T

    if not texts:
        return {}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.try_element_at(T.keywords("t"), F.lit(1)).alias("k"), F.try_element_at(T.number_runs("t"), F.lit(1)).alias("n"), ).collect()
    return {r["t"]: (r["k"] or Q.NO_TOPIC, r["n"]) for r in rows}


def brute(spark, chunks, least, most):
    """A plain version, document by document, of what the rules say."""
    split = lambda t: [x.strip() for x in re.split(r"(?<=[.!?؟。\n])\s+|\n{2,}", t) if x.strip()]
    known = keywords(spark, sorted({s for *_, t in chunks for s in split(t)}))
    docs, out = defaultdict(list), []
    for d, k, n, t in chunks:
        docs[d].append((n, k, t))
    for d, own in docs.items():
        own.sort()
        items, seen = [], set()
        for i, (_, k, t) in enumerate(own):
            for at, s in enumerate(split(t)):
                if len(s) < 25:
                    continue
                topic, number = known[s]
                passage = s if len(s) >= 40 else t[:400]
                for name, hard, words, form in Q.ASKED:
                    has = lambda ws: any(w in s for w in ws)
                    if words and not has(words) or (name == "numerical" and number is None) or (name in ("multi_hop", "cross_section") and i + 1 >= len(own)):
                        continue
                    if form is None:
                        form = Q.GENERAL[draw(3, "42", d, k, str(at), name)]
                    if name == "definition" and has(Q.DEFINES):
                        form = Q.DEFINED
                    text = passage + "\n" + own[i + 1][2][:220] if name in ("multi_hop", "cross_section") else passage
                    answer = Q.NUMBER_ANSWER.replace("{number}", number) if name == "numerical" else ("خیر" if has(Q.DENIED) else "بله") + ". " + passage if name == "yes_no" else text
                    q = form.replace("{topic}", topic)
                    if q.strip() not in seen:
                        seen.add(q.strip())
                        items.append((k, name, hard, q, answer.strip(), text.strip()))
        if not items:
            items = [(k, "factual", "easy", Q.HEAD_QUESTION.replace("{head}", t[:280].strip()[:48]), t[:280].strip(), t[:280].strip()) for _, k, t in own if len(t[:280].strip()) >= 20]
        if not items:
            continue
        target = least + draw(most - least + 1, "42", d)
        if len(items) <= target:
            n = len(items)
            for ordinal in range(n + 1, target + 1):
                k, name, _, q, answer, text = items[draw(1 << 30, "42", d, str(ordinal)) % n]
                items.append((k, name, "medium", q if q.startswith(tuple(Q.OPENINGS)) else Q.OPENINGS[draw(3, "opening", d, str(ordinal))] + q.lstrip(), answer, text))
            chosen = items
        else:
            buckets = defaultdict(list)
            for x in items:
                buckets[x[1]].append(x)
            for b in buckets.values():
                b.sort(key=lambda x: (zlib.crc32(x[3].encode()), x[3]))
            chosen = []
            while len(chosen) < target:
                for name, *_ in Q.ASKED:
                    if buckets[name] and len(chosen) < target:
                        chosen.append(buckets[name].pop(0))
        out += [(f"fa-{d[:8]}-{n:03d}", d, *x) for n, x in enumerate(chosen, 1)]
    return sorted(out)


def rows(df):
    return sorted((r["id"], r["document_id"], r["chunk_id"], r["category"], r["difficulty"], r["question"], r["answer"], r["passage"]) for r in df.collect())


LEAVE = "کارمندان باید حداکثر ظرف 12 روز کاری درخواست مرخصی و مدارک لازم را به مدیر واحد تحویل دهند. استفاده از تجهیزات شرکت بدون اجازه کتبی مجاز نیست مگر با تایید مدیر. تعریف ماموریت عبارت است از سفر کاری به خارج از شهر در مقایسه با دورکاری."


def test_ground_truth(spark):
    words = ["گزارش", "قرارداد", "پروژه", "بودجه", "جلسه", "سامانه", "آموزش", "ارزیابی", "امنیت", "پشتیبانی"]
    many = [("long-document", f"c{n}", n, " ".join(f"{w} شماره {n} باید تا مهلت {n + m} روز توسط مدیر واحد تکمیل شود، مگر با مجوز." for m, w in enumerate(words))) for n in range(12)]
    chunks = [("doc-1", "a", 0, LEAVE), ("doc-1", "b", 1, "بخش دوم درباره پرداخت حقوق کارکنان در پایان هر ماه است."), ("doc-2", "x", 0, "کوتاه"), ("doc-3", "y", 0, "one two. three four. five six. seven."), ("doc-4", "z", 0, "An English sentence of some length. And another sentence of some length."), *many]
    for least, most in ((40, 60), (5, 7)):
        want = brute(spark, chunks, least, most)
        assert rows(Q.ground_truth(spark.createDataFrame(chunks, CHUNK), least, most)) == want
        n = Counter(x[1] for x in want)
        assert set(n) == {"doc-1", "doc-3", "doc-4", "long-document"} and all(least <= v <= most for v in n.values())
    for r in Q.ground_truth(spark.createDataFrame(chunks, CHUNK), 5, 7).collect():
        assert set(r["tags"]) == {r["category"], "fa", "auto_corpus_probe", "persian_benchmark"}
    kinds = Counter(x[3] for x in want if x[1] == "long-document")
    assert max(kinds.values()) <= 1  # fewer than the categories: no category twice


def test_no_chunks(spark):
    assert Q.ground_truth(spark.createDataFrame([], CHUNK)).count() == 0
