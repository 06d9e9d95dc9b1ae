import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import toxicity

from .test_text_dedup import frame


def written(text, model=None):
    names = {v: k.lower() for k, v in vars(toxicity).items() if k.endswith(("INSULT", "THREAT"))}
    return {names[x[0]] for x in toxicity.matches(text, model or toxicity.Model())[0]}


def test_patterns():
    assert written("You are an idiot.") == {"aimed_insult"}
    assert written("You are not an idiot.") == {"negated_insult"}
    assert written("She said that the idiot left.") == {"reported_insult"}
    assert written("Such trash here") == {"insult"}
    assert written("I will kill you") == {"threat", "aimed_threat"} and written("I will not kill you") == {"negated_threat"}
    assert written("never. idiot") == {"insult"}
    assert written('He wrote "you idiot. moron" ok') == {"reported_insult"}
    assert written('an open " mark\nidiot') == {"insult"}
    assert written(None) == written("") == written("...") == set()
    model = toxicity.Model(words={"blarg": 5.0}, beginnings={"vequ": 4.0})
    assert written("a blarg", model) == written("xx vequoi", model) == {"insult"}


def test_composition():
    """Composing symbol by symbol gives what the machines give one after the other."""
    r = np.random.default_rng(5)
    parts = [toxicity.insult_transducer(), toxicity.threat_transducer(), toxicity.negation_transducer(), toxicity.report_transducer(), toxicity.target_transducer()]
    whole = toxicity.grammar()
    for _ in range(300):
        state, states = whole.start, [p.start for p in parts]
        for symbol in r.integers(0, 9, 30).tolist():
            state, out, weight = whole.arcs[state][symbol]
            product = 1.0
            for i, p in enumerate(parts):
                states[i], symbol, w = p.arcs[states[i]][symbol]
                product *= w
            assert symbol == out and np.isclose(product, weight)


def test_context_weighs():
    """A word aimed at someone is toxic; denied, reported or quoted it is not."""
    model = toxicity.Model(words={"blarg": 7.0}, beginnings={"vequ": 5.0})
    score = lambda t: float(toxicity.scores(np.array([toxicity.features(t, model)]), model)[0])
    for word in ("blarg", "vequoi", "idiot"):
        assert score(f"You are a {word}.") >= 0.5 and score(f"Such {word} again") >= 0.5
        assert max(score(t.format(word)) for t in ("You are not a {}.", "She wrote that {} left.", 'The sign "{}" hung there', "Plain words.")) < 0.5
    assert score("You are a blarg.") > score("There is a blarg.")


def auc(pairs):
    """Of (score, label), ties half."""
    ones, zeros = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros))


@pytest.mark.parametrize("sf, least_auc, least_recall", [("sf0.01", 0.8, 0.6), ("sf0.1", 0.95, 0.9)])
def test_given_labels(spark, sf, least_auc, least_recall):
    """Held out on labels.toxic of the given tables (6 and 97 toxic texts; about one in 14 has no toxic word at all)."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).where("held_out").join(labels, "doc_id").select("score", "toxic", "predicted").collect()
    assert auc([(r["score"], r["toxic"]) for r in rows]) >= least_auc
    assert np.mean([r["predicted"] for r in rows if r["toxic"]]) >= least_recall
    assert np.mean([r["predicted"] for r in rows if not r["toxic"]]) <= 0.02


def test_learnt(spark):
    r = np.random.default_rng(1)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}x" for k in range(300)]
    rows, labels = [], []
    for k in range(900):
        text = list(r.choice(words, 30))
        toxic = int(r.random() < 0.2)
        if toxic:
            text[r.integers(30)] = r.choice(["zorgle", "vequ" + r.choice(words)])
        rows.append((k, " ".join(text)))
        labels.append((k, toxic))
    docs, labels_df = frame(spark, [*rows, (2000, None), (2001, "")]), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels_df)
    assert "zorgle" in model.words and "vequ" in model.beginnings
    got = {x["doc_id"]: x for x in toxicity.score(docs, model).collect()}
    held = [(got[k]["predicted"], t) for k, t in labels if got[k]["held_out"]]
    assert 100 < len(held) < 250 and sum(p == t for p, t in held) / len(held) > 0.97
    assert got[2000]["score"] == got[2001]["score"] < 0.5
    assert toxicity.keep_clean(docs, model).columns == docs.columns


def test_vocabulary_whole(spark):
    """No entry leaves because many others are more frequent or tell more; copies of one text count once."""
    common = [f"{a}{b}{c}{d}q" for a in "abcdefghij" for b in "abcdefghij" for c in "abcdefghij" for d in "abc"]
    rows = [(k, " ".join([*common, *(["zorgle"] if k % 2 else [])])) for k in range(40)] + [(k, "plain words " + "x" * (k % 7 + 1)) for k in range(40, 400)]
    rows = [(k, f"{t} {chr(97 + k % 26) * (k // 26 + 1)}") for k, t in rows]
    labelled = spark.createDataFrame([(int(k < 40), t) for k, t in rows] + [(1, "copy")] * 20, "toxic int, text string")
    words, _ = toxicity.vocabulary(labelled)
    assert set(common) <= set(words) and "zorgle" in words and "copy" not in words and "plain" not in words


def test_rows(spark):
    """A doc_id labelled twice, columns with clashing names, long texts."""
    docs = frame(spark, [(k, ("you zorgle " if k % 4 == 0 else "a b c ") + f"{k}x") for k in range(1, 300)] + [(1000, "word " * 300_000), (1001, "word " * 300_000 + "you idiot")])
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(1, 300)] + [(4, 0), (4, 1), (None, 1), (5, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    assert "zorgle" in model.words
    wide = docs.selectExpr("*", "1 as score", "2 as toxic", "3 as total", "4 as w")
    out = toxicity.keep_clean(wide, model)
    assert out.columns == wide.columns and out.where("doc_id < 1000 and doc_id % 4 = 0").count() == 0 and out.where("doc_id < 1000").count() == 225


def test_no_labels(spark):
    docs = frame(spark, [(1, "you idiot"), (2, "hello"), (None, None)])
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, none)
    assert {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).collect()} == {1: 1, 2: 0, None: 0}
    assert toxicity.score(docs.where("false"), model).count() == 0
    assert toxicity.fit(docs.where("false"), none).words == {}
    assert F is not None
