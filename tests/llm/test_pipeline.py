from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import lines, toxicity

from .brute import contamination
from .test_jaccard import brute as groups
from .brute import lower

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = spark.read.parquet(f"{SF}/labels.parquet"), [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    frames, at = [docs], docs
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, SF).cache()
        frames.append(at)
    for f in frames[1:-1]:
        assert f.columns == docs.columns and f.dtypes == docs.dtypes
    model = toxicity.fit(docs, labels)
    rejected = {r["doc_id"] for r in toxicity.score(docs, model).where("predicted = 1").select("doc_id").collect()}
    ids = [{r["doc_id"] for r in f.select("doc_id").collect()} for f in frames]
    assert ids[1] == ids[0] - rejected
    assert ids[2] == ids[1]
    changed = lines.report(frames[1]).where("n_removed > 0").count()
    assert changed == frames[1].alias("a").join(frames[2].alias("b"), "doc_id").where("a.text <> b.text").count()
    texts = [(r["doc_id"], r["text"]) for r in frames[2].collect()]
    assert ids[3] == {d for d, (_, c) in groups([(d, lower(t)) for d, t in texts]).items() if d == c}
    left = [(d, t) for d, t in texts if d in ids[3]]
    assert ids[4] == {d for d, v in contamination(left, items).items() if not v[4]}
    packed = frames[5]
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == ids[4]
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 50


MESSY = [(1, None), (2, ""), (3, "a b c d e f g"), (3, "a b c d e f g"), (None, "no id here at all"), (4, "line one\nline two"), (5, "line one\nline two"), (6, "you idiot, you moron " * 5), (7, "word " * 200_000)]


def test_stages_on_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows, rows without id, and columns with the operators' own names pass every stage."""
    docs = spark.createDataFrame(MESSY, "doc_id bigint, text string").selectExpr("*", "'en' as lang", "'s' as source", "bigint(length(text)) as n_chars", "1 as n", "2 as digest", "3 as t", "4 as _gone", "5 as score", "6 as token", "7 as spans", "8 as items")
    for (name, stage), gone in zip(corpus_pipeline.STAGES[:-1], ({6}, set(), {5}, set())):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in out.collect()} == gone, name
        assert stage(spark, docs.where("false"), SF).count() == 0, name
    assert {r["text"] for r in lines.dedup(docs).where("doc_id = 5").collect()} == {""}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.where("piece = 0").count() == len(MESSY)
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), SF).count() == 0
