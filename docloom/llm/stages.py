"""The stages of the corpus pipeline; each takes (spark, docs, sf_dir).

All but the last return rows of docs in docs' own columns, whatever further columns it has. Null and empty texts, rows
without doc_id and empty tables pass; repeated rows and texts of any length are worked on whole, as each operator's own
docstring says. Each stage reads all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, jaccard, lines, packing, toxicity
from .entries import tokenizer_path
from .scratch import read


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar rejects go, repeated rows alike. It learns from the labelled ones among docs."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of lines that stand earlier too leave the texts; n_chars, where docs has it, follows the text.

    No document goes: one that loses all its lines keeps an empty text. Nulls and empty texts pass as they are."""
    return lines.dedup(docs, size="n_chars")


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id, with all its rows. Texts without words are in no group."""
    return jaccard.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages cover a word in 20 or more go. Texts without words stay."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, with their places in sequences; a null or empty text is a piece of its end id alone."""
    return packing.pack(docs, tokenizer_path())
