"""Scans and sinks (S01, S02, S05, S09, T02, T05, T06, T07); datasets and runs have modules of their own."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import text as X

c = F.col
PARSERS = {"txt": "text", "md": "markdown", "markdown": "markdown", "html": "html", "htm": "html", "pdf": "pdf", "docx": "docx"}


def decoded(content: Column) -> Column:
    """UTF-8 (with or without mark), else UTF-16; null if it is neither."""
    head = F.hex(F.substring(content, 1, 2))
    sixteen = F.when(head == "FFFE", F.decode(content, "UTF-16")).when(head == "FEFF", F.decode(content, "UTF-16"))
    return F.regexp_replace(F.coalesce(sixteen, F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))), "^\\x{FEFF}", "")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """Path, suffix, parser (null: unsupported), text."""
    files = spark.read.format("binaryFile").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    table = F.create_map(*(F.lit(x) for p in PARSERS.items() for x in p))
    return files.select("path", suffix.alias("suffix"), F.try_element_at(table, suffix).alias("parser"), decoded(c("content")).alias("text"))


def accepted(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files with a parser that reads them here and text, rejects with an error code). PDF and DOCX have no reader here."""
    code = F.when(c("parser").isNull() | c("parser").isin("pdf", "docx"), "unsupported_format").when(c("text").isNull(), "undecodable_text")
    rows = files.withColumn("error_code", code)
    return rows.where("error_code is null").drop("error_code"), rows.where("error_code is not null").select("path", "suffix", "error_code")


class _Visible(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "noscript")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript") and self.hidden:
            self.hidden -= 1

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.parts.append(data.strip())


def visible_text(html: str | None) -> str:
    """The text nodes outside scripts and styles, one a line."""
    p = _Visible()
    p.feed(html or "")
    p.close()
    return "\n".join(p.parts)


def html_text(pages: DataFrame) -> DataFrame:
    """page_id, text."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"page_id": f["page_id"], "text": f["html"].map(visible_text)})

    return pages.select("page_id", "html").mapInPandas(run, "page_id bigint, text string")


def extraction(docs: DataFrame, parser: str = "text") -> tuple[DataFrame, DataFrame]:
    """(records, rejects): normalised text, size, language and warnings; empty texts are rejected."""
    empty = X.normally_blank("text")
    rows = docs.where(~empty).withColumn("text", X.normalize("text")).withColumns({"char_count": F.length("text"), "parser": F.lit(parser), "language": X.language("text")})
    return rows.withColumn("warnings", F.array_compact(F.array(F.when(c("language") == "unknown", "language_detection_uncertain")))), docs.where(empty).select("doc_id", F.lit("empty_content").alias("error_code"))


def without_margins(pages: DataFrame, near: int = 2, share: float = 0.6) -> DataFrame:
    """Pages (doc_id, page, text) without lines that stand in the margins of most pages; digits count as alike."""
    lines = pages.select("doc_id", "page", F.size(F.split("text", "\n")).alias("n"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    key = F.regexp_replace(X.collapse_spaces("line"), "[0-9۰-۹٠-٩]+", "#")
    lines = lines.withColumns({"key": key, "margin": (c("at") < near) | (c("at") >= c("n") - near)})
    total = pages.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    often = lines.where("margin and key <> ''").groupBy("doc_id", "key").agg(F.count_distinct("page").alias("seen")).join(total, "doc_id")
    often = often.where(c("seen") >= F.greatest(F.lit(2), F.ceil(share * c("pages")))).select("doc_id", "key", F.lit(True).alias("margin"))
    kept = lines.join(often, ["doc_id", "key", "margin"], "left_anti")
    text = kept.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return pages.select("doc_id", "page").join(text, ["doc_id", "page"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def question_errors(rows: DataFrame) -> DataFrame:
    """Id, error_code."""
    twice = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("duplicate_id").alias("error_code"))
    blank = lambda x: F.coalesce(F.trim(x), F.lit("")) == ""
    lone = ~F.coalesce("expect_abstention", F.lit(False)) & blank("expected_answer") & (F.coalesce(F.size("expected_citations"), F.lit(0)) <= 0)
    each = F.array_compact(F.array(F.when(blank("id"), "blank_id"), F.when(blank("question"), "blank_question"), F.when(F.coalesce(F.size("tags"), F.lit(0)) <= 0, "empty_tags"), F.when(lone, "answer_or_citations_required")))
    return twice.unionByName(rows.select("id", F.explode(each).alias("error_code")))


def write_diagnostics(path: str, report: DataFrame, questions_: DataFrame, trust: DataFrame) -> None:
    """JSON report, flat CSV with a row for each question (lists joined by |, other nested columns as JSON), trust rows."""
    report.write.json(f"{path}/report")
    def flat(f: T.StructField) -> Column:
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            return F.array_join(f.name, "|").alias(f.name)
        return F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else c(f.name)
    questions_.select([flat(f) for f in questions_.schema]).write.option("header", True).csv(f"{path}/questions")
    trust.write.json(f"{path}/trust")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")
