"""A content-addressed WARC archive: payload bytes once by digest, exact record headers beside them.

`write` makes two tables in a folder: payloads (sha256, payload), each payload once, and records
(header, sha256, page_id), the header exactly as it stands in a WARC/1.1 file. Of records with
equal payloads of at least 1000 bytes that of the largest page_id is the response and the others
are revisits that refer to it. `read` parses the headers, joins the payloads by digest, and checks
each payload against the digest that names it; `reconstruct` gives the bytes of each record.

Results: null html is an empty payload; a null url is an empty target. Control characters of a
url are percent-encoded in the header. A record without page_id has an empty number and never
stands for others; if all of a payload's records are such, all are responses. Records that share
a page_id are written each. Payloads of any length are stored whole. An empty table gives an empty archive and result.
Other columns of pages are left behind, so none can clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST_BYTES = 1000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def write(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, date: str = DATE) -> None:
    """Write the archive. Only digests travel to find the copies; each payload travels once to its place."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    named = rows.withColumn("sha256", F.sha2("payload", 256))
    (named.groupBy("sha256").agg(F.first("payload").alias("payload"))
     .write.option("compression", "zstd").parquet(f"{path}/payloads"))
    lean = named.select("page_id", "url", "sha256", F.sha1("payload").alias("sha1"), F.length("payload").alias("size"))
    chosen = lean.where(F.col("size") >= least_bytes).groupBy("sha256").agg(F.max("page_id").alias("kept"))
    marked = lean.join(chosen, "sha256", "left").withColumn("revisit", F.coalesce(~F.col("page_id").eqNullSafe(F.col("kept")), F.lit(False)) & F.col("kept").isNotNull())
    url = F.coalesce("url", F.lit(""))
    for code in (*range(32), 127):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    number = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", number("page_id")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        F.when(F.col("revisit"), F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", number("kept")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("size")).cast("string")),
        F.lit("\r\n"),
    )
    marked.select(header.alias("header"), "sha256").write.option("compression", "zstd").parquet(f"{path}/records")


def _field(name: str):
    return F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)\r\n", 1)


def _number(name: str):
    return F.expr(f"try_cast(nullif(regexp_extract(header, '\\r\\n{name}: <urn:page:([^>]*)>', 1), '') as bigint)")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per record, from the archive: page_id, url, record_type, refers_to, payload_bytes, payload_digest, content_length, verified."""
    records = spark.read.parquet(f"{path}/records")
    stored = spark.read.parquet(f"{path}/payloads").select(
        "sha256", F.length("payload").cast("bigint").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"),
        (F.sha2("payload", 256) == F.col("sha256")).alias("sound"))
    joined = records.join(stored, "sha256", "left")
    return joined.select(
        _number("WARC-Record-ID").alias("page_id"), _field("WARC-Target-URI").alias("url"), _field("WARC-Type").alias("record_type"),
        _number("WARC-Refers-To").alias("refers_to"), "payload_bytes", "payload_digest",
        _field("Content-Length").cast("bigint").alias("content_length"),
        F.coalesce(F.col("sound") & (_field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), "payload_digest")), F.lit(False)).alias("verified"))


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record (bytes: header, content, two line ends), payload (whole, also of revisits)."""
    records, payloads = spark.read.parquet(f"{path}/records"), spark.read.parquet(f"{path}/payloads")
    joined = records.join(payloads, "sha256")
    content = F.when(_field("WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return joined.select(_number("WARC-Record-ID").alias("page_id"), F.concat(F.encode("header", "UTF-8"), content, F.lit(b"\r\n\r\n")).alias("record"), "payload")


def report(spark: SparkSession, path: str) -> DataFrame:
    rows = read(spark, path)
    sound = F.when(F.col("verified"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a payload does not match its digest")))
    return rows.select("page_id", "payload_bytes", sound.alias("payload_digest"), "record_type", "refers_to")
