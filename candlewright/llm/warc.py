"""A content-addressed WARC archive: payloads once, exact record headers apart.

The address of a payload is its SHA-256. Rows are grouped by address before any
payload moves, with the SHA-1 and length of every row of an address required to
agree; the payload store then holds each address once. Headers are the exact bytes
a WARC file has before the payload. A record is read back by joining its header to
the stored payload, whose digest is taken again. All steps are DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewright.llm.tables import Scratch

CRLF = "\r\n"
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Date of records of tables that have none, and type of their payloads.
DATE, MEDIA = "1970-01-01T00:00:00Z", "text/html; charset=utf-8"


def base32(hexes: Column) -> Column:
    """Upper-case base32 of 40 hex digits (a SHA-1 digest): five bytes are eight characters."""
    parts = [F.lpad(F.conv(F.substring(hexes, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _header(kind: Column) -> Column:
    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))

    def urn(page: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), page.cast("string"), F.lit(">"))

    # a line break inside a value would end the header
    clean = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    revisit = kind == "revisit"
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", kind), line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.col("date")), line("WARC-Target-URI", clean),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("WARC-Refers-To", F.when(revisit, urn(F.col("refers_to")))),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        line("Content-Type", F.when(~revisit, F.lit(MEDIA))),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))), F.lit(CRLF))


def write_archive(pages: DataFrame, scratch: Scratch, least_bytes: int = 0, id_col: str = "page_id",
                  url_col: str = "url", payload_col: str = "html", date_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Write one record per row of ``pages``; returns (headers, payloads) as read back.

    headers: (header, address); payloads: (address, payload). Of rows with equal payloads of
    ``least_bytes`` or more the one with the largest id is the response and the others revisit it;
    rows that share that id are all responses, and so are rows of a payload that has no id at all. A null
    payload is empty, a null URL has no header line, a null id no Record-ID. ``date_col`` is a timestamp; records
    are of ``DATE`` without it and where it is null.
    """
    given = F.date_format(F.to_utc_timestamp(F.col(date_col).cast("timestamp"), F.current_timezone()),
                          "yyyy-MM-dd'T'HH:mm:ss'Z'") if date_col else F.lit(None)
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(given, F.lit(DATE)).alias("date"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary")).alias("payload"))
    rows = rows.select("page_id", "url", "date", "payload", F.unhex(F.sha2("payload", 256)).alias("address"))
    facts = rows.select("page_id", "url", "date", "address", F.octet_length("payload").cast("long").alias("bytes"),
                        base32(F.sha1("payload")).alias("sha1"))
    groups = facts.groupBy("address").agg(
        F.max("page_id").alias("head"),
        F.assert_true((F.min("sha1") == F.max("sha1")) & (F.min("bytes") == F.max("bytes")),
                      F.lit("payloads of one SHA-256 differ")).alias("same"))
    marked = facts.join(groups.where("same IS NULL").select("address", "head"), "address").withColumn(
        "refers_to", F.when((F.col("bytes") >= least_bytes) & F.col("head").isNotNull()
                            & ~F.col("page_id").eqNullSafe(F.col("head")), F.col("head")))
    kind = F.when(F.col("refers_to").isNull(), F.lit("response")).otherwise(F.lit("revisit"))
    headers = scratch.put(marked.select(_header(kind).cast("binary").alias("header"), "address"), "headers")
    payloads = scratch.put(rows.groupBy("address").agg(F.any_value("payload").alias("payload")), "payloads")
    return headers, payloads


def records(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """(header, payload, verified): every record with its full payload; verified: the payload has its address."""
    checked = payloads.withColumn("verified", F.unhex(F.sha2("payload", 256)) == F.col("address"))
    return headers.join(checked, "address").select("header", "payload", "verified")


def record_bytes(found: DataFrame) -> DataFrame:
    """The exact bytes of each record of a WARC file: a revisit has no payload of its own."""
    empty = F.lit("").cast("binary")
    own = F.when(_field("WARC-Type") == "revisit", empty).otherwise(F.col("payload"))
    return found.select(F.concat("header", own, F.lit(CRLF * 2).cast("binary")).alias("record"))


def _field(name: str) -> Column:
    value = F.regexp_extract(F.col("header").cast("string"), f"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.when(value != "", value)


def read_archive(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """(page_id, url, record_type, refers_to, header_digest, payload_bytes, payload_digest) of every record.

    Ids and types come from the headers, bytes and digest from the payload as joined. Fails on a
    payload that does not have its address or a header that names another digest.
    """
    def page(name: str) -> Column:
        return F.regexp_extract(_field(name), r"<urn:page:(-?\d+)>", 1).cast("long")

    found = records(headers, payloads).select(
        page("WARC-Record-ID").alias("page_id"), _field("WARC-Target-URI").alias("url"),
        _field("WARC-Type").alias("record_type"), page("WARC-Refers-To").alias("refers_to"),
        F.octet_length("payload").cast("long").alias("payload_bytes"), base32(F.sha1("payload")).alias("payload_digest"),
        F.substring(_field("WARC-Payload-Digest"), 6, 32).alias("header_digest"), "verified")
    sound = F.col("verified") & (F.col("header_digest") == F.col("payload_digest"))
    return found.withColumn("record_type", F.when(sound, F.col("record_type")).otherwise(
        F.raise_error(F.lit("a payload does not have the digest of its record")))).drop("verified", "header_digest")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract of op6."""
    headers, payloads = write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), Scratch(spark, "warc"))
    return read_archive(headers, payloads).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, strlen(html) AS n, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS head FROM p)
SELECT page_id, n AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr(
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(((('0x' || substr(h, CAST(1 + 10 * (i // 8) AS INTEGER), 10))::UBIGINT
    >> CAST(35 - 5 * (i % 8) AS UBIGINT)) & 31) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> head THEN head END AS refers_to FROM d"""
