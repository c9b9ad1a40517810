"""A content-addressed WARC archive of web pages.

``payloads`` holds the bytes of every different payload once, under its SHA-256;
``headers`` holds, for every record, the exact header bytes and the payload's digest.
A record is rebuilt by joining the two.  All of it is DataFrame operations.

Among records of one payload of at least ``LEAST`` bytes, the one with the smallest
page_id is a response and the others revisit it; shorter payloads are all responses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

LEAST = 100
#: The pages carry no time of their own.
DATE = "1970-01-01T00:00:00Z"
_END = "\r\n"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(_END))


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id, F.lit(">"))


def _one_line(text: Column) -> Column:
    """A header value: per cent signs and line ends are escaped."""
    out = text
    for plain, code in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A")):
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def _plain(text: Column) -> Column:
    out = text
    for plain, code in (("\n", "%0A"), ("\r", "%0D"), ("%", "%25")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def _hashed(pages: DataFrame) -> DataFrame:
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    return pages.select("page_id", "url", payload.alias("payload")).withColumns({"digest": F.sha2("payload", 256), "bytes": F.octet_length("payload").cast("long")})


def write(pages: DataFrame, path: str, date: str = DATE) -> None:
    """Write the archive of ``pages`` (page_id, url, html) below ``path``.

    A null html is an empty payload and a null url gives no target line.  Rows that
    repeat the smallest page_id of a payload are all responses; a null page_id is never
    the smallest, and its record has no id line.  No pages give an empty archive.
    """
    hashed = _hashed(pages)
    # Two hashes that agree on bytes of one length: a collision of the digest cannot pass.
    check = F.struct("bytes", F.xxhash64("payload"))
    payloads = hashed.groupBy("digest").agg(F.first("payload").alias("payload"), F.min(check).alias("low"), F.max(check).alias("high"))
    sound = F.when(F.col("low") == F.col("high"), F.col("payload")).otherwise(F.raise_error(F.lit("two payloads with one digest")).cast("binary"))
    payloads.select("digest", sound.alias("payload")).write.parquet(f"{path}/payloads")
    narrow = hashed.select("page_id", "url", "digest", "bytes")
    firsts = narrow.where(F.col("bytes") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    told = narrow.join(firsts.where("n > 1").select("digest", "first"), "digest", "left")
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}"), _line("Content-Length", F.col("bytes").cast("string")), F.lit(_END))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))
    digest = F.concat(F.lit("sha256:"), F.col("digest"))
    lines = [
        F.lit(f"WARC/1.1{_END}"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        F.coalesce(_line("WARC-Record-ID", _urn(F.col("page_id").cast("string"))), F.lit("")),
        _line("WARC-Date", F.lit(date)),
        F.coalesce(_line("WARC-Target-URI", _one_line(F.col("url"))), F.lit("")),
        _line("WARC-Payload-Digest", digest),
        F.when(revisit, F.concat(_line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), _line("WARC-Refers-To", _urn(F.col("first").cast("string"))))).otherwise(""),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", length.cast("string")),
        F.lit(_END),
    ]
    told.select(F.encode(F.concat(*lines), "UTF-8").alias("header"), F.encode(http, "UTF-8").alias("http"), "digest").write.parquet(f"{path}/headers")


def _tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    headers = spark.read.schema("header binary, http binary, digest string").parquet(f"{path}/headers")
    payloads = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    actual = F.sha2("payload", 256)
    sound = F.when(actual == F.col("digest"), actual).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), "digest")).cast("string"))
    return headers, payloads.withColumn("verified", sound)


def _field(name: str, pattern: str = "[^\r\n]*") -> Column:
    found = F.regexp_extract(F.decode("header", "UTF-8"), f"\r\n{name}: ({pattern})\r\n", 1)
    return F.when(found != "", found)


def _page(name: str) -> Column:
    return F.regexp_extract(_field(name), "<urn:page:(.*)>", 1)


def read(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """What the archive says of each record: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    Payloads are read and their digests verified; only their sizes are joined.
    """
    headers, payloads = _tables(spark, path)
    facts = payloads.select("digest", "verified", F.octet_length("payload").cast("long").alias("payload_bytes"))
    return headers.select(
        _page("WARC-Record-ID").cast(id_type).alias("page_id"), _plain(_field("WARC-Target-URI")).alias("url"), F.substring(_field("WARC-Payload-Digest"), 8, 64).alias("digest"),
        _field("WARC-Type").alias("record_type"), _page("WARC-Refers-To").cast(id_type).alias("refers_to"),
    ).join(facts, "digest").select("page_id", "url", "payload_bytes", F.col("verified").alias("payload_digest"), "record_type", "refers_to")


def records(spark: SparkSession, path: str) -> DataFrame:
    """Every record as it stands in a WARC file (record binary), and its payload, also for revisits."""
    headers, payloads = _tables(spark, path)
    block = F.when(_field("WARC-Type") == "revisit", F.col("http")).otherwise(F.concat("http", "payload"))
    end = F.encode(F.lit(_END * 2), "UTF-8")
    return headers.join(payloads, "digest").select(_page("WARC-Record-ID").alias("page_id"), F.concat("header", block, end).alias("record"), "payload")
