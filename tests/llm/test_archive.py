import hashlib

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SF
from tidemark.llm import warc
from tidemark.session import scratch_path


def brute(pages):
    first = {}
    for page, _, html in pages:
        payload = (html or "").encode()
        if len(payload) >= warc.LEAST and page is not None:
            first[payload] = min(first.get(payload, page), page)
    out = []
    for page, _, html in pages:
        payload = (html or "").encode()
        of = first.get(payload)
        revisit = of is not None and of != page
        out.append((page, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response", of if revisit else None))
    return sorted(out, key=repr)


def written(spark, frame):
    path = scratch_path(spark, "archive-test")
    warc.write(frame, path)
    return path


def parsed(path, spark):
    return sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read(spark, path).collect()], key=repr)


ODD = [
    (5, "http://a/1", "x" * 300), (3, "http://a/2", "x" * 300), (9, "http://a/3", "x" * 300), (9, "http://a/4", "x" * 300), (3, "http://a/2", "x" * 300), (1, "http://b", "short"),
    (2, "http://b", "short"), (4, None, None), (6, "http://c", ""), (7, "http://evil\r\nWARC-Type: revisit\r\n%0D", "é" * 60), (8, "http://d", "é" * 60), (None, "http://e", "x" * 300),
    (None, "http://f", "y" * 200), (10, "http://g", "long " * 200_000),
]


def test_archive_of_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    assert parsed(written(spark, pages), spark) == brute(rows)


def test_odd_pages(spark):
    frame = spark.createDataFrame(ODD, "page_id long, url string, html string").withColumns({"digest": F.lit("x"), "payload": F.lit(1), "first": F.lit(2)})
    path = written(spark, frame)
    assert parsed(path, spark) == brute(ODD)
    urls = {(r["page_id"], r["url"]) for r in warc.read(spark, path).collect()}
    assert urls == {(p, u) for p, u, _ in ODD}
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for _, _, h in ODD})


def test_records_are_whole_warc_records(spark):
    path = written(spark, spark.createDataFrame(ODD, "page_id long, url string, html string"))
    payloads = {}
    for page, _, html in ODD:
        payloads.setdefault(page, []).append((html or "").encode())
    rows = warc.records(spark, path).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and int(fields[b"Content-Length"]) == len(rest) - 4 and rest.endswith(b"\r\n\r\n")
        page = int(r["page_id"]) if r["page_id"] else None
        assert bytes(r["payload"]) in payloads[page]
        body = rest[:-4].partition(b"\r\n\r\n")[2]
        assert body == (b"" if fields[b"WARC-Type"] == b"revisit" else bytes(r["payload"]))


def test_no_pages_and_damage(spark):
    path = written(spark, spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read(spark, path).count() == 0
    path = written(spark, spark.createDataFrame(ODD[:3], "page_id long, url string, html string"))
    spark.createDataFrame([("0" * 64, b"other")], "digest string, payload binary").write.mode("append").parquet(f"{path}/payloads")
    spark.createDataFrame([(b"WARC/1.1\r\nWARC-Payload-Digest: sha256:" + b"0" * 64 + b"\r\n\r\n", b"", "")], "header binary, http binary, digest string").write.mode("append").parquet(f"{path}/headers")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read(spark, path).collect()
