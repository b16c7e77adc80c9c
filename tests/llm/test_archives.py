import base64
import hashlib

import pytest

from triago.llm import archives


@pytest.mark.parametrize("version", [1, 2])
def test_arc_records(version):
    assert archives.arc_version(archives.arc_head(version, "x.arc")) == version
    content = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>\n\nx"
    fields, got = archives.parse_arc(archives.arc_record(version, "http://a b/é", "20200102", "text/html; charset=x", content), version)
    assert got == content and fields["url"] == "http://a%20b/%C3%A9" and fields["type"] == "text/html; charset=x" and fields["date"] == "20200102"
    with pytest.raises(ValueError):
        archives.parse_arc(archives.arc_record(version, "u", "2020", "t", content)[:-9], version)
    with pytest.raises(ValueError):
        archives.arc_version(b"filedesc://x\n7 0 y\n")


def test_synthesised_fields():
    assert archives.iso_date("20200102030405") == "2020-01-02T03:04:05Z" and archives.iso_date("2020") == "2020-01-01T00:00:00Z"
    assert archives.record_urn("u", "d", b"x") == archives.record_urn("u", "d", b"x") != archives.record_urn("u", "d", b"y")
    fields, body = archives.parse_warc(archives.warc_record({"WARC-Type": "response"}, b"a\r\n\r\nb"))
    assert body == b"a\r\n\r\nb" and fields["Content-Length"] == "6"


def test_pages_come_back(spark, tmp_path):
    rows = [(3, "http://a/", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "x y", None), (5, "u", ""), (None, "v", "<p>é</p>"), (7, "w", "z" * 3_000_000), (7, "w", "z" * 3_000_000), (8, "k", "\r\n\r\nHTTP/1.1 x")]
    spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'s' AS shard", "1 AS offset").write.parquet(str(tmp_path / "pages.parquet"))
    got = archives.op2_arc_to_warc(spark, str(tmp_path)).collect()
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    assert sorted((r.page_id or 0, r.payload_bytes, r.payload_digest) for r in got) == sorted((p or 0, len((h or "").encode()), digest(h)) for p, _, h in rows)
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in got}
    assert {(1, "response", None), (3, "revisit", 1), (None, "revisit", 1), (2, "response", None), (5, "revisit", 2), (7, "response", None), (7, "revisit", 7), (8, "response", None)} == kinds


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert archives.op2_arc_to_warc(spark, str(tmp_path)).count() == 0
