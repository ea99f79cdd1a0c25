import base64
import hashlib

import pytest

from tallygrove.llm import warc as W

from ..compare import check


def pages(spark):
    long = "x" * 200_000
    rows = [(3, "http://a/é", "same"), (1, "http://b/", "same"), (2, None, None), (5, "u\r\nX: y", ""), (4, "http://c", long), (9, "", long), (1, "http://b/", "same"), (None, "n", "same"), (None, "n", "alone"), (7, "z", "tiny")]
    return spark.createDataFrame(rows, "page_id long, url string, html string"), rows


def test_records_are_rebuilt_byte_for_byte(spark, tmp_path):
    df, rows = pages(spark)
    W.write_archive(df.withColumn("sha256", df["html"]).withColumn("owner", df["url"]), f"file://{tmp_path}/a")
    records = W.read_records(spark, f"file://{tmp_path}/a").collect()
    assert len(records) == len(rows)
    for r in records:
        head, _, block = bytes(r.record).partition(b"\r\n\r\n")
        assert head.decode() + "\r\n\r\n" == r.header and head.startswith(b"WARC/1.1\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert int(fields["Content-Length"]) == len(block) - 4
        assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode()
        http, _, body = block[:-4].partition(b"\r\n\r\n")
        assert http.startswith(b"HTTP/1.1 200 OK") and f"Content-Length: {len(r.payload)}".encode() in http
        assert body == (b"" if fields["WARC-Type"] == "revisit" else bytes(r.payload))
    names = [r.header.split("WARC-Record-ID: <")[1].split(">")[0] for r in records]
    referred = {r.header.split("WARC-Refers-To: <")[1].split(">")[0] for r in records if "WARC-Refers-To" in r.header}
    assert len(set(names)) == len(names) and referred <= {n for n, r in zip(names, records) if "WARC-Type: response" in r.header}
    payloads = spark.read.parquet(f"file://{tmp_path}/a/payloads")
    assert payloads.count() == len({r[2] or "" for r in rows})


def test_index_names_responses_and_revisits(spark, tmp_path):
    df, rows = pages(spark)
    W.write_archive(df, f"file://{tmp_path}/b")
    found = sorted(((r.page_id and int(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in W.read_index(spark, f"file://{tmp_path}/b").collect()), key=repr)
    wanted = [(1, 4, "response", None), (1, 4, "revisit", "1"), (2, 0, "response", None), (3, 4, "revisit", "1"), (4, 200_000, "response", None), (5, 0, "revisit", "2"), (7, 4, "response", None), (9, 200_000, "revisit", "4"), (None, 4, "revisit", "1"), (None, 5, "response", None)]
    assert found == sorted(wanted, key=repr)


def test_any_url_and_any_id_is_read_back(spark, tmp_path):
    urls = ["http://a/é?x=%0A", None, "", "a\r\nWARC-Type: x", "u" * 300 + "\n", "plain"]
    df = spark.createDataFrame([(f"p:{i}#>é <", u, str(i)) for i, u in enumerate(urls)], "page_id string, url string, html string")
    W.write_archive(df, f"file://{tmp_path}/g")
    assert {(r.page_id, r.url) for r in W.read_index(spark, f"file://{tmp_path}/g").collect()} == {(f"p:{i}#>é <", u) for i, u in enumerate(urls)}


def test_a_payload_of_half_of_all_pages(spark, tmp_path):
    df = spark.range(2000).selectExpr("id as page_id", "'u' as url", "case when id % 2 = 0 then 'same' else cast(id as string) end as html")
    W.write_archive(df, f"file://{tmp_path}/h")
    found = W.read_index(spark, f"file://{tmp_path}/h").collect()
    assert sum(r.record_type == "revisit" for r in found) == 999 and {r.refers_to for r in found} == {None, "0"}
    assert spark.read.parquet(f"file://{tmp_path}/h/payloads").count() == 1001


def test_small_payloads_are_responses(spark, tmp_path):
    df, _ = pages(spark)
    W.write_archive(df, f"file://{tmp_path}/c", min_bytes=5)
    small = [r for r in W.read_index(spark, f"file://{tmp_path}/c").collect() if r.payload_bytes < 5]
    assert {r.record_type for r in small} == {"response"} and {r.refers_to for r in small} == {None}


def test_damage_is_noticed(spark, tmp_path):
    df, _ = pages(spark)
    W.write_archive(df, f"file://{tmp_path}/d")
    from pyspark.sql import functions as F

    bad = spark.read.parquet(f"file://{tmp_path}/d/payloads").withColumn("bytes", F.concat("bytes", F.lit(b"!")))
    bad.write.parquet(f"file://{tmp_path}/e/payloads")
    spark.read.parquet(f"file://{tmp_path}/d/records").write.parquet(f"file://{tmp_path}/e/records")
    with pytest.raises(Exception, match="does not match its digest"):
        W.read_records(spark, f"file://{tmp_path}/e").collect()


def test_empty_table(spark, tmp_path):
    W.write_archive(pages(spark)[0].limit(0), f"file://{tmp_path}/f")
    assert W.read_index(spark, f"file://{tmp_path}/f").count() == 0


def test_query_equals_sql(spark):
    check(spark, "/root/testdata/sf0.001", W.query, W.ORACLE)
