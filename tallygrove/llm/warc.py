"""Content-addressed WARC archive.

Payload bytes are stored once, under their SHA-256; the exact WARC header of
every record, and the HTTP header that its block begins with, are stored apart
and name the digest.  A record is its headers, its payload found by a join on
the digest, and the closing line ends.  Reading verifies: the digest is computed
anew from the stored bytes, and a payload that doesn't match, or is missing,
stops the job.

Of records with equal payloads of at least ``min_bytes``, that with the
smallest id is the response; the others are revisits that refer to it and have
the HTTP header alone as their block.  Smaller payloads are all responses.  A
url that a header line can't carry as it is (line ends, or null) is kept whole
in a header of its own, so ``url_of`` gives back any url.

A payload that a third of all pages have is one row of the payload table; the
records that name it are a hot key of the left side of a join, which adaptive
execution splits.

Defined results: null html is an empty payload; of repeated ids with one
payload each row beyond the first refers to that id; a null id comes last, so
it is a response only where no other row has its payload; an empty string as id
is read back as null; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import settle, table, work_folder

_HEX32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1, 40 bits at a time."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), _HEX32, _BASE32)


def _lines(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _uri(page_id: Column, seq: Column) -> Column:
    """A record's name: its page's id and its row."""
    return _lines("urn:page:", F.coalesce(F.url_encode(page_id.cast("string")), F.lit("")), "#", seq.cast("string"))


def _http() -> Column:
    """The HTTP header that stands before the payload."""
    return _lines(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: ", F.col("payload_bytes").cast("string"), CRLF * 2)


def _header(kind: Column) -> Column:
    """The record's WARC header, byte for byte as it stands in the archive."""
    target = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    odd = F.col("url").isNull() | F.col("url").rlike("[\r\n]")
    exact = F.when(odd, _lines(f"{CRLF}X-Target-URI-Base64: ", F.coalesce(F.base64(F.encode("url", "UTF-8")), F.lit("null")))).otherwise("")
    # base64 of a long url comes in lines
    exact = F.concat(F.substring(exact, F.lit(1), F.lit(len(CRLF))), F.regexp_replace(F.substring(exact, F.lit(len(CRLF) + 1), F.length(exact)), "[\r\n]", ""))
    block = F.octet_length("http") + F.when(kind == "revisit", 0).otherwise(F.col("payload_bytes"))
    refers = F.when(kind == "revisit", _lines(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: <", _uri(F.col("owner.page_id"), F.col("owner.seq")), ">")).otherwise("")
    return _lines(
        f"WARC/1.1{CRLF}WARC-Type: ", kind, f"{CRLF}WARC-Record-ID: <", _uri(F.col("page_id"), F.col("seq")),
        f">{CRLF}WARC-Date: {DATE}{CRLF}WARC-Target-URI: ", target, exact, f"{CRLF}WARC-Payload-Digest: sha1:", F.col("payload_digest"), refers,
        f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: ", block.cast("string"), CRLF * 2,
    )


def write_archive(pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Two tables under ``folder``: payloads (sha256, bytes) and records (seq, header, http, sha256)."""
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("bytes")).withColumn("sha256", F.sha2("bytes", 256))
    # equal payloads meet in each map task first, so a payload that a third of all pages have is shuffled once per task
    rows.groupBy("sha256").agg(F.first("bytes").alias("bytes")).write.parquet(f"{folder}/payloads")
    heads = rows.select(F.monotonically_increasing_id().alias("seq"), "page_id", "url", "sha256", F.octet_length("bytes").cast("long").alias("payload_bytes"), base32_sha1(F.col("bytes")).alias("payload_digest"))
    heads = settle(heads, "warc-heads").withColumn("http", _http())
    owners = heads.groupBy("sha256").agg(F.min(F.struct(F.col("page_id").isNull().alias("nameless"), "page_id", "seq")).alias("owner"))
    kind = F.when((F.col("payload_bytes") < min_bytes) | (F.col("seq") == F.col("owner.seq")), "response").otherwise("revisit")
    heads.join(owners, "sha256").select("seq", _header(kind).alias("header"), "http", "sha256").write.parquet(f"{folder}/records")


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)", 1), F.lit(""))


def _page(name: str) -> Column:
    """The page's id in a header that names a record; null if there is none."""
    return F.nullif(F.url_decode(F.regexp_extract("header", rf"\r\n{name}: <urn:page:([^#>]*)#", 1)), F.lit(""))


def url_of() -> Column:
    """The url as it was given, from a record's header."""
    exact = _field("X-Target-URI-Base64")
    return F.when(exact == "null", F.lit(None).cast("string")).when(exact.isNotNull(), F.decode(F.unbase64(exact), "UTF-8")).otherwise(F.regexp_extract("header", r"\r\nWARC-Target-URI: ([^\r\n]*)", 1))


def read_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """The stored payloads, each verified against the digest that it is kept under."""
    bad = F.raise_error(F.concat(F.lit("payload does not match its digest: "), F.col("sha256")))
    return spark.read.parquet(f"{folder}/payloads").withColumn("sha256", F.when(F.sha2("bytes", 256) == F.col("sha256"), F.col("sha256")).otherwise(bad))


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """The original records: seq, header, http, payload, and the record's exact bytes."""
    found = spark.read.parquet(f"{folder}/records").join(read_payloads(spark, folder), "sha256", "left")
    missing = F.raise_error(F.concat(F.lit("no payload under "), F.col("sha256")))
    found = found.select("seq", "header", "http", F.coalesce("bytes", missing.cast("binary")).alias("payload"))
    block = F.when(_field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return found.withColumn("record", F.concat(F.encode("header", "UTF-8"), F.encode("http", "UTF-8"), block, F.lit((CRLF * 2).encode())))


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """What the rebuilt records say: page_id, url and the other header fields, and measures of the payload that was joined to each."""
    found = read_records(spark, folder).withColumn("own", base32_sha1(F.col("payload")))
    # the record's own bytes must be what its headers announce
    size = F.octet_length("record") - F.octet_length("header") - 2 * len(CRLF)
    agrees = (_field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("own"))) & (_field("Content-Length") == size.cast("string"))
    bad = F.raise_error(F.concat(F.lit("record and payload disagree: "), F.col("header")))
    return found.select(
        "seq",
        _page("WARC-Record-ID").alias("page_id"),
        url_of().alias("url"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(agrees, F.col("own")).otherwise(bad).alias("payload_digest"),
        _field("WARC-Type").alias("record_type"),
        _page("WARC-Refers-To").alias("refers_to"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = work_folder(spark, "warc")
    write_archive(pages, folder)
    kind = pages.schema["page_id"].dataType
    return read_index(spark, folder).select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


ORACLE = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT *, sha1(b) AS d, min(page_id) OVER (PARTITION BY b) AS owner FROM p)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('{_BASE32}', CAST(1 + ((CAST('0x' || substr(d, CAST(1 + 10 * (i // 8) AS INT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = owner THEN NULL ELSE owner END AS refers_to
FROM q
"""
