"""A content-addressed WARC archive as two tables.

``payloads`` holds the bytes of each distinct payload once, under its SHA-256 digest; ``records``
holds, for every record, the exact header bytes and the digest. A join gives back the original
records. The reader verifies a payload against its digest before it is used.

Of the records with equal payloads of at least ``min_revisit`` bytes, that with the largest key is a
``response`` and the others are ``revisit`` records that refer to it; smaller payloads are always
responses.

Only digests and keys are grouped, after pre-aggregation, so a payload that a third of all rows share
moves as one row; the join back to it is by digest, a skewed key that adaptive execution splits.

Defined results: a null payload is empty; a null URL is an empty target, and line ends in
a URL, which a header line can't hold, are left out; null keys sort below all
others and have an empty record id; rows repeated with the same key and payload are each a response if
the key is the largest; empty tables give empty tables; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_path, written

CRLF = "\r\n"
ARCHIVED_AT = "1970-01-01T00:00:00Z"


def base32(hex_digest: Column, digits: int) -> Column:
    """Upper-case base32 of a hex string whose bytes make whole groups of 5."""
    bits = F.concat(*(F.lpad(F.conv(F.substring(hex_digest, i + 1, 10), 16, 2), 40, "0") for i in range(0, digits, 10)))
    value = lambda i: F.conv(F.substring(bits, i + 1, 5), 2, 10).cast("int")
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    return F.concat(*(F.substring(alphabet, value(i) + 1, F.lit(1)) for i in range(0, digits * 4, 5)))


def _record_id(key: Column) -> Column:
    """A stable URN for a key."""
    h = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _digested(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    body = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    plain = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), body.alias("payload"))
    return plain.select("key", "url", "payload", F.unhex(F.sha2("payload", 256)).alias("digest"), F.length("payload").cast("long").alias("size"))


def write_archive(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", min_revisit: int = 0) -> None:
    """Writes the tables ``path/payloads`` and ``path/records``."""
    rows = _digested(pages, key, url, html)
    # A response for each digest; its payload comes from the row (or equal rows) with the largest key. The owners are
    # a table, so that both joins are of two plain exchanges, of which adaptive execution splits a very common digest.
    owners = written(rows.select("key", "digest").groupBy("digest").agg(F.max("key").alias("owner")), "owners")
    no_key = F.lit(-(1 << 63)).cast("long")
    winners = owners.select(F.col("digest").alias("w_digest"), F.coalesce("owner", no_key).alias("w_key"))
    stored = (
        rows.select(F.coalesce("key", no_key).alias("k"), "payload", "digest")
        .join(winners, (F.col("digest") == F.col("w_digest")) & (F.col("k") == F.col("w_key")), "left_semi")
        .dropDuplicates(["digest", "k"])
        .select("digest", "payload")
    )
    stored.write.option("compression", "zstd").parquet(f"{path}/payloads")
    joined = rows.select("key", "url", "digest", "size", F.sha1("payload").alias("sha1")).join(owners, "digest")
    refers = F.when((F.col("size") >= min_revisit) & ~F.col("key").eqNullSafe(F.col("owner")), F.col("owner"))
    kind = F.when(refers.isNotNull(), F.lit("revisit")).otherwise(F.lit("response"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(CRLF * 2))
    length = F.octet_length("http") + F.when(F.col("kind") == "response", F.col("size")).otherwise(0)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.col("kind")),
        line("WARC-Record-ID", _record_id(F.col("key"))),
        F.lit(f"WARC-Date: {ARCHIVED_AT}{CRLF}"),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1"), 40))),
        F.when(F.col("kind") == "revisit", F.concat(F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}"), line("WARC-Refers-To", _record_id(F.col("refers_to"))))).otherwise(F.lit("")),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"),
        line("Content-Length", length.cast("string")),
        F.lit(CRLF),
    )
    records = joined.select("key", "digest", "size", kind.alias("kind"), refers.alias("refers_to"), "url", "sha1", http.alias("http"))
    records.select("key", "digest", "refers_to", F.encode(F.concat(header, "http"), "UTF-8").alias("header")).write.option("compression", "zstd").parquet(f"{path}/records")


def read_archive(spark, path: str) -> DataFrame:
    """The original records: ``key``, ``refers_to``, ``header``, ``payload``, and ``record``, the bytes of the WARC record.

    A revisit's record ends after its header; its payload is that of the record it refers to. A
    payload that doesn't match its digest fails the read.
    """
    payloads = spark.read.parquet(f"{path}/payloads")
    checked = F.when(F.unhex(F.sha2("payload", 256)) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.lit("an archived payload doesn't match its digest")))
    payloads = payloads.select("digest", checked.alias("payload"), F.sha1("payload").alias("sha1"))
    joined = spark.read.parquet(f"{path}/records").join(payloads, "digest")
    end = F.lit((CRLF * 2).encode())
    body = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b""))
    return joined.select("key", "refers_to", "header", "payload", "sha1", F.concat("header", body, end).alias("record"))


def archived(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """Writes an archive of ``pages`` to the shared folder and reports on it from what is read back."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archive(pages, path, min_revisit=min_revisit)
    read = read_archive(spark, path)
    text = F.decode("header", "UTF-8")
    field = lambda name: F.regexp_extract(text, rf"\r\n{name}: ([^\r]*)\r\n", 1)
    return read.select(
        F.col("key").alias("page_id"),
        F.length("payload").cast("long").alias("payload_bytes"),
        F.when(field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), base32(F.col("sha1"), 40)), base32(F.col("sha1"), 40)).otherwise(F.raise_error(F.lit("a record's digest isn't its payload's"))).alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        F.col("refers_to"),
    )
