"""A content-addressed WARC archive.

Two tables stand for the archive: `payloads` holds each payload's bytes once, under their SHA-256, and `headers` holds
the exact header block of every record with the digest of its payload. Records are put together again by a join on the
digest, and every payload that is read is hashed again before use. `export_warc` writes plain WARC files.

Of the records with equal payloads the one with the smallest id is the response; the others are revisits that refer to
it. A null payload is an empty one. A repeated (id, payload) row is a revisit of itself with the same id; rows with a
null id are dropped, since a record must have an id. A null URL gives a record without WARC-Target-URI; line breaks in a
URL become spaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, shared_dir

#: RFC 4648 base 32, in the order of its values.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HEADERS = "page_id long, header string, digest string, record_type string"
PAYLOADS = "digest string, payload binary"


def base32(hex_digest: Column) -> Column:
    """Upper-case base 32 of a hex string whose length is a multiple of 5 (SHA-1 has 40 digits: no padding)."""
    five = [F.lpad(F.conv(F.substring(hex_digest, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*five), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def digests(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    body = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"").cast("binary"))
    return pages.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.sha2(body, 256).alias("digest"), base32(F.sha1(body)).alias("sha1"), F.octet_length(body).cast("long").alias("bytes")
    )


def write_archive(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write `headers` and `payloads` below path.

    Shuffles: narrow digest rows by digest, and the payload bytes once, by digest, to keep one copy of each.
    """
    rows = digests(pages, id_col, url_col, payload_col)
    first = cut(rows.groupBy("digest").agg(F.min("page_id").alias("holder")), "holders")
    typed = cut(rows.join(first, "digest"), "digests")
    # a row of its own for the response, also where its page is repeated
    twin = typed.where("page_id = holder").groupBy("page_id", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    kind = F.when(F.col("page_id") == F.col("holder"), "response").otherwise("revisit")
    one = typed.join(twin.select("page_id", "digest"), ["page_id", "digest"], "left_anti").withColumn("record_type", kind)
    again = Window.partitionBy("page_id", "digest").orderBy(F.col("url").asc_nulls_first())
    more = typed.join(twin.select("page_id", "digest"), ["page_id", "digest"], "left_semi").withColumn("k", F.row_number().over(again))
    more = more.withColumn("record_type", F.when(F.col("k") == 1, "response").otherwise("revisit")).drop("k")
    records = one.unionByName(more)
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    response = F.col("record_type") == "response"
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", urn(F.col("page_id"))), line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", " ")), line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")), line("WARC-Payload-Length", F.col("bytes").cast("string")), line("WARC-Refers-To", F.when(~response, urn(F.col("holder")))),
        line("WARC-Profile", F.when(~response, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))), line("Content-Type", F.when(response, F.lit("text/html; charset=utf-8"))), line("Content-Length", F.when(response, F.col("bytes")).otherwise(0).cast("string")), F.lit("\r\n"),
    )
    records.select("page_id", header.alias("header"), "digest", "record_type").write.option("compression", "zstd").parquet(f"{path}/headers")

    body = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"").cast("binary"))
    kept = typed.where("page_id = holder").select("page_id", "digest").distinct()
    bodies = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("page_id"), body.alias("payload"))
    # equal bytes under one id are stored once; unequal ones under one id are told apart by their digest
    stored = bodies.join(kept, "page_id").where(F.sha2("payload", 256) == F.col("digest")).select("digest", "payload")
    if twin.limit(1).count():
        stored = stored.dropDuplicates(["digest"])
    stored.write.option("compression", "zstd").parquet(f"{path}/payloads")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """The header fields of every record, parsed from the stored header blocks."""
    h = spark.read.schema(HEADERS).parquet(f"{path}/headers")
    field = lambda name: F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    given = lambda name: F.when(field(name) != "", field(name))
    return h.select(
        F.regexp_extract("header", r"\r\nWARC-Record-ID: <urn:page:(-?\d+)>", 1).cast("long").alias("page_id"), field("WARC-Type").alias("record_type"), F.regexp_extract(given("WARC-Refers-To"), r"<urn:page:(-?\d+)>", 1).cast("long").alias("refers_to"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"), field("WARC-Payload-Length").cast("long").alias("payload_bytes"), given("WARC-Target-URI").alias("url"), field("Content-Length").cast("long").alias("content_length"), "digest", "header",
    )


def read_payloads(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    """The stored payloads with their size and SHA-1; a payload whose SHA-256 is not its key fails the job."""
    p = spark.read.schema(PAYLOADS).parquet(f"{path}/payloads")
    if verify:
        right = F.sha2("payload", 256) == F.col("digest")
        p = p.withColumn("digest", F.when(right, F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("payload does not match its digest "), "digest"))))
    return p.withColumn("stored_bytes", F.octet_length("payload").cast("long")).withColumn("stored_sha1", base32(F.sha1("payload")))


def reconstruct(spark: SparkSession, path: str, full: bool = False) -> DataFrame:
    """(page_id, record): the bytes of each WARC record. full: revisits carry the payload that they refer to as `payload`."""
    h, p = read_headers(spark, path), read_payloads(spark, path).select("digest", "payload")
    out = h.join(p, "digest")
    block = F.when(F.col("content_length") > 0, F.col("payload")).otherwise(F.lit(b"").cast("binary"))
    record = F.concat(F.col("header").cast("binary"), block, F.lit(b"\r\n\r\n").cast("binary"))
    return out.select("page_id", "record_type", record.alias("record"), *(["payload"] if full else []))


def export_warc(spark: SparkSession, path: str, to: str, records_per_file: int = 4096) -> None:
    """Write plain WARC files. The text writer's line end is the two line breaks that end a record."""
    r = reconstruct(spark, path)
    text = F.decode(F.substring(F.col("record"), F.lit(1), F.octet_length("record") - 4), "UTF-8")
    r.select(text.alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file).text(to)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write the archive of `pages` to the shared folder, read it back, and return what it says of each page."""
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    write_archive(pages, path)
    h = read_headers(spark, path)
    p = cut(read_payloads(spark, path).select("digest", "stored_bytes", "stored_sha1"), "verified")
    out = h.join(p, "digest")
    whole = (F.col("stored_bytes") == F.col("payload_bytes")) & (F.col("stored_sha1") == F.col("payload_digest"))
    return out.select(
        "page_id", F.col("stored_bytes").alias("payload_bytes"), F.when(whole, F.col("stored_sha1")).otherwise(F.raise_error(F.lit("a header and its payload differ"))).alias("payload_digest"), "record_type", "refers_to"
    )
