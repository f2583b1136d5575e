"""A content-addressed WARC archive, and plain WARC files.

The archive has two tables in the shared folder: ``payloads`` stores the bytes
of each distinct payload once, under a SHA-256 that is verified on reading, and
``headers`` stores the exact header of every record (WARC named fields and the
HTTP status part), with the digest as its key.  A record is their join.
Everything runs on built-in functions; payload bytes are shuffled once to store
them and once to join them to their responses, whatever the number of copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.llm.common import bound_batches, shared_path, small_or_not, staged

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of fewer bytes are always stored as responses of their own.
MIN_REVISIT_BYTES = 100
REVISIT = f"{CRLF}WARC-Type: revisit{CRLF}"
#: Records of one payload that meet its bytes in one task.
COPIES_TOGETHER = 4096


def _record_id(row: Column) -> Column:
    """A name of its own for each record: the page's id, escaped (a null one as a lone sign of escape), and the record's number."""
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(F.url_encode(row["page_id"].cast("string")), F.lit("%")), F.lit("/"), row["at"].cast("string"), F.lit(">"))


def _header(date: str) -> Column:
    """The exact bytes before a record's payload, from the columns of the record table."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    revisit = F.col("record_type") == "revisit"
    uri = F.coalesce(F.nullif(F.regexp_replace("url", r"[\x00-\x20\x7f]", ""), F.lit("")), F.concat(F.lit("urn:x-page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none"))))
    block = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.col("record_type"),
        F.lit(f"{CRLF}WARC-Record-ID: "), _record_id(F.struct("page_id", "at")),
        F.lit(f"{CRLF}WARC-Target-URI: "), uri,
        F.lit(f"{CRLF}WARC-Date: {date}{CRLF}WARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"{CRLF}WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: "), _record_id(F.col("first")))).otherwise(F.lit("")),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), block.cast("string"),
        F.lit(CRLF * 2), http,
    )


def write_archive(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> str:
    """Write every row of ``df`` as a record into a new archive at ``path``.

    Of rows with equal payloads of at least 100 bytes the one with the smallest
    id (nulls last, then the first read) is the response and the rest revisit
    it; smaller payloads are responses each.  A null payload is empty, a null
    URL becomes a URN of the id; repeated rows give a record each.
    """
    page = df.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{payload_col}`"), F.lit("")).cast("binary").alias("payload"))
    digest = F.sha2("payload", 256).alias("digest")
    page.select(digest, "payload").groupBy("digest").agg(F.any_value("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")
    rows = staged(page.select("page_id", "url", digest, F.octet_length("payload").cast("long").alias("payload_bytes"), F.monotonically_increasing_id().alias("at")), "warc-rows")
    first = rows.filter(F.col("payload_bytes") >= MIN_REVISIT_BYTES).groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "at")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    # Staged: a payload that very many pages have is joined between plain shuffles, which can be dealt anew, or broadcast.
    records = rows.join(small_or_not(staged(first, "warc-first")), "digest", "left").withColumn("record_type", F.when(F.col("first").isNotNull() & (F.col("first.at") != F.col("at")), "revisit").otherwise("response"))
    records.select("page_id", "digest", _header(date).alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")
    return path


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """``digest, payload, payload_bytes`` of the stored payloads; one whose SHA-256 is not its key ends the query."""
    damaged = F.raise_error(F.concat(F.lit("payload damaged: "), F.col("digest"))).cast("binary")
    good = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(damaged)
    return spark.read.parquet(f"{path}/payloads").select("digest", good.alias("payload")).select("digest", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"))


def _found(records: DataFrame) -> DataFrame:
    """A header without payload ends the query with an error: nothing is lost in silence."""
    missing = F.raise_error(F.concat(F.lit("payload missing: "), F.col("digest"))).cast("long")
    return records.withColumn("payload_bytes", F.coalesce("payload_bytes", missing))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive: ``page_id, digest, header, payload_bytes, payload``, joined and verified.

    Payloads are verified once each, before the join.  Records that revisit a
    payload have none of their own in the archive, so of copies in whatever
    number only the response meets the payload's bytes here, and the others
    only its size: ``payload`` is null for them (see full_payloads).
    """
    headers = spark.read.parquet(f"{path}/headers")
    payloads = read_payloads(spark, path)
    revisits = F.col("header").contains(REVISIT)
    whole = headers.filter(~revisits).join(payloads, "digest", "left").select("page_id", "digest", "header", "payload_bytes", "payload")
    again = headers.filter(revisits).join(payloads.select("digest", "payload_bytes"), "digest", "left")
    return _found(whole.unionByName(again.select("page_id", "digest", "header", "payload_bytes", F.lit(None).cast("binary").alias("payload"))))


def full_payloads(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, digest, header, payload`` with the bytes for revisits as well.

    A payload with very many copies is dealt over salts, so that it and its
    headers never meet in one task.
    """
    headers = spark.read.parquet(f"{path}/headers")
    hot = headers.groupBy("digest").agg(F.ceil(F.count("*") / COPIES_TOGETHER).alias("salts")).filter("salts > 1")
    hot = small_or_not(staged(hot, "warc-hot"))
    one = F.coalesce("salts", F.lit(1))
    salted = headers.join(hot, "digest", "left").withColumn("salt", F.pmod(F.xxhash64("header"), one)).drop("salts")
    spread = read_payloads(spark, path).join(hot, "digest", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), one - 1))).drop("salts")
    return _found(salted.join(spread, ["digest", "salt"], "left")).select("page_id", "digest", "header", "payload")


def record_bytes() -> Column:
    """The original record, byte for byte: a revisit's block has no payload of its own."""
    body = F.when(F.col("header").contains(REVISIT), F.lit(b"")).otherwise(F.col("payload"))
    return F.concat(F.encode("header", "utf-8"), body, F.lit(b"\r\n\r\n"))


def parsed(records: DataFrame) -> DataFrame:
    """What read records say, one row a record; sizes of responses are those of the record put together again."""
    field = lambda name: F.nullif(F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))
    id_type = records.schema["page_id"].dataType
    kind = field("WARC-Type")
    referred = F.regexp_extract("header", r"\r\nWARC-Refers-To: <urn:x-page:([^/>]*)/", 1)
    rebuilt = F.octet_length(record_bytes()) - F.octet_length(F.encode("header", "utf-8")) - 4
    return records.select(
        "page_id",
        F.when(kind == "revisit", F.col("payload_bytes")).otherwise(rebuilt.cast("long")).alias("payload_bytes"),
        F.regexp_replace(field("WARC-Payload-Digest"), r"\Asha256:", "").alias("payload_digest"),
        kind.alias("record_type"),
        F.when((kind == "revisit") & (referred != "%"), F.url_decode(F.nullif(referred, F.lit("%")))).try_cast(id_type).alias("refers_to"),
    )


def archive_pages(df: DataFrame) -> DataFrame:
    """Write the pages into an archive in the shared folder and read it back; a row a page.

    Rows are as write_archive treats them: null payloads are empty, ids may be
    null, repeated or of any type that casts to text and back, repeated rows
    give a record each, other columns are not read; an empty table gives none.
    A revisit's ``refers_to`` is the smallest id of its payload.
    """
    spark = df.sparkSession
    return parsed(read_archive(spark, write_archive(df, shared_path(spark, "warc"))))


def export_warc(records: DataFrame, path: str) -> None:
    """Write records as ordinary ``.warc`` files, from text payloads, by Spark's text writer.

    Each record ends with CRLF CRLF, which is the writer's line separator here.
    """
    body = F.when(F.col("header").contains(REVISIT), F.lit("")).otherwise(F.decode("payload", "utf-8"))
    records.select(F.concat("header", body).alias("value")).write.option("lineSep", CRLF * 2).text(path)


def import_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of ``.warc`` files: ``header string, block binary``; blocks follow Content-Length.

    Files are read whole, so they should be of moderate size, as export_warc's are.
    """
    bound_batches(spark)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data, at, heads, blocks = content.as_py(), 0, [], []
                while at < len(data):
                    end = data.index(b"\r\n\r\n", at) + 4
                    head = data[at:end].decode("utf-8")
                    length = next(int(x.split(":", 1)[1]) for x in head.split(CRLF) if x.lower().startswith("content-length:"))
                    heads.append(head)
                    blocks.append(data[end : end + length])
                    at = end + length + 4
                yield pa.RecordBatch.from_arrays([pa.array(heads, pa.string()), pa.array(blocks, pa.binary())], names=["header", "block"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(split, "header string, block binary")


ORACLE = """
WITH t AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM t
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
