"""The document pipeline over a folder that files keep coming into.

``watch`` is the same stateless projection as in batch, by the rules it was
started with.  ``watch_into`` writes a table: each batch reads the rules as they
are then, and a file whose content was there before, under whatever name, gives
no second row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.streaming import StreamingQuery

from ledgerleaf.operators import documents
from ledgerleaf.plans import rule_table
from ledgerleaf.plans import rules as R
from ledgerleaf.sources import pdf

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def _arriving(spark: SparkSession, folder: str, files_per_batch: int) -> DataFrame:
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", "*.[pP][dD][fF]").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return files.select(F.regexp_extract("path", r"([^/]*)\z", 1).alias("file"), "path", "length", F.when(F.col("length") <= R.MAX_BYTES, F.col("content")).alias("content"))


def _rows(files: DataFrame, reader: documents.Reader, vendors: tuple[R.Vendor, ...] = R.VENDORS) -> DataFrame:
    texts = documents.with_text(files.select("file", "length", "content"), reader)
    return documents.document_rows(texts.select("file", "error", F.col("extracted.text").alias("text"), F.col("extracted.joined").alias("joined")), vendors=vendors, joined="joined")


def watch(spark: SparkSession, folder: str, files_per_batch: int = 1000, reader: documents.Reader | None = None) -> DataFrame:
    """A stream of document rows of the PDF files that arrive in ``folder``."""
    return _rows(_arriving(spark, folder, files_per_batch), reader or pdf.reader())


def watch_into(spark: SparkSession, folder: str, out: str, checkpoint: str, rules: str | None = None, files_per_batch: int = 1000, reader: documents.Reader | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Write document rows of arriving files into the Parquet table ``out``, by batch.

    ``rules`` is the path of a stored rule table, of which each batch takes the
    latest versions.  Contents are told apart by their SHA-256, which is the
    only thing kept between batches; files over the limit, which are not read,
    by path and length.  A batch has a folder of its own, which is written anew
    if the batch is repeated, so a restart from ``checkpoint`` adds no row twice.
    """
    read = reader or pdf.reader()
    files = _arriving(spark, folder, files_per_batch)
    files = files.withColumn("digest", F.coalesce(F.sha2("content", 256), F.concat_ws("\n", "path", F.col("length").cast("string")))).dropDuplicates(["digest"])

    def write(batch: DataFrame, batch_id: int) -> None:
        vendors = rule_table.read_rules(batch.sparkSession, rules) if rules else R.VENDORS
        _rows(batch, read, vendors).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
