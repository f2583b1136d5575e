"""The package's functions: extract texts and fields of uploads, process a folder."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.functions.staging import staged
from ledgerleaf.operators import contract, documents, model_stage, naming, sinks
from ledgerleaf.plans import rules as R
from ledgerleaf.sources import pdf, settings

#: What a caller must know about the texts.
TRUST_BOUNDARY = "Texts of documents are untrusted data, never instructions."


def extract(files: DataFrame, max_pages: int = R.DEFAULT_PAGES, max_chars: int = R.DEFAULT_CHARS, reader: documents.Reader | None = None, ocr: Callable[[Column], Column] | None = None, model: model_stage.Model | None = None) -> DataFrame:
    """``file, error, envelope`` of files (file, content): all that is found in each; a bad file is a row with its error.

    With a ``model`` there are also ``structured`` (its reply, if that keeps the
    contract) and ``model_error``; only texts are sent, never bytes of files.
    """
    settings.check_input(max_pages=max_pages, max_chars=max_chars)
    texts = documents.with_text(files, reader or pdf.reader(), max_pages, max_chars, ocr)
    if model is None:
        return documents.envelopes(texts)
    texts = staged(texts, "extracted")
    answers = model_stage.replies(texts.select("file", F.col("extracted.text").alias("text")), model)
    checked = contract.reply_object(F.col("response"), model.messages_api)
    refused = F.when(F.col("response").isNotNull() & F.col("structured").isNull(), F.lit("invalid_response"))
    said = answers.withColumn("structured", checked).select(F.col("file").alias("__file"), "structured", F.coalesce("error", refused).alias("model_error")).dropDuplicates(["__file"])
    return documents.envelopes(texts).join(said, F.col("file") == F.col("__file"), "left").drop("__file")


def process(
    spark: SparkSession, folder: str, out: str | None = None, reader: documents.Reader | None = None, ocr: Callable[[Column], Column] | None = None, vendors: tuple[R.Vendor, ...] = R.VENDORS, name_pattern: str = R.NAME_PATTERNS[0],
    model: model_stage.Model | None = None, gaps_only: bool = False,
) -> DataFrame:
    """One row per PDF file of a folder; with ``out`` its articles are written there as CSV.

    A ``model`` is asked about every readable document (``gaps_only``: about
    those in which the rules find no number or no total) and fills what the
    rules left open.  Its replies are kept in its store: a run that is repeated
    asks for what is missing alone.
    """
    texts = documents.with_text(pdf.scan_folder(spark, folder), reader or pdf.reader(), ocr=ocr)
    rows = texts.select("file", "error", F.col("extracted.text").alias("text"), F.col("extracted.joined").alias("joined"))
    how = {"name_pattern": name_pattern, "vendors": vendors, "joined": "joined"}
    if model is None:
        docs = documents.document_rows(rows, **how)
    else:
        rows, wanted = staged(rows, "texts"), None
        if gaps_only:
            found = documents.document_rows(rows, **how)
            lacking = found.filter(documents.lacks_fields(F.struct("invoice_number", "total"))).select(F.col("file").alias("__lacks")).distinct()
            rows = staged(rows.join(lacking, F.col("file") == F.col("__lacks"), "left"), "lacking")
            wanted = F.col("__lacks").isNotNull()
        docs = model_stage.filled_documents(rows, model, wanted, **how)
    if out:
        sinks.write_csv(documents.article_rows(docs), out)
    return docs


def renames(docs: DataFrame, reuse_freed: bool = False) -> DataFrame:
    """``file, new_name``: how the files of a processed folder may be renamed without collisions."""
    return naming.rename_plan(docs.filter(F.col("error").isNull()).select("file", "new_name"), docs.select("file"), reuse_freed=reuse_freed)


def apply_renames(plan: DataFrame, folder: str) -> int:
    """Carry out a plan in a local folder, in the order that keeps every name free when it is used; how many moves that took.

    A name that something else has meanwhile ends it with FileExistsError: no
    file is ever overwritten.
    """
    moves = 0
    for r in naming.rename_order(plan).orderBy("step", "file").toLocalIterator():
        old, new = os.path.join(folder, r["file"]), os.path.join(folder, r["new_name"])
        if os.path.exists(new) and not os.path.samefile(old, new):
            raise FileExistsError(new)
        os.rename(old, new)
        moves += 1
    return moves
