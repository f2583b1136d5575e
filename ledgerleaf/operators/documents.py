"""Documents as rows: validation, the extraction pipeline, articles, envelopes, summaries.

Input is a frame of texts or of files; all steps but reading and recognising
are built-in expressions in one projection, so a document never leaves its
task.  A document that can't be read is a row with an error, never a failure.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ledgerleaf.functions import text as T
from ledgerleaf.operators import budget, fields, items, naming
from ledgerleaf.plans import rules as R

PAGES = "struct<pages:array<string>,declared:int,error:string>"


#: From a file's bytes and the number of pages to read to PAGES.
Reader = Callable[[Column, int], Column]


def validation_error(content: Column, length: Column | None = None) -> Column:
    """The code of the first fault of a file's bytes; null for none.

    With a known ``length`` that is over the limit the content is not looked at.
    """
    n = F.coalesce(length, F.octet_length(content)) if length is not None else F.octet_length(content)
    return (
        F.when(n > R.MAX_BYTES, "pdf_too_large")
        .when(content.isNull(), "pdf_invalid_type")
        .when(n < R.MIN_BYTES, "pdf_too_small")
        .when(F.substring(content, 1, len(R.MAGIC)) != F.lit(R.MAGIC), "pdf_invalid_magic")
    )


def with_text(files: DataFrame, reader: Reader, max_pages: int = R.PIPELINE_PAGES, max_chars: int = R.PIPELINE_CHARS, ocr: Callable[[Column], Column] | None = None) -> DataFrame:
    """``file, sha256, error, extracted`` of files with ``file, content`` and, if known, ``length``.

    ``reader`` maps content to PAGES and reads ``max_pages`` pages at most; bytes
    that fail validation never reach it.  ``ocr`` maps content to text and gets
    only the bytes of readable files without text, in the same pass.
    """
    checked = files.withColumn("error", validation_error(F.col("content"), F.col("length") if "length" in files.columns else None))
    good = F.when(F.col("error").isNull(), F.col("content"))
    read = checked.withColumn("read", reader(good, max_pages))
    read = read.withColumn("error", F.coalesce("error", F.col("read.error")))
    read = read.withColumn("extracted", F.when(F.col("error").isNull(), budget.page_budget(F.col("read.pages"), F.col("read.declared"), max_pages, max_chars)))
    if ocr is not None:
        blank = F.col("extracted").isNotNull() & (T.trim_blanks(F.col("extracted.text")) == "")
        # Generated, as a function of Python must not be merged into a lambda that uses its text once.
        read = read.select("*", F.explode(F.array(ocr(F.when(blank, F.col("content"))))).alias("__said")).withColumn("__ocr", T.null_if_empty(F.col("__said")))
        by_ocr = F.col("extracted").withField("text", F.col("__ocr")).withField("joined", F.col("__ocr"))
        read = read.withColumn("extracted", F.when(blank & F.col("__ocr").isNotNull(), by_ocr).otherwise(F.col("extracted")))
    return read.select("file", F.sha2("content", 256).alias("sha256"), "error", "extracted")


def model_wanted(text: Column, wanted: Column | None = None) -> Column:
    """Whether a model is asked: it is wanted, and there is text to send."""
    has_text = F.coalesce(T.trim_blanks(text) != "", F.lit(False))
    return has_text if wanted is None else has_text & F.coalesce(wanted, F.lit(False))


def lacks_fields(docs: Column) -> Column:
    """The narrower branch: only documents without number or total are worth a model."""
    return docs["invoice_number"].isNull() | docs["total"].isNull()


def unread(docs: DataFrame) -> DataFrame:
    """Documents that nothing was found in: no error, no total, no articles."""
    # Generated rows: the filter would else be pushed below and repeat the expressions that find fields.
    found = docs.select(F.explode(F.array(F.struct(*docs.columns))).alias("d")).select("d.*")
    return found.filter(F.col("error").isNull() & F.col("total").isNull() & (F.coalesce(F.size("articles"), F.lit(0)) <= 0))


def needs_parser(files: DataFrame, docs: DataFrame, file: str = "file") -> DataFrame:
    """The files of unread documents, for a new rule to be made from: a semi join back, each file once, columns as they were."""
    return files.join(unread(docs).select(F.col("file").alias("__unread")).distinct(), F.col(file) == F.col("__unread"), "left_semi")


def first_file(rows: DataFrame, files: DataFrame, file: str = "file", order: str = "path") -> DataFrame:
    """``rows`` with the columns of the first file of that name, by ``order``; rows without a file go.

    Names are not unique over folders, so the files are reduced to one a name
    (by a combining aggregation, not a window) before they are joined.
    """
    others = [c for c in files.columns if c != file]
    first = files.groupBy(F.col(file).alias("__f")).agg(F.min_by(F.struct(*others), F.col(order)).alias("__first"))
    return rows.join(first, F.col(file) == F.col("__f")).select(*rows.columns, *[F.col(f"__first.{c}").alias(c) for c in others if c not in rows.columns])


def document_rows(texts: DataFrame, model: DataFrame | None = None, name_pattern: str = R.NAME_PATTERNS[0], vendors: tuple[R.Vendor, ...] = R.VENDORS, text: str = "text", joined: str | None = None) -> DataFrame:
    """One row per document of ``texts`` (file, text and, if known, error).

    Fields are taken from ``joined`` (the text before its last cut) where given.
    ``model`` has replies by file: number, date, total, summary, articles; they
    only fill gaps, and their list of items counts only if it is longer.
    """
    docs = texts if "error" in texts.columns else texts.withColumn("error", F.lit(None).cast("string"))
    body = F.coalesce(F.col(text), F.lit(""))
    vendor = fields.detect_vendor(body, vendors)
    docs = docs.withColumn("__vendor", vendor)
    # The fields' text has a vendor of its own where it is not the same text.
    field_vendor = F.col("__vendor") if joined is None else fields.detect_vendor(F.coalesce(F.col(joined), F.lit("")), vendors)
    docs = docs.withColumn("__fields", fields.extract_fields(F.col(joined or text), field_vendor))
    docs = docs.withColumn("__items", items.articles(items.vendor_items(body, F.col("__vendor"), vendors)))
    summary = F.lit("")
    if model is not None:
        m = model.select(F.col("file").alias("__mf"), F.struct("number", "date", "total", "summary", "articles").alias("__m"))
        docs = docs.join(m, F.col("file") == F.col("__mf"), "left")
        has_text = T.trim_blanks(body) != ""
        filled = fields.fill_from_model(F.col("__fields"), F.col("__m.number"), F.col("__m.date"), F.col("__m.total"))
        docs = docs.withColumn("__fields", F.when(has_text, filled).otherwise(F.col("__fields")))
        docs = docs.withColumn("__items", F.when(has_text, items.longer_list(F.col("__items"), F.col("__m.articles"))).otherwise(F.col("__items")))
        summary = F.coalesce(F.col("__m.summary"), F.lit(""))
    f = F.col("__fields")
    fine = F.col("error").isNull()
    only = lambda c: F.when(fine, c)
    description = F.get(F.col("__items"), F.lit(0))["description"]
    return docs.select(
        "file",
        only(summary).alias("keyword"),
        only(F.col("__vendor")).alias("vendor"),
        only(f["invoice_number"]).alias("invoice_number"),
        only(f["invoice_date"]).alias("invoice_date"),
        only(f["totals"]["subtotal"]).alias("subtotal"),
        only(f["totals"]["tax"]).alias("tax"),
        only(items.reconciled_total(f["totals"]["total"], F.col("__items"))).alias("total"),
        only(f["tax_label"]).alias("tax_label"),
        only(F.array_join(f["matched"], "|")).alias("matched"),
        only(items.items_text(F.col("__items"))).alias("line_items"),
        only(F.col("__items")).alias("articles"),
        only(F.length(body)).alias("text_chars"),
        naming.new_name(F.col("__vendor"), f["invoice_number"], f["invoice_date"], summary, description, name_pattern, F.col("error")).alias("new_name"),
        "error",
    )


def article_rows(docs: DataFrame) -> DataFrame:
    """The flat table: a row an article with its document's context; documents without articles keep one row."""
    a = F.col("article")
    exploded = docs.select("file", "vendor", "invoice_number", "invoice_date", "subtotal", "tax", "total", "tax_label", F.posexplode_outer("articles").alias("pos", "article"))
    return exploded.select("file", "vendor", "invoice_number", "invoice_date", "subtotal", "tax", "total", "tax_label", *[a[k].alias(k if k not in ("amount",) else "amount") for k in items.ARTICLE], "pos")


def run_summary(docs: DataFrame, order: str = "file") -> DataFrame:
    """One row about a run: documents, those with data, without text, with errors, and the vendors in the order first met.

    Rows are first counted by vendor, so that one row a vendor is all that is
    brought together.
    """
    filled = lambda c: F.col(c).isNotNull()
    with_data = filled("invoice_number") | filled("total")
    counts = {
        "with_data": with_data,
        "with_data_or_vendor": with_data | filled("vendor"),
        "scanned": F.col("text_chars") == 0,
        "errors": filled("error"),
        "uncovered": filled("error") | (F.col("total").isNull() & (F.coalesce(F.size("articles"), F.lit(0)) <= 0)),
    }
    by_vendor = docs.groupBy("vendor").agg(F.count("*").alias("total"), *[F.count_if(c).alias(k) for k, c in counts.items()], F.min(order).alias("first"))
    met = F.array_sort(F.collect_list(F.when(filled("vendor"), F.struct("first", "vendor"))))
    sums = [F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("total", *counts)]
    return by_vendor.agg(*sums, F.array_join(F.transform(met, lambda v: v["vendor"]), ", ").alias("vendors"))


def failures(docs: DataFrame, tool: str = "extract") -> DataFrame:
    """``file, event, content`` of documents with an error: a log line, and what a caller is told, without traces."""
    event = F.to_json(F.struct(F.lit("document_failure").alias("event"), F.lit(tool).alias("tool"), F.col("error"), F.col("file")))
    content = F.struct(F.array(F.struct(F.lit("text").alias("type"), F.to_json(F.struct("error")).alias("text"))).alias("content"), F.lit(True).alias("isError"))
    return docs.filter(F.col("error").isNotNull()).select("file", event.alias("event"), content.alias("content"))


def observed(docs: DataFrame, name: str = "progress") -> tuple[DataFrame, Observation]:
    """``docs`` with counts of rows and errors, to be read from the observation when an action has run on them."""
    seen = Observation(name)
    return docs.observe(seen, F.count("*").alias("processed"), F.count_if(F.col("error").isNotNull()).alias("errors")), seen


def attribution(vendor: Column, tabular_items: Column, matched: Column) -> Column:
    """``struct<parser, source>``: who found what is in an envelope."""
    tabular = F.size(tabular_items) >= R.MIN_TABULAR_ITEMS
    by_vendor = F.concat(vendor, F.lit("-tabular"))
    ticket = F.lit(f"{next(v.name for v in R.VENDORS if v.tabular)}-tabular")
    parser = F.when(vendor.isNotNull(), by_vendor).when(tabular, ticket)
    return F.struct(F.coalesce(parser, F.lit("plain-text")).alias("parser"), F.coalesce(parser, F.when(F.size(matched) > 0, "invoice-fields"), F.lit("plain-text")).alias("source"))


def envelopes(texts: DataFrame) -> DataFrame:
    """``file, envelope`` of ``with_text`` rows: all that is known of a document, as a struct."""
    body = F.coalesce(F.col("extracted.text"), F.lit(""))
    docs = texts.withColumn("__vendor", fields.detect_vendor(body)).withColumn("__ticket", items.ticket_items(body))
    docs = docs.withColumn("__fields", fields.extract_fields(F.col("extracted.joined"), fields.detect_vendor(F.coalesce(F.col("extracted.joined"), F.lit("")))))
    tabular = F.size(F.col("__ticket.items")) >= R.MIN_TABULAR_ITEMS
    # A ticket vendor's items are those already found.
    by_ticket = F.coalesce(F.col("__vendor").isin([v.name for v in R.VENDORS if v.tabular]), F.lit(False))
    by = attribution(F.col("__vendor"), F.col("__ticket.items"), F.col("__fields.matched"))
    return docs.select(
        "file",
        F.struct(
            body.alias("text"),
            F.coalesce("extracted.pages", F.lit(0)).alias("pages"),
            F.coalesce("extracted.truncated", F.lit(False)).alias("truncated"),
            budget.truncation(F.col("extracted")).alias("truncation"),
            F.col("__fields").alias("invoice_fields"),
            F.when(tabular | by_ticket, F.col("__ticket.items")).otherwise(items.vendor_items(body, F.col("__vendor"))).alias("line_items"),
            by["parser"].alias("parser"),
            items.ticket_stats(F.col("__ticket")).alias("parser_stats"),
            by["source"].alias("source"),
            F.lit("deterministic").alias("confidence"),
            "sha256",
        ).alias("envelope"),
    )


def capped_json(value: Column, most: int = R.RESPONSE_BYTES) -> Column:
    """A value as JSON; an error object if that is longer than ``most`` bytes."""
    return T.bind(F.to_json(value), lambda j: F.when(F.octet_length(j) > most, F.lit('{"error":"response_too_large"}')).otherwise(j))
