"""Sinks for article tables: CSV in three shapes, and JSON."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.functions import text as T
from ledgerleaf.plans import rules as R
from ledgerleaf.sources import files

COLUMNS = ("file", "vendor", "invoice_number", "invoice_date", "subtotal", "tax", "total", "tax_label", "description", "units", "unit_price", "amount", "tax_rate")


#: Of the document's columns, those of which a zero says nothing.
MONEY = ("subtotal", "tax", "total")


def csv_lines(articles: DataFrame, keep: tuple[str, ...] = (), zeros: bool = True) -> DataFrame:
    """``value``: a CSV line for each row of an article table; without ``zeros`` totals of nothing are empty cells."""
    shown = lambda c: F.col(c) if zeros or c not in MONEY else F.when(F.col(c) != 0, F.col(c))
    return articles.select(*keep, F.concat_ws(",", *[T.csv_cell(shown(c)) for c in COLUMNS]).alias("value"))


def write_csv(articles: DataFrame, path: str, header: tuple[str, ...] = R.CSV_HEADER, bom: bool = False, single: bool = False, zeros: bool = True) -> None:
    """Write an article table as CSV text.

    Every part has the header, as Spark's own writer does.  ``single`` writes one
    sorted part, for results that people open; ``bom`` puts a byte order mark
    before each header; the English header is ``rules.CSV_HEADER_EN``.
    """
    lines = csv_lines(articles, ("file", "pos"), zeros)
    head = ("\ufeff" if bom else "") + ",".join(header)
    parts = lines.repartition(1) if single else lines
    parts = parts.sortWithinPartitions("file", "pos").select("value")

    def with_head(batches):
        started = False
        for b in batches:
            if not started:
                yield pa.RecordBatch.from_arrays([pa.array([head])], names=["value"])
                started = True
            yield pa.RecordBatch.from_arrays(b.columns, names=["value"])
        if not started:
            yield pa.RecordBatch.from_arrays([pa.array([head])], names=["value"])

    parts.mapInArrow(with_head, "value string").write.mode("overwrite").text(path)


def write_json(docs: DataFrame, path: str) -> None:
    """Write documents as JSON lines."""
    docs.write.mode("overwrite").json(path)


def write_json_array(docs: DataFrame, path: str, order: str = "file") -> None:
    """Write documents as one JSON array in one part, by ``order``: for results that people open, as it is made by one task."""
    lines = docs.select(F.col(order).alias("__order"), F.to_json(F.struct(*docs.columns)).alias("value"))
    # A row that isn't written, so that the one task also runs for a table without rows.
    none = docs.sparkSession.range(1).select(*[F.lit(None).cast(lines.schema[c].dataType).alias(c) for c in lines.columns])
    lines = lines.unionByName(none).repartition(1).sortWithinPartitions("__order").select("value")

    def listed(batches):
        lead = "["
        for b in batches:
            rows = [x for x in b.column(0).to_pylist() if x is not None]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([lead + rows[0], *("," + r for r in rows[1:])])], names=["value"])
                lead = ","
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if lead == "[" else "]"])], names=["value"])

    lines.mapInArrow(listed, "value string").write.mode("overwrite").text(path)


def write_csv_file(articles: DataFrame, path: str, header: tuple[str, ...] = R.CSV_HEADER, bom: bool = False, zeros: bool = True) -> None:
    """Write an article table as the one CSV file ``path``, by file and position, with one header: see files.write_lines().

    Rows of one document are next to each other; a document of very many
    articles may be written by several tasks.
    """
    head = ("\ufeff" if bom else "") + ",".join(header) + "\n"
    files.write_lines(csv_lines(articles, ("file", "pos"), zeros), path, ["file", "pos"], head=head)


def write_json_file(docs: DataFrame, path: str, order: str = "file") -> None:
    """Write documents as the one JSON array file ``path``, by ``order``, a document a line."""
    lines = docs.select(F.col(order).alias("__order"), F.to_json(F.struct(*docs.columns)).alias("value"))
    files.write_lines(lines, path, ["__order", "value"], lead=",", first="[", tail="]\n")
