"""Page and character budgets of a document's text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.functions import text as T
from ledgerleaf.plans import rules as R

RESULT = "struct<pieces:array<string>,used:int,hit:boolean>"


def page_budget(pages: Column, declared: Column, max_pages: Column | int = R.DEFAULT_PAGES, max_chars: Column | int = R.DEFAULT_CHARS) -> Column:
    """The bounded text of an array of page texts.

    Returns ``struct<text, joined, pages, truncated, truncation_reason, applied>``.
    Blank and null pages vanish; each page gives at most 4,000 characters and
    all together at most ``max_chars``; ``pages`` is the number of pages
    attempted.  ``joined`` is the text before the last cut.
    """
    max_pages = F.lit(max_pages) if isinstance(max_pages, int) else max_pages
    max_chars = F.lit(max_chars) if isinstance(max_chars, int) else max_chars
    attempted = F.least(F.when(F.coalesce(declared, F.lit(0)) > 0, declared).otherwise(max_pages), max_pages).cast("int")

    def step(s: Column, page: Column) -> Column:
        left = F.greatest(max_chars - s["used"], F.lit(0))

        def taken(piece: Column) -> Column:
            took = F.length(piece)
            return F.struct(
                F.when(left > 0, F.concat(s["pieces"], F.array(piece))).otherwise(s["pieces"]).alias("pieces"),
                (s["used"] + took).cast("int").alias("used"),
                (s["hit"] | (F.length(page) > took) | (s["used"] + took >= max_chars)).alias("hit"),
            )

        return T.bind(F.substring(page, F.lit(1), F.least(F.lit(R.PAGE_CHARS), left)), taken)

    trimmed = F.filter(F.transform(F.slice(F.coalesce(pages, F.array().cast("array<string>")), F.lit(1), F.greatest(attempted, F.lit(1))), T.trim_bound), lambda p: F.length(p) > 0)
    start = F.struct(F.array().cast("array<string>").alias("pieces"), F.lit(0).alias("used"), F.lit(False).alias("hit"))
    walked = F.aggregate(trimmed, start, step)

    def of(w: Column) -> Column:
        return T.bind(T.strip_controls(F.array_join(w["pieces"], "\n\n")), lambda joined: result(w["hit"], joined))

    def result(hit: Column, joined: Column) -> Column:
        chars_hit = hit | (F.length(joined) > max_chars)
        pages_hit = F.coalesce(declared, F.lit(0)) > attempted
        reason = F.when(pages_hit & chars_hit, "maxPagesAndMaxChars").when(pages_hit, "maxPages").when(chars_hit, "maxChars")
        return F.struct(
            T.truncated(joined, max_chars).alias("text"),
            joined.alias("joined"),
            attempted.alias("pages"),
            (pages_hit | chars_hit).alias("truncated"),
            reason.alias("truncation_reason"),
            F.struct(max_pages.cast("int").alias("max_pages"), max_chars.cast("int").alias("max_chars")).alias("applied"),
        )

    return T.bind(walked, of)


def gather_pages(df: DataFrame, doc: str, page_no: str, text: str, max_pages: int = R.DEFAULT_PAGES) -> DataFrame:
    """``doc, declared, pages`` from a table with a row a page: the first ``max_pages`` that there are.

    Pages stand by number, without a number last, those of one number by their
    texts; gaps and repeats lose nothing, and ``declared`` counts all pages.
    Pages beyond the limit are dropped before the shuffle.
    """
    # Ranks up to a limit are cut in each task first, so a document of very many pages isn't in one.
    rank = F.row_number().over(Window.partitionBy(doc).orderBy(F.asc_nulls_last(page_no), F.asc_nulls_last(text)))
    kept = df.select(F.col(doc), F.col(page_no), F.col(text)).withColumn("__nr", rank).filter(F.col("__nr") <= max_pages)
    pages = F.transform(F.array_sort(F.collect_list(F.struct("__nr", F.col(text)))), lambda x: x[text])
    declared = df.groupBy(F.col(doc).alias("__doc")).agg(F.count("*").cast("int").alias("declared"))
    return declared.join(kept.groupBy(doc).agg(pages.alias("pages")), F.col("__doc").eqNullSafe(F.col(doc))).select(doc, "declared", "pages")


def truncation(result: Column) -> Column:
    """What a caller is told about a cut text; null if nothing was cut."""
    return F.when(
        result["truncated"],
        F.struct(
            F.coalesce(result["truncation_reason"], F.lit("maxChars")).alias("reason"),
            result["applied"].alias("applied"),
            F.struct(F.lit(R.HARD_PAGES).alias("max_pages"), F.lit(R.HARD_CHARS).alias("max_chars")).alias("allowed"),
            F.lit(True).alias("requires_user_confirmation"),
        ),
    )
