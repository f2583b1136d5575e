"""Line parsers that are functions: for vendors whose items no declarative layout describes.

A parser maps a text to rows and is registered by vendor.  All of them are one
table function over Arrow batches, joined laterally to the documents of their
vendors; those of other vendors keep the compiled layouts and never reach
Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.operators import items
from ledgerleaf.plans import rules as R

#: From a text to its items: names of items.ARTICLE, missing ones null.
Parser = Callable[[str], Iterable[Mapping[str, object]]]
PLACES = {c: int(kind[8:-1].split(",")[1]) for c, kind in items.ARTICLE.items() if kind.startswith("decimal(")}


def _exact(column: str, value: object) -> object:
    if value is None or column not in PLACES:
        return None if value is None else str(value)
    return Decimal(str(value)).quantize(Decimal(1).scaleb(-PLACES[column]))


def table_function(parsers: Mapping[str, Parser]):
    """The table function of the registered parsers: of (vendor, text) a row an item, by its place."""

    class Lines:
        def eval(self, vendor: str, text: str):
            for k, item in enumerate(parsers[vendor](text or "")):
                yield (k, *[_exact(c, item.get(c)) for c in items.ARTICLE])

    return F.udtf(Lines, returnType="place int, " + ", ".join(f"{c} {kind}" for c, kind in items.ARTICLE.items()), useArrow=True)


def parsed_lines(docs: DataFrame, parsers: Mapping[str, Parser], text: str = "text", vendor: str = "vendor") -> DataFrame:
    """A row an item of the documents whose vendor has a parser: ``docs`` without its text, ``place`` and the item's columns.

    Documents without items have none.  A parser that fails ends the query: its
    faults are the registrant's.
    """
    lines = table_function(parsers)
    own = docs.filter(F.col(vendor).isin(*parsers) if parsers else F.lit(False))
    return own.lateralJoin(lines(F.col(vendor).outer(), F.col(text).outer())).select(*[c for c in docs.columns if c != text], "place", *items.ARTICLE)


def vendor_lines(docs: DataFrame, parsers: Mapping[str, Parser], vendors: tuple[R.Vendor, ...] = R.VENDORS, text: str = "text", vendor: str = "vendor") -> DataFrame:
    """parsed_lines() for vendors with a parser, and the same rows by the compiled layout for the others."""
    rest = docs.filter(~F.coalesce(F.col(vendor).isin(*parsers), F.lit(False))) if parsers else docs
    keep = [c for c in docs.columns if c != text]
    # The outer form keeps the pattern scan from being evaluated again in a filter below it.
    compiled = rest.select(*keep, F.posexplode_outer(items.articles(items.vendor_items(F.coalesce(F.col(text), F.lit("")), F.col(vendor), vendors))).alias("place", "i")).filter("i IS NOT NULL")
    return parsed_lines(docs, parsers, text, vendor).unionByName(compiled.select(*keep, "place", *[F.col(f"i.{c}").alias(c) for c in items.ARTICLE]))
