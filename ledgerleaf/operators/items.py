"""Line items: bounded regions, row patterns, cleaning and keyed first-wins dedup.

A document's items stay an array in its row: no explode, no shuffle, however
many documents there are.  A row pattern is applied twice to a match: once to
find it in the region, once to part it into its columns.  A text that is used
in several places is bound, so that it is made once.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerleaf.functions import text as T
from ledgerleaf.plans import rules as R
from ledgerleaf.plans import shapes as S

AMOUNT, RATE = "decimal(18,4)", "decimal(9,4)"
#: The columns of a line item with their types; a layout leaves null what it doesn't print.
ITEM = {
    "description": "string", "units": AMOUNT, "unit_price": AMOUNT, "amount": AMOUNT, "tax_rate": RATE, "base": AMOUNT, "tax_amount": AMOUNT,
    "tax_label": "string", "list_price": AMOUNT, "discount_pct": RATE, "reference": "string",
}
ITEM_TYPE = f"struct<{','.join(f'{k}:{v}' for k, v in ITEM.items())}>"
ARTICLE = {"description": "string", "units": AMOUNT, "unit_price": AMOUNT, "amount": AMOUNT, "tax_rate": RATE}
ARTICLE_TYPE = f"struct<{','.join(f'{k}:{v}' for k, v in ARTICLE.items())}>"
#: Parts the columns of a match; stripped from texts by the reader as a control character.
_SEP = "\x1f"


def _parts(row: Column, java_pattern: str, groups: int) -> Column:
    """The groups of a row that the pattern matches as a whole."""
    return F.split(F.regexp_replace(row, rf"\A{java_pattern}\z", _SEP.join(f"${k}" for k in range(1, groups + 1))), _SEP)


def rows_of(region: Column, java_pattern: str, groups: int) -> Column:
    """All matches of a row pattern in a region, each an array of its groups."""
    return F.transform(F.regexp_extract_all(F.replace(region, F.lit(_SEP), F.lit(" ")), F.lit(java_pattern), F.lit(0)), lambda row: _parts(row, java_pattern, groups))


def _item(**values: Column) -> Column:
    return F.struct(*[values.get(k, F.lit(None)).cast(kind).alias(k) for k, kind in ITEM.items()])


# Tabular tickets.


def ticket_region(text: Column) -> Column:
    """After the first known header, in order of preference, up to the earliest footer; all of it without a header."""

    def region(t: Column) -> Column:
        start = F.coalesce(*[T.find_from(t, m) + len(m) for m in R.TICKET_STARTS])
        return T.bind(start, lambda s: F.when(s.isNull(), t).otherwise(before_end(F.substring(t, s, F.length(t)))))

    def before_end(rest: Column) -> Column:
        # What is after the cap can't move the earliest footer before it.
        return F.substring(F.regexp_replace(rest, f"(?s){T.any_of(R.TICKET_ENDS)}.*\\z", ""), F.lit(1), F.lit(R.REGION_CHARS))

    return T.bind(text, region)


def plausible_description(d: Column) -> Column:
    return T.bind(T.trim_short(d), _plausible)


def _plausible(d: Column) -> Column:
    """Of a trimmed description."""
    low, high = R.DESCRIPTION_CHARS
    return F.length(d).between(low, high) & ~F.upper(d).rlike(T.any_of(R.NOT_PRODUCTS)) & ~d.rlike(f"(?:[0-9][^0-9]*+){{{R.DESCRIPTION_DIGITS + 1}}}")


def ticket_items(text: Column) -> Column:
    """``struct<items, skipped>`` of a tabular ticket.

    Implausible descriptions are skipped and counted; of rows with the same
    description, units and total the first stays, and later ones aren't counted.
    """
    rows = F.transform(rows_of(ticket_region(text), T.pattern(S.row(R.TICKET_CELLS), ""), len(R.TICKET_CELLS)), lambda p: F.struct(T.trim_short(T.collapse_blanks(F.get(p, F.lit(0)))).alias("d"), p.alias("p")))

    def typed(r: Column) -> Column:
        part = lambda k: F.get(r["p"], F.lit(k))
        n = lambda k: T.tabular_number(part(k), AMOUNT)
        return _item(description=r["d"], units=n(1), unit_price=n(2), base=n(3), tax_label=T.trim_short(part(4)), tax_amount=n(5), amount=n(6))

    def of(all_rows: Column) -> Column:
        good = F.filter(all_rows, lambda r: _plausible(r["d"]))

        def firsts(g: Column) -> Column:
            keys = F.transform(g, lambda r: F.concat_ws("|", r["d"], F.get(r["p"], F.lit(1)), F.get(r["p"], F.lit(6))))
            kept = T.bind(keys, lambda ks: F.when(F.size(F.array_distinct(ks)) == F.size(ks), g).otherwise(F.filter(g, lambda r, i: F.array_position(ks, F.get(ks, i)) == i + 1)))
            return F.struct(F.transform(kept, typed).alias("items"), (F.size(all_rows) - F.size(g)).alias("skipped"))

        return T.bind(good, firsts)

    return T.bind(rows, of)


def ticket_stats(parsed: Column) -> Column:
    """Counts and the rounded sum of an item list from ``ticket_items``."""
    return F.struct(
        F.size(parsed["items"]).alias("items_detected"),
        parsed["skipped"].alias("items_skipped"),
        F.round(F.aggregate(parsed["items"], F.lit(0).cast("decimal(28,4)"), lambda s, x: (s + F.coalesce(x["amount"], F.lit(0).cast(AMOUNT))).cast("decimal(28,4)")), 2).alias("sum_totals"),
    )


# Vendors' layouts.


def bounded_region(text: Column, start: str, end: str) -> Column:
    """From a start marker (included) up to an end marker after it, capped; without the start: the text's beginning."""
    cap = F.lit(R.REGION_CHARS)

    def of(t: Column, s: Column) -> Column:
        n = F.least(F.coalesce(T.find_from(t, end, s), F.length(t) + 1) - s, cap)
        return F.when(s.isNull(), F.substring(t, F.lit(1), cap)).otherwise(F.substring(t, s, n))

    return T.bind(text, lambda t: T.bind(T.find_from(t, start), lambda s: of(t, s)))


def clean_description(c: Column) -> Column:
    """Without serial numbers, a leading run of column headers, and all up to a telephone number."""

    def without_numbers(d: Column) -> Column:
        for word in ("n[úu]mero", "n[úu]meros"):
            d = F.regexp_replace(d, T.pattern(f"{word}_de_serie~:~[A-Z0-9]+"), "")
        return d

    # Patterns that fold cases are tried only where their letters are.
    with_letters = lambda v, letters, made: T.bind(v, lambda d: F.when(T.low_letters(d).contains(letters), made(d)).otherwise(d))
    c = T.trim_short(T.collapse_blanks(with_letters(c, "serie", without_numbers)))
    tokens = T.any_of(tuple(sorted(R.HEADER_WORDS, key=len, reverse=True)))
    c = F.regexp_replace(c, rf"\A(?:{tokens}\.?[{T.BLANK}]+)+", "")
    return T.trim_short(with_letters(c, "fono", lambda d: F.regexp_replace(d, T.pattern(rf"\A.*?Tel[ée]fono~:~[0-9{T.BLANK}]+"), "")))


def _row_pieces(cells: tuple[S.Cell, ...]) -> tuple[str, ...]:
    """What any row of these cells has in it."""
    pieces = [T.needed(c.ends, fold=False) for c in cells] + [c.tail for c in cells] + ["," for c in cells if c.kind == "decimal"]
    return tuple(dict.fromkeys(x for x in pieces if x))


def layout_items(text: Column, rules: R.ItemRules) -> Column:
    """The rows of one vendor's layout."""

    def found(region: Column) -> Column:
        rows = rows_of(region, T.pattern(S.row(rules.cells), ""), len(rules.cells))
        pieces = _row_pieces(rules.cells)
        # A description may start at any character, which is tried only where a row's signs are.
        return F.when(reduce(and_, [region.contains(x) for x in pieces]), rows).otherwise(F.array().cast("array<array<string>>")) if pieces else rows

    rows = T.bind(bounded_region(text, rules.start, rules.end), found)

    def typed(p: Column) -> Column:
        out = {}
        for k, name in enumerate(rules.columns):
            part = F.get(p, F.lit(k))
            out[name] = clean_description(part) if name == "description" else part if ITEM[name] == "string" else T.spanish_amount(part, ITEM[name])
        return _item(**out)

    return F.transform(rows, typed)


def vendor_items(text: Column, vendor: Column, vendors: tuple[R.Vendor, ...] = R.VENDORS) -> Column:
    """The line items by the vendor's layout; an empty list for an unknown vendor or one without a layout."""
    none = F.array().cast(f"array<{ITEM_TYPE}>")

    def of(t: Column) -> Column:
        out = None
        for v in vendors:
            made = ticket_items(t)["items"] if v.tabular else layout_items(t, v.items) if v.items else None
            if made is not None:
                out = F.when(vendor == v.name, made) if out is None else out.when(vendor == v.name, made)
        return out.otherwise(none) if out is not None else none

    return T.bind(text, of)


# Articles.


def articles(items: Column) -> Column:
    """Line items in the canonical shape."""
    return F.transform(items, lambda x: F.struct(*[x[k].cast(kind).alias(k) for k, kind in ARTICLE.items()]))


def model_articles(items: Column) -> Column:
    """A model's items (description, quantity, unitPrice, amount, taxRate as texts) in the canonical shape."""
    pick = {"description": "description", "units": "quantity", "unit_price": "unitPrice", "amount": "amount", "tax_rate": "taxRate"}
    return F.transform(items, lambda x: F.struct(*[(x[pick[k]] if kind == "string" else x[pick[k]].try_cast(kind)).alias(k) for k, kind in ARTICLE.items()]))


def longer_list(items: Column, others: Column) -> Column:
    """``others`` only if it has more entries."""
    both = F.struct(items.alias("own"), others.alias("more"))
    return T.bind(both, lambda b: F.when(F.size(F.coalesce(b["more"], F.array().cast(f"array<{ARTICLE_TYPE}>"))) > F.size(b["own"]), b["more"]).otherwise(b["own"]))


def reconciled_total(total: Column, items: Column) -> Column:
    """The printed total or, if there is none, the items' rounded sum; null if an amount is missing or the sum isn't positive."""
    s = F.aggregate(items, F.lit(0).cast("decimal(28,4)"), lambda a, x: (a + x["amount"]).cast("decimal(28,4)"))
    return F.coalesce(total, T.bind(s, lambda x: F.when((F.size(items) > 0) & (x > 0), F.round(x, 2).cast("decimal(12,2)"))))


def items_text(items: Column) -> Column:
    """``description :: units :: price :: amount`` of each article, joined by semicolons; nulls as empty."""
    e = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.array_join(F.transform(items, lambda x: F.concat_ws(" :: ", e(x["description"]), e(x["units"]), e(x["unit_price"]), e(x["amount"]))), " ; ")
