"""Field extraction: generic labels, vendor rules, and merging by precedence.

Everything is compiled from ``plans.rules`` into built-in expressions over one
text column; no row leaves the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerleaf.functions import text as T
from ledgerleaf.plans import rules as R
from ledgerleaf.plans import shapes as S

TOTALS = ("subtotal", "tax", "total")
MONEY = "decimal(12,2)"


def _lines(text: Column) -> Column:
    # By one plain character, for which no pattern is compiled for each text.
    return F.split(T.replaced(text, "\r\n", "\n"), "\n")


def _unfinished(name: str) -> str:
    """A label's pattern, which ends with its line, so that it can be looked for in a whole text."""
    # The label's first letter is looked at before what stands before it.
    firsts = "".join(dict.fromkeys(x[0] for x in re.sub(r"\A\(\?:|\)[^)]*\Z", "", R.LABELS[name]).split("|")))
    return T.starting(firsts) + "%a" + R.LABELS[name].replace("[^)]", r"[^)\n]")


def _label(name: str) -> str:
    return T.pattern(_unfinished(name), lines=True)


def _date_pattern(name: str) -> str:
    """The group is the first date after a label in its line or, if that has none, in the line below."""
    return T.pattern(_unfinished(name) + rf"(?=(?:[^\n]*?|[^\n]*+\n[^\n]*?)({T.DAY_MONTH_YEAR}))[^\n]*+", lines=True)


def _value_pattern(name: str) -> str:
    """The group is what follows a label in its line up to the next label, without signs before it and currency after it; none if that label is next."""
    stop, currency = R.VALUE_STOP.removeprefix("%b"), R.CURRENCY_TAIL.removesuffix(r"\z")
    # What follows a label is a text of its own: a next label right behind it needs no word's edge.
    # The value grows over characters that none of what may end it begins with, which is seen at once.
    may_end = T.starting(_STOP_FIRSTS + T.BLANK_CHARS, r"|\z")
    return T.pattern(_unfinished(name) + rf"(?:{stop}|(?:[:;.,]|_)*+([^\n]*?){may_end}(?:{currency})?~(?={T.starting(_STOP_FIRSTS)}%b{stop}|\n|\z))[^\n]*+", lines=True)


_STOP_FIRSTS = "".join(dict.fromkeys(x[0] for x in re.sub(r"\A%b\(\?:|\)[^)]*\Z", "", R.VALUE_STOP).split("|")))


def _has(low: Column, words: tuple[str, ...]) -> Column:
    return reduce(or_, [low.contains(w) for w in words])


def _said(line: Column, name: str) -> Column:
    """Whether a line has a label; most lines lack its words, and those are looked for without a pattern."""
    return _has(line["low"], R.LABEL_WORDS[name]) & line["line"].rlike(_label(name))


def _labelled_lines(text: Column) -> Column:
    """The lines with a label's words, each with the line below: what a search of the whole text is held against."""
    words = tuple(dict.fromkeys(w for name in R.LABELS for w in R.LABEL_WORDS[name]))

    def shaped(lines: Column) -> Column:
        one = lambda x, i: F.struct(x.alias("line"), F.get(lines, i + 1).alias("below"), T.low_letters(x).alias("low"))
        return F.filter(F.transform(lines, one), lambda x: x["low"].rlike(T.any_of(words)))

    return T.bind(T.bind(F.coalesce(text, F.lit("")), _lines), shaped)


def _scanned(text: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of a text whose lines end in line feeds alone, and of its small letters; null counts as empty.

    Each label is looked for in the whole text at once, and only if its words are there.
    """
    lines = T.bind(F.coalesce(text, F.lit("")), lambda t: T.replaced(t, "\r\n", "\n"))
    return T.bind(lines, lambda t: T.bind(T.low_letters(t), lambda low: body(t, low)))


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def _found(text: Column, low: Column, name: str, java_pattern: str) -> Column:
    """The pattern's group beside each line's first label of this name; null without its words."""
    return F.when(_has(low, R.LABEL_WORDS[name]), F.regexp_extract_all(text, F.lit(java_pattern), F.lit(1)))


def label_date(text: Column, name: str) -> Column:
    """The date beside a label or, if that line has none, on the line below; later labels are tried if it is invalid."""
    return _scanned(text, lambda t, low: _date_in(t, low, name))


def _date_in(text: Column, low: Column, name: str) -> Column:
    return _first(F.transform(_found(text, low, name, _date_pattern(name)), T.found_day))


def label_value(text: Column, name: str, most: int) -> Column:
    """The text beside a label up to the next label, without currency; empty or longer ones are passed over."""
    return _scanned(text, lambda t, low: _value_in(t, low, name, most))


def _value_in(text: Column, low: Column, name: str, most: int) -> Column:
    return F.get(F.filter(_found(text, low, name, _value_pattern(name)), lambda v: F.length(v).between(1, most)), F.lit(0))


def label_amount(text: Column, name: str) -> Column:
    return _scanned(text, lambda t, low: _amount_in(t, low, name))


def _amount_in(text: Column, low: Column, name: str) -> Column:
    return T.labelled_amount(_value_in(text, low, name, R.VALUE_CHARS), R.MOST_TOTAL)


def label_tax(text: Column) -> Column:
    """IGIC, IVA or TAX by the first line with a tax label; null if that label is spelled otherwise."""
    return _scanned(text, _tax_in)


def _tax_in(text: Column, low: Column) -> Column:
    word = lambda w: T.pattern(f"%b(?:{w})%e")
    head = F.when(_has(low, R.LABEL_WORDS["tax"]), F.regexp_extract(text, _label("tax"), 0))
    return T.bind(head, lambda h: F.when(h.rlike(word("igic")), "IGIC").when(h.rlike(word("iva")), "IVA").when(h.rlike(word("tax|taxes")), "TAX"))


def named(**values: Column) -> Column:
    """The names of those that aren't null, in order."""
    return F.array_compact(F.array(*[F.when(v.isNotNull(), F.lit(k)) for k, v in values.items()]))


def generic_fields(text: Column) -> Column:
    """The seven generic slots as a struct, with the list of those found."""

    return _scanned(text, _slots)


def _slots(text: Column, low: Column) -> Column:
    found = {
        "invoice_date": _date_in(text, low, "invoice_date"),
        "simplified_invoice_date": _date_in(text, low, "simplified_invoice_date"),
        "invoice_number": _value_in(text, low, "invoice_number", R.NUMBER_CHARS),
        "subtotal": _amount_in(text, low, "subtotal"),
        "tax_label": _tax_in(text, low),
        "tax": _amount_in(text, low, "tax"),
        "total": _amount_in(text, low, "total"),
    }

    def shaped(s: Column, order: tuple[str, ...]) -> Column:
        plain = [s[k].alias(k) for k in ("invoice_date", "simplified_invoice_date", "invoice_number", "tax_label")]
        return F.struct(*plain, F.struct(*[s[k].alias(k) for k in TOTALS]).alias("totals"), named(**{k: s[k] for k in order}).alias("matched"))

    return T.bind(F.struct(*[v.alias(k) for k, v in found.items()]), lambda s: shaped(s, tuple(found)))


# Vendors.


def detect_vendor(text: Column, vendors: tuple[R.Vendor, ...] = R.VENDORS) -> Column:
    """The first vendor, by priority, of which any marker occurs; null for none."""
    return T.bind(text, lambda t: T.bind(T.low_letters(t), lambda low: _vendor_of(t, low, vendors)))


def detect_vendors(text: Column, **groups: tuple[R.Vendor, ...]) -> Column:
    """A struct with the first vendor of each group, by its name, of a bound text."""
    return T.bind(T.low_letters(text), lambda low: F.struct(*[_vendor_of(text, low, vendors).alias(name) for name, vendors in groups.items()]))


def _vendor_of(text: Column, low: Column, vendors: tuple[R.Vendor, ...]) -> Column:
    def any_marker(markers: tuple[str, ...]) -> Column:
        has = text.rlike(T.pattern("|".join(markers)))
        # Most texts lack the longest words of a vendor's markers, which is seen without a pattern.
        words = [T.needed(m) for m in markers]
        return _has(low, tuple(words)) & has if all(words) else has

    return F.coalesce(*[F.when(any_marker(v.markers), F.lit(v.name)) for v in vendors])


def _vendor_totals(text: Column, rules: R.FieldRules) -> Column:
    none = F.lit(None).cast(MONEY)
    if rules.each:
        return F.struct(*[(T.spanish_amount(T.first_group(text, rules.each[k].pattern()), MONEY) if k in rules.each else none).alias(k) for k in TOTALS])
    nothing = F.struct(*[none.alias(k) for k in TOTALS])

    def alternative(k: int) -> Column:
        """The first alternative from the k-th on that occurs at all; parts are taken from its match alone."""
        if k == len(rules.totals):
            return nothing
        p, parts = S.between(*rules.totals[k]), [c.column for c in rules.totals[k] if isinstance(c, S.Cell)]
        taken = lambda m: F.struct(*[(T.spanish_amount(F.regexp_extract(m, p, parts.index(t) + 1), MONEY) if t in parts else none).alias(t) for t in TOTALS])
        return T.bind(F.regexp_extract(text, p, 0), lambda m: F.when(m != "", taken(m)).otherwise(alternative(k + 1)))

    return alternative(0)


def vendor_fields(text: Column, vendor: Column, vendors: tuple[R.Vendor, ...] = R.VENDORS) -> Column:
    """The fields by the vendor's own rules; a null struct if the vendor has none."""
    # Bound, as each vendor is compared with it.
    return T.bind(vendor, lambda by: _fields_by(text, by, vendors))


def _fields_by(text: Column, vendor: Column, vendors: tuple[R.Vendor, ...]) -> Column:
    word = lambda w: text.rlike(T.pattern(f"{T.starting(w[0])}%b{w}%e"))
    tax_label = F.when(word("IGIC"), "IGIC").when(word("IVA"), "IVA")
    out = None
    for v in vendors:
        if v.fields:
            f = v.fields
            made = F.struct(
                F.lit(v.name).alias("vendor"),
                (T.vendor_date(T.first_group(text, f.date.pattern())) if f.date else F.lit(None).cast("date")).alias("invoice_date"),
                (T.first_group(text, f.number.pattern()) if f.number else F.lit(None).cast("string")).alias("invoice_number"),
                tax_label.alias("tax_label"),
                _vendor_totals(text, f).alias("totals"),
            )
            out = F.when(vendor == v.name, made) if out is None else out.when(vendor == v.name, made)
    return out if out is not None else F.lit(None).cast(f"struct<vendor:string,invoice_date:date,invoice_number:string,tax_label:string,totals:struct<subtotal:{MONEY},tax:{MONEY},total:{MONEY}>>")


def merge_fields(generic: Column, vendor: Column) -> Column:
    """Vendor values override generic ones one by one; the list of matches is extended in order."""
    over = {"invoice_number": vendor["invoice_number"], "invoice_date": vendor["invoice_date"], "tax_label": vendor["tax_label"], **{k: vendor["totals"][k] for k in TOTALS}}
    return F.struct(
        F.coalesce(over["invoice_date"], generic["invoice_date"]).alias("invoice_date"),
        generic["simplified_invoice_date"].alias("simplified_invoice_date"),
        F.coalesce(over["invoice_number"], generic["invoice_number"]).alias("invoice_number"),
        F.coalesce(over["tax_label"], generic["tax_label"]).alias("tax_label"),
        F.struct(*[F.coalesce(over[k], generic["totals"][k]).alias(k) for k in TOTALS]).alias("totals"),
        F.array_union(generic["matched"], named(**over)).alias("matched"),
        vendor["vendor"].alias("vendor"),
    )


def extract_fields(text: Column, vendor: Column | None = None) -> Column:
    """Generic and vendor fields of a text, merged; null text counts as empty."""

    def of(t: Column, low: Column) -> Column:
        lines = T.replaced(t, "\r\n", "\n")
        generic = T.bind(lines, lambda x: _slots(x, low))
        by = vendor if vendor is not None else _vendor_of(t, low, R.VENDORS)
        both = T.bind(by, lambda v: F.struct(generic.alias("g"), vendor_fields(t, v).alias("v")))
        return T.bind(both, lambda s: merge_fields(s["g"], s["v"]))

    # Ends of lines are no part of what is looked for in small letters.
    return T.bind(F.coalesce(text, F.lit("")), lambda t: T.bind(T.low_letters(t), lambda low: of(t, low)))


def fill_from_model(fields: Column, number: Column, date: Column, total: Column) -> Column:
    """A model's output fills only what the rules left open; it never overrides."""
    return T.bind(fields, lambda f: _filled(f, number, date, total))


def _filled(fields: Column, number: Column, date: Column, total: Column) -> Column:
    add = {"invoice_number": F.when(fields["invoice_number"].isNull(), T.null_if_empty(number)), "invoice_date": F.when(fields["invoice_date"].isNull(), date), "total": F.when(fields["totals"]["total"].isNull(), total.cast(MONEY))}
    totals = fields["totals"]
    return F.struct(
        F.coalesce(fields["invoice_date"], add["invoice_date"]).alias("invoice_date"),
        fields["simplified_invoice_date"].alias("simplified_invoice_date"),
        F.coalesce(fields["invoice_number"], add["invoice_number"]).alias("invoice_number"),
        fields["tax_label"].alias("tax_label"),
        F.struct(totals["subtotal"].alias("subtotal"), totals["tax"].alias("tax"), F.coalesce(totals["total"], add["total"]).alias("total")).alias("totals"),
        F.concat(fields["matched"], named(**add)).alias("matched"),
        fields["vendor"].alias("vendor"),
    )
