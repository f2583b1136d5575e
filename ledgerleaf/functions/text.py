"""Column helpers for text: blanks, patterns, amounts, dates, file names, CSV cells.

All are built-in expressions.  Patterns are Java's; see ``pattern()`` for how
rule patterns get their case folding and their wide class of blanks.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All characters that count as blank in document text, as the inside of a class.
BLANK = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: The characters of the class themselves.
BLANK_CHARS = " \t\n\v\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: The same class as it is compiled: most characters are no blanks and are passed over by the first, cheap test.
_BLANKS = rf"[[^!-~]&&[{BLANK}]]"
#: The same within a line, which no line feed parts.
_LINE_BLANKS = _BLANKS.replace(r"\s", r" \t\x0b\f\r")
_EDGES = rf"\A{_BLANKS}+|{_BLANKS}+\z"
#: Each by itself, as such a class is looked up at once, where ranges are tried in turn.
_CONTROLS = "[" + "".join(f"\\x{k:02x}" for k in (*range(9), 11, 12, *range(14, 32), 127)) + "]"
#: Letters that a pattern takes, in whatever case, for one of A to Z.
_ODD_LETTERS = {"\u0130": "i", "\u0131": "i", "\u017f": "s", "\u212a": "k"}
_WORD = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_"


def pattern(source: str, flags: str = "iu", lines: bool = False) -> str:
    """A Java pattern from a rule's: ``_`` is a run of blanks, ``~`` any blanks, ``%b``/``%e`` word edges in ASCII, ``%a`` the text's start or a place after a blank.

    ``iu`` folds accented letters too; pass ``""`` for exact case.  With ``lines``
    a run of blanks ends with its line.
    """
    # Blanks have no case, and of words all letters are given; a class that folds case looks up both cases of each character that it is tried on.
    plain, again = (f"(?-{flags})", f"(?{flags})") if flags else ("", "")
    word = f"{plain}[{_WORD}{''.join(_ODD_LETTERS) if flags else ''}]"
    for short, long in (("_", f"[{BLANK}]+"), ("~", f"[{BLANK}]*"), ("%b", f"(?<!{word})"), ("%e", f"(?!{word})")):
        source = source.replace(short, long)
    blanks = _LINE_BLANKS if lines else _BLANKS
    source = re.sub(rf"{re.escape(f'[{BLANK}]')}((?:[+*?]|\{{[0-9,]+\}})?[+?]?)", lambda m: plain + blanks + m[1] + again, source)
    source = source.replace("%a", rf"(?:(?<={plain}{_BLANKS})|\A)")
    return f"(?{flags}s){source}" if flags else f"(?s){source}"


def starting(firsts: str, more: str = "") -> str:
    """For a pattern that folds case: what follows may begin with one of these, in either case.

    Few characters pass this cheap test: those of Latin-1 are looked up at once, and all beyond are let through.
    """
    each = dict.fromkeys(c for x in firsts for c in (*x.lower(), *x.upper()) if ord(c) < 256)
    return f"(?-iu)(?=[{''.join(map(escape_pattern, each))}\\u0100-\\uffff]{more})(?iu)"


def needed(source: str, fold: bool = True) -> str | None:
    """The longest piece (in small letters, with ``fold``) that is in any text in which a rule's pattern is found; null if that isn't plain to see."""
    bare = re.sub(r"\\x[0-9A-Fa-f]{2}|\\[^0-9A-Za-z]|%[abe]|[_~]", " ", source.replace(f"[{BLANK}]", "[ ]"))
    bare = re.sub(r"\[[^\]\[\\]*\][+*?]?", " ", bare)
    if re.search(r"[\\|(){}\[\]*?^$]", bare):
        return None
    longest = max(re.findall("[0-9A-Za-z]{3,}", bare), key=len, default=None)
    return longest.lower() if longest and fold else longest


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value made once for each row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trim_blanks(c: Column) -> Column:
    """Without leading and trailing blanks of any kind, NBSP included."""
    return F.regexp_replace(c, _EDGES, "")


def trim_bound(t: Column) -> Column:
    """The same for a bound text: most have no blank at an edge, which is seen without a pattern that is tried on each character."""
    blank = lambda edge: F.lit(BLANK_CHARS).contains(edge)
    return F.when(blank(F.substring(t, 1, 1)) | blank(F.substring(t, -1, 1)), trim_blanks(t)).otherwise(t)


def trim_short(c: Column) -> Column:
    """The same for cells and labels' values, without a pattern; it takes some bytes for each one of its text."""
    return F.btrim(c, F.lit(BLANK_CHARS))


def rtrim_blanks(c: Column) -> Column:
    return F.regexp_replace(c, rf"{_BLANKS}+\z", "")


def collapse_blanks(c: Column) -> Column:
    """Each run of blanks as one space."""
    return F.regexp_replace(c, f"{_BLANKS}+", " ")


def strip_controls(c: Column) -> Column:
    """Without control characters, but for tab, line feed and carriage return."""
    return F.regexp_replace(c, _CONTROLS, "")


def safe_string(c: Column) -> Column:
    """One line: controls as blanks, blanks collapsed, trimmed; null as empty."""
    # One pass: controls are blanks here, and what is left at the edges is one space.
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), rf"[\x00-\x1F\x7F{BLANK}]+", " "))


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_group(c: Column, java_pattern: str, group: int = 1) -> Column:
    """A group of the first match; null where nothing (or an empty group) matches."""
    # Bound, as nullif() would look for it twice.
    return bind(F.regexp_extract(c, java_pattern, group), lambda v: F.when(v != "", v))


def find_from(c: Column, marker: str, start: Column | None = None) -> Column:
    """1-based place of the first occurrence at or after ``start``; null if there is none."""
    return bind(F.position(F.lit(marker), c, start if start is not None else F.lit(1)), lambda p: F.when(p > 0, p))


def truncated(c: Column, most: Column | int) -> Column:
    """At most ``most`` characters: a longer text ends in an ellipsis after its trimmed beginning."""
    most = F.lit(most) if isinstance(most, int) else most
    return F.when(F.length(c) <= most, c).otherwise(F.concat(rtrim_blanks(F.substring(c, F.lit(1), F.greatest(most - 1, F.lit(0)))), F.lit("…")))


def escape_pattern(text: str) -> str:
    """A literal text as a part of a pattern."""
    return re.sub(r"([.*+?^${}()|\[\]\\/#&~-])", r"\\\1", text)


def replaced(c: Column, what: str, by: str) -> Column:
    """replace() for a bound text that seldom has ``what``: looking is cheaper than looking for what to replace."""
    return F.when(c.contains(what), F.replace(c, F.lit(what), F.lit(by))).otherwise(c)


def low_letters(c: Column) -> Column:
    """A bound text in which each letter that a pattern takes for one of A to Z, in whatever case, is that small letter."""
    plain = c
    for odd, letter in _ODD_LETTERS.items():
        plain = F.replace(plain, F.lit(odd), F.lit(letter))
    return F.lower(F.when(reduce(or_, [c.contains(x) for x in _ODD_LETTERS]), plain).otherwise(c))


def any_of(words: tuple[str, ...]) -> str:
    """A pattern of literal words, which looks at one character before it tries those that begin with it."""
    heads = {w[0]: [x[1:] for x in words if x[0] == w[0]] for w in words}
    tried = "|".join(escape_pattern(h) + "(?:" + "|".join(map(escape_pattern, rest)) + ")" for h, rest in heads.items())
    return f"(?=[{''.join(map(escape_pattern, heads))}])(?:{tried})"


def escape_pattern_col(c: Column) -> Column:
    return F.regexp_replace(c, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


# Numbers and dates.


def bounded_int(c: Column, fallback: int, hard_max: int) -> Column:
    """A whole number of 1 to ``hard_max``; null, NaN, infinities and values of 0 or less give the fallback."""
    x = c.try_cast("double")
    fine = x.isNotNull() & ~F.isnan(x) & (x > 0) & (x < float("inf"))
    return F.when(fine, F.least(F.greatest(F.floor(x), F.lit(1)), F.lit(hard_max)).cast("int")).otherwise(F.lit(fallback))


def spanish_amount(c: Column, kind: str = "decimal(12,2)") -> Column:
    """An amount as printed by vendors: with dots and commas, dots are thousands; else the first comma is the point."""

    return bind(F.regexp_replace(c, "[^0123456789,.]", ""), lambda kept: plain_amount(kept, kind))


def plain_amount(kept: Column, kind: str = "decimal(12,2)") -> Column:
    """The same for a bound text that has nothing but digits, dots and commas."""
    whole = F.when(kept.contains(",") & kept.contains("."), F.replace(kept, F.lit("."), F.lit(""))).otherwise(kept)
    # With a second comma or point it is no number, whichever of them becomes the point.
    return F.replace(whole, F.lit(","), F.lit(".")).try_cast(kind)


def tabular_number(c: Column, kind: str = "decimal(18,4)") -> Column:
    """A number of a tabular ticket: dots dropped, the comma is the point; with a second one it is no number."""
    return F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast(kind)


#: An amount that starts a value, with nothing numeric after it.
AMOUNT = r"\A((?:[0-9]{1,3}(?:\.[0-9]{3})+|[0-9]+)[.,][0-9]{2})(?![0-9A-Za-z_])[^0-9.,+\-]*\z"


def labelled_amount(value: Column, most: int) -> Column:
    """The money amount of a label's value; null unless it is positive, not over ``most`` and well formed."""

    def of(raw: Column) -> Column:
        whole = F.replace(F.substring(raw, F.lit(1), F.length(raw) - 3), F.lit("."), F.lit(""))
        return F.concat(whole, F.lit("."), F.right(raw, F.lit(2))).try_cast("decimal(38,2)")

    amount = bind(first_group(value, AMOUNT), of)
    return bind(amount, lambda x: F.when((x > 0) & (x <= most), x.cast("decimal(12,2)")))


DAY_MONTH_YEAR = "[0-9]{1,2}[/.][0-9]{1,2}[/.][0-9]{2,4}"


def day_month_year(c: Column) -> Column:
    """The first d/m/yyyy or d.m.yyyy of a text as a date; null if it is none of 1900 to 2100."""
    return found_day(F.regexp_extract(c, DAY_MONTH_YEAR, 0))


def found_day(c: Column) -> Column:
    """The same for a text that is as ``DAY_MONTH_YEAR``, or empty."""
    date = bind(F.replace(c, F.lit("."), F.lit("/")), lambda m: F.when(F.length(F.substring_index(m, "/", -1)) == 4, F.try_to_date(m, "d/M/yyyy")))
    return bind(date, lambda d: F.when(F.year(d).between(1900, 2100), d))


def vendor_date(c: Column) -> Column:
    """yyyy-mm-dd, dd/mm/yyyy or dd-mm-yyyy as a date; impossible dates are null."""
    return bind(bind(c, trim_bound), bound_vendor_date)


def bound_vendor_date(c: Column) -> Column:
    """The same for a bound text without blanks at its edges."""
    return F.when(c.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.try_to_date(c, "yyyy-MM-dd")).when(c.rlike(r"\A([0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}-[0-9]{2}-[0-9]{4})\z"), F.try_to_date(F.replace(c, F.lit("-"), F.lit("/")), "dd/MM/yyyy"))


# Output.


def csv_cell(c: Column) -> Column:
    """A CSV cell: null as empty, formulas disarmed by an apostrophe, quoted where needed."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    any_in = lambda signs, has: reduce(or_, [has(F.lit(x)) for x in signs])
    s = F.when(any_in("=+-@", s.startswith), F.concat(F.lit("'"), s)).otherwise(s)
    return F.when(any_in('",\n', s.contains), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def filename_part(c: Column, fallback: Column | str) -> Column:
    """A part of a file name: forbidden characters and blanks as dashes, dashes trimmed; empty: the fallback."""
    fallback = F.lit(fallback) if isinstance(fallback, str) else fallback
    made = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), rf'[\\/:*?"<>|{BLANK}]+', "-"), r"\A-+|-+\z", "")
    return F.coalesce(null_if_empty(made), fallback)


def strict_base64(c: Column) -> Column:
    """The bytes of strict base64; null for anything else, also for an empty text."""
    ok = c.rlike(r"\A[A-Za-z0-9+/]+={0,2}\z") & (F.length(c) % 4 == 0)
    return F.when(ok, F.try_to_binary(c, F.lit("base64")))
