"""Typed shapes of printed values, and the one compiler that turns them into Java patterns.

A rule says what a value is (a whole number, an amount, a number with so many
decimals, a code, a mask of digits, a text), what label stands before it and how
far off.
Nothing here knows a vendor.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from ledgerleaf.functions import text as T

SOME, ANY, NONE, TABS = f"[{T.BLANK}]+", f"[{T.BLANK}]*", "", r"[ \t]+"
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"


def phrase(text: str) -> str:
    """A printed phrase: blanks are runs of blanks, accented and raised letters may be plain, all else is literal."""
    out = []
    for c in " ".join(text.split()):
        bare = unicodedata.normalize("NFKD", c)[0]
        # These three have a meaning in the short forms of a pattern.
        literal = f"\\x{ord(c):02x}" if c in "_~%" else T.escape_pattern(c)
        out.append(SOME if c == " " else f"[{bare}{c}]" if bare != c and bare.isalpha() else literal)
    return "".join(out)


def listed(chars: str) -> str:
    """The inside of a class with each character of its Latin ranges by itself: they are looked up at once, where ranges are tried in turn."""
    return re.sub(r"([0-9A-Za-z\u00c0-\u00ff])-([0-9A-Za-z\u00c0-\u00ff])", lambda m: "".join(map(chr, range(ord(m[1]), ord(m[2]) + 1))), chars)


def phrases(*parts: str) -> str:
    """Phrases one after the other, with or without blanks between them."""
    return ANY.join(map(phrase, parts))


@dataclass(frozen=True)
class Cell:
    """One printed value; ``gap`` is what stands before it in a row, ``tail`` a sign after it."""

    kind: str
    column: str = ""
    least: int = 1
    most: int | None = None
    places: int = 0
    chars: str = ""
    first: str = ""
    ends: str = ""
    #: Forms of a mask, parted by blanks.
    order: str = ""
    tail: str = ""
    gap: str = SOME

    def _times(self, least: int, most: int | None) -> str:
        return {(0, None): "*", (1, None): "+", (1, 1): ""}.get((least, most), f"{{{least},{'' if most is None else most}}}" if least != most else f"{{{least}}}")

    def source(self) -> str:
        """The value's pattern, without a group."""
        match self.kind:
            case "whole":
                return "[0-9]" + self._times(self.least, self.most)
            case "amount":
                return "[0-9.,]+"
            case "quantity":
                return "[0-9]+(?:[.,][0-9]+)?"
            case "decimal":
                return f"[0-9]+,[0-9]{{{self.places}}}"
            case "mask":
                return "|".join(map(self._mask, self.order.split()))
            case "code":
                if not self.first:
                    return f"[{self.chars}]" + self._times(self.least, self.most)
                return f"[{self.first}][{self.chars}]" + self._times(self.least - 1, None if self.most is None else self.most - 1)
            case "name":
                return f"[{listed(self.first)}][{listed(self.chars)}]{{0,{self.most - 1}}}?"
            case "tax":  # a short name in capitals, or a rate
                return "[A-Z][A-Z0-9 ().%]{0,8}|[0-9]{1,2}%"
            case "text":
                return f".{{{self.least},{self.most}}}?" + self.ends
        raise ValueError(f"no such kind: {self.kind}")

    @staticmethod
    def _mask(form: str) -> str:
        """A digit for each #, one that may be missing for each (#), all else as it is."""
        return "".join("[0-9]?" if x == "(#)" else "[0-9]" if x == "#" else T.escape_pattern(x) for x in re.findall(r"\(#\)|.", form))


def group(cell: Cell) -> str:
    return f"({cell.source()})"


def row(cells: tuple[Cell, ...]) -> str:
    """A row of cells, a group each."""
    return "".join((c.gap if k else "") + group(c) + (ANY + T.escape_pattern(c.tail) if c.tail else "") for k, c in enumerate(cells))


@dataclass(frozen=True)
class Labelled:
    """Values after a label: ``near`` allows so many characters between, ``gap`` the blanks before the first value."""

    label: tuple[str, ...]
    cells: tuple[Cell, ...]
    gap: str = SOME
    near: int = 0
    whole_word: bool = False

    def pattern(self) -> str:
        between = self.gap + (f".{{0,{self.near}}}?" if self.near else "")
        body = (phrases(*self.label) + between if self.label else "") + row(self.cells)
        return T.pattern(f"%b{body}%e" if self.whole_word else body)

    def columns(self) -> tuple[str, ...]:
        return tuple(c.column for c in self.cells)


def between(*parts: str | Cell) -> str:
    """Phrases and values in turn, as they stand on one line, a group for each value."""
    out = ""
    for k, p in enumerate(parts):
        if isinstance(p, Cell):
            out += (p.gap if k else "") + group(p) + (ANY + T.escape_pattern(p.tail) if p.tail else "")
        else:
            out += (SOME if k else "") + phrase(p)
    return T.pattern(out)
