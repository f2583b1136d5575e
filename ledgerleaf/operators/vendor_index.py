"""Vendors by many rules: which of thousands of markers stand in a text, without looking for each of them.

A text that a marker matches has every literal run of the marker in it.  So
each marker is filed under one short piece of its literals, the piece that the
fewest markers have; a text is cut into its pieces once, these meet the filed
ones in an equi join, and only the few markers found that way are tried with
their full patterns.  The work on a text doesn't depend on the number of
vendors.

Pieces are compared folded: without blanks, accents and case, character by
character, so that whatever a pattern lets a text vary in, its pieces stay.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.functions import text as T
from ledgerleaf.functions.staging import staged
from ledgerleaf.plans import rule_table
from ledgerleaf.plans import shapes as S

#: Characters of a piece; a marker has the longest that fits into one of its literal runs.  Short pieces of long markers
#: are shared by many, each of which is tried on whatever text has the piece.
SIZES = (24, 16, 8, 5, 3, 2, 1)
#: Filed markers (some hundred bytes each) are broadcast up to this number, beyond it the join shuffles.
BROADCAST_ROWS = 200_000
INDEX = "vendor string, priority int, pattern string, size int, piece string"


@lru_cache(maxsize=1)
def folding() -> tuple[str, str]:
    """What ``translate`` folds by: letters to their plain small form, blanks to nothing.

    The form is that which a pattern that ignores case and accents compares by,
    one character at a time: the small letter of the capital, without marks.
    """
    plain, folded = [], []
    for code in range(0x10000):
        c = chr(code)
        if not c.isalpha() and c not in "ªº":
            continue
        small = c.upper().lower() if len(c.upper()) == 1 and len(c.upper().lower()) == 1 else c.lower() if len(c.lower()) == 1 else c
        bare = unicodedata.normalize("NFKD", small)[0]
        small = bare.lower() if bare.isalpha() and len(bare.lower()) == 1 else small
        if small != c:
            plain.append(c)
            folded.append(small)
    blanks = "".join(re.findall(f"[{_python_class(T.BLANK)}]", "".join(map(chr, range(0x10000)))))
    return "".join(plain) + blanks, "".join(folded)


def _python_class(java: str) -> str:
    r"""The class of blanks as Python reads it: there ``\s`` is only Java's six blanks."""
    return java.replace(r"\s", " \\t\\n\\x0b\\f\\r")


def folded(text: Column) -> Column:
    """A text as its pieces are compared."""
    return F.translate(text, *folding())


@lru_cache(maxsize=1)
def _table() -> dict[int, str | None]:
    a, b = folding()
    return {ord(c): b[k] if k < len(b) else None for k, c in enumerate(a)}


def fold(text: str) -> str:
    return text.translate(_table())


#: The parts of a marker's pattern: a class and what repeats it, an edge of a word, an escaped or a plain character.
_PARTS = re.compile(r"(\[(?:\\.|[^\]\\])*\])([*+?]|\{[^}]*\})?|(%[be])|\\x([0-9a-f]{2})|\\([^A-Za-z0-9])|([^\\\[\](){}|.*+?^$])([*+?]|\{[^}]*\})?|([_~])|(.)", re.DOTALL)


def literals(source: str) -> list[str]:
    """The folded literal runs of a marker's pattern, which every match of it has.

    Blanks between them are folded away, so a phrase of several words is one
    run.  A marker with alternatives, groups or references can't be filed.
    """
    runs, run = [], ""
    for cls, repeat, edge, code, escaped, char, times, blanks, other in _PARTS.findall(source):
        if edge or blanks or cls in (f"[{T.BLANK}]",):
            continue
        if other:
            raise ValueError(f"a marker with more than phrases can't be filed: {source}")
        members = {fold(x) for x in cls[1:-1]} if cls and not re.search(r"[\\^-]", cls) else set()
        one = members.pop() if len(members) == 1 else fold(chr(int(code, 16)) if code else escaped or char) if not cls else None
        if one is not None and not (repeat or times):
            run += one
        else:
            runs.append(run)
            run = ""
    return [r for r in [*runs, run] if r]


def _compiled(source: Column) -> Column:
    """``struct<pattern, literals>`` of a marker's pattern."""

    @F.arrow_udf("struct<pattern:string,literals:array<string>>")
    def of(source: pa.Array) -> pa.Array:
        return pa.array([None if s is None else {"pattern": T.pattern(s), "literals": literals(s)} for s in source.to_pylist()], pa.struct([("pattern", pa.string()), ("literals", pa.list_(pa.string()))]))

    return of(source)


def phrase_pattern(phrase: Column) -> Column:
    """A marker's pattern from the phrase that documents print; null for a blank one."""

    @F.arrow_udf("string")
    def of(phrase: pa.Array) -> pa.Array:
        return pa.array([S.phrase(p) if p and p.strip() else None for p in phrase.to_pylist()], pa.string())

    return of(phrase)


def markers_of(table: DataFrame) -> DataFrame:
    """``vendor, priority, marker`` of a rule table's latest rules."""
    rows = rule_table.latest(table).filter("slot = 'marker'")
    return rows.select("vendor", "priority", F.from_json(F.concat(F.lit('{"m":'), F.col("spec"), F.lit("}")), "m string")["m"].alias("marker"))


def _pieces(text: Column, size: int) -> Column:
    """All runs of so many characters of a text, in one pass over it, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def _cut_by(size: int) -> Callable[[Column], Column]:
    return lambda run: _pieces(run, size)


def filed(markers: DataFrame) -> DataFrame:
    """The index of ``markers`` (vendor, priority, marker): each under its rarest piece; see INDEX.

    Null and blank markers are left out, repeated ones filed once, for the
    first of their vendors.  A marker
    without any literal, or with alternatives, is an error.
    """
    rows = markers.select("vendor", F.col("priority").cast("int").alias("priority"), "marker").filter("marker IS NOT NULL AND vendor IS NOT NULL")
    # Where one of several vendors with the same marker fits, all do, and the first is taken.
    rows = rows.groupBy("marker").agg(F.min(F.struct(F.col("priority").isNotNull().alias("has"), "priority", "vendor")).alias("v")).select("v.vendor", "v.priority", "marker")
    # Compiling costs time, not bytes, by which small partitions would be merged into one.
    spark = rows.sparkSession
    rows = rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "marker").withColumn("c", _compiled(F.col("marker")))
    longest = F.array_max(F.transform("c.literals", F.length))
    size = F.coalesce(*[F.when(longest >= n, F.lit(n)) for n in SIZES], F.raise_error(F.concat(F.lit("a marker without a literal: "), F.col("marker"))).cast("int"))
    rows = staged(rows.select(F.monotonically_increasing_id().alias("id"), "vendor", "priority", F.col("c.pattern").alias("pattern"), "c.literals", size.alias("size")), "markers")
    each = None
    for n in SIZES:
        cut = F.array_distinct(F.flatten(F.transform("literals", _cut_by(n))))
        part = rows.filter(F.col("size") == n).select("id", F.explode_outer(cut).alias("piece"))
        each = part if each is None else each.unionByName(part)
    common = each.groupBy("piece").agg(F.count("*").alias("n"))
    # Pieces that very many markers share are joined by a shuffle that may be split.  Numbers stand for markers, so that no pattern is copied for each piece.
    known = each.join(staged(common, "marker-pieces").hint("merge"), "piece")
    rarest = known.groupBy("id").agg(F.min_by("piece", F.struct("n", "piece")).alias("piece"))
    return staged(rows.join(rarest, "id").select("vendor", "priority", "pattern", "size", "piece"), "marker-index")


def candidates(texts: DataFrame, index: DataFrame, key: str, text: str) -> DataFrame:
    """``__key, markers``: of each text the markers of which the filed piece occurs, as an array of (priority, vendor, pattern)."""
    sizes = sorted(r["size"] for r in index.select("size").distinct().collect())
    if not sizes:
        return texts.select(F.col(key).alias("__key"), F.array().cast("array<struct<priority:int,vendor:string,pattern:string>>").alias("markers")).limit(0)
    cut = lambda t: F.concat(*[_pieces(t, n) for n in sizes])
    # Keys and pieces alone are exploded, so that no text is copied.
    pieces = texts.filter(F.col(text).isNotNull()).select(F.col(key).alias("__key"), F.explode(T.bind(folded(F.col(text)), cut)).alias("piece"))
    few = index.count() <= BROADCAST_ROWS
    side = index.select(F.xxhash64("piece").alias("__h"), F.struct("priority", "vendor", "pattern").alias("marker"))
    # Hashes are shuffled instead of pieces: one that two pieces share gives a candidate more, which its pattern refuses.
    hits = pieces.select("__key", F.xxhash64("piece").alias("__h")).join(F.broadcast(side) if few else side.hint("merge"), "__h")
    return hits.groupBy("__key").agg(F.collect_set("marker").alias("markers"))


def detect_vendors(texts: DataFrame, index: DataFrame, key: str = "file", text: str = "text") -> DataFrame:
    """``texts`` with ``vendor``: the first by priority, then by name, of which any marker occurs; null for none.

    ``key`` names each row; rows with a null key or text have no vendor.  Rows
    of one key share what is looked for, and each is tried by its own text.
    """
    found = candidates(texts, index, key, text)
    joined = texts.join(found, F.col(key) == F.col("__key"), "left")
    fits = F.filter("markers", lambda m: F.regexp_like(F.col(text), m["pattern"]))
    best = F.array_min(F.transform(fits, lambda m: F.struct(m["priority"].alias("priority"), m["vendor"].alias("vendor"))))
    return joined.select(*[texts[c] for c in texts.columns], best["vendor"].alias("vendor"))
