"""Vendor rules from samples whose values are known: which labels stand before them, counted, chosen and checked.

Every printed value of a sample that has the shape of a number, a date or an
amount gives anchors: the words before it, some of them skipped.  A rule takes
what follows the first place of its label, so of each sample and anchor only
the first value counts; one aggregation over the samples tells how often that
is the known value (support) and how often not (precision).  A first one over
the known values alone tells which labels can have enough support at all.  Tasks
find the values and count samples by what stands before these; anchors are made
of the counts.  The best anchor of
each slot becomes a rule, which is compiled and tried on samples that it was
not chosen by; only then it may be appended to a rule table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from operator import add, or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.functions import text as T
from ledgerleaf.functions.staging import staged
from ledgerleaf.operators import fields
from ledgerleaf.plans import rule_table, templates
from ledgerleaf.plans import rules as R
from ledgerleaf.plans import shapes as S

#: Slots by the kind of their values.
SLOTS = {"number": "number", "date": "date", "subtotal": "amount", "tax": "amount", "total": "amount"}
KINDS = tuple(dict.fromkeys(SLOTS.values()))
#: Words of a label, words between it and a value, and characters that these may have.
LABEL_WORDS, SKIPPED_WORDS, SKIPPED_CHARS = 4, 2, 40
#: Share of the samples with a known value that a rule must find, and of what it finds that must be right.
LEAST_SUPPORT, LEAST_PRECISION = 0.5, 0.95
#: Labels that are looked for by name; with more of them all anchors are counted.
MOST_LABELS = 5_000
#: One sample of so many is kept to check the rules by.
CHECKED_BY = 3
#: What a pattern of either case takes for A to Z, and what it takes for a part of a word.
_LETTERS = "A-Za-z\u0131\u017f"
_WORD = "0-9A-Za-z_\u0130\u0131\u017f\u212a"
#: Values as they are printed; a number has a digit, an amount begins with one.  What stands before a first digit is looked at after it, as most characters are no digits.
PRINTED = {
    "number": re.compile(rf"((?<![{_WORD}])(?=[{_LETTERS}/\-.]*[0-9])[{_LETTERS}0-9][{_LETTERS}0-9/\-.]{{2,}})"),
    "date": re.compile(rf"([0-9](?<![0-9].)(?:{'|'.join(x.removeprefix('[0-9]') for x in R.ANY_DATE.source().split('|'))})(?![0-9]))"),
    "amount": re.compile(rf"([0-9](?<![{_WORD}.,].)[0-9.,]*)"),
}
_BLANK_RUN = re.compile(f"[{T.BLANK_CHARS}]+")
#: What a task counts in memory before it hands it on.
MOST_COUNTED = 20_000
TOLD = "array<struct<tail:string,hits:int>>"


@dataclass(frozen=True)
class Proposal:
    """A vendor's rules and, by slot, what was counted: label, support, precision, and precision on the checked samples."""

    vendor: R.Vendor
    report: tuple[dict, ...]


def _known(samples: DataFrame, file: str, text: str) -> DataFrame:
    """``file, text`` and the known values by slot; slots that the samples don't have are null."""
    has = samples.columns
    kinds = {"number": "string", "date": "date"} | dict.fromkeys(fields.TOTALS, fields.MONEY)
    return samples.select(F.col(file).cast("string").alias("file"), F.coalesce(F.col(text), F.lit("")).alias("text"), *[(F.col(k) if k in has else F.lit(None)).cast(kind).alias(k) for k, kind in kinds.items()])


def _anchors(before: Column, kind: str) -> Column:
    """The labels that may be meant before a value: (label, words skipped), in small letters."""
    words = F.filter(F.split(F.lower(before), f"[{T.BLANK}]+"), lambda w: w != "")

    def of(words: Column) -> Column:
        n = F.size(words)
        # Between a label and a number nothing may stand: any word might be read as one.
        skips = (0,) if kind == "number" else range(SKIPPED_WORDS + 1)
        cut = lambda k, j: F.when(n >= k + j, F.struct(F.array_join(F.slice(words, n - (k + j) + 1, F.lit(k)), " ").alias("label"), F.lit(j).alias("skipped"), F.lit(k).alias("words")))
        return F.array_compact(F.array(*[cut(k, j) for k in range(1, LABEL_WORDS + 1) for j in skips]))

    # Words farther away are in no label; this keeps what is split small.
    return T.bind(F.slice(words, F.greatest(F.size(words) - LABEL_WORDS - SKIPPED_WORDS + 1, F.lit(1)), F.lit(LABEL_WORDS + SKIPPED_WORDS)), of)


def _slots(kind: str) -> list[str]:
    return [s for s, k in SLOTS.items() if k == kind]


def _bit(slot: str) -> int:
    return 1 << list(SLOTS).index(slot)


def _samples(known: DataFrame) -> list[Column]:
    """``text``, ``slots`` (a bit for each slot with a known value) and the known values as tasks compare them: numbers, dates as yyyy-mm-dd, amounts in cents."""
    slots = reduce(add, [F.when(F.col(s).isNotNull(), F.lit(_bit(s))).otherwise(F.lit(0)) for s in SLOTS])
    day = F.when(F.col("date") >= F.lit("0001-01-01").cast("date"), F.date_format("date", "yyyy-MM-dd"))
    return [F.col("text"), slots.alias("slots"), F.col("number"), day.alias("date"), *[(F.col(s) * 100).cast("long").alias(s) for s in fields.TOTALS]]


def _day(value: str) -> str:
    """A printed date as yyyy-mm-dd, as vendor_date() reads it; another form is as it is."""
    return f"{value[6:]}-{value[3:5]}-{value[:2]}" if value[2] in "/-" else value


def _cents(value: str) -> int | None:
    """A printed amount in cents, half a cent up, as spanish_amount() reads it."""
    if "," in value:
        value = (value.replace(".", "") if "." in value else value).replace(",", ".")
    whole, _, rest = value.partition(".")
    if "." in rest or len(whole) > 10 and len(whole.lstrip("0")) > 10:
        return None
    cents = int(whole[-10:]) * 100 + int((rest + "00")[:2]) + (rest[2:3] >= "5")
    return cents if cents < 10**12 else None


def _single_spaced(text: str) -> str:
    """One space for each run of blanks; of blanks only spaces are printable, and most texts have nothing but single spaces and line feeds."""
    plain = text.replace("\n", " ")
    return plain if plain.isprintable() and "  " not in plain else _BLANK_RUN.sub(" ", text)


def _tail(before: str, most: int) -> str:
    """The last words of what stands before a value; words farther away are in no label."""
    before = before.strip(" ")
    return " ".join(before.rsplit(" ", most)[1:]) if before.count(" ") >= most else before


def _words(kind: str) -> int:
    return LABEL_WORDS if kind == "number" else LABEL_WORDS + SKIPPED_WORDS


def _kept_for(made: Callable[[str], object]) -> Callable[[str], object]:
    """``made`` with what it gave for texts that it saw before, as many as fit."""
    seen: dict[str, object] = {}

    def of(text: str) -> object:
        if text in seen:
            return seen[text]
        if len(seen) >= MOST_COUNTED:
            seen.clear()
        if len(text) > 200:
            return made(text)
        return seen.setdefault(text, made(text))

    return of


def _known_values(row: dict, kind: str) -> dict:
    """The bits of a sample's slots of a kind by their value."""
    out = {}
    for s in _slots(kind):
        if row[s] is not None:
            out[row[s]] = out.get(row[s], 0) | _bit(s)
    return out


def _summed(each: Callable[[], Callable[[dict], Iterable]], schema: pa.Schema) -> Callable:
    """A task that counts what ``each()`` gives for its rows, and hands on ``(*columns, n)``; it holds a bounded number of counts."""

    def rows_of(counts: Counter) -> pa.RecordBatch:
        columns = list(zip(*counts, strict=True))
        return pa.RecordBatch.from_arrays([*[pa.array(c, f.type) for c, f in zip(columns, schema, strict=False)], pa.array(counts.values(), pa.int64())], schema=schema)

    def run(batches):
        counts: Counter = Counter()
        of = each()
        for batch in batches:
            names = batch.schema.names
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for found in of(dict(zip(names, row, strict=True))):
                    counts[found] += 1
                if len(counts) >= MOST_COUNTED:
                    yield rows_of(counts)
                    counts = Counter()
        if counts:
            yield rows_of(counts)

    return run


def _readers() -> dict[str, Callable[[str], object]]:
    return {"number": str, "date": _day, "amount": _kept_for(_cents)}


def _hit_tails() -> Callable[[dict], Iterable[tuple]]:
    """For a sample ``tail, hits`` of its known values, wherever they are printed."""
    read = _readers()

    def each(row: dict) -> Iterable[tuple]:
        text = _single_spaced(row["text"])
        for kind in KINDS:
            known = _known_values(row, kind)
            if known:
                # Every second piece is a value, behind what stands before it.
                pieces = PRINTED[kind].split(text)
                for k, value in enumerate(map(read[kind], pieces[1::2])):
                    if value in known:
                        yield _tail(pieces[2 * k], _words(kind)), known[value]

    return each


def _shapes(wanted: dict[str, set[tuple[str, int]] | None]) -> Callable[[], Callable[[dict], Iterable[tuple]]]:
    """For a sample ``kind, slots, told``: the tails before its printed values, and a bit for each slot of which that is the known value.

    Tails that have no part in a wanted anchor are left out, other words in
    tails are made one, and of equal tails only the first counts, so that
    samples of one layout are the same.
    """

    def start() -> Callable[[dict], Iterable[tuple]]:
        read, made = _readers(), {kind: _kept_for(_plain_tails(wanted[kind], _words(kind))) for kind in KINDS}

        def each(row: dict) -> Iterable[tuple]:
            text = _single_spaced(row["text"])
            for kind in KINDS:
                known = _known_values(row, kind)
                if known:
                    pieces, told = PRINTED[kind].split(text), {}
                    for k, tail in enumerate(map(made[kind], pieces[:-1:2])):
                        if tail and tail not in told:
                            told[tail] = known.get(read[kind](pieces[2 * k + 1]), 0)
                    yield kind, row["slots"], tuple(told.items())

        return each

    return start


def _plain_tails(anchors: set[tuple[str, int]] | None, most: int) -> Callable[[str], str | None]:
    """The tail of what stands before a value, as the wanted anchors see it (null: all anchors); null if none can be there."""
    if anchors is None:
        return lambda before: _tail(before, most)
    words = {w for label, _ in anchors for w in label.split(" ")}
    # In the place of all other words is one that none of them is.
    other = "?" * (1 + max(map(len, words), default=0))
    ends = [{label.split(" ")[-1] for label, skipped in anchors if skipped == j} for j in range(SKIPPED_WORDS + 1)]

    def plain(before: str) -> str | None:
        said = _tail(before, most).lower().split(" ")
        may = any(w in found for w, found in zip(reversed(said), ends, strict=False))
        return " ".join(w if w in words else other for w in said) if may else None

    return plain


def _sizes(counts: list) -> dict[str, int]:
    """How many samples have a known value, by slot, from counts by ``slots``."""
    return {s: sum(r["n"] for r in counts if r["slots"] & _bit(s)) for s in SLOTS}


def _has(bits: Column, slot: str) -> Column:
    return bits.bitwiseAND(F.lit(_bit(slot))) != 0


def _frequent(rows: DataFrame, sizes: dict[str, int], least_support: float) -> dict[str, set[tuple[str, int]] | None]:
    """By kind the anchors (label, words skipped) that may have the support: they stand before that many known values, first or not; null if there are too many to name."""
    # Each tail is counted before labels are made of it.
    schema = pa.schema([("tail", pa.string()), ("hits", pa.int32()), ("n", pa.int64())])
    tails = rows.mapInArrow(_summed(_hit_tails, schema), "tail string, hits int, n long").groupBy("tail", "hits").agg(F.sum("n").alias("n"))
    out = {}
    slot = F.explode(F.array_compact(F.array(*[F.when(_has(F.col("hits"), s), F.lit(s)) for s in SLOTS]))).alias("slot")
    anchors = reduce(lambda w, kind: w.when(F.col("slot").isin(_slots(kind)), _anchors(F.col("tail"), kind)), KINDS, F)
    counts = tails.select("tail", "n", slot).select("slot", "n", F.explode(anchors).alias("a")).groupBy("slot", "a.label", "a.skipped").agg(F.sum("n").alias("most"))
    enough = reduce(or_, [(F.col("slot") == s) & (F.col("most") >= least_support * sizes[s]) for s in SLOTS])
    kind_of = reduce(lambda w, kind: w.when(F.col("slot").isin(_slots(kind)), F.lit(kind)), KINDS, F)
    fit = counts.filter(enough).select(kind_of.alias("kind"), "label", "skipped").distinct()
    numbered = fit.withColumn("nr", F.row_number().over(Window.partitionBy("kind").orderBy("label", "skipped"))).filter(F.col("nr") <= MOST_LABELS + 1)
    named = numbered.collect()
    for kind in KINDS:
        found = {(r["label"], r["skipped"]) for r in named if r["kind"] == kind}
        out[kind] = found if len(found) <= MOST_LABELS else None
    return out


def _first_anchors(told: Column, kind: str, wanted: set[tuple[str, int]] | None) -> Column:
    """``array<struct<label, skipped, at, words, hits>>``: each anchor of a sample with the first value behind it."""
    # A label has no blank at its end, so no two anchors are written alike.
    key, keys = lambda a: F.concat_ws(" ", a["label"], a["skipped"].cast("string")), [] if wanted is None else sorted(f"{label} {skipped}" for label, skipped in wanted)
    found = lambda x: _anchors(x["tail"], kind)
    some = found if wanted is None else lambda x: F.filter(found(x), lambda a: key(a).isin(keys))
    placed = F.flatten(F.transform(told, lambda x, at: F.transform(some(x), lambda a: F.struct(a["label"].alias("label"), a["skipped"].alias("skipped"), at.alias("at"), a["words"].alias("words"), x["hits"].alias("hits")))))
    new = lambda anchors: F.filter(anchors, lambda a, k: (k == 0) | ~T.bind(F.get(anchors, k - 1), lambda b: (a["label"] == b["label"]) & (a["skipped"] == b["skipped"])))
    return T.bind(F.sort_array(placed), new)


def _counted(rows: DataFrame, sizes: dict[str, int], least_support: float) -> DataFrame:
    """counted_anchors() of ``_samples()``, which are read twice if there is a bound."""
    wanted = _frequent(rows, sizes, least_support) if least_support > 0 else dict.fromkeys(KINDS)
    schema = pa.schema([("kind", pa.string()), ("slots", pa.int32()), ("told", pa.list_(pa.struct([("tail", pa.string()), ("hits", pa.int32())]))), ("n", pa.int64())])
    # Texts of a layout are counted as one, before their anchors are made.
    one = rows.mapInArrow(_summed(_shapes(wanted), schema), f"kind string, slots int, told {TOLD}, n long").groupBy("kind", "slots", "told").agg(F.sum("n").alias("n"))
    anchors = reduce(lambda w, kind: w.when(F.col("kind") == kind, _first_anchors(F.col("told"), kind, wanted[kind])), KINDS, F)
    # The outer form keeps the anchors from being made again in a filter below it.
    met = one.select("kind", "slots", "n", F.explode_outer(anchors).alias("a")).filter("a IS NOT NULL")
    slot = F.explode(F.array_compact(F.array(*[F.when(F.col("kind").eqNullSafe(SLOTS[s]) & _has(F.col("slots"), s), F.struct(F.lit(s).alias("slot"), _has(F.col("a.hits"), s).alias("hit"))) for s in SLOTS]))).alias("h")
    counts = met.select("a.label", "a.skipped", "a.words", "n", slot).groupBy(F.col("h.slot").alias("slot"), "label", "skipped", "words").agg(F.sum(F.when(F.col("h.hit"), F.col("n")).otherwise(F.lit(0).cast("long"))).alias("support"), F.sum("n").alias("seen"))
    size = reduce(lambda w, s: w.when(F.col("slot") == s, F.lit(sizes[s]).cast("long")), SLOTS, F)
    return counts.withColumn("known", size)


def counted_anchors(samples: DataFrame, file: str = "file", text: str = "text", least_support: float = 0.0) -> DataFrame:
    """``slot, label, skipped, words, support, seen, known`` of the anchors of the samples' values.

    ``support`` samples have the known value behind the label, ``seen`` have the
    label before any value, ``known`` have a known value at all.  A row is a
    sample.  With ``least_support``, anchors that can't have that share of the
    known values as support may be left out, so that labels with a sample's own
    words are neither kept nor shuffled.
    """
    known = _known(samples, file, text)
    rows = known.select(*_samples(known))
    return _counted(rows, _sizes(rows.groupBy("slots").agg(F.count("*").alias("n")).collect()), least_support)


def best_anchors(counts: DataFrame, least_support: float = LEAST_SUPPORT, least_precision: float = LEAST_PRECISION) -> DataFrame:
    """One anchor a slot: of those precise and frequent enough the one with most support, then the most precise, the nearest, the longest."""
    fit = counts.filter((F.col("support") >= least_support * F.col("known")) & (F.col("support") >= least_precision * F.col("seen")) & (F.col("support") > 0))
    order = Window.partitionBy("slot").orderBy(F.desc("support"), "seen", "skipped", F.desc("words"), "label")
    return fit.withColumn("nr", F.row_number().over(order)).filter("nr = 1").drop("nr")


def _labelled(label: str, skipped: int, slot: str) -> S.Labelled:
    cell = {"number": R.ANY_NUMBER, "date": R.ANY_DATE, "amount": S.Cell("amount")}[SLOTS[slot]]
    return S.Labelled((label,), (cell,), gap=S.ANY, near=SKIPPED_CHARS if skipped else 0)


def found_values(texts: DataFrame, vendor: R.Vendor, text: str = "text") -> DataFrame:
    """``texts`` with what a vendor's rules find: ``found_number, found_date, found_subtotal, found_tax, found_total``."""
    f = texts.withColumn("__f", fields.vendor_fields(F.coalesce(F.col(text), F.lit("")), F.lit(vendor.name), (vendor,)))
    where = {"number": "invoice_number", "date": "invoice_date"} | {k: f"totals.{k}" for k in fields.TOTALS}
    return f.select(*texts.columns, *[F.col(f"__f.{w}").alias(f"found_{k}") for k, w in where.items()])


def propose(samples: DataFrame, name: str, markers: list[str], known: tuple[R.Vendor, ...] = R.VENDORS, file: str = "file", text: str = "text", least_support: float = LEAST_SUPPORT, least_precision: float = LEAST_PRECISION) -> Proposal:
    """A vendor's rules, induced from ``samples`` with known values (any of number, date, subtotal, tax, total).

    A third of the samples, by the hash of their file names, is kept for the
    check.  Refused (ValueError) are names that are taken, samples that a known
    vendor claims or that lack the markers, samples from which no rule comes,
    and rules that are wrong too often on the samples kept.
    """
    slug = templates.vendor_slug(name)
    if slug in {v.name for v in known}:
        raise ValueError(f"vendor exists: {slug}")
    own = templates.vendor_from_labels(name, markers, {"total": "Total"})
    known_values = _known(samples, file, text)
    kept = F.pmod(F.xxhash64("file"), F.lit(CHECKED_BY)) == 0
    found = T.bind(F.col("text"), lambda t: fields.detect_vendors(t, claimed=known, own=(own,)))
    rows = staged(known_values.select(found.alias("by"), kept.alias("kept"), *_samples(known_values)), "samples")
    sizes = rows.groupBy("kept", "slots").agg(F.max("by.claimed").alias("claimed"), F.count_if(F.col("by.own").isNull()).alias("lacking"), F.count("*").alias("n")).collect()
    claimed = max((r["claimed"] for r in sizes if r["claimed"]), default=None)
    if claimed:
        raise ValueError(f"a sample belongs to a known vendor: {claimed}")
    if not sizes or any(r["lacking"] for r in sizes):
        raise ValueError("samples without a marker of the vendor" if sizes else "no samples")
    learned_from = _sizes([r for r in sizes if not r["kept"]])
    best = {r["slot"]: r.asDict() for r in best_anchors(_counted(rows.filter("NOT kept").drop("by", "kept"), learned_from, least_support), least_support, least_precision).collect()}
    if not best:
        raise ValueError("no label stands before the known values")
    made = {slot: _labelled(r["label"], r["skipped"], slot) for slot, r in best.items()}
    vendor = R.Vendor(own.name, own.markers, R.FieldRules(made.get("number"), made.get("date"), each={k: made[k] for k in fields.TOTALS if k in made}))
    tried = found_values(rows.filter("kept"), vendor)
    # Known values are staged as tasks compare them.
    known_value = {"number": F.col("number"), "date": F.col("date").cast("date")} | {s: (F.col(s).cast("decimal(12,0)") / 100).cast(fields.MONEY) for s in fields.TOTALS}
    right = {s: F.col(f"found_{s}").eqNullSafe(known_value[s]) for s in best}
    counts = tried.agg(*[F.count_if(F.col(s).isNotNull() & F.col(f"found_{s}").isNotNull()).alias(f"seen_{s}") for s in best], *[F.count_if(F.col(s).isNotNull() & right[s]).alias(f"right_{s}") for s in best]).first()
    report = []
    for slot, r in sorted(best.items()):
        seen, good = counts[f"seen_{slot}"], counts[f"right_{slot}"]
        if not seen or good < least_precision * seen:
            raise ValueError(f"the rule of {slot} is wrong on samples that it was not made from: {good} of {seen} after '{r['label']}'")
        report.append({"slot": slot, "label": r["label"], "skipped": r["skipped"], "support": r["support"], "precision": r["support"] / r["seen"], "checked": good / seen})
    return Proposal(vendor, tuple(report))


def learned(table: DataFrame, samples: DataFrame, name: str, markers: list[str], **how) -> DataFrame:
    """A rule table with the rules that propose() finds appended; those of the table are the known ones."""
    return rule_table.with_vendor(table, propose(samples, name, markers, rule_table.vendors_of(table), **how).vendor)
