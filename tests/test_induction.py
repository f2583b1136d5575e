"""Rules induced from samples with known values."""

import datetime
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerleaf.functions import text as T
from ledgerleaf.operators import fields
from ledgerleaf.plans import induction, rule_table
from ledgerleaf.plans import rules as R

SCHEMA = "file string, text string, number string, date date, subtotal decimal(12,2), tax decimal(12,2), total decimal(12,2)"


def printed(x):
    return f"{x:,.2f}".translate(str.maketrans(",.", ".,"))


def samples(n=60, seed=1, wrong=0):
    """A layout that no vendor of the engine has: noise dates and amounts beside the right ones."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        date = datetime.date(2020, 1, 1) + datetime.timedelta(days=rng.randrange(900))
        sub = rng.randrange(100, 999999) / 100
        tax, due = round(sub * 0.21, 2), date + datetime.timedelta(days=30)
        number = f"EN-{rng.randrange(1000, 9999)}/{k}"
        noise = "".join(f"Línea {rng.choice('abc')} {rng.randrange(1, 9)} uds {printed(rng.randrange(1, 9999) / 100)}\n" for _ in range(rng.randrange(4)))
        text = f"ENERGÍA  BOREAL S.L.\nContrato C-{rng.randrange(999)}-X\nRef. documento {number}\nVence el {due:%d/%m/%Y} Emitida con fecha {date:%d-%m-%Y}\n{noise}Suma sin impuestos {printed(sub)} EUR\nCuota IVA 21%: {printed(tax)}\nA pagar por el cliente {printed(sub + tax)} €\nGracias"
        rows.append((f"s{k}.pdf", text, number, date, sub, tax, round(sub + tax, 2)))
    return [r if k >= wrong else (*r[:2], "XX-1", datetime.date(1999, 1, 1), 1.0, 1.0, 1.0) for k, r in enumerate(rows)]


def frame(spark, rows):
    from decimal import Decimal

    return spark.createDataFrame([(*r[:4], *[None if x is None else Decimal(str(round(x, 2))) for x in r[4:]]) for r in rows], SCHEMA)


def test_rules_of_an_unseen_layout(spark):
    got = induction.propose(frame(spark, samples()), "Energía Boreal", ["ENERGÍA BOREAL"])
    by = {r["slot"]: r for r in got.report}
    assert set(by) == set(induction.SLOTS)
    assert by["number"]["label"].endswith("documento") and by["date"]["label"].endswith("fecha")
    assert all(r["checked"] == 1.0 and r["precision"] == 1.0 for r in got.report)
    unseen = frame(spark, samples(40, seed=7))
    found = induction.found_values(unseen, got.vendor).collect()
    assert all((r.found_number, r.found_date, r.found_subtotal, r.found_tax, r.found_total) == (r.number, r.date, r.subtotal, r.tax, r.total) for r in found)


def test_stored_and_read_back(spark):
    table = induction.learned(rule_table.as_table(spark), frame(spark, samples()), "Energía Boreal", ["ENERGÍA BOREAL"])
    vendors = rule_table.vendors_of(table)
    assert vendors[-1].name == "energaboreal"
    r = frame(spark, samples(5, seed=3)).select("number", "total", fields.extract_fields(F.col("text"), fields.detect_vendor(F.col("text"), vendors)).alias("f")).collect()
    own = frame(spark, samples(5, seed=3)).select("number", "total", fields.vendor_fields(F.col("text"), fields.detect_vendor(F.col("text"), vendors), vendors).alias("f")).collect()
    assert len(r) == 5 and all(x.f.invoice_number == x.number and x.f.totals.total == x.total for x in own)
    with pytest.raises(ValueError, match="exists"):
        induction.learned(table, frame(spark, samples()), "Energía Boreal", ["ENERGÍA BOREAL"])


def test_counts_are_those_of_a_loop(spark):
    rows = samples(12)
    counts = {(r.slot, r.label, r.skipped): (r.support, r.seen, r.known) for r in induction.counted_anchors(frame(spark, rows)).collect()}
    assert counts["number", "documento", 0] == (12, 12, 12) and counts["total", "cliente", 0] == (12, 12, 12)
    # "el" stands before the due date first.
    assert counts["date", "el", 0][0] == 0 and counts["date", "vence", 1][0] == 0
    assert counts["total", "el cliente", 0] == (12, 12, 12)


def test_wrong_samples_are_refused(spark):
    rows = samples()
    with pytest.raises(ValueError, match="exists"):
        induction.propose(frame(spark, rows), "Miller", ["ENERGÍA BOREAL"])
    with pytest.raises(ValueError, match="known vendor"):
        induction.propose(frame(spark, [(*rows[0][:1], rows[0][1] + "\nMERCADONA S.A.", *rows[0][2:]), *rows[1:]]), "Energía Boreal", ["ENERGÍA BOREAL"])
    with pytest.raises(ValueError, match="marker"):
        induction.propose(frame(spark, rows), "Other", ["OTHER NAME"])
    with pytest.raises(ValueError, match="no samples"):
        induction.propose(frame(spark, rows).limit(0), "Other", ["OTHER NAME"])
    with pytest.raises(ValueError, match="no label"):
        induction.propose(frame(spark, samples(wrong=60)), "Energía Boreal", ["ENERGÍA BOREAL"])
    # Right where the rules are made, wrong where they are checked.
    kept = {r.file for r in frame(spark, rows).filter(F.pmod(F.xxhash64("file"), F.lit(induction.CHECKED_BY)) == 0).collect()}
    mixed = [(*r[:2], "XX-1", *r[3:]) if r[0] in kept else r for r in rows]
    with pytest.raises(ValueError, match="number is wrong"):
        induction.propose(frame(spark, mixed), "Energía Boreal", ["ENERGÍA BOREAL"])
    # Slots that samples don't know have no rule.
    some = induction.propose(frame(spark, [(*r[:2], None, r[3], None, None, r[6]) for r in rows]), "Energía Boreal", ["ENERGÍA BOREAL"])
    assert {r["slot"] for r in some.report} == {"date", "total"} and some.vendor.fields.number is None


def test_labels_that_can_not_be_frequent_are_left_out(spark):
    """The anchors with enough support are counted as without the bound; the others are neither kept nor shuffled."""
    rows = frame(spark, samples(40))
    of = lambda df: {tuple(r) for r in df.filter("support >= 0.5 * known").select("slot", "label", "skipped", "words", "support", "seen", "known").collect()}
    every, some = induction.counted_anchors(rows), induction.counted_anchors(rows, least_support=0.5)
    assert of(some) == of(every) and len(of(every)) > 10
    assert some.count() < every.count() / 2


def test_samples_of_one_layout_are_counted_as_one(spark):
    """A task hands on a few rows for all of its samples, though each has a word of its own before a value."""
    texts = [f"ENERGÍA BOREAL\nRef. X{k}Y{k} del documento EN-{k:04}\nEmitida con fecha 02-01-2020\nA pagar {k},50 EUR\n" for k in range(300)]
    rows = spark.createDataFrame([(f"s{k}", t, f"EN-{k:04}", datetime.date(2020, 1, 2), None, None, k + 0.5) for k, t in enumerate(texts)], SCHEMA.replace("decimal(12,2)", "double"))
    known = induction._known(rows, "file", "text")
    taken = known.select(*induction._samples(known)).toArrow().to_batches()
    wanted = induction._frequent(known.select(*induction._samples(known)), {s: 300 for s in induction.SLOTS}, 0.5)
    assert ("documento", 0) in wanted["number"] and ("fecha", 0) in wanted["date"] and ("a pagar", 0) in wanted["amount"]
    schema = pa.schema([("kind", pa.string()), ("slots", pa.int32()), ("told", pa.list_(pa.struct([("tail", pa.string()), ("hits", pa.int32())]))), ("n", pa.int64())])
    out = [r for b in induction._summed(induction._shapes(wanted), schema)(taken) for r in b.to_pylist()]
    assert len(out) <= 6 and {kind: sum(r["n"] for r in out if r["kind"] == kind) for kind in induction.KINDS} == dict.fromkeys(induction.KINDS, 300)


def test_values_are_taken_and_read_as_by_the_engine(spark):
    """The tasks' patterns, amounts and dates are those of the engine's own expressions, over texts of signs that matter."""
    rng = random.Random(5)
    some = lambda signs, n: "".join(rng.choice(signs) for _ in range(n))
    texts = [some("0123456789" * 3 + "/-.,, \nAzıſİK_é", rng.randrange(60)) for _ in range(1500)] + [f"x{some('.,-/ 1', 1)}0{rng.randrange(10)}/12/199{rng.randrange(10)}{some('0/ ,', 1)}" for _ in range(200)]
    java = {"number": rf"%b(?=[A-Z/\-.]*[0-9]){R.ANY_NUMBER.source()}", "date": f"(?<![0-9])(?:{R.ANY_DATE.source()})(?![0-9])", "amount": "%b(?<![.,])[0-9][0-9.,]*"}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *[F.regexp_extract_all("t", F.lit(T.pattern(p)), F.lit(0)).alias(k) for k, p in java.items()]).collect()
    for r in got:
        assert {k: induction.PRINTED[k].split(r.t)[1::2] for k in java} == {k: r[k] for k in java}
    amounts = sorted({v for r in got for v in r["amount"]} | {"0,995", "0,994", "9999999999,99", "9999999999,995", "0" * 20 + "1,2", "1.", "1,2,3", "1.234,5"})
    for r in spark.createDataFrame([(v,) for v in amounts], "v string").select("v", (T.spanish_amount(F.col("v")) * 100).cast("long").alias("c")).collect():
        assert induction._cents(r.v) == r.c, r.v
    dates = sorted({v for r in got for v in r["date"]})
    assert len(dates) > 50
    for r in spark.createDataFrame([(v,) for v in dates], "v string").select("v", F.date_format(T.vendor_date(F.col("v")), "yyyy-MM-dd").alias("d")).collect():
        assert r.d is None or induction._day(r.v) == r.d
    assert all(induction._single_spaced(x + "a" + x + x + "b") == " a b" for x in T.BLANK_CHARS)
