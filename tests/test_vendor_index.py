"""Vendors by many rules."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerleaf.operators import fields, vendor_index
from ledgerleaf.plans import rule_table
from ledgerleaf.plans import rules as R
from ledgerleaf.plans import shapes as S


def test_the_engine_s_own_vendors(spark):
    """The same vendor as the compiled rules give, on each marker in several spellings and on near misses."""
    said = ["MERCADONA S.A.", "mercadona \t s.a.", "MERCADONAS.A.", "Lencar Canarias", "pol.in.miller", "POL.IN. \n Miller", "POLxIN. MILLER", "xEMPARK aparcamientosx", "PARQUE DARSENA", "parque dársena", "ACASTIMAR,S.L.", "FACTURA VENTA", "FACTURA VENTAS", "doctoragua.es", "doctoraguaXes", "Doctor Agua", "b52537339", "nothing", "", None, "EMPARK APARCAMIENTOS MERCADONA S.A."]
    texts = spark.createDataFrame([(str(k), t) for k, t in enumerate(said)] + [(None, "MERCADONA S.A.")], "file string, text string")
    index = vendor_index.filed(vendor_index.markers_of(rule_table.as_table(spark)))
    got = {r.file: r.vendor for r in vendor_index.detect_vendors(texts, index).collect()}
    want = {r.file: r.v for r in texts.select("file", fields.detect_vendor(F.col("text")).alias("v")).collect()}
    assert got == want | {None: None}
    assert {want[str(k)] for k in range(len(said))} == {v.name for v in R.VENDORS} | {None}


def brute(texts, phrases):
    out = {}
    for key, t in texts:
        best = min(((p, v) for v, p, m in phrases if m.strip() and " ".join(vendor_index.fold(w) for w in m.split()) in " ".join(vendor_index.fold(w) for w in t.split())), default=None)
        out[key] = best and best[1]
    return out


def test_many_phrases_against_a_nested_loop(spark):
    rng = random.Random(6)
    words = ["agua", "Luz", "GAS", "del", "Sur", "Núñez", "& Cía.", "S.L.", "no_1", "100%", "~x", "a", "Ω"]
    phrases = [(f"v{k}", rng.randrange(9), " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4)))) for k in range(300)] + [("blank", 0, "  "), ("v1", 0, "Luz")]
    texts = []
    for k in range(200):
        t = " ".join(rng.choice([*words, "x", "y", "factura", "núñez", "SUR", "luzagua"]) for _ in range(rng.randrange(1, 12)))
        texts.append((k, rng.choice([t, t.upper(), t.lower()])))
    rows = spark.createDataFrame(phrases, "vendor string, priority int, phrase string")
    index = vendor_index.filed(rows.select("vendor", "priority", vendor_index.phrase_pattern(F.col("phrase")).alias("marker")))
    assert index.filter("vendor = 'blank'").count() == 0
    # Rare pieces first: no marker is under a piece that more markers have than another of its own.
    got = vendor_index.detect_vendors(spark.createDataFrame(texts, "file long, text string"), index)
    assert {r.file: r.vendor for r in got.collect()} == brute(texts, phrases)
    none = vendor_index.filed(rows.limit(0).select("vendor", "priority", F.col("phrase").alias("marker")))
    assert {r.vendor for r in vendor_index.detect_vendors(spark.createDataFrame(texts[:3], "file long, text string"), none).collect()} == {None}


def test_the_plan_has_no_nested_loop(spark, capsys):
    texts = spark.createDataFrame([("a", "Agua del Sur"), ("b", "x")], "file string, text string")
    index = vendor_index.filed(spark.createDataFrame([("sur", 1, S.phrase("Agua del Sur"))], "vendor string, priority int, marker string"))
    for most in (vendor_index.BROADCAST_ROWS, 0):
        vendor_index.BROADCAST_ROWS, kept = most, vendor_index.BROADCAST_ROWS
        try:
            df = vendor_index.detect_vendors(texts, index)
            df.explain("formatted")
            assert not any(x in capsys.readouterr().out for x in ("NestedLoop", "Cartesian"))
            assert {r.file: r.vendor for r in df.collect()} == {"a": "sur", "b": None}
        finally:
            vendor_index.BROADCAST_ROWS = kept


def test_literals_of_patterns():
    assert vendor_index.literals(S.phrase("LENCAR  CANARIAS")) == ["lencarcanarias"]
    assert vendor_index.literals(S.phrases("POL.IN.", "MILLER") + "%e") == ["pol.in.miller"]
    assert vendor_index.literals(S.phrase("Nº Núñez_1 ~ 5%")) == ["nonunez_1~5%"]
    assert vendor_index.literals("ab[0-9]+cd?e") == ["ab", "c", "e"]
    with pytest.raises(ValueError):
        vendor_index.literals("(a|b)c")
    assert vendor_index.fold("ſK İ ß ς Σ ª É") == vendor_index.fold("sk İ ß σ σ a e")


def test_long_markers_have_few_candidates(spark):
    """Markers that share most of their pieces, and equal markers of several vendors."""
    rows = [(f"v{k} {b}", k, f"Supplier#{k:09d} Sucursal Núm. {b}") for k in range(20) for b in range(1, 51)] + [("other", -1, "Supplier#000000003  sucursal núm. 7"), ("later", 9, "Supplier#000000004 Sucursal Núm. 7")]
    index = vendor_index.filed(spark.createDataFrame(rows, "vendor string, priority int, phrase string").select("vendor", "priority", vendor_index.phrase_pattern(F.col("phrase")).alias("marker")))
    assert index.filter("vendor = 'later'").count() == 0
    texts = spark.createDataFrame([(k, f"x SUPPLIER#{k:09d}\nSucursal num. 7 y") for k in range(2, 6)], "file long, text string")
    assert all(len(r.markers) <= 2 for r in vendor_index.candidates(texts, index, "file", "text").collect())
    assert {r.file: r.vendor for r in vendor_index.detect_vendors(texts, index).collect()} == {2: "v2 7", 3: "other", 4: "v4 7", 5: "v5 7"}
