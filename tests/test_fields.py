"""Generic and vendor fields: accept and reject tables, merging, filling."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerleaf.operators import fields
from ledgerleaf.plans import rules as R
from ledgerleaf.plans import templates


def run(spark, texts, col):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    return [r.out for r in df.select("k", col(F.col("text")).alias("out")).orderBy("k").collect()]


DATES = [
    ("Fecha Factura: 15/06/2026", dt.date(2026, 6, 15)),
    ("FECHA FACTURACIÓN - 1.2.2026", dt.date(2026, 2, 1)),
    ("fecha de factura\n3/4/2026", dt.date(2026, 4, 3)),
    ("Fecha Factura:\r\n15/06/2026\r\n", dt.date(2026, 6, 15)),
    ("Fecha Factura: 30/02/2026\nFecha factura 1/3/2026", dt.date(2026, 3, 1)),
    ("Fecha Factura: 30/02/2026", None),
    ("Fecha Factura: 32/13/2026", None),
    ("Fecha Factura: 27/07/26", None),
    ("Fecha Factura: 2026-06-15", None),
    ("Fecha factura simplificada: 15/06/2026", None),
    ("XFecha Factura: 15/06/2026", None),
    ("Fecha Factura:\n\n15/06/2026", None),
    ("Fecha Factura:", None),
    ("", None),
    (None, None),
]

AMOUNTS = [
    ("Total: 1.234,56 EUR", "1234.56"),
    ("Importe total 12,00 €", "12.00"),
    ("TOTAL (EUR): 87.42", "87.42"),
    ("Total 12,00 pagado", "12.00"),
    ("Total:\nTotal: 5,00", "5.00"),
    ("Total: 1.000.000,00", "1000000.00"),
    ("Total: 12.34.56", None),
    ("Total: 12,3,4", None),
    ("Total: -12,00", None),
    ("Total: 0", None),
    ("Total: 0,00", None),
    ("Total: 1.000.000,01", None),
    ("Total: 12,00.", None),
    ("Total: 12,00EUR", None),
    ("Total: about 12,00", None),
    ("Subtotal: 12,00", None),
]

NUMBERS = [
    ("Nº Factura: F-1/26", "F-1/26"),
    ("n factura A 12", "A 12"),
    ("N° de factura - X9 Fecha Factura: 1/1/2026", "X9"),
    ("Factura: 12", None),
    ("Nº Factura:", None),
    ("Nº Factura: " + "9" * 64, "9" * 64),
    ("Nº Factura: " + "9" * 65, None),
    ("Nº Factura: " + "9" * 65 + "\nNº Factura: 7", "7"),
]

TAXES = [("IGIC (7%): 1,00", "IGIC"), ("iva 21", "IVA"), ("TAXES: 3", "TAX"), ("I.G.I.C.: 3", None), ("igicx", "IGIC"), ("x iva", "IVA"), ("I.G.I.C.: 3\nIVA 3", None), ("none", None)]


def test_dates(spark):
    assert run(spark, [t for t, _ in DATES], lambda c: fields.label_date(c, "invoice_date")) == [d for _, d in DATES]
    assert run(spark, ["Fecha factura simplificada: 15/06/2026", "fecha simplificada 1.1.2000"], lambda c: fields.label_date(c, "simplified_invoice_date")) == [dt.date(2026, 6, 15), dt.date(2000, 1, 1)]


def test_amounts(spark):
    assert run(spark, [t for t, _ in AMOUNTS], lambda c: fields.label_amount(c, "total")) == [d and Decimal(d) for _, d in AMOUNTS]
    assert run(spark, ["IVA 4%: 4.41", "IVA (4%): 4.41"], lambda c: fields.label_amount(c, "tax")) == [None, Decimal("4.41")]


def test_numbers_and_tax_labels(spark):
    assert run(spark, [t for t, _ in NUMBERS], lambda c: fields.label_value(c, "invoice_number", R.NUMBER_CHARS)) == [d for _, d in NUMBERS]
    assert run(spark, [t for t, _ in TAXES], fields.label_tax) == [d for _, d in TAXES]


def test_vendors_by_priority(spark):
    texts = ["EMPARK APARCAMIENTOS y MERCADONA  S.A.", "parque dársena", "PARQUE DARSENA", "FACTURA VENTAS", "factura venta 1", "Doctor Agua", "nobody", None]
    assert run(spark, texts, fields.detect_vendor) == ["mercadona", "empark", "empark", None, "acastimar", "doctoragua", None, None]


def test_vendor_values_override_and_extend(spark):
    text = "Fecha Factura: 1/1/2020\nTotal: 9,00\nFECHA de factura: 02/08/2026 LENCAR CANARIAS F1234/26 Base imponible Importe IGIC Total Factura 1.131,59 79,21 1.210,80"
    (f,) = run(spark, [text], fields.extract_fields)
    assert (f.vendor, f.invoice_number, f.invoice_date, f.tax_label) == ("miller", "F1234/26", dt.date(2026, 8, 2), "IGIC")
    assert f.totals.asDict() == {"subtotal": Decimal("1131.59"), "tax": Decimal("79.21"), "total": Decimal("1210.80")}
    assert f.matched[0] == "invoice_date" and len(f.matched) == len(set(f.matched))


def test_vendor_without_a_tax_keeps_the_generic_one(spark):
    (f,) = run(spark, ["IVA: 3,00\nACASTIMAR, S.L. FACTURA VENTA 26-722 Fecha operación: 31-02-2026\nImporte Factura(EUR): 1.298,05"], fields.extract_fields)
    assert f.totals.asDict() == {"subtotal": None, "tax": Decimal("3.00"), "total": Decimal("1298.05")} and f.invoice_date is None and f.tax_label == "IVA"


def test_a_model_only_fills(spark):
    fill = lambda c: fields.fill_from_model(fields.extract_fields(c), F.lit("M1"), F.lit("2020-01-01").cast("date"), F.lit("7.5").cast("decimal(12,2)"))
    a, b = run(spark, ["Nº Factura: A1\nTotal: 9,00", ""], fill)
    assert (a.invoice_number, a.invoice_date, a.totals.total, a.matched) == ("A1", dt.date(2020, 1, 1), Decimal("9.00"), ["invoice_number", "total", "invoice_date"])
    assert (b.invoice_number, b.totals.total, b.matched) == ("M1", Decimal("7.50"), ["invoice_number", "invoice_date", "total"])


def test_rules_from_labels(spark):
    v = templates.vendor_from_labels("Agua & Co.", ["AGUA (y) CO"], {"number": "Recibo nº", "date": "Emitido el", "subtotal": "Base_1 50%", "total": "A pagar"})
    sample = spark.createDataFrame([("agua  (Y) co Recibo nº  AB-12 Emitido el: 03/04/2026 base_1 50% 10,00 A PAGAR 1.210,50",)], "text string")
    all_vendors = templates.validated(v, sample)
    (f,) = [r.out for r in sample.select(fields.extract_fields(F.col("text"), fields.detect_vendor(F.col("text"), all_vendors)).alias("out")).collect()][:1]
    assert all_vendors[-1].name == "aguaco"
    got = sample.select(fields.vendor_fields(F.col("text"), F.lit("aguaco"), all_vendors).alias("v")).first().v
    assert (got.invoice_number, got.invoice_date, got.totals.subtotal, got.totals.total) == ("AB-12", dt.date(2026, 4, 3), Decimal("10.00"), Decimal("1210.50"))
    assert f.vendor is None
    with pytest.raises(ValueError):
        templates.validated(R.VENDORS[1], sample)
    with pytest.raises(ValueError):
        templates.validated(v, spark.createDataFrame([("DOCTOR AGUA",)], "text string"))
    with pytest.raises(ValueError):
        templates.validated(v, spark.createDataFrame([("nothing",)], "text string"))


def test_lines_are_passed_over_only_if_no_label_can_match(spark):
    """Letters that patterns take for plain ones; blanks of all kinds in labels."""
    said = ["Total: 1,00", "ſubtotal: 2,00", "BAſE IMPONIBLE 3,00", "İGİC (7%): 4,00", "ıva: 5,00", "I.G.I.C. 6,00", "TAXES - 7,00", "Nº FACTURA X-1", "n.factura y", "Fecha　de  factura: 1/2/2020", "FECHA FACTURACIÓN 1/2/2020", "fecha  simplificada 1.2.2020", "importe\tneto 8,00", "TOTAL € 9,00", "subtotalx", "", "xtotal 1,00"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(said)], "k int, text string")
    for name in R.LABELS:
        got = rows.select("k", F.size(F.filter(fields._labelled_lines(F.col("text")), lambda x: fields._said(x, name))).alias("n"), F.col("text").rlike(fields._label(name)).cast("int").alias("want")).collect()
        assert [r.n for r in got] == [r.want for r in got]


def test_lines_are_parted_without_a_pattern(spark):
    """A pattern would be compiled for each text, and a value looked for twice by each label."""
    df = spark.createDataFrame([("x",)], "text string")
    plan = df.select(fields.generic_fields(F.col("text")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert ", \r?\n" not in plan and plan.count("imponible|importe") == 1
    texts = ["a\rTotal 1,00\r\nTotal 2,00\n", " TOTAL 3,00", "xTotal 4,00 Ktotal 5,00", "İGIC 1,00\nimporte\ttotal 6,00", "Totally\nSubtotal 7,00", "\r\n\r\n"]
    assert [v and float(v) for v in run(spark, texts, lambda t: fields.label_amount(t, "total"))] == [1.0, 3.0, None, 6.0, None, None]
    assert [v and float(v) for v in run(spark, texts, lambda t: fields.label_amount(t, "tax"))] == [None, None, None, 1.0, None, None]


def test_labels_are_looked_for_in_the_whole_text_at_once(spark):
    """A pattern for each label and line, and more for each value, would be what most time goes into."""
    df = spark.createDataFrame([("x",)], "text string")
    plan = df.select(fields.generic_fields(F.col("text")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and plan.count("regexp_replace") == 0 and plan.count("regexp_extract_all(") == 6
    # What stands in another line, or behind the next label, is no part of a value or label.
    texts = ["Total\n12,00", "Total:\n\nTotal 3,00 EUR\r\n", "IGIC (7%\n8) 5,00", "importe\ntotal 6,00", "Totaliva 4,00", "Total 7,00 igic 1,00", "Total 8,00 eur eur", "Total 9,00 € Fecha  factura", "Total: ; 2,00 "]
    assert [v and float(v) for v in run(spark, texts, lambda t: fields.label_amount(t, "total"))] == [None, 3.0, None, 6.0, None, 7.0, 8.0, 9.0, 2.0]
    texts = ["Fecha factura\nFecha factura 1/2/2020 3/4/2020", "Fecha\nfactura 1/2/2020", "Fecha factura\n\n1/2/2020", "Fecha factura\nsimplificada 1/2/2020", "Fecha factura 1/2/20 3/4/2020\nFecha factura: 5/6/2020"]
    assert run(spark, texts, lambda t: fields.label_date(t, "invoice_date")) == [dt.date(2020, 2, 1), None, None, dt.date(2020, 2, 1), dt.date(2020, 6, 5)]


def test_vendors_are_looked_for_where_their_words_are(spark):
    from ledgerleaf.functions import text as T

    assert [T.needed(m) for v in R.VENDORS for m in v.markers] == ["mercadona", "canarias", "miller", "aparcamientos", "parque", "acastimar", "factura", "doctoragua", "doctor", "b52537339"]
    assert [T.needed(p) for p in ("ab", "abc|xyz", "abcd?", "a[bc]d", "(abc)", r"\dabc", "%babc%e", "abc_defg")] == [None, None, None, None, None, None, "abc", "defg"]
    assert run(spark, ["acaſtimar,s.l.", "MERCADONA S.A.", "POL.IN.MİLLER", "doctor", "B5253733"], fields.detect_vendor) == ["acastimar", "mercadona", "miller", None, None]
