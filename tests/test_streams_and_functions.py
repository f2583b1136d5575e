"""Rules read for each batch of a stream, line parsers as functions, messages by columns."""

import pytest
from pyspark.sql import functions as F

from ledgerleaf.operators import items, line_functions
from ledgerleaf.plans import rule_table, templates
from ledgerleaf.sources import pdf, settings
from ledgerleaf.streaming import folder_watch

TEXTS = {b"1": "AGUAS DEL SUR\nRecibo nº R-100\nTotal 5,00", b"2": "AGUAS DEL SUR\nRecibo nº R-200\nTotal 6,00", b"3": "nothing"}
READ = pdf.reader(lambda data, most: ([TEXTS[data[-1:]]], 1))


def test_a_rule_counts_from_the_next_batch_on_and_a_content_once(spark, tmp_path):
    folder, out, rules, checkpoint = (str(tmp_path / x) for x in ("in", "out", "rules", "checkpoint"))
    (tmp_path / "in").mkdir()
    put = lambda name, end: (tmp_path / "in" / name).write_bytes(b"%PDF-1.7 " + end)
    table = rule_table.as_table(spark)
    table.write.parquet(rules)
    run = lambda: folder_watch.watch_into(spark, folder, out, checkpoint, rules, reader=READ).awaitTermination(120)
    rows = lambda: {r.file: r.vendor for r in spark.read.parquet(out).collect()}
    put("a.pdf", b"1"), put("z.pdf", b"3")
    run()
    assert rows() == {"a.pdf": None, "z.pdf": None}
    vendor = templates.vendor_from_labels("Aguas del Sur", ["AGUAS DEL SUR"], {"number": "Recibo nº", "total": "Total"})
    own = rule_table.with_vendor(table, vendor).filter(F.col("vendor") == vendor.name)
    own.write.mode("append").parquet(rules)
    put("b.pdf", b"2"), put("again.pdf", b"1")
    run()
    assert rows() == {"a.pdf": None, "z.pdf": None, "b.pdf": "aguasdelsur"}
    before = spark.read.parquet(out).count()
    run()
    assert spark.read.parquet(out).count() == before == 3


def test_one_vendor_in_both_forms(spark):
    text = "EMPARK APARCAMIENTOS\nDetalle de Facturación\nPlaza 7 2 10,50 21,00 7,00 %\nAbono 1 1.000,00 1.000,00 0,00 %\nDetalle del IGIC"

    def parse(text):
        for line in text.split("\n")[2:-1]:
            *name, units, price, amount, rate, _ = line.split(" ")
            yield {"description": " ".join(name), "units": units, **{k: v.replace(".", "").replace(",", ".") for k, v in (("unit_price", price), ("amount", amount), ("tax_rate", rate))}}

    docs = spark.createDataFrame([(1, "empark", text), (2, "other", text), (3, None, text), (4, "empark", None)], "key int, vendor string, text string")
    of = lambda parsers, good=docs: sorted(map(tuple, line_functions.vendor_lines(good, parsers).collect()))
    readable = docs.filter("text IS NOT NULL")
    assert of({"empark": parse}, readable) == of({}, readable) and len(of({}, readable)) == 2
    assert of({"empark": lambda t: ()}) == []
    got = line_functions.parsed_lines(docs, {"other": lambda t: [{"description": "x", "amount": 2}]}).collect()
    assert [(r.key, r.place, r.description, str(r.amount), r.units) for r in got] == [(2, 0, "x", "2.0000", None)]
    assert got[0].asDict().keys() == {"key", "vendor", "place", *items.ARTICLE}
    with pytest.raises(Exception, match="ZeroDivision"):
        line_functions.parsed_lines(docs, {"empark": lambda t: 1 / 0}).collect()


def test_messages_by_columns(spark):
    catalogs = {"es": {"a": "hola {x} {y} {x}", "b": "sólo"}, "en": {"a": "hi {x}"}}
    rows = [("a", "en", {"x": "1"}), ("a", "fr", {"x": "{y}", "y": "2"}), ("b", "en", None), ("c", "es", None), ("a", None, {"x": None, "y": "$&"}), (None, "es", None)]
    df = spark.createDataFrame(rows, "key string, lang string, params map<string,string>")
    got = [r.m for r in df.select(settings.message_column(catalogs, F.col("key"), F.col("lang"), F.col("params")).alias("m")).collect()]
    assert got == ["hi 1", "hola 2 2 2", "sólo", "c", "hola  $& ", None]
    assert [r.m for r in df.select(settings.message_column({}, F.col("key"), F.col("lang")).alias("m")).collect()][:2] == ["a", "a"]
