"""Items, budgets, documents, names, contracts, sources and sinks."""

import base64
import datetime as dt
import json
import zlib
from decimal import Decimal

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerleaf import queries
from ledgerleaf.functions import text as T
from ledgerleaf.operators import budget, contract, documents, items, naming, sinks
from ledgerleaf.plans import rule_table
from ledgerleaf.plans import rules as R
from ledgerleaf.sources import pdf, settings
from ledgerleaf.streaming import folder_watch

D = Decimal


def run(spark, texts, col):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    return [r.out for r in df.select("k", col(F.col("text")).alias("out")).orderBy("k").collect()]


def one(spark, col):
    return spark.range(1).select(col.alias("out")).first().out


HEAD = "Descripción Unid. P.Unitario B.Imp. IGIC Cuota IGIC Importe"


def test_ticket_items(spark):
    text = (
        f"MERCADONA S.A. DATOS FISCALES 1 1,0000 1,0000 EX 0,0000 1,0000 {HEAD} PAN  BLANCO 2 1,5000 3,0000 EX 0,0000 3,0000  LECHE 1.5 1,0000 1,0000 21% 0,2100 1,2100 "
        "PAN BLANCO 2 9,0000 9,0000 EX 0,0000 3,0000 NIF 1 1,0000 1,0000 EX 0,0000 1,0000 AB 1 1,0000 1,0000 EX 0,0000 1,0000 Total Factura X 1 1,0000 1,0000 EX 0,0000 1,0000"
    )
    (r,) = run(spark, [text], items.ticket_items)
    assert [(i.description, i.units, i.amount, i.tax_label) for i in r["items"]] == [("PAN BLANCO", D("2.0000"), D("3.0000"), "EX"), ("LECHE", D("15.0000"), D("1.2100"), "21%")]
    assert r.skipped == 2
    s = run(spark, [text], lambda c: items.ticket_stats(items.ticket_items(c)))[0]
    assert (s.items_detected, s.items_skipped, s.sum_totals) == (2, 2, D("4.21"))


def test_regions(spark):
    a, b, c = run(spark, [f"x {HEAD} in TOTAL ( out Total Factura", "no header", f"Descripción Unid. P.Unitario short {HEAD} long"], items.ticket_region)
    assert (a, b, c) == (" in ", "no header", " long")
    assert run(spark, ["aa S bb E cc", "aa bb E", "S only", ""], lambda c: items.bounded_region(c, "S", "E")) == ["S bb ", "aa bb E", "S only", ""]
    assert len(run(spark, ["S" + "x" * 70_000], lambda c: items.bounded_region(c, "S", "E"))[0]) == R.REGION_CHARS


def test_plausible_and_clean_descriptions(spark):
    texts = ["ab", "abc", "x" * 60, "x" * 61, "sello rojo", "a" + "1" * 20, "a" + "1" * 21, "página 3"]
    assert run(spark, texts, items.plausible_description) == [False, True, True, False, False, True, False, False]
    texts = ["Dto. Importe IGIC  Bolt", "Número de serie : AB12 Bolt números de serie: Z9", "Refª x Teléfono : 600 000 000 Bolt", "Precio Unitario Bolt", "igic Bolt", "Total"]
    assert run(spark, texts, items.clean_description) == ["Bolt", "Bolt", "Bolt", "Bolt", "igic Bolt", "Total"]


def test_unknown_vendor_and_one_without_layout(spark):
    assert run(spark, ["x", "y"], lambda c: items.vendor_items(c, F.when(c == "x", "doctoragua"))) == [[], []]


def test_total_is_reconciled_only_from_complete_items(spark):
    row = lambda a: F.struct(F.lit("d").alias("description"), *[F.lit(None).cast("decimal(18,4)").alias(k) for k in ("units", "unit_price")], F.lit(a).cast("decimal(18,4)").alias("amount"), F.lit(None).cast("decimal(9,4)").alias("tax_rate"))
    none = F.lit(None).cast("decimal(12,2)")
    assert one(spark, items.reconciled_total(none, F.array(row("1.005"), row("2.00")))) == D("3.01")
    assert one(spark, items.reconciled_total(none, F.array(row("1.00"), row(None)))) is None
    assert one(spark, items.reconciled_total(none, F.array(row("-1.00")))) is None
    assert one(spark, items.reconciled_total(F.lit("9").cast("decimal(12,2)"), F.array(row("1.00")))) == D("9.00")
    assert one(spark, items.items_text(F.array(row("1.00")))) == "d ::  ::  :: 1.0000"


def naive_budget(pages, declared, max_pages, max_chars):
    read = min(declared or max_pages, max_pages)
    pieces, total, hit = [], 0, False
    for p in pages[:read]:
        p = (p or "").strip()
        if not p:
            continue
        left = max(0, max_chars - total)
        if not left:
            hit = True
            break
        s = p[: min(4000, left)]
        pieces.append(s)
        total += len(s)
        hit = hit or len(p) > len(s) or total >= max_chars
    joined = "\n\n".join(pieces)
    text = joined if len(joined) <= max_chars else joined[: max_chars - 1].rstrip() + "…"
    hit = hit or len(joined) > max_chars
    more = declared > read
    return text, read, {(True, True): "maxPagesAndMaxChars", (True, False): "maxPages", (False, True): "maxChars", (False, False): None}[(more, hit)]


def test_budget_against_a_loop(spark):
    import random

    rng = random.Random(3)
    rows = []
    for k in range(120):
        n = rng.randrange(0, 8)
        pages = [rng.choice([None, "", "   ", "x" * rng.randrange(1, 60), "y" * 4000, "z" * 4001, " pad "]) for _ in range(n)]
        rows.append((k, pages, n + rng.choice([0, 0, 2]), rng.choice([1, 3, 100]), rng.choice([5, 40, 4000, 8002, 20000])))
    df = spark.createDataFrame(rows, "k int, pages array<string>, declared int, mp int, mc int")
    got = {r.k: r.r for r in df.select("k", budget.page_budget(F.col("pages"), F.col("declared"), F.col("mp"), F.col("mc")).alias("r")).collect()}
    for k, pages, declared, mp, mc in rows:
        assert (got[k].text, got[k].pages, got[k].truncation_reason) == naive_budget(pages, declared, mp, mc), rows[k]
        assert got[k].truncated == (got[k].truncation_reason is not None)
    t = spark.range(1).select(budget.page_budget(F.array(F.lit("a\x00b")), F.lit(3), 2, 10).alias("r")).select(budget.truncation(F.col("r")).alias("t"), "r.text").first()
    assert t.text == "ab" and t.t.reason == "maxPages" and t.t.allowed.max_pages == 200


def test_text_functions(spark):
    assert run(spark, ["  a \ufeff", "\t", None], T.trim_blanks) == ["a", "", None]
    assert run(spark, ["a\x07 \n b", None], T.safe_string) == ["a b", ""]
    assert run(spark, ["=1", "-x", "a,b", 'q"q', "l\nm", None, "a=b", "r\rs"], T.csv_cell) == ["'=1", "'-x", '"a,b"', '"q""q"', '"l\nm"', "", "a=b", "r\rs"]
    assert run(spark, ['a/b:c  d"', "--", None, "?x?"], lambda c: T.filename_part(c, "f")) == ["a-b-c-d", "f", "f", "x"]
    assert run(spark, ["abcdef", "abc  ef", "abcde"], lambda c: T.truncated(c, 5)) == ["abcd…", "abc…", "abcde"]
    assert run(spark, ["1.298,05", "131,59", "12.00", "1.298", "€ 3", "x", None], T.spanish_amount) == [D("1298.05"), D("131.59"), D("12.00"), D("1.30"), D("3.00"), None, None]
    assert run(spark, ["1.5", "2,25", "x"], T.tabular_number) == [D("15.0000"), D("2.2500"), None]
    assert run(spark, ["2026-02-30", "2026-02-03", "03/02/2026", "03-02-2026", "3/2/2026", ""], T.vendor_date) == [None] + [dt.date(2026, 2, 3)] * 3 + [None, None]
    assert run(spark, ["0", "-1", "2.9", "999", "NaN", "Infinity", "x", None], lambda c: T.bounded_int(c, 7, 100)) == [7, 7, 2, 100, 7, 7, 7, 7]
    assert run(spark, ["YQ==", "YQ=", "Y Q=", "", "YWI=", "a===", None], T.strict_base64) == [b"a", None, None, None, b"ab", None, None]
    assert run(spark, ["a.b(c)"], T.escape_pattern_col) == ["a\\.b\\(c\\)"] and run(spark, ['<a href="x">&'], T.html_escape) == ["&lt;a href=&quot;x&quot;&gt;&amp;"]


def test_names(spark):
    assert run(spark, ["Factura de Batería de Litio 12,5 V batería azul", "", None, "un la 12"], naming.keyword) == ["batería-litio-azul", "", "", ""]
    name = lambda pattern, vendor="miller", error=None: one(spark, naming.new_name(F.lit(vendor).cast("string"), F.lit("A/1"), F.lit(None).cast("date"), F.lit(""), F.lit("pan blanco"), pattern, F.lit(error).cast("string")))
    assert name("{fecha}_{proveedor}_{palabra}_{numero}") == "sin-fecha_miller_pan-blanco_A-1.pdf"
    assert name("{proveedor}", vendor=None) == "desconocido.pdf"
    assert name("") is None and name("{fecha}", error="bad") is None


def test_rename_plan(spark):
    rows = [("f1", "a.pdf"), ("f2", "A.pdf"), ("f3", "a-1.pdf"), ("f4", "b.pdf"), ("B.pdf", "b.pdf"), ("f5", None), ("f6", "c.pdf"), ("f7", "c.pdf"), ("f8", "d.pdf")]
    existing = [(f,) for f, _ in rows] + [("c-1.pdf",), ("d.pdf",)]
    plan = naming.rename_plan(spark.createDataFrame(rows, "file string, new_name string"), spark.createDataFrame(existing, "file string"))
    got = {r.file: r.new_name for r in plan.collect()}
    assert got == {"f1": "a.pdf", "f2": "A-1.pdf", "f3": "a-1-1.pdf", "f4": "b-1.pdf", "f6": "c.pdf", "f7": "c-2.pdf", "f8": "d-1.pdf"}
    table = spark.createDataFrame([("f1", 1), ("f5", 2)], "file string, n int")
    assert sorted(map(tuple, naming.apply_plan(table, plan).collect())) == [("a.pdf", 1), ("f5", 2)]


def test_a_name_that_very_many_files_wish_for(spark):
    rows = [(f"f{k:05d}", "Same.pdf" if k % 3 else f"own{k}.pdf") for k in range(3000)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        df = spark.createDataFrame(rows, "file string, new_name string")
        got = {r.file: r.new_name for r in naming.rename_plan(df, df.select("file")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    same = [f for f, t in rows if t == "Same.pdf"]
    assert [got[f] for f in same] == ["Same.pdf", *(f"Same-{k}.pdf" for k in range(1, len(same)))]
    assert all(got[f] == t for f, t in rows if t != "Same.pdf")


GOOD = {"documentType": "manual", "summary": "s", "fields": {"a": 1}, "lineItems": [{"description": "d", "quantity": 2}], "sections": [], "warnings": ["w"]}


def test_contract(spark):
    bad = [{**GOOD, "documentType": "letter"}, {**GOOD, "more": 1}, {k: v for k, v in GOOD.items() if k != "sections"}, {**GOOD, "fields": []}, {**GOOD, "fields": None}, {**GOOD, "warnings": [1]}, {**GOOD, "warnings": ["a", None]}, {**GOOD, "summary": 3}, {**GOOD, "lineItems": {}}, [GOOD], None]
    texts = [json.dumps(x) for x in bad] + ["", None, "{", "text " + json.dumps(GOOD), json.dumps(GOOD) + json.dumps(GOOD)]
    assert run(spark, texts, contract.structured_reply) == [None] * len(texts)
    fine = [json.dumps(GOOD), f"```json\n{json.dumps(GOOD)}\n```", f"  ```\n{json.dumps({**GOOD, 'warnings': []})}```\n"]
    assert [json.loads(x) is not None for x in run(spark, fine, contract.structured_reply)] == [True] * 3
    call = lambda n, name=contract.TOOL, kind="function": json.dumps({"content": "x", "tool_calls": [{"type": kind, "function": {"name": name, "arguments": json.dumps(GOOD)}}] * n})
    got = run(spark, [call(1), call(2), call(0), call(1, "other"), call(1, kind="x"), json.dumps({"content": json.dumps(GOOD)}), json.dumps({"content": None})], contract.structured_message)
    assert [x is not None for x in got] == [True, False, False, False, False, True, False]
    assert run(spark, ["say ```json\n{1}\n``` so", "a {b {c}} d", "none"], contract.lenient_block) == ["{1}\n", "{b {c}}", "none"]


def make_pdf(pages, compress=False, encrypt=False):
    out, places = b"%PDF-1.7\n", []
    kids = " ".join(f"{3 + 2 * k} 0 R" for k in range(len(pages)))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} >>".encode()]
    for k, text in enumerate(pages):
        escaped = text.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)").encode("cp1252")
        stream = b"BT /F1 12 Tf 72 720 Td (" + escaped + b") Tj ET"
        stream = zlib.compress(stream) if compress else stream
        objects.append(f"<< /Type /Page /Parent 2 0 R /Contents {4 + 2 * k} 0 R >>".encode())
        objects.append(f"<< /Length {len(stream)}{' /Filter /FlateDecode' if compress else ''} >>\nstream\n".encode() + stream + b"\nendstream")
    for k, o in enumerate(objects, 1):
        places.append(len(out))
        out += f"{k} 0 obj\n".encode() + o + b"\nendobj\n"
    return out + b"trailer << /Root 1 0 R" + (b" /Encrypt 9 0 R" if encrypt else b"") + b" >>\n%%EOF"


@pytest.fixture()
def folder(tmp_path):
    text = "DOCTOR AGUA FACTURA #10001 Fecha 01/08/2026 BASE IMPONIBLE 3,00 IMPUESTO 0,21 IVA TOTAL 3,21"
    for name, data in {
        "a.pdf": make_pdf([text, "second (page)"]), "b.PDF": make_pdf(["Nº Factura: Ñ-7 "], compress=True), "c.pdf": b"%PDF-1.7 nothing", "d.pdf": b"tiny", "e.pdf": b"no magic here", "f.txt": b"%PDF-",
        "g.pdf": make_pdf([""]), "h.pdf": make_pdf(["x"], encrypt=True),
    }.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "z.pdf").write_bytes(make_pdf(["z"]))
    return str(tmp_path)


def scanned(spark, folder, **more):
    texts = documents.with_text(pdf.scan_folder(spark, folder), pdf.reader(), **more)
    return documents.document_rows(texts.select("file", "error", F.col("extracted.text").alias("text"), F.col("extracted.joined").alias("joined")), joined="joined")


def test_scan_folder(spark, folder):
    assert [r.file for r in pdf.list_files(spark, folder).collect()] == ["a.pdf", "b.PDF", "c.pdf", "d.pdf", "e.pdf", "g.pdf", "h.pdf"]
    got = {r.file: r for r in scanned(spark, folder).collect()}
    assert (got["a.pdf"].vendor, got["a.pdf"].invoice_number, got["a.pdf"].total, got["a.pdf"].new_name) == ("doctoragua", "10001", D("3.21"), "2026-08-01_doctoragua_doctoragua.pdf")
    assert got["b.PDF"].invoice_number == "Ñ-7" and got["b.PDF"].error is None
    assert {f: got[f].error for f in ("c.pdf", "d.pdf", "e.pdf", "g.pdf", "h.pdf")} == {"c.pdf": "pdf_parse_failed", "d.pdf": "pdf_too_small", "e.pdf": "pdf_invalid_magic", "g.pdf": None, "h.pdf": "pdf_parse_failed"}
    s = documents.run_summary(scanned(spark, folder)).first()
    assert (s.total, s.with_data, s.scanned, s.errors, s.vendors) == (7, 2, 1, 4, "doctoragua")


def test_ocr_and_envelopes(spark, folder):
    texts = documents.with_text(pdf.scan_folder(spark, folder), pdf.reader(), ocr=pdf.recogniser(lambda data, language: [(2, "two"), (10, ""), (1, "Nº Factura: S-1")] if language == "eng" else []))
    e = {r.file: r.envelope for r in documents.envelopes(texts).collect()}
    assert e["g.pdf"].text == "Nº Factura: S-1\n\ntwo" and e["g.pdf"].source == "invoice-fields" and e["g.pdf"].parser == "plain-text"
    assert e["a.pdf"].parser == "doctoragua-tabular" and e["a.pdf"].pages == 2 and e["a.pdf"].text.endswith("second (page)") and len(e["a.pdf"].sha256) == 64
    j = documents.envelopes(texts).select("file", documents.capped_json(F.col("envelope"), 900).alias("j")).collect()
    assert all(json.loads(r.j) for r in j)


def test_model_fills_documents(spark):
    texts = spark.createDataFrame([("a", "Nº Factura: A1"), ("b", " "), ("c", "x")], "file string, text string")
    replies = pdf.ask_model(texts, lambda t: json.dumps({"n": t}) if t != "x" else 1 / 0)
    assert {r.file: (r.reply is None, r.error) for r in replies.collect()} == {"a": (False, None), "c": (True, "ZeroDivisionError")}
    model = spark.createDataFrame([(f, "M", dt.date(2020, 1, 1), D("5.00"), "pan rico", [("d", D(1), D(2), D(2), None)]) for f in "ab"], "file string, number string, date date, total decimal(12,2), summary string, articles array<struct<description:string,units:decimal(18,4),unit_price:decimal(18,4),amount:decimal(18,4),tax_rate:decimal(9,4)>>")
    got = {r.file: r for r in documents.document_rows(texts, model).collect()}
    assert (got["a"].invoice_number, got["a"].total, len(got["a"].articles), got["a"].new_name) == ("A1", D("5.00"), 1, "2020-01-01_desconocido_pan-rico.pdf")
    assert got["b"].invoice_number is None and got["b"].articles == [] and got["c"].total is None


def test_csv_and_json_files(spark, tmp_path):
    docs = documents.document_rows(spark.createDataFrame([("=f,1.pdf", "ACASTIMAR, S.L. Precio Unitario BOLT 1,00 1,00 0,00 AB 2,00 2,00 NUT 1,00 1,00 0,00 AB 3,00 3,00 Importe neto"), ("g.pdf", "")], "file string, text string"))
    sinks.write_csv(documents.article_rows(docs), f"file://{tmp_path}/csv", bom=True, single=True)
    (part,) = [p for p in (tmp_path / "csv").iterdir() if p.name.startswith("part-")]
    lines = part.read_text(encoding="utf-8").split("\n")
    assert lines[0] == "\ufeff" + ",".join(R.CSV_HEADER) and len(lines) == 5 and lines[-1] == ""
    assert lines[1].startswith("\"'=f,1.pdf\",acastimar,") and ",BOLT,2.0000,1.0000,2.0000," in lines[1] and lines[3] == "g.pdf" + "," * 12
    sinks.write_json(docs, f"file://{tmp_path}/json")
    assert spark.read.json(f"file://{tmp_path}/json").count() == 2


def test_files_over_the_limit_are_not_read(spark, tmp_path, monkeypatch):
    (tmp_path / "big.pdf").write_bytes(make_pdf(["x" * 3000]))
    (tmp_path / "ok.pdf").write_bytes(make_pdf(["Nº Factura: A-1"]))
    monkeypatch.setattr(R, "MAX_BYTES", 2000)
    got = {r.file: r for r in pdf.scan_folder(spark, str(tmp_path)).collect()}
    assert got["big.pdf"].content is None and got["big.pdf"].length > 2000 and got["ok.pdf"].content is not None
    texts = documents.with_text(pdf.scan_folder(spark, str(tmp_path)), pdf.reader())
    assert {r.file: r.error for r in texts.collect()} == {"big.pdf": "pdf_too_large", "ok.pdf": None}
    assert [r.file for r in pdf.scan_paths(spark, ["ok.pdf"], str(tmp_path)).collect()] == ["ok.pdf"]


def lzw(data):
    """Nine-bit codes only, so the table is cleared in time."""
    codes = []
    for k, byte in enumerate(data):
        codes += [256] if k % 200 == 0 else []
        codes.append(byte)
    bits = "".join(f"{c:09b}" for c in [*codes, 257])
    return bytes(int(bits[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(bits), 8))


def pdf_of(stream, keys="", fonts=""):
    head = f"%PDF-1.7\n1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj\n2 0 obj <</Type /Pages /Kids [3 0 R] /Count 1 /Resources <</Font <<{'/F1 5 0 R' if fonts else ''}>> >> >> endobj\n3 0 obj <</Type /Page /Parent 2 0 R /Contents 4 0 R>> endobj\n"
    return head.encode() + f"4 0 obj <</Length {len(stream)} {keys}>>\nstream\n".encode() + stream + b"\nendstream endobj\n" + fonts.encode()


def test_streams_of_all_filters():
    content = b"BT /F1 9 Tf (Total \\(EUR\\): 3,21) Tj ET " * 8
    rows = zlib.compress(b"".join(b"\x02" + bytes((b - a) & 255 for a, b in zip(content[k - 16 : k] if k else bytes(16), content[k : k + 16], strict=False)) for k in range(0, len(content), 16)))
    cases = {
        "/Filter /FlateDecode": zlib.compress(content),
        "/Filter /LZWDecode": lzw(content),
        "/Filter [/ASCII85Decode /FlateDecode]": base64.a85encode(zlib.compress(content)) + b"~>",
        "/Filter /ASCIIHexDecode": content.hex().encode() + b">",
        "/Filter /RunLengthDecode": b"".join(bytes([len(c) - 1]) + c for c in (content[k : k + 100] for k in range(0, len(content), 100))) + bytes([257 - 3]) + b" " + bytes([128]),
        "/Filter /FlateDecode /DecodeParms <</Predictor 12 /Columns 16>>": rows,
        "": content,
    }
    for keys, stream in cases.items():
        assert pdf.read_pages(pdf_of(stream, keys)) == ([" ".join(["Total (EUR): 3,21"] * 8)], 1), keys


def test_fonts_with_maps():
    cmap = "1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0003> <0020> endbfchar 2 beginbfrange <0010> <0029> <0041> <0030> <0031> [<00F1> <00660069>] endbfrange"
    fonts = f"5 0 obj <</Type /Font /Subtype /Type0 /ToUnicode 6 0 R>> endobj\n6 0 obj <</Length {len(cmap)}>>\nstream\n{cmap}\nendstream endobj\n"
    assert pdf.read_pages(pdf_of(b"BT /F1 12 Tf <0015001000320003> Tj [<0030> -20 <0031>] TJ /F2 9 Tf (plain) Tj ET", fonts=fonts)) == (["FA  \u00f1fi plain"], 1)


def test_one_limit_of_pages_for_reader_and_budget(spark):
    sent = spark.createDataFrame([("a.pdf", make_pdf([f"page {k}" for k in range(150)]))], "file string, content binary")
    for most, reason in ((200, None), (150, None), (100, "maxPages")):
        e = documents.with_text(sent, pdf.reader(), max_pages=most).first().extracted
        assert (e.pages, e.truncation_reason) == (min(most, 150), reason) and e.text.count("page") == min(most, 150)


def test_package_functions(spark, folder, tmp_path):
    import ledgerleaf

    docs = ledgerleaf.process(spark, folder, out=f"file://{tmp_path}/csv")
    assert docs.count() == 7 and spark.read.text(f"file://{tmp_path}/csv").filter("value LIKE 'a.pdf,%'").count() == 1
    assert ("a.pdf", "2026-08-01_doctoragua_doctoragua.pdf") in {(r.file, r.new_name) for r in ledgerleaf.renames(docs).collect()}
    assert [r.file for r in documents.needs_parser(pdf.scan_folder(spark, folder), docs).collect()] == ["b.PDF", "g.pdf"] or {r.file for r in documents.needs_parser(pdf.scan_folder(spark, folder), docs).collect()} == {"b.PDF", "g.pdf"}
    e = {r.file: r.envelope for r in ledgerleaf.extract(pdf.scan_folder(spark, folder), max_pages=1).collect()}
    assert e["a.pdf"].truncation.reason == "maxPages" and e["a.pdf"].truncation.applied.max_pages == 1
    with pytest.raises(ValueError):
        ledgerleaf.extract(docs, max_pages=0)
    with pytest.raises(AttributeError):
        ledgerleaf.nothing  # noqa: B018
    seen, progress = documents.observed(docs)
    seen.write.format("noop").mode("overwrite").save()
    assert progress.get == {"processed": 7, "errors": 4}


def test_json_array(spark, tmp_path):
    rows = spark.createDataFrame([(f"f{k}.pdf", k) for k in range(50)], "file string, n int")
    for name, df in (("some", rows.repartition(4)), ("none", rows.limit(0))):
        sinks.write_json_array(df, f"file://{tmp_path}/{name}")
        (part,) = [p for p in (tmp_path / name).iterdir() if p.name.startswith("part-")]
        assert [x["file"] for x in json.loads(part.read_text())] == ([] if name == "none" else sorted(f"f{k}.pdf" for k in range(50)))


def test_rule_table_round_trip(spark, tmp_path):
    table = rule_table.as_table(spark)
    assert rule_table.vendors_of(table) == R.VENDORS
    table.write.parquet(f"file://{tmp_path}/rules")
    assert rule_table.read_rules(spark, f"file://{tmp_path}/rules") == R.VENDORS


def test_blank_texts_are_never_sent(spark):
    texts = spark.createDataFrame([("a", "x"), ("b", " \u00a0"), ("c", None), ("d", "y")], "file string, text string")
    assert sorted((r.file, r.reply) for r in pdf.ask_model(texts, lambda t: t * 2, F.col("file") != "d").collect()) == [("a", "xx")]


def test_streaming_folder(spark, folder, tmp_path):
    out = folder_watch.watch(spark, folder).select("file", "invoice_number", "error")
    q = out.writeStream.format("memory").queryName("watched").option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.file: (r.invoice_number, r.error) for r in spark.table("watched").collect()}
    assert len(got) == 7 and got["a.pdf"] == ("10001", None) and got["d.pdf"] == (None, "pdf_too_small")


def test_settings(spark, tmp_path):
    f = tmp_path / "x.env"
    f.write_text("A='1'\n B = two \n#C=3\nD=\"4\"\n")
    assert settings.load_settings(str(f), {"B": "env"}) == {"A": "1", "B": "env", "D": "4"}
    c = {"es": {"k": "hola {n}", "z": "zeta"}, "en": {"k": "hello {n}"}}
    assert [settings.message(c, "k", "en", n=3), settings.message(c, "z", "en"), settings.message(c, "q", "es")] == ["hello 3", "zeta", "q"]
    assert settings.detect_language({"LANG": "es_ES.UTF-8"}) == "es" and settings.detect_language({}) == "en"
    catalog = settings.providers(spark, [("one", "One", "http://one", ["m1", "m2"], True, False), ("two", "Two", "http://two", [], False, True)])
    assert settings.provider_by_id(catalog, "one").first().default_model == "m1" and settings.provider_by_id(catalog, "two").first().default_model is None
    settings.check_input(name="n", max_pages=200, max_chars=1, prompt="p", max_tokens=256)
    for bad in ({"name": ""}, {"max_pages": 201}, {"max_chars": 0}, {"prompt": ""}, {"max_tokens": 255}, {"max_pages": True}):
        with pytest.raises(ValueError):
            settings.check_input(**bad)
    assert pdf.inside_workspace("x.env", str(tmp_path)) == str(f.resolve())
    with pytest.raises(PermissionError):
        pdf.inside_workspace("../x", str(tmp_path))


def test_row_patterns_are_scanned_once(spark):
    df = spark.createDataFrame([(1, "text")], "key int, text string")
    docs = df.select("key", items.ticket_items(F.col("text"))["items"].alias("items"))
    plan = queries.exploded(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(replace(") == 1


def _made(spark, column):
    """How often a long expression over ``text``, marked by a reverse(), stands in a plan."""
    df = spark.createDataFrame([("a", "b")], "text string, vendor string")
    return df.select(column(F.reverse("text")).alias("x"))._jdf.queryExecution().optimizedPlan().toString().count("reverse(")


def test_a_text_is_made_once(spark):
    """Texts, pages and lists that are expressions stand once in a plan, however often they are needed."""
    assert _made(spark, items.ticket_items) == 1
    assert _made(spark, lambda t: items.vendor_items(t, F.col("vendor"))) == 1
    assert _made(spark, items.plausible_description) == 1
    assert _made(spark, lambda t: T.first_group(t, "(a)")) == 1
    assert _made(spark, lambda t: T.labelled_amount(t, 100)) == 1
    assert _made(spark, lambda t: items.longer_list(items.articles(items.vendor_items(t, F.col("vendor"))), items.articles(items.vendor_items(F.lit("x"), F.col("vendor"))))) == 1
    plan = spark.createDataFrame([("a",)], "text string").select(budget.page_budget(F.array("text"), F.lit(1)).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\x1f\x7f]") == 1


def test_words_trims_and_edges(spark):
    words = ("TOTAL (", "TOTAL  (", "A+B", "ÁB", "A")
    texts = ["x TOTAL  (y", "TOTL [", "aA+Bc", "ÁB", "áb", "", None]
    assert run(spark, texts, lambda c: F.regexp_extract(c, T.any_of(words), 0)) == ["TOTAL  (", "", "A+B", "ÁB", "", "", None]
    edges = [" \t\u00a0\ufeffa b\u2003\n", "a", "\u3000", "", None, "\x1fa\x1f"]
    assert run(spark, edges, T.trim_short) == ["a b", "a", "", "", None, "\x1fa\x1f"] == run(spark, edges, T.trim_blanks) == run(spark, edges, lambda c: T.bind(c, T.trim_bound))
    assert run(spark, ["1,2,3", "1.234,5", "1,5", "12", "", None], T.tabular_number) == [None, D("1234.5"), D("1.5"), D("12"), None, None]
    assert run(spark, ["1,2,3", "1.234,50 €", "1,5", "1.298", "1.2.3", ""], T.spanish_amount) == [None, D("1234.50"), D("1.50"), D("1.30"), None, None]
    described = ["Pump NÚMERO DE SERIE : AB12 big", "Pump número de \u017ferie: X9", "Importe Total. Pump", "Caja Tel\u00e9FONO: 600 1 Pump", "  Pump  big "]
    assert run(spark, described, items.clean_description) == ["Pump big", "Pump", "Pump", "Pump", "Pump big"]


def test_regions_end_at_the_first_footer_and_the_cap(spark):
    texts = [f"x {HEAD} a Total Factura b Inscrita en el Registro", f"Total Factura {HEAD} ab", HEAD + "a" * 70_000 + "Total Factura", "no header Total Factura", None]
    assert run(spark, texts, items.ticket_region) == [" a ", " ab", "a" * R.REGION_CHARS, "no header Total Factura", None]


def test_short_uploads_against_sql(spark, tmp_path):
    texts = ["", "a", "ab", "abc", "é", "€", None]
    docs = spark.createDataFrame([(k, texts[k % 7]) for k in range(308)], "doc_id bigint, text string")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = [tuple(r) for r in queries.QUERIES["doc_validate"](spark, str(tmp_path)).select("doc_id", "error_code", "sha256").collect()]
    assert sorted(got, key=str) == sorted(con.execute(f"SELECT doc_id, error_code, sha256 FROM ({queries.ORACLES['doc_validate']})").fetchall(), key=str)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_against_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "part", "supplier", "customer", "nation", "events", "documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    a, b = queries.QUERIES[name](spark, small).toPandas(), con.execute(queries.ORACLES[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    rows = lambda d: sorted(tuple("-" if pd.isna(x) else f"{x:.6f}" if isinstance(x, float) else str(x).replace(" 00:00:00", "") for x in r) for r in d[cols].itertuples(index=False))
    assert rows(a) == rows(b)


def test_rows_are_looked_for_where_their_signs_are(spark):
    """A row's description may start anywhere, so that the pattern is tried at each character of a region without rows."""
    by = {v.name: v for v in R.VENDORS}
    assert [items._row_pieces(by[n].items.cells) for n in ("miller", "empark", "acastimar")] == [("DULO",), ("%",), (",",)]
    texts = ["Refª pan MODULO  Nº : A1 5 1,00 2,00 7,00 Recibo Resumen", "Refª pan MÓDULO Nº:A1 5 1,00 2,00 7,00", "Refª pan módulo Nº : A1 5 1,00 2,00 7,00", "Refª pan 5 1,00 2,00 7,00", ""]
    assert run(spark, texts, lambda t: F.size(items.layout_items(t, by["miller"].items))) == [1, 1, 0, 0, 0]
    cells = ["=1", "+1", "-1", "@a", "a,b", 'a"b', "a\nb", "a=b", "'", "", None]
    assert run(spark, cells, T.csv_cell) == ["'=1", "'+1", "'-1", "'@a", '"a,b"', '"a""b"', '"a\nb"', "a=b", "'", "", ""]
