"""Asking a model as a stage that can be resumed."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from ledgerleaf import api
from ledgerleaf.operators import documents, model_stage
from ledgerleaf.sources import pdf

TEXTS = "file string, text string"


def reply(body, **fields):
    said = {"documentType": "invoice", "summary": "one", "fields": fields, "lineItems": [{"description": "d", "quantity": "2", "unitPrice": "1,5", "amount": "3.00"}], "sections": [], "warnings": []}
    return json.dumps({"choices": [{"message": {"content": json.dumps(said)}}]})


class Counting:
    """A model that notes each call in a folder, and fails or dies where it is told to."""

    def __init__(self, folder, fails=(), slow=(), dies=()):
        self.folder, self.fails, self.slow, self.dies = str(folder), fails, slow, dies

    def __call__(self, body):
        text = json.loads(body)["messages"][-1]["content"].split("\n")[1]
        with open(os.path.join(self.folder, f"{text}-{time.time_ns()}"), "x"):
            pass
        if text in self.dies:
            os._exit(3)
        if text in self.slow:
            time.sleep(30)
        if text in self.fails:
            raise OSError("no")
        return reply(body, invoiceNumber=f"N-{text}", invoiceDate="2024-03-01", total="1.234,50")

    def calls(self):
        out = {}
        for f in os.listdir(self.folder):
            out[f.rsplit("-", 1)[0]] = out.get(f.rsplit("-", 1)[0], 0) + 1
        return out


def test_a_run_goes_on_where_the_last_one_ended(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    call = Counting(tmp_path / "calls", fails=("t5",), slow=("t6",))
    model = model_stage.Model(call, str(tmp_path / "store"), per_wave=3, at_once=2, most=8, tries=2, wait=0.01, seconds=1.0)
    texts = spark.createDataFrame([(f"f{k}", f"t{k % 20}") for k in range(40)] + [("blank", "  "), ("none", None)], TEXTS)
    first = model_stage.replies(texts, model).collect()
    assert len(first) == 40 and len(call.calls()) == 8
    for _ in range(4):
        got = model_stage.replies(texts, model).collect()
    calls = call.calls()
    good = {f"t{k}" for k in range(20)} - {"t5", "t6"}
    # One call for each text, in whatever number of documents and runs; failing ones are tried twice a run that reaches them.
    assert {t for t in good if calls[t] != 1} == set()
    assert calls["t5"] >= 2 and calls["t5"] % 2 == 0 and calls["t6"] >= 2
    by = {r.file: r for r in got}
    assert set(by) == {f"f{k}" for k in range(40)}
    assert {r.error for r in got if r.response is None} == {"OSError", "TimeoutError"}
    assert {r.file for r in got if r.response is None} == {"f5", "f25", "f6", "f26"}
    stored = model_stage.stored(spark, model.store)
    assert stored.filter("ok").count() == stored.filter("ok").select("request").distinct().count() == 18
    # Another prompt or model is another request.
    other = model_stage.Model(call, model.store, name="other", at_once=2, tries=1)
    assert model_stage.ask(model_stage.requests(texts.filter("text = 't1'"), other), other) == 1


def test_a_run_that_dies_leaves_whole_waves(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    texts = spark.createDataFrame([(f"f{k}", f"t{k}") for k in range(12)], TEXTS)
    bad = Counting(tmp_path / "calls", dies=("t7",))
    model = model_stage.Model(bad, str(tmp_path / "store"), per_wave=2, at_once=1, tries=1)
    with pytest.raises(Exception, match="(?i)python worker|exited|crashed"):
        model_stage.replies(texts, model)
    kept = model_stage.stored(spark, model.store)
    done = {r.response for r in kept.collect()}
    before = bad.calls()
    finished = {t for t in before if any(f"N-{t}\\" in r or f"N-{t}" in json.loads(json.loads(r)["choices"][0]["message"]["content"])["fields"].values() for r in done)}
    good = Counting(tmp_path / "calls")
    got = model_stage.replies(texts, model_stage.Model(good, model.store, per_wave=5, at_once=2, tries=1)).collect()
    assert all(r.response for r in got)
    after = good.calls()
    assert all(after[t] == before[t] for t in finished) and set(after) == {f"t{k}" for k in range(12)}
    assert all(after[t] == 1 for t in after if t not in before)


def test_replies_fill_gaps_by_contract(spark):
    answers = spark.createDataFrame(
        [("a", reply("", invoiceNumber="7", invoiceDate="01/02/2024", total="1.234,50 €"), None), ("b", '{"choices":[{"message":{"content":"talk"}}]}', None), ("c", None, "OSError"), ("d", reply("", number=" ", date="soon", total="n/a"), None), ("a", None, None)],
        "file string, response string, error string",
    )
    got = {r.file: r for r in model_stage.model_rows(answers).collect()}
    assert (got["a"].number, str(got["a"].date), str(got["a"].total), got["a"].summary) == ("7", "2024-02-01", "1234.50", "one")
    assert [str(x) for x in got["a"].articles[0]][:2] == ["d", "2.0000"]
    assert all(got[k].number is None and got[k].total is None and got[k].date is None for k in "bcd") and got["b"].articles is None


def test_process_and_extract_reach_the_stage(spark, tmp_path):
    folder, calls = tmp_path / "in", tmp_path / "calls"
    folder.mkdir(), calls.mkdir()
    for name in ("a", "b", "c"):
        (folder / f"{name}.pdf").write_bytes(b"%PDF-1.7 " + name.encode())
    texts = {b"a": "Nº Factura: F-1\nImporte total: 5,00", b"b": "plain words", b"c": " "}
    read = pdf.reader(lambda data, most: ([texts[data[-1:]]], 1))

    def call(body):
        with open(calls / str(time.time_ns()), "x"):
            pass
        return reply(body, invoiceNumber="M-9", total="8,00")

    model = model_stage.Model(call, str(tmp_path / "store"), tries=1)
    docs = {r.file: r for r in api.process(spark, str(folder), reader=read, model=model).collect()}
    assert (docs["a.pdf"].invoice_number, str(docs["a.pdf"].total)) == ("F-1", "5.00") and (docs["b.pdf"].invoice_number, str(docs["b.pdf"].total)) == ("M-9", "8.00")
    assert docs["c.pdf"].invoice_number is None and len(os.listdir(calls)) == 2
    again = {r.file: r for r in api.process(spark, str(folder), reader=read, model=model, gaps_only=True).collect()}
    assert again["b.pdf"].invoice_number == "M-9" and len(os.listdir(calls)) == 2
    one = model_stage.Model(call, str(tmp_path / "store2"), tries=1)
    api.process(spark, str(folder), reader=read, model=one, gaps_only=True).collect()
    assert len(os.listdir(calls)) == 3
    got = {r.file: r for r in api.extract(pdf.scan_folder(spark, str(folder)), reader=read, model=model).collect()}
    assert json.loads(got["a.pdf"].structured)["fields"]["invoiceNumber"] == "M-9" and got["c.pdf"].structured is None and got["a.pdf"].envelope.text.startswith("Nº")
    assert documents.lacks_fields(F.struct("invoice_number", "total")) is not None


def said_by_a_model(body):
    return reply(body, invoiceNumber="M-9", total="8,00")


def read_aloud(data, language):
    return ["Nº Factura: OCR-1"] if language == "eng" else []


def test_the_command_line_renames_and_asks(spark, tmp_path, capsys):
    from ledgerleaf.__main__ import main

    folder = tmp_path / "in"
    folder.mkdir()
    page = "%PDF-1.7\n1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj\n2 0 obj <</Type/Pages/Kids[3 0 R]/Count 1>> endobj\n3 0 obj <</Type/Page/Parent 2 0 R/Contents 4 0 R>> endobj\n4 0 obj <<>>\nstream\nBT (TEXT) Tj ET\nendstream endobj\n"
    for name, text in (("one", "words"), ("M-9", "others"), ("scan", " ")):
        (folder / f"{name}.pdf").write_bytes(page.replace("TEXT", text).encode("latin-1"))
    main([str(folder), "--out", str(tmp_path / "out"), "--rename", "--pattern", "{numero}", "--ocr", f"{__name__}:read_aloud", "--llm", f"{__name__}:said_by_a_model", "--store", str(tmp_path / "store")])
    assert "moves" in capsys.readouterr().out
    # The file that has its name already keeps it; numbers that rules find come before a model's.
    assert sorted(os.listdir(folder)) == ["M-9-1.pdf", "M-9.pdf", "OCR-1.pdf"]
    table = "".join(open(tmp_path / "out" / f).read() for f in sorted(os.listdir(tmp_path / "out")) if f.startswith("part-"))
    assert all(f"\n{f}," in table for f in os.listdir(folder))
    with pytest.raises(SystemExit):
        main([str(folder), "--llm", f"{__name__}:said_by_a_model"])
