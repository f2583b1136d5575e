"""One file written by many tasks, and lines of any length."""

import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerleaf.operators import sinks
from ledgerleaf.sources import files, uploads


def articles(spark, n):
    docs = spark.range(n).select(F.concat(F.lit("f"), F.lpad((F.col("id") / 3).cast("int").cast("string"), 4, "0")).alias("file"), (F.col("id") % 3).cast("int").alias("pos"))
    return docs.select("file", "pos", *[F.concat(F.lit(f"{c}, "), F.col("pos").cast("string")).alias(c) if c in ("vendor", "description") else F.lit(1).cast("decimal(12,2)").alias(c) for c in sinks.COLUMNS if c != "file"])


def whole(folder):
    """The bytes of the one part that Spark's own writer makes."""
    (part,) = [f for f in os.listdir(folder) if f.startswith("part-")]
    return open(os.path.join(folder, part), "rb").read()


@pytest.mark.parametrize("n", (0, 1, 600))
def test_a_file_is_what_one_task_would_write(spark, tmp_path, n):
    table = articles(spark, n).repartition(7)
    for bom in (False, True):
        sinks.write_csv(table, str(tmp_path / f"one-{bom}"), bom=bom, single=True)
        sinks.write_csv_file(table, str(tmp_path / "many.csv"), bom=bom)
        # Of a table without rows the one task writes nothing, not even the header.
        head = ("\ufeff" if bom else "") + ",".join(sinks.R.CSV_HEADER) + "\n"
        assert (tmp_path / "many.csv").read_bytes() == (whole(tmp_path / f"one-{bom}") or head.encode())
    docs = table.select("file", "pos", "vendor").filter("pos = 0")
    sinks.write_json_array(docs, str(tmp_path / "json"))
    sinks.write_json_file(docs, "file://" + str(tmp_path / "docs.json"))
    assert (tmp_path / "docs.json").read_bytes() == whole(tmp_path / "json")
    assert len(json.loads((tmp_path / "docs.json").read_text())) == docs.count()
    assert sorted(f for f in os.listdir(tmp_path) if "parts" in f) == []


def test_a_failed_task_leaves_what_was_there(spark, tmp_path):
    path = tmp_path / "x.csv"
    sinks.write_csv_file(articles(spark, 30), str(path))
    before = path.read_bytes()
    bad = articles(spark, 300).withColumn("vendor", F.when((F.col("file") == "f0090") & (F.rand() < 2), F.raise_error(F.lit("bad row"))).otherwise(F.col("vendor")))
    with pytest.raises(Exception, match="bad row"):
        sinks.write_csv_file(bad, str(path))
    assert path.read_bytes() == before and os.listdir(tmp_path) == ["x.csv"]
    fragments = files.OneFileWriter(str(tmp_path / "y"), "", "", "", "", True)
    os.makedirs(fragments.own)
    fragments.abort([None])
    assert os.listdir(tmp_path) == ["x.csv"]
    with pytest.raises(FileExistsError):
        files.OneFileWriter(str(path), "", "", "", "", False)


def test_lines_up_to_a_cap(spark, tmp_path):
    texts = ["", "a", "é" * 10, "x" * 50, "y" * 51, "z" * 5000, "last"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one").write_text("\n".join(texts))
    (tmp_path / "in" / "two").write_bytes(b"r\r\nbad \xff byte\n" + b"w" * 300 + b"\n")
    (tmp_path / "in" / "empty").write_text("")
    (tmp_path / "in" / "_hidden").write_text("no")
    data = {n: (tmp_path / "in" / n).read_bytes() for n in ("one", "two")}
    want = []
    for name, raw in data.items():
        at = 0
        for line in raw.split(b"\n") if not raw.endswith(b"\n") else raw[:-1].split(b"\n"):
            want.append((name, at, None if len(line) > 50 else line.removesuffix(b"\r").decode("utf-8", "replace")))
            at += len(line) + 1
    for split, chunk in ((1 << 20, 1 << 16), (64, 16), (7, 3), (1, 1)):
        got = files.read_lines(spark, str(tmp_path / "in"), 50, split, chunk).collect()
        assert sorted((os.path.basename(r.path), r.offset, r.value) for r in got) == sorted(want, key=lambda x: x[:2]), (split, chunk)
        assert max(r.seen for r in got) <= 51
    assert files.read_lines(spark, str(tmp_path / "in" / "empty"), 50).count() == 0


def test_a_very_long_request_is_a_row(spark, tmp_path):
    path = tmp_path / "requests.jsonl"
    with open(path, "wb") as f:
        f.write(b'{"name":"a","payload":"eA=="}\n')
        f.write(b'{"name":"big","payload":"')
        for _ in range(64):
            f.write(b"A" * (1 << 20))
        f.write(b'"}\n\n{"name":"b"}\nnot json\n')
    got = uploads.read_requests(spark, str(path), most=1000).collect()
    assert sorted((r.error or "", r.request and r.request.name or "", bytes(r.content or b"")) for r in got) == [("", "a", b"x"), ("", "b", b""), ("invalid_json", "", b""), ("request_empty", "", b""), ("request_too_large", "", b"")]
