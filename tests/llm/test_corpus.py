"""Mixing, packing, the classifier, archives and the pipeline."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerleaf.llm import mixing, packing, quality_model, warc
from ledgerleaf.llm.common import shared_path

SCHEMA = "doc_id long, text string, source string, size int, at string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "x") for i, t, s in rows], SCHEMA)


def mixed_rows(seed=1):
    rng = random.Random(seed)
    rows = [(k, " ".join("w" for _ in range(rng.randrange(0, 90))), rng.choice(["a", "b", "b", "b", "b", "c", "é", None])) for k in range(600)]
    return rows + [(7, "one two", "a"), (7, "one two", "a"), (None, "n n n", "b"), (900, None, "z"), (901, "", "z"), (902, "x" * 9 + " y" * 9000, "c")]


def brute_targets(rows):
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len((t or "").split())
    names = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in size else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, full, left = dict.fromkeys(names, 0.0), set(), 1.5 * sum(size.values())
    while left > 1e-9:
        live = [s for s in names if s not in full]
        w = sum(weight[s] for s in live)
        for s in live:
            target[s] += left * weight[s] / w
        left = 0.0
        for s in live:
            if target[s] >= 2 * size[s]:
                left += target[s] - 2 * size[s]
                target[s] = 2.0 * size[s]
                full.add(s)
    return size, target


def test_mix_against_brute_force(spark):
    rows = mixed_rows()
    got = mixing.mix(frame(spark, rows)).collect()
    size, target = brute_targets(rows)
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in rows)
    by_id = {i: s for i, _, s in rows}
    taken = defaultdict(int)
    for r in got:
        s = by_id[r.doc_id]
        assert r.source_size == size[s] and abs(r.target - target[s]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in size:
        assert taken[s] == int(target[s] + 0.5), s
    assert all((r.first_slot == -1) == (r.taken == 0) for r in got)
    again = mixing.mix(frame(spark, rows).repartition(3)).collect()
    assert sorted((str(r.doc_id), r.size, r.taken, r.first_slot) for r in again) == sorted((str(r.doc_id), r.size, r.taken, r.first_slot) for r in got)
    assert mixing.mix(frame(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(frame(spark, [(1, None, None)])).collect()] == [0]


def test_mix_of_many_sources_and_its_order(spark):
    rng = random.Random(12)
    rows = [(k, " ".join("w" for _ in range(rng.randrange(1, 40))), f"host{rng.randrange(3000)}") for k in range(6000)]
    got = mixing.mix(frame(spark, rows)).collect()
    size, target = brute_targets(rows)
    assert all(abs(r.target - target[rows[r.doc_id][2]]) < 1e-6 for r in got)
    taken = Counter()
    for r in got:
        taken[rows[r.doc_id][2]] += r.taken
    assert all(taken[s] == int(target[s] + 0.5) for s in target)
    df = spark.createDataFrame([(k, f"x\n\n{t}\ty", s, "c", 1, 2) for k, t, s in rows[:300]], "doc_id long, text string, source string, size string, row int, start int")
    out = mixing.mixed_documents(df, slot_col="slot")
    assert out.columns == [*df.columns, "slot"]
    assert all(r.slot is not None and (r.size, r.row, r.start) == ("c", 1, 2) and r.text.startswith(("x\n\nw", "x")) for r in out.collect())
    assert mixing.mixed_documents(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mixed_documents(df, slot_col="row")


def test_mixed_documents_hold_what_is_taken(spark):
    rows = mixed_rows(2)
    rows = [(k, t, s) for k, (_, t, s) in enumerate(rows)]
    taken = {r.doc_id: r.taken for r in mixing.mix(frame(spark, rows)).collect()}
    out = mixing.mixed_documents(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "source", "size", "at"]
    words = defaultdict(int)
    for r in out.collect():
        words[r.doc_id] += len(r.text.split())
    assert dict(words) == {k: v for k, v in taken.items() if v}


def test_small_sources_meet_their_targets_beside_large_ones(spark, monkeypatch):
    """Sources of 1 to 500 words beside large ones, null ids of one size among them: each gives its target to the word."""
    sizes = {f"s{n:03d}": n for n in (1, 2, 3, 7, 20, 40, 65, 93, 130, 200, 255, 258, 400, 500)} | {"large": 60_000, "larger": 150_000, None: 90}
    rows = []
    for s, n in sizes.items():
        docs = [1] * n if n < 4 else [n // 3, n // 3, n - 2 * (n // 3)] if n < 1000 else [500] * (n // 500)
        rows += [(None if k % 2 else len(rows) + k, "w " * m, s) for k, m in enumerate(docs)]
    brute_size, target = brute_targets(rows)
    assert brute_size == sizes
    got = mixing.mix(frame(spark, rows))
    by_source = spark.createDataFrame([(n, s) for s, n in sizes.items()], "n long, s string")
    taken = {r.s: r.taken for r in got.groupBy("source_size").agg(F.sum("taken").alias("taken")).join(by_source, F.col("source_size") == F.col("n")).collect()}
    assert all(taken[s] == int(target[s] + 0.5) for s in sizes)
    words = Counter()
    for r in mixing.mixed_documents(frame(spark, rows)).collect():
        words[r.source] += len(r.text.split())
    assert all(words[s] == int(target[s] + 0.5) for s in sizes)


def brute_slots(targets, words=mixing.BLOCK_WORDS):
    """(slot, nr, rank): each point of the sequence to the source in whose share it falls."""
    total, out, seen = sum(t for _, t in targets), [], Counter()
    n = -(-total // words)
    for i in range(int(n)):
        point, upto = i * mixing.GOLDEN % 1, 0.0
        for nr, t in targets:
            upto += t
            if point < upto / total or nr == targets[-1][0]:
                out.append((i, nr, seen[nr]))
                seen[nr] += 1
                break
    before = 0.0
    for nr, t in targets:
        if not seen[nr] and int(t + 0.5):
            out.append((int(before / total * n), nr, 0))
        before += t
    return sorted(out)


def test_every_prefix_of_the_schedule_follows_the_shares(spark):
    schema = "nr long, source string, source_size long, target double, total long"
    targets = mixing.staged(spark.createDataFrame([(1, "a", 60_000, 90_000.0, 200_000), (2, "b", 140_000, 210_000.0, 200_000)], schema), "test-targets")
    slots = sorted((r.slot, r.nr, r["rank"]) for r in mixing.slot_schedule(targets).collect())
    assert slots == brute_slots([(1, 90_000.0), (2, 210_000.0)])
    seen = Counter()
    for k, (_, nr, rank) in enumerate(slots, 1):
        assert rank == seen[nr]
        seen[nr] += 1
        assert abs(seen[1] - 0.3 * k) < 4
    many = [(k, float(k % 7)) for k in range(1, 60)] + [(60, 5000.0)]
    targets = mixing.staged(spark.createDataFrame([(nr, str(nr), 1, t, 1) for nr, t in many], schema), "test-targets")
    assert sorted((r.slot, r.nr, r["rank"]) for r in mixing.slot_schedule(targets).collect()) == brute_slots(many)


def test_a_document_begins_in_the_block_of_its_first_word(spark):
    rows = [(k, "w " * (17 + k % 60), s) for k, s in enumerate("aabbbbbbbbcbbabbbbbbbb" * 8)]
    got = {r.doc_id: r for r in mixing.mix(frame(spark, rows)).collect()}
    size, target = brute_targets(rows)
    names = sorted(size)
    slots = brute_slots([(nr, target[s]) for nr, s in enumerate(names)])
    for nr, s in enumerate(names):
        own = [slot for slot, n, _ in slots if n == nr]
        words, start = int(target[s] + 0.5), 0
        ends = [(r + 1) * words // len(own) for r in range(len(own))]
        for k, n in sorted(((k, len(t.split())) for k, t, x in rows if x == s), key=lambda x: hashlib.md5(str(x[0]).encode()).hexdigest()):
            want = sum(max(0, min(start + p * size[s] + n, words) - (start + p * size[s])) for p in (0, 1))
            assert got[k].taken == want
            if want:
                assert got[k].first_slot == own[next(r for r, e in enumerate(ends) if e > start)]
            start += n


def test_pack_invariants():
    rng = random.Random(8)
    for lengths in ((16,), (8, 16, 64), (4, 7, 50)):
        sizes = [min(lengths[-1], max(1, int(rng.lognormvariate(2, 1)))) for _ in range(2000)]
        bins, place, final, filled = packing.pack(sizes, lengths)
        by = defaultdict(list)
        for k, b in enumerate(bins):
            by[b].append((place[k], sizes[k]))
        for b, parts in by.items():
            at = 0
            for p, s in sorted(parts):
                assert p == at
                at += s
            assert at == filled[b] <= final[b] and final[b] == min(n for n in lengths if n >= at)
    sizes = [min(4096, max(1, int(rng.lognormvariate(5.5, 1.1)))) for _ in range(5000)]
    price = lambda lengths: sum(map(packing.cost, packing.pack(sizes, lengths)[2]))
    assert price(packing.LENGTHS) < 0.95 * price(packing.LENGTHS[-1:])
    assert packing.pack([], (8,)) == ([], [], [], [])


def least_cost(sizes, lengths):
    """By trying every way to part the items into sequences."""

    def ways(items):
        if not items:
            yield []
            return
        first, rest = items[0], items[1:]
        for k in range(len(rest) + 1):
            for others in itertools.combinations(range(len(rest)), k):
                for more in ways([x for j, x in enumerate(rest) if j not in others]):
                    yield [first + sum(rest[j] for j in others), *more]

    longest = max(lengths)
    return min(sum(packing.cost(next(n for n in sorted(lengths) if n >= s)) for s in way) for way in ways(list(sizes)) if max(way) <= longest)


def test_packing_is_close_to_the_least_cost():
    rng, shares = random.Random(4), []
    for _ in range(150):
        lengths = rng.choice([(8, 16, 32), (5, 12, 20), (256, 512, 1024, 2048, 4096)])
        sizes = [rng.randrange(1, lengths[-1] + 1) // rng.choice([1, 2, 4, 8]) or 1 for _ in range(rng.randrange(1, 8))]
        shares.append(sum(map(packing.cost, packing.pack(sizes, lengths)[2])) / least_cost(sizes, lengths))
    assert min(shares) >= 1 - 1e-9 and max(shares) <= 1.6 and sum(shares) / len(shares) <= 1.06, (max(shares), sum(shares) / len(shares))


def test_packing_is_the_same_however_rows_are_split(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(400), "w " * rng.randrange(0, 90), "s") for _ in range(900)] + [(7, "w " * 30, "s")] * 300 + [(None, "w w", "s")] * 5 + [(2**60 + 1, "w " * 70_000, "s")]
    rows_of = lambda df: sorted(map(str, packing.pack_documents(df, lengths=(16, 64), shard_rows=100).collect()))
    first = rows_of(frame(spark, rows))
    rng.shuffle(rows)
    assert rows_of(frame(spark, rows).repartition(5)) == first
    assert sum(f"doc_id={2**60 + 1}," in r for r in first) == -(-70_000 // 64)
    named = spark.createDataFrame([("b", "w w"), ("a", "w"), (None, "w")], "doc_id string, text string")
    assert sorted(str(r.doc_id) for r in packing.pack_documents(named).collect()) == ["None", "a", "b"]


def test_pack_documents(spark):
    rows = [(k, " ".join("w" * 3 for _ in range(n)), "s") for k, n in enumerate([0, 1, 5, 63, 64, 65, 200, 3, 3, 3])] + [(3, "a b", "s"), (None, "x y z", "s"), (77, None, "s")]
    got = packing.pack_documents(frame(spark, rows), lengths=(8, 64), shard_rows=4).collect()
    words, bins = defaultdict(int), defaultdict(list)
    for r in got:
        words[r.doc_id] += r.n_words
        bins[r.seq_id].append(r)
    want = defaultdict(int)
    for i, t, _ in rows:
        want[i] += len((t or "").split())
    assert dict(words) == {k: v for k, v in want.items() if v}
    for parts in bins.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.place):
            assert r.place == at
            at += r.n_words
        assert at == parts[0].seq_words <= parts[0].seq_length and parts[0].seq_length in (8, 64)
    assert packing.pack_documents(frame(spark, [])).count() == 0


def test_classifier_on_held_out_rows(spark, small):
    documents, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    extra = spark.createDataFrame([(10**9, None), (10**9 + 1, ""), (None, "text")], "doc_id long, text string")
    got = {r.doc_id: r for r in quality_model.quality_scores(documents.select("doc_id", "text").union(extra), labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items() if i is not None)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    tested = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if r.doc_id in got and got[r.doc_id].held_out]
    assert np.mean([a == b for a, b in tested]) > 0.85
    assert got[10**9].score == got[10**9 + 1].score


def test_classifier_without_labels(spark):
    d = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_model.quality_scores(d, none).collect()} == {0.5}


def test_scoring_in_pieces_is_the_same(monkeypatch):
    rng = random.Random(3)
    data = " ".join(rng.choice(["and", "and", "word", "ÉTÉ!!", "x***"]) for _ in range(3000)).encode()
    net = quality_model.ByteNetwork()
    whole = net.score(data)
    monkeypatch.setattr(quality_model, "PIECE_BYTES", 4 * quality_model.HALF)  # and training pools the same places
    assert net.score(data) == pytest.approx(whole, abs=1e-5)
    assert 0 < net.score(b"") < 1 and 0 < net.score(b"a") < 1


def slow_score(net, data):
    """The network as it is described, one byte, filter and chunk after the other."""
    half, width = quality_model.HALF, quality_model.WIDTH
    n = max(1, -(-len(data) // half))
    inputs = [*data, *[quality_model.PAD] * (n * half + width - len(data))]
    chunks = [range(k * half, (k + 2) * half) for k in range(n - 1)] or [range(half)]
    pooled = np.array([[max(0.0, max(sum(float(net.tables[k, inputs[at + k], f]) for k in range(width)) for at in chunk) + float(net.bias[f])) for f in range(quality_model.FILTERS)] for chunk in chunks])
    z = pooled.mean(axis=0) @ net.mean_w + pooled.max(axis=0) @ net.max_w + net.offset[0]
    return 1 / (1 + np.exp(-z))


def test_scores_against_a_slow_convolution():
    rng = np.random.default_rng(4)
    net = quality_model.ByteNetwork()
    net.bias += 0.05
    for n in (0, 1, 255, 256, 257, 700):
        data = bytes(rng.integers(0, 256, n, dtype=np.uint8))
        assert net.score(data) == pytest.approx(slow_score(net, data), abs=1e-5)


def test_gradients_against_finite_differences():
    rng = np.random.default_rng(1)
    net = quality_model.ByteNetwork()
    net.tables = net.tables.astype(np.float64)
    net.bias += 0.1
    parts, y = [quality_model.codes(bytes(rng.integers(97, 110, n, dtype=np.uint8))) for n in (0, 5, 300, 1500)], np.array([1.0, 0, 1, 0])

    def loss():
        z = np.array([net.logits(np.maximum(v + net.bias, 0), np.array([len(v)]))[0][0] for v, _ in map(net.pooled, parts)])
        p = 1 / (1 + np.exp(-z))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for values, grad in zip(net.params(), net._gradients(parts, y), strict=True):
        for at in map(tuple, np.argwhere(np.abs(grad) > np.abs(grad).max() / 3)[:5]):
            old, e = values[at], 1e-3
            values[at] = old + e
            up = loss()
            values[at] = old - e
            down = loss()
            values[at] = old
            assert grad[at] == pytest.approx((up - down) / (2 * e), rel=0.01)


def test_scores_know_nothing_of_held_out_labels_or_other_columns(spark, small):
    documents, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    held = "crc32(cast(doc_id AS string)) % 3 = 1"
    turned = labels.withColumn("quality", F.when(F.expr(held), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = documents.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("yy")).withColumn("score", F.lit(0.5)).withColumn("data", F.lit("z"))
    scores = lambda d, l: sorted((r.doc_id, r.score) for r in quality_model.quality_scores(d, l).collect())  # noqa: E731, E741
    first = scores(documents, labels)
    assert scores(other, turned) == first
    assert quality_model.quality_scores(documents.limit(0), labels).count() == 0
    twice = quality_model.quality_scores(documents.unionByName(documents), labels)
    assert sorted((r.doc_id, r.score) for r in twice.collect()) == sorted([*first, *first])


def test_the_sample_is_bounded_in_bytes_and_not_by_length(spark):
    rows = [(k, ("good words here " if k % 2 else "bad!!! ") * (2000 if k % 5 == 0 else 3)) for k in range(200)]
    d, l = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, quality int")  # noqa: E741
    every, _ = quality_model.training_rows(d, l, "doc_id", "text", "quality", 900, 1 << 30)
    some, y = quality_model.training_rows(d, l, "doc_id", "text", "quality", 900, 100_000)
    assert 0 < len(some) < len(every) and max(map(len, some)) == max(map(len, every)) and set(y.tolist()) == {0.0, 1.0}


def archive_rows():
    long = "payload é " * 20
    return [(5, "http://a/ b", long), (3, "http://b", long), (9, None, long), (3, "http://b", long), (1, "u", "short"), (2, "u\r\nX: y", "short"), (4, "u", None), (None, "u", "z" * 200), (8, "u", "z" * 200), (6, "u", "a\r\n\r\nWARC/1.1\r\n" * 20)]


def test_archive_round_trip(spark, monkeypatch):
    rows = archive_rows()
    df = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string")
    got = warc.archive_pages(df).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.page_id].append((r.record_type, r.refers_to))
    assert by[5] == [("revisit", 3)] and by[9] == [("revisit", 3)]
    assert sorted(by[3], key=str) == [("response", None), ("revisit", 3)]
    assert by[1] == by[2] == by[4] == by[6] == by[8] == [("response", None)] and by[None] == [("revisit", 8)]
    path = warc.write_archive(df, shared_path(spark, "test"))
    assert spark.read.parquet(f"{path}/payloads").count() == 5
    back = warc.read_archive(spark, path)
    assert all((r.payload is None) == ("WARC-Type: revisit" in r.header) for r in back.collect())
    for batch in (4096, 2):
        monkeypatch.setattr(warc, "COPIES_TOGETHER", batch)
        full = warc.full_payloads(spark, path).collect()
        assert sorted(((r.page_id or 0), bytes(r.payload).decode()) for r in full) == sorted(((i or 0), t or "") for i, _, t in rows)
    assert len({re.search("WARC-Record-ID: (.*)", r.header)[1] for r in full}) == len(rows)
    out = shared_path(spark, "files")
    warc.export_warc(back, out)
    read = warc.import_warc(spark, out).collect()
    assert len(read) == len(rows)
    for r in read:
        assert r.header.startswith("WARC/1.1\r\n") and ("WARC-Type: revisit" in r.header) == (not bytes(r.block).split(b"\r\n\r\n", 1)[1] and "Content-Length: 0" not in bytes(r.block).decode())


def test_archive_of_text_ids_and_of_nothing(spark):
    text = "p" * 150
    df = spark.createDataFrame([("b/é> x", "u", text), ("a", "u", text), ("a", "u", text), (None, "u", text), ("", "u", "q" * 200)], "page_id string, url string, html string")
    got = sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes) for r in warc.archive_pages(df).collect())
    assert got == [("", "response", None, 200), ("None", "revisit", "a", 150), ("a", "response", None, 150), ("a", "revisit", "a", 150), ("b/é> x", "revisit", "a", 150)]
    blank = spark.createDataFrame([("", "u", text), ("z", "u", text), (None, "u", text)], df.schema)
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.archive_pages(blank).collect()) == [("", "response", None), ("None", "revisit", ""), ("z", "revisit", "")]
    odd = spark.createDataFrame([("x/y> é", "u", text), ("z", "u", text)], "page_id string, url string, html string")
    assert [r.refers_to for r in warc.archive_pages(odd).collect() if r.refers_to] == ["x/y> é"]
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_damage_is_noticed(spark):
    df = spark.createDataFrame([(1, "u", "t" * 150)], "page_id long, url string, html string")
    path = warc.write_archive(df, shared_path(spark, "test"))
    bad = spark.read.parquet(f"{path}/payloads").selectExpr("digest", "cast('other' as binary) payload").collect()
    spark.createDataFrame(bad, "digest string, payload binary").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="damaged"):
        warc.parsed(warc.read_archive(spark, path)).collect()


def test_sql_of_the_queries(spark, small):
    from ledgerleaf.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    for name, sql in ORACLES.items():
        a, b = QUERIES[name](spark, small).toPandas(), con.execute(sql).df()
        assert sorted(a.columns) == sorted(b.columns), name
        cols = sorted(a.columns)
        rows = lambda d: sorted(tuple("-" if pd.isna(x) else f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in d[cols].itertuples(index=False))  # noqa: B023, E731
        assert rows(a) == rows(b), name


def test_pipeline_of_odd_rows_and_of_nothing(spark, small):
    """Null texts and ids, repeated rows and further columns with any name; each stage also without rows."""
    import corpus_pipeline as p

    good = "\n".join(" ".join(f"{w}{k}" for k in range(12)) + "." for w in ("some", "other", "last"))
    rows = [(1, good, "en", "s", len(good), 5), (1, good, "en", "s", len(good), 5), (None, good, None, None, None, None), (None, None, "en", "s", 0, 1), (2, "", "en", "t", 0, 1), (None, good.replace("some3", "any"), "en", "t", 9, 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, __id int"
    docs = spark.createDataFrame(rows, schema)
    for name, stage in p.STAGES:
        assert stage(spark, docs.limit(0), small).count() == 0, name
    for name, stage in p.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, small).collect(), schema)
        assert docs.count() > 0, name
    assert {r.doc_id for r in docs.collect()} == {1}
    assert {r.doc_id for r in p.STAGES[-1][1](spark, docs, small).collect()} == {1}


def test_pipeline_stage_by_stage(spark, small):
    import corpus_pipeline as p

    from tests.llm.test_dedup import LOWER, brute_near

    docs = spark.read.parquet(f"{small}/documents.parquet")
    seen = {}
    columns = docs.columns
    for name, stage in p.STAGES:
        before = docs.collect()
        out = stage(spark, docs, small)
        path = shared_path(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = (before, docs.collect())
        if name != p.STAGES[-1][0]:
            assert docs.columns == columns
            assert all(len(r.text) == r.n_chars for r in seen[name][1] if name in ("quality_rules", "source_mixing"))
    before, after = seen["quality_rules"]
    assert 0 < len(after) < len(before)
    before, after = seen["exact_dedup"]
    best = {}
    for r in before:
        k = r.text.translate(LOWER)
        best[k] = max(best.get(k, -1), r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(best.values())
    before, after = seen["minhash_near_dedup"]
    assert sorted(r.doc_id for r in after) == sorted({c for _, c in brute_near([(r.doc_id, r.text) for r in before]).values()})
    before, after = seen["source_mixing"]
    _, target = brute_targets([(r.doc_id, r.text, r.source) for r in before])
    taken = defaultdict(int)
    for r in after:
        taken[r.source] += len(r.text.split())
    assert all(taken[s] == int(target[s] + 0.5) for s in target)
    before, after = seen["best_fit_packing"]
    words, packed = Counter(), Counter()
    for r in before:
        words[r.doc_id] += len(r.text.split())
    for r in after:
        packed[r.doc_id] += r.n_words
    assert packed == +words
    assert p.run(spark, small).count() == len(after)
