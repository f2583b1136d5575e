"""Rename plans against a loop over random folders, and the order in which they can be carried out."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerleaf.operators import budget, naming

PLAN = "file string, new_name string"


def loop(rows, existing, reuse=False):
    """One file after the other, in the order of their names."""
    todo = sorted((f, t) for f, t in rows if t is not None and f.lower() != t.lower())
    gone = {f for f, _ in todo}
    used = {f.lower() for f in existing if not (reuse and f in gone)} | {t.lower() for f, t in rows if t is not None and f.lower() == t.lower()}
    out = {}
    for f, t in todo:
        base, n, name = t[:-4], 0, t
        while name.lower() in used:
            n += 1
            name = f"{base}-{n}.pdf"
        used.add(name.lower())
        out[f] = name
    return out


def folder(rng, n):
    stems = ["a", "A", "a-1", "a-2", "a-1-1", "b", "b-1", "c", "a-1-2", "B-01", "a-0", "é"]
    names = sorted({f"{rng.choice(stems)}{rng.choice(['', '-1', '-2', '-3', 'x'])}.pdf" for _ in range(n)} | {f"f{k}.pdf" for k in range(n)})
    rows = [(f, rng.choice([None, f, *[f"{rng.choice(stems)}.pdf"] * 6])) for f in names]
    return rows, names + [f"a-{k}.pdf" for k in rng.sample(range(1, 30), 4) if f"a-{k}.pdf" not in names]


@pytest.mark.parametrize("seed", range(4))
def test_plans_are_those_of_a_loop(spark, seed):
    rng = random.Random(seed)
    rows, names = folder(rng, 25)
    df, there = spark.createDataFrame(rows, PLAN), spark.createDataFrame([(f,) for f in names], "file string")
    for reuse in (False, True):
        got = naming.rename_plan(df, there, reuse_freed=reuse).collect()
        assert {r.file: r.new_name for r in got} == loop(rows, names, reuse) and len(got) == len({r.file for r in got})


def test_many_wishes_and_many_taken_numbers(spark):
    """No task gets much more than its share of one name's rows."""
    n = 20_000
    rows = spark.range(n).select(F.format_string("f%06d.pdf", "id").alias("file"), F.lit("Same.pdf").alias("new_name"))
    there = rows.select("file").union(spark.range(n).select(F.concat(F.lit("same-"), (F.col("id") * 2 + 1).cast("string"), F.lit(".pdf"))))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = naming.rename_plan(rows, there).orderBy("file").collect()
        ranged = naming.running_sum(rows.select(F.lit("x").alias("b"), "file", F.lit(1).alias("one")), "b", ["file"], "one")
        parts = [r.c for r in ranged.groupBy(F.spark_partition_id()).agg(F.count("*").alias("c")).collect()]
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert [r.new_name for r in got[:4]] == ["Same.pdf", "Same-2.pdf", "Same-4.pdf", "Same-6.pdf"]
    assert [r.new_name for r in got] == ["Same.pdf", *(f"Same-{2 * k}.pdf" for k in range(1, n))]
    assert max(parts) < n / 2


def carried_out(order, names):
    there = set(names)
    low = {f.lower() for f in there}
    for _, f, new in sorted(order):
        assert f in there and new.lower() not in low, (f, new)
        there.remove(f), low.remove(f.lower())
        there.add(new), low.add(new.lower())
    return there


def test_chains_and_rings_in_order(spark):
    chain = [(f"n{k:03d}.pdf", f"n{k + 1:03d}.pdf") for k in range(37)]
    ring = [("x.pdf", "y.pdf"), ("y.pdf", "z.pdf"), ("z.pdf", "x.pdf"), ("p.pdf", "q.pdf"), ("q.pdf", "p.pdf"), ("same.pdf", "same.pdf"), ("free.pdf", "new.pdf")]
    plan = spark.createDataFrame(chain + ring, PLAN)
    order = [(r.step, r.file, r.new_name) for r in naming.rename_order(plan).collect()]
    assert len(order) == len(chain) + 5 + 2 + 1
    assert carried_out(order, [f for f, _ in chain + ring]) == {t for _, t in chain + ring}
    assert naming.rename_order(plan.limit(0)).count() == 0


@pytest.mark.parametrize("seed", (10, 11))
def test_freed_names_are_used_again(spark, seed):
    rng = random.Random(seed)
    names = [f"{c}.pdf" for c in "abcdefghijklmno"]
    rows = list(zip(names, rng.sample(names, len(names)), strict=True)) + [("w.pdf", "a.pdf")]
    there = [f for f, _ in rows]
    plan = naming.rename_plan(spark.createDataFrame(rows, PLAN), spark.createDataFrame([(f,) for f in there], "file string"), reuse_freed=True)
    want = loop(rows, there, True)
    assert {r.file: r.new_name for r in plan.collect()} == want
    order = [(r.step, r.file, r.new_name) for r in naming.rename_order(plan).collect()]
    assert carried_out(order, there) == {want.get(f, f) for f in there}


def test_no_page_is_lost(spark):
    rows = [("d", 1, "one"), ("d", 5, "five"), ("d", 9, "nine"), ("e", 2, "b"), ("e", 2, "a"), ("e", None, "last"), ("e", 1, None), ("e", None, None), (None, 3, "x")] + [("f", k, f"p{k}") for k in range(9, 0, -1)]
    got = {r.doc: (r.declared, r.pages) for r in budget.gather_pages(spark.createDataFrame(rows, "doc string, page int, text string"), "doc", "page", "text", 4).collect()}
    assert got == {"d": (3, ["one", "five", "nine"]), "e": (5, [None, "a", "b", "last"]), "f": (9, ["p1", "p2", "p3", "p4"]), None: (1, ["x"])}


def test_as_many_rounds_as_the_longest_ring_needs(spark, monkeypatch):
    """Many short rings: the rounds don't grow with their number, and no path is broadcast."""
    written = []
    monkeypatch.setattr(naming, "staged", lambda df, name, real=naming.staged: (written.append(name), real(df, name))[1])
    n = 4000
    name = lambda c: F.format_string("r%05d.pdf", c)
    k = F.col("id")
    plan = spark.range(n).select(name(k).alias("file"), name(F.when(k % 4 == 3, k - 3).otherwise(k + 1)).alias("new_name"))
    order = [(r.step, r.file, r.new_name) for r in naming.rename_order(plan).collect()]
    assert written.count("rename-paths") <= 12
    assert carried_out(order, [f"r{j:05d}.pdf" for j in range(n)]) == {f"r{j:05d}.pdf" for j in range(n)}


@pytest.mark.parametrize("block", (3, 16384))
def test_only_names_that_are_wished_for_are_looked_at(spark, monkeypatch, block):
    """Numbers of other names are not dealt with; blocks of numbers, however small, give what a loop gives."""
    rng = random.Random(block)
    rows = [(f"f{k:03}.pdf", f"{rng.choice(['x', 'X', 'y', 'y-z'])}.pdf") for k in range(60)]
    names = [f for f, _ in rows] + [f"x-{k}.pdf" for k in (*range(1, 12), *range(20, 90, 7))] + ["y.pdf", "y-2.pdf", "Y-Z-40.pdf"] + [f"other-{k}.pdf" for k in range(1, 301)]
    written = {}

    def counted(df, name, made=naming.staged):
        out = made(df, name)
        written[name] = max(out.count(), written.get(name, 0))
        return out

    monkeypatch.setattr(naming, "staged", counted)
    monkeypatch.setattr(naming, "BLOCK", block, raising=False)
    got = naming.rename_plan(spark.createDataFrame(rows, PLAN), spark.createDataFrame([(f,) for f in names], "file string")).collect()
    assert {r.file: r.new_name for r in got} == loop(rows, names) and len(got) == len(rows)
    assert written["rename-taken"] == 24
