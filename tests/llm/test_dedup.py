"""Exact and near dedup against brute force."""

import hashlib
import random

import pytest

from ledgerleaf.llm import near_dedup as nd
from ledgerleaf.llm.exact_dedup import drop_exact_copies, exact_dedup
from ledgerleaf.llm.near_dedup import drop_near_copies, near_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, part int, label string, id long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0, "x", 7) for i, t in rows], SCHEMA)


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    return {k: (max((x for x in v if x is not None), default=None), len(v)) for k, v in groups.items()}


@pytest.mark.parametrize("n_parts", [1, 7])
def test_exact_against_brute_force(spark, n_parts):
    rng = random.Random(n_parts)
    words = ["", None, "a", "A", "ä", "Ä", "same text", "SAME text", "x" * 5000]
    rows = [(k, rng.choice(words)) for k in range(400)] + [(k, "hot") for k in range(1000, 1400)] + [(None, "a"), (None, "lonely"), (5, "twice"), (5, "twice")]
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(n_parts))
    try:
        got = exact_dedup(frame(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = brute_exact(rows)
    sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
    assert len(got) == len(rows)
    assert all((r.keep_id, r.group_size) == sha[r.text_sha256] for r in got)
    kept = [r for r in got if r.kept]
    assert sorted(r.text_sha256 for r in kept) == sorted(sha)
    assert all(r.doc_id == r.keep_id for r in kept)


def test_exact_smallest_and_dropping(spark):
    rows = [(3, "a"), (1, "A"), (2, "b"), (2, "b"), (None, "a"), (4, None), (9, "")]
    got = {(r.doc_id, r.text_sha256): r for r in exact_dedup(frame(spark, rows), keep="smallest").collect()}
    assert {r.keep_id for r in got.values()} == {1, 2, 4}
    left = drop_exact_copies(frame(spark, rows))
    assert left.columns == ["doc_id", "text", "part", "label", "id"]
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [(2, "b"), (3, "a"), (9, "")]
    assert exact_dedup(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        exact_dedup(frame(spark, rows), keep="any")


CLASHING = "doc_id long, text string, i long, s string, __id long, __sha string, row string, digest string, part int, at long"


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("n_parts,batch", [(1, 10000), (9, 7)])
def test_dropping_exact_copies_against_brute_force(spark, keep, n_parts, batch):
    rng = random.Random(n_parts)
    texts = ["", None, "a", "A", "ä", "Ä", "same text", "SAME text", "x" * 5000]
    rows = [(k, rng.choice(texts)) for k in range(400)] + [(k, "hot") for k in range(1000, 1600)] + [(None, "a"), (None, "lonely"), (5, "twice"), (5, "twice")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, i, "S", i, "u", "r", "d", 1, i) for i, t in rows], CLASHING)
    settings = {"spark.sql.shuffle.partitions": str(n_parts), "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": str(batch)}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        left = drop_exact_copies(df, keep=keep)
        assert left.columns == df.columns
        got = left.collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    best = max if keep == "largest" else min
    assert sorted(((r.text or "").translate(LOWER), r.doc_id) for r in got) == sorted((t, best((x for x in v if x is not None), default=None)) for t, v in groups.items())
    assert all(r["__id"] == r.i == r.at == r.doc_id and (r.s, r["__sha"], r.row, r.digest, r.part) == ("S", "u", "r", "d", 1) for r in got)
    assert drop_exact_copies(df.limit(0), keep=keep).count() == 0


def brute_near(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").translate(LOWER).split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def chains(seed, n_groups=12, length=12):
    """Texts that drift: neighbours are similar, ends of a chain are not."""
    rng = random.Random(seed)
    rows, k = [], 0
    for _ in range(n_groups):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([6, 30, 80, 150]))]
        for _ in range(length):
            rows.append((k * 7 % 1009, " ".join(words)))
            k += 1
            for _ in range(rng.choice([0, 1, 1, 2])):
                words[rng.randrange(len(words))] = f"w{rng.randrange(5000)}"
    return rows


def test_near_against_brute_force(spark):
    rows = chains(1) + [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "one two"), (2004, "ONE  two"), (2005, "two one")]
    got = {r.doc_id: r for r in near_dedup(frame(spark, rows)).collect()}
    want = brute_near(rows)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert len({c for _, c in want.values()}) < len(want) - 50


def test_near_repeats_nulls_and_nothing(spark):
    text = " ".join(f"v{k}" for k in range(40))
    got = near_dedup(frame(spark, [(4, text), (4, text), (2, text + " more"), (None, text), (None, "alone in here")])).collect()
    assert [(r.component_id, r.kept) for r in got if r.doc_id == 4] == [(2, False)] * 2
    assert sorted((str(r.component_id), r.kept) for r in got if r.doc_id is None) == [("2", False), ("None", True)]
    assert near_dedup(frame(spark, [])).count() == 0
    left = drop_near_copies(frame(spark, [(4, text), (2, text + " more"), (3, "other words")]))
    assert sorted(r.doc_id for r in left.collect()) == [2, 3]


def test_estimates_are_corrected_for_chance():
    import numpy as np

    rng = np.random.default_rng(3)
    for share in (0.0, 0.5, 0.75, 1.0):
        guesses = []
        for _ in range(40):
            common, a, b = (rng.integers(0, 2**63, int(n), dtype=np.uint64) for n in (1000 * 2 * share / (1 + share), 1000 * (1 - share) / (1 + share), 1000 * (1 - share) / (1 + share)))
            x, y = (nd.packed(nd.minima(np.unique(np.concatenate([common, z])))) for z in (a, b))
            guesses.append(nd.estimate(nd.equal_slots(x, y)))
        assert abs(np.mean(guesses) - share) < 0.03


TEXT = " ".join(f"v{k}" for k in range(40))
UNLIKE = [(4, TEXT), (4, "quite another text with other words in it"), (2, TEXT + " more"), (None, TEXT), (None, "alone in here"), (None, "alone too"), (9, "x y z"), (9, "x y z"), (7, ""), (7, None)]


def test_ids_that_clash_link_no_unlike_texts(spark):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup(frame(spark, UNLIKE)).collect()), key=str)
    want = [(2, 37, 2, True), (4, 36, 2, False), (4, 4, 4, True), (7, 0, 7, True), (7, 0, 7, True), (9, 1, 9, True), (9, 1, 9, True), (None, 1, None, True), (None, 1, None, True), (None, 36, 2, False)]
    assert got == sorted(want, key=str)


def test_dropping_near_copies_is_by_row(spark):
    df = spark.createDataFrame([(i, t, i, "s", i, "x", "r", "d", 1, 5) for i, t in UNLIKE], CLASHING)
    left = drop_near_copies(df)
    assert left.columns == df.columns
    got = left.collect()
    assert sorted((str(r.doc_id), r.text or "") for r in got) == sorted((str(i), t or "") for i, t in [(2, TEXT + " more"), (4, "quite another text with other words in it"), (None, "alone in here"), (None, "alone too"), (9, "x y z"), (7, ""), (7, None)])
    assert all((r["__id"], r.at, r.row) == (r.doc_id, 5, "r") for r in got)
    assert drop_near_copies(df.limit(0)).count() == 0


def test_a_family_with_a_third_of_all_rows(spark):
    """Its pairs are dealt over salts; a very long text is read whole."""
    rng = random.Random(6)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(300):
        words = list(base)
        words[rng.randrange(120)] = f"z{k}"
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, " ".join(f"u{k}x{j}" for j in range(30))) for k in range(500)] + [(2000 + k, "hot copy of a text in very many rows") for k in range(100)]
    long = [f"l{k}" for k in range(60_000)]
    rows += [(5000, " ".join(long)), (5001, " ".join(long[5:] + ["end"]))]
    got = {r.doc_id: r for r in near_dedup(frame(spark, rows)).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute_near_by_shingle(rows)
    assert sorted(r.doc_id for r in drop_near_copies(frame(spark, rows)).collect()) == sorted(i for i, r in got.items() if r.kept)


def brute_near_by_shingle(rows):
    """As brute_near, for more rows: only pairs that share a shingle are compared."""
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for i, w in ((i, t.split()) for i, t in rows)}
    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in {(min(g[0], i), max(g[0], i)) for g in by.values() for i in g} | {(a, b) for g in by.values() if len(g) < 40 for a in g for b in g if a < b}:
        if a != b and find(a) != find(b) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}
