"""Toxicity by compression, the audit of filters, and the divergence of sources."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from ledgerleaf.llm import divergence, filter_audit, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, id int, n string, part string, mask int, term string"
LABELS = "doc_id long, quality int, toxic int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, s, 1, "x", "p", 3, "t") for i, t, g, s in rows], SCHEMA)


# Toxicity.

PARTS = "an the re on ti sh le mo ka ri so ul en ver ing pa".split()


def writing(rng, n, bad=()):
    words = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 4))) for _ in range(n)]
    for w in bad:
        words.insert(rng.randrange(len(words)), w)
    return " ".join(words)


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(4)
    insults = ["blockhead", "nitwit", "dimwit", "buffoon", "halfwit"]
    rows = []
    for i in range(900):
        toxic = i % 5 < 2
        rows.append((i, writing(rng, rng.randrange(30, 300), [rng.choice(insults) for _ in range(rng.randrange(2, 6))] if toxic else ()), int(toxic)))
    return rows


def test_toxic_texts_are_told_and_others_left_alone(spark, talk):
    rng = random.Random(9)
    long_text = writing(rng, 40_000)
    more = [(5000, None), (5001, ""), (None, "short one"), (5002, long_text), (5003, long_text + " nitwit blockhead " * 60), (7, "twice"), (7, "twice")]
    docs = frame(spark, [(i, t, "en", "s") for i, t, _ in talk] + [(i, t, "en", "s") for i, t in more])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in talk] + [(None, 0, 1), (3, 0, None), (99999, 1, 1)], LABELS)
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert len(got) == len(talk) + len(more)
    by = {r.doc_id: r for r in got}
    held = [(i, y) for i, _, y in talk if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, _ in held} == {r.doc_id for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900}
    assert len(held) > 100
    assert np.mean([by[i].predicted == y for i, y in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert by[5003].score > by[5002].score and by[5003].predicted == 1
    assert by[5000].score == by[5001].score and by[None].held_out is False
    # Nothing but texts and the labels that may be learned from is read.
    turned = spark.createDataFrame([(i, 0, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in talk] + [(99999, 0, 1)], LABELS)
    again = toxicity.toxicity_scores(docs.withColumn("lang", docs.source), turned.unionByName(turned.limit(5)))
    assert sorted((str(r.doc_id), r.score) for r in again.collect()) == sorted((str(r.doc_id), r.score) for r in got)


def test_toxicity_without_classes_or_rows(spark):
    docs = frame(spark, [(1, "a text", "en", "s"), (2, None, "en", "s")])
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    none, bad = spark.createDataFrame([], LABELS), spark.createDataFrame([(i, 0, 1) for i in ids], LABELS)
    assert {r.score for r in toxicity.toxicity_scores(docs, none).collect()} == {0.5}
    assert {r.score for r in toxicity.toxicity_scores(frame(spark, [(i, "t", "en", "s") for i in ids]), bad).collect()} == {1.0}
    assert toxicity.toxicity_scores(docs.limit(0), bad).count() == 0
    few = toxicity.fit([b"one nitwit", b"nitwit two"], [b"plain", b"words"], 0.5)
    assert 0 <= few.score(toxicity.Distances(few.ordinary, few.toxic), "any") <= 1


def test_windows_cover_the_text_and_pieces_change_nothing(monkeypatch):
    pair = toxicity.Distances(b"", b"")
    seen = []
    monkeypatch.setattr(toxicity, "_lengths", lambda c, data, segments: seen.append((data, np.frombuffer(segments, np.uint64).reshape(-1, 2))) or np.zeros(len(segments) // 16, np.int64))
    for n in (0, 1, 31, 32, 63, 64, 65, 96, 97, 640, 4096, 4097, 5000):
        counts = []
        for piece in (1 << 20, 4096, 128):
            monkeypatch.setattr(toxicity, "PIECE_BYTES", piece)
            seen.clear()
            text = bytes(k % 251 for k in range(n))
            counts.append(sum(len(d) for d in pair.of(text)))
            windows = [data[int(s) : int(s + z)] for data, seg in seen[::2] for s, z in seg]
            starts = range(0, max(n - 64, 0) + 32, 32) if n else []
            assert windows == [text[s : s + 64] for s in starts if s < n]
            assert not n or windows[-1].endswith(text[-1:])
        assert len(set(counts)) == 1


def test_copies_and_fragments():
    rng = random.Random(2)
    texts = [writing(rng, 80).encode() for _ in range(5)]
    assert toxicity.without_copies([*texts, texts[0], texts[1] + b" and a little more"]) == texts
    toxic = [writing(rng, 50, ["nitwits"]).encode() for _ in range(60)]
    plain = [writing(rng, 50).encode() for _ in range(60)]
    found = toxicity.telling_fragments(toxic, plain)
    as_bytes = {int(x).to_bytes(6, "big") for x in found}
    assert {b"nitwit", b"itwits"} <= as_bytes and all(any(c in b for c in (b"nitw", b"itwi", b"twit", b"wits")) for b in as_bytes)
    assert all(b"itwit" in p for p in toxicity.passages(toxic, found) if len(p) >= 8)
    assert not len(toxicity.telling_fragments([], plain)) and not len(toxicity.telling_fragments([b"ab"], []))


# The audit of filters.


def brute_audit(rows, labels):
    good, toxic = defaultdict(int), defaultdict(int)
    for i, q, t in labels:
        if i is not None:
            good[i] |= int(q == 1)
            toxic[i] |= int(t == 1)
    first = {}
    for i, t, _, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    docs = []
    for i, t, _, s in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = ""
        fails += "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 2 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t))
        fails += "E" * (t in first and (i is None or first[t] < i))
        docs.append((s or "", fails, good[i] if i is not None else 0, toxic[i] if i is not None else 0))
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            gone = []
            for step, x in enumerate(order, 1):
                removed = [d for d in left if x in d[1]]
                redundant = [d for d in gone if x in d[1]]
                left = [d for d in left if x not in d[1]]
                gone += removed
                shapley[part, x] += len(removed)
                out[part, "".join(order), step] = [len(left), len(removed), len(redundant), sum(d[0] == part and d[1] == x for d in docs), sum(d[2] for d in removed), sum(d[3] for d in removed)]
    return {k: tuple([*v, shapley[k[0], k[1][k[2] - 1]]]) for k, v in out.items()}


def audit_rows():
    rng = random.Random(8)
    words = ["a", "b", "é", "Word", "日本", "x" * 40, "$5", "end.", "K"] + [f"w{k}" for k in range(300)]
    rows = []
    for k in range(150):
        n = rng.choice([0, 1, 3, 199, 200, 201, 400])
        sep = rng.choice([" ", "\n", "\t ", "\x0b", "  "])
        rows.append((rng.randrange(200), sep.join(rng.choice(words[: rng.choice([9, 309])]) for _ in range(n)), "en", rng.choice(["s", "t", None, ""])))
    rows += [(300 + k, "same text again", "en", "s") for k in range(40)] + [(5, "same text again", "en", "t"), (5, "same text again", "en", "t")]
    rows += [(None, "same text again", "en", "s"), (None, None, "en", None), (400, None, None, "s"), (401, "", "en", "s"), (402, "Q" * 300_000, "en", "t"), (403, ("word" + "é" * 9 + " ") * 30_000, "en", "t")]
    return rows


def test_audit_against_brute_force(spark):
    rows = audit_rows()
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 320, 2)] + [(4, 1, 1), (None, 1, 1), (6, None, None), (9999, 1, 1)]
    got = filter_audit.filter_audit(frame(spark, rows).repartition(5), spark.createDataFrame(labels, LABELS))
    assert got.columns == ["part", "filter_order", "step", *filter_audit.MEASURES]
    assert {tuple(r[:3]): tuple(r[3:]) for r in got.collect()} == brute_audit(rows, labels)
    assert filter_audit.filter_audit(frame(spark, rows).limit(0), spark.createDataFrame(labels, LABELS)).count() == 0
    assert filter_audit.filter_audit(frame(spark, rows[:3]), spark.createDataFrame([], LABELS)).count() % 600 == 0


def test_distinct_words_do_not_hang_on_hashes(monkeypatch):
    texts = ["b a b c a", "", "xx yy xx", None, "one", "aé é aé", " lead and trail "]
    whole = pa.array(["skipped", *texts])[1:]
    data, offsets = filter_audit.buffers(whole)
    begins, ends = filter_audit.word_bounds(data, offsets)
    want = [len(set((t or "").split())) for t in texts]
    for hashes in (filter_audit.word_hashes(data, begins, ends), np.zeros(len(begins), np.uint64), (begins % 2).astype(np.uint64) * 0 + np.arange(len(begins), dtype=np.uint64) * 0):
        assert filter_audit.distinct_words(data, offsets, begins, ends, hashes).tolist() == want
    monkeypatch.setattr(filter_audit, "PIECE_BYTES", 4)
    assert filter_audit.distinct_words(data, offsets, begins, ends, filter_audit.word_hashes(data, begins, ends)).tolist() == want
    assert filter_audit.text_masks(pa.array([], pa.string())).tolist() == []
    large = pa.array(["A b"] * 3, pa.large_string())
    assert filter_audit.text_masks(large).tolist() == [0b101] * 3


# The divergence of sources.


def brute_divergence(rows, least, top):
    docs = [(g or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))) for _, t, g, s in rows]
    has, in_group, in_lang = Counter(), Counter(), Counter()
    for g, s, ws in docs:
        has.update((g, w) for w in set(ws))
        in_group.update((g, s, w) for w in ws)
        in_lang.update((g, w) for w in ws)
    out = set()
    groups = {(g, s) for g, s, _ in docs}
    for g, s in groups:
        kept = [w for (x, w), n in has.items() if x == g and n >= least]
        p = lambda count: {w: 1 + 1000000000 * (count(w) + 5) // (sum(count(v) for v in kept) + 5 * len(kept)) for w in kept}  # noqa: B023, E731
        mine, q = p(lambda w: in_group[g, s, w]), p(lambda w: in_lang[g, w])  # noqa: B023
        pairs = []
        for _, other in {x for x in groups if x[0] == g and x[1] != s}:
            theirs = p(lambda w: in_group[g, other, w])  # noqa: B023
            pairs.append((-sum(abs(mine[w] - theirs[w]) for w in kept), other.encode(), other))
        told = [(q[w] - mine[w], w.encode(), w) for w in kept if in_group[g, s, w] and mine[w] > q[w]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(told)[:top])):
            out |= {(g, s, part, item, -v, k) for k, (v, _, item) in enumerate(found, 1)}
    return out


def divergence_rows(seed=3):
    rng = random.Random(seed)
    words = ["the", "The", "of", "é", "Été", "日本", "don't", "a1b", "x" * 30, " nbsp", "_under_", "Z"] + [f"w{chr(97 + k)}" for k in range(26)]
    rows = []
    for k in range(400):
        g = rng.choice(["en", "en", "en", "fr", None])
        s = rng.choice(["s1", "s1", "s1", "s2", "é", "\U0001f600", "￮", None, ""])
        skew = words[: rng.randrange(5, len(words))]
        rows.append((k, " ".join(rng.choice(skew) for _ in range(rng.randrange(0, 25))), g, s))
    return rows + [(1, "the the", "en", "s1"), (1, "the the", "en", "s1"), (900, None, "en", "s9"), (901, "", "de", "only"), (902, "1 2 3", "de", "two"), (903, "rare", "de", "three"), (904, None, None, None), (905, "w " * 50_000, "en", "s2")]


def test_divergence_against_brute_force(spark, monkeypatch):
    rows = divergence_rows()
    for least, top in ((3, 5), (1, 1000), (60, 2)):
        got = [tuple(r) for r in divergence.source_divergence(frame(spark, rows).repartition(7), least_documents=least, top=top).collect()]
        assert len(got) == len(set(got))
        assert set(got) == brute_divergence(rows, least, top)
    monkeypatch.setattr(divergence, "GATHERED", 10)
    got = divergence.source_divergence(frame(spark, rows).repartition(3), least_documents=3, top=5)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert {tuple(r) for r in got.collect()} == brute_divergence(rows, 3, 5)
    assert divergence.source_divergence(frame(spark, rows).limit(0)).count() == 0


def test_pairs_in_small_blocks(spark):
    rows = divergence_rows(5)
    docs = divergence._plain(frame(spark, rows), "text", "lang", "source")
    counts = divergence.staged(divergence.kept_counts(docs, 3), "test-counts")
    in_lang = {(r.lang, r.term): r.lang_n for r in counts.collect()}
    by_lang = {g: (sum(1 for x, _ in in_lang if x == g), sum(n for (x, _), n in in_lang.items() if x == g)) for g, _ in in_lang}
    total = Counter()
    for r in counts.collect():
        total[r.lang, r.source] += r.n
    groups = spark.createDataFrame([(g, s, total[g, s], by_lang.get(g, (0, 0))[1], by_lang.get(g, (0, 0))[0]) for g, s in sorted({(g or "", s or "") for _, _, g, s in rows})], "lang string, source string, total long, lang_total long, kept long")
    want = {x[:2] + x[3:] for x in brute_divergence(rows, 3, 1) if x[2] == "pair"}
    for block, shard in ((1, 3), (2, 1000), (3, 5)):
        got = divergence.pair_distances(counts, groups, block, shard)
        assert {(r.lang, r.source, r.item, r.value, r["rank"]) for r in got.collect()} == want, (block, shard)


def test_the_search_ends_at_the_bound():
    """Rows after the first whose bound is strictly below the last of the best are passed over, ties are kept."""
    rows = [("en", "s", f"t{k}", bound, 10 * bound, 10 * bound - v) for k, (bound, v) in enumerate([(9, 9), (9, 4), (7, 7), (7, 5), (5, 5), (5, 2), (4, 4), (4, 1)])]
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part, strict=True)], names=["lang", "source", "item", "bound", "p", "q"])
    found = [(r["item"], r["value"]) for b in divergence.best_first(iter([batch(rows[:3]), batch(rows[3:])]), 3) for r in b.to_pylist()]
    assert found == [("t0", 9), ("t1", 4), ("t2", 7), ("t3", 5), ("t4", 5)]


def test_probabilities_of_very_many(spark):
    big = 5 * 10**17
    r = spark.range(1).select(divergence.probability(divergence.F.lit(big), divergence.F.lit(3 * big), divergence.F.lit(7)).alias("p")).first()
    assert r.p == 1 + 10**9 * (big + 5) // (3 * big + 35)
