"""How the sources of a language differ: distances of all pairs, and each source's most telling terms.

Terms are counted in tasks, by language and source, before anything is
shuffled; a language keeps the terms that enough of its documents have.
Probabilities are smoothed whole numbers, so that all arithmetic is exact.

Terms of a source are searched by upper bounds.  Its terms of one count share
one probability, so a bucket a count, with the least probability that the
language gives any of its terms, bounds how far any of them can stick out.
Buckets are opened best first, and the search ends as soon as the bound of all
that is unseen is strictly below the 50th value found.  It does so twice: the
buckets' lower bounds tell a value that 50 terms reach, and buckets bounded
below that are never shuffled; of the rest each task keeps its own best.

Pairs are computed from postings: a row a term with the sources that have it.
Blocks of sources meet in shards of the terms, so neither a language nor a
source is in one task, and what two sources lack in common is added in closed
form.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.llm.common import bound_batches, dealt, small_or_not, staged

#: Documents of its language that a term needs; terms told of a source.
LEAST_DOCUMENTS, TOP = 30, 50
#: Probabilities are of so many parts; each term counts as seen so many times more.
PARTS, PRIOR = 1_000_000_000, 5
#: Distinct (group, term) pairs that a task gathers before it passes them on.
GATHERED = 400_000
#: Sources of a block, and terms of a shard, in the mean.
BLOCK_SOURCES, SHARD_TERMS = 128, 4096

#: Letters and all beyond ASCII stay, capitals become small, everything else parts terms.  In UTF-8 this is byte by byte.
TERM_BYTES = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 0x20 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order.

    Splitting is by the one blank left; other bytes that split() knows are gone.
    """
    return text.translate(TERM_BYTES).split()


def _plain(df: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(k) for k, c in (("lang", lang_col), ("source", source_col), ("text", text_col))])


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences, and documents that have the term; a row or more a task and key."""
    bound_batches(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, has) in found.items():
                keys = list(n)
                for at in range(0, len(keys), 50_000):
                    part = keys[at : at + 50_000]
                    same = lambda x: pa.array([x], pa.string()).take(pa.array(np.zeros(len(part), np.int32)))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([same(lang), same(source), pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[k] for k in part], pa.int64()), pa.array([has[k] for k in part], pa.int64())], names=["lang", "source", "term", "n", "docs"])
            found.clear()

        size = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                n, has = found.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                here = Counter(terms(text.as_py()))
                for term, times in here.items():
                    n[term] += times
                has.update(here.keys())
                size += len(n) - before
            if size > GATHERED:
                yield from rows()
                size = 0
        yield from rows()

    return dealt(docs).select("lang", "source", "text").mapInArrow(counted, "lang string, source string, term string, n bigint, docs bigint")


def probability(count: Column | str, total: Column | str, kept: Column | str) -> Column:
    """``1 + floor(PARTS * (count + PRIOR) / (total + PRIOR * kept))``, exact for counts of any size; null where no term is kept."""
    wide = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(27,0)")
    of = wide(total) + F.lit(PRIOR).cast("decimal(1,0)") * wide(kept)
    return F.when(of > 0, F.call_function("div", (F.lit(PARTS).cast("decimal(10,0)") * (wide(count) + F.lit(PRIOR))).cast("decimal(38,0)"), of.cast("decimal(38,0)")).cast("long") + 1)


def kept_counts(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """``lang, source, term, n, lang_n`` of the kept terms: occurrences in the source and in the language."""
    # One shuffle, by language and term, serves both sums; a source's are a row a task at most.
    rows = term_counts(docs).repartition("lang", "term")
    by_source = rows.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("lang", "term")
    return by_source.withColumn("lang_n", F.sum("n").over(whole)).withColumn("lang_docs", F.sum("docs").over(whole)).filter(F.col("lang_docs") >= least_documents).select("lang", "source", "term", "n", "lang_n")


def best_first(batches: Iterator[pa.RecordBatch], top: int = TOP) -> Iterator[pa.RecordBatch]:
    """Of rows (lang, source, term, bound, p, q), buckets by group in the order of their bounds, those that may be among the best.

    A group's rows are seen until it has ``top`` values and the bound of all
    that follow is strictly below the least of them; ties stay.
    """
    group, heap = None, []
    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        bound, value = batch.column(3).to_numpy(), batch.column(4).to_numpy() - batch.column(5).to_numpy()
        keep = []
        for k, key in enumerate(keys):
            if key != group:
                group, heap = key, []
            if len(heap) == top and bound[k] < heap[0]:
                continue
            v = int(value[k])
            if v <= 0 or len(heap) == top and v < heap[0]:
                continue
            keep.append(k)
            (heapq.heappushpop if len(heap) == top else heapq.heappush)(heap, v)
        if keep:
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), pa.array(value[keep], pa.int64())], names=["lang", "source", "item", "value"])


def telling_terms(counts: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """``lang, source, item, value, rank``: the terms by which a source sticks out most from its language.

    ``counts`` from kept_counts, staged; ``groups`` has ``lang, source, total,
    lang_total, kept``.
    """
    sizes = groups.filter("kept > 0").select(F.col("lang").alias("l"), F.col("source").alias("s"), "total", "lang_total", "kept")
    rows = counts.join(small_or_not(sizes), (F.col("lang") == F.col("l")) & (F.col("source") == F.col("s")))
    rows = rows.select("lang", "source", "term", "n", probability("n", "total", "kept").alias("p"), probability("lang_n", "lang_total", "kept").alias("q"))
    rows = staged(rows.filter("n > 0"), "divergence-terms")
    # A bucket a count: a value that all of its terms reach, and one that none exceeds.
    buckets = rows.groupBy("lang", "source", "n").agg(F.count("*").alias("terms"), (F.max("p") - F.max("q")).alias("least"), (F.max("p") - F.min("q")).alias("bound"))
    # What so many terms of the group reach at least; counts of a group are few beside its terms.
    upto = F.sum("terms").over(Window.partitionBy("lang", "source").orderBy(F.desc("least"), "n").rowsBetween(Window.unboundedPreceding, 0))
    reached = F.max(F.when(F.col("upto") >= top, F.col("least"))).over(Window.partitionBy("lang", "source"))
    open_ = buckets.withColumn("upto", upto).withColumn("reached", reached).filter((F.col("bound") > 0) & (F.col("bound") >= F.coalesce("reached", F.lit(1))))
    open_ = staged(open_.select(F.col("lang").alias("l"), F.col("source").alias("s"), F.col("n").alias("n_"), "bound"), "divergence-buckets")
    seen = rows.join(small_or_not(open_), (F.col("lang") == F.col("l")) & (F.col("source") == F.col("s")) & (F.col("n") == F.col("n_"))).select("lang", "source", "term", "bound", "p", "q")
    found = seen.sortWithinPartitions("lang", "source", F.desc("bound"), "n_").mapInArrow(lambda batches: best_first(batches, top), "lang string, source string, item string, value bigint")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= top)


def _partial_distances(key: tuple, table: pa.Table) -> pa.Table:
    """For two blocks of sources and some terms: how much further each pair is apart than without these terms."""
    i, j = key[1].as_py(), key[2].as_py()
    size = key[4].as_py()
    zero = np.zeros(2 * size, np.int64)
    there = np.zeros(2 * size, bool)
    lists = table.column("found").combine_chunks()
    where = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    values = lists.flatten()
    nr, p = values.field("nr").to_numpy(zero_copy_only=False), values.field("p").to_numpy(zero_copy_only=False)
    marker = table.column("marker").to_numpy(zero_copy_only=False)[where]
    place = np.where(nr // size == i, nr - i * size, size + nr - j * size)
    zero[place[marker]], there[place[marker]] = p[marker], True
    row = np.cumsum(~table.column("marker").to_numpy(zero_copy_only=False)) - 1
    grid = np.repeat(zero[:, None], max(int((row.max() if len(row) else -1) + 1), 0), axis=1)
    grid[place[~marker], row[where[~marker]]] = p[~marker]
    first = np.flatnonzero(there[:size])
    second = first if i == j else size + np.flatnonzero(there[size:])
    a, b, v = [], [], []
    for x in first:
        others = second[second > x] if i == j else second
        a.append(np.full(len(others), x))
        b.append(others)
        v.append((np.abs(grid[others] - grid[x]) - np.abs(zero[others] - zero[x])[:, None]).sum(axis=1))
    back = lambda c: np.where(c < size, c + i * size, c - size + j * size)
    a, b, v = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (a, b, v))
    return pa.table({"lang": pa.array([key[0].as_py()] * len(a), pa.string()), "a": pa.array(back(a.astype(np.int64)), pa.int64()), "b": pa.array(back(b.astype(np.int64)), pa.int64()), "part": pa.array(v.astype(np.int64), pa.int64())})


def pair_distances(counts: DataFrame, groups: DataFrame, block: int = BLOCK_SOURCES, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """``lang, source, item, value, rank``: for each source every other of its language, the furthest first.

    Of two sources a term that neither has adds the same, so only terms in the
    postings of either are looked at, in (two blocks of sources, a shard of the
    terms) at a time; the sums are added, with the rest in closed form.
    """
    numbered = groups.withColumn("nr", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long"))
    shards = F.greatest(F.ceil(F.col("kept") / shard_terms), F.lit(1)).cast("int")
    zero = F.coalesce(probability(F.lit(0), "total", "kept"), F.lit(0).cast("long"))
    numbered = staged(numbered.select("lang", "source", "total", "kept", "nr", F.floor(F.col("nr") / block).alias("own"), shards.alias("shards"), zero.alias("zero"), F.max("nr").over(Window.partitionBy("lang")).alias("last")), "divergence-sources")
    last = F.floor(F.col("last") / block)
    # The pairs of blocks that a block belongs to, smaller first.
    pairs = lambda own: F.transform(F.sequence(F.lit(0).cast("long"), last), lambda k: F.struct(F.least(k, own).alias("i"), F.greatest(k, own).alias("j")))
    named = numbered.select(F.col("lang").alias("l"), F.col("source").alias("s"), "nr", "own", "total", "kept", "shards", "last")
    held = counts.join(small_or_not(named), (F.col("lang") == F.col("l")) & (F.col("source") == F.col("s")))
    held = held.select("lang", "term", "own", "nr", "shards", "last", probability("n", "total", "kept").alias("p"))
    # Postings: a term's sources, block by block of them.
    postings = held.groupBy("lang", "term", "own").agg(F.collect_list(F.struct("nr", "p")).alias("found"), F.max("shards").alias("shards"), F.max("last").alias("last"))
    postings = postings.select("lang", "term", F.explode(pairs(F.col("own"))).alias("at"), F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"), "found")
    # A term's two halves meet in one row, so that both blocks see it once.
    postings = postings.groupBy("lang", "term", "at", "shard").agg(F.flatten(F.collect_list("found")).alias("found")).select("lang", "at.i", "at.j", "shard", F.lit(False).alias("marker"), "found")
    blocks = numbered.groupBy("lang", "own").agg(F.collect_list(F.struct("nr", F.col("zero").alias("p"))).alias("found"), F.max("shards").alias("shards"), F.max("last").alias("last"))
    markers = blocks.select("lang", F.explode(pairs(F.col("own"))).alias("at"), "shards", "found").select("lang", "at.i", "at.j", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.lit(True).alias("marker"), "found")
    met = postings.unionByName(markers).withColumn("size", F.lit(block))
    partial = met.groupBy("lang", "i", "j", "shard", "size").applyInArrow(_partial_distances, "lang string, a bigint, b bigint, part bigint")
    sums = partial.groupBy("lang", "a", "b").agg(F.sum("part").alias("part"))
    both = sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("of"), "part").select("lang", "of.x", "of.y", "part")
    side = lambda k, c: small_or_not(numbered.select(F.col("lang").alias(f"lang_{k}"), F.col("nr").alias(f"nr_{k}"), F.col("source").alias(c), F.col("zero").alias(f"zero_{k}"), "kept" if k == "x" else F.lit(0).alias("none")))
    named_pairs = both.join(side("x", "source"), (F.col("lang") == F.col("lang_x")) & (F.col("x") == F.col("nr_x"))).join(side("y", "item"), (F.col("lang") == F.col("lang_y")) & (F.col("y") == F.col("nr_y")))
    value = F.col("part") + F.col("kept") * F.abs(F.col("zero_x") - F.col("zero_y"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return named_pairs.select("lang", "source", "item", value.cast("long").alias("value")).withColumn("rank", rank)


def source_divergence(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_documents: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: all pairs of sources of a language, and each source's ``top`` terms.

    Null texts, languages and sources are empty strings.  Every language and
    source that occurs is a group, even without terms; repeated rows count each
    time; ties are ordered by the item's bytes.  A language without kept terms
    has distances of 0 and no terms; an empty table gives an empty result; other
    columns are not read.
    """
    docs = _plain(df, text_col, lang_col, source_col)
    counts = staged(kept_counts(docs, least_documents), "divergence-counts")
    by_lang = counts.groupBy("lang", "term").agg(F.max("lang_n").alias("n")).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_total"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(by_lang, "lang", "left")
    groups = staged(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "lang_total", "kept")]), "divergence-groups")
    told = telling_terms(counts, groups, top).withColumn("part", F.lit("term"))
    apart = pair_distances(counts, groups).withColumn("part", F.lit("pair"))
    return apart.unionByName(told).select("lang", "source", "part", "item", "value", "rank")


ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS doc_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_no, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT doc_no) >= {LEAST_DOCUMENTS}
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL
), t AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n
  FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), s AS (
  SELECT *, CAST(sum(n) OVER (PARTITION BY lang, source) AS HUGEINT) AS total, CAST(sum(lang_n) OVER (PARTITION BY lang, source) AS HUGEINT) AS lang_total, count(*) OVER (PARTITION BY lang, source) AS kept FROM t
), p AS (
  SELECT lang, source, term, n, CAST(1 + ({PARTS} * CAST(n + {PRIOR} AS HUGEINT)) // (total + {PRIOR} * kept) AS BIGINT) AS p, CAST(1 + ({PARTS} * CAST(lang_n + {PRIOR} AS HUGEINT)) // (lang_total + {PRIOR} * kept) AS BIGINT) AS q FROM s
), a AS (
  SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
), pairs AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(a.value, 0) AS BIGINT) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source
), r AS (
  SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, p - q, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS INTEGER) FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= {TOP}
"""
