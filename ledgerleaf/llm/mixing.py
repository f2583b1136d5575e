"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents stand in a shuffled order (by MD5 of the id), gone
round as often as its target needs.  The points i * golden ratio mod 1 are
mapped through the cumulative target shares, so every prefix of the slots
follows the shares closely.  A source's target, to the word, is cut into as
many blocks of equal words (one more or less) as it has slots, and a slot's
rank among them names the block it takes: so a source of a few words meets its
target as exactly as a large one, and a block has some 64 words everywhere.  A
source too small for a point has one block, in the slot where its share begins.

Where a document's words stand in its source says in closed form how many of
them are taken and in which block they begin, so that documents are joined with
the slots once, a row each.  Running sums and ranks are made in two levels
(bucket totals, then within a bucket), so that a source with a third of all
rows is never in one task.

The table of sources is the only one handled as a whole: a row a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.llm.common import BLANKS, WORD, n_words, small_or_not, staged

#: Weights by the sources' order, repeating.
WEIGHTS = (3, 1, 2)
#: Words taken in all, as a share of all words; passes over a source at most.
SHARE = 1.5
PASSES = 2
#: Words of a block in the mean, however large the input is.
BLOCK_WORDS = 64
#: Hex digits of the MD5 that name a bucket of the shuffled order.
BUCKET_DIGITS = 3
#: Slots ranked together in one window.
SLOT_CHUNK = 16384
#: Cells of the unit interval in which a slot's point looks for its source.
CELLS = 4096
GOLDEN = 0.6180339887498949

BEFORE = (Window.unboundedPreceding, -1)


def _everything():
    return Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def source_targets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """``nr, source, source_size, target, total`` of a table with ``source, size``.

    Sources are weighed in code-point order, null last.  Water filling: sources
    with the least room for their weight are full first; the rest share what is
    left by weight.  This is where resharing the excess until none is above its
    limit ends.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    before = Window.orderBy("ratio", "nr").rowsBetween(*BEFORE)
    t = docs.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("nr", F.row_number().over(by_name))
    t = t.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("nr") - 1) % len(weights) + 1).cast("double"))
    t = t.withColumn("full_size", F.col("source_size") * F.lit(float(passes))).withColumn("ratio", F.col("full_size") / F.col("weight"))
    t = t.withColumn("total", F.sum("source_size").over(_everything())).withColumn("w_all", F.sum("weight").over(_everything()))
    left = F.col("total") * F.lit(float(share)) - F.coalesce(F.sum("full_size").over(before), F.lit(0.0))
    t = t.withColumn("level", left / (F.col("w_all") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # The first source that isn't full says at which level all the others end.
    t = t.withColumn("full", F.col("ratio") <= F.col("level"))
    t = t.withColumn("ends", F.min(F.when(~F.col("full"), F.struct("ratio", "nr", "level"))).over(_everything()))
    return t.select("nr", "source", "source_size", F.when(F.col("full"), F.col("full_size")).otherwise(F.col("weight") * F.col("ends.level")).alias("target"), "total")


def whole_target() -> Column:
    """The words that a source gives: its target to the word."""
    return F.floor(F.col("target") + 0.5).cast("long")


def _div(a: Column, b: Column) -> Column:
    """A whole quotient of numbers whose product may be beyond 64 bits."""
    return F.call_function("div", a.cast("decimal(38,0)"), b.cast("decimal(38,0)")).cast("long")


def _wide(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def shuffled_offsets(docs: DataFrame) -> DataFrame:
    """``docs`` (at, id, key, source, size) with ``start``: words before it in its source's shuffled order."""
    keyed = docs.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    totals = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    bucket_start = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(*BEFORE)), F.lit(0))
    totals = totals.select(F.col("source").alias("s"), F.col("bucket").alias("b"), bucket_start.alias("bucket_start"))
    within = Window.partitionBy("source", "bucket").orderBy("key", "id", "size", "at").rowsBetween(*BEFORE)
    local = keyed.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return local.join(totals, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).select("at", "id", "source", "size", (F.col("bucket_start") + F.col("before")).alias("start"))


def slot_schedule(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``slot, nr, rank`` of every slot, and of the blocks of sources without one; ``targets`` from source_targets, staged.

    There are as many slots as blocks of ``block_words`` make up the sum of the
    targets.
    """
    by_nr = Window.orderBy("nr").rowsBetween(Window.unboundedPreceding, 0)
    t = targets.withColumn("sum_all", F.sum("target").over(_everything()))
    t = t.withColumn("upto", F.when(F.col("nr") == F.count("*").over(_everything()), F.lit(2.0)).otherwise(F.sum("target").over(by_nr) / F.col("sum_all")))
    t = t.withColumn("n", F.ceil(F.col("sum_all") / F.lit(block_words))).withColumn("since", F.coalesce(F.lag("upto").over(Window.orderBy("nr")), F.lit(0.0)))
    shares = staged(t.filter("target > 0").select("nr", "since", "upto", "n", whole_target().alias("words")), "mix-shares")
    one = shares.agg(F.max("n").alias("n"))
    chunks = one.filter("n > 0").select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / SLOT_CHUNK))).alias("chunk"))
    # A row a chunk is little to read but much to make: by a given number of partitions, which are not coalesced.
    chunks = chunks.repartition(4 * targets.sparkSession.sparkContext.defaultParallelism, "chunk")
    slots = chunks.select("chunk", F.explode(F.sequence(F.col("chunk") * SLOT_CHUNK, F.least((F.col("chunk") + 1) * SLOT_CHUNK, F.col("n")) - 1)).alias("slot"))
    slots = slots.withColumn("turn", F.col("slot") * F.lit(GOLDEN)).withColumn("point", F.col("turn") - F.floor("turn"))
    # Each source's stretch of the unit interval, by the cells that it touches: a slot sees the few sources of its cell.
    cell = lambda c: F.least(F.floor(F.col(c) * CELLS), F.lit(CELLS - 1))
    cells = staged(shares.filter("upto > since").select("nr", "since", "upto", F.explode(F.sequence(cell("since"), cell("upto"))).alias("cell")), "mix-cells")
    slots = slots.withColumn("cell", cell("point")).join(small_or_not(cells), "cell").filter("since <= point AND point < upto").select("chunk", "slot", "nr")
    base = slots.groupBy("nr", "chunk").agg(F.count("*").alias("c"))
    base = base.select("nr", "chunk", F.coalesce(F.sum("c").over(Window.partitionBy("nr").orderBy("chunk").rowsBetween(*BEFORE)), F.lit(0)).alias("base"))
    ranked = slots.withColumn("r", F.row_number().over(Window.partitionBy("nr", "chunk").orderBy("slot")) - 1).join(base.hint("merge"), ["nr", "chunk"])
    ranked = ranked.select("slot", "nr", (F.col("r") + F.col("base")).alias("rank"))
    # Sources without a point: the left side is a row a source, the right one a row a source and chunk.
    have = base.select(F.col("nr").alias("nr_")).distinct()
    alone = shares.filter("words > 0").join(have.hint("merge"), F.col("nr") == F.col("nr_"), "left_anti")
    return ranked.unionByName(alone.select(F.floor(F.col("since") * F.col("n")).cast("long").alias("slot"), "nr", F.lit(0).cast("long").alias("rank")))


def taken_words(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """For a staged ``docs`` (at, id, key, source, size): the words taken by document and pass, and the targets.

    The first table has ``at, pass_no, taken, slot`` (the slot of the block in
    which the document's words begin in that pass), only where words are taken.
    """
    targets = staged(source_targets(docs, weights, share, passes), "mix-targets")
    slots = staged(slot_schedule(targets, block_words), "mix-slots")
    counts = slots.groupBy("nr").agg(F.count("*").alias("blocks"))
    named = targets.select("nr", F.col("source").alias("s"), "source_size", whole_target().alias("words")).join(counts, "nr")
    named = small_or_not(staged(named, "mix-sources"))
    placed = shuffled_offsets(docs).filter("size > 0").join(named, F.col("source").eqNullSafe(F.col("s")))
    rows = placed.select("at", "nr", "size", "words", "blocks", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(passes - 1)), lambda p: F.col("start") + p * F.col("source_size"))).alias("pass_no", "first"))
    rows = rows.withColumn("taken", F.greatest(F.least(F.col("size"), F.col("words") - F.col("first")), F.lit(0))).filter("taken > 0")
    # The last block that begins at or before the word.
    rank = _div((_wide(F.col("first")) + F.lit(1)) * _wide(F.col("blocks")) - F.lit(1), F.col("words"))
    rows = rows.select("at", "nr", "pass_no", "taken", rank.alias("rank"))
    times = slots.select(F.col("nr").alias("nr_"), F.col("rank").alias("rank_"), "slot").hint("merge")
    return rows.join(times, (F.col("nr") == F.col("nr_")) & (F.col("rank") == F.col("rank_"))).select("at", "pass_no", "taken", "slot"), targets


def _shuffled_by(id_: Column, text: Column) -> Column:
    """What the order within a source is by: the MD5 of the id, of a row without id that of its text."""
    return F.md5(F.coalesce(id_.cast("string"), F.concat(F.lit("none "), F.md5(F.coalesce(text, F.lit("")).cast("binary")))).cast("binary"))


def _slim(df: DataFrame, id_col: str, text_col: str, source_col: str, *more: str) -> DataFrame:
    return df.select(F.monotonically_increasing_id().alias("at"), F.col(f"`{id_col}`").alias("id"), _shuffled_by(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("key"), F.col(f"`{source_col}`").alias("source"), n_words(F.col(f"`{text_col}`")).alias("size"), *more)


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """One row per document: ``id, size, source_size, target, taken, first_slot``.

    A document has as many words as runs of non-blanks (null text: 0, taken 0).
    ``first_slot`` is where the mix first takes words of it, -1 if nowhere.
    Null sources are one source, the last; null ids are shuffled by their texts;
    ties and repeated rows are told apart.  An empty table gives an empty
    result; other columns are not read.
    """
    docs = staged(_slim(df, id_col, text_col, source_col), "mix-docs")
    taken, targets = taken_words(docs, **how)
    each = taken.groupBy("at").agg(F.sum("taken").alias("taken"), F.min_by("slot", "pass_no").alias("slot"))
    named = small_or_not(staged(targets.select(F.col("source").alias("s"), "source_size", "target"), "mix-named"))
    out = docs.join(each, "at", "left").join(named, F.col("source").eqNullSafe(F.col("s")))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("slot", F.lit(-1)).cast("long").alias("first_slot"))


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", slot_col: str | None = None, **how) -> DataFrame:
    """The mix itself, with the columns of ``df``: a row for each pass that takes words of a document.

    ``slot_col`` names a further column with the slot in which the row's words
    begin: in its order every prefix follows the shares.  Where a source's words
    end within a document its text is cut after the words taken, blanks and line
    ends before them as they were (at most one document a source); all other
    texts are whole.  Documents without words (null, empty) and those not taken have no
    row.  Null sources are one source; null ids, ties and repeated rows are told
    apart by row; other columns may have any name.  An empty table stays empty.
    """
    names = df.columns
    if slot_col in names:
        raise ValueError(f"there is a column {slot_col} already")
    full = staged(df.select(F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)]).alias("row"), F.monotonically_increasing_id().alias("at"), _shuffled_by(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("key"), n_words(F.col(f"`{text_col}`")).alias("size")), "mix-full")
    field = {c: F.col(f"row.c{k}") for k, c in enumerate(names)}
    docs = full.select("at", field[id_col].alias("id"), "key", field[source_col].alias("source"), "size")
    taken, _ = taken_words(docs, **how)
    rows = full.join(taken, "at")
    pieces = F.regexp_extract_all(field[text_col], F.lit(f"[{BLANKS}]*{WORD}"), F.lit(0))
    text = F.when(F.col("taken") >= F.col("size"), field[text_col]).otherwise(F.array_join(F.slice(pieces, F.lit(1), F.col("taken").cast("int")), ""))
    new = {text_col: text} | ({"n_chars": F.length(text).cast(df.schema["n_chars"].dataType)} if "n_chars" in names else {})
    return rows.select(*[new.get(c, field[c]).alias(c) for c in names], *([F.col("slot").alias(slot_col)] if slot_col else []))


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nr FROM d GROUP BY source
), w AS (
  SELECT *, CAST(CASE (nr - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight, source_size * CAST({PASSES} AS DOUBLE) AS full_size FROM s
), r AS (
  SELECT *, full_size / weight AS ratio, (SELECT sum(source_size) FROM s)::BIGINT AS total, (SELECT sum(weight) FROM w) AS w_all FROM w
), l AS (
  SELECT *, (total * CAST({SHARE} AS DOUBLE) - coalesce(sum(full_size) OVER (ORDER BY ratio, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / (w_all - coalesce(sum(weight) OVER (ORDER BY ratio, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM r
), t AS (
  SELECT nr, source, source_size, total,
         CASE WHEN ratio <= level THEN full_size ELSE weight * (SELECT arg_min(level, ratio) FROM l WHERE ratio > level) END AS target
  FROM l
), b AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS words, (SELECT ceil(sum(target) / {BLOCK_WORDS}) FROM t) AS n,
         CASE WHEN nr = (SELECT max(nr) FROM t) THEN 2.0 ELSE sum(target) OVER (ORDER BY nr) / (SELECT sum(target) FROM t) END AS upto FROM t
), u AS (
  SELECT *, coalesce(lag(upto) OVER (ORDER BY nr), 0) AS since FROM b
), p AS (
  SELECT i, i * CAST({GOLDEN} AS DOUBLE) - floor(i * CAST({GOLDEN} AS DOUBLE)) AS point FROM range(0, (SELECT CAST(max(n) AS BIGINT) FROM b)) AS g(i)
), k AS (
  SELECT p.i AS slot, u.nr, row_number() OVER (PARTITION BY u.nr ORDER BY p.i) - 1 AS rank FROM p JOIN u ON p.point >= u.since AND p.point < u.upto
), h AS (
  SELECT slot, nr, rank FROM k UNION ALL
  SELECT CAST(floor(since * n) AS BIGINT), nr, 0 FROM u WHERE words > 0 AND nr NOT IN (SELECT nr FROM k)
), f AS (
  SELECT u.nr, source, source_size, target, words, count(h.nr) AS blocks FROM u LEFT JOIN h ON u.nr = h.nr GROUP BY ALL
), o AS (
  SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d
), z AS (
  SELECT o.doc_id, o.size, f.nr, f.source_size, f.target, f.words, f.blocks, o.start,
         greatest(least(o.size, words - o.start), 0) + greatest(least(o.size, words - o.start - source_size), 0) AS taken
  FROM o JOIN f ON o.source IS NOT DISTINCT FROM f.source
)
SELECT z.doc_id, CAST(z.size AS BIGINT) AS size, z.source_size, z.target, CAST(z.taken AS BIGINT) AS taken, CAST(coalesce(h.slot, -1) AS BIGINT) AS first_slot
FROM z LEFT JOIN h ON z.taken > 0 AND h.nr = z.nr AND h.rank = ((CAST(z.start AS HUGEINT) + 1) * z.blocks - 1) // nullif(z.words, 0)
"""
