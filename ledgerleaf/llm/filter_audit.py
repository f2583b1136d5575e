"""How filters interact: what each would remove, alone and after the others, in every order.

Texts are scanned in Arrow's own buffers: byte classes are NumPy look-ups over
the batch's data, and prefix sums at the texts' offsets count words, capitals,
symbols and code points without touching one text by itself.  Distinct words
are counted by sorting (text, hash of the word); neighbours with equal hashes
are compared byte by byte.  A document becomes a mask of the filters that it
fails; masks are counted by part, and all orders are read off these 32 counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm.common import bound_batches, dealt, small_or_not, staged

FILTERS = "ABCDE"
#: A: fewer words than this; B: distinct words under this per cent; C: capitals over this per cent of code points.
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
SYMBOLS = b"#$%&*|"
BLANK_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"

IS_WORD = np.ones(256, bool)
IS_WORD[list(BLANK_BYTES)] = False
IS_CAPITAL = np.zeros(256, bool)
IS_CAPITAL[ord("A") : ord("Z") + 1] = True
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(SYMBOLS)] = True
#: Bytes for which hashes and comparisons are made at a time.
PIECE_BYTES = 1 << 20
#: The first byte of a code point in UTF-8.
IS_FIRST = (np.arange(256) & 0xC0) != 0x80
#: An odd factor, so that its powers can be taken back modulo 2^64.
FACTOR = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a batch of texts and where each begins, with the end after the last; nulls are empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def counted(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags each text has: a prefix sum, read at the offsets."""
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end; no word goes on from one text to the next."""
    word = IS_WORD[data]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    # Texts that meet without a blank: a word ends with the text and another begins with the next.
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner] = word[inner]
    ends[inner - 1] = word[inner - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def _pieces(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Neighbouring items in groups of some PIECE_BYTES each, so that what is made for a group stays small."""
    if not len(sizes):
        return []
    group = np.cumsum(sizes) // PIECE_BYTES
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word: a polynomial of its bytes modulo 2^64, by prefix sums, mixed with its length."""
    out = np.zeros(len(begins), np.uint64)
    with np.errstate(over="ignore"):
        for i, j in _pieces(np.diff(begins, append=ends[-1:])):
            b, e = begins[i:j] - begins[i], ends[i:j] - begins[i]
            part = data[begins[i] : ends[j - 1]].astype(np.uint64) + np.uint64(1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * np.cumprod(np.full(len(part), FACTOR, np.uint64)), dtype=np.uint64)])
            back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(part) - 1, BACK, np.uint64)]))
            h = (sums[e] - sums[b]) * back[b]
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            out[i:j] = (h ^ (h >> np.uint64(29))) + (e - b).astype(np.uint64)
    return out


def _equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether data[a : a + size] and data[b : b + size] are the same, pair by pair; sizes are positive."""
    out = np.zeros(len(a), bool)
    for i, j in _pieces(sizes):
        n = sizes[i:j]
        first = np.cumsum(n) - n
        place = np.arange(n.sum()) - np.repeat(first, n)
        out[i:j] = np.logical_and.reduceat(data[np.repeat(a[i:j], n) + place] == data[np.repeat(b[i:j], n) + place], first)
    return out


def distinct_words(data: np.ndarray, offsets: np.ndarray, begins: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Distinct words of each text: sorted by text and hash, each is compared with the one before it.

    Words of one hash that differ (they are then counted exactly) do not make a
    wrong number: the comparison decides, not the hash.
    """
    n = len(offsets) - 1
    if not len(begins):
        return np.zeros(n, np.int64)
    text = np.searchsorted(offsets, begins, side="right") - 1
    order = np.lexsort((hashes, text))
    text, hashes, begins, sizes = text[order], hashes[order], begins[order], (ends - begins)[order]
    alike = np.concatenate([[False], (text[1:] == text[:-1]) & (hashes[1:] == hashes[:-1])])
    same = alike.copy()
    k = np.flatnonzero(alike)
    same[k] = sizes[k] == sizes[k - 1]
    k = k[same[k]]
    same[k] = _equal_bytes(data, begins[k], begins[k - 1], sizes[k])
    found = np.bincount(text[~same], minlength=n).astype(np.int64)
    for run in np.unique(np.cumsum(~alike)[alike & ~same]):
        at = np.flatnonzero(np.cumsum(~alike) == run)
        words = {data[begins[i] : begins[i] + sizes[i]].tobytes() for i in at}
        found[text[at[0]]] += len(words) - int((~same[at]).sum())
    return found


def text_masks(texts: pa.Array) -> np.ndarray:
    """For each text of a batch the filters A to D that it fails, as bits 0 to 3."""
    data, offsets = buffers(texts)
    begins, ends = word_bounds(data, offsets)
    words = np.searchsorted(begins, offsets[1:]) - np.searchsorted(begins, offsets[:-1])
    distinct = distinct_words(data, offsets, begins, ends, word_hashes(data, begins, ends))
    fails = (
        words < LEAST_WORDS,
        100 * distinct < DISTINCT_PERCENT * words,
        100 * counted(IS_CAPITAL[data], offsets) > CAPITAL_PERCENT * counted(IS_FIRST[data], offsets),
        counted(IS_SYMBOL[data], offsets) > 0,
    )
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def failed_filters(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``id, part, mask`` of every document: bit k is set if it fails the k-th filter.

    E compares whole texts by their SHA-256: a document fails if a smaller id
    has the text.  Null texts are empty, null parts an empty string; a null id
    comes after all others, and rows of one id and text are not copies of each
    other.
    """
    bound_batches(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()
    rows = dealt(df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")))
    rows = rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), "text")

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(text_masks(batch.column(3)), pa.int32())], names=["id", "part", "digest", "mask"])

    each = staged(rows.mapInArrow(scanned, f"id {id_type}, part string, digest binary, mask int"), "audit-masks")
    # Only texts that occur more than once have anything to look up; staged, so that a hot text can be split in the join.
    firsts = each.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    joined = each.join(small_or_not(staged(firsts, "audit-firsts")), "digest", "left")
    later = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first")))
    return joined.select("id", "part", F.when(later, F.col("mask").bitwiseOR(1 << 4)).otherwise(F.col("mask")).alias("mask"))


MASKS = 1 << len(FILTERS)


def order_tables() -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """Every (order, step), and for each measure which masks it counts, how often: a row a (order, step), a column a mask."""
    masks = np.arange(MASKS)
    sizes = np.array([bin(m).count("1") for m in masks])
    keys, rows = [], {k: [] for k in ("kept", "removed", "redundant", "unique_fails", "shapley")}
    orders = list(permutations(FILTERS))
    for order in orders:
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            fails, earlier = (masks & bit) > 0, (masks & before) > 0
            keys.append(("".join(order), step))
            rows["kept"].append((masks & (before | bit)) == 0)
            rows["removed"].append(fails & ~earlier)
            rows["redundant"].append(fails & earlier)
            rows["unique_fails"].append(masks == bit)
            # Of all orders, each of a document's failed filters comes first in as many.
            rows["shapley"].append(np.where(fails, len(orders) // np.maximum(sizes, 1), 0))
            before |= bit
    return keys, {k: np.array(v, np.int64) for k, v in rows.items()}


MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def filter_audit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """``part, filter_order, step`` and the seven measures: every order of the five filters, by part.

    Rows are as failed_filters treats them.  A document is good (toxic) if any
    of its labels is 1; null ids have no label.  An empty table gives an empty
    result; other columns are not read.
    """
    masks = failed_filters(df, id_col, text_col, part_col)
    known = labels.select(F.col(f"`{id_col}`").alias("id_"), (F.col(f"`{good_col}`") == 1).cast("int").alias("good"), (F.col(f"`{toxic_col}`") == 1).cast("int").alias("toxic")).filter("id_ IS NOT NULL")
    known = known.groupBy("id_").agg(F.coalesce(F.max("good"), F.lit(0)).alias("good"), F.coalesce(F.max("toxic"), F.lit(0)).alias("toxic"))
    rows = masks.join(known, F.col("id") == F.col("id_"), "left")
    counts = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    # 32 rows a part at most.
    by_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, use = order_tables()
        orders, steps = pa.array([o for o, _ in keys], pa.string()), pa.array([s for _, s in keys], pa.int32())
        for batch in batches:
            for part, found in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                n, good, toxic = np.zeros((3, MASKS), np.int64)
                for c in found:
                    n[c["mask"]], good[c["mask"]], toxic[c["mask"]] = c["n"], c["good"], c["toxic"]
                values = {k: use[k] @ n for k in use} | {"good_lost": use["removed"] @ good, "toxic_lost": use["removed"] @ toxic}
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * len(keys), pa.string()), orders, steps, *(pa.array(values[m], pa.int64()) for m in MEASURES)], names=["part", "filter_order", "step", *MEASURES])

    return by_part.mapInArrow(measured, "part string, filter_order string, step int, " + ", ".join(f"{m} bigint" for m in MEASURES))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), m AS (
  SELECT doc_id, part,
         CAST(len(words) < 200 AS INTEGER) AS a,
         CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INTEGER) AS b,
         CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS INTEGER) AS c,
         CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER) AS d,
         CAST(doc_id > min(doc_id) OVER (PARTITION BY t) AS INTEGER) AS e
  FROM w
), l AS (
  SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id
), n AS (
  SELECT part, a, b, c, d, e, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM m LEFT JOIN l ON m.doc_id = l.doc_id GROUP BY ALL
), f AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (
  SELECT f1.x || f2.x || f3.x || f4.x || f5.x AS filter_order FROM f f1, f f2, f f3, f f4, f f5
  WHERE f2.x <> f1.x AND f3.x NOT IN (f1.x, f2.x) AND f4.x NOT IN (f1.x, f2.x, f3.x) AND f5.x NOT IN (f1.x, f2.x, f3.x, f4.x)
), s AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step:step] AS letter, filter_order[1:step - 1] AS earlier FROM o, range(1, 6) AS g(step)
), v AS (
  SELECT part, filter_order, step, letter, n, good, toxic,
         CASE letter WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS fails, a + b + c + d + e AS failed,
         (contains(earlier, 'A') AND a = 1) OR (contains(earlier, 'B') AND b = 1) OR (contains(earlier, 'C') AND c = 1) OR (contains(earlier, 'D') AND d = 1) OR (contains(earlier, 'E') AND e = 1) AS gone
  FROM n, s
), r AS (
  SELECT part, filter_order, step, letter,
         coalesce(sum(n) FILTER (fails = 0 AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (fails = 1 AND NOT gone), 0) AS removed,
         coalesce(sum(n) FILTER (fails = 1 AND gone), 0) AS redundant, coalesce(sum(n) FILTER (fails = 1 AND failed = 1), 0) AS unique_fails,
         coalesce(sum(good) FILTER (fails = 1 AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails = 1 AND NOT gone), 0) AS toxic_lost
  FROM v GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM r
"""
