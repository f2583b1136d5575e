"""Exact dedup by content sort.

Texts are normalised (A-Z lower-cased, null as empty), range-partitioned by
splitters that Spark samples, and sorted within each partition by the spilling
external sort.  The splitters are (first characters, hash of the whole, id), so
that the sample the driver gets has a bounded number of bytes a row; the sort
goes on by the whole normalised bytes.  Equal texts then stand next to each
other, and a single forward pass compares each text in full with the one before
it.  The id is part of the range key, so a text that holds a third of all rows
is dealt over as many partitions as its rows need; runs that touch a
partition's edge are joined again by a table of at most two rows a partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerleaf.llm.common import bound_batches, lower_ascii, small_or_not, staged

#: Characters of a text that its splitter key begins with.
PREFIX_CHARS = 32


def _runs_of(id_type: pa.DataType, keep_largest: bool):
    """The pass over one sorted partition: a row out for each row in, when its run has ended."""
    out_schema = pa.schema([("id", id_type), ("text_sha256", pa.string()), ("keep_id", id_type), ("group_size", pa.int64()), ("is_keep", pa.bool_()), ("is_last", pa.bool_()), ("edge", pa.bool_()), ("part", pa.int32())])

    def ended(ids: list, digest: str, edge: bool, part: int, out: list[list]) -> None:
        n = len(ids)
        at = n - 1 if keep_largest else next((k for k, x in enumerate(ids) if x is not None), 0)
        for k, x in enumerate(ids):
            for column, value in zip(out, (x, digest, ids[at], n, k == at, k == n - 1, edge, part), strict=True):
                column.append(value)

    def batch_of(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, out_schema, strict=True)], schema=out_schema)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        text, digest, ids, first = None, "", [], True
        out: list[list] = [[] for _ in out_schema]
        for batch in batches:
            for x, now in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                now = now.as_py()
                if now != text:
                    if text is not None:
                        ended(ids, digest, first, part, out)
                        first = False
                    text, digest, ids = now, hashlib.sha256(now).hexdigest(), []
                ids.append(x)
                if len(out[0]) >= 20_000:
                    yield batch_of(out)
                    out = [[] for _ in out_schema]
        if text is not None:
            ended(ids, digest, True, part, out)
            yield batch_of(out)

    return runs


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Of rows with equal normalised text the one with the largest (or
    ``keep="smallest"``) id stays.  Null text counts as empty.  Null ids come
    before all others: such a row stays only if its group has no other id.  Of
    rows that repeat both text and id, exactly one stays.  An empty table gives
    an empty result; other columns of ``df`` are not read.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep must be 'largest' or 'smallest'")
    spark = df.sparkSession
    bound_batches(spark)
    largest = keep == "largest"
    id_type = df.schema[id_col].dataType
    slim = df.select(F.col(f"`{id_col}`").alias("id"), lower_ascii(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("norm"))
    keyed = slim.select("id", "norm", F.substring("norm", 1, PREFIX_CHARS).alias("head"), F.xxhash64("norm").alias("tail"))
    ordered = keyed.repartitionByRange("head", "tail", "id").sortWithinPartitions("head", "tail", "norm", "id")
    schema = T.StructType([T.StructField("id", id_type), T.StructField("text_sha256", T.StringType()), T.StructField("keep_id", id_type), T.StructField("group_size", T.LongType()), T.StructField("is_keep", T.BooleanType()), T.StructField("is_last", T.BooleanType()), T.StructField("edge", T.BooleanType()), T.StructField("part", T.IntegerType())])
    from pyspark.sql.pandas.types import to_arrow_type

    passed = ordered.select("id", F.col("norm").cast("binary").alias("norm")).mapInArrow(_runs_of(to_arrow_type(id_type), largest), schema)
    rows = staged(passed, "exact-dedup")
    best = F.max(F.struct("keep_id", "part")) if largest else F.min(F.struct(F.col("keep_id").isNull().alias("none"), "keep_id", "part"))
    # At most two rows a partition: its first run and its last.
    edges = rows.filter("edge AND is_last").groupBy("text_sha256").agg(best.alias("best"), F.sum("group_size").alias("total"), F.count("*").alias("parts")).filter("parts > 1")
    joined = rows.join(F.broadcast(edges), "text_sha256", "left")
    spans = F.col("edge") & F.col("total").isNotNull()
    return joined.select(
        F.col("id").alias(id_col),
        F.when(spans, F.col("best.keep_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(spans, F.col("total")).otherwise(F.col("group_size")).alias("group_size"),
        (F.col("is_keep") & (~spans | (F.col("best.part") == F.col("part")))).alias("kept"),
        "text_sha256",
    )


def _kept_of(largest: bool):
    """The pass over one sorted partition of whole rows: of each run its last row (or its first), when the run has ended.

    The first and the last run of a partition, which may go on in others, come with their digest.
    """

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        text, row, first = None, None, True  # of the open run; whether it is the partition's first

        def given(rows: pa.Array, edge: bytes | None) -> pa.RecordBatch:
            digests = [hashlib.sha256(edge).digest() if edge is not None else None] + [None] * (len(rows) - 1)
            return pa.RecordBatch.from_arrays([rows, pa.array(digests, pa.binary()), pa.array([part] * len(rows), pa.int32())], names=["row", "digest", "part"])

        for batch in batches:
            rows, texts = batch.column(0), batch.column(1).to_pylist()
            starts = [k for k, t in enumerate(texts) if t != (texts[k - 1] if k else text)]
            ends = [k - 1 for k in starts[1:]] + [len(texts) - 1]
            if largest and text is not None and texts and (not starts or starts[0]):
                row = rows.slice(starts[0] - 1 if starts else len(texts) - 1, 1)
            if not starts:
                continue
            if text is not None:
                yield given(row, text if first else None)
                first = False
            picks = ends if largest else starts
            if len(starts) > 1:
                yield given(rows.take(pa.array(picks[:-1])), texts[0] if first else None)
                first = False
            text, row = texts[-1], rows.slice(picks[-1], 1)
        if text is not None:
            yield given(row, text)

    return kept


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """``df`` without the rows that ``exact_dedup`` drops; all columns stay, whatever their names.

    Null text counts as empty; of equal texts the row with the largest (or
    smallest) id stays, one without an id only if no other has one; of rows that
    repeat both text and id, exactly one.  An empty table stays empty.

    Whole rows go through the same content sort, once, and the pass gives only
    the rows that stay: no second read, and no join but that of the partitions'
    edges.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep must be 'largest' or 'smallest'")
    bound_batches(df.sparkSession)
    largest = keep == "largest"
    names = df.columns
    packed = df.select(F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)]).alias("row"))
    text = F.col(f"row.c{names.index(text_col)}")
    # The run's row that stays is its last one or, with the smallest id and no null before it, its first.
    by = F.col("id") if largest else F.col("id").asc_nulls_last()
    keyed = packed.select("row", F.col(f"row.c{names.index(id_col)}").alias("id"), lower_ascii(F.coalesce(text, F.lit(""))).alias("norm"))
    keyed = keyed.select("row", "id", F.substring("norm", 1, PREFIX_CHARS).alias("head"), F.xxhash64("norm").alias("tail"))
    # The normalised text is made again on the other side, so that each text is shuffled once.
    dealt = keyed.repartitionByRange("head", "tail", by).withColumn("norm", lower_ascii(F.coalesce(text, F.lit(""))).cast("binary"))
    ordered = dealt.sortWithinPartitions("head", "tail", "norm", by)
    schema = T.StructType([T.StructField("row", packed.schema["row"].dataType), T.StructField("digest", T.BinaryType()), T.StructField("part", T.IntegerType())])
    rows = staged(ordered.select("row", "norm").mapInArrow(_kept_of(largest), schema), "exact-kept")
    # At most two rows a partition have a digest: that of its first run and of its last.
    own = F.struct(F.col(f"row.c{names.index(id_col)}").alias("id"), "part")
    best = F.max(own) if largest else F.min(F.struct(own["id"].isNull().alias("none"), own["id"].alias("id"), F.col("part")))
    edges = rows.filter("digest IS NOT NULL").groupBy("digest").agg(best.alias("best"), F.count("*").alias("parts")).filter("parts > 1").select("digest", F.col("best.part").alias("stays"))
    out = rows.join(F.broadcast(edges), "digest", "left").filter("stays IS NULL OR stays = part")
    return out.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(names)])


ORACLE = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM t
"""
