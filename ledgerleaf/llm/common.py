"""What the training-data operators share: text normalisation, staged tables, word splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.functions.staging import shared_dir, shared_path, staged

__all__ = ["shared_dir", "shared_path", "staged"]

#: A word is a run of anything but these six ASCII blanks.
BLANKS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Of one Arrow batch: the JVM and its worker each hold several at a time.
BATCH_BYTES = 4 << 20
#: Bytes a core below which an input may have too few splits.
SMALL_INPUT = 64 << 20
#: Keys (some 100 bytes each at most) are broadcast up to this number.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables; the path goes to Spark's reader alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(col, UPPER, UPPER.lower())


def words(col: Column) -> Column:
    """The words of a text as an array (null: empty), with built-in functions only."""
    plain = F.coalesce(col, F.lit(""))
    for blank in BLANKS[1:]:
        plain = F.replace(plain, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(plain, " "), "")


def n_words(col: Column) -> Column:
    """How many words a text has (null: none)."""
    return F.regexp_count(F.coalesce(col, F.lit("")), F.lit(WORD)).cast("long")


def dealt(df: DataFrame) -> DataFrame:
    """Rows of few small files, which Spark reads in fewer tasks than there are cores, dealt over all cores.

    For operators that cost CPU, not bytes.  An input of 64 MB a core or more, or
    of as many files as cores, stays as it is: it has enough splits, and is never
    shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= cores * SMALL_INPUT:
        return df
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df


def bound_batches(spark: SparkSession) -> None:
    """Cap the bytes of one Arrow batch, so that very long texts can't fill a worker's memory.

    Spark reads the cap of the session when a plan runs, which is after this
    library has returned it, so the setting stays: only a session that has no
    cap, or a larger one, is changed, and a smaller one of its own is kept.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    digits = "".join(c for c in str(now) if c.isdigit())
    if not digits or str(now).startswith("-") or int(digits) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def small_or_not(keys: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Staged key rows, marked to be broadcast if they are at most ``most``, else to be joined by a shuffle."""
    return F.broadcast(keys) if keys.count() <= most else keys.hint("merge")
