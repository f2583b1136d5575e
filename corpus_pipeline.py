"""The corpus pipeline: clean, drop exact and near copies, mix the sources, pack into sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept.  All but the last return the columns of ``documents``: the first removes
failing lines from the texts it keeps and the fourth repeats documents that are
taken twice (and cuts the one in which a source's last block ends), so ``text``
and ``n_chars`` follow the decisions.  The last returns a row for each piece of
a document in a packed sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerleaf.llm.common import staged, table
from ledgerleaf.llm.exact_dedup import drop_exact_copies
from ledgerleaf.llm.mixing import mixed_documents
from ledgerleaf.llm.near_dedup import drop_near_copies
from ledgerleaf.llm.packing import pack_documents
from ledgerleaf.llm.quality_rules import clean_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("minhash_near_dedup", near), ("source_mixing", mix), ("best_fit_packing", pack)]

#: SQL can express neither the near-duplicate components nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
