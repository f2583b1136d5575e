"""Requests as JSON lines: bounded, parsed, and with their payloads decoded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.functions import text as T
from ledgerleaf.plans import rules as R
from ledgerleaf.sources import files

SCHEMA = "name string, payload string, max_pages int, max_chars int, prompt string"


def request_error(body: Column, most: int = R.REQUEST_BYTES) -> Column:
    """The code of a body's fault: too large (then it is not parsed), empty or no JSON object; null for none."""
    parsed = F.when(F.octet_length(body) <= most, F.try_parse_json(body))
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT<"), F.lit(False))
    return F.when(F.octet_length(body) > most, "request_too_large").when(F.coalesce(F.trim(body) == "", F.lit(True)), "request_empty").when(~is_object, "invalid_json")


def requests(rows: DataFrame, body: str = "value", schema: str = SCHEMA, most: int = R.REQUEST_BYTES) -> DataFrame:
    """``rows`` with ``error`` and ``request``: the parsed body, null where there is an error."""
    checked = rows.withColumn("error", request_error(F.col(body), most))
    return checked.withColumn("request", F.when(F.col("error").isNull(), F.from_json(body, schema)))


def read_requests(spark: SparkSession, path: str, schema: str = SCHEMA, most: int = R.REQUEST_BYTES) -> DataFrame:
    """``error, request, content`` of JSON lines; ``content`` is the strict base64 payload, null if it isn't that.

    A line over the cap is never in memory as a whole: see files.read_lines().
    """
    lines = files.read_lines(spark, path, most)
    read = requests(lines, schema=schema, most=most)
    over = F.col("value").isNull()
    error = F.when(over, "request_too_large").otherwise(F.col("error"))
    return read.select(error.alias("error"), "request", T.strict_base64(F.col("request.payload")).alias("content"))
