"""Small driver-side inputs: settings, message catalogs, service catalogs, argument checks."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.plans import rules as R

PROVIDER_SCHEMA = "id string, name string, base_url string, models array<string>, needs_key boolean, messages_api boolean"


def load_settings(path: str | None = None, environment: Mapping[str, str] | None = None) -> dict[str, str]:
    """``KEY=VALUE`` lines of a file, quotes stripped, overlaid by the environment."""
    out: dict[str, str] = {}
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                if m := re.match(r"\s*([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$", line):
                    out[m[1]] = re.sub(r"^([\"'])(.*)\1$", r"\2", m[2])
    return out | dict(os.environ if environment is None else environment)


def message(catalogs: Mapping[str, Mapping[str, str]], key: str, lang: str, **params: object) -> str:
    """A message in a language, else in Spanish, else its key, with ``{name}`` filled in."""
    text = catalogs.get(lang, {}).get(key) or catalogs.get("es", {}).get(key) or key
    for k, v in params.items():
        text = text.replace("{" + k + "}", str(v))
    return text


def message_column(catalogs: Mapping[str, Mapping[str, str]], key: Column, lang: Column, params: Column | None = None) -> Column:
    """Messages by columns: that of the language, else the Spanish one, else the key; null only for a null key.

    Catalogs become one map literal.  ``params`` maps names to texts; each
    ``{name}`` is replaced literally, in the order of the names, by its value
    (null: an empty text).
    """
    entries = [F.lit(x) for code, texts in catalogs.items() for k, v in texts.items() for x in (f"{code}\n{k}", v)]
    known = F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")
    found = lambda code: F.nullif(F.element_at(known, F.concat_ws("\n", code, key)), F.lit(""))
    text = F.when(key.isNotNull(), F.coalesce(F.when(lang.isNotNull(), found(lang)), found(F.lit("es")), key))
    if params is None:
        return text
    pairs = F.array_sort(F.map_entries(F.coalesce(params, F.create_map().cast("map<string,string>"))))
    return F.aggregate(pairs, text, lambda t, p: F.replace(t, F.concat(F.lit("{"), p["key"], F.lit("}")), F.coalesce(p["value"], F.lit(""))))


def detect_language(environment: Mapping[str, str]) -> str:
    """es or en, by the first of the usual settings that is there."""
    said = next((environment[k] for k in ("LEDGERLEAF_LANG", "LC_ALL", "LC_MESSAGES", "LANG") if environment.get(k)), "")
    return "es" if said.lower().startswith("es") else "en"


def providers(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A catalog of model services as a frame: id, name, base_url, models, needs_key, messages_api."""
    return spark.createDataFrame(rows, PROVIDER_SCHEMA)


def provider_by_id(catalog: DataFrame, provider: str) -> DataFrame:
    """The entry of that id, with its first model as the default."""
    return catalog.filter(F.col("id") == provider).withColumn("default_model", F.get("models", F.lit(0)))


def check_input(name: str | None = None, max_pages: int | None = None, max_chars: int | None = None, prompt: str | None = None, max_tokens: int | None = None, path: str | None = None) -> None:
    """Raise ValueError for arguments out of their ranges."""
    for what, value, high in (("max_pages", max_pages, R.HARD_PAGES), ("max_chars", max_chars, R.HARD_CHARS)):
        if value is not None and not (type(value) is int and 1 <= value <= high):
            raise ValueError(f"{what} must be an integer from 1 to {high}")
    if name is not None and not (isinstance(name, str) and 1 <= len(name) <= 256):
        raise ValueError("name must have 1 to 256 characters")
    if path is not None and not (isinstance(path, str) and 1 <= len(path) <= 4096):
        raise ValueError("path must have 1 to 4096 characters")
    if prompt is not None and not (isinstance(prompt, str) and 1 <= len(prompt) <= 16_000):
        raise ValueError("prompt must have 1 to 16000 characters")
    if max_tokens is not None and not (type(max_tokens) is int and 256 <= max_tokens <= 16_000):
        raise ValueError("max_tokens must be an integer from 256 to 16000")
