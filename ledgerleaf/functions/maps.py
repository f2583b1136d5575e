"""Maps: lookup, overlay, and entries as lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def get(m: Column, key: Column | str) -> Column:
    """The value of a key; null without it, and for a null map."""
    return F.try_element_at(m, F.lit(key) if isinstance(key, str) else key)


def has(m: Column, key: Column | str) -> Column:
    """Whether a key is there, whatever its value; false for a null map."""
    return F.coalesce(F.map_contains_key(m, F.lit(key) if isinstance(key, str) else key), F.lit(False))


def overlay(below: Column, above: Column) -> Column:
    """Both maps as one: values of ``above`` win, keys keep the place at which they came first; null counts as empty."""
    none = F.map_filter(F.coalesce(below, above), lambda k, v: F.lit(False))
    a, b = F.coalesce(below, none), F.coalesce(above, none)
    won = F.transform_values(a, lambda k, v: F.when(F.map_contains_key(b, k), F.try_element_at(b, k)).otherwise(v))
    return F.map_concat(won, F.map_filter(b, lambda k, v: ~F.map_contains_key(a, k)))


def lines(m: Column, sep: str = "=") -> Column:
    """``key=value`` lines in the order of the entries; null values are empty."""
    return F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"].cast("string"), F.lit(sep), F.coalesce(e["value"].cast("string"), F.lit("")))), "\n")
