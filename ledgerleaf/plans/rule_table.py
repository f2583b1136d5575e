"""Vendors' rules as rows of a table: stored, versioned, read again for each query, never as code.

A row is one slot of one vendor (a marker, a field, a total, the layout of
items) with its shape as JSON.  New rules are appended with the next version; a
vendor's rules are those of its latest.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerleaf.plans import rules as R
from ledgerleaf.plans.shapes import Cell, Labelled

SCHEMA = "vendor string, priority int, version int, slot string, pos int, spec string"
#: Rules are read by the driver, so a table of more rows is refused.
MOST_ROWS = 10_000


def _rows(v: R.Vendor, priority: int, version: int) -> list[tuple]:
    out = [("marker", k, m) for k, m in enumerate(v.markers)]
    if v.tabular:
        out.append(("tabular", 0, True))
    if v.fields:
        out += [(slot, 0, asdict(x)) for slot, x in (("number", v.fields.number), ("date", v.fields.date)) if x]
        out += [("totals", k, [asdict(p) if isinstance(p, Cell) else p for p in parts]) for k, parts in enumerate(v.fields.totals)]
        out += [(f"total:{name}", k, asdict(x)) for k, (name, x) in enumerate(v.fields.each.items())]
    if v.items:
        out.append(("items", 0, {"start": v.items.start, "end": v.items.end, "cells": [asdict(c) for c in v.items.cells]}))
    return [(v.name, priority, version, slot, pos, json.dumps(spec, ensure_ascii=False, sort_keys=True)) for slot, pos, spec in out]


def as_table(spark: SparkSession, vendors: tuple[R.Vendor, ...] = R.VENDORS, version: int = 1) -> DataFrame:
    """The rows of vendors in the order of their priority."""
    return spark.createDataFrame([row for k, v in enumerate(vendors) for row in _rows(v, k, version)], SCHEMA)


def latest(table: DataFrame) -> DataFrame:
    """Of each vendor the rows of its latest version."""
    newest = F.max("version").over(Window.partitionBy("vendor"))
    return table.withColumn("__newest", newest).filter(F.col("version") == F.col("__newest")).drop("__newest")


def with_vendor(table: DataFrame, vendor: R.Vendor) -> DataFrame:
    """The table with a vendor's rules appended: as its next version, or as a new vendor of the least priority."""
    spark = table.sparkSession
    own, every = table.filter(F.col("vendor") == vendor.name).agg(F.max("version"), F.max("priority")).first(), table.agg(F.max("priority")).first()[0]
    priority = own[1] if own[1] is not None else (-1 if every is None else every) + 1
    return table.unionByName(spark.createDataFrame(_rows(vendor, priority, (own[0] or 0) + 1), SCHEMA))


def _labelled(spec: dict) -> Labelled:
    return Labelled(**{**spec, "label": tuple(spec["label"]), "cells": tuple(Cell(**c) for c in spec["cells"])})


def vendors_of(table: DataFrame) -> tuple[R.Vendor, ...]:
    """The vendors of a table, by priority and name."""
    rows = latest(table).select("vendor", "priority", "slot", "pos", "spec").limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a rule table of more than {MOST_ROWS} rows")
    by_vendor: dict[tuple, dict[str, list]] = {}
    for r in sorted(rows, key=lambda r: (r["priority"], r["vendor"], r["slot"], r["pos"])):
        by_vendor.setdefault((r["priority"], r["vendor"]), {}).setdefault(r["slot"], []).append((r["pos"], json.loads(r["spec"])))
    out = []
    for (_, name), slots in by_vendor.items():
        one = lambda slot: _labelled(slots[slot][0][1]) if slot in slots else None  # noqa: B023, E731
        each = sorted((x[0], slot.partition(":")[2], _labelled(x[1])) for slot, found in slots.items() if slot.startswith("total:") for x in found[:1])
        totals = tuple(tuple(Cell(**p) if isinstance(p, dict) else p for p in parts) for _, parts in slots.get("totals", []))
        has_fields = bool({"number", "date", "totals"} & set(slots)) or bool(each)
        items = slots["items"][0][1] if "items" in slots else None
        out.append(
            R.Vendor(
                name,
                tuple(m for _, m in slots.get("marker", [])),
                R.FieldRules(one("number"), one("date"), totals, {k: x for _, k, x in each}) if has_fields else None,
                R.ItemRules(items["start"], items["end"], tuple(Cell(**c) for c in items["cells"])) if items else None,
                "tabular" in slots,
            )
        )
    return tuple(out)


def read_rules(spark: SparkSession, path: str) -> tuple[R.Vendor, ...]:
    """The vendors of a stored table as it is now."""
    return vendors_of(spark.read.schema(SCHEMA).parquet(path))
