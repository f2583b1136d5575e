"""Vendor rules from labels: what a person or a model says about a layout becomes a checked rule, never code."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.operators import fields
from ledgerleaf.plans import rules as R
from ledgerleaf.plans import shapes as S


def _label(text: str) -> str:
    """A label on one line, without control characters."""
    return re.sub(r"\s+", " ", re.sub(r"[\x00-\x1f\x7f]", " ", text)).strip()


def vendor_slug(name: str) -> str:
    return re.sub("[^a-z0-9]+", "", name.lower())


def vendor_from_labels(name: str, markers: list[str], labels: Mapping[str, str]) -> R.Vendor:
    """A vendor whose values stand right after labels: ``number``, ``date``, ``subtotal``, ``tax``, ``total``."""
    slug = vendor_slug(name)
    if not slug or not [m for m in markers if m.strip()]:
        raise ValueError("a vendor needs a name and a marker")
    after = lambda label, cell, near=0: S.Labelled((_label(label),), (cell,), gap=S.ANY, near=near)
    return R.Vendor(
        slug,
        tuple(S.phrase(_label(m)) for m in markers if m.strip()),
        R.FieldRules(
            number=after(labels["number"], R.ANY_NUMBER) if labels.get("number") else None,
            date=after(labels["date"], R.ANY_DATE, R.DATE_NEAR) if labels.get("date") else None,
            each={k: after(labels.get(k) or "Total", S.Cell("amount")) for k in fields.TOTALS if labels.get(k) or k == "total"},
        ),
    )


def validated(vendor: R.Vendor, samples: DataFrame, known: tuple[R.Vendor, ...] = R.VENDORS, text: str = "text") -> tuple[R.Vendor, ...]:
    """``known`` with the new vendor, after a check on sample texts.

    Refused are names that are taken, samples that a known vendor's markers
    claim, and rules that find no number, date or total in any sample.
    """
    if vendor.name in {v.name for v in known}:
        raise ValueError(f"vendor exists: {vendor.name}")
    body = F.col(text)
    v = fields.vendor_fields(body, F.lit(vendor.name), (vendor,))
    found = samples.agg(
        F.max(fields.detect_vendor(body, known)).alias("claimed"),
        F.count_if(fields.detect_vendor(body, (vendor,)).isNotNull() & (v["invoice_number"].isNotNull() | v["invoice_date"].isNotNull() | v["totals"]["total"].isNotNull())).alias("n"),
    ).first()
    if found["claimed"]:
        raise ValueError(f"the sample belongs to a known vendor: {found['claimed']}")
    if not found["n"]:
        raise ValueError("the rules find nothing in the samples")
    return (*known, vendor)
