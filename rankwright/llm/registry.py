"""All queries of this subpackage."""

from __future__ import annotations

import importlib

MODULES = [
    "language_id", "mixing", "near_dedup", "quality", "packing", "fingerprints", "pii", "exact_dedup", "chat", "licenses",
    "divergence", "media", "centroids",
]


def _all(attr: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"rankwright.llm.{name}"), attr)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("SQL")
