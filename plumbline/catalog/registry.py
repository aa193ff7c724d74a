"""All registered queries and their SQL equivalents."""

from __future__ import annotations

import importlib

from plumbline.catalog.views import QUERIES, SQL

MODULES = (
    "rule_queries", "profile_queries", "statistic_queries", "detector_queries",
    "fusion_queries", "report_queries", "record_queries", "source_queries",
)


def load() -> tuple[dict, dict]:
    for name in MODULES:
        importlib.import_module(f"plumbline.catalog.{name}")
    return dict(QUERIES), dict(SQL)
