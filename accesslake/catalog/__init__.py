"""The registered queries, each with the SQL it must agree with where SQL can say it."""

from __future__ import annotations

from importlib import import_module

from accesslake.catalog.registry import ORACLES, QUERIES

for _part in ("values", "filters", "relations", "metrics", "ranking", "trees", "risks", "ingest", "reports", "streams", "nested", "rule_tables"):
    import_module(f"accesslake.catalog.{_part}")

__all__ = ["ORACLES", "QUERIES"]
