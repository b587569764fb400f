"""All registered queries and their SQL counterparts, collected from the plan modules."""

from __future__ import annotations

from importlib import import_module

from litspan.plans.registering import ORACLES, QUERIES

for _name in ("documents", "search", "retrieval", "references", "headings", "sections", "navigation", "tables", "state", "questions", "ingest", "derived", "sessions"):
    import_module(f"litspan.plans.{_name}")

__all__ = ["ORACLES", "QUERIES"]
