"""The registered queries and their SQL counterparts."""

from __future__ import annotations

from workload import deep, filters, intake, many, measures, pack, reports, rollups, sketches, streams, tables, upkeep  # noqa: F401
from workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
