"""Registry of the library's queries over the driver's tables, and their SQL."""

from __future__ import annotations

from .plans import attempts, audio, checks, ends, frames, records, registry, relations, routing, series, streams, tracks
from .plans.frames import flagship

MODULES = [frames, series, relations, routing, tracks, checks, ends, audio, streams, attempts, records]


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)


__all__ = ["flagship", "oracle_sql", "queries"]
