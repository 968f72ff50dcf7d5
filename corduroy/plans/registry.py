"""All queries of the engine itself by name: (query, SQL twin or None)."""

from __future__ import annotations

from . import analytic, further, more, relational, streams
from .base import REGISTRY

__all__ = ["all_queries", "analytic", "further", "more", "relational", "streams"]


def all_queries() -> dict:
    return dict(REGISTRY)
