"""All registered queries."""

from __future__ import annotations

from . import basics, domain, grouped, models, scalars, whole  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
