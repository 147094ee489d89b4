"""Joins with lookup tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Beyond this many rows a lookup table is joined by shuffle, not broadcast (16 to 40 bytes a row).
BROADCAST_ROWS = 500_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a fixed (checkpointed) table of narrow rows if it is small; else leave the join to shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
