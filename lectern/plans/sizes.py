"""Broadcasts behind a check of size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A side of a join is broadcast if it has no more rows of so many bytes than fit in BYTES.
BYTES = 64 << 20


def broadcast_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if its counted rows stay under BYTES; otherwise as it is, and the planner shuffles both sides."""
    limit = BYTES // row_bytes
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
