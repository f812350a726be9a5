"""Named queries over the test tables, each with the SQL that it is held against."""

from __future__ import annotations

from . import activity, aligning, browsing, citing, cleaning, reading, retrieval, scalars, sources, streams  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
