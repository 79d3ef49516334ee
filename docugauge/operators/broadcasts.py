"""Broadcasts behind a check of size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a table that is still broadcast.
SMALL = 100_000


def small(dimension: DataFrame, rows: int = SMALL) -> DataFrame:
    """A broadcast hint if the table has no more rows than that; else Spark joins it as it sees fit."""
    return F.broadcast(dimension) if dimension.limit(rows + 1).count() <= rows else dimension
