"""Arrays to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unroll(rows: DataFrame, keep: Sequence[str], items: Column | str, position: str, item: str) -> DataFrame:
    """One row per array item with its 0-based position; null and empty arrays give none.

    The plain ``posexplode`` makes Spark infer ``size(items) > 0`` below it, which
    computes ``items`` once more per row; for tokenised text that doubles the work.
    """
    return rows.select(*keep, F.posexplode_outer(items).alias(position, item)).where(F.col(position).isNotNull())
