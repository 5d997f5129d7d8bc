"""Document vectors from segment vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def max_pool(segments: DataFrame, document: str, vector: str, real: Column | None = None) -> DataFrame:
    """Element-wise maximum over the segments of each document.

    Rows where ``real`` is false (padding) are left out; pass nothing to pool all.
    The maxima are combined on the map side, so a document with very many
    segments sends one row per dimension and task.
    """
    kept = segments if real is None else segments.where(real)
    maxima = (
        kept.select(document, F.posexplode(vector).alias("_dim", "_x"))
        .groupBy(document, "_dim")
        .agg(F.max("_x").alias("_x"))
    )
    ordered = F.sort_array(F.collect_list(F.struct("_dim", "_x")))
    return maxima.groupBy(document).agg(F.transform(ordered, lambda c: c["_x"]).alias(vector))


def regroup_choices(rows: DataFrame, example: str, choice: str, score: str) -> DataFrame:
    """One row per (example, choice) back to one ordered score list per example."""
    ordered = F.sort_array(F.collect_list(F.struct(choice, score)))
    return rows.groupBy(example).agg(F.transform(ordered, lambda c: c[score]).alias("scores"))
