"""Early stopping over a table of per-epoch metrics.

The windows run per training run; a run has at most as many rows as the trainer
has epochs, so they stay small however many runs there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_stop_flag(epochs: DataFrame, run: Sequence[str], epoch: str, metric: str, patience: int = 3) -> DataFrame:
    """Adds ``waited``: epochs in a row that did not beat the best so far, and ``stops``."""
    order = Window.partitionBy(*run).orderBy(epoch)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best = F.max(metric).over(before)
    improved = best.isNull() | (F.col(metric) > best)
    numbered = epochs.withColumn("_n", F.row_number().over(order)).withColumn("_improved", improved)
    last_gain = F.max(F.when(F.col("_improved"), F.col("_n"))).over(so_far)
    return (
        numbered.withColumn("waited", F.col("_n") - last_gain)
        .withColumn("stops", F.col("waited") >= patience)
        .drop("_n", "_improved")
    )


def early_stop(epochs: DataFrame, run: Sequence[str], epoch: str, metric: str, patience: int = 3) -> DataFrame:
    """Per run: the epoch training ends at, and whether patience ended it before the last epoch's turn."""
    flagged = with_stop_flag(epochs, run, epoch, metric, patience)
    return (
        flagged.groupBy(*run)
        .agg(F.min(F.when(F.col("stops"), F.col(epoch))).alias("_stop"), F.max(epoch).alias("_last"))
        .select(*run, F.coalesce("_stop", "_last").alias("stop_epoch"), F.col("_stop").isNotNull().alias("out_of_patience"))
    )


def best_epoch(epochs: DataFrame, run: Sequence[str], epoch: str, metric: str, patience: int = 3) -> DataFrame:
    """Per run: the first epoch with the highest metric among those trained before stopping."""
    flagged = with_stop_flag(epochs, run, epoch, metric, patience)
    so_far = Window.partitionBy(*run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    trained = flagged.withColumn("_stopped", F.coalesce(F.max("stops").over(so_far), F.lit(False)))
    pick = F.max(F.struct(F.col(metric), (-F.col(epoch)).alias("_back")))
    return (
        trained.where(~F.col("_stopped"))
        .groupBy(*run)
        .agg(pick.alias("_best"))
        .select(*run, (-F.col("_best._back")).alias("best_epoch"), F.col(f"_best.{metric}").alias(metric))
    )
