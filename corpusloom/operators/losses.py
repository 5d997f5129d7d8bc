"""Mean losses over a table of scores and gold labels.

Row losses are column expressions; each mean is one partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + x)


def binary_cross_entropy(logits: Column, targets: Column) -> Column:
    """Sum over labels, in the form that does not overflow for large logits."""
    terms = F.zip_with(
        logits, targets, lambda x, y: F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
    )
    return total(terms)


def log_sum_exp(logits: Column) -> Column:
    top = F.array_max(logits)
    return top + F.log(total(F.transform(logits, lambda x: F.exp(x - top))))


def cross_entropy(logits: Column, label: Column) -> Column:
    """-log softmax at the gold class; null for labels below 0."""
    return F.when(label >= 0, log_sum_exp(logits) - F.get(logits, label.cast("int")))


def soft_cross_entropy(logits: Column, targets: Column) -> Column:
    """Cross entropy against a distribution over classes."""
    return log_sum_exp(logits) * total(targets) - total(F.zip_with(logits, targets, lambda x, y: x * y))


def mean_bce(rows: DataFrame, logits: str, targets: str) -> DataFrame:
    """Mean over rows and labels."""
    return rows.agg(
        (F.sum(binary_cross_entropy(F.col(logits), F.col(targets))) / F.sum(F.size(logits))).alias("loss")
    )


def mean_ce(rows: DataFrame, logits: str, label: str) -> DataFrame:
    """Mean over the rows that carry a label, 0 if none does."""
    return rows.agg(
        F.coalesce(F.avg(cross_entropy(F.col(logits), F.col(label))), F.lit(0.0)).alias("loss")
    )


def mean_soft_ce(rows: DataFrame, logits: str, targets: str) -> DataFrame:
    return rows.agg(F.avg(soft_cross_entropy(F.col(logits), F.col(targets))).alias("loss"))


def mean_squared_error(rows: DataFrame, score: str, target: str) -> DataFrame:
    gap = F.col(score) - F.col(target)
    return rows.agg(F.avg(gap * gap).alias("loss"))
