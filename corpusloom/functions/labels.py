"""Gold labels and predictions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def multi_hot(labels: Column, n_labels: int) -> Column:
    """0/1 vector over labels 0..n-1; ids outside that range are ignored."""
    known = F.coalesce(labels, F.array().cast("array<int>"))
    return F.transform(
        F.sequence(F.lit(0), F.lit(n_labels - 1)),
        lambda i: F.array_contains(known, i).cast("int"),
    )


def label_ids(labels: Column, n_labels: int) -> Column:
    """Distinct label ids within 0..n-1, null lists read as empty."""
    known = F.coalesce(labels.cast("array<int>"), F.array().cast("array<int>"))
    return F.array_distinct(F.filter(known, lambda x: (x >= 0) & (x < n_labels)))


def positive_indicators(scores: Column) -> Column:
    """1 where the sigmoid of a logit exceeds one half."""
    return F.transform(scores, lambda x: (sigmoid(x) > 0.5).cast("int"))


def positive_ids(scores: Column) -> Column:
    """Ids of the labels whose logit is over the threshold."""
    marked = F.transform(scores, lambda x, i: F.when(sigmoid(x) > 0.5, i.cast("int")))
    return F.filter(marked, lambda i: i.isNotNull())


def add_zero_class(indicators: Column) -> Column:
    """Append a column that is 1 exactly when no other label is set."""
    empty = ~F.exists(indicators, lambda x: x == 1)
    return F.concat(indicators, F.array(empty.cast("int")))


def zero_class_ids(ids: Column, n_labels: int) -> Column:
    """Same on id lists: an empty list becomes the extra label ``n_labels``."""
    return F.when(F.size(ids) == 0, F.array(F.lit(n_labels))).otherwise(ids)


def argmax(scores: Column) -> Column:
    """0-based index of the first maximum."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def is_known_label(label: Column, n_classes: int) -> Column:
    return F.coalesce((label >= 0) & (label < n_classes), F.lit(False))


def require_label(label: Column, n_classes: int) -> Column:
    """The label itself; an unknown one fails the job."""
    message = F.concat(F.lit("unknown label: "), F.coalesce(label.cast("string"), F.lit("null")))
    return F.when(is_known_label(label, n_classes), label).otherwise(F.raise_error(message))
