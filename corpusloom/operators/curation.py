"""From raw dumps to labelled tables with splits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import text as T
from corpusloom.operators.lookups import lookup_join
from corpusloom.sources.cache import spool

#: Labels that are compared with every row as a constant.
MAX_ALLOWED = 10_000

# The eight clause annotations, in file-set order.
CLAUSE_LABELS = (
    "Arbitration",
    "Unilateral change",
    "Content removal",
    "Jurisdiction",
    "Choice of law",
    "Limitation of liability",
    "Unilateral termination",
    "Contract by using",
)


def label_counts(rows: DataFrame, labels: str) -> DataFrame:
    """How often each label occurs over all label lists."""
    return rows.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def top_labels(rows: DataFrame, labels: str, k: int = 100) -> DataFrame:
    """The ``k`` most frequent labels; ties go to the smaller label."""
    return label_counts(rows, labels).orderBy(F.desc("n"), "label").limit(k)


def keep_single_label(rows: DataFrame, labels: str, allowed: DataFrame) -> DataFrame:
    """Rows with exactly one allowed label, their list reduced to it.

    ``allowed`` is a top-k result (column ``label``): its k values are read once
    and reach the rows as a constant, so no join is needed. More than ``MAX_ALLOWED``
    are an error; ``rows_with_labels`` takes any number.
    """
    names = [row["label"] for row in allowed.select("label").limit(MAX_ALLOWED + 1).collect()]
    if len(names) > MAX_ALLOWED:
        raise ValueError(f"more than {MAX_ALLOWED} allowed labels")
    constant = F.array(*[F.lit(name) for name in names]).cast("array<string>")
    kept = F.sort_array(F.array_intersect(labels, constant))
    return rows.where(F.arrays_overlap(labels, constant)).withColumn(labels, kept).where(F.size(labels) == 1)


def rows_with_labels(rows: DataFrame, labels: str, id_column: str, allowed: DataFrame) -> DataFrame:
    """(id, label) pairs whose label is in the ``allowed`` table; it is broadcast only where it is small."""
    pairs = rows.select(id_column, F.explode(F.array_distinct(labels)).alias("label"))
    # stored, for its size is looked at before the join
    return lookup_join(pairs, spool(allowed.select("label").distinct()), "label", spread_by=[id_column])


def split_by_value(column: str, splits: dict[str, Sequence[str]]) -> Column:
    """Split name chosen by a column's value, e.g. years; null for other values."""
    chosen = F.lit(None).cast("string")
    for name, values in splits.items():
        chosen = F.when(F.col(column).isin(*values), F.lit(name)).otherwise(chosen)
    return chosen


def canonical_split(split: Column) -> Column:
    """``dev`` and ``val`` are names for ``validation``."""
    return F.when(split.isin("dev", "val"), F.lit("validation")).otherwise(split)


def chronological_splits(groups: DataFrame, order: Sequence[str], n_train: int, n_validation: int) -> DataFrame:
    """Whole groups in time order: first train, then validation, the rest test.

    Only the first ``n_train + n_validation`` groups need an order, which a top-n
    finds without sorting all of them; every other group is test.
    """
    head = groups.select(*order).orderBy(*order).limit(n_train + n_validation)
    place = F.row_number().over(Window.orderBy(*order))
    early = head.select(
        *order,
        F.when(place <= n_train, F.lit("train")).otherwise(F.lit("validation")).alias("split"),
    )
    # null-safe: a group without an order key sorts first and keeps that place
    early = early.select(*[F.col(c).alias(f"_{c}") for c in order], "split")
    same = reduce(and_, [groups[c].eqNullSafe(early[f"_{c}"]) for c in order])
    placed = groups.join(F.broadcast(early), same, "left")
    return placed.select(*groups.columns, F.coalesce("split", F.lit("test")).alias("split"))


def label_types(annotations: DataFrame, keys: Sequence[str], n_types: int) -> DataFrame:
    """(keys, _types): the positive label types of each position, in order.

    A line is positive when its value is ``1``. Only positive lines move, a few per
    position. A type that is not 0 to ``n_types - 1`` is an error.
    """
    known = F.col("label_type").between(0, n_types - 1)
    kind = F.when(known, F.col("label_type").cast("int")).otherwise(
        F.raise_error(F.concat(F.lit("unknown label type "), F.coalesce(F.col("label_type").cast("string"), F.lit("null"))))
    )
    return (
        annotations.where(F.col("value") == "1")
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_set(kind)).alias("_types"))
    )


def has_label(i: int) -> Column:
    return F.coalesce(F.array_contains("_types", i), F.lit(False))


def label_lists(
    sentences: DataFrame, annotations: DataFrame, keys: Sequence[str], names: Sequence[str] = CLAUSE_LABELS
) -> DataFrame:
    """Positional join: each sentence with the names of its positive annotations.

    ``annotations`` holds ``keys``, ``label_type`` (0-based) and ``value``.
    """
    by_type = F.array(*[F.lit(name) for name in names])
    chosen = F.transform(F.coalesce("_types", F.array().cast("array<int>")), lambda t: F.get(by_type, t))
    return (
        sentences.join(label_types(annotations, keys, len(names)), list(keys), "left")
        .withColumn("labels", chosen)
        .drop("_types")
    )


def unlabelled(rows: DataFrame, labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows without any matching label row."""
    return rows.join(labelled.select(*keys), list(keys), "left_anti")


def annotation_summary(
    sentences: DataFrame, annotations: DataFrame, keys: Sequence[str], names: Sequence[str] = CLAUSE_LABELS
) -> DataFrame:
    """Counts as (measure, n): sentences, positives per label, two notions of unannotated.

    ``sentences minus annotations`` counts a sentence with two labels twice;
    ``without annotation`` is the true number. All counts come from one join and
    one aggregation.
    """
    marked = sentences.select(*keys).join(label_types(annotations, keys, len(names)), list(keys), "left")
    n_labels = F.coalesce(F.size("_types"), F.lit(0))
    counts = marked.agg(
        F.count("*").alias("sentences"),
        *[F.count_if(has_label(i)).alias(name) for i, name in enumerate(names)],
        F.coalesce(F.sum(n_labels), F.lit(0)).alias("annotations"),
        (F.count("*") - F.coalesce(F.sum(n_labels), F.lit(0))).alias("sentences minus annotations"),
        F.count_if(F.col("_types").isNull()).alias("without annotation"),
    )
    return counts.unpivot([], [F.col(f"`{c}`") for c in counts.columns], "measure", "n")


def well_formed(line: Column) -> Column:
    """Starts with a digit and ends with text plus a digit (terminator stripped)."""
    return line.rlike(r"(?s)^\p{Nd}.*\p{Nd}\z") & (F.length(line) >= 2)


def not_overlong(line: Column, limit: int = 5000) -> Column:
    """Shorter than ``limit`` characters, counting the line terminator."""
    return F.length(line) + 1 < limit


def first_years(lines: DataFrame, group: str, order: Sequence[str], text: str) -> DataFrame:
    """First year each group mentions, reading its lines in order; ``-`` without one."""
    year = T.first_match(F.col(text), T.YEAR_PATTERN)
    position = F.when(year.isNotNull(), F.struct(*order))
    return lines.groupBy(group).agg(F.coalesce(F.min_by(year, position), F.lit("-")).alias("year"))


def dataset_card(tasks: DataFrame) -> DataFrame:
    """Per task: number of classes in use and rows per split.

    ``tasks`` holds ``task``, ``split`` and ``labels`` (a list; one entry for
    single-label tasks).
    """
    examples = tasks.select("task", "split", F.posexplode_outer("labels").alias("_i", "label"))
    once = F.coalesce(F.col("_i") == 0, F.lit(True))
    splits = ("train", "validation", "test")
    # one row per task and label, where the first label of a row counts the example
    per_label = examples.groupBy("task", "label").agg(
        *[F.count_if(once & (F.col("split") == split)).alias(split) for split in splits]
    )
    return per_label.groupBy("task").agg(
        *[F.sum(split).alias(split) for split in splits], F.count("label").alias("n_classes")
    )
