"""Scores of predictions against gold labels.

Every function returns a DataFrame; ``by`` optionally adds group columns, so many
runs can be scored in one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import labels as L


def align(gold: DataFrame, predictions: DataFrame, key: str, require_all: bool = False) -> DataFrame:
    """Gold rows next to their predictions, matched by example id.

    With ``require_all`` a gold row without a prediction is an error instead of being
    left out, so no score is taken over a part of the examples.
    """
    if not require_all:
        return gold.join(predictions, key)
    there = predictions.withColumn("_there", F.lit(True))
    missing = F.raise_error(F.concat(F.lit("no prediction for "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return gold.join(there, key, "left").where(F.coalesce("_there", missing.cast("boolean"))).drop("_there")


def alignment_report(gold: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """How many examples are on both sides, only gold, only predicted."""
    both = gold.select(key, F.lit(1).alias("_g")).join(
        predictions.select(key, F.lit(1).alias("_p")), key, "full_outer"
    )
    g, p = F.col("_g").isNotNull(), F.col("_p").isNotNull()
    return both.agg(
        F.count_if(g & p).alias("matched"),
        F.count_if(g & ~p).alias("gold_only"),
        F.count_if(~g & p).alias("predicted_only"),
    )


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """2TP / (2TP + FP + FN), 0 where nothing was expected or predicted."""
    return F.coalesce(F.try_divide(2.0 * tp, (2 * tp + fp + fn).cast("double")), F.lit(0.0))


def sparse_confusion(rows: DataFrame, gold: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """TP, FP, FN per label that occurs in gold or predictions.

    Works on lists of label ids: only labels actually set are exploded (a few per
    row, not one row per possible label), and the map-side combine leaves one row
    per label and task before the shuffle.
    """
    marked = rows.select(
        *by,
        F.explode(F.array_union(gold, pred)).alias("label"),
        F.col(gold).alias("_gold"),
        F.col(pred).alias("_pred"),
    ).select(
        *by,
        "label",
        F.array_contains("_gold", F.col("label")).alias("g"),
        F.array_contains("_pred", F.col("label")).alias("p"),
    )
    return marked.groupBy(*by, "label").agg(
        F.count_if(F.col("g") & F.col("p")).alias("tp"),
        F.count_if(~F.col("g") & F.col("p")).alias("fp"),
        F.count_if(F.col("g") & ~F.col("p")).alias("fn"),
    )


def label_confusion(rows: DataFrame, gold: str, pred: str, n_labels: int) -> DataFrame:
    """TP, FP, FN and F1 of every label 0..n-1, also those that never occur."""
    spark = rows.sparkSession
    universe = spark.range(n_labels).select(F.col("id").cast("int").alias("label"))
    counts = sparse_confusion(rows, gold, pred)
    zero = F.lit(0).cast("bigint")
    full = universe.join(counts, "label", "left").select(
        "label", *[F.coalesce(c, zero).alias(c) for c in ("tp", "fp", "fn")]
    )
    return full.withColumn("f1", f1(F.col("tp"), F.col("fp"), F.col("fn")))


def multilabel_f1(
    rows: DataFrame,
    gold: str,
    scores: str,
    n_labels: int,
    zero_class: bool = True,
    by: Sequence[str] = (),
) -> DataFrame:
    """Micro- and macro-F1 of logits against gold label lists.

    With ``zero_class`` examples without any label count as an extra label, on
    both sides independently. Macro-F1 averages over all labels: those that never
    occur score 0, so dividing the sum of F1 by the number of labels is enough.
    """
    gold_ids, pred_ids = L.label_ids(F.col(gold), n_labels), L.positive_ids(F.col(scores))
    if zero_class:
        gold_ids, pred_ids = L.zero_class_ids(gold_ids, n_labels), L.zero_class_ids(pred_ids, n_labels)
    ids = rows.select(*by, gold_ids.alias("_g"), pred_ids.alias("_p"))
    return summarise_labels(sparse_confusion(ids, "_g", "_p", by), n_labels + int(zero_class), by)


def summarise_labels(confusion: DataFrame, n_labels: int, by: Sequence[str] = ()) -> DataFrame:
    """Micro- and macro-F1 from per-label counts."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return confusion.groupBy(*by).agg(
        F.coalesce(f1(F.sum(tp), F.sum(fp), F.sum(fn)), F.lit(0.0)).alias("micro_f1"),
        F.coalesce(F.sum(f1(tp, fp, fn)) / F.lit(float(n_labels)), F.lit(0.0)).alias("macro_f1"),
    )


def class_counts(rows: DataFrame, gold: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """TP, FP, FN per class found in gold or predictions, through the class x class table."""
    cells = rows.groupBy(*by, F.col(gold).alias("g"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    g, p = F.col("g"), F.col("p")
    sides = F.when(g == p, F.array(F.struct(g.alias("label"), F.lit("tp").alias("kind")))).otherwise(
        F.array(
            F.struct(g.alias("label"), F.lit("fn").alias("kind")),
            F.struct(p.alias("label"), F.lit("fp").alias("kind")),
        )
    )
    zero = F.lit(0).cast("bigint")
    return (
        cells.select(*by, "n", F.inline(sides))
        .groupBy(*by, "label")
        .agg(
            *[
                F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), zero).alias(kind)
                for kind in ("tp", "fp", "fn")
            ]
        )
    )


def multiclass_f1(rows: DataFrame, gold: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Micro-F1 (= accuracy) and macro-F1 over the classes in gold or predictions."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (
        class_counts(rows, gold, pred, by)
        .groupBy(*by)
        .agg(
            f1(F.sum(tp), F.sum(fp), F.sum(fn)).alias("micro_f1"),
            F.avg(f1(tp, fp, fn)).alias("macro_f1"),
        )
    )


def accuracy(rows: DataFrame, gold: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows whose prediction equals gold; on 0/1 vectors, exact-match accuracy."""
    hit = (F.col(gold) == F.col(pred)).cast("double")
    return rows.groupBy(*by).agg(F.avg(hit).alias("accuracy"))


MetricFn = Callable[..., DataFrame]
METRICS: dict[str, MetricFn] = {
    "multilabel_f1": multilabel_f1,
    "multiclass_f1": multiclass_f1,
    "accuracy": accuracy,
}


def register_metric(name: str, metric: MetricFn) -> None:
    """Add a metric: any function of a DataFrame that returns a one-row DataFrame."""
    METRICS[name] = metric


def evaluate(rows: DataFrame, name: str, **options) -> DataFrame:
    """Run a registered metric and return it as (metric, value) rows."""
    result = METRICS[name](rows, **options)
    by = list(options.get("by", ()))
    values = [c for c in result.columns if c not in by]
    return result.unpivot(by, values, "metric", "value")


def prediction_lines(rows: DataFrame, key: str, scores: str) -> DataFrame:
    """One line per example: id, then each score with five decimals, tab separated."""
    from corpusloom.functions.numbers import fixed

    cells = F.transform(scores, lambda x: fixed(x, 5))
    line = F.concat_ws("\t", F.col(key).cast("string"), F.array_join(cells, "\t"))
    return rows.select(key, line.alias("line"))
