"""Scores over models, tasks and seeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.numbers import duration, fixed, percent

RUN = ("model", "task")
SCORES = ("eval_micro_f1", "eval_macro_f1", "predict_micro_f1", "predict_macro_f1")


def ranked_seeds(runs: DataFrame, metric: str = "eval_macro_f1") -> DataFrame:
    """Seeds of each (model, task) ranked by a dev score, ties in seed order."""
    order = Window.partitionBy(*RUN).orderBy(F.desc(metric), "seed")
    return runs.withColumn("rank", F.row_number().over(order))


def top_seeds(runs: DataFrame, k: int = 1, metric: str = "eval_macro_f1") -> DataFrame:
    return ranked_seeds(runs, metric).where(F.col("rank") <= k)


def seed_summary(runs: DataFrame, scores: Sequence[str] = SCORES) -> DataFrame:
    """Mean and population standard deviation of each score over seeds."""
    return runs.groupBy(*RUN).agg(
        F.count("*").alias("n_seeds"),
        *[F.avg(s).alias(f"{s}_mean") for s in scores],
        *[F.stddev_pop(s).alias(f"{s}_std") for s in scores],
    )


def dev_topk_test_best(runs: DataFrame, k: int = 3, metric: str = "eval_macro_f1") -> DataFrame:
    """Dev scores over the best ``k`` seeds, test scores of the best seed only."""
    chosen = top_seeds(runs, k, metric)
    best = F.col("rank") == 1
    return chosen.groupBy(*RUN).agg(
        *[F.avg(s).alias(f"{s}_mean") for s in SCORES[:2]],
        *[F.stddev_pop(s).alias(f"{s}_std") for s in SCORES[:2]],
        *[F.max(F.when(best, F.col(s))).alias(s) for s in SCORES[2:]],
    )


def harmonic_mean(x: Column) -> Column:
    """n / sum(1/x); 0 as soon as one value is 0, an error for negative values."""
    inverse = F.sum(F.when(x < 0, F.raise_error(F.lit("negative score"))).otherwise(F.try_divide(F.lit(1.0), x)))
    return F.when(F.count_if(x == 0) > 0, F.lit(0.0)).otherwise(F.try_divide(F.count(x), inverse))


def geometric_mean(x: Column) -> Column:
    """exp(mean(ln x)); 0 as soon as one value is 0, an error for negative values."""
    logs = F.avg(F.when(x < 0, F.raise_error(F.lit("negative score"))).otherwise(F.log(F.when(x > 0, x))))
    return F.when(F.count_if(x == 0) > 0, F.lit(0.0)).otherwise(F.exp(logs))


def one_of(items: Sequence) -> Column:
    return F.explode(F.array(*[F.lit(x) for x in items]))


def expected_pairs(spark: SparkSession, models: Sequence, tasks: Sequence) -> DataFrame:
    """Every (model, task) that should have scores."""
    return spark.range(1).select(one_of(models).alias("model")).select("model", one_of(tasks).alias("task"))


def expected_runs(spark: SparkSession, models: Sequence, tasks: Sequence, seeds: Sequence[int]) -> DataFrame:
    """Every (model, task, seed) that should exist."""
    return expected_pairs(spark, models, tasks).select("model", "task", one_of(seeds).alias("seed"))


def missing_runs(expected: DataFrame, runs: DataFrame) -> DataFrame:
    """Expected runs that have no complete result."""
    return expected.join(runs.select(*RUN, "seed"), [*RUN, "seed"], "left_anti")


def task_scores(expected: DataFrame, runs: DataFrame, k: int = 1, metric: str = "eval_macro_f1") -> DataFrame:
    """Mean score over the best ``k`` seeds for every (model, task) of ``expected``; null without runs."""
    means = top_seeds(runs, k, metric).groupBy(*RUN).agg(*[F.avg(s).alias(s) for s in SCORES])
    return expected.join(means, list(RUN), "left")


def mean_scores(scores: DataFrame) -> DataFrame:
    """Arithmetic, harmonic and geometric mean over tasks per model, split and average.

    A model that lacks a task has no mean, rather than a mean over fewer tasks.
    """
    long = scores.unpivot(["model", "task"], list(SCORES), "measure", "score")
    complete = F.count("score") == F.count("*")
    x = F.col("score")
    return long.groupBy("model", "measure").agg(
        F.when(complete, F.avg(x)).alias("arithmetic"),
        F.when(complete, harmonic_mean(x)).alias("harmonic"),
        F.when(complete, geometric_mean(x)).alias("geometric"),
    )


def with_display_name(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Adds ``name`` by model id; two models may share a name, so never group by it."""
    return rows.join(names, "model", "left").withColumn("name", F.coalesce("name", F.col("model").cast("string")))


def micro_macro_cell(micro: Column, macro: Column) -> Column:
    return F.concat(percent(micro), F.lit(" / "), percent(macro))


def score_table(scores: DataFrame, tasks: Sequence) -> DataFrame:
    """One row per model, one ``micro / macro`` cell per task (test scores)."""
    cell = micro_macro_cell(F.col("predict_micro_f1"), F.col("predict_macro_f1"))
    return scores.groupBy("model").pivot("task", list(tasks)).agg(F.first(cell))


def table_lines(table: DataFrame, name: str, cells: Sequence[str]) -> DataFrame:
    """Rows of an HTML table."""
    missing = F.lit("nan / nan")
    columns = [F.concat(F.lit("<td>"), F.coalesce(F.col(f"`{c}`"), missing), F.lit("</td>")) for c in cells]
    start = F.concat(F.lit("<tr><td>"), F.col(name).cast("string"), F.lit("</td>"))
    return table.withColumn("line", F.concat(start, *columns, F.lit("</tr>")))


def task_headings(tasks: DataFrame) -> DataFrame:
    return tasks.withColumn("heading", F.upper("task"))


def run_lines(runs: DataFrame) -> DataFrame:
    """One text line per run: dev and test scores in percent."""
    line = F.concat(
        F.lit("MICRO-F1: "), percent(F.col("eval_micro_f1")),
        F.lit("\tMACRO-F1: "), percent(F.col("eval_macro_f1")),
        F.lit("\t | MICRO-F1: "), percent(F.col("predict_micro_f1")),
        F.lit("\tMACRO-F1: "), percent(F.col("predict_macro_f1")),
    )
    return runs.withColumn("line", line)


def summary_lines(summary: DataFrame) -> DataFrame:
    """One text line per (model, task): dev mean and deviation, then the best test score."""
    line = F.concat(
        F.lit("MICRO-F1: "), percent(F.col("eval_micro_f1_mean")),
        F.lit("\t ± "), percent(F.col("eval_micro_f1_std")),
        F.lit("\tMACRO-F1: "), percent(F.col("eval_macro_f1_mean")),
        F.lit("\t ± "), percent(F.col("eval_macro_f1_std")),
        F.lit("\t | MICRO-F1: "), percent(F.col("predict_micro_f1")),
        F.lit("\tMACRO-F1: "), percent(F.col("predict_macro_f1")),
    )
    return summary.withColumn("line", line)


def train_time(logs: DataFrame) -> DataFrame:
    """Mean runtime, mean of the runs' time per epoch, and epochs, per (task, model)."""
    per_epoch = F.try_divide(F.col("runtime"), F.col("epochs"))
    return logs.groupBy("task", "model").agg(
        F.avg("runtime").alias("runtime"),
        F.avg(per_epoch).alias("time_per_epoch"),
        F.avg("epochs").alias("epochs_mean"),
        F.stddev_pop("epochs").alias("epochs_std"),
    )


def train_time_lines(times: DataFrame) -> DataFrame:
    line = F.concat(
        F.lit("TRAIN TIME: "), duration(F.col("runtime")),
        F.lit("\t TIME/EPOCH: "), duration(F.col("time_per_epoch")),
        F.lit("\t EPOCHS: "), fixed(F.col("epochs_mean"), 1),
        F.lit(" ± "), fixed(F.col("epochs_std"), 1),
    )
    return times.withColumn("line", line)
