"""Writers; every one refuses to replace existing output unless told to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def write_split_json(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """JSON lines, one folder per split."""
    rows.write.mode(_mode(overwrite)).partitionBy("split").json(path)


def write_task(rows: DataFrame, folder: str, task: str, overwrite: bool = False) -> None:
    """Parquet, one folder per split, as ``load_task`` reads it."""
    rows.write.mode(_mode(overwrite)).partitionBy("split").parquet(f"{folder}/{task}")


def write_lines(rows: DataFrame, column: str, path: str, overwrite: bool = False) -> None:
    """One line per row, verbatim."""
    rows.select(F.col(column).alias("value")).write.mode(_mode(overwrite)).text(path)


def write_metrics(metrics: DataFrame, folder: str, task: str, model: str, seed: int, overwrite: bool = False) -> None:
    """One run's metrics where ``read_runs`` finds them.

    ``metrics`` has one row; column names follow the result files, e.g. ``eval_micro-f1``.
    """
    path = f"{folder}/logs/{task}/{model}/seed_{seed}/all_results.json"
    metrics.coalesce(1).write.mode(_mode(overwrite)).json(path)


def write_run_files(rows: DataFrame, column: str, folder: str, file: str, overwrite: bool = False) -> None:
    """A file per (task, model, seed), the JSON text of ``column``, in one job; read as a run tree.

    The keys hold one row each and name the folders, so they must be free of slashes.
    """
    keys = ("task", "model", "seed")
    rows.select(*keys, F.lit(file).alias("file"), F.col(column).alias("value")).write.mode(_mode(overwrite)).partitionBy(
        *keys, "file"
    ).text(f"{folder}/logs")


def encode_records(rows: DataFrame) -> DataFrame:
    """Each row as one JSON string."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))
