"""Readers for the file layouts the benchmark tables come in."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import file_stem
from corpusloom.operators.curation import canonical_split
from corpusloom.sinks import keyed_files
from corpusloom.sources import schemas

METRICS = ("eval_micro_f1", "eval_macro_f1", "predict_micro_f1", "predict_macro_f1")
SPLIT_ALIASES = {"train": ["train"], "validation": ["validation", "dev", "val"], "test": ["test"]}


def load_task(spark: SparkSession, folder: str, task: str, split: str | None = None) -> DataFrame:
    """Rows of one task, stored as parquet under ``folder/task/split=...``.

    The split filter names the partition values themselves, so only the folders
    of that split are listed and read.
    """
    schema, _, _ = schemas.TASKS[task]
    rows = spark.read.schema(schema).parquet(f"{folder}/{task}")
    return select_split(rows, split).withColumn("split", canonical_split(F.col("split")))


def select_split(rows: DataFrame, split: str | None) -> DataFrame:
    """One split under any of its names; None keeps all."""
    if split is None:
        return rows
    name = next((k for k, names in SPLIT_ALIASES.items() if split in names), split)
    return rows.where(F.col("split").isin(*SPLIT_ALIASES.get(name, [name])))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON object per line."""
    return spark.read.schema(schema).json(path)


def json_layouts(spark: SparkSession, path: str | list[str], max_layouts: int = 10_000) -> DataFrame:
    """(fields, n_files, n_rows): the sets of field names that the records have, names in order.

    Counted by Spark, per file and record; more than ``max_layouts`` sets are an error,
    for then the names are data and no layout. A line that is no JSON object has none.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.array_sort(F.array_distinct(F.json_object_keys("value"))).alias("fields")
    )
    per_file = lines.where("fields is not null").groupBy("fields", "file").agg(F.count("*").alias("n"))
    layouts = per_file.groupBy("fields").agg(F.count("*").alias("n_files"), F.sum("n").alias("n_rows"))
    found = layouts.limit(max_layouts + 1).collect()
    if len(found) > max_layouts:
        raise ValueError(f"more than {max_layouts} layouts in {path}")
    return spark.createDataFrame(found, "fields array<string>, n_files bigint, n_rows bigint")


def read_drifted_json(
    spark: SparkSession, path: str | list[str], types: T.StructType, drop: Sequence[str] = (), layouts: DataFrame | None = None
) -> DataFrame:
    """JSON lines of several layouts: the fields of all of them, null where a record lacks one.

    A field named in ``types`` has that type and comes first, in that order, whether it
    occurs or not; any other comes by name, as text. Those in ``drop`` go where they
    occur. ``layouts`` is a result of ``json_layouts``, made here when it is not given.
    """
    layouts = json_layouts(spark, path) if layouts is None else layouts
    # within the bound of json_layouts
    names = {name for row in layouts.select("fields").collect() for name in row["fields"]}
    fields = list(types.fields) + [T.StructField(name, T.StringType()) for name in sorted(names - set(types.names))]
    schema = T.StructType([field for field in fields if field.name not in set(drop)])
    return spark.read.schema(schema).json(path)


def read_lines(spark: SparkSession, path: str | list[str], skip_first: bool = False) -> DataFrame:
    """Whole lines, without their terminators; ``skip_first`` leaves out the first line of every file.

    A file's first line is the first that a task reads of the split that starts at byte
    0, however the files are cut and packed into tasks, so one scan does and empty lines
    stay. The rows go through Arrow for it, and only then.
    """
    lines = spark.read.text(path)
    if not skip_first:
        return lines
    places = lines.select("value", "_metadata.file_path", "_metadata.file_block_start")

    def drop_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            files, starts = batch.column(1).dictionary_encode(), batch.column(2).to_numpy()
            codes = files.indices.to_numpy()
            new = np.append(True, (codes[1:] != codes[:-1]) | (starts[1:] != starts[:-1]))
            new[0] = (batch.column(1)[0].as_py(), starts[0]) != before
            before = batch.column(1)[-1].as_py(), starts[-1]
            yield batch.select(["value"]).filter(pa.array(~(new & (starts == 0))))

    return places.mapInArrow(drop_first, "value string")


def read_choice_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Quoted CSV with id, context, five options and a label; doubled quotes escape."""
    return (
        spark.read.schema(schemas.CHOICE_RECORD)
        .option("header", header)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )


def read_keyed_lines(spark: SparkSession, glob: str) -> DataFrame:
    """Lines of small files as (key, line_no, text); the key is the file name's stem.

    One file is one document, so a file per row keeps line numbers exact. Where the files
    are those of ``keyed_files.write_keyed_files``, its manifest names them, and no list
    of files goes through the driver; files that others put beside them are not read.
    """
    content = F.regexp_replace("value", r"\r\n?", "\n")
    folder, _, pattern = glob.rpartition("/")
    published = keyed_files.read_published(spark, folder, pattern[1:]) if re.fullmatch(r"\*\.\w+", pattern) else None
    if published is None:
        published = spark.read.text(glob, wholetext=True).select("value", file_stem(F.col("_metadata.file_name")).alias("key"))
    files = published.select(
        "key",
        F.split(F.regexp_replace(content, r"\n\z", ""), "\n").alias("lines"),
        (F.length("value") > 0).alias("filled"),
    )
    return files.where("filled").select("key", F.posexplode("lines").alias("line_no", "text"))


def read_annotation_sets(spark: SparkSession, root: str, folders: list[str]) -> DataFrame:
    """Parallel 0/1 files of several folders as (key, line_no, label_type, value)."""
    content = F.regexp_replace("value", r"\r\n?", "\n")
    number = F.array_position(F.array(*[F.lit(f) for f in folders]), F.element_at(F.split("path", "/"), -2))
    files = (
        spark.read.text([f"{root}/{folder}/*.txt" for folder in folders], wholetext=True)
        .select("value", F.col("_metadata.file_path").alias("path"))
        .select(
            file_stem(F.col("path")).alias("key"),
            (number - 1).cast("int").alias("label_type"),
            F.split(F.regexp_replace(content, r"\n\z", ""), "\n").alias("lines"),
        )
    )
    return files.select("key", "label_type", F.posexplode("lines").alias("line_no", "value"))


def _run_files(spark: SparkSession, folder: str, file: str, schema: T.StructType) -> DataFrame:
    """Readable JSON files named ``logs/task/model/seed_n/file`` with their keys.

    A model id may contain slashes. A result may also be a folder of that name,
    as Spark writes it, and folders may be named ``key=value`` (see
    ``writers.write_run_files``). Malformed files are skipped; without the tree there
    are no rows.
    """
    scan = _scan_runs(spark).schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").format("json")
    runs = _with_run_keys(_load_or_none(spark, scan, f"{folder}/logs", schema), file)
    return runs.where("_corrupt_record is null").drop("_corrupt_record")


def _scan_runs(spark: SparkSession):
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "{*.json,part-*}")


def _load_or_none(spark: SparkSession, scan, path: str, schema: T.StructType) -> DataFrame:
    """(columns of ``schema``, path) of the files under ``path``; no rows where there is no such folder."""
    try:
        return scan.load(path).select(*[F.col(f"`{c}`") for c in schema.names], F.col("_metadata.file_path").alias("path"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("path", T.StringType())]))


def _with_run_keys(files: DataFrame, file: str) -> DataFrame:
    pattern = rf"/logs/(?:task=)?([^/]+)/(?:model=)?(.+)/seed[_=](\d+)/(?:file=)?{re.escape(file)}(?:/part-[^/]*)?$"
    path = F.col("path")
    return files.where(path.rlike(pattern)).select(
        F.regexp_extract(path, pattern, 1).alias("task"),
        F.regexp_extract(path, pattern, 2).alias("model"),
        F.regexp_extract(path, pattern, 3).cast("int").alias("seed"),
        *[F.col(f"`{c}`") for c in files.columns if c != "path"],
    )


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all readable runs under ``folder/logs``; a run counts when all four are present."""
    results = _run_files(spark, folder, "all_results.json", schemas.RUN_RESULTS)
    return complete_runs(results.withColumnsRenamed({m.replace("_f1", "-f1"): m for m in METRICS}))


def audit_runs(spark: SparkSession, folder: str, expected: DataFrame | None = None) -> DataFrame:
    """Every run file under ``folder/logs`` in one scan: its keys, scores, and ``reason`` where it does not count.

    ``cut off``: no whole JSON object; ``field missing``: a score is not there or null;
    ``wrong type``: a field holds something else than a number, or NaN; null: the run counts,
    just as in ``read_runs``. A run of ``expected`` (task, model, seed) without a file is
    ``absent``, and so is one whose file has no byte, for Spark's scans pass over those.
    Without the tree, all are.
    """
    text = T.StructType([T.StructField("value", T.StringType())])
    scan = _scan_runs(spark).option("wholetext", True).format("text")
    files = _with_run_keys(_load_or_none(spark, scan, f"{folder}/logs", text), "all_results.json")
    untyped = T.StructType([T.StructField(f.name, T.StringType()) for f in schemas.RUN_RESULTS])
    parsed = files.withColumns({
        "_texts": F.from_json("value", untyped),
        "_typed": F.from_json("value", schemas.RUN_RESULTS),
    }).drop("value")
    names = {m: m.replace("_f1", "-f1") for m in METRICS}
    cut = F.col("_texts").isNull() | F.col("_texts._corrupt_record").isNotNull() | _all_null("_texts", untyped.names)
    missing = F.lit(False)
    other = F.col("_typed._corrupt_record").isNotNull()
    for name in names.values():
        missing = missing | F.col(f"_texts.`{name}`").isNull()
        other = other | F.isnan(f"_typed.`{name}`")
    found = parsed.select(
        "task", "model", "seed",
        *[F.col(f"_typed.`{name}`").alias(m) for m, name in names.items()],
        F.when(cut, "cut off").when(missing, "field missing").when(other, "wrong type").alias("reason"),
    )
    if expected is None:
        return found
    keys = ["task", "model", "seed"]
    wanted = expected.select(*[F.col(k).cast(found.schema[k].dataType).alias(k) for k in keys])
    absent = wanted.join(found.select(*keys), keys, "left_anti").withColumn("reason", F.lit("absent"))
    return found.unionByName(absent, allowMissingColumns=True)


def _all_null(struct: str, names: Sequence[str]) -> Column:
    """A blank file parses to a struct without any field."""
    return F.coalesce(*[F.col(f"{struct}.`{name}`") for name in names]).isNull()


def read_train_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Total training time and epochs per run, from the last entry of its log."""
    return last_log_entry(_run_files(spark, folder, "trainer_state.json", schemas.TRAINER_STATE))


def complete_runs(runs: DataFrame) -> DataFrame:
    """Only runs with all four scores."""
    return runs.dropna("any", subset=list(METRICS))


def last_log_entry(logs: DataFrame) -> DataFrame:
    """Epoch and runtime of the last log entry; runs without both are skipped."""
    last = F.element_at("log_history", -1)
    return (
        logs.where(F.size("log_history") > 0)
        .select(
            "task", "model", "seed",
            last["epoch"].alias("epochs"),
            last["train_runtime"].alias("runtime"),
        )
        .dropna("any", subset=["epochs", "runtime"])
    )
