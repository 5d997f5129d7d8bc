"""Read-or-build tables in the shared folder."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from datetime import datetime
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import shared_folder
from corpusloom.sources.files import remove_folder

MARK = "key string, event string, at timestamp"
BUILT, READ, DROPPED = "built", "read", "dropped"


def feature_key(source: DataFrame, **parameters: object) -> str:
    """Cache key of features of ``source``: a digest of its plan, its input files and the parameters.

    Other rows or parameters give another key. Files replaced under the same name do
    not: ``kept`` tells those too, at the price of asking for every file's state.
    """
    told = [source.semanticHash(), source.columns, sorted(source.inputFiles()), sorted(parameters.items())]
    return "features/" + hashlib.sha256(json.dumps(told, default=str).encode()).hexdigest()


def materialize(df: DataFrame, key: str, overwrite: bool = False) -> DataFrame:
    """The table stored under ``key``, built from ``df`` when absent or told to.

    A written table also cuts the lineage: a lost executor costs a re-read, not
    a re-computation. Spark commits the write atomically (``_SUCCESS``), and a
    half-written folder has no readable schema.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/corpusloom/{key}"
    if not overwrite:
        stored = _read(spark, path)
        if stored is not None:
            return stored
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fingerprint(source: DataFrame) -> str:
    """Digest of path, size and modification time of all files ``source`` reads; their contents are not read.

    Spark lists the files and sums their hashes, in any order; only the names that
    Spark itself keeps for the scan come through the driver.
    """
    # names come as URIs, and are read as patterns
    paths = [re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(path)) for path in source.inputFiles()]
    if not paths:
        return "no files"
    state = F.xxhash64("path", "length", "modificationTime")
    files = source.sparkSession.read.format("binaryFile").load(paths)
    return "{}-{}-{}".format(*files.agg(F.count("*"), F.sum(state.cast("decimal(38,0)")), F.bit_xor(state)).first())


def kept(source: DataFrame, **parameters: object) -> DataFrame:
    """The stored table of ``source``, built when its plan, parameters or any input file is new or changed.

    Every use is marked, so tables that nobody reads any more can be told and dropped.
    """
    spark = source.sparkSession
    key = feature_key(source, files=fingerprint(source), **parameters)
    stored = _read(spark, f"{shared_folder(spark)}/corpusloom/{key}")
    _mark(spark, [key], BUILT if stored is None else READ)
    return materialize(source, key) if stored is None else stored


def unused_since(spark: SparkSession, moment: datetime) -> DataFrame:
    """(key, at): stored tables last built or read before ``moment``, and when."""
    try:
        marks = spark.read.schema(MARK).parquet(_marks_path(spark))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        marks = spark.createDataFrame([], MARK)
    last = marks.groupBy("key").agg(F.max(F.struct("at", "event")).alias("last"))
    return last.where((F.col("last.event") != DROPPED) & (F.col("last.at") < F.lit(moment))).select("key", "last.at")


def drop_unused(spark: SparkSession, moment: datetime) -> int:
    """Remove the tables of ``unused_since`` and return how many they were."""
    keys = [row["key"] for row in unused_since(spark, moment).toLocalIterator()]
    for key in keys:
        remove_folder(f"{shared_folder(spark)}/corpusloom/{key}")
    if keys:
        _mark(spark, keys, DROPPED)
    return len(keys)


def _marks_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/corpusloom/marks"


def _mark(spark: SparkSession, keys: list[str], event: str) -> None:
    marks = spark.createDataFrame([(key, event, datetime.now()) for key in keys], MARK)
    marks.coalesce(1).write.mode("append").parquet(_marks_path(spark))


def new_folder(spark: SparkSession) -> str:
    """A folder of its own for one run's files."""
    return f"{shared_folder(spark)}/corpusloom/runs/{uuid.uuid4().hex}"


def spool(df: DataFrame) -> DataFrame:
    """Write an intermediate once under a fresh name and go on from the table."""
    return materialize(df, f"spool/{uuid.uuid4().hex}", overwrite=True)


def drop_spool(df: DataFrame) -> None:
    """Remove a spooled table that nobody reads any more."""
    for folder in {unquote(path).rsplit("/", 1)[0] for path in df.inputFiles()}:
        remove_folder(folder)


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        spark.read.format("binaryFile").load(f"{path}/_SUCCESS")
        return spark.read.parquet(path)
    except AnalysisException:
        return None
