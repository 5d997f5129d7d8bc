"""Text files named by a key, written by the tasks and published by a manifest.

A task attempt writes under a temporary name of its own and returns what it wrote.
Spark keeps the answers of the attempts that count; only the files in them get their
final names, so a lost or repeated attempt leaves nothing that a reader sees.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.ship import ship
from corpusloom.sources.cache import spool
from corpusloom.sources.files import open_folder, refuse_filled, remove_folder

MANIFEST = "key string, temporary string, n_lines bigint, n_bytes bigint"
#: Folder of the published manifest; Spark's readers pass over names that start so.
MANIFEST_FOLDER = "_manifest"
#: Published files that one task reads, by number and bytes; bytes of a batch of them.
FILES_A_TASK, BYTES_A_TASK, READ_BYTES = 10_000, 64 << 20, 1 << 20
#: Names in a path, without a dot (readers cut names there) and not hidden.
KEY_PATTERN = r"\A[^/._\x00][^/.\x00]*(/[^/._\x00][^/.\x00]*)*\z"


def _checked(key: Column) -> Column:
    told = F.concat(F.lit("not a file name: "), F.coalesce(key, F.lit("null")))
    return F.when(key.rlike(KEY_PATTERN), key).otherwise(F.raise_error(told))


def _line(text: Column) -> Column:
    return F.when(text.rlike(r"[\r\n]"), F.raise_error(F.lit("a line holds a line end"))).otherwise(F.coalesce(text, F.lit("")))


def write_keyed_files(
    lines: DataFrame,
    folder: str,
    key: str = "key",
    order: str = "line_no",
    text: str = "text",
    suffix: str = ".txt",
    overwrite: bool = False,
) -> DataFrame:
    """One file ``folder/<key><suffix>`` per key, its lines in ``order``; the manifest (key, n_lines, n_bytes).

    A key may name subfolders (``set/name``). A null text is an empty line; a key that
    is no file name, and a text that holds a line end, are errors. Lines are sorted by
    Spark and streamed, so memory does not grow with a file, but a file is written by
    one task. A folder that is not empty is refused before any job runs;
    with ``overwrite`` its files are replaced, and those of keys that are gone are removed.
    """
    spark = lines.sparkSession
    folder = folder.rstrip("/")
    if not overwrite:
        refuse_filled(folder)
    ship(spark)
    temporary = f"{folder}/_temporary-{uuid.uuid4().hex}"
    rows = lines.select(
        _checked(F.col(key).cast("string")).alias("key"), F.col(order).alias("place"), _line(F.col(text)).alias("text")
    )
    placed = rows.repartition("key").sortWithinPartitions("key", "place").select("key", "text")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_folder(temporary)
        system.create_dir(root, recursive=True)
        for name, told in _files(batches):
            file = f"{root}/{uuid.uuid4().hex}"
            n_lines = 0
            with system.open_output_stream(file) as out:
                for texts in told:
                    out.write("".join(f"{line}\n" for line in texts).encode())
                    n_lines += len(texts)
                n_bytes = out.tell()
            yield _manifest_row(name, file.rpartition("/")[2], n_lines, n_bytes)

    manifest = spool(placed.mapInArrow(put, MANIFEST))
    before = _old_manifest(spark, folder) if overwrite else None

    def name_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_folder(folder)
        hidden = open_folder(temporary)[1]
        for batch in batches:
            for name, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                source, target = f"{hidden}/{file}", f"{root}/{name}{suffix}"
                # a repeated attempt finds what the first one has named
                if system.get_file_info(source).type != fs.FileType.NotFound:
                    system.create_dir(target.rpartition("/")[0], recursive=True)
                    system.move(source, target)
                elif system.get_file_info(target).type == fs.FileType.NotFound:
                    raise FileNotFoundError(source)
            yield batch.select(["key"])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_folder(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                if system.get_file_info(f"{root}/{name}{suffix}").type != fs.FileType.NotFound:
                    system.delete_file(f"{root}/{name}{suffix}")
            yield batch

    manifest.select("key", "temporary").mapInArrow(name_files, "key string").count()
    if before is not None:
        before.join(manifest, "key", "left_anti").select("key").mapInArrow(remove, "key string").count()
    result = manifest.drop("temporary")
    result.write.mode("overwrite").parquet(f"{folder}/{MANIFEST_FOLDER}")
    remove_folder(temporary)
    return result


def read_published(spark: SparkSession, folder: str, suffix: str = ".txt") -> DataFrame | None:
    """(key, value): whole contents of the files that the manifest of ``folder`` names, subfolders apart; read by the tasks.

    None where there is no manifest, or its files have another suffix.
    """
    if re.search(r"[\[\]{}*?\\]", folder) or not _has_manifest(folder):
        return None
    named = spark.read.parquet(f"{folder}/{MANIFEST_FOLDER}").where("not contains(key, '/')")
    first, system, root = named.first(), *open_folder(folder)
    if first is None or system.get_file_info(f"{root}/{first['key']}{suffix}").type == fs.FileType.NotFound:
        return None
    ship(spark)
    n_files, n_bytes = named.agg(F.count("*"), F.sum("n_bytes")).first()
    tasks = max(spark.sparkContext.defaultParallelism, n_files // FILES_A_TASK, n_bytes // BYTES_A_TASK)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_folder(folder)
        names = (name for batch in batches for name in batch.column(0).to_pylist())
        held, size = [], 0
        for name in names:
            with system.open_input_stream(f"{root}/{name}{suffix}") as file:
                held.append((name, file.read()))
            size += len(held[-1][1])
            if size >= READ_BYTES:
                yield _contents(held)
                held, size = [], 0
        if held:
            yield _contents(held)

    files = named.select("key").repartition(tasks, "key").mapInArrow(read, "key string, value binary")
    return files.select("key", F.col("value").cast("string").alias("value"))


def _contents(held: list[tuple[str, bytes]]) -> pa.RecordBatch:
    keys, values = zip(*held, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.binary())], names=["key", "value"])


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[list[str]]]]:
    """(key, its texts batch by batch) of rows that are sorted by key."""
    pieces = (
        (name, [text for _, text in rows])
        for batch in batches
        for name, rows in groupby(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), lambda row: row[0])
    )
    for name, told in groupby(pieces, lambda piece: piece[0]):
        yield name, (texts for _, texts in told)


def _manifest_row(*values: object) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
    names = ["key", "temporary", "n_lines", "n_bytes"]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)


def _old_manifest(spark, folder: str) -> DataFrame | None:
    if not _has_manifest(folder):
        return None
    # stored apart: the folder it is read from is replaced
    return spool(spark.read.parquet(f"{folder}/{MANIFEST_FOLDER}").select("key"))


def _has_manifest(folder: str) -> bool:
    system, root = open_folder(folder)
    return system.get_file_info(f"{root}/{MANIFEST_FOLDER}/_SUCCESS").type != fs.FileType.NotFound
