"""Deterministic sharded WARC writer and its reader.

Records are range-sorted by key and cut into shards by a running total of their bytes,
so the files depend on the rows alone and not on the cluster's layout. A task writes
one shard, one gzip member per record, and rolls to a new file when one reaches a
compressed size. Headers, digests and record ids are made anew. Of equal payloads the
record with the smallest key is a response, the others revisit it.

A task attempt writes under a temporary name of its own and returns its manifest rows;
Spark commits the manifest of the attempts that count, the files in it get their final
names, and a closing file marks the archive complete. An attempt that was lost leaves
only a temporary file that no manifest names. Files go to any file system that
``pyarrow.fs`` opens from a URI, shared by all executors.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.ship import ship
from corpusloom.llm.texts import column
from corpusloom.operators.lookups import lookup_join
from corpusloom.sources.cache import spool

#: Uncompressed bytes of a shard, and compressed bytes from which a file is rolled.
SHARD_BYTES = 64 * 1024 * 1024
FILE_BYTES = 32 * 1024 * 1024
#: Bytes of a record's headers, next to its payload and url.
HEADER_BYTES = 600
#: Rows of a range over which the running total of bytes is taken in one go.
RANGE_ROWS = 500_000
LEVEL = 6
#: The date of every record: made anew, so it is the caller's, not the clock's.
DATE = "2024-01-01T00:00:00Z"
READ = 1 << 20

MANIFEST = "name string, temporary string, records bigint, bytes bigint, digest string"
RECORD = (
    "page_id bigint, record_type string, record_id string, target string, payload_bytes bigint, "
    "payload_digest string, refers_to_id string, refers_to bigint, payload binary"
)


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(uri)
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: int | None, digest: str) -> str:
    """The same for the same key and payload, told apart from all others."""
    return f"<urn:page:{'' if key is None else key}:{digest}>"


def key_of(identifier: str) -> int | None:
    key = identifier.strip("<>").split(":")[2]
    return int(key) if key else None


def _block(payload: bytes | None, size: int) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    return head.encode() + (payload or b"")


def make_record(
    key: int | None, target: str | None, payload: bytes, digest: str, first: int | None, is_first: bool, date: str
) -> bytes:
    """One record, headers and all, as a gzip member."""
    block = _block(payload if is_first else None, len(payload))
    fields = [
        ("WARC-Type", "response" if is_first else "revisit"),
        ("WARC-Record-ID", record_id(key, digest)),
        ("WARC-Date", date),
        # escaped, so that no url can end a header
        ("WARC-Target-URI", quote(target or "", safe="!#$%&'()*+,/:;=?@[]~-._")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if not is_first:
        fields[1:1] = [
            ("WARC-Refers-To", record_id(first, digest)),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    # a gzip member without name and time: the same bytes for the same record
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


class _Files:
    """Files of one task attempt, rolled by compressed size."""

    def __init__(self, folder: str, limit: int) -> None:
        self.system, self.folder = open_folder(folder)
        self.limit, self.attempt, self.out = limit, uuid.uuid4().hex, None
        self.done: list[tuple] = []
        self.shard = self.part = None

    def add(self, shard: int, record: bytes) -> None:
        if self.out is not None and (shard != self.shard or self.size >= self.limit):
            self.close()
        if shard != self.shard:
            self.shard, self.part = shard, 0
        if self.out is None:
            self.name = f"shard-{shard:06d}-{self.part:06d}.warc.gz"
            self.temporary = f"_temporary/{self.attempt}/{self.name}"
            self.system.create_dir(f"{self.folder}/_temporary/{self.attempt}", recursive=True)
            self.out = self.system.open_output_stream(f"{self.folder}/{self.temporary}", compression=None)
            self.size = self.records = 0
            self.digest = hashlib.sha1()
        self.out.write(record)
        self.digest.update(record)
        self.size += len(record)
        self.records += 1

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        self.done.append((self.name, self.temporary, self.records, self.size, self.digest.hexdigest()))
        self.out = None
        self.part += 1


def _cuts(sized: DataFrame, shard_bytes: int) -> DataFrame:
    """(key, tie, low, high): where shards begin, and the shards of rows too many for one.

    ``sized`` has (key, tie, size); rows are in the order of (key, tie), null keys first. A
    shard is the running total of bytes before a row over ``shard_bytes``. Rows that
    agree in key and tie, and together hold more than a shard, are dealt over the shards
    ``low`` to ``high``. The total is taken per range of the order, and ranges are added up.
    """
    groups = sized.groupBy("key", "tie").agg(F.sum("size").alias("size"), F.count("*").alias("copies"))
    ranges = max(1, -(-sized.count() // RANGE_ROWS))
    groups = spool(
        groups.repartitionByRange(ranges, F.asc_nulls_first("key"), "tie").withColumn("range", F.spark_partition_id())
    )
    # one row per range
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.groupBy("range").agg(F.sum("size").alias("bytes"))
    starts = starts.select("range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("range").orderBy(F.asc_nulls_first("key"), "tie").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("start") + F.sum("size").over(inside)
    placed = groups.join(F.broadcast(starts), "range").withColumn("end", end)
    shard = lambda at: F.floor(at / F.lit(shard_bytes))
    low = F.greatest(shard(F.col("end") - F.col("size")), F.lit(0))
    high = F.when((F.col("copies") > 1) & (F.col("size") > shard_bytes), shard(F.col("end") - 1)).otherwise(low)
    placed = placed.select("key", "tie", low.alias("low"), high.alias("high"))
    # structs order null keys first, as the sort does
    first = placed.groupBy("low").agg(F.min(F.struct("key", "tie", "low", "high")).alias("cut")).select("cut.*")
    return first.unionByName(placed.where("high > low")).distinct()


class _Shards:
    """Finds the shard of a row from the cuts: about one row of four numbers per shard."""

    def __init__(self, cuts: list[tuple]) -> None:
        cuts = sorted(cuts, key=lambda c: (c[0] is not None, c[0] or 0, c[1]))
        self.nulls = sum(c[0] is None for c in cuts)
        self.keys = np.array([c[0] or 0 for c in cuts], np.int64)
        self.ties, self.low, self.high = (np.array([c[i] for c in cuts], np.int64) for i in (1, 2, 3))

    def of(self, key: int | None, tie: int, row: int) -> int:
        if key is None:
            first, last = 0, self.nulls
        else:
            known = self.keys[self.nulls :]
            first = self.nulls + int(np.searchsorted(known, key, "left"))
            last = self.nulls + int(np.searchsorted(known, key, "right"))
        at = first + int(np.searchsorted(self.ties[first:last], tie, "right")) - 1
        if at < 0:
            return 0
        low, high = int(self.low[at]), int(self.high[at])
        if low == high:
            return low
        same = at >= first and self.ties[at] == tie
        # rows behind a group of several shards go on with its last
        return low + row % (high - low + 1) if same else high


def write(
    pages: DataFrame,
    folder: str,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    date: str = DATE,
    shard_bytes: int = SHARD_BYTES,
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write the archive into ``folder`` and return its manifest (name, records, bytes, digest).

    A null or empty payload is one of no bytes, a null url an empty target. Rows with a
    null key come first; of equal payloads with null keys alone all are responses, as
    are repeated rows of the smallest key. An empty table makes an empty manifest.
    Keys are whole numbers; other columns are not read. Rows of one key are in the order of
    a hash of payload and url. Only where rows that agree in all three fill more than a shard
    does their place in the table decide which of its shards one is in. The cuts, a row per shard, are
    sent to the tasks: 32 bytes for every ``shard_bytes`` of records.
    """
    spark = pages.sparkSession
    ship(spark)
    payload = F.coalesce(column(html), F.lit("")).cast("binary")
    source = pages.select(column(key).cast("bigint").alias("key"), column(url).alias("url"), payload.alias("payload"))
    sha = F.sha1("payload")
    source = source.withColumn("sha", sha).withColumn("tie", F.xxhash64("sha", "url"))
    size = F.octet_length("payload") + F.coalesce(F.octet_length("url"), F.lit(0)) + HEADER_BYTES
    slim = spool(source.select("key", "sha", "tie", size.cast("bigint").alias("size")))
    firsts = slim.groupBy("sha").agg(F.min("key").alias("first"), F.count("*").alias("copies"))
    # only payloads that occur again need a look-up
    again = spool(firsts.where("copies > 1").select("sha", "first"))
    cuts = [tuple(r) for r in _cuts(slim, shard_bytes).collect()]
    n = max((c[3] for c in cuts), default=0) + 1
    shards = _Shards(cuts)
    # numbered at the scan, so a task that is run again deals its rows alike
    rows = lookup_join(source.withColumn("number", F.monotonically_increasing_id()), again, "sha", "left", ["key"])

    @F.pandas_udf("int")
    def shard_of(keys: pd.Series, ties: pd.Series, numbers: pd.Series) -> pd.Series:
        keys = [None if k is None else int(k) for k in keys]
        found = [shards.of(*row) for row in zip(keys, ties.to_numpy(), numbers.to_numpy(), strict=True)]
        return pd.Series(found, dtype="int32")

    # a string, for a null among whole numbers would make them inexact
    dealt = rows.withColumn("shard", shard_of(F.col("key").cast("string"), "tie", "number"))
    dealt = dealt.repartitionById(n, "shard").sortWithinPartitions(F.asc_nulls_first("key"), "tie", "sha", "url")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(folder, file_bytes)
        for batch in batches:
            for row in batch.to_pylist():
                body = row["payload"]
                own = base32_sha1(body)
                first = row["first"] if row["first"] is not None else row["key"]
                files.add(
                    row["shard"], make_record(row["key"], row["url"], body, own, first, row["key"] == first, date)
                )
        files.close()
        columns = list(zip(*files.done, strict=True)) or [[]] * 5
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=[part.split()[0] for part in MANIFEST.split(", ")],
        )

    written = spool(dealt.select("key", "url", "payload", "first", "shard").mapInArrow(put, MANIFEST))
    _commit(written, folder)
    return written.select("name", "records", "bytes", "digest")


def _commit(manifest: DataFrame, folder: str) -> None:
    """Give the files of the manifest their names, write it beside them, and mark the archive complete."""

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_folder(folder)
        for batch in batches:
            for row in batch.to_pylist():
                source, target = f"{root}/{row['temporary']}", f"{root}/{row['name']}"
                # a task that is run again finds its work done
                if system.get_file_info(source).type != fs.FileType.NotFound:
                    system.move(source, target)
                elif system.get_file_info(target).type == fs.FileType.NotFound:
                    raise FileNotFoundError(target)
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["name"])

    moved = manifest.mapInArrow(rename, "name string").count()
    if moved != manifest.count():
        raise RuntimeError("the manifest and the files differ")
    manifest.drop("temporary").write.mode("overwrite").parquet(f"{folder}/_manifest")


def _members(stream) -> Iterator[bytes]:
    """The records of a file one by one, whatever its size."""
    data, unpacker, parts = b"", zlib.decompressobj(31), []
    while True:
        if not data:
            data = stream.read(READ)
            if not data:
                return
        parts.append(unpacker.decompress(data))
        data = unpacker.unused_data
        if unpacker.eof:
            yield b"".join(parts)
            unpacker, parts = zlib.decompressobj(31), []


def parse_record(raw: bytes) -> dict:
    """The values of ``RECORD`` from a record's bytes; digests are made anew and must agree."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a record: {lines[0]!r}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError(f"damaged block of {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    is_response = fields["WARC-Type"] == "response"
    if is_response and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")
    refers = fields.get("WARC-Refers-To")
    return {
        "page_id": key_of(fields["WARC-Record-ID"]),
        "record_type": fields["WARC-Type"],
        "record_id": fields["WARC-Record-ID"],
        "target": fields["WARC-Target-URI"],
        "payload_bytes": size,
        "payload_digest": digest,
        "refers_to_id": refers,
        "refers_to": key_of(refers) if refers else None,
        "payload": payload if is_response else None,
    }


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of an archive's manifest; every block and payload is checked against its digest.

    A task streams whole files. A revisit has the size and digest of the payload it
    revisits, but no payload; ``payloads=False`` leaves them all out.
    """
    ship(spark)
    manifest = spark.read.parquet(f"{folder}/_manifest").select("name")
    files = manifest.repartition(max(1, manifest.count()), "name")
    names = [part.split()[0] for part in RECORD.split(", ")]
    kinds = [{"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[p.split()[1]] for p in RECORD.split(", ")]

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_folder(folder)

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names
            )

        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with system.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for raw in _members(stream):
                        row = parse_record(raw)
                        if not payloads:
                            row["payload"] = None
                        rows.append(row)
                        size += len(row["payload"] or b"") + 200
                        if size > 8 * READ:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return files.mapInArrow(get, RECORD)
