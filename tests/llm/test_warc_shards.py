"""Shards of the WARC writer are cut by bytes."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.llm import warc

SHARD = 100_000


def write(spark, rows, folder):
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    manifest = warc.write(pages, folder, shard_bytes=SHARD, file_bytes=1 << 30).collect()
    return {r["name"]: r["records"] for r in manifest}


def sizes(rows):
    return [len((h or "").encode()) + len((u or "").encode()) + warc.HEADER_BYTES for _, u, h in rows]


def test_large_payloads_at_one_end(spark, tmp_path):
    rows = [(i, f"u{i}", f"{i} " + "x" * 30_000) for i in range(40)] + [(i, f"u{i}", f"{i}") for i in range(40, 1000)]
    files = write(spark, rows, str(tmp_path / "a"))
    # the shard of a row is the bytes before it over the size of a shard
    expected, total = {}, 0
    for size in sizes(rows):
        name = f"shard-{total // SHARD:06d}-000000.warc.gz"
        expected[name] = expected.get(name, 0) + 1
        total += size
    assert files == expected and len(files) > 15
    assert warc.read(spark, str(tmp_path / "a")).count() == len(rows)


def test_one_key_is_cut_too(spark, tmp_path):
    rows = [(None if i % 2 else 7, f"u{i}", f"{i} " + "y" * 2_000) for i in range(400)] + [(-5, "z", "z"), (9, "z", "z")]
    files = write(spark, rows, str(tmp_path / "a"))
    shards = -(-sum(sizes(rows)) // SHARD)
    assert len(files) == shards and max(files.values()) <= 50
    found = warc.read(spark, str(tmp_path / "a")).groupBy("page_id").agg(F.count("*")).collect()
    assert {tuple(r) for r in found} == {(None, 200), (7, 200), (-5, 1), (9, 1)}


def test_rows_alike_fill_several_shards(spark, tmp_path):
    rows = [(3, "same", "s" * 3_000)] * 300 + [(i, f"u{i}", str(i)) for i in range(4, 300)] + [(1, "first", "first")]
    files = write(spark, rows, str(tmp_path / "a"))
    assert sum(files.values()) == len(rows) and len(files) == -(-sum(sizes(rows)) // SHARD)
    first = [n for name, n in sorted(files.items())][:10]
    assert max(first) <= 2 * min(first[1:])
    records = warc.read(spark, str(tmp_path / "a"), payloads=False).where("page_id = 3")
    assert records.count() == 300 and records.where("record_type = 'response'").count() == 300
