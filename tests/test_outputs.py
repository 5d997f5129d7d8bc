"""Named files, guarded and staged output, changed and drifting input."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.sinks import keyed_files, staging
from corpusloom.sources import cache, readers as R

LINES = "key string, line_no int, text string"


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode())


def tree(folder):
    return {
        os.path.relpath(os.path.join(at, name), folder): open(os.path.join(at, name), encoding="utf-8", newline="").read()
        for at, _, names in os.walk(folder)
        for name in names
        if not name.startswith(".") and "_manifest" not in at
    }


def keyed(spark, rows):
    return spark.createDataFrame(rows, LINES)


def test_keyed_files_hold_their_lines_in_order(spark, tmp_path):
    rows = [("a", 2, "third"), ("a", 0, "é"), ("a", 1, None), ("set/b", 5, ""), ("set/b", 6, " x "), ("a", 3, "")]
    manifest = keyed_files.write_keyed_files(keyed(spark, rows), str(tmp_path / "out"))
    assert tree(tmp_path / "out") == {"a.txt": "é\n\nthird\n\n", "set/b.txt": "\n x \n"}
    assert sorted(map(tuple, manifest.collect())) == [("a", 4, 11), ("set/b", 2, 5)]
    back = R.read_keyed_lines(spark, str(tmp_path / "out/*.txt")).orderBy("line_no").collect()
    assert [tuple(r) for r in back] == [("a", 0, "é"), ("a", 1, ""), ("a", 2, "third"), ("a", 3, "")]


def test_keyed_files_over_many_batches(spark, tmp_path):
    lines = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"),
                                       F.col("id").alias("line_no"), F.col("id").cast("string").alias("text"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 700)
    try:
        manifest = keyed_files.write_keyed_files(lines, str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert tree(tmp_path / "out")["hot.txt"] == "".join(f"{i}\n" for i in range(0, 60_000, 3))
    assert manifest.agg(F.sum("n_lines")).first()[0] == 60_000


def test_keyed_files_refuse_and_replace(spark, tmp_path):
    out = str(tmp_path / "out")
    keyed_files.write_keyed_files(keyed(spark, [("a", 0, "1"), ("b", 0, "1")]), out)
    with pytest.raises(FileExistsError):
        keyed_files.write_keyed_files(keyed(spark, [("a", 0, "2")]), out)
    assert tree(out) == {"a.txt": "1\n", "b.txt": "1\n"}
    keyed_files.write_keyed_files(keyed(spark, [("a", 0, "2"), ("c", 0, "2")]), out, overwrite=True)
    assert tree(out) == {"a.txt": "2\n", "c.txt": "2\n"}
    keyed_files.write_keyed_files(keyed(spark, []), out, overwrite=True)
    assert tree(out) == {}


@pytest.mark.parametrize("key", [None, "", "../a", "a/../b", "/a", "a.b", "_hidden", "a//b", "a/"])
def test_keys_that_are_no_file_names(spark, tmp_path, key):
    with pytest.raises(Exception, match="not a file name"):
        keyed_files.write_keyed_files(keyed(spark, [(key, 0, "x")]), str(tmp_path / "out"))


def test_a_line_holds_no_line_end(spark, tmp_path):
    with pytest.raises(Exception, match="line end"):
        keyed_files.write_keyed_files(keyed(spark, [("a", 0, "x\ny")]), str(tmp_path / "out"))


def test_publish_is_all_or_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    jobs = []

    def write_counted(rows, path):
        jobs.append(path)
        rows.write.parquet(path)

    staging.publish(spark.range(3), out, write_counted)
    with pytest.raises(FileExistsError):
        staging.publish(spark.range(9), out, write_counted)
    assert len(jobs) == 1 and spark.read.parquet(out).count() == 3
    failing = spark.range(5).select(F.raise_error(F.lit("broken")).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken"):
        staging.publish(failing, out, overwrite=True)
    assert spark.read.parquet(out).count() == 3
    staging.publish(spark.range(9), out, overwrite=True)
    assert spark.read.parquet(out).count() == 9
    staging.publish(spark.range(2), str(tmp_path / "new"), overwrite=True)
    (tmp_path / "empty").mkdir()
    staging.publish(spark.range(2), str(tmp_path / "empty"))
    assert sorted(os.listdir(tmp_path)) == ["empty", "new", "out"]
    assert spark.read.parquet(str(tmp_path / "empty")).count() == 2


def test_a_target_filled_meanwhile_is_kept(spark, tmp_path):
    def slow(rows, path):
        rows.write.parquet(path)
        write(tmp_path / "out/theirs", "x")

    with pytest.raises(FileExistsError):
        staging.publish(spark.range(3), str(tmp_path / "out"), slow)
    assert os.listdir(tmp_path) == ["out"] and os.listdir(tmp_path / "out") == ["theirs"]


def test_replaced_files_are_read_anew(spark, tmp_path):
    file = tmp_path / "a [1] {b}.txt"
    write(file, "one\n")

    def read():
        return spark.read.text(str(tmp_path))

    assert [r[0] for r in cache.kept(read()).collect()] == ["one"]
    first = cache.fingerprint(read())
    assert cache.fingerprint(read()) == first
    write(file, "two\n")
    os.utime(file, (1, 1))
    assert cache.fingerprint(read()) != first
    assert [r[0] for r in cache.kept(read()).collect()] == ["two"]
    assert cache.kept(read(), other=1).count() == 1
    assert cache.fingerprint(spark.range(3)) == "no files"


def test_stored_tables_are_dropped_by_age(spark, tmp_path):
    write(tmp_path / "a.txt", "one\n")
    source = spark.read.text(str(tmp_path))
    cache.kept(source)
    key = cache.feature_key(source, files=cache.fingerprint(source))
    soon = datetime.now() + timedelta(minutes=1)
    assert key not in {r["key"] for r in cache.unused_since(spark, datetime.now() - timedelta(hours=1)).collect()}
    assert key in {r["key"] for r in cache.unused_since(spark, soon).collect()}
    assert cache.drop_unused(spark, soon) >= 1
    assert cache.unused_since(spark, soon).count() == 0 and cache.drop_unused(spark, soon) == 0
    assert cache.kept(source).count() == 1


WHOLE = {"eval_micro-f1": 0.5, "eval_macro-f1": 1, "predict_micro-f1": 0.3, "predict_macro-f1": 0.2}


def test_audit_agrees_with_the_reader(spark, tmp_path):
    cases = {
        1: (json.dumps(WHOLE, indent=2), None),
        2: (json.dumps(WHOLE)[:30], "cut off"),
        3: ("", "absent"),
        4: (json.dumps({**WHOLE, "predict_macro-f1": None}), "field missing"),
        5: (json.dumps({"epoch": 1.0}), "field missing"),
        6: (json.dumps({**WHOLE, "eval_micro-f1": "0.5"}), "wrong type"),
        7: (json.dumps({**WHOLE, "eval_micro-f1": [1]}), "wrong type"),
        8: (json.dumps({**WHOLE, "epoch": "x"}), "wrong type"),
        9: (json.dumps({**WHOLE, "eval_micro-f1": float("nan")}), "wrong type"),
        10: ("\n ", "cut off"),
    }
    for seed, (text, _) in cases.items():
        write(tmp_path / f"logs/t/org/m/seed_{seed}/all_results.json", text)
    expected = spark.createDataFrame([("org/m", "t", s) for s in (1, 2, 3, 77)], "model string, task string, seed int")
    audit = {r["seed"]: r for r in R.audit_runs(spark, str(tmp_path), expected).collect()}
    assert {s: r["reason"] for s, r in audit.items()} == {**{s: why for s, (_, why) in cases.items()}, 77: "absent"}
    assert audit[1]["eval_macro_f1"] == 1.0 and audit[1]["task"] == "t"
    assert {r["seed"] for r in R.read_runs(spark, str(tmp_path)).collect()} == {s for s, (_, why) in cases.items() if why is None}


def test_an_absent_tree_has_no_runs(spark, tmp_path):
    assert R.read_runs(spark, str(tmp_path)).count() == 0
    assert R.read_train_logs(spark, str(tmp_path)).count() == 0
    expected = spark.createDataFrame([("m", "t", 1)], "model string, task string, seed int")
    assert [r["reason"] for r in R.audit_runs(spark, str(tmp_path), expected).collect()] == ["absent"]


def test_first_line_of_every_file_goes(spark, tmp_path):
    bodies = {"a": ["1,x,1", "", "head"], "b": [], "c": [f"{i},{'y' * (i % 37)},{i}" for i in range(5000)], "d": ["head"] * 3}
    for name, body in bodies.items():
        write(tmp_path / f"{name}.csv", "\n".join(["head", *body]) + "\n")
    write(tmp_path / "e.csv", "")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        got = R.read_lines(spark, str(tmp_path), skip_first=True).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r[0] for r in got) == sorted(line for body in bodies.values() for line in body)


def test_drifted_json(spark, tmp_path):
    write(tmp_path / "a.json", '{"id": 1, "text": "x", "old": 1}\n{"id": 2}\nbroken\n')
    write(tmp_path / "b.json", '{"id": 3, "new": {"k": [1]}, "text": null}\n')
    write(tmp_path / "c.json", "")
    path = str(tmp_path)
    layouts = R.json_layouts(spark, path)
    assert sorted((",".join(r["fields"]), r["n_files"], r["n_rows"]) for r in layouts.collect()) == [
        ("id", 1, 1), ("id,new,text", 1, 1), ("id,old,text", 1, 1),
    ]
    types = T.StructType.fromDDL("id bigint, label int")
    back = R.read_drifted_json(spark, path, types, drop=["old", "nowhere"], layouts=layouts)
    assert back.columns == ["id", "label", "new", "text"]
    assert sorted(map(tuple, back.where("id is not null").collect())) == [
        (1, None, None, "x"), (2, None, None, None), (3, None, '{"k": [1]}', None),
    ]
    with pytest.raises(ValueError, match="more than 2 layouts"):
        R.json_layouts(spark, path, max_layouts=2)
