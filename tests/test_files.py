"""File layouts written and read back."""

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators import curation
from corpusloom.sinks import keyed_files
from corpusloom.sinks import writers as W
from corpusloom.sources import cache, readers as R


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode())


def test_task_table_reads_one_split_only(spark, tmp_path, capsys):
    rows = spark.createDataFrame([("a", 1, "train"), ("b", 2, "dev"), ("c", 3, "test")], "text string, label int, split string")
    W.write_task(rows, str(tmp_path), "scotus")
    assert R.load_task(spark, str(tmp_path), "scotus").count() == 3
    for name in ("dev", "val", "validation"):
        dev = R.load_task(spark, str(tmp_path), "scotus", name)
        assert [tuple(r) for r in dev.collect()] == [("b", 2, "validation")]
    R.load_task(spark, str(tmp_path), "scotus", "train").explain()
    assert "PartitionFilters: [isnotnull(split" in capsys.readouterr().out


def test_output_is_not_replaced_unless_told(spark, tmp_path):
    rows = spark.createDataFrame([("a", "train")], "text string, split string")
    path = str(tmp_path / "out")
    W.write_split_json(rows, path)
    with pytest.raises(AnalysisException, match="PATH_ALREADY_EXISTS"):
        W.write_split_json(rows, path)
    W.write_split_json(rows, path, overwrite=True)


def test_json_lines_by_split(spark, tmp_path):
    schema = T.StructType.fromDDL("labels array<string>, text string, extra string, split string")
    rows = spark.createDataFrame([(["x"], 'say "é"\n', "e", "train"), ([], "", "f", "test")], schema)
    W.write_split_json(rows.drop("extra", "absent"), str(tmp_path / "j"))
    back = R.read_jsonl(spark, str(tmp_path / "j"), T.StructType.fromDDL("labels array<string>, text string, split string"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted([(["x"], 'say "é"\n', "train"), ([], "", "test")], key=str)
    assert json.loads(W.encode_records(rows).first()["value"])["text"] == 'say "é"\n'


def test_raw_lines_to_choice_records(spark, tmp_path):
    raw = tmp_path / "raw.csv"
    good = '1,"the, ""court"" held",a b,c,d,e,f,2'
    write(raw, f"id,context,o1,o2,o3,o4,o5,label\n{good}\nx,broken,1\n2,short,no digit at the end\n3,{'y' * 5000},1\n")
    lines = R.read_lines(spark, str(raw))
    kept = lines.where(curation.well_formed(F.col("value")) & curation.not_overlong(F.col("value")))
    W.write_lines(kept, "value", str(tmp_path / "fixed"))
    assert [r["value"] for r in R.read_lines(spark, str(tmp_path / "fixed")).collect()] == [good]
    record = R.read_choice_csv(spark, str(tmp_path / "fixed"), header=False).first()
    assert record["context"] == 'the, "court" held'
    assert (record["option_1"], record["option_5"], record["label"]) == ("a b", "f", "2")
    write(tmp_path / "head.csv", f"id,context,o1,o2,o3,o4,o5,label\n{good}\n")
    assert R.read_choice_csv(spark, str(tmp_path / "head.csv")).count() == 1


def test_keyed_lines_and_annotation_sets(spark, tmp_path):
    write(tmp_path / "sentences/Acme.v1.txt", "first -lrb-x-rrb-\nsecond\r\n\nlast")
    write(tmp_path / "sentences/Beta.txt", "only\n")
    write(tmp_path / "sentences/Empty.txt", "")
    got = {(r["key"], r["line_no"]): r["text"] for r in R.read_keyed_lines(spark, str(tmp_path / "sentences/*.txt")).collect()}
    assert got == {
        ("Acme", 0): "first -lrb-x-rrb-",
        ("Acme", 1): "second",
        ("Acme", 2): "",
        ("Acme", 3): "last",
        ("Beta", 0): "only",
    }
    write(tmp_path / "L_A/Acme.txt", "1\n0\n0\n1")
    write(tmp_path / "L_A/Beta.txt", "0\n")
    write(tmp_path / "L_B/Acme.txt", "1\n0\n0\n0\n")
    write(tmp_path / "L_B/Beta.txt", "1\n")
    marks = R.read_annotation_sets(spark, str(tmp_path), ["L_A", "L_B"])
    lines = R.read_keyed_lines(spark, str(tmp_path / "sentences/*.txt"))
    labelled = curation.label_lists(lines, marks, ["key", "line_no"], ["A", "B"])
    assert {(r["key"], r["line_no"]): r["labels"] for r in labelled.collect()} == {
        ("Acme", 0): ["A", "B"],
        ("Acme", 1): [],
        ("Acme", 2): [],
        ("Acme", 3): ["A"],
        ("Beta", 0): ["B"],
    }


def result(a=0.5, b=0.4, c=0.3, d=0.2):
    return {"eval_micro-f1": a, "eval_macro-f1": b, "predict_micro-f1": c, "predict_macro-f1": d, "epoch": 3.0, "train_samples": 9}


def test_run_tree(spark, tmp_path):
    write(tmp_path / "logs/t1/base/seed_1/all_results.json", json.dumps(result(), indent=4))
    write(tmp_path / "logs/t1/org/base/seed_2/all_results.json", json.dumps(result(a=1)))
    write(tmp_path / "logs/t1/base/seed_3/all_results.json", '{"eval_micro-f1": 0.5,')
    partial = result()
    del partial["predict_macro-f1"]
    write(tmp_path / "logs/t1/base/seed_4/all_results.json", json.dumps(partial))
    write(tmp_path / "logs/t1/base/seed_1/other.json", json.dumps(result()))
    metrics = spark.createDataFrame([(0.9, 0.8, 0.7, 0.6)], "`eval_micro-f1` double, `eval_macro-f1` double, `predict_micro-f1` double, `predict_macro-f1` double")
    W.write_metrics(metrics, str(tmp_path), "t2", "base", 5)
    got = {(r["task"], r["model"], r["seed"]): (r["eval_micro_f1"], r["predict_macro_f1"]) for r in R.read_runs(spark, str(tmp_path)).collect()}
    assert got == {("t1", "base", 1): (0.5, 0.2), ("t1", "org/base", 2): (1.0, 0.2), ("t2", "base", 5): (0.9, 0.6)}


def test_trainer_states(spark, tmp_path):
    state = {"log_history": [{"loss": 1.0, "epoch": 1.0}, {"train_runtime": 60.5, "epoch": 4.0}], "best": 1}
    write(tmp_path / "logs/t1/org/m/seed_1/trainer_state.json", json.dumps(state, indent=2))
    write(tmp_path / "logs/t1/m/seed_2/trainer_state.json", json.dumps({"log_history": []}))
    write(tmp_path / "logs/t1/m/seed_3/trainer_state.json", json.dumps({"log_history": [{"epoch": 1.0}]}))
    write(tmp_path / "logs/t1/m/seed_4/trainer_state.json", "not json")
    assert [tuple(r) for r in R.read_train_logs(spark, str(tmp_path)).collect()] == [("t1", "org/m", 1, 4.0, 60.5)]


def test_feature_cache_builds_once(spark):
    import uuid

    run = uuid.uuid4().hex
    key = cache.feature_key(spark.range(3), max_length=128, run=run)
    assert key == cache.feature_key(spark.range(3), run=run, max_length=128)
    assert key != cache.feature_key(spark.range(4), max_length=128, run=run)
    assert key != cache.feature_key(spark.range(3), max_length=64, run=run)
    first = cache.materialize(spark.range(3), key)
    assert first.count() == 3
    assert cache.materialize(spark.range(99), key).count() == 3
    assert cache.materialize(spark.range(5), key, overwrite=True).count() == 5


def test_shared_folder_is_the_configured_one(spark):
    from corpusloom.session import shared_folder

    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_published_files_are_read_by_their_manifest(spark, tmp_path):
    rows = spark.range(40).select(F.concat(F.lit("k"), F.col("id") % 5).alias("key"), F.col("id").alias("line_no"), F.lit("é\u2028x").alias("text"))
    other = rows.limit(3).withColumn("key", F.lit("sub/name"))
    keyed_files.write_keyed_files(rows.unionByName(other), str(tmp_path / "out"))
    plan = R.read_keyed_lines(spark, f"{tmp_path}/out/*.txt")
    # no file but the manifest is listed for the scan, so their names do not pass the driver
    assert plan.inputFiles() and all("/_manifest/" in name for name in plan.inputFiles())
    # the same files without a manifest
    for name in (tmp_path / "out").glob("*.txt"):
        write(tmp_path / "bare" / name.name, name.read_bytes().decode())
    bare = R.read_keyed_lines(spark, f"{tmp_path}/bare/*.txt")
    assert sorted(map(tuple, plan.collect())) == sorted(map(tuple, bare.collect())) and plan.count() == 40
    assert R.read_keyed_lines(spark, f"{tmp_path}/out/sub/*.txt").count() == 3
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        R.read_keyed_lines(spark, f"{tmp_path}/out/*.csv").collect()
