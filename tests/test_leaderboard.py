"""Leaderboard arithmetic, early stopping, and the published averages."""

import math

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import leaderboard as B
from corpusloom.operators import training_log as G

# Published scores per model: micro / macro of six tasks, then one multiple-choice score.
TASK_SCORES = {
    "large": "73.8 67.6 79.8 71.6 75.5 66.3 67.9 50.3 88.6 83.6 95.8 81.6 74.4",
    "m1": "71.2 63.6 79.7 73.4 68.3 58.3 71.4 57.2 87.6 81.8 95.6 81.3 70.8",
    "m2": "69.2 59.0 77.3 68.9 71.6 62.0 71.9 57.9 87.9 82.3 95.2 79.2 71.4",
    "m3": "70.0 60.8 78.8 71.0 71.1 62.7 72.1 57.4 88.2 83.1 95.5 80.3 72.6",
    "m4": "69.9 64.7 79.4 71.7 72.9 64.0 71.6 57.7 88.2 83.0 95.5 80.9 71.9",
    "m5": "70.0 62.9 78.8 70.9 72.8 62.0 71.5 56.8 87.8 82.6 95.7 81.3 70.8",
    "m6": "70.0 64.0 80.4 74.7 76.4 66.5 72.1 57.4 88.2 83.0 96.0 83.0 75.3",
    "m7": "69.8 62.9 78.8 70.3 76.6 65.9 70.7 56.6 88.3 83.0 96.0 82.3 75.4",
}
# Published means: arithmetic, harmonic, geometric, each micro / macro.
MEANS = {
    "large": "79.4 70.8 78.4 69.1 78.9 70.0",
    "m1": "77.8 69.5 76.7 68.2 77.2 68.8",
    "m2": "77.8 68.7 76.8 67.5 77.3 68.1",
    "m3": "78.3 69.7 77.4 68.5 77.8 69.1",
    "m4": "78.5 70.5 77.5 69.5 78.0 70.0",
    "m5": "78.2 69.6 77.2 68.4 77.7 69.0",
    "m6": "79.8 72.0 78.9 70.8 79.3 71.4",
    "m7": "79.4 70.9 78.5 69.7 78.9 70.3",
}


def test_published_averages(spark):
    rows = []
    for model, line in TASK_SCORES.items():
        numbers = [float(x) / 100 for x in line.split()]
        pairs = list(zip(numbers[0:12:2], numbers[1:12:2])) + [(numbers[12], numbers[12])]
        rows += [(model, t, 1, micro, macro, micro, macro) for t, (micro, macro) in enumerate(pairs)]
    runs = spark.createDataFrame(rows, ["model", "task", "seed", *B.SCORES])
    expected = B.expected_pairs(spark, list(TASK_SCORES), list(range(7)))
    means = B.mean_scores(B.task_scores(expected, runs)).collect()
    got = {(r["model"], r["measure"]): r for r in means}
    checked = 0
    for model, line in MEANS.items():
        published = [float(x) for x in line.split()]
        for offset, measure in ((0, "predict_micro_f1"), (1, "predict_macro_f1")):
            row = got[model, measure]
            assert row["harmonic"] <= row["geometric"] <= row["arithmetic"]
            for i, kind in enumerate(("arithmetic", "harmonic", "geometric")):
                assert row[kind] * 100 == pytest.approx(published[2 * i + offset], abs=0.1001), (model, kind)
                checked += 1
    assert checked == 48


@pytest.fixture(scope="module")
def runs(spark):
    rows = [
        ("a", "t", 1, 0.50, 0.40, 0.10, 0.20),
        ("a", "t", 2, 0.60, 0.70, 0.30, 0.40),
        ("a", "t", 3, 0.70, 0.70, 0.50, 0.60),
        ("a", "t", 4, 0.80, 0.10, 0.70, 0.80),
        ("a", "u", 1, 0.90, 0.20, 0.90, 1.00),
        ("b", "t", 5, 0.10, 0.00, 0.00, 0.00),
        ("b", "u", 1, 0.10, 0.30, 0.50, 0.25),
    ]
    return spark.createDataFrame(rows, ["model", "task", "seed", *B.SCORES])


def test_top_seeds_keep_seed_order_on_ties(runs):
    ranked = [(r["seed"], r["rank"]) for r in B.top_seeds(runs.where("model='a' and task='t'"), 3).orderBy("rank").collect()]
    assert ranked == [(2, 1), (3, 2), (1, 3)]


def test_dev_topk_test_best(runs):
    row = B.dev_topk_test_best(runs, 2).where("model='a' and task='t'").first()
    assert row["eval_micro_f1_mean"] == pytest.approx(0.65)
    assert row["eval_micro_f1_std"] == pytest.approx(0.05)
    assert (row["predict_micro_f1"], row["predict_macro_f1"]) == (0.30, 0.40)


def test_seed_summary_uses_population_deviation(runs):
    row = B.seed_summary(runs).where("model='a' and task='t'").first()
    assert row["n_seeds"] == 4
    assert row["eval_micro_f1_std"] == pytest.approx(math.sqrt(sum((x - 0.65) ** 2 for x in (0.5, 0.6, 0.7, 0.8)) / 4))


def test_missing_runs_and_models_without_a_task(spark, runs):
    expected = B.expected_runs(spark, ["a", "b", "c"], ["t", "u"], [1, 2])
    missing = {(r["model"], r["task"], r["seed"]) for r in B.missing_runs(expected, runs).collect()}
    assert missing == {("a", "u", 2), ("b", "t", 1), ("b", "t", 2), ("b", "u", 2)} | {
        ("c", t, s) for t in "tu" for s in (1, 2)
    }
    means = {r["model"]: r for r in B.mean_scores(B.task_scores(B.expected_pairs(spark, ["a", "b", "c"], ["t", "u"]), runs)).where("measure='predict_micro_f1'").collect()}
    assert means["c"]["arithmetic"] is None
    # one score of 0 makes both other means 0
    assert (means["b"]["arithmetic"], means["b"]["harmonic"], means["b"]["geometric"]) == (0.25, 0.0, 0.0)


def test_harmonic_mean_rejects_negative_scores(spark):
    with pytest.raises(Exception, match="negative score"):
        spark.createDataFrame([(0.5,), (-0.1,)], "x double").agg(B.harmonic_mean(F.col("x"))).collect()


def test_table_and_lines(spark, runs):
    expected = B.expected_pairs(spark, ["a", "b", "c"], ["t", "u"])
    table = B.score_table(B.task_scores(expected, runs), ["t", "u"])
    names = spark.createDataFrame([("a", "Same"), ("b", "Same")], "model string, name string")
    lines = {r["model"]: r["line"] for r in B.table_lines(B.with_display_name(table, names), "name", ["t", "u"]).collect()}
    assert lines["a"] == "<tr><td>Same</td><td>30.0 / 40.0</td><td>90.0 / 100.0</td></tr>"
    assert lines["c"] == "<tr><td>c</td><td>nan / nan</td><td>nan / nan</td></tr>"
    line = B.run_lines(runs.where("model='a' and seed=4")).first()["line"]
    assert line == "MICRO-F1: 80.0\tMACRO-F1: 10.0\t | MICRO-F1: 70.0\tMACRO-F1: 80.0"


def test_train_time(spark):
    logs = spark.createDataFrame([("t", "m", 1, 2.0, 100.0), ("t", "m", 2, 10.0, 90000.0), ("t", "m", 3, 0.0, 5.0)],
                                 "task string, model string, seed int, epochs double, runtime double")
    row = B.train_time_lines(B.train_time(logs)).first()
    # the mean of the runs' ratios, not the ratio of the means; a run without epochs has no ratio
    assert row["time_per_epoch"] == pytest.approx((50 + 9000) / 2)
    assert row["line"] == "TRAIN TIME: 8:20:35\t TIME/EPOCH: 1:15:25\t EPOCHS: 4.0 ± 4.3"


def simulate(metrics, patience):
    best, waited, best_epoch = None, 0, None
    for epoch, value in enumerate(metrics, start=1):
        if best is None or value > best:
            best, waited, best_epoch = value, 0, epoch
        else:
            waited += 1
            if waited >= patience:
                return epoch, best_epoch
    return None, best_epoch


def test_early_stop_and_best_epoch(spark):
    import random

    rng = random.Random(8)
    runs = {r: [rng.choice([0.1, 0.2, 0.3, 0.4, 0.5, 0.6]) for _ in range(rng.randint(1, 20))] for r in range(60)}
    rows = [(r, e, v) for r, vs in runs.items() for e, v in enumerate(vs, start=1)]
    df = spark.createDataFrame(rows, "run int, epoch int, f1 double")
    stops = {r["run"]: r for r in G.early_stop(df, ["run"], "epoch", "f1").collect()}
    best = {r["run"]: r for r in G.best_epoch(df, ["run"], "epoch", "f1").collect()}
    for run, metrics in runs.items():
        stop, first_best = simulate(metrics, 3)
        assert stops[run]["stop_epoch"] == (stop or len(metrics))
        assert stops[run]["out_of_patience"] == (stop is not None)
        assert best[run]["best_epoch"] == first_best
        assert best[run]["f1"] == metrics[first_best - 1]


def test_geometric_mean_refuses_negatives(spark):
    scores = spark.createDataFrame([(0.5,), (-0.5,)], "x double")
    with pytest.raises(Exception, match="negative score"):
        scores.agg(B.geometric_mean(F.col("x"))).collect()
