"""Metrics and losses against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.labels import argmax
from corpusloom.operators import evaluation as E
from corpusloom.operators import losses

N = 4


def f1(tp, fp, fn):
    return 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0


def brute(gold, pred, labels):
    counts = []
    for label in labels:
        tp = sum(label in g and label in p for g, p in zip(gold, pred))
        fp = sum(label not in g and label in p for g, p in zip(gold, pred))
        fn = sum(label in g and label not in p for g, p in zip(gold, pred))
        counts.append((tp, fp, fn))
    micro = f1(*[sum(c[i] for c in counts) for i in range(3)])
    return micro, sum(f1(*c) for c in counts) / len(counts)


@pytest.fixture(scope="module")
def examples():
    rng = random.Random(5)
    gold = [sorted(rng.sample(range(3), rng.choice([0, 1, 1, 2]))) for _ in range(200)]
    scores = [[rng.choice([-1.5, -0.1, 0.0, 0.2, 2.0]) for _ in range(N)] for _ in range(200)]
    # label 3 never occurs in gold; the first row repeats a label and has one out of range
    gold[0] = [1, 1, 9]
    return gold, scores


def frame(spark, examples):
    gold, scores = examples
    rows = [(i, g, s) for i, (g, s) in enumerate(zip(gold, scores))]
    return spark.createDataFrame(rows, "id int, labels array<int>, scores array<double>")


@pytest.mark.parametrize("zero_class", [True, False])
def test_multilabel_f1(spark, examples, zero_class):
    gold, scores = examples
    g = [{x for x in labels if x < N} for labels in gold]
    p = [{i for i, x in enumerate(s) if x > 0} for s in scores]
    labels = range(N + int(zero_class))
    if zero_class:
        g, p = [x or {N} for x in g], [x or {N} for x in p]
    row = E.multilabel_f1(frame(spark, examples), "labels", "scores", N, zero_class).first()
    assert (row["micro_f1"], row["macro_f1"]) == pytest.approx(brute(g, p, labels))


def test_multilabel_f1_per_group_equals_each_group_alone(spark, examples):
    df = frame(spark, examples).withColumn("part", F.col("id") % 3)
    together = {r["part"]: r for r in E.multilabel_f1(df, "labels", "scores", N, by=["part"]).collect()}
    for part in range(3):
        alone = E.multilabel_f1(df.where(F.col("part") == part), "labels", "scores", N).first()
        assert together[part]["macro_f1"] == pytest.approx(alone["macro_f1"])
        assert together[part]["micro_f1"] == pytest.approx(alone["micro_f1"])


def test_nothing_predicted_scores_zero(spark):
    df = spark.createDataFrame([([], [-1.0, -1.0])], "labels array<int>, scores array<double>")
    row = E.multilabel_f1(df, "labels", "scores", 2, zero_class=False).first()
    assert (row["micro_f1"], row["macro_f1"]) == (0.0, 0.0)
    with_zero = E.multilabel_f1(df, "labels", "scores", 2).first()
    assert with_zero["micro_f1"] == 1.0
    assert with_zero["macro_f1"] == pytest.approx(1 / 3)


def test_confusion_lists_labels_that_never_occur(spark):
    df = spark.createDataFrame([([0], [0, 2]), ([2], [])], "g array<int>, p array<int>")
    rows = [tuple(r) for r in E.label_confusion(df, "g", "p", 4).orderBy("label").collect()]
    assert rows == [(0, 1, 0, 0, 1.0), (1, 0, 0, 0, 0.0), (2, 0, 1, 1, 0.0), (3, 0, 0, 0, 0.0)]


def test_multiclass_f1(spark):
    rng = random.Random(2)
    gold = [rng.choice([0, 1, 2]) for _ in range(300)]
    pred = [rng.choice([g, g, 1, 5]) for g in gold]
    df = spark.createDataFrame(list(zip(gold, pred)), "g int, p int")
    row = E.multiclass_f1(df, "g", "p").first()
    classes = sorted(set(gold) | set(pred))
    expected = brute([{g} for g in gold], [{p} for p in pred], classes)
    assert (row["micro_f1"], row["macro_f1"]) == pytest.approx(expected)
    assert row["micro_f1"] == pytest.approx(E.accuracy(df, "g", "p").first()["accuracy"])


def test_hot_class_is_one_row_per_task_before_the_shuffle(spark):
    df = spark.range(50_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).cast("int").alias("g"), (F.col("id") % 7).cast("int").alias("p")
    )
    counts = {r["label"]: (r["tp"], r["fp"], r["fn"]) for r in E.class_counts(df, "g", "p").collect()}
    pairs = [(0 if i % 3 == 0 else i % 7, i % 7) for i in range(50_000)]
    for c in range(7):
        assert counts[c] == (
            sum(g == c == p for g, p in pairs),
            sum(g != c and p == c for g, p in pairs),
            sum(g == c and p != c for g, p in pairs),
        )


def test_alignment(spark):
    gold = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    pred = spark.createDataFrame([(2, 0.5), (3, 0.1), (4, 0.2), (5, 0.0)], "id int, s double")
    assert tuple(E.alignment_report(gold, pred, "id").first()) == (2, 1, 2)
    assert E.align(gold, pred, "id").count() == 2


def test_metric_registry(spark):
    df = spark.createDataFrame([(1, 1), (0, 1)], "g int, p int")
    E.register_metric("n_rows", lambda rows: rows.agg(F.count("*").cast("double").alias("n_rows")))
    assert [tuple(r) for r in E.evaluate(df, "n_rows").collect()] == [("n_rows", 2.0)]
    long = {r["metric"]: r["value"] for r in E.evaluate(df, "multiclass_f1", gold="g", pred="p").collect()}
    assert long["micro_f1"] == 0.5


def test_prediction_lines(spark):
    df = spark.createDataFrame([(3, [0.5, -1.25, 1 / 3])], "id int, s array<double>")
    assert E.prediction_lines(df, "id", "s").first()["line"] == "3\t0.50000\t-1.25000\t0.33333"


def softmax_loss(x, y):
    return math.log(sum(math.exp(v) for v in x)) - x[y]


def test_losses(spark):
    rng = random.Random(1)
    rows = [([rng.uniform(-3, 3) for _ in range(3)], rng.choice([-1, 0, 1, 2])) for _ in range(50)]
    df = spark.createDataFrame(rows, "x array<double>, y int")
    expected = [softmax_loss(x, y) for x, y in rows if y >= 0]
    assert losses.mean_ce(df, "x", "y").first()[0] == pytest.approx(sum(expected) / len(expected))
    assert losses.mean_ce(df.where("y < 0"), "x", "y").first()[0] == 0.0
    soft = df.withColumn("t", F.array(F.lit(0.2), F.lit(0.5), F.lit(0.3)))
    want = [sum(t * softmax_loss(x, i) for i, t in enumerate((0.2, 0.5, 0.3))) for x, _ in rows]
    assert losses.mean_soft_ce(soft, "x", "t").first()[0] == pytest.approx(sum(want) / len(want))
    hot = df.withColumn("t", F.array(F.lit(1), F.lit(0), F.lit(1)))
    want = [-math.log(1 / (1 + math.exp(-v if t else v))) for x, _ in rows for v, t in zip(x, (1, 0, 1))]
    assert losses.mean_bce(hot, "x", "t").first()[0] == pytest.approx(sum(want) / len(want))
    squares = df.withColumn("s", F.get("x", 0))
    want = [(x[0] - y) ** 2 for x, y in rows]
    assert losses.mean_squared_error(squares, "s", "y").first()[0] == pytest.approx(sum(want) / len(want))


def test_losses_stay_finite_for_large_logits(spark):
    df = spark.createDataFrame([([1000.0, -1000.0], 0)], "x array<double>, y int")
    assert losses.mean_ce(df, "x", "y").first()[0] == 0.0
    hot = df.withColumn("t", F.array(F.lit(0), F.lit(0)))
    assert losses.mean_bce(hot, "x", "t").first()[0] == 500.0


def test_argmax_ties_go_to_the_first(spark):
    df = spark.createDataFrame([([1.0, 1.0],)], "s array<double>")
    assert df.select(argmax(F.col("s"))).first()[0] == 0


def test_alignment_of_all_rows_or_none(spark):
    gold = spark.createDataFrame([(1,), (2,)], "id int")
    pred = spark.createDataFrame([(2, 0.5), (3, 0.1)], "id int, s double")
    assert E.align(gold.where("id = 2"), pred, "id", require_all=True).count() == 1
    with pytest.raises(Exception, match="no prediction for 1"):
        E.align(gold, pred, "id", require_all=True).collect()
