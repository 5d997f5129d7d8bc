"""TF-IDF, token ids, pooling and the linear baselines against brute force."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import sequences as S
from corpusloom.functions import text as T
from corpusloom.operators import encoding, hooks, pooling, svm, tfidf
from corpusloom.sources import cache

WORDS = "court law judge appeal right contract party treaty article state the of and".split()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    made = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    return made + ["", "the of", made[0], made[0]]


@pytest.fixture(scope="module")
def docs(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return tfidf.with_tokens(df, "text")


def grams(text):
    toks = [t for t in re.findall(r"\w\w+", text) if t not in set(T.ENGLISH_STOP_WORDS)]
    return [" ".join(toks[j : j + n]) for n in (1, 2, 3) for j in range(len(toks) - n + 1)]


def brute_vocabulary(texts, size):
    tf, df = Counter(), Counter()
    for text in texts:
        tf.update(grams(text))
        df.update(set(grams(text)))
    kept = sorted((t for t in tf if df[t] >= 5), key=lambda t: (-tf[t], t))[:size]
    return {t: (tf[t], df[t], math.log((1 + len(texts)) / (1 + df[t])) + 1) for t in sorted(kept)}


def test_vocabulary_and_idf(docs, texts):
    expected = brute_vocabulary(texts, 40)
    rows = tfidf.vocabulary(docs, 40).orderBy("index").collect()
    assert [r["term"] for r in rows] == list(expected)
    assert [r["index"] for r in rows] == list(range(len(expected)))
    for r in rows:
        assert (r["tf"], r["df"], r["idf"]) == pytest.approx(expected[r["term"]])


@pytest.mark.parametrize("inline", [0, 2_000])
@pytest.mark.parametrize("size", [1, 8, 15, 5000])
def test_pruned_counting_finds_the_same_vocabulary(docs, texts, size, inline, monkeypatch):
    monkeypatch.setattr(tfidf, "INLINE_MEMBERS", inline)
    # small sizes cut among ties, where the ties may exceed what one length may return
    got = {r["term"]: (r["tf"], r["df"]) for r in tfidf.vocabulary(docs, size).collect()}
    assert got == {t: (tf, df) for t, (tf, df, _) in brute_vocabulary(texts, size).items()}


def test_ties_beyond_the_bound_switch_pruning_off(spark):
    # twelve words, all equally frequent: more ties than twice the vocabulary
    texts = [" ".join(chr(97 + (i + j) % 12) * 2 for j in range(12)) for i in range(12)]
    df = tfidf.with_tokens(spark.createDataFrame([(t,) for t in texts], "text string"), "text")
    got = {r["term"]: (r["tf"], r["df"]) for r in tfidf.vocabulary(df, 3).collect()}
    assert got == {t: (tf, n) for t, (tf, n, _) in brute_vocabulary(texts, 3).items()}


def test_weights_are_normalised_per_document(docs, texts):
    vocabulary = brute_vocabulary(texts, 40)
    got = {(r["doc_id"], r["term"]): r["weight"] for r in tfidf.term_weights(docs, "doc_id", 40).collect()}
    expected = {}
    for i, text in enumerate(texts):
        raw = {t: n * vocabulary[t][2] for t, n in Counter(grams(text)).items() if t in vocabulary}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        expected.update({(i, t): w / norm for t, w in raw.items()})
    assert got == pytest.approx(expected)


def test_empty_vocabulary_is_an_error(docs):
    with pytest.raises(ValueError, match="vocabulary is empty"):
        tfidf.fit_tfidf(docs, 10, min_documents=10_000)


def test_token_vocabulary_and_ids(spark):
    rows = [(1, [["b", "a"], [], ["a", "zz"]]), (2, []), (3, [[], []]), (4, [["a", "b", "a", "a"]])]
    df = spark.createDataFrame(rows, "id int, segments array<array<string>>")
    flat = df.withColumn("tokens", F.flatten("segments"))
    vocabulary = encoding.token_vocabulary(flat, "tokens", 2)
    assert {r["token"]: r["token_id"] for r in vocabulary.collect()} == {"a": 2, "b": 3}
    got = {r["id"]: r["rows"] for r in encoding.encode_rows(flat, "id", F.col("segments"), vocabulary).collect()}
    assert got == {1: [[3, 2], [], [2, 1]], 2: [], 3: [[], []], 4: [[2, 3, 2, 2]]}


def test_matrix_of_a_document_with_many_segments(spark):
    df = spark.createDataFrame([(1, [[f"t{i}"] * (i % 4) for i in range(70)])], "id int, segments array<array<string>>")
    flat = df.withColumn("tokens", F.flatten("segments"))
    vocabulary = encoding.token_vocabulary(flat, "tokens", 1000)
    rows = encoding.encode_rows(flat, "id", F.slice("segments", 1, 64), vocabulary)
    matrix = rows.select(S.pad_matrix(F.col("rows"), 64, 3).alias("m"))
    got = matrix.select("m", S.segment_positions(F.col("m")).alias("p")).first()
    assert len(got["m"]) == 64 and all(len(r) == 3 for r in got["m"])
    assert got["p"] == [0 if i % 4 == 0 else i + 1 for i in range(64)]


def test_max_pool_skips_padding(spark):
    rows = [(1, [1.0, -5.0], 1), (1, [0.0, -7.0], 2), (1, [9.0, 9.0], 0), (2, [-1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "d int, v array<double>, p int")
    real = {r["d"]: r["v"] for r in pooling.max_pool(df, "d", "v", F.col("p") != 0).collect()}
    assert real == {1: [1.0, -5.0], 2: [-1.0, 2.0]}
    padded = {r["d"]: r["v"] for r in pooling.max_pool(df, "d", "v").collect()}
    assert padded[1] == [9.0, 9.0]


def test_regroup_choices(spark):
    df = spark.createDataFrame([(1, 2, 0.3), (1, 0, 0.1), (1, 1, 0.2)], "e int, c int, s double")
    assert pooling.regroup_choices(df, "e", "c", "s").first()["scores"] == [0.1, 0.2, 0.3]


@pytest.fixture(scope="module")
def topics(spark):
    rng = random.Random(4)
    words = {0: ["court", "judge", "appeal"], 1: ["contract", "party", "clause"], 2: ["treaty", "state", "union"]}
    rows = []
    for i in range(120):
        label = i % 3
        text = " ".join(rng.choice(words[label] + ["law", "right"]) for _ in range(20))
        rows.append((i, text, label, [label] if label else [], "train" if i < 80 else "validation" if i < 100 else "test"))
    return spark.createDataFrame(rows, "doc_id int, text string, label int, labels array<int>, split string")


def test_multiclass_baseline_learns_separable_topics(spark, topics):
    points = svm.grid(sizes=(20, 30), penalties=(1.0,), losses=(svm.HINGE,))
    rows = topics.withColumn("positives", F.array("label"))
    scores = svm.grid_search(points, lambda size: svm.featurise(rows, "text", size, 5), "positives", 3, False)
    assert [r["grid_index"] for r in scores.orderBy("grid_index").collect()] == [0, 1]
    best = svm.best_point(scores).first()
    assert best["grid_index"] == 0 and best["score"] == 1.0
    predicted = svm.fit_predict_multiclass(svm.featurise(topics, "text", 30, 5), "label", 1.0)
    by_split = {r["split"]: r["micro_f1"] for r in svm.split_scores(predicted, "label").collect()}
    assert by_split == {"validation": 1.0, "test": 1.0}


def test_multilabel_baseline_handles_constant_labels(topics):
    # label 0 and label 3 never occur
    rows = svm.fit_predict_multilabel(svm.featurise(topics, "text", 30, 5), "labels", 4, 1.0)
    held_out = rows.where("split = 'test'").collect()
    assert all(r["predicted"] == r["labels"] for r in held_out)
    assert all([s > 0 for s in r["scores"]] == [i in r["labels"] for i in range(4)] for r in held_out)
    scores = {r["split"]: r["macro_f1"] for r in svm.split_scores(rows, "labels", multilabel=4).collect()}
    # three of five labels, the zero class among them, are perfect; two never occur
    assert scores["test"] == pytest.approx(3 / 5)


def test_choice_blocks_sit_side_by_side(spark):
    rng = random.Random(9)
    rows = []
    for i in range(60):
        label = i % 3
        endings = [" ".join(rng.choice(["yes", "truth"] if c == label else ["no", "wrong"]) for _ in range(6)) for c in range(3)]
        rows.append((i, "which one holds", endings, label, "train" if i < 45 else "test"))
    df = spark.createDataFrame(rows, "i int, context string, endings array<string>, label int, split string")
    wide = svm.choice_columns(df, n=3)
    columns = ["context", "option_1", "option_2", "option_3"]
    features = svm.featurise_choices(wide, columns, 50, 5)
    predicted = svm.fit_predict_multiclass(features, "label", 1.0).where("split = 'test'").collect()
    assert all(r["predicted"] == r["label"] for r in predicted)


def test_search_and_seeds_of_a_multilabel_task(spark, topics):
    got = svm.search_and_rate(
        svm.grid(sizes=(30,), penalties=(1.0, 10.0)),
        lambda size: cache.spool(svm.featurise(topics, "text", size, 5)),
        "labels",
        4,
        True,
        "doc_id",
        (1, 2),
        0.9,
    )
    rows = got.collect()
    assert sorted((r["split"], r["sample"], r["n_seeds"]) for r in rows) == [
        ("test", "all", 1), ("test", "drawn", 2), ("validation", "all", 1), ("validation", "drawn", 2),
    ]
    assert all((r["max_features"], r["penalty"], r["loss"], r["micro_f1_std"]) == (30, 1.0, "hinge", 0.0) for r in rows)


def test_encoding_refuses_a_vocabulary_without_bound(spark, monkeypatch):
    df = spark.createDataFrame([(1, [["a", None, "b"], None], ["a", "b"]), (2, None, [])], "id int, s array<array<string>>, tokens array<string>")
    vocabulary = encoding.token_vocabulary(df, "tokens", 10)
    got = {r["id"]: r["rows"] for r in encoding.encode_rows(df, "id", F.col("s"), vocabulary).collect()}
    assert got == {1: [[2, 1, 3], []], 2: None}
    monkeypatch.setattr(encoding, "MAX_VOCABULARY", 1)
    with pytest.raises(ValueError):
        encoding.encode_rows(df, "id", F.col("s"), vocabulary)


def test_best_point_ties_go_to_the_first(spark):
    scores = spark.createDataFrame([(2, 0.9), (1, 0.9), (0, 0.1)], "grid_index int, score double")
    assert svm.best_point(scores).first()["grid_index"] == 1


def test_seeded_train_samples(spark):
    df = spark.range(1000).withColumn("split", F.when(F.col("id") < 900, "train").otherwise("test"))
    one, two = svm.train_sample(df, "id", 1, 0.5), svm.train_sample(df, "id", 2, 0.5)
    assert one.where("split='test'").count() == 100
    assert 380 < one.where("split='train'").count() < 520
    assert one.join(two, "id", "left_anti").count() > 100
    runs = spark.createDataFrame([(1, "test", 0.5, 0.25), (2, "test", 1.0, 0.75)], "seed int, split string, micro_f1 double, macro_f1 double")
    row = svm.over_seeds(runs).first()
    assert (row["n_seeds"], row["micro_f1_mean"], row["micro_f1_std"], row["macro_f1_std"]) == (2, 0.75, 0.25, 0.25)


def test_a_batch_function_gets_frames_bounded_by_their_text(spark):
    rows = spark.range(300).select("id", F.repeat(F.lit("ab "), F.when(F.col("id") == 7, 1_000_000).otherwise(10_000).cast("int")).alias("text")).coalesce(1)

    def sizes(frame):
        return frame.assign(n=len(frame), most=frame["text"].str.len().sum(), first=frame.index[0])[["n", "most", "first"]]

    done = hooks.map_batches(rows, sizes, "n bigint, most bigint, first bigint").drop("text").orderBy("id").collect()
    assert [r["id"] for r in done] == list(range(300))
    assert all(r["most"] <= hooks.FRAME_BYTES or r["n"] == 1 for r in done) and {r["first"] for r in done} == {0}
    assert max(r["n"] for r in done) > 10
