"""The registered queries: each runs one job of the benchmark kit over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import labels as L
from corpusloom.functions import sequences as S
from corpusloom.functions import text as T
from corpusloom.functions import vectors as V
from corpusloom.functions.arrays import unroll
from corpusloom.operators import (
    curation,
    encoding,
    evaluation,
    hooks,
    leaderboard,
    linear,
    losses,
    pooling,
    sampling,
    svm,
    tfidf,
    training_log,
)
from corpusloom.operators.lookups import lookup_join
from corpusloom.plans import views
from corpusloom.plans.parameters import (
    CAP,
    FIRST_WORDS,
    LABELS,
    MAX_FEATURES,
    MODELS,
    N_TRAIN_GROUPS,
    N_VALIDATION_GROUPS,
    PAIR_BUDGET,
    PATIENCE,
    SEEDS,
    SEGMENT_PATTERN,
    SEGMENT_WORDS,
    SEGMENTS,
    SEQUENCE,
    SVM_TRAIN_SHARE,
    SVM_VOCABULARY_SIZES,
    TASKS,
    TOKEN_VOCABULARY,
    TOP_LABELS,
    TOP_SEEDS,
    YEAR_SAMPLES,
    YEAR_SPLITS,
)
from corpusloom.session import tune
from corpusloom.sinks import keyed_files, staging, writers
from corpusloom.sources import cache, readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(tune(spark), folder)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def listing(items: Column) -> Column:
    """Array as text, so that results compare across engines."""
    return F.array_join(items.cast("array<string>"), ",")


# --- scoring -----------------------------------------------------------------


def scored_labels(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.align(views.multilabel_gold(spark, folder), views.multilabel_scores(spark, folder), "doc_id", True)


def indicator_rows(spark: SparkSession, folder: str) -> DataFrame:
    return scored_labels(spark, folder).select(
        "doc_id",
        L.multi_hot(F.col("labels"), LABELS).alias("gold"),
        L.positive_indicators(F.col("scores")).alias("pred"),
        "scores",
    )


@query
def eval_multilabel_f1(spark, folder):
    """Micro/macro F1 with the zero class."""
    scores = evaluation.multilabel_f1(scored_labels(spark, folder), "labels", "scores", LABELS)
    return rounded(scores, "micro_f1", "macro_f1")


@query
def eval_multilabel_f1_no_zero_class(spark, folder):
    scores = evaluation.multilabel_f1(scored_labels(spark, folder), "labels", "scores", LABELS, zero_class=False)
    return rounded(scores, "micro_f1", "macro_f1")


@query
def eval_multilabel_f1_by_split(spark, folder):
    """The same metric for every split in one pass."""
    rows = scored_labels(spark, folder).withColumn("split", views.split_column())
    scores = evaluation.multilabel_f1(rows, "labels", "scores", LABELS, by=["split"])
    return rounded(scores, "micro_f1", "macro_f1")


@query
def eval_label_confusion(spark, folder):
    """TP, FP, FN and F1 per label, the zero class included."""
    ids = scored_labels(spark, folder).select(
        L.zero_class_ids(L.label_ids(F.col("labels"), LABELS), LABELS).alias("gold"),
        L.zero_class_ids(L.positive_ids(F.col("scores")), LABELS).alias("pred"),
    )
    return rounded(evaluation.label_confusion(ids, "gold", "pred", LABELS + 1), "f1")


@query
def eval_indicator_rows(spark, folder):
    """Multi-hot gold and thresholded predictions, both with the zero class appended."""
    return indicator_rows(spark, folder).select(
        "doc_id",
        listing(L.add_zero_class(F.col("gold"))).alias("gold"),
        listing(L.add_zero_class(F.col("pred"))).alias("pred"),
    )


@query
def eval_subset_accuracy(spark, folder):
    """Exact-match accuracy of the label vectors."""
    return rounded(evaluation.accuracy(indicator_rows(spark, folder), "gold", "pred"), "accuracy")


@query
def eval_alignment(spark, folder):
    """Examples found on both sides, only in gold, only in the predictions."""
    return evaluation.alignment_report(
        views.multilabel_gold(spark, folder), views.multilabel_scores(spark, folder), "doc_id"
    )


@query
def eval_multiclass_f1(spark, folder):
    rows = views.multiclass(spark, folder).withColumn("pred", L.argmax(F.col("scores")))
    return rounded(evaluation.multiclass_f1(rows, "label", "pred"), "micro_f1", "macro_f1")


@query
def eval_multiclass_counts(spark, folder):
    """TP, FP, FN per class in gold or predictions."""
    rows = views.multiclass(spark, folder).withColumn("pred", L.argmax(F.col("scores")))
    return evaluation.class_counts(rows, "label", "pred")


@query
def eval_metrics_long(spark, folder):
    """Registered metrics as (metric, value) rows."""
    rows = views.multiclass(spark, folder).withColumn("pred", L.argmax(F.col("scores")))
    both = evaluation.evaluate(rows, "multiclass_f1", gold="label", pred="pred").unionByName(
        evaluation.evaluate(rows, "accuracy", gold="label", pred="pred")
    )
    return rounded(both, "value")


def choice_scores(spark: SparkSession, folder: str) -> DataFrame:
    """One score per (example, choice)."""
    pairs = views.choice(spark, folder).select("doc_id", "label", F.posexplode("endings").alias("choice", "ending"))
    score = (F.length("ending") * (F.col("choice") + 3) + F.col("doc_id") * 13) % 101
    return pairs.select("doc_id", "label", "choice", (score.cast("double") / 8).alias("score"))


@query
def eval_choice_argmax(spark, folder):
    """Choices scored one per row, regrouped, the first best one picked."""
    scores = pooling.regroup_choices(choice_scores(spark, folder), "doc_id", "choice", "score")
    gold = views.table(spark, folder, "documents").select("doc_id", views.choice_label().alias("label"))
    picked = evaluation.align(gold, scores, "doc_id", True).withColumn("predicted", L.argmax(F.col("scores")))
    return picked.select("doc_id", "label", "predicted")


@query
def eval_bce_loss(spark, folder):
    return rounded(losses.mean_bce(indicator_rows(spark, folder), "scores", "gold"), "loss")


@query
def eval_ce_loss(spark, folder):
    """Softmax cross entropy; the last class plays the unlabelled rows (-1), which are ignored."""
    label = F.when(F.col("label") == 3, -1).otherwise(F.col("label"))
    rows = views.multiclass(spark, folder).withColumn("label", label)
    return rounded(losses.mean_ce(rows, "scores", "label"), "loss")


@query
def eval_soft_ce_loss(spark, folder):
    """Cross entropy against a smoothed gold distribution."""
    soft = F.transform(L.multi_hot(F.array("label"), 4), lambda y: F.when(y == 1, 0.7).otherwise(0.1))
    rows = views.multiclass(spark, folder).withColumn("soft", soft)
    return rounded(losses.mean_soft_ce(rows, "scores", "soft"), "loss")


@query
def eval_mse_loss(spark, folder):
    """Squared error of the first score against the class number."""
    rows = views.multiclass(spark, folder).withColumn("score", V.first_element(F.col("scores")))
    return rounded(losses.mean_squared_error(rows, "score", "label"), "loss")


@query
def zero_class_docs(spark, folder):
    """Documents that no label applies to."""
    labelled = views.multilabel_gold(spark, folder).where(F.size("labels") > 0)
    return curation.unlabelled(views.table(spark, folder, "documents").select("doc_id"), labelled, ["doc_id"])


@query
def label_validation(spark, folder):
    """Rows with known and unknown labels when only three classes are declared."""
    known = L.is_known_label(F.col("label"), 3)
    return views.multiclass(spark, folder).agg(F.count_if(known).alias("known"), F.count_if(~known).alias("unknown"))


@query
def predictions_tsv(spark, folder):
    return evaluation.prediction_lines(scored_labels(spark, folder), "doc_id", "scores")


# --- curation ----------------------------------------------------------------


def top_brands(spark: SparkSession, folder: str) -> DataFrame:
    return curation.top_labels(views.orders_brands(spark, folder), "labels", TOP_LABELS)


def single_label_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The labelled orders are written once: counting and filtering both read them."""
    rows = cache.spool(views.orders_brands(spark, folder))
    return curation.keep_single_label(rows, "labels", curation.top_labels(rows, "labels", TOP_LABELS))


@query
def curate_label_counts(spark, folder):
    return curation.label_counts(views.orders_brands(spark, folder), "labels")


@query
def curate_top_labels(spark, folder):
    return top_brands(spark, folder)


@query
def curate_label_pairs(spark, folder):
    """(order, label) pairs of the top labels."""
    rows = cache.spool(views.orders_brands(spark, folder))
    top = curation.top_labels(rows, "labels", TOP_LABELS)
    return curation.rows_with_labels(rows, "labels", "o_orderkey", top)


@query
def curate_single_label(spark, folder):
    """Orders with exactly one top label."""
    rows = single_label_rows(spark, folder)
    return rows.select("o_orderkey", F.element_at("labels", 1).alias("label"), "year")


@query
def curate_year_sample_split(spark, folder):
    """A fixed-size sample per year, years mapped to splits."""
    rows = cache.spool(single_label_rows(spark, folder))
    sampled = sampling.sample_per_group(rows, "year", YEAR_SAMPLES, "o_orderkey")
    tagged = sampled.withColumn("split", curation.canonical_split(curation.split_by_value("year", YEAR_SPLITS)))
    return tagged.select("o_orderkey", F.element_at("labels", 1).alias("label"), "year", "split")


@query
def curate_chrono_group_split(spark, folder):
    """Every sentence with its company's year and chronological split."""
    groups = curation.chronological_splits(
        cache.spool(views.companies(spark, folder)), ["year", "company"], N_TRAIN_GROUPS, N_VALIDATION_GROUPS
    )
    rows = views.sentences(spark, folder)
    joined = lookup_join(rows, groups, "company", spread_by=["doc_id", "line_no"])
    return joined.select("company", "doc_id", "line_no", "text", F.col("year").alias("release_year"), "split")


KEYS = ["company", "doc_id", "line_no"]


@query
def curate_positional_labels(spark, folder):
    """Sentences with the clause labels found at the same line of the annotation files."""
    rows = curation.label_lists(views.sentences(spark, folder), views.annotations(spark, folder), KEYS)
    return rows.select(*KEYS, "text", F.array_join("labels", "|").alias("labels"))


@query
def curate_annotation_counts(spark, folder):
    return curation.annotation_summary(
        views.sentences(spark, folder).select(*KEYS), views.annotations(spark, folder), KEYS
    )


@query
def curate_wellformed_lines(spark, folder):
    lines = views.raw_lines(spark, folder)
    return lines.where(curation.well_formed(F.col("value")) & curation.not_overlong(F.col("value")))


@query
def curate_first_year(spark, folder):
    """First year each company mentions; some lines get one appended, since few texts hold any."""
    text = F.expr(
        "case when (doc_id+line_no)%9=0 then concat(text,' ',cast(2000+doc_id%23 as string)) else text end"
    )
    lines = views.sentences(spark, folder).withColumn("text", text)
    return curation.first_years(lines, "company", ["doc_id", "line_no"], "text")


@query
def curate_brackets(spark, folder):
    """Bracket escapes, put in first where the text says ``the``, become brackets."""
    escaped = F.replace("text", F.lit("the"), F.lit("-lrb-the-rrb-"))
    return views.sentences(spark, folder).select(*KEYS, T.unescape_brackets(escaped).alias("text"))


@query
def curate_dataset_card(spark, folder):
    """Split sizes and class counts of each task."""
    return curation.dataset_card(views.tasks(spark, folder))


# --- text --------------------------------------------------------------------


@query
def text_first_n_words(spark, folder):
    """First words, all words but the last, and the word count."""
    docs = views.documents(spark, folder)
    return docs.select(
        "doc_id",
        T.first_words(F.col("text"), FIRST_WORDS).alias("head"),
        T.first_words(F.col("text"), -1).alias("all_but_last"),
        T.word_count(F.col("text")).alias("n_words"),
        F.length("text").alias("n_chars"),
    )


def segments_of(column: str = "text") -> Column:
    return T.clip_segments(T.paragraphs(F.col(column), SEGMENT_PATTERN), SEGMENTS)


@query
def text_segments(spark, folder):
    """The first segments of each document, one row each."""
    docs = views.documents(spark, folder).select("doc_id", segments_of().alias("segments"))
    return unroll(docs, ["doc_id"], "segments", "segment", "text")


@query
def text_long_document(spark, folder):
    docs = views.documents(spark, folder)
    whole = T.long_document(T.paragraphs(F.col("text"), SEGMENT_PATTERN), "[SEP]", SEGMENTS, SEGMENT_WORDS)
    return docs.select("doc_id", whole.alias("text"))


@query
def text_joined_segments(spark, folder):
    """All segments of a document joined with a blank."""
    docs = views.documents(spark, folder)
    return docs.select("doc_id", T.join_segments(T.paragraphs(F.col("text"), SEGMENT_PATTERN)).alias("text"))


def documents_with_terms(spark: SparkSession, folder: str) -> DataFrame:
    return views.documents(spark, folder).select("doc_id", "text", T.terms(F.col("text")).alias("tokens"))


@query
def text_pad_mask(spark, folder):
    """Token ids of a document in a fixed length, with attention and global-attention masks."""
    docs = documents_with_terms(spark, folder)
    vocabulary = encoding.token_vocabulary(docs, "tokens", TOKEN_VOCABULARY)
    cut = F.array(F.slice("tokens", 1, SEQUENCE))
    ids = encoding.encode_rows(docs, "doc_id", cut, vocabulary).select("doc_id", F.get("rows", 0).alias("ids"))
    return ids.select(
        "doc_id",
        listing(S.pad(F.col("ids"), SEQUENCE)).alias("input_ids"),
        listing(S.attention_mask(F.col("ids"), SEQUENCE)).alias("attention_mask"),
        listing(S.global_attention(SEQUENCE)).alias("global_attention_mask"),
    )


@query
def text_segment_matrix(spark, folder):
    """Token ids as a segments x tokens matrix, one row per segment with its position."""
    docs = documents_with_terms(spark, folder)
    vocabulary = encoding.token_vocabulary(docs, "tokens", TOKEN_VOCABULARY)
    segments = F.transform(segments_of(), lambda s: F.slice(T.terms(s), 1, SEGMENT_WORDS))
    rows = encoding.encode_rows(docs, "doc_id", segments, vocabulary)
    matrix = rows.select("doc_id", S.pad_matrix(F.col("rows"), SEGMENTS, SEGMENT_WORDS).alias("matrix"))
    slots = F.arrays_zip(S.segment_positions(F.col("matrix")).alias("position"), F.col("matrix").alias("ids"))
    return matrix.select("doc_id", F.posexplode(slots).alias("segment", "slot")).select(
        "doc_id", "segment", "slot.position", listing(F.col("slot.ids")).alias("input_ids")
    )


@query
def text_pair_truncate(spark, folder):
    """Context and choice cut to a common budget, with token types."""
    counted = views.choice(spark, folder).select(
        "doc_id",
        T.word_count(F.col("context")).alias("a"),
        F.transform("endings", lambda e: T.word_count(e)).alias("counts"),
    )
    pairs = unroll(counted, ["doc_id", "a"], "counts", "choice", "b")
    kept = pairs.select("doc_id", "choice", S.pair_lengths(F.col("a"), F.col("b"), PAIR_BUDGET).alias("kept"))
    return kept.select(
        "doc_id",
        "choice",
        F.col("kept.first").alias("context_words"),
        F.col("kept.second").alias("choice_words"),
        listing(S.token_types(F.col("kept.first"), F.col("kept.second"), PAIR_BUDGET)).alias("token_types"),
    )


@query
def text_pair_length_stats(spark, folder):
    """Mean and median words of ``context + ' ' + choice`` over all pairs."""
    # the blank between them keeps words apart, so the counts of both parts add up
    counted = views.choice(spark, folder).select(
        T.word_count(F.col("context")).alias("a"), F.transform("endings", lambda e: T.word_count(e)).alias("counts")
    )
    pairs = unroll(counted, ["a"], "counts", "choice", "b")
    n_words = F.col("a") + F.col("b")
    stats = pairs.agg(
        F.count("*").alias("n_pairs"), F.avg(n_words).alias("mean_words"), F.median(n_words).alias("median_words")
    )
    return rounded(stats, "mean_words")


@query
def text_identifiers(spark, folder):
    """File stem, camel-case identifier and upper-case form of page addresses."""
    pages = views.table(spark, folder, "pages")
    return pages.select(
        "page_id",
        T.file_stem(F.col("url")).alias("stem"),
        T.camel_identifier(F.col("url")).alias("identifier"),
        F.upper("url").alias("heading"),
    )


def count_words(batch: pd.DataFrame) -> pd.DataFrame:
    """Stand-in for a user's tokenizer."""
    tokens = batch["text"].str.split()
    return pd.DataFrame({"n_tokens": tokens.str.len(), "last_token": tokens.str[-1].fillna("")})


@query
def text_batched_map(spark, folder):
    """A user's batch function over all documents."""
    docs = views.documents(spark, folder).select("doc_id", "text")
    return hooks.map_batches(docs, count_words, "n_tokens bigint, last_token string").drop("text")


# --- features ----------------------------------------------------------------


def documents_with_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, tokens), stored: every later count reads the terms, not the text."""
    docs = tfidf.with_tokens(views.documents(spark, folder).select("doc_id", "text"), "text")
    return cache.spool(docs.select("doc_id", "tokens"))


@query
def tfidf_ngram_counts(spark, folder):
    """Terms and distinct terms (1- to 3-grams) per document."""
    docs = tfidf.with_ngrams(documents_with_tokens(spark, folder))
    return docs.select(
        "doc_id", F.size("terms").alias("n_terms"), F.size(F.array_distinct("terms")).alias("n_distinct")
    )


@query
def tfidf_vocabulary(spark, folder):
    return tfidf.vocabulary(documents_with_tokens(spark, folder), MAX_FEATURES).select("index", "term", "tf", "df")


@query
def tfidf_idf(spark, folder):
    vocabulary = tfidf.vocabulary(documents_with_tokens(spark, folder), MAX_FEATURES)
    return rounded(vocabulary.select("term", "idf"), "idf")


@query
def tfidf_weights(spark, folder):
    """L2-normalised weights of every document."""
    weights = tfidf.term_weights(documents_with_tokens(spark, folder), "doc_id", MAX_FEATURES)
    return rounded(weights, "weight")


# --- linear baselines ----------------------------------------------------------

#: Grid of the score table that ``svm_best_point`` shares with its SQL; the searches run over ``svm.grid()``.
SVM_GRID = svm.grid(sizes=SVM_VOCABULARY_SIZES, losses=svm.LOSSES[:1])


def language_rows(spark: SparkSession, folder: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in views.LANGUAGES])
    return views.documents(spark, folder).select(
        "doc_id",
        "text",
        views.split_column().alias("split"),
        (F.array_position(names, F.col("lang")) - 1).cast("int").alias("label"),
    )


def choice_features(spark: SparkSession, folder: str, sizes: Iterable[int]) -> dict[int, DataFrame]:
    """Features of the choice task by vocabulary size; its rows are made and their terms counted once."""
    rows = svm.choice_columns(views.choice(spark, folder)).withColumn("split", views.split_column())
    columns = ["context", *[f"option_{i}" for i in range(1, views.N_ENDINGS + 1)]]
    features = svm.Features(rows, columns, sizes, tfidf.MIN_DOCUMENTS, True)
    return {size: features(size) for size in sizes}


@query
def svm_multiclass_grid(spark, folder):
    """Language from text: the best point of the validation split, mean and deviation over the seeds."""
    rows = language_rows(spark, folder).withColumn("positives", F.array("label"))
    return svm.search_and_rate(
        svm.grid(),
        svm.Features(rows, ["text"], svm.VOCABULARY_SIZES, tfidf.MIN_DOCUMENTS, False),
        "positives",
        len(views.LANGUAGES),
        False,
        "doc_id",
        SEEDS,
        SVM_TRAIN_SHARE,
    )


@query
def svm_multilabel(spark, folder):
    """Quality and toxicity from text: one machine per label, searched, seeded, scored with the zero class."""
    rows = cache.spool(
        evaluation.align(
            views.multilabel_gold(spark, folder), views.documents(spark, folder).select("doc_id", "text"), "doc_id", True
        ).withColumn("split", views.split_column())
    )
    return svm.search_and_rate(
        svm.grid(),
        svm.Features(rows, ["text"], svm.VOCABULARY_SIZES, tfidf.MIN_DOCUMENTS, False),
        "labels",
        LABELS,
        True,
        "doc_id",
        SEEDS,
        SVM_TRAIN_SHARE,
    )


@query
def svm_choice(spark, folder):
    """Choice from six TF-IDF blocks, the context and each of the five options: penalty and loss searched, seeded."""
    prepared = choice_features(spark, folder, [svm.CHOICE_VOCABULARY])[svm.CHOICE_VOCABULARY]
    prepared = prepared.withColumn("positives", F.array("label"))
    return svm.search_and_rate(
        svm.grid(sizes=(svm.CHOICE_VOCABULARY,)),
        lambda size: prepared,
        "positives",
        views.N_ENDINGS,
        False,
        "doc_id",
        SEEDS,
        SVM_TRAIN_SHARE,
    )


@query
def svm_choice_predictions(spark, folder):
    """Choice of every held-out row, by a stored model and a prediction file; the marks of the endings tell it."""
    prepared = choice_features(spark, folder, [svm.CHOICE_VOCABULARY])[svm.CHOICE_VOCABULARY]
    prepared = prepared.withColumn("positives", F.array("label"))
    train = prepared.where("split = 'train'")
    model, lines = fresh(spark, "model"), fresh(spark, "predictions.tsv")
    linear.store(spark, linear.fit(train, "positives", views.N_ENDINGS, [linear.Setting(10.0)]), model)
    held_out = prepared.where("split <> 'train'").select("doc_id", "features")
    scored = linear.score(held_out, linear.load(spark, model)).withColumn("scores", F.get("all_scores", 0))
    writers.write_lines(evaluation.prediction_lines(scored, "doc_id", "scores"), "line", lines)
    cells = F.split("value", "\t")
    scores = F.slice(cells, 2, views.N_ENDINGS).cast("array<double>")
    read = readers.read_lines(spark, lines).select(F.get(cells, 0).cast("bigint").alias("doc_id"), scores.alias("scores"))
    return read.select("doc_id", views.split_column().alias("split"), L.argmax(F.col("scores")).alias("predicted"))


@query
def svm_choice_classes(spark, folder):
    """Rows of each class in each split of the choice task."""
    rows = views.table(spark, folder, "documents").select(views.split_column().alias("split"), views.choice_label().alias("label"))
    return rows.groupBy("split", "label").agg(F.count("*").alias("n"))


def grid_runs(spark: SparkSession, folder: str) -> DataFrame:
    """A table of validation scores by grid point, from order lines."""
    sums = views.table(spark, folder, "lineitem").groupBy((F.col("l_partkey") % len(SVM_GRID)).cast("int").alias("grid_index"))
    return sums.agg(((F.sum(F.floor("l_quantity")).cast("bigint") % 3).cast("double") / 4).alias("score"))


@query
def svm_best_point(spark, folder):
    """The grid point of the highest score, the first of equals."""
    return svm.best_point(grid_runs(spark, folder)).select("grid_index", "score")


@query
def svm_over_seeds(spark, folder):
    """Mean and deviation over the seeds of a score table, by model and task."""
    runs = views.all_runs(spark, folder).select(
        F.concat_ws("-", F.col("model").cast("string"), F.col("task").cast("string")).alias("split"),
        "seed",
        F.col("predict_micro_f1").alias("micro_f1"),
        F.col("predict_macro_f1").alias("macro_f1"),
    )
    return rounded(svm.over_seeds(runs), "micro_f1_mean", "micro_f1_std", "macro_f1_mean", "macro_f1_std")


@query
def svm_features(spark, folder):
    """Weights of held-out documents: vocabulary and idf of the train rows only."""
    docs = documents_with_tokens(spark, folder).withColumn("split", views.split_column())
    weights = tfidf.term_weights(docs.where("split <> 'train'"), "doc_id", MAX_FEATURES, fit_on=docs.where("split = 'train'"))
    return rounded(weights, "weight")


# --- vectors -----------------------------------------------------------------


@query
def vec_max_pool(spark, folder):
    """Element-wise maximum of the vectors of each label, one row per dimension."""
    pooled = pooling.max_pool(views.table(spark, folder, "embeddings"), "label", "embedding")
    return pooled.select("label", F.posexplode("embedding").alias("dim", "x")).withColumn(
        "x", F.round(F.col("x").cast("double"), 6)
    )


@query
def vec_position_encode(spark, folder):
    """Vectors as segments at position id mod 65: position code added, padding (0) left as it is."""
    dim = 64
    vectors = views.table(spark, folder, "embeddings").select(
        "vec_id", (F.col("vec_id") % 65).cast("int").alias("position"), "embedding"
    )
    encoded = V.add_position(F.col("embedding"), F.col("position"), dim)
    return vectors.select("vec_id", "position", F.posexplode(encoded).alias("dim", "x")).withColumn(
        "x", F.round("x", 6)
    )


# --- leaderboard ---------------------------------------------------------------


def complete(spark: SparkSession, folder: str) -> DataFrame:
    return readers.complete_runs(views.all_runs(spark, folder))


@query
def board_topk_seeds(spark, folder):
    """The best seeds per (model, task) by dev macro-F1."""
    return leaderboard.top_seeds(complete(spark, folder), TOP_SEEDS)


@query
def board_seed_summary(spark, folder):
    """Mean and deviation of every score over seeds."""
    summary = leaderboard.seed_summary(complete(spark, folder))
    return rounded(summary, *[c for c in summary.columns if c.endswith(("_mean", "_std"))])


@query
def board_dev_topk_test_best(spark, folder):
    summary = leaderboard.dev_topk_test_best(complete(spark, folder), TOP_SEEDS)
    return rounded(summary, *summary.columns[2:])


def board_scores(spark: SparkSession, folder: str) -> DataFrame:
    expected = leaderboard.expected_pairs(spark, MODELS, TASKS)
    return leaderboard.task_scores(expected, complete(spark, folder))


@query
def board_means(spark, folder):
    """Arithmetic, harmonic and geometric mean over tasks per model."""
    return rounded(
        leaderboard.mean_scores(board_scores(spark, folder)), "arithmetic", "harmonic", "geometric"
    )


def display_names(spark: SparkSession) -> DataFrame:
    """Display names of the models; models 1 and 7 share one."""
    name = F.concat(F.lit("model-"), F.when(F.col("model") == 7, 1).otherwise(F.col("model")).cast("string"))
    return spark.range(1).select(leaderboard.one_of(MODELS).alias("model")).withColumn("name", name)


@query
def board_pivot(spark, folder):
    """One row per model, one cell of test scores per task."""
    table = leaderboard.score_table(board_scores(spark, folder), TASKS)
    named = leaderboard.with_display_name(table, display_names(spark))
    return named.withColumnsRenamed({str(t): f"task_{t}" for t in TASKS})


@query
def board_table_lines(spark, folder):
    """The same table as HTML rows."""
    table = leaderboard.score_table(board_scores(spark, folder), TASKS)
    named = leaderboard.with_display_name(table, display_names(spark))
    return leaderboard.table_lines(named, "name", [str(t) for t in TASKS]).select("model", "line")


@query
def board_report_lines(spark, folder):
    """One formatted line per run."""
    return leaderboard.run_lines(complete(spark, folder)).select("model", "task", "seed", "line")


@query
def board_summary_lines(spark, folder):
    """One formatted line per (model, task)."""
    summary = leaderboard.dev_topk_test_best(complete(spark, folder), TOP_SEEDS)
    return leaderboard.summary_lines(rounded(summary, *summary.columns[2:])).select("model", "task", "line")


@query
def board_missing_runs(spark, folder):
    expected = leaderboard.expected_runs(spark, MODELS, TASKS, SEEDS)
    return leaderboard.missing_runs(expected, complete(spark, folder))


@query
def board_train_time(spark, folder):
    """Training time per (task, model) from the last entry of each log."""
    times = leaderboard.train_time(readers.last_log_entry(views.train_logs(spark, folder)))
    numbers = ["runtime", "time_per_epoch", "epochs_mean", "epochs_std"]
    lines = leaderboard.train_time_lines(rounded(times, *numbers))
    return leaderboard.task_headings(lines).select("heading", "model", *numbers, "line")


@query
def log_early_stop(spark, folder):
    epochs = views.epoch_metrics(spark, folder)
    return training_log.early_stop(epochs, ["task", "model", "seed"], "epoch", "metric", PATIENCE)


@query
def log_best_epoch(spark, folder):
    epochs = views.epoch_metrics(spark, folder)
    return training_log.best_epoch(epochs, ["task", "model", "seed"], "epoch", "metric", PATIENCE)


# --- samples -------------------------------------------------------------------


@query
def sample_first_n(spark, folder):
    """The first rows by id, the cap on training examples."""
    return sampling.first_rows(views.table(spark, folder, "documents"), CAP, "doc_id").select("doc_id", "text")


@query
def sample_preview(spark, folder):
    """The first two feature rows."""
    return sampling.first_rows(views.table(spark, folder, "documents"), 2, "doc_id").select(
        "doc_id", T.word_count(F.col("text")).alias("n_words")
    )


@query
def sample_spot_check(spark, folder):
    """Three random rows."""
    return sampling.spot_check(views.table(spark, folder, "documents"), "doc_id").select("doc_id", "text")


@query
def sample_counts(spark, folder):
    """Rows per split and how many a cap would use."""
    docs = views.table(spark, folder, "documents").withColumn("split", views.split_column())
    return sampling.effective_counts(docs, "split", CAP)


# --- files -----------------------------------------------------------------------


def fresh(spark: SparkSession, name: str) -> str:
    return f"{cache.new_folder(spark)}/{name}"


@query
def io_split_json(spark, folder):
    """The curated sample written as JSON lines per split and read back with a schema."""
    path = fresh(spark, "curated.jsonl")
    rows = cache.spool(single_label_rows(spark, folder))
    sampled = sampling.sample_per_group(rows, "year", YEAR_SAMPLES, "o_orderkey")
    tagged = sampled.withColumn("split", curation.split_by_value("year", YEAR_SPLITS))
    writers.write_split_json(tagged, path)
    back = readers.read_jsonl(spark, path, tagged.schema)
    return back.select(
        "o_orderkey",
        F.element_at("labels", 1).alias("label"),
        "year",
        curation.canonical_split(F.col("split")).alias("split"),
    )


@query
def io_task_split(spark, folder):
    """A task table written per split; only its ``dev`` (= validation) folder is read."""
    path = fresh(spark, "tasks")
    rows = views.table(spark, folder, "documents").select(
        "text",
        (F.col("doc_id") % 14).cast("int").alias("label"),
        views.split_column().alias("split"),
    )
    writers.write_task(rows, path, "scotus")
    return readers.load_task(spark, path, "scotus", "dev")


def quoted(text: Column) -> Column:
    line = F.regexp_replace(text, r"[\r\n]+", " ")
    return F.concat(F.lit('"'), F.replace(line, F.lit('"'), F.lit('""')), F.lit('"'))


@query
def io_choice_csv(spark, folder):
    """Choice records as raw CSV lines, filtered as lines, then parsed and counted."""
    cells = F.concat_ws(
        ",", F.col("doc_id").cast("string"), quoted(F.col("context")),
        F.array_join(F.transform("endings", quoted), ","), F.col("label").cast("string"),
    )
    raw = fresh(spark, "raw.csv")
    fixed = fresh(spark, "fixed.csv")
    writers.write_lines(views.choice(spark, folder).select(cells.alias("value")), "value", raw)
    lines = readers.read_lines(spark, raw)
    kept = lines.where(curation.well_formed(F.col("value")) & curation.not_overlong(F.col("value")))
    writers.write_lines(kept, "value", fixed)
    records = readers.read_choice_csv(spark, fixed, header=False)
    options = F.array(*[F.col(f"option_{i}") for i in range(1, 6)])
    pairs = records.select(
        F.col("record_id").cast("bigint").alias("doc_id"), "context", F.posexplode(options).alias("choice", "ending")
    )
    return pairs.select(
        "doc_id", "choice", T.word_count(T.pair_text(F.col("context"), F.col("ending"))).alias("n_words")
    )


@query
def io_json_records(spark, folder):
    """Each curated order as one JSON record."""
    return writers.encode_records(views.orders_brands(spark, folder).select("o_orderkey", "labels", "year"))


@query
def io_run_tree(spark, folder):
    """A tree of run results, written in one job and read back without its broken and partial files."""
    names = {m: m.replace("_f1", "-f1") for m in readers.METRICS}
    whole = F.to_json(F.struct(*[F.col(m).alias(n) for m, n in names.items()]))
    broken = (F.col("model") + F.col("task") + F.col("seed")) % 9 == 0
    runs = views.all_runs(spark, folder).withColumn("value", F.when(broken, F.substring(whole, 1, 20)).otherwise(whole))
    root = fresh(spark, "runs")
    writers.write_run_files(runs, "value", root, "all_results.json")
    return readers.read_runs(spark, root).select("task", "model", "seed", *readers.METRICS)


@query
def io_train_logs(spark, folder):
    """Trainer states, written in one job and read back: epochs and runtime of the last entry."""
    logs = views.train_logs(spark, folder).withColumn("value", F.to_json(F.struct("log_history")))
    root = fresh(spark, "states")
    writers.write_run_files(logs, "value", root, "trainer_state.json")
    return readers.read_train_logs(spark, root)


@query
def io_feature_cache(spark, folder):
    """Words per document, built once; a second call under the key reads what is stored."""
    built = views.table(spark, folder, "documents").select("doc_id", T.word_count(F.col("text")).alias("n_words"))
    key = f"{cache.feature_key(built, feature='words')}/{uuid.uuid4().hex}"
    cache.materialize(built, key)
    # had this call built, it would return no row
    return cache.materialize(built.limit(0), key)


def file_name(id_column: str, n_rows: int, rows_per_file: int = 500) -> Column:
    """Name of the file a row goes to, of as many as give each about ``rows_per_file``."""
    return F.concat(F.lit("part"), F.pmod(F.xxhash64(id_column), F.lit(n_rows // rows_per_file + 1)))


@query
def io_content_cache(spark, folder):
    """Words per document, kept by the content of its files: those replaced under the same name are read anew."""
    docs = views.table(spark, folder, "documents")
    path = fresh(spark, "texts")
    files = docs.select(
        file_name("doc_id", docs.count()).alias("key"),
        F.concat_ws(" ", F.lit("words"), F.col("doc_id"), T.word_count(F.col("text"))).alias("text"),
        "doc_id",
    )
    # had the second call not built, its first words would be these
    for first in ("stale", "words"):
        lines = files.withColumn("text", F.regexp_replace("text", "^words", first))
        keyed_files.write_keyed_files(lines, path, order="doc_id", overwrite=True)
        words = F.split("value", " ")
        parsed = readers.read_lines(spark, f"{path}/*.txt").select(
            F.get(words, 0).alias("state"),
            F.get(words, 1).cast("bigint").alias("doc_id"),
            F.get(words, 2).cast("int").alias("n_words"),
        )
        built = cache.kept(parsed, feature="words")
    return built


@query
def io_guarded_output(spark, folder):
    """A published result and an attempt to write another in its place, which is refused."""
    path = fresh(spark, "published")
    rows = views.table(spark, folder, "documents").select("doc_id", T.word_count(F.col("text")).alias("n_words"))
    staging.publish(rows, path)
    try:
        staging.publish(rows.where("doc_id < 0"), path)
        refused = False
    except FileExistsError:
        refused = True
    return spark.read.schema(rows.schema).parquet(path).withColumn("refused", F.lit(refused))


@query
def io_keyed_lines(spark, folder):
    """One file per document, named by its id, written and read back with line numbers."""
    path = fresh(spark, "sentences")
    lines = views.sentences(spark, folder).withColumn("key", F.concat(F.lit("doc"), "doc_id"))
    keyed_files.write_keyed_files(lines.withColumn("text", F.replace("text", F.lit("\r"), F.lit(" "))), path)
    return readers.read_keyed_lines(spark, f"{path}/*.txt").select(
        "key", F.col("line_no").cast("int").alias("line_no"), F.length("text").alias("n_chars")
    )


@query
def io_annotation_sets(spark, folder):
    """Words of the benchmark items, one a line, with the clause names of eight parallel folders of 0/1 files."""
    path = fresh(spark, "tos")
    words = views.item_words(spark, folder).withColumn("item", F.concat(F.lit("item"), "item_id"))
    sets = [f"labels_{i}" for i in range(len(curation.CLAUSE_LABELS))]
    marks = words.select("*", F.posexplode(F.array(*[F.lit(s) for s in sets])).alias("label_type", "set")).select(
        F.concat_ws("/", "set", "item").alias("key"),
        "line_no",
        F.expr("if((item_id*5+line_no*3+label_type)%11=0, '1', '0')").alias("text"),
    )
    both = words.select(F.concat(F.lit("sentences/"), "item").alias("key"), "line_no", "text").unionByName(marks)
    keyed_files.write_keyed_files(both, path)
    lines = readers.read_keyed_lines(spark, f"{path}/sentences/*.txt")
    labelled = curation.label_lists(lines, readers.read_annotation_sets(spark, path, sets), ["key", "line_no"])
    return labelled.select(
        "key", F.col("line_no").cast("int").alias("line_no"), "text", F.array_join("labels", "|").alias("labels")
    )


@query
def io_run_ledger(spark, folder):
    """Every expected run: whether it counts and, if not, what is wrong with its file."""
    names = {m: m.replace("_f1", "-f1") for m in readers.METRICS}
    whole = F.to_json(F.struct(*[F.col(m).alias(n) for m, n in names.items()]))
    place = (F.col("model") + F.col("task") + F.col("seed")) % 9
    quotes = F.regexp_replace(whole, r'("predict_micro-f1":)([^,}]+)', '$1"$2"')
    value = F.when(place == 0, F.substring(whole, 1, 20)).when(place == 1, quotes).otherwise(whole)
    root = fresh(spark, "runs")
    runs = views.all_runs(spark, folder).where(place != 2).withColumn("value", value)
    writers.write_run_files(runs, "value", root, "all_results.json")
    audit = readers.audit_runs(spark, root, leaderboard.expected_runs(spark, MODELS, TASKS, SEEDS))
    return audit.select("task", "model", "seed", F.coalesce("reason", F.lit("counts")).alias("reason"))


@query
def io_headed_lines(spark, folder):
    """Line scan of many files that each begin with a header; quoted or broken lines stay as they are."""
    path = fresh(spark, "headed")
    rows = views.raw_lines(spark, folder)
    rows = rows.select(file_name("doc_id", rows.count()).alias("key"), "doc_id", "value")
    # the header sorts before the lines of its file
    header = rows.select("key").distinct().select("key", F.lit(None).cast("bigint").alias("doc_id"), F.lit("1,text,1").alias("value"))
    lines = rows.withColumn("value", F.regexp_replace("value", r"[\r\n]", " ")).unionByName(header)
    keyed_files.write_keyed_files(lines, path, order="doc_id", text="value", suffix=".csv")
    kept = readers.read_lines(spark, f"{path}/*.csv", skip_first=True)
    return kept.select(
        F.md5(F.encode("value", "utf-8")).alias("line_md5"), curation.well_formed(F.col("value")).alias("well_formed")
    )


@query
def io_drifted_json(spark, folder):
    """JSON lines of two layouts in two folders, read as one table without the columns that were to go."""
    docs = views.table(spark, folder, "documents").withColumn("split", views.split_column())
    path = fresh(spark, "drifted")
    old = docs.where("split <> 'train'").select("doc_id", "lang", "n_chars", F.length("text").alias("size"))
    new = docs.where("split = 'train'").select("doc_id", F.col("lang").alias("language"), "n_chars", F.lit("x").alias("note"))
    for name, rows in (("old", old), ("new", new)):
        rows.write.json(f"{path}/{name}")
    types = views.table(spark, folder, "documents").select("doc_id", F.lit(0).alias("size")).schema
    back = readers.read_drifted_json(spark, [f"{path}/old", f"{path}/new"], types, drop=["note", "absent"])
    return back.select("doc_id", F.coalesce("size", F.lit(-1)).alias("size"), "lang", "language", F.col("n_chars").alias("n_chars_text"))
