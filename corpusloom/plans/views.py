"""Benchmark-shaped tables derived from the given ones.

Each view reads its whole source tables; nothing is filtered away to save work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.arrays import unroll
from corpusloom.operators.curation import CLAUSE_LABELS
from corpusloom.operators.lookups import lookup_join

LANGUAGES = ("de", "en", "es", "fr")
N_ENDINGS = 5
#: Words at the end of a gold ending and of the others; without them nothing would tell the choice.
GOLD_MARK, OTHER_MARK = "foregone conclusion reached", "unlikely outcome described"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text, ...) for work that is heavy per document.

    A table of many files is scanned by as many tasks and stays where it is. Only
    one with fewer scan tasks than cores is spread, by the key later steps group by.
    """
    docs = table(spark, folder, "documents")
    cores = spark.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < cores:
        docs = docs.repartition(cores, "doc_id")
    return docs


def draw(seed: str, id_column: str, n: int) -> Column:
    """A number from 0 to n - 1, told by a digest of seed and id, so draws of other seeds are unrelated."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % n).cast("int")


def choice_label(id_column: str = "doc_id") -> Column:
    """Place of the gold ending among a document's five."""
    return draw("gold", id_column, N_ENDINGS)


def split_column(id_column: str = "doc_id"):
    """A split for tables that come without one: 80 / 10 / 10 by a digest of the id."""
    place = draw("split", id_column, 10)
    return F.when(place < 8, "train").when(place == 8, "validation").otherwise("test")


def multilabel_gold(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, labels): label 0 = good quality, 1 = toxic; some documents have none."""
    marks = F.array(F.when(F.col("quality") == 1, F.lit(0)), F.when(F.col("toxic") == 1, F.lit(1)))
    return table(spark, folder, "labels").select("doc_id", F.array_compact(marks).alias("labels"))


def multilabel_scores(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, scores): two logits in steps of 1/40."""
    return table(spark, folder, "documents").select(
        "doc_id",
        F.expr(
            "array(cast((doc_id*37+n_chars*11)%200-90 as double)/40, cast((doc_id*53+n_chars*7)%200-120 as double)/40)"
        ).alias("scores"),
    )


def multiclass(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, label, scores): language as one of four classes."""
    docs = table(spark, folder, "documents")
    names = F.array(*[F.lit(x) for x in LANGUAGES])
    return docs.select(
        "doc_id",
        (F.array_position(names, F.col("lang")) - 1).cast("int").alias("label"),
        F.expr(
            "transform(sequence(0,3), k -> cast((doc_id*(31+7*k)+n_chars*(13+4*k))%100 as double)/40)"
        ).alias("scores"),
    )


def choice_items(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, k, item_id): the five benchmark passages each document is paired with."""
    n_items = table(spark, folder, "benchmark").agg(F.count("*")).scalar()
    slots = table(spark, folder, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(N_ENDINGS - 1))).alias("k"))
    return slots.select("doc_id", "k", ((F.col("doc_id") + F.col("k") * 7) % n_items).alias("item_id"))


def choice(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, context, endings, label): a document, five passages, the gold choice.

    The gold passage ends with one mark, the others with another.
    """
    items = table(spark, folder, "benchmark").select("item_id", F.col("text").alias("ending"))
    slots = lookup_join(choice_items(spark, folder), items, "item_id", spread_by=["doc_id", "k"])
    mark = F.when(F.col("k") == choice_label(), GOLD_MARK).otherwise(OTHER_MARK)
    slots = slots.withColumn("ending", F.concat_ws(" ", "ending", mark))
    ordered = F.sort_array(F.collect_list(F.struct("k", "ending")))
    endings = slots.groupBy("doc_id").agg(F.transform(ordered, lambda e: e["ending"]).alias("endings"))
    docs = documents(spark, folder).select("doc_id", F.col("text").alias("context"))
    return docs.join(endings, "doc_id").withColumn("label", choice_label())


def orders_brands(spark: SparkSession, folder: str) -> DataFrame:
    """(o_orderkey, labels, year): the brands of an order as its label list."""
    brands = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey")
    labels = (
        lookup_join(lines, brands, "l_partkey", spread_by=["l_orderkey"])
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.sort_array(F.collect_set("p_brand")).alias("labels"))
    )
    orders = table(spark, folder, "orders").select(
        "o_orderkey", F.year("o_orderdate").cast("string").alias("year")
    )
    return lookup_join(labels, orders, "o_orderkey")


def sentences(spark: SparkSession, folder: str) -> DataFrame:
    """(company, doc_id, line_no, text): the lines of each document."""
    docs = table(spark, folder, "documents").select(
        F.col("source").alias("company"), "doc_id", F.split("text", "\n").alias("lines")
    )
    return unroll(docs, ["company", "doc_id"], "lines", "line_no", "text")


def item_words(spark: SparkSession, folder: str) -> DataFrame:
    """(item_id, line_no, text): the words of each benchmark item, parted at blanks, one a line."""
    words = F.split(F.regexp_replace("text", r"[\r\n]", " "), " ")
    items = table(spark, folder, "benchmark").select("item_id", words.alias("words"))
    return unroll(items, ["item_id"], "words", "line_no", "text")


def annotations(spark: SparkSession, folder: str) -> DataFrame:
    """(company, doc_id, line_no, label_type, value): eight parallel 0/1 lines per sentence."""
    types = F.explode(F.sequence(F.lit(0), F.lit(len(CLAUSE_LABELS) - 1)))
    return (
        sentences(spark, folder)
        .select("company", "doc_id", "line_no", types.alias("label_type"))
        .withColumn(
            "value", F.expr("case when (doc_id*5+line_no*3+label_type)%11=0 then '1' else '0' end")
        )
    )


def companies(spark: SparkSession, folder: str) -> DataFrame:
    """(company, year): one row per source."""
    year = F.expr("cast(2006 + cast(substring(company,4) as int)%12 as string)")
    docs = table(spark, folder, "documents")
    return docs.select(F.col("source").alias("company")).distinct().withColumn("year", year)


def raw_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, value): CSV-like lines, some without a leading or trailing digit."""
    return table(spark, folder, "documents").select(
        "doc_id",
        F.expr(
            "concat(case when doc_id%7=0 then '' else cast(doc_id as string) end, ',', replace(text, '\\n', ' '), ',',"
            " case when doc_id%6=0 then 'x' else cast(doc_id%5 as string) end)"
        ).alias("value"),
    )


def all_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of 8 models x 7 tasks x 5 seeds; a run whose quantity sum divides by 11 lacks a score."""
    sums = (
        table(spark, folder, "lineitem")
        .groupBy(
            (F.col("l_suppkey") % 8).alias("model"),
            (F.col("l_partkey") % 7).alias("task"),
            ((F.col("l_linenumber") - 1) % 5 + 1).cast("int").alias("seed"),
        )
        .agg(
            F.sum(F.floor("l_quantity")).alias("q"),
            F.sum(F.floor("l_extendedprice")).alias("e"),
        )
    )
    return sums.select(
        "model",
        "task",
        "seed",
        F.when(F.col("q") % 11 != 0, F.expr("cast(q%1000 as double)/1000")).alias("eval_macro_f1"),
        F.expr("cast(e%997+1 as double)/1000").alias("predict_macro_f1"),
        F.expr("cast((q*7)%991 as double)/1000").alias("eval_micro_f1"),
        F.expr("cast((e*3)%983+1 as double)/1000").alias("predict_micro_f1"),
    )


def epoch_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """(task, model, seed, epoch, metric, runtime): one row per run and day of the month.

    The epoch is bounded by 31 whatever the number of events, and events are
    combined before any run is looked at as a whole.
    """
    cents = F.floor(F.col("value") * 100).cast("bigint")
    per_epoch = (
        table(spark, folder, "events")
        .groupBy(
            F.col("event_type").alias("task"),
            (F.col("user_id") % 7).alias("model"),
            (F.col("user_id") % 5 + 1).alias("seed"),
            F.dayofmonth("ts").alias("epoch"),
        )
        .agg(F.sum(cents).alias("c"))
    )
    return per_epoch.select(
        "task",
        "model",
        "seed",
        "epoch",
        (F.col("c") % 1000).cast("double").alias("_m"),
        (F.floor(F.col("c") / F.lit(100)) + 1).alias("runtime"),
    ).withColumn("metric", F.col("_m") / 1000).drop("_m")


def train_logs(spark: SparkSession, folder: str) -> DataFrame:
    """(task, model, seed, log_history): per run an ordered log of epoch and runtime so far."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("task", "model", "seed").orderBy("epoch")
    steps = epoch_metrics(spark, folder).select(
        "task",
        "model",
        "seed",
        F.row_number().over(order).cast("double").alias("epoch"),
        F.sum("runtime").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        .cast("double")
        .alias("train_runtime"),
    )
    entries = F.sort_array(F.collect_list(F.struct("epoch", "train_runtime")))
    return steps.groupBy("task", "model", "seed").agg(entries.alias("log_history"))


def tasks(spark: SparkSession, folder: str) -> DataFrame:
    """(task, split, labels) of the three derived tasks, one after the other."""
    two_labels = multilabel_gold(spark, folder).select(
        F.lit("multilabel").alias("task"), split_column().alias("split"), "labels"
    )
    languages = multiclass(spark, folder).select(
        F.lit("multiclass").alias("task"), split_column().alias("split"), F.array("label").alias("labels")
    )
    choices = table(spark, folder, "documents").select(
        F.lit("choice").alias("task"),
        split_column().alias("split"),
        F.array(choice_label()).alias("labels"),
    )
    return two_labels.unionByName(languages).unionByName(choices)
