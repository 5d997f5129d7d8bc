"""A pipeline from raw documents to packed sequences, in five stages.

Each stage takes all that the one before kept; all but the last return the columns of
``documents``. Between stages the rows are written as Parquet in the shared folder and
read again, so a lost executor costs a part of one stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontamination, jaccard_join, packing, quality_rules, toxicity
from corpusloom.llm.calibration import fold
from corpusloom.llm.queries import TOXIC, table
from corpusloom.operators.lookups import fits_broadcast
from corpusloom.session import shared_folder


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the fertility bands keep; null and empty texts go."""
    return quality_rules.judge(docs, "text").where("out.kept").select("row.*")


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays under the threshold.

    The model learns from the labelled ones among these documents, but for the fold
    that is held out; without labels all score alike and none goes.
    """
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, fold(F.col("key"), 3) != 1)
    return toxicity.score(docs, model, "text").where(F.col("out.score") < TOXIC).select("row.*")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row, of the document with the smallest id.

    Rows that repeat an id are one group, whatever their texts; the least of them by its
    columns in order stays. Rows whose id is null stay.
    """
    linked = jaccard_join.join(docs, "doc_id", "text")
    gone = linked.where("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(F.broadcast(gone) if fits_broadcast(gone) else gone, "doc_id", "left_anti").select(docs.columns)
    again = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return kept
    least = F.min(F.struct(*docs.columns)).alias("row")
    firsts = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(least).select("row.*")
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(firsts)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    found = decontamination.find(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("found") == 0).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2,048 tokens."""
    pieces = packing.cut(packing.tokenise(docs, "text", keep=["doc_id"]))
    packed = packing.pack(pieces.select("row.doc_id", "piece", "start", "length", "ids_crc32"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality rules", keep_quality),
    ("toxicity", keep_civil),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", keep_clean),
    ("best-fit packing", pack),
]

#: Language models and tokens are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpusloom/pipeline/{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        out = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
