"""Token ids from a corpus vocabulary, in fixed-length shapes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.arrays import unroll

UNKNOWN_ID = 1
FIRST_TERM_ID = 2
MAX_VOCABULARY = 1_000_000


def token_vocabulary(docs: DataFrame, tokens: str, size: int) -> DataFrame:
    """The ``size`` most frequent tokens as (token, token_id); ids follow frequency.

    Id 0 is padding and 1 stands for tokens outside the vocabulary.
    """
    top = (
        unroll(docs, [], tokens, "_i", "token")
        .groupBy("token")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "token")
        .limit(size)
    )
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "token"))
    return top.select("token", (rank + (FIRST_TERM_ID - 1)).alias("token_id"))


def encode_rows(docs: DataFrame, id_column: str, segments: Column, vocabulary: DataFrame) -> DataFrame:
    """(id, rows): per document the token ids of its segments, in order; null segments give null rows.

    The vocabulary travels with the job, at most ``MAX_VOCABULARY`` entries; a longer one
    is an error. Ids are looked up a batch at a time, so no token leaves its row and nothing
    is shuffled. A null segment counts as an empty one.
    """
    entries = vocabulary.select("token", "token_id").limit(MAX_VOCABULARY + 1).collect()
    if len(entries) > MAX_VOCABULARY:
        raise ValueError(f"a vocabulary to encode with has at most {MAX_VOCABULARY} entries")
    tokens, ids = [e["token"] for e in entries], [e["token_id"] for e in entries]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, numbers = pa.array(tokens, pa.string()), pa.array(ids, pa.int32())
        for batch in batches:
            outer = batch.column(1)
            inner = outer.values
            words = inner.values.cast(pa.string())
            found = numbers.take(pc.index_in(words, known)).fill_null(UNKNOWN_ID)
            rows = pa.ListArray.from_arrays(outer.offsets, pa.ListArray.from_arrays(inner.offsets, found))
            yield pa.RecordBatch.from_arrays([batch.column(0), rows, batch.column(2)], names=["id", "rows", "held"])

    empty = F.array().cast("array<string>")
    whole = F.transform(segments, lambda s: F.coalesce(s, empty))
    given = docs.select(
        F.col(id_column).alias("id"),
        F.coalesce(whole, F.array().cast("array<array<string>>")).alias("segments"),
        segments.isNotNull().alias("held"),
    )
    kind = docs.schema[id_column].dataType.simpleString()
    encoded = given.mapInArrow(encode, f"id {kind}, rows array<array<int>>, held boolean")
    return encoded.select(F.col("id").alias(id_column), F.when(F.col("held"), F.col("rows")).alias("rows"))
