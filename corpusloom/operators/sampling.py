"""Deterministic samples: the order is the md5 of ``seed:id``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Hash prefix digits that make up a bucket: 16**4 = 65,536 buckets per group.
BUCKET_DIGITS = 4


def sample_key(seed: int, id_column: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")))


def sample_per_group(
    rows: DataFrame, group: str, sizes: dict[str, int], id_column: str, seed: int = 1
) -> DataFrame:
    """``sizes[g]`` rows of each group g without replacement; other groups are dropped.

    Sorting a whole group in one task would not hold for a group with a third of
    all rows. Instead the hash space is cut into buckets and rows are counted per
    (group, bucket); only the rows of the one bucket in which the wanted size is
    reached are ranked, which gives the largest hash still inside. The result is
    exactly the ``size`` smallest hashes, ties broken by id. Both counting and
    ranking read the group and the id only; the full rows are filtered once.
    """
    if not sizes:
        return rows.limit(0)
    wanted = F.create_map(*[F.lit(x) for item in sizes.items() for x in item])
    bucket = F.conv(F.substring("_key", 1, BUCKET_DIGITS), 16, 10).cast("int")
    keys = (
        rows.where(F.col(group).isin(*sizes))
        .select(group, F.col(id_column).alias("_id"), sample_key(seed, id_column).alias("_key"))
        .withColumn("_bucket", bucket)
    )
    # at most 65,536 counts per group, hence one cut per entry of ``sizes``
    earlier = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        keys.groupBy(group, "_bucket")
        .agg(F.count("*").alias("_rows"))
        .withColumn("_open", F.element_at(wanted, F.col(group)) - F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .where(F.col("_open") > 0)
        .groupBy(group)
        .agg(F.max("_bucket").alias("_bucket"), F.max_by("_open", "_bucket").alias("_open"))
    )
    rank = F.row_number().over(Window.partitionBy(group).orderBy("_key", "_id"))
    last_inside = (
        keys.join(F.broadcast(cuts), [group, "_bucket"])
        .withColumn("_rank", rank)
        .where(F.col("_rank") <= F.col("_open"))
        .groupBy(group)
        .agg(F.max(F.struct("_key", "_id")).alias("_last"))
    )
    return (
        rows.join(F.broadcast(last_inside), group)
        .where(F.struct(sample_key(seed, id_column), F.col(id_column)) <= F.col("_last"))
        .drop("_last")
    )


def first_rows(rows: DataFrame, n: int, id_column: str) -> DataFrame:
    """The ``n`` rows with the smallest ids."""
    return rows.orderBy(id_column).limit(n)


def spot_check(rows: DataFrame, id_column: str, n: int = 3, seed: int = 1) -> DataFrame:
    """A few rows to look at."""
    return rows.orderBy(sample_key(seed, id_column), id_column).limit(n)


def effective_counts(rows: DataFrame, split: str, cap: int | None) -> DataFrame:
    """Rows per split and how many of them a cap would use."""
    used = F.col("n_rows") if cap is None else F.least(F.lit(cap).cast("bigint"), F.col("n_rows"))
    return rows.groupBy(split).agg(F.count("*").alias("n_rows")).withColumn("n_used", used)
