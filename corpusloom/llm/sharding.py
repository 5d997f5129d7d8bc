"""Jump consistent hashing: a stable key and the number of shards give the shard.

No ring table is kept. With one shard more, a key either stays or moves into the new
shard, so only the necessary fraction of rows moves. Everything is expressions: the
64-bit state is two 32-bit halves, because products would overflow a signed long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.texts import column
from corpusloom.sources.cache import spool

# Fixed value: multiplier of the published method's 64-bit linear congruential generator.
MULTIPLIER = 2862933555777941757
HIGH, LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
LOW_HIGH, LOW_LOW = LOW >> 16, LOW & 0xFFFF
WORD = 0xFFFFFFFF
#: Jumps tried at first; n shards need about ln(n) of them, n at most.
FIRST_JUMPS = 64


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _times_low(x: Column) -> tuple[Column, Column]:
    """Halves of x * LOW for x below 2**32, the upper one not yet cut to 32 bits."""
    small, large = x * _long(LOW_LOW), x * _long(LOW_HIGH)
    lower = small + F.shiftleft(large.bitwiseAND(_long(0xFFFF)), 16)
    return lower, F.shiftright(large, 16)


def _step(state: Column, shards: int) -> Column:
    """One jump of (high, low, b, j), or the state itself once j has reached the shards."""
    high, low = state["high"], state["low"]
    lower, carry = _times_low(low)
    lower = lower + 1
    other_lower, _ = _times_low(high)
    upper = (
        carry
        + F.shiftright(lower, 32)
        + (low * _long(HIGH)).bitwiseAND(_long(WORD))
        + other_lower.bitwiseAND(_long(WORD))
    ).bitwiseAND(_long(WORD))
    jump = F.floor((state["j"] + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(upper, 1) + 1)))
    # a jump far beyond the shards ends the walk as well as one just beyond
    reach = F.least(jump, _long(shards)).cast("bigint")
    moved = F.struct(
        upper.alias("high"), lower.bitwiseAND(_long(WORD)).alias("low"), state["j"].alias("b"), reach.alias("j")
    )
    return F.when(state["j"] < shards, moved).otherwise(state)


def jump_hash(key: Column, shards: int) -> Column:
    """Shard 0 to ``shards - 1`` of a long key; a null key counts as 0."""
    if shards < 1:
        raise ValueError("at least one shard")
    k = F.coalesce(key.cast("bigint"), _long(0))
    start = F.struct(
        F.shiftrightunsigned(k, 32).alias("high"), k.bitwiseAND(_long(WORD)).alias("low"),
        _long(-1).alias("b"), _long(0).alias("j"),
    )

    def walk(state: Column, jumps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(jumps)), state, lambda s, _: _step(s, shards))

    state = walk(start, min(shards, FIRST_JUMPS))
    if shards > FIRST_JUMPS:
        # the rare key that is still on its way takes all the jumps there can be
        state = F.when(state["j"] < shards, walk(state, shards)).otherwise(state)
    return state["b"].cast("int")


def stable_key(df: DataFrame, key: str) -> Column:
    """A long for any key: whole numbers as they are, anything else by its 64-bit hash."""
    kind = df.schema[key].dataType
    whole = isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    return column(key).cast("bigint") if whole else F.xxhash64(column(key))


def assign(rows: DataFrame, key: str, shards: int, partitions: int | None = None) -> DataFrame:
    """The columns of ``rows`` with ``shard``, ``slot`` and ``grown_shard`` (with one shard more).

    Slots number a shard's rows from 0 without gaps, by key, then by the other
    columns' values. The rows are range-partitioned by key once and written with their
    partition; a partition's first slot in every shard follows from its counts, a small
    table, so no shard is ever in one task. Copies of one key beyond a partition's
    share are spread by their stored row number. Rows with a null key are one key's
    rows; repeated rows get a slot each; columns named like a result are replaced.
    """
    spark = rows.sparkSession
    names = [c for c in rows.columns if c not in ("shard", "slot", "grown_shard")]
    hashed = stable_key(rows, key)
    source = spool(
        rows.select(
            F.struct(*[column(c).alias(c) for c in names]).alias("_row"),
            hashed.alias("_key"),
            F.monotonically_increasing_id().alias("_rid"),
        )
    )
    order = [F.col("_row").getField(key), F.xxhash64(*[F.col("_row").getField(c) for c in names]), F.col("_rid")]
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = spool(
        source.select(
            "_row",
            jump_hash(F.col("_key"), shards).alias("shard"),
            jump_hash(F.col("_key"), shards + 1).alias("grown_shard"),
            *[o.alias(f"_o{i}") for i, o in enumerate(order)],
        )
        .repartitionByRange(n, "_o0", "_o1", "_o2")
        .withColumn("_part", F.spark_partition_id())
    )
    from pyspark.sql import Window

    counts = ranged.groupBy("_part", "shard").count()
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        "_part", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base")
    )
    within = Window.partitionBy("_part", "shard").orderBy("_o0", "_o1", "_o2")
    numbered = ranged.withColumn("_place", F.row_number().over(within).cast("bigint") - 1)
    # one row per partition and shard, as many as the caller's two numbers allow
    joined = numbered.join(bases, ["_part", "shard"])
    return joined.select(
        *[F.col("_row").getField(c).alias(c) for c in names],
        "shard",
        (F.col("_base") + F.col("_place")).alias("slot"),
        "grown_shard",
    )
