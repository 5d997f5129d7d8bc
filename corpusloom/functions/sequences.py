"""Fixed-length id sequences: padding, masks and pair truncation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAD_ID = 0


def pad(ids: Column, length: int, value: int = PAD_ID) -> Column:
    """Cut to ``length`` items, then fill on the right."""
    kept = F.slice(ids, 1, length)
    return F.concat(kept, F.array_repeat(F.lit(value), F.lit(length) - F.size(kept)))


def attention_mask(ids: Column, length: int) -> Column:
    """1 for real items, 0 for padding."""
    real = F.least(F.size(ids), F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), real), F.array_repeat(F.lit(0), F.lit(length) - real))


def pad_matrix(rows: Column, max_rows: int, length: int) -> Column:
    """Segment rows padded to ``length``, followed by all-zero rows up to ``max_rows``."""
    kept = F.transform(F.slice(rows, 1, max_rows), lambda r: pad(r, length))
    blank = F.array_repeat(F.lit(PAD_ID), length)
    return F.concat(kept, F.array_repeat(blank, F.lit(max_rows) - F.size(kept)))


def segment_positions(matrix: Column) -> Column:
    """1-based position of each real segment, 0 for segments that are all padding."""

    def position(row: Column, i: Column) -> Column:
        total = F.aggregate(row, F.lit(0), lambda acc, x: acc + x)
        return F.when(total != 0, i + 1).otherwise(0)

    return F.transform(matrix, position)


def global_attention(length: int) -> Column:
    """1 for the first token, 0 for all others."""
    return F.concat(F.array(F.lit(1)), F.array_repeat(F.lit(0), length - 1))


def pair_lengths(first: Column, second: Column, budget: int) -> Column:
    """Lengths left after cutting the longer of two sequences until both fit.

    Closed form of removing one item at a time; on ties the second gives way.
    """
    total = F.lit(budget)
    small, large = budget // 2, budget - budget // 2
    kept_first = (
        F.when(first + second <= total, first)
        .when(first <= small, first)
        .when(second <= small, total - second)
        .otherwise(F.lit(large))
    )
    kept_second = (
        F.when(first + second <= total, second)
        .when(first <= small, total - first)
        .when(second <= small, second)
        .otherwise(F.lit(small))
    )
    return F.struct(kept_first.alias("first"), kept_second.alias("second"))


def token_types(first: Column, second: Column, length: int) -> Column:
    """0 for the first sequence, 1 for the second, 0 for padding."""
    return F.concat(
        F.array_repeat(F.lit(0), first),
        F.array_repeat(F.lit(1), second),
        F.array_repeat(F.lit(0), F.lit(length) - first - second),
    )
