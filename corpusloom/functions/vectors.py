"""Dense vectors held as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sinusoid(position: Column, i: Column, dim: int) -> Column:
    """Entry ``i`` of the position encoding; position 0 stands for padding and is zero."""
    angle = position / F.pow(F.lit(10000.0), 2 * i / F.lit(float(dim)))
    wave = F.when(i % 2 == 0, F.sin(angle)).otherwise(F.cos(angle))
    return F.when(position == 0, F.lit(0.0)).otherwise(wave)


def position_encoding(position: Column, dim: int) -> Column:
    """The whole encoding of one position."""
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: sinusoid(position, i, dim))


def add_position(vector: Column, position: Column, dim: int) -> Column:
    return F.transform(vector, lambda x, i: x.cast("double") + sinusoid(position, i, dim))


def first_element(items: Column) -> Column:
    """First-token pooling: the first entry of a sequence, null when it is empty."""
    return F.get(items, 0)
