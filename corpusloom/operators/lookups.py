"""Joins against lookup tables whose size is checked before they are broadcast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 16


def row_bytes(table: DataFrame) -> Column:
    """Size of a row: the bytes of its strings, nested values as JSON, 16 for anything else."""
    total = F.lit(0).cast("bigint")
    for field in table.schema.fields:
        if isinstance(field.dataType, T.StringType):
            size = F.octet_length(field.name)
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size = F.octet_length(F.to_json(F.struct(field.name)))
        else:
            size = F.lit(0)
        total = total + F.coalesce(size, F.lit(0)) + 16
    return total


def fits_broadcast(
    table: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES
) -> bool:
    """True when the table has at most ``max_rows`` rows and ``max_bytes`` bytes.

    Only row sizes leave the scan, and no more than ``max_rows + 1`` of them.
    """
    sizes = table.select(row_bytes(table).alias("bytes")).limit(max_rows + 1)
    n, total = sizes.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    return n <= max_rows and total <= max_bytes


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    spread_by: Sequence[str] = (),
    max_rows: int = MAX_BROADCAST_ROWS,
    max_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Join facts to a lookup table with unique keys; ``how`` is ``inner`` or ``left``.

    A lookup within both bounds is broadcast, so the facts do not move. A larger
    one is joined by shuffle; each of its rows is then repeated once per salt and
    the facts spread over the salts by a hash of ``spread_by``, so a key that
    holds a third of all facts is shared by ``SALTS`` tasks. It is told to Spark as
    a merge: the planner does not count the repeated rows, and would broadcast them
    by the size of the file they come from.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how must be inner or left, not {how}")
    keys = [on] if isinstance(on, str) else list(on)
    if fits_broadcast(lookup, max_rows, max_bytes):
        return facts.join(F.broadcast(lookup), keys, how)
    if not spread_by:
        return facts.join(lookup.hint("merge"), keys, how)
    salted_facts = facts.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)).cast("int"))
    salted_lookup = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted_facts.join(salted_lookup.hint("merge"), [*keys, "_salt"], how).drop("_salt")
