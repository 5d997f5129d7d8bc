"""Place for a user's own batch function, such as a subword tokenizer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


#: Characters and bytes of the frames that the function gets; a longer row is one of its own.
FRAME_BYTES = 1 << 20


def frames(batch: pd.DataFrame, most: int = FRAME_BYTES) -> Iterator[pd.DataFrame]:
    """The batch in consecutive frames whose strings and bytes are no longer than ``most`` together."""
    sizes = np.zeros(len(batch), np.int64)
    for place, kind in enumerate(batch.dtypes):
        if not pd.api.types.is_numeric_dtype(kind):
            sizes += [len(x) if isinstance(x, str | bytes) else 0 for x in batch.iloc[:, place]]
    ends, start = np.cumsum(sizes), 0
    while start < len(batch):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield batch.iloc[start:stop].reset_index(drop=True)
        start = stop


def map_batches(rows: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], added: str) -> DataFrame:
    """Rows with the columns ``fn`` computes for each frame of an Arrow batch; ``added`` is their DDL.

    A batch is counted in rows, so what ``fn`` makes of it would grow with the texts; it
    gets the batch in frames of about ``FRAME_BYTES`` in place.

    The slow path: use it only for what column expressions cannot say. Select the
    columns ``fn`` needs first, since all of them travel to Python. ``fn`` returns
    a frame with the added columns and one row per input row.
    """
    new = T.StructType.fromDDL(added)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for frame in frames(batch):
                result = fn(frame)
                yield frame.assign(**{name: result[name].to_numpy() for name in new.names})

    return rows.mapInPandas(run, T.StructType(rows.schema.fields + new.fields))
