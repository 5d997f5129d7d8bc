"""Whole texts of a table through Arrow batches, and the per-worker word tables.

Words are ``[^\\x20\\x09-\\x0D]+``: exactly what ``bytes.split()`` yields on UTF-8, so
splitting, counting and looking words up stay in C. What is costly to know about a
word (its tokens, its hash, its likelihood) is worked out once per distinct word and
worker, and looked up for every further occurrence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.ship import ship

#: Rows handled at once in a task.
SLICE = 256
#: Distinct words a worker remembers; beyond it the table starts anew.
MAX_WORDS = 300_000
#: Bytes of an Arrow batch; a task holds several at once, on either side.
BATCH_BYTES = 8 << 20


def column(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


_held: dict[tuple, Any] = {}


def release_others(owner: str) -> None:
    """Drop the worker's tables of other owners.

    Workers live on from stage to stage; so a chain of operators needs the memory of the
    largest and not of all.
    """
    others = [key for key in _held if key[0] != owner]
    for key in others:
        del _held[key]
    if others:
        pa.default_memory_pool().release_unused()


def held(owner: str, name: Any, make: Callable[[], Any]) -> Any:
    """The worker's table of that owner and name, made when it is not there; others' tables go."""
    release_others(owner)
    if (owner, name) not in _held:
        _held[owner, name] = make()
    return _held[owner, name]


def per_text(
    docs: DataFrame,
    text: str,
    kernel: Callable[[], Callable[..., dict[str, pa.Array]]],
    result: T.StructType,
    keep: Iterable[str] | None = None,
    beside: Column | None = None,
) -> DataFrame:
    """(row, out): the ``keep`` columns of ``docs`` (all by default) and what the kernel makes of the text.

    Both are structs, so a column of the input may bear the name of a result. The
    kernel is made once per task and called with the UTF-8 texts of up to ``SLICE``
    rows, null where the text is null, and with the values of the column ``beside`` if
    there is one. One pass over the scan, no shuffle. The session's Arrow batches are
    set to ``BATCH_BYTES``.
    """
    ship(docs.sparkSession)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    names = list(docs.columns if keep is None else keep)
    source = docs.select(
        F.struct(*[column(c).alias(c) for c in names]).alias("row"),
        column(text).cast("binary").alias("text"),
        *([] if beside is None else [beside.alias("beside")]),
    )
    schema = T.StructType([T.StructField("row", source.schema["row"].dataType), T.StructField("out", result)])
    fields = result.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = kernel()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                made = work(*[c.to_pylist() for c in part.columns[1:]])
                out = pa.StructArray.from_arrays([made[f] for f in fields], names=fields)
                yield pa.RecordBatch.from_arrays([part.column(0), out], names=["row", "out"])

    return source.mapInArrow(run, schema)


class WordIds(dict):
    """Word -> number in order of first sight; ``fresh`` lists words not yet looked into."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.fresh.append(word)
        return number

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def take_fresh(self) -> list[bytes]:
        fresh, self.fresh = self.fresh, []
        return fresh


class Grown:
    """A numpy column that grows by chunks; ``values`` is valid up to its length."""

    def __init__(self, dtype) -> None:
        self._data = np.zeros(1024, dtype)
        self._n = 0

    def add(self, chunk) -> None:
        chunk = np.asarray(chunk, self._data.dtype)
        need = self._n + len(chunk)
        if need > len(self._data):
            bigger = np.zeros(max(need, 2 * len(self._data)), self._data.dtype)
            bigger[: self._n] = self._data[: self._n]
            self._data = bigger
        self._data[self._n : need] = chunk
        self._n = need

    @property
    def values(self) -> np.ndarray:
        return self._data[: self._n]


def folded(text: bytes | None) -> bytes:
    """The text without case, by Unicode's full folding; bytes that are not UTF-8 stay as they are."""
    text = text or b""
    if text.isascii():
        return text.lower()
    return text.decode("utf-8", "surrogateescape").casefold().encode("utf-8", "surrogateescape")


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every run, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
