"""Quality by compression: which of two zstandard dictionaries makes a text smaller.

One dictionary is built from texts labelled good, one from texts labelled bad. A text is
cut into blocks, so the dictionary and not the text's own past explains each; the
difference of the two compressed sizes over their sum is the figure, and a logistic
curve fitted on other labelled rows makes it a score.

The fit takes a bounded sample of labelled rows (``SAMPLE`` rows per label, of texts up to
``SAMPLE_BYTES`` bytes, and ``CURVE`` rows for the curve); scoring covers every block of
every text. One pass, no shuffle, and two dictionaries of ``DICTIONARY`` bytes to send.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.calibration import bounded, fit_logistic, labelled, logistic
from corpusloom.llm.texts import per_text
from corpusloom.sources.cache import spool

DICTIONARY = 65_536
LEVEL = 3
BLOCK = 2_048
SAMPLE = 1_500
SAMPLE_BYTES = 32_768
CURVE = 10_000

FIGURE = T.StructType([T.StructField("figure", T.DoubleType(), False)])
SCORE = T.StructType([T.StructField("figure", T.DoubleType(), False), T.StructField("score", T.DoubleType(), False)])


class Model(NamedTuple):
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    level: int = LEVEL
    block: int = BLOCK


def dictionary(texts: list[bytes], size: int = DICTIONARY) -> bytes:
    """A dictionary built from the texts; where they are too few to train one, their tail itself."""
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(texts)[-size:]


def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    options = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if len(content) < 8:  # shorter than any dictionary
        return zstandard.ZstdCompressor(level=level, **options)
    data = zstandard.ZstdCompressionDict(content)
    data.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=data, **options)


def _figures(model: Model):
    good, bad = (_compressor(d, model.level) for d in (model.good, model.bad))

    def figure(text: bytes | None) -> float:
        text = text or b""
        a = b = 0
        for start in range(0, len(text), model.block):
            block = text[start : start + model.block]
            a += len(good.compress(block))
            b += len(bad.compress(block))
        return (b - a) / (a + b) if a + b else 0.0

    return figure


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample: int = SAMPLE,
    curve: int = CURVE,
) -> Model:
    """Dictionaries and curve from the labelled rows whose ``key`` fulfils ``learn``.

    Half of those rows, by a hash of the key, may go into the dictionaries, the others
    into the curve. Without labels the dictionaries are empty and the curve is flat.
    """
    rows = labelled(docs, labels, key, text, label).where("text IS NOT NULL").withColumn("_half", F.pmod(F.xxhash64(F.lit(5), "key"), F.lit(2)))
    rows = rows.where(learn)
    built = []
    for value in (1, 0):
        fits = rows.where((F.col("label") == value) & (F.col("_half") == 0) & (F.octet_length("text") <= SAMPLE_BYTES))
        texts = bounded(fits, "key", sample, 11).select("key", F.col("text").cast("binary").alias("text"))
        built.append(dictionary([bytes(r["text"]) for r in texts.orderBy("key", "text").toLocalIterator()]))
    model = Model(*built, ())
    held = spool(bounded(rows.where("_half = 1"), "key", curve, 12).select("label", "text"))
    figures = score_raw(held, model, "text", ["label"]).select("row.label", "out.figure").toArrow()
    x = np.array(figures.column("figure").to_pylist(), float).reshape(-1, 1)
    y = np.array(figures.column("label").to_pylist(), float)
    return model._replace(weights=tuple(fit_logistic(x, y)))


def score_raw(docs: DataFrame, model: Model, text: str, keep: list[str]) -> DataFrame:
    """(row, out.figure): the normalised difference of the compressed sizes."""

    def kernel():
        figure = _figures(model)
        return lambda texts: {"figure": pa.array([figure(t) for t in texts], pa.float64())}

    return per_text(docs, text, kernel, FIGURE, keep)


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row, out): figure and score of every row's whole text, higher for label 1.

    A null or empty text has the figure 0, where neither dictionary wins. Repeated rows
    and ties score alike, columns named like a result stay in ``row``.
    """

    def kernel():
        figure = _figures(model)
        weights = np.array(model.weights)

        def work(texts):
            figures = np.array([figure(t) for t in texts])
            return {
                "figure": pa.array(figures, pa.float64()),
                "score": pa.array(logistic(figures[:, None], weights), pa.float64()),
            }

        return work

    return per_text(docs, text, kernel, SCORE, keep)
