"""Toxicity by class-conditional Kneser-Ney language models.

One model per class gives every expression (a word without case and edges) a toxic and
an ordinary log-likelihood: its discounted count in the class, and for the rest of the
mass a backoff distribution that both classes share. The backoff is Kneser-Ney's, the
number of different contexts an expression stands in, here texts of either class, so
one that is rare in both is told by neither; a text that repeats itself counts once. The difference of the two log-likelihoods per word, over the whole text and
over its highest windows of ``WINDOWS`` words, becomes a score by a logistic curve
fitted on labelled rows that gave no counts.

Counts come from all labelled rows but those. A task counts the distinct words of its
texts, and Spark adds them up by the 64-bit hash into a written table that grows with
the corpus. An expression that no class has more than ``DISCOUNT`` times has the ratio
of one never seen, so the ratios of the others say all. Up to ``MAX_SENT`` of them, the
most frequent, are sent to the tasks; with them alone scoring is one pass without a
shuffle. Where there are more, the distinct remaining expressions of every text meet
the rest of the ratios by a salted join, and the scores are the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.calibration import fit_logistic, labelled, logistic, within
from corpusloom.llm.ship import ship
from corpusloom.llm.texts import MAX_WORDS, SLICE, Grown, WordIds, column, folded, per_text, release_others
from corpusloom.operators.lookups import lookup_join
from corpusloom.sources.cache import spool

#: Taken off every count and given to the backoff.
DISCOUNT = 2.0
WINDOWS = (1, 3, 10)
#: Ratios sent to every task at most, 12 bytes each.
MAX_SENT = 4_000_000
#: Rows the curve is fitted on, at most, out of one in ``CURVE_SHARE`` labelled rows.
CURVE = 20_000
CURVE_SHARE = 5

M = np.uint64
_EDGE = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
NAMES = ("mean_ratio", *[f"peak_{w}" for w in WINDOWS])
FIGURES = T.StructType([T.StructField(f, T.DoubleType(), False) for f in NAMES])
SCORE = T.StructType([*FIGURES.fields, T.StructField("score", T.DoubleType(), False)])
COUNTED = "hash bigint, ordinary bigint, toxic bigint"
RARE = T.StructType([T.StructField("rare", T.ArrayType(T.LongType(), False), False)])


class Sent(NamedTuple):
    """Toxic minus ordinary log-likelihood by hash, ascending; of an expression in no table; and the weights of the curve."""

    hashes: np.ndarray
    ratios: np.ndarray
    unseen: float
    weights: tuple[float, ...] = ()


class Model(NamedTuple):
    """What every task gets, and the (hash, ratio) beyond it, if any."""

    sent: Sent
    rest: DataFrame | None


class Expressions:
    """Words of a worker, each with the number of its bare form (-1 if nothing is left) and that form's hash."""

    def __init__(self) -> None:
        self.words, self.bare = WordIds(), WordIds()
        self.number, self.hashes = Grown(np.int64), Grown(M)

    def of(self, text: bytes | None) -> np.ndarray:
        """Numbers of the text's expressions, in order."""
        ids = self.words.ids(folded(text).split())
        if self.words.fresh:
            bare = [w.strip(_EDGE) for w in self.words.take_fresh()]
            self.number.add([self.bare[w] if w else -1 for w in bare])
            self.hashes.add([xxhash.xxh64_intdigest(w) for w in self.bare.take_fresh()])
        numbers = self.number.values[ids]
        return numbers[numbers >= 0]


def count(rows: DataFrame) -> DataFrame:
    """(hash, ordinary, toxic): how many texts of either class have an expression, of the rows (text, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = Expressions(), np.zeros((0, 2), np.int64)

        def flush() -> pa.RecordBatch:
            n = len(known.bare)
            columns = [known.hashes.values.view(np.int64), counts[:n, 0], counts[:n, 1]]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], names=["hash", "ordinary", "toxic"]
            )

        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    numbers = known.of(text)
                    if len(known.bare) > len(counts):
                        more = max(len(known.bare), 2 * len(counts)) - len(counts)
                        counts = np.concatenate([counts, np.zeros((more, 2), np.int64)])
                    counts[np.unique(numbers), label] += 1
                if len(known.words) > MAX_WORDS:
                    yield flush()
                    known, counts = Expressions(), np.zeros((0, 2), np.int64)
        if len(known.bare):
            yield flush()

    ship(rows.sparkSession)
    found = rows.select(F.col("text").cast("binary").alias("text"), "label").mapInArrow(run, COUNTED)
    return found.groupBy("hash").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def ratios(counted: DataFrame) -> tuple[DataFrame, float]:
    """(hash, n, ratio) of all expressions whose ratio is not that of one never seen, and that ratio.

    ``n`` is how many texts have the expression. Totals are those of the whole table.
    """
    n, classes = F.col("ordinary") + F.col("toxic"), ("ordinary", "toxic")
    kept = {c: F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) for c in classes}
    sums = counted.agg(
        F.count("*").alias("seen"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in classes],
        *[F.coalesce(F.sum(kept[c]), F.lit(0.0)).alias(f"kept_{c}") for c in classes],
    ).first()
    # half a context for what was never seen, as much in all as for every expression that was
    shared = (n + 0.5) / (sums["ordinary"] + sums["toxic"] + 0.5 * max(sums["seen"], 1))
    total = {c: max(float(sums[c]), 1.0) for c in classes}
    left = {c: 1 - sums[f"kept_{c}"] / total[c] for c in classes}
    ordinary, toxic = (F.log(kept[c] / total[c] + left[c] * shared) for c in classes)
    known = counted.where(F.greatest(*classes) > DISCOUNT)
    unseen = float(np.log(left["toxic"]) - np.log(left["ordinary"]))
    return known.select("hash", n.alias("n"), (toxic - ordinary).cast("float").alias("ratio")), unseen


def learn_ratios(counted: DataFrame, max_sent: int = MAX_SENT) -> Model:
    """The model without a curve; only the most frequent ``max_sent`` ratios at most leave the written table."""
    found, unseen = ratios(spool(counted))
    found = spool(found)
    # classes of frequency, four to a doubling
    rank = F.floor(4 * F.log2("n"))
    sizes = sorted(((r["rank"], r["count"]) for r in found.groupBy(rank.alias("rank")).count().collect()), reverse=True)
    total, least = 0, None
    for value, size in sizes:
        total += size
        if total > max_sent:
            break
        least = value
    else:
        least = 0
    often = F.lit(False) if least is None else rank >= least
    sent = found.where(often).select("hash", "ratio").toArrow()
    hashes = sent.column("hash").to_numpy().view(M)
    order = np.argsort(hashes)
    return Model(
        Sent(hashes[order], sent.column("ratio").to_numpy()[order], unseen),
        found.where(~often).select("hash", "ratio") if total > max_sent else None,
    )


def look_up(hashes: np.ndarray, sent: Sent) -> tuple[np.ndarray, np.ndarray]:
    """The ratios of the hashes, and which of them the table has."""
    if not len(sent.hashes):
        return np.full(len(hashes), sent.unseen), np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(sent.hashes, hashes), len(sent.hashes) - 1)
    known = sent.hashes[at] == hashes
    return np.where(known, sent.ratios[at].astype(np.float64), sent.unseen), known


class Ratios:
    """The figures of texts; ratios are looked up once per distinct word."""

    def __init__(self, sent: Sent) -> None:
        self.sent = sent
        self.clear()

    def clear(self) -> None:
        self.expressions, self.ratio, self.known = Expressions(), Grown(np.float64), Grown(bool)

    def numbers(self, text: bytes | None) -> np.ndarray:
        numbers = self.expressions.of(text)
        fresh = self.expressions.hashes.values[len(self.ratio.values) :]
        if len(fresh):
            found, known = look_up(fresh, self.sent)
            self.ratio.add(found)
            self.known.add(known)
        return numbers

    def rare(self, text: bytes | None) -> np.ndarray:
        """Hashes of the text's distinct expressions that were not sent."""
        numbers = np.unique(self.numbers(text))
        return self.expressions.hashes.values[numbers[~self.known.values[numbers]]].view(np.int64)

    def of(self, text: bytes | None, more: list[dict] | None) -> list[float]:
        """Mean ratio over the text, and in its highest window of each size; ``more`` are ratios that were not sent."""
        numbers = self.numbers(text)
        if not len(numbers):
            return [0.0] * len(NAMES)
        own = self.ratio.values[numbers]
        if more:
            others = sorted((m["hash"] % (1 << 64), m["ratio"]) for m in more)
            table = Sent(np.array([h for h, _ in others], M), np.array([r for _, r in others], np.float32), 0.0)
            found, known = look_up(self.expressions.hashes.values[numbers], table)
            own = np.where(known, found, own)
        sums = np.concatenate([[0.0], np.cumsum(own)])
        made = [float(sums[-1] / len(numbers))]
        for window in WINDOWS:
            w = min(window, len(numbers))
            made.append(float((sums[w:] - sums[:-w]).max() / w))
        return made

    def bound(self) -> None:
        if len(self.expressions.words) > MAX_WORDS:
            self.clear()


def _scored(docs: DataFrame, model: Model, text: str, keep: list[str] | None, with_score: bool) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model.sent)
    schema = SCORE if with_score else FIGURES

    def kernel():
        release_others("toxicity")
        ratios = Ratios(sent.value)
        weights = np.array(sent.value.weights)

        def work(texts, more=None):
            ratios.bound()
            pairs = zip(texts, more or [None] * len(texts), strict=True)
            figures = np.array([ratios.of(t, m) for t, m in pairs]).reshape(-1, len(NAMES))
            out = {name: pa.array(figures[:, i]) for i, name in enumerate(NAMES)}
            if with_score:
                out["score"] = pa.array(logistic(figures, weights))
            return out

        return work

    if model.rest is None:
        return per_text(docs, text, kernel, schema, keep)

    def kernel_of_rare():
        release_others("toxicity")
        ratios = Ratios(sent.value)

        def work(texts):
            ratios.bound()
            return {"rare": pa.array([ratios.rare(t) for t in texts], pa.list_(pa.int64()))}

        return work

    names = list(docs.columns if keep is None else keep)
    stored = spool(
        docs.select(
            F.struct(*[column(c).alias(c) for c in names]).alias("row"),
            column(text).cast("binary").alias("text"),
            F.monotonically_increasing_id().alias("rid"),
        )
    )
    rare = per_text(stored, "text", kernel_of_rare, RARE, ["rid"])
    pairs = rare.select("row.rid", F.explode("out.rare").alias("hash"))
    found = lookup_join(pairs, model.rest, "hash", "inner", ["rid"])
    more = found.groupBy("rid").agg(F.collect_list(F.struct("hash", "ratio")).alias("more"))
    joined = stored.join(more, "rid", "left")
    return per_text(joined, "text", kernel, schema, ["row"], F.col("more")).select("row.row", "out")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    curve: int = CURVE,
    max_sent: int = MAX_SENT,
) -> Model:
    """Models and curve from the labelled rows whose ``key`` fulfils ``learn``.

    Of one in ``CURVE_SHARE`` of them, by a hash of the key, at most about ``curve`` rows
    fit the curve; all others give counts. Without labels every text scores alike.
    """
    rows = labelled(docs, labels, key, text, label).where(learn)
    apart = F.pmod(F.xxhash64(F.lit(2), "key"), F.lit(CURVE_SHARE)) == 0
    apart &= within(rows.where(apart).count(), "key", curve, 21)
    model = learn_ratios(count(rows.where(~apart)), max_sent)
    held = spool(rows.where(apart).select("label", "text"))
    figures = _scored(held, model, "text", ["label"], False).select("row.label", "out.*").toArrow()
    x = np.stack([figures.column(c).to_numpy() for c in NAMES], axis=1).astype(float)
    weights = tuple(fit_logistic(x, figures.column("label").to_numpy().astype(float)))
    return model._replace(sent=model.sent._replace(weights=weights))


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row, out): figures and score of every row's whole text, higher for label 1.

    A null or empty text, or one of punctuation alone, has the figures 0. Repeated rows
    and ties score alike; columns named like a result stay in ``row``.
    """
    return _scored(docs, model, text, keep, True)
