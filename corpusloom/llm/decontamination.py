"""Benchmark decontamination by greedy string tiling.

A text and a benchmark item are compared when they share a seed, a run of
``MIN_MATCH`` tokens. Their longest common runs of unmarked tokens are marked one after
the other, longest first, by running Karp-Rabin: rolling hashes of all windows give the
equal ones, neighbours on a diagonal join to maximal runs, and a run that an earlier
mark cuts goes back with what is left of it. An item counts as leaked when marked runs
cover enough of it, in whatever order the text has them.

Items are few and short next to the texts. Up to ``MAX_ITEM_BYTES`` they are sent to
every task and the texts stay where they are; beyond, seeds are joined by shuffle and
each pair gets its two texts. Both ways find the same pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.ship import ship
from corpusloom.llm.texts import column, folded, held, per_text
from corpusloom.operators.lookups import fits_broadcast
from corpusloom.sources.cache import spool

#: Tokens of the shortest run that counts.
MIN_MATCH = 4
#: Share of an item's tokens that marked runs must cover.
COVERAGE = 0.5
#: Items beyond these bounds are joined by shuffle.
MAX_ITEM_BYTES = 16 * 1024 * 1024
MAX_ITEMS = 100_000

M = np.uint64
#: Base of the rolling hash.
BASE = 0x9E3779B97F4A7C15

ITEM = T.StructType(
    [
        T.StructField("item", T.LongType()),
        *[T.StructField(name, T.IntegerType()) for name in ("covered", "tokens", "tiles")],
    ]
)
RESULT = T.StructType([T.StructField("found", T.ArrayType(ITEM), False)])
ARROW_ITEM = pa.struct([("item", pa.int64()), ("covered", pa.int32()), ("tokens", pa.int32()), ("tiles", pa.int32())])
SEEDS = T.StructType([T.StructField("seeds", T.ArrayType(T.LongType(), False), False)])

#: Characters that do not tell tokens apart where they stand at a word's ends.
_EDGE = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def tokens(text: bytes | None) -> list[bytes]:
    """Words without case and without ASCII punctuation at their ends; bare punctuation is no token."""
    return [t for t in (w.strip(_EDGE) for w in folded(text).split()) if t]


def windows(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``width`` tokens."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, M)
    total = np.zeros(n, M)
    for i in range(width):
        total = total * M(BASE) + ids[i : i + n]
    return total


def tile(text: np.ndarray, item: np.ndarray, at: np.ndarray, of: np.ndarray, width: int) -> tuple[int, int]:
    """Tokens of the item that greedy tiling covers, and the number of tiles.

    ``at`` and ``of`` are the places in the text and in the item of every pair of equal
    windows of ``width`` tokens.
    """
    same = np.ones(len(at), bool)
    for i in range(width):
        same &= text[at + i] == item[of + i]
    at, of = at[same], of[same]
    order = np.lexsort((at, at - of))
    at, of = at[order], of[order]
    if not len(at):
        return 0, 0
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(at - of) != 0)) + 1
    starts, ends = np.append(0, cut), np.append(cut, len(at))
    heap = [
        (-(int(e - s) + width - 1), int(at[s]), int(of[s])) for s, e in zip(starts, ends, strict=True)
    ]
    heapq.heapify(heap)
    text_marks, item_marks = set(), np.zeros(len(item), bool)
    tiles = 0
    while heap:
        size, p, q = heapq.heappop(heap)
        size = -size
        free = [not item_marks[q + i] and p + i not in text_marks for i in range(size)]
        if all(free):
            item_marks[q : q + size] = True
            text_marks.update(range(p, p + size))
            tiles += 1
            continue
        start = None
        for i, ok in enumerate([*free, False]):
            if ok and start is None:
                start = i
            elif not ok and start is not None:
                if i - start >= width:
                    heapq.heappush(heap, (-(i - start), p + start, q + start))
                start = None
    return int(item_marks.sum()), tiles


class Items:
    """Benchmark items ready to be found: token numbers, and the sorted hashes of their windows."""

    def __init__(self, texts: Iterable[bytes | None], width: int) -> None:
        self.width = width
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[np.ndarray] = []
        hashes, owners, places = [], [], []
        for k, text in enumerate(texts):
            words = tokens(text)
            ids = np.array([self.vocabulary.setdefault(w, xxhash.xxh64_intdigest(w) | 1) for w in words], M)
            self.items.append(ids)
            # an item shorter than a window is a window of its own
            own = windows(ids, min(width, max(len(ids), 1)))
            hashes.append(own)
            owners.append(np.full(len(own), k))
            places.append(np.arange(len(own)))
        all_hashes = np.concatenate(hashes) if hashes else np.zeros(0, M)
        order = np.argsort(all_hashes, kind="stable")
        self.hashes = all_hashes[order]
        self.owner = (np.concatenate(owners) if owners else np.zeros(0, np.int64))[order]
        self.place = (np.concatenate(places) if places else np.zeros(0, np.int64))[order]
        lengths = {len(i) for i in self.items if 0 < len(i) < width}
        self.widths = sorted(lengths | {width})

    def find(self, text: bytes | None) -> list[tuple[int, int, int, int]]:
        """(item, covered tokens, tokens, tiles) of every item that shares a seed with the text."""
        words = tokens(text)
        look = self.vocabulary.get
        ids = np.fromiter((look(w, 0) for w in words), M, len(words))
        hit_at, hit_row = [], []
        for width in self.widths:
            if len(ids) < width:
                continue
            # only windows whose tokens the benchmark knows
            known = np.concatenate([[0], np.cumsum(ids != 0)])
            at = np.flatnonzero(known[width:] - known[:-width] == width)
            if not len(at):
                continue
            own = np.zeros(len(at), M)
            for i in range(width):
                own = own * M(BASE) + ids[at + i]
            first = np.searchsorted(self.hashes, own, "left")
            count = np.searchsorted(self.hashes, own, "right") - first
            some = count > 0
            if some.any():
                first, count, at = first[some], count[some], at[some]
                ends = np.cumsum(count)
                rows = np.arange(int(ends[-1])) + np.repeat(first - (ends - count), count)
                hit_row.append(rows)
                hit_at.append(np.repeat(at, count))
        if not hit_row:
            return []
        rows, at = np.concatenate(hit_row), np.concatenate(hit_at)
        owner, place = self.owner[rows], self.place[rows]
        order = np.argsort(owner, kind="stable")
        owner, place, at = owner[order], place[order], at[order]
        cuts = np.flatnonzero(np.diff(owner)) + 1
        found = []
        for part_owner, part_place, part_at in zip(
            np.split(owner, cuts), np.split(place, cuts), np.split(at, cuts), strict=True
        ):
            k = int(part_owner[0])
            item = self.items[k]
            width = min(self.width, len(item))
            ok = (part_at + width <= len(ids)) & (part_place + width <= len(item))
            covered, tiles = tile(ids, item, part_at[ok], part_place[ok], width)
            if covered:
                found.append((k, covered, len(item), tiles))
        return found


def _items(texts: tuple, width: int) -> Items:
    return held("decontamination", (texts, width), lambda: Items(texts, width))


def _rows(found: list[tuple], names, coverage: float) -> list[dict]:
    return [
        {"item": names[k], "covered": c, "tokens": n, "tiles": t} for k, c, n, t in found if c >= coverage * n
    ]


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    keep: list[str] | None = None,
    width: int = MIN_MATCH,
    coverage: float = COVERAGE,
    max_item_bytes: int = MAX_ITEM_BYTES,
) -> DataFrame:
    """(row, found): the columns ``keep`` of every row, and the items its text leaks.

    ``found`` has the item's key, its covered tokens, all its tokens and the tiles, in
    the items' order. Null or empty texts and items leak nothing; an item shorter than
    ``width`` tokens must stand in the text as a whole. Equal items are found alike,
    repeated rows are judged one by one, and an empty benchmark finds nothing.
    """
    if not 0 < coverage <= 1 or width < 1:
        raise ValueError("coverage must be in (0, 1] and width positive")
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(column(item).cast("bigint").alias("item"), column(item_text).cast("binary").alias("text"))
    if fits_broadcast(benchmark.select(column(item_text).alias("text")), MAX_ITEMS, max_item_bytes):
        rows = items.orderBy("item", "text").collect()
        sent = spark.sparkContext.broadcast(
            (tuple(r["item"] for r in rows), tuple(bytes(r["text"] or b"") for r in rows))
        )

        def kernel():
            names, texts = sent.value
            known = _items(texts, width)

            def work(batch):
                found = [_rows(known.find(t), names, coverage) for t in batch]
                return {"found": pa.array(found, pa.list_(ARROW_ITEM))}

            return work

        return per_text(docs, text, kernel, RESULT, keep).select("row", "out.found")
    return _by_shuffle(docs, items, text, keep, width, coverage)


def _seed_rows(texts: DataFrame, text: str, keep: list[str], width: int, widths: tuple[int, ...] | None) -> DataFrame:
    """(row, out.seeds): hashes of the windows of ``widths``; of an item's own width when none are given."""

    def kernel():
        def work(batch):
            made = []
            for t in batch:
                ids = np.array([xxhash.xxh64_intdigest(w) | 1 for w in tokens(t)], M)
                own = [windows(ids, n) for n in widths or (min(width, max(len(ids), 1)),)]
                made.append(np.unique(np.concatenate(own)).view(np.int64))
            return {"seeds": pa.array(made, pa.list_(pa.int64()))}

        return work

    return per_text(texts, text, kernel, SEEDS, keep)


def _by_shuffle(
    docs: DataFrame, items: DataFrame, text: str, keep: list[str] | None, width: int, coverage: float
) -> DataFrame:
    """The same result when the benchmark is too large to send: seeds meet by shuffle, then pairs get their texts."""
    names = list(docs.columns if keep is None else keep)
    stored = spool(
        docs.select(
            F.struct(*[column(c).alias(c) for c in names]).alias("row"),
            column(text).cast("binary").alias("text"),
            F.monotonically_increasing_id().alias("rid"),
        )
    )
    numbered = spool(items.withColumn("k", F.monotonically_increasing_id()))
    item_seeds = _seed_rows(numbered, "text", ["k"], width, None)
    item_seeds = item_seeds.select("row.k", F.explode("out.seeds").alias("seed"))
    # every width up to the usual one, since an item may be shorter
    doc_seeds = _seed_rows(stored, "text", ["rid"], width, tuple(range(1, width + 1)))
    doc_seeds = doc_seeds.select("row.rid", F.explode("out.seeds").alias("seed"))
    pairs = doc_seeds.join(item_seeds, "seed").select("rid", "k").distinct()
    both = pairs.join(stored.select("rid", "text"), "rid").join(
        numbered.select("k", "item", F.col("text").alias("item_text")), "k"
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: Mapping[str, list] = batch.to_pydict()
            out = [
                _rows(Items([b], width).find(a), [i], coverage)
                for a, b, i in zip(columns["text"], columns["item_text"], columns["item"], strict=True)
            ]
            keep_rows = [bool(x) for x in out]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r for r, ok in zip(columns["rid"], keep_rows, strict=True) if ok], pa.int64()),
                    pa.array([x[0] for x in out if x], ARROW_ITEM),
                ],
                names=["rid", "one"],
            )

    schema = T.StructType([T.StructField("rid", T.LongType()), T.StructField("one", ITEM)])
    one = both.select("rid", "text", "item", "item_text").mapInArrow(judge, schema)
    found = one.groupBy("rid").agg(F.sort_array(F.collect_list("one")).alias("found"))
    empty = F.array().cast(T.ArrayType(ITEM))
    return stored.join(found, "rid", "left").select("row", F.coalesce("found", empty).alias("found"))
