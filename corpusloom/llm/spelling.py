"""Spelling variants grouped by k-d trees over letter-count vectors.

One inserted, deleted or replaced code point changes the counts of letters by at most
two in all: a replaced letter takes one away and adds one, an inserted one adds one. So
words at distance one lie in a small box around each other. The words of every length
have a k-d tree, whose upper levels are fitted on a bounded sample and deal all words
into cells; a word asks the cells of its own length and of the next that its box
touches, each cell is searched by a tree of its own, and what is found is verified
letter by letter. Every word is in one cell and every cell a box touches is asked, so
no pair is lost, whatever the sample.

A cell with more words than ``BLOCK`` is dealt in blocks, each asked by all that ask
the cell, so a task holds one block and streams the words that ask it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.ship import ship
from corpusloom.llm.texts import column, ragged
from corpusloom.operators.lookups import fits_broadcast
from corpusloom.sources.cache import spool

#: Letters of a word: A-Z, a-z and U+00C0 to U+00FF.
LETTERS = "A-Za-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT = 5, 3
#: One run in so many, told by its document, loses a letter.
TYPO = 97
#: A form is at least so many times as frequent as its variant.
RATIO = 2
#: Counts of a word: the 26 letters and the other code points, dealt over the rest.
DIMENSIONS = 64
#: Words the upper levels are fitted on, at most; words a cell should hold, and about as many as one block has at most.
SAMPLE, CELL, BLOCK = 200_000, 6_000, 16_000
#: Words of a leaf of a cell's own tree, and pairs compared at once.
LEAF, PAIRS = 32, 200_000
#: Distinct words a task counts before it passes them on.
MAX_COUNTED = 300_000
#: Words that ask at once.
SLICE = 4_096


class Tree(NamedTuple):
    """Nodes of a k-d tree: a split of one count, the bounds of that count above it, two children; or a leaf (child -1)."""

    axis: np.ndarray
    split: np.ndarray
    low: np.ndarray
    high: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaf: np.ndarray


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(rows of code points padded with 0, lengths)."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    width = int(lengths.max()) if len(words) else 0
    rows = np.zeros((len(words), width), np.uint32)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    rows[np.arange(width) < lengths[:, None]] = flat
    return rows, lengths


def letter_counts(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How often a word has each letter; other code points share what is left of the dimensions, which keeps the bounds."""
    place = np.where((rows >= 97) & (rows <= 122), rows - 97, 26 + rows % (DIMENSIONS - 26))
    counts = np.zeros((len(rows), DIMENSIONS), np.int16)
    inside = np.arange(rows.shape[1]) < lengths[:, None]
    np.add.at(counts, (np.nonzero(inside)[0], place[inside]), 1)
    return counts


def outlines(counts: np.ndarray) -> np.ndarray:
    """Bits for a first and for a second letter of a kind; at most as many differ as the counts do in all."""
    bits = np.concatenate([counts >= 1, counts >= 2], axis=1)
    return np.packbits(bits, axis=1).view(np.uint64)


def build(points: np.ndarray, size: int) -> tuple[Tree, list[np.ndarray]]:
    """A tree over the points with at most ``size`` in a leaf, unless they are alike, and the points of every leaf."""
    nodes: list[list[int]] = []
    leaves: list[np.ndarray] = []
    top = np.iinfo(np.int16).max
    bounds = [np.zeros(points.shape[1], np.int64), np.full(points.shape[1], top)]
    waiting = [(np.arange(len(points)), *bounds, -1, 0)]
    while waiting:
        members, low, high, parent, side = waiting.pop()
        own = len(nodes)
        if parent >= 0:
            nodes[parent][4 + side] = own
        inside = points[members]
        spread = inside.var(axis=0) if len(members) > size else np.zeros(1)
        axis = int(spread.argmax())
        if not spread[axis]:
            nodes.append([0, 0, 0, 0, -1, -1, len(leaves)])
            leaves.append(members)
            continue
        values = inside[:, axis]
        # below the largest, so that both sides hold something
        split = min(int(np.median(values)), int(values.max()) - 1)
        split = max(split, int(values.min()))
        nodes.append([axis, split, int(low[axis]), int(high[axis]), -1, -1, -1])
        below = values <= split
        left_high, right_low = high.copy(), low.copy()
        left_high[axis], right_low[axis] = split, split + 1
        waiting.append((members[below], low, left_high, own, 0))
        waiting.append((members[~below], right_low, high, own, 1))
    return Tree(*np.array(nodes, np.int64).T), leaves


def home(tree: Tree, points: np.ndarray) -> np.ndarray:
    """The leaf of every point."""
    at = np.zeros(len(points), np.int64)
    while True:
        inner = tree.left[at] >= 0
        if not inner.any():
            return tree.leaf[at]
        node = at[inner]
        goes_left = points[inner, tree.axis[node]] <= tree.split[node]
        at[inner] = np.where(goes_left, tree.left[node], tree.right[node])


def touched(tree: Tree, points: np.ndarray, more: int, less: int) -> tuple[np.ndarray, np.ndarray]:
    """(point, leaf) of all leaves that can hold a vector with at most ``more`` counts added and ``less`` taken away."""
    who, at = np.arange(len(points)), np.zeros(len(points), np.int64)
    added, taken = np.zeros((2, len(points)), np.int64)
    found = []
    while len(who):
        ends = tree.left[at] < 0
        found.append((who[ends], tree.leaf[at[ends]]))
        who, at, added, taken = who[~ends], at[~ends], added[~ends], taken[~ends]
        value, low, high, split = points[who, tree.axis[at]], tree.low[at], tree.high[at], tree.split[at]
        above, beneath = np.maximum(low - value, 0), np.maximum(value - high, 0)
        # a child moves one bound of the box along one axis
        sides = []
        for child, child_low, child_high in ((tree.left[at], low, split), (tree.right[at], split + 1, high)):
            up = added - above + np.maximum(child_low - value, 0)
            down = taken - beneath + np.maximum(value - child_high, 0)
            kept = (up <= more) & (down <= less)
            sides.append((who[kept], child[kept], up[kept], down[kept]))
        who, at, added, taken = (np.concatenate(x) for x in zip(*sides, strict=True))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def one_edit(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether words a of n code points become b of m = n or n + 1 by exactly one replaced or inserted one."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    place = np.arange(width)
    same = (a == b) | (place >= n[:, None])
    # the letters that agree from the front, and from the back
    front = np.where(same.all(axis=1), n, same.argmin(axis=1))
    shift = m - n
    back = np.zeros(len(a), np.int64)
    for s in (0, 1):
        rows = np.flatnonzero(shift == s)
        if not len(rows):
            continue
        moved = np.pad(b[rows], ((0, 0), (0, 1)))[:, s : s + width]
        agree = (a[rows] == moved) | (place >= n[rows, None])
        agree = agree[:, ::-1]
        back[rows] = np.where(agree.all(axis=1), width, agree.argmin(axis=1)) - (width - n[rows])
    return np.where(shift == 0, (front < n) & (front + back == n - 1), front + back >= n)


def count_words(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
    typo: int = TYPO,
) -> DataFrame:
    """(word, n) of the runs of letters in all texts, A-Z as a-z, that have enough code points and occurrences.

    Where the crc32 of ``key:run`` is a multiple of ``typo``, the run loses the code
    point at that crc32 modulo its length. A null text has no run; a null key is the
    empty text. Tasks add up what they read before anything is shuffled.
    """
    runs = re.compile(f"[{LETTERS}]{{{min_length},}}").findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            columns = [pa.array(list(counted), pa.string()), pa.array(list(counted.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["word", "n"])

        for batch in batches:
            for name, raw in zip(batch.column(0), batch.column(1), strict=True):
                own = Counter(runs((raw.as_py() or b"").lower().decode("utf-8", "replace")))
                seed = zlib.crc32(f"{name.as_py() or ''}:".encode())
                for word, n in own.items():
                    h = zlib.crc32(word.encode(), seed)
                    if h % typo == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < min_length:
                            continue
                    counted[word] += n
                if len(counted) > MAX_COUNTED:
                    yield flush()
                    counted.clear()
        if counted:
            yield flush()

    ship(docs.sparkSession)
    source = docs.select(column(key).cast("string").alias("key"), column(text).cast("binary").alias("text"))
    found = source.mapInArrow(run, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _cells(words: DataFrame, sample: int, cell: int) -> dict[int, Tree]:
    """A tree per length for the upper levels, from about ``sample`` words by a hash; all words are dealt by it."""
    n = words.count()
    share = min(1.0, sample / max(n, 1))
    some = words.where(F.pmod(F.xxhash64("word"), F.lit(1_000_000)) < int(1_000_000 * share)).select("word").toArrow()
    rows, lengths = code_points(some.column("word").to_pylist())
    points = letter_counts(rows, lengths)
    return {int(size): build(points[lengths == size], max(8, int(cell * share)))[0] for size in np.unique(lengths)}


def _dealt(words: DataFrame, trees: dict[int, Tree], asks: bool) -> DataFrame:
    """(size, cell, word, n): the cell of every word, or all cells that it must ask."""
    sent = words.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                rows, lengths = code_points(part.column(0).to_pylist())
                points = letter_counts(rows, lengths)
                for size in np.unique(lengths).tolist():
                    members = np.flatnonzero(lengths == size)
                    for goal, more, less in ((size, 1, 1), (size + 1, 1, 0)) if asks else ((size, 0, 0),):
                        if goal not in known:
                            # no word of the sample is so long: one cell for them all
                            who, cells = np.arange(len(members)), np.zeros(len(members), np.int64)
                        elif asks:
                            who, cells = touched(known[goal], points[members], more, less)
                        else:
                            who, cells = np.arange(len(members)), home(known[goal], points[members])
                        taken = part.take(pa.array(members[who]))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(who), goal), pa.int32()), pa.array(cells, pa.int32()), *taken.columns],
                            names=["size", "cell", "word", "n"],
                        )

    return words.select("word", "n").mapInArrow(run, "size int, cell int, word string, n bigint")


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, near, near_n), both ways round, from rows (size, cell, block, asks, word, n) in that order.

    The words of a block come first and are at most ``BLOCK``; those that ask it stream by.
    """
    key, stock, tree = None, [], None

    def ready():
        nonlocal tree
        if tree is None:
            words, numbers = (np.concatenate(x) for x in zip(*stock, strict=True))
            rows, lengths = code_points(words.tolist())
            points = letter_counts(rows, lengths)
            tree = (words, numbers, rows, lengths, outlines(points), *build(points, LEAF))
        return tree

    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
        asks = batch.column(3).to_numpy()
        words = batch.column(4).to_numpy(zero_copy_only=False)
        numbers = batch.column(5).to_numpy()
        marks = np.concatenate([keys, asks[:, None]], axis=1)
        starts = np.flatnonzero(np.concatenate([[True], (marks[1:] != marks[:-1]).any(axis=1)])) if len(keys) else []
        for start, end in zip(starts, [*starts[1:], len(keys)], strict=True):
            own = tuple(keys[start])
            if own != key:
                key, stock, tree = own, [], None
            if not asks[start]:
                stock.append((words[start:end], numbers[start:end]))
            elif stock:
                for i in range(start, end, SLICE):
                    yield from _near(ready(), words[i : min(i + SLICE, end)], numbers[i : min(i + SLICE, end)], own[0])


def _near(block, words: np.ndarray, numbers: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    """The words of a block that are one edit away from those that ask."""
    held, held_n, held_rows, held_lengths, held_bits, tree, leaves = block
    rows, lengths = code_points(words.tolist())
    points = letter_counts(rows, lengths)
    bits = outlines(points)
    sizes = np.fromiter(map(len, leaves), np.int64, len(leaves))
    begins, flat = np.cumsum(sizes) - sizes, np.concatenate(leaves)
    for same in (True, False):
        members = np.flatnonzero(lengths == (size if same else size - 1))
        if not len(members):
            continue
        less = 1 if same else 0
        who, leaf = touched(tree, points[members], 1, less)
        who = members[who]
        # leaves in turns of about PAIRS pairs
        turns = np.cumsum(sizes[leaf]) // PAIRS
        for turn in np.unique(turns):
            now = turns == turn
            a = np.repeat(who[now], sizes[leaf[now]])
            b = flat[ragged(begins[leaf[now]], sizes[leaf[now]])]
            # the counts' distance, from below: most pairs go here
            apart = sum(np.bitwise_count(held_bits[b, i] ^ bits[a, i]) for i in range(bits.shape[1]))
            close = apart <= 1 + less
            a, b = a[close], b[close]
            edited = one_edit(rows[a], held_rows[b], lengths[a], held_lengths[b])
            a, b = a[edited], b[edited]
            pairs = [(words[a], held[b], held_n[b])]
            if not same:
                # a word of the own length asks back by itself; a longer one never asks for a shorter
                pairs.append((held[b], words[a], numbers[a]))
            for word, near, n in pairs:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(word, pa.string()), pa.array(near, pa.string()), pa.array(n, pa.int64())],
                    names=["word", "near", "near_n"],
                )


def near_words(words: DataFrame, sample: int = SAMPLE, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """(word, near, near_n) of all pairs of different words one edit apart, both ways round; ``words`` is (word, n), distinct."""
    trees = _cells(words, sample, cell)
    homes = _dealt(words, trees, False)
    # a hash deals the words of a large cell into blocks; one number per cell goes along with those that ask
    blocks = homes.groupBy("size", "cell").agg(F.ceil(F.count("*") / F.lit(block / 2)).cast("int").alias("blocks"))
    blocks = spool(blocks)
    small = F.broadcast(blocks) if fits_broadcast(blocks) else blocks
    spread = F.pmod(F.xxhash64("word"), F.col("blocks").cast("bigint")).cast("int")
    sides = [
        homes.join(small, ["size", "cell"]).withColumn("block", spread).withColumn("asks", F.lit(0)),
        _dealt(words, trees, True)
        .join(small, ["size", "cell"])
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("asks", F.lit(1)),
    ]
    names = ["size", "cell", "block", "asks", "word", "n"]
    both = sides[0].select(*names).unionByName(sides[1].select(*names))
    dealt = both.repartition("size", "cell", "block").sortWithinPartitions("size", "cell", "block", "asks")
    return dealt.mapInArrow(_search, "word string, near string, near_n bigint")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the rows (word, form): the last form that the forms lead to.

    Every form is more frequent than its variant by the ratio, so a chain has at most as
    many steps as its counts have doublings, and pointers that double see it through in
    a logarithm of that.
    """
    links = spool(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = links.join(F.broadcast(ahead) if fits_broadcast(ahead) else ahead, "root", "left")
        stepped = spool(joined.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        links = stepped.select("word", "root")
        if not stepped.agg(F.count_if("moved")).first()[0]:
            return links


def group(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    ratio: int = RATIO,
    typo: int = TYPO,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts.

    ``form`` is the most frequent word one edit away, the smallest of equals, if it is
    ``ratio`` (at least 2) times as frequent; ``root`` the last of the forms from there,
    the word itself if it has none. Null and empty texts have no words, repeated rows
    count again, an empty table gives no rows; other columns are not read.
    """
    if ratio < 2:
        raise ValueError("the ratio must be at least 2")
    words = spool(count_words(docs, key, text, min_length, min_count, typo))
    # code-point order is the order of the UTF-8 bytes
    best = F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near")))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    found = words.join(near, "word", "left")
    form_n = -F.col("best.rank")
    has_form = form_n >= ratio * F.col("n")
    found = spool(
        found.select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(has_form, F.col("best.near")).alias("form"), F.when(has_form, form_n).alias("form_n"),
        )
    )
    last = roots(found.where("form IS NOT NULL"))
    tied = found.join(F.broadcast(last) if fits_broadcast(last) else last, "word", "left")
    return tied.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
