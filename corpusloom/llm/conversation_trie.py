"""Trie of conversation prefixes, rolled up by centroid decomposition.

A conversation's first d turns are told by 128 bits: the exclusive or of hashes of
(depth, role, text), so a prefix is a running aggregate. Turns are sorted by range over
(conversation, turn), which cuts a conversation of any length, and what earlier ranges
hold is carried on, so no task needs a whole conversation. Equal prefixes are a node, found by one
aggregation that combines before it shuffles.

Subtree totals come from a centroid decomposition of the parent edges. A node weighs
its members, so what the aggregation sums of (turns left) over a node's members is the
weight of its subtree and needs no rollup. In every round each component has one
centroid, the lowest node whose subtree has half of the weight. What the centroid's
subtree holds within the component is added to the nodes on the path from the centroid to the
component's top; then the centroid goes, and its children's subtrees and what lies
above are components of at most half the weight. A node is on a path to the top just if the
centroid's smallest member has it as a prefix, and below a centroid just if its own
smallest member goes on from there, so neither needs a walk. Rounds are stored tables;
components of at most ``COMPONENT`` nodes are finished inside a task by the same rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.ship import ship
from corpusloom.llm.texts import column
from corpusloom.operators.lookups import MAX_BROADCAST_ROWS, fits_broadcast
from corpusloom.sources.cache import spool

#: Conversations of one hundred borrow their first turns, fewer than ``BORROWED``, from the first of them.
FAMILY, BORROWED = 100, 6
#: Nodes of a component that a task finishes by itself, at most.
COMPONENT = 4_096
#: Ids of one piece of an ordered list.
PIECE = 4_096
#: The names of a node and of its parent.
NODE, PARENT = ["a", "b"], ["pa", "pb"]


def _tied(facts: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """A join with unique keys; a lookup beyond the checked size is shuffled, and Spark splits what is skewed."""
    return facts.join(F.broadcast(lookup) if fits_broadcast(lookup) else lookup, list(on), how)


def ordered_turns(turns: DataFrame) -> DataFrame:
    """(conv, range, place, x, y, chars): the turns in order, their ranges and their places in the range.

    A null turn is first; turns of one number are ordered by role and then by the digest
    of their text.
    """
    text, role = (F.coalesce(column(c).cast("string"), F.lit("")) for c in ("text", "role"))
    rows = turns.select(
        column("conv_id").cast("bigint").alias("conv"), column("turn").alias("turn"), role.alias("role"),
        F.md5(text.cast("binary")).alias("mark"), F.xxhash64(F.lit(1), role, text).alias("x"),
        F.xxhash64(F.lit(2), text, role).alias("y"), F.length(text).cast("bigint").alias("chars"),
    ).where("conv IS NOT NULL")
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "mark"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.select(
        "conv", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("place"), "x", "y", "chars"
    )


def rebuild(turns: DataFrame, family: int = FAMILY, borrowed: int = BORROWED) -> tuple[DataFrame, DataFrame]:
    """The seats (conv, depth, node, parent, chars, left) of all rebuilt turns, and (conv, turns) of all conversations.

    Conversation c has the first h = crc32(c) mod ``borrowed`` turns of c - c mod
    ``family`` and then its own after its first h. ``left`` counts the turns from here
    on, this one included.
    """
    rows = spool(ordered_turns(turns))
    earlier = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # one row per conversation, but for those that a range cuts
    blocks = rows.groupBy("conv", "range").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    blocks = spool(blocks.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))))
    convs = blocks.groupBy("conv").agg(F.sum("n").alias("own"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % borrowed).alias("h")
    convs = spool(convs.select("conv", "own", h, (F.col("conv") - F.col("conv") % family).alias("base")))
    bases = convs.select(F.col("conv").alias("base"), F.col("own").alias("offered"))
    convs = convs.join(bases, "base", "left").withColumn("k", F.least("h", F.coalesce("offered", F.lit(0))))
    length = F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    convs = spool(convs.select("conv", "base", "h", "k", length.alias("turns")))

    numbered = _tied(rows, blocks.select("conv", "range", "first", "before"), ["conv", "range"])
    numbered = spool(numbered.select("conv", "range", (F.col("place") - F.col("first") + F.col("before")).alias("nth"), "x", "y", "chars"))
    own = _tied(numbered, convs.select("conv", "h", "k"), ["conv"]).where("nth >= h")
    own = own.withColumn("depth", F.col("nth") - F.col("h") + F.col("k") + 1)
    heads = numbered.where((F.col("nth") < borrowed - 1) & (F.col("conv") % family == 0))
    heads = heads.select(F.col("conv").alias("base"), "nth", "x", "y", "chars")
    lent = convs.where("k > 0").select("conv", "base", "k").join(heads, "base").where("nth < k")
    lent = lent.select("conv", F.lit(-1).alias("range"), (F.col("nth") + 1).alias("depth"), "x", "y", "chars")
    both = lent.unionByName(own.select("conv", "range", "depth", "x", "y", "chars"))
    both = spool(
        both.select(
            "conv", "range", "depth", "chars",
            F.xxhash64(F.lit(3), "depth", "x", "y").alias("x"), F.xxhash64(F.lit(4), "depth", "y", "x").alias("y"),
        )
    )
    totals = both.groupBy("conv", "range").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    carried = [F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(f"carried_{c}") for c in ("x", "y")]
    carries = spool(totals.select("conv", "range", *carried))
    within = Window.partitionBy("conv", "range").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    summed = both.withColumns({"a": F.bit_xor("x").over(within), "b": F.bit_xor("y").over(within)})
    seats = _tied(_tied(summed, carries, ["conv", "range"]), convs.select("conv", "turns"), ["conv"])
    a, b = F.col("a").bitwiseXOR(F.col("carried_x")), F.col("b").bitwiseXOR(F.col("carried_y"))
    seats = seats.select(
        "conv", "depth", a.alias("a"), b.alias("b"), a.bitwiseXOR(F.col("x")).alias("pa"), b.bitwiseXOR(F.col("y")).alias("pb"),
        "chars", (F.col("turns") - F.col("depth") + 1).alias("left"),
    )
    return spool(seats), convs.select("conv", "turns")


def nodes_of(seats: DataFrame, convs: DataFrame) -> DataFrame:
    """(node, parent, depth, conv, n_convs, weight, n_children, leaf, saved) of every distinct prefix and the root (0, 0)."""
    found = seats.groupBy(*NODE).agg(
        *[F.first(c).alias(c) for c in (*PARENT, "depth", "chars")],
        F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.sum("left").alias("weight"),
    )
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    root = convs.agg(
        F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.sum(F.col("turns") + 1).alias("weight")
    ).where("n_convs > 0")
    root = root.select(
        *[zero.alias(c) for c in NODE], *[none.alias(c) for c in PARENT], zero.alias("depth"), zero.alias("chars"),
        "conv", "n_convs", "weight",
    )
    found = spool(found.unionByName(root))
    children = found.where("depth > 0").groupBy(*[F.col(p).alias(n) for p, n in zip(PARENT, NODE, strict=True)])
    found = found.join(children.agg(F.count("*").alias("n_children")), NODE, "left")
    found = found.withColumn("n_children", F.coalesce("n_children", zero))
    return spool(
        found.withColumns(
            {
                "leaf": (F.col("n_children") == 0).cast("bigint"),
                "saved": (F.col("n_convs") - 1) * F.col("chars"),
            }
        ).drop("chars")
    )


def subtree_sums(nodes: DataFrame, seats: DataFrame, values: Sequence[str], component: int = COMPONENT) -> DataFrame:
    """(node, values): the sum of every value over the node's subtree, by centroid decomposition."""
    sums, comp, slim = [f"sum_{v}" for v in values], ["ca", "cb"], ["a", "b", "pa", "pb", "depth", "conv", "weight"]
    active = nodes.select(
        *slim, *values, *[F.lit(0).cast("bigint").alias(c) for c in (*sums, *comp)]
    )
    done = []
    while True:
        sizes = active.groupBy(*comp).agg(F.count("*").alias("n"), F.max("weight").alias("total"), F.min("depth").alias("top"))
        sizes = spool(sizes)
        big = sizes.where(F.col("n") > component)
        # one row per component that still is large
        n_big = big.count()
        if not n_big:
            break

        def few(table: DataFrame, n: int = n_big) -> DataFrame:
            return F.broadcast(table) if n <= MAX_BROADCAST_ROWS else table

        large = big.select(*comp, "total", "top")
        done.append(_finished(active.join(few(large.select(*comp)), comp, "left_anti"), values))
        within = active.join(few(large), comp)
        lowest = F.min_by(F.struct("a", "b", "conv", "depth", "weight"), "weight")
        centroids = within.where(2 * F.col("weight") >= F.col("total")).groupBy(*comp, "top").agg(lowest.alias("c"))
        centroids = spool(centroids)
        passing = centroids.select(*comp, F.col("c.a").alias("pa"), F.col("c.b").alias("pb"))
        # a conversation goes on from a centroid to one child
        below = seats.select("conv", *NODE, *PARENT).join(few(passing), PARENT)
        below = below.select(*comp, "conv", F.col("a").alias("child_a"), F.col("b").alias("child_b"))
        ways = centroids.select(F.col("c.conv").alias("conv"), F.col("c.depth").alias("end"), "top")
        # a conversation may be the smallest member of several centroids; their paths have no node in common
        path = seats.select("conv", "depth", *NODE).join(few(ways), "conv").where("depth >= top AND depth <= end")
        zeros = [F.lit(0).cast("bigint").alias(c) for c in NODE]
        path = path.select(*NODE).unionByName(ways.where("top = 0").limit(1).select(*zeros))

        marked = within.drop("total", "top").join(few(centroids.drop("top")), comp)
        marked = marked.join(below, [*comp, "conv"], "left").join(path.withColumn("on_path", F.lit(True)), NODE, "left")
        is_centroid = (F.col("a") == F.col("c.a")) & (F.col("b") == F.col("c.b"))
        marked = spool(marked.withColumns({
            "is_centroid": is_centroid,
            "is_below": F.col("child_a").isNotNull() & (F.col("depth") > F.col("c.depth")),
        }))
        totals = marked.where("is_centroid OR is_below").groupBy(*comp)
        moved = marked.join(few(totals.agg(*[F.sum(v).alias(f"all_{v}") for v in values])), comp)
        on_path = F.coalesce("on_path", F.lit(False))
        moved = spool(moved.select(
            *[c for c in slim if c != "weight"],
            F.when(on_path & ~F.col("is_centroid"), F.col("weight") - F.col("c.weight")).otherwise(F.col("weight")).alias("weight"),
            *values,
            *[F.when(on_path, F.col(s) + F.col(f"all_{v}")).otherwise(F.col(s)).alias(s) for s, v in zip(sums, values, strict=True)],
            *[F.when(F.col("is_below"), F.col(f"child_{n}")).otherwise(F.col(c)).alias(c) for c, n in zip(comp, NODE, strict=True)],
            "is_centroid",
        ))
        done.append(moved.where("is_centroid").select(*NODE, *[F.col(s).alias(v) for s, v in zip(sums, values, strict=True)]))
        active = moved.where("NOT is_centroid").drop("is_centroid")
    result = _finished(active, values)
    for part in done:
        result = result.unionByName(part)
    return result


def forest_sums(parent: list[int], weight: list[int], values: list[list[int]]) -> list[list[int]]:
    """Subtree sums in a forest by centroid decomposition; parents (-1 for a top) stand before their children."""
    parent, weight = list(parent), list(weight)
    n = len(parent)
    comp = list(range(n))
    for i, p in enumerate(parent):
        if p >= 0:
            comp[i] = comp[p]
    sums = [[0] * n for _ in values]
    alive = list(range(n))
    while alive:
        centroid: dict[int, int] = {}
        for i in alive:
            # the last in order is the lowest
            if 2 * weight[i] >= weight[comp[i]]:
                centroid[comp[i]] = i
        tops = {i: i for i in centroid.values()}
        total = {c: [v[c] for v in values] for c in tops}
        fresh: dict[int, int] = {}
        for i in alive:
            p, c = parent[i], centroid[comp[i]]
            if i == c or p < 0:
                continue
            if p == c:
                fresh[i] = i
            elif p in fresh:
                fresh[i] = fresh[p]
            else:
                continue
            own = total[c]
            for k, v in enumerate(values):
                own[k] += v[i]
        for c, own in total.items():
            node, gone = c, weight[c]
            while node >= 0:
                for k, add in enumerate(own):
                    sums[k][node] += add
                if node != c:
                    weight[node] -= gone
                node = parent[node]
        for i, top in fresh.items():
            comp[i] = top
            if i == top:
                parent[i] = -1
        alive = [i for i in alive if i not in tops]
    return sums


def _finished(active: DataFrame, values: Sequence[str]) -> DataFrame:
    """(node, values) of components that a task holds whole."""
    names = [*NODE, *values]

    def solve(rows: pa.Table) -> pa.RecordBatch:
        data = {c: rows.column(c).to_pylist() for c in rows.column_names}
        # a top's parent is in another component
        place = {key: i for i, key in enumerate(zip(data["ca"], data["cb"], data["a"], data["b"], strict=True))}
        parents = [place.get(key, -1) for key in zip(data["ca"], data["cb"], data["pa"], data["pb"], strict=True)]
        made = forest_sums(parents, data["weight"], [data[v] for v in values])
        columns = [data["a"], data["b"], *[[x + y for x, y in zip(m, data[f"sum_{v}"], strict=True)] for m, v in zip(made, values, strict=True)]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come by component and depth; batches are cut between components
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ca, cb = batch.column("ca").to_numpy(), batch.column("cb").to_numpy()
            last = int(np.flatnonzero((ca != ca[-1]) | (cb != cb[-1])).max(initial=-1)) + 1
            if held and (held[0].column("ca")[0].as_py(), held[0].column("cb")[0].as_py()) != (ca[0], cb[0]):
                yield solve(pa.Table.from_batches(held))
                held = []
            if last:
                yield solve(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield solve(pa.Table.from_batches(held))

    dealt = active.repartition("ca", "cb").sortWithinPartitions("ca", "cb", "depth")
    return dealt.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def list_digests(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """(node, sha256) of the rows (node, conv): the SHA-256 of the numbers in order, joined by commas.

    A range of the sorted rows becomes pieces of text, so what one task must put in
    order for a node is a row for every ``piece`` numbers, and it holds one at a time.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, []

        def made() -> pa.RecordBatch:
            columns = [pa.array([x], pa.int64()) for x in (*key, own[0])]
            return pa.RecordBatch.from_arrays([*columns, pa.array([",".join(map(str, own))])], names=["a", "b", "first", "said"])

        for batch in batches:
            for a, b, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, b) != key or len(own) >= piece:
                    if own:
                        yield made()
                    key, own = (a, b), []
                own.append(conv)
        if own:
            yield made()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        out: list[tuple[Any, ...]] = []

        def made() -> pa.RecordBatch:
            a, b, sha = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sha)], names=["a", "b", "sha256"])

        for batch in batches:
            for a, b, said in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if (a, b) != key:
                    if state is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = (a, b), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(said.encode())
            if out:
                yield made()
        if state is not None:
            out.append((*key, state.hexdigest()))
            yield made()

    order = ["a", "b", "conv"]
    texts = rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    texts = texts.mapInArrow(pieces, "a bigint, b bigint, first bigint, said string")
    dealt = texts.repartition("a", "b").sortWithinPartitions("a", "b", "first")
    return dealt.mapInArrow(digests, "a bigint, b bigint, sha256 string")


def trie(turns: DataFrame, family: int = FAMILY, borrowed: int = BORROWED, component: int = COMPONENT) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations, from the root down.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256) as in ``op12``'s query. ``turns`` has conv_id, turn, role and text; null
    roles and texts are empty, a null turn comes first, turns of one number follow role
    and digest of the text, and repeated rows are turns of their own. Rows without a
    conv_id belong to no conversation and are left out. An empty table has no node.
    Other columns are not read.
    """
    ship(turns.sparkSession)
    seats, convs = rebuild(turns, family, borrowed)
    nodes = nodes_of(seats, convs)
    sums = subtree_sums(nodes.drop("n_convs", "n_children"), seats, ["leaf", "saved"], component)
    zero = F.lit(0).cast("bigint")
    ends = seats.where("left = 1").select(*NODE, "conv").unionByName(
        convs.where("turns = 0").select(zero.alias("a"), zero.alias("b"), "conv")
    )
    found = nodes.drop("leaf", "saved", "weight").join(sums.withColumnsRenamed({"leaf": "n_leaves", "saved": "saved_tokens"}), NODE)
    found = found.join(list_digests(ends), NODE, "left")
    parents = nodes.select(*[F.col(n).alias(p) for n, p in zip(NODE, PARENT, strict=True)], F.col("conv").alias("parent_conv_id"))
    found = _tied(found, parents, PARENT, "left")
    return found.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
