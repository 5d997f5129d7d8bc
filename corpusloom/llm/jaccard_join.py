"""Similarity join of shingle sets under a Jaccard threshold by PartEnum signatures.

Two sets of a and b shingles with |A & B| >= s |A | B| differ in at most
d = (1 - s) / (1 + s) (a + b) shingles. The domain is dealt by hash into parts, more for
larger sets: sets of one size band use one number of parts, and a set near the upper
end of its band also signs for the next one, so similar sets meet in a band. The
content of a part is a signature. At most d parts that hold anything of A or B differ,
so under any global order of the signatures the first d + 1 of either set have one in
common; that subset of the parts is what a set enumerates. Parts with most shingles
come first, because one shingle alone is often shared by chance. A set whose non-empty
parts are too few for that bound signs, besides, for what its parts keep when shingles
are missing, which only sets like it need.

The bound is exact: no link is lost, whatever the hash does, and every candidate is
verified by its whole set. Candidates come from two rounds. In the first each set
meets only the least and the next set of a signature's group; verified links make
components. In the second only groups that still hold several components are compared,
across components. A group beyond ``SPLIT`` sets is dealt into blocks before the shuffle and
every two blocks are a group of their own, so no task holds or compares more; and a pair is verified only if two bounds allow it: an upper bound of
its overlap from hashed counts, and the number of signatures it must share at least
(with k and l signatures, all but d of the fewer). So a group of thousands of near
copies costs a star, and a phrase that many texts share costs little output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.ship import ship
from corpusloom.llm.texts import MAX_WORDS, Grown, WordIds, column, held, per_text
from corpusloom.operators.lookups import fits_broadcast, lookup_join
from corpusloom.sources.cache import spool

WORDS = 5
#: The threshold as a fraction: 100 * common >= 75 * union.
THRESHOLD = (75, 100)
#: Mean shingles of a part for a set at the upper end of its band.
PART = 2.4
#: Bins of the hashed counts that bound an overlap from above.
BINS = 512
#: Share of its signatures that a pair must have in common to be verified in the first round already.
EARLY = 0.125
#: Groups are compared in blocks of so many sets.
BLOCK = 512
#: Sets of a block of a group; a task holds at most two blocks of one group.
SPLIT = 4096
#: Pairs a task adds up before it passes them on.
HELD = 500_000

M = np.uint64
_FACTORS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], M
)

SIGNED = T.StructType(
    [
        T.StructField("n", T.LongType(), False),
        T.StructField("digest_a", T.LongType(), False),
        T.StructField("digest_b", T.LongType(), False),
        T.StructField("signatures", T.ArrayType(T.LongType(), False), False),
        T.StructField("k", T.LongType(), False),
        T.StructField("bins", T.BinaryType(), False),
    ]
)
SETS = T.StructType([T.StructField("members", T.BinaryType(), False)])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input sways every bit of the result."""
    x = (x ^ (x >> M(33))) * M(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> M(33))) * M(0xC4CEB9FE1A85EC53)
    return x ^ (x >> M(33))


class WordHashes:
    """64-bit hash per distinct word, kept per worker."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.words, self.values = WordIds(), Grown(M)

    def of(self, words: list[bytes]) -> np.ndarray:
        ids = self.words.ids(words)
        if self.words.fresh:
            self.values.add([xxhash.xxh64_intdigest(w) for w in self.words.take_fresh()])
        return self.values.values[ids]


def _hashes() -> WordHashes:
    return held("jaccard_join", "words", WordHashes)


def shingles(text: bytes | None, width: int = WORDS) -> np.ndarray:
    """Distinct hashes of a text's word shingles, in order; A-Z count as a-z."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, M)
    hashes = _hashes().of(words)
    w = min(width, len(words))
    n = len(words) - w + 1
    total = np.full(n, w, M)
    for i in range(w):
        total += mix(hashes[i : i + n] + _FACTORS[i % 5] * M(i // 5 + 1))* _FACTORS[i % 5]
    return np.unique(mix(total))


def _deletions(part: np.ndarray, threshold: tuple[int, int]) -> list[np.ndarray]:
    """What may be left of a part: it without each choice of shingles that a similar part may lack.

    A similar pair has a part whose own sets are as similar, so with o common shingles
    the two lack at most (1 - s) / s * o of the other's; each side enumerates its own.
    """
    from itertools import combinations

    low, high = threshold
    made = []
    for gone in range(len(part)):
        common = len(part) - gone
        if gone * low > (high - low) * common:
            break
        made += [np.delete(part, list(c)) for c in combinations(range(len(part)), gone)]
    return made


def signatures(members: np.ndarray, threshold: tuple[int, int] = THRESHOLD) -> tuple[np.ndarray, int]:
    """The signatures of one set, for its band and, near the band's end, for the next.

    And the fewest of them, in a band, that are of whole parts.
    """
    a = len(members)
    if not a:
        return np.zeros(0, M), 0
    low, high = threshold
    # most differing shingles against any partner, the largest of which has a / s of them
    most = (a * high // low + a) * (high - low) // (high + low)
    band = a.bit_length() - 1
    found, fewest = [], most + 1
    for b in (band, band + 1):
        if b > band and a * high < low * 2**b:
            continue
        parts = max(1, int(2 ** (b + 1) / PART))
        part = (members >> M(32)) % M(parts)
        order = np.argsort(part, kind="stable")
        dealt, inside = part[order], members[order]
        starts = np.flatnonzero(np.concatenate([[True], dealt[1:] != dealt[:-1]]))
        sizes = np.diff(np.append(starts, a))
        seal = dealt[starts] * _FACTORS[0] + np.full(1, b, M) * _FACTORS[1]
        values = mix(np.add.reduceat(inside, starts) + seal)
        found.append(values[np.lexsort((values, -sizes))[: most + 1]])
        fewest = min(fewest, len(values))
        if len(values) <= most:
            # apart from the signatures above, so that only sets like this one meet here
            for k, (start, size) in enumerate(zip(starts, sizes, strict=True)):
                left = _deletions(inside[start : start + size], threshold)
                found.append(mix(np.array([x.sum(dtype=M) for x in left], M) + seal[k] + _FACTORS[2]))
    return np.unique(np.concatenate(found)), fewest


def _digest(members: np.ndarray) -> tuple[int, int]:
    raw = xxhash.xxh3_128_intdigest(members.tobytes())
    return (raw >> 64) - (1 << 63), (raw & ((1 << 64) - 1)) - (1 << 63)


def _bins(members: np.ndarray) -> bytes:
    """Hashed counts, cut at 255, which still bounds the overlap of sets that stay below."""
    return np.minimum(np.bincount((members & M(BINS - 1)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes()


def _worker_hashes() -> None:
    if len(_hashes().words) > MAX_WORDS:
        _hashes().clear()


def sign(docs: DataFrame, text: str, keep: list[str], width: int = WORDS, threshold=THRESHOLD) -> DataFrame:
    """(row, out): set size, digest, signatures and hashed counts of every text."""

    def kernel():
        def work(texts):
            _worker_hashes()
            sets = [shingles(t, width) for t in texts]
            digests = [_digest(s) for s in sets]
            signed = [signatures(s, threshold) for s in sets]
            return {
                "n": pa.array([len(s) for s in sets], pa.int64()),
                "digest_a": pa.array([d[0] for d in digests], pa.int64()),
                "digest_b": pa.array([d[1] for d in digests], pa.int64()),
                "signatures": pa.array([v.view(np.int64) for v, _ in signed], pa.list_(pa.int64())),
                "k": pa.array([k for _, k in signed], pa.int64()),
                "bins": pa.array([_bins(s) for s in sets], pa.binary()),
            }

        return work

    return per_text(docs, text, kernel, SIGNED, keep)


def members(docs: DataFrame, text: str, keep: list[str], width: int = WORDS) -> DataFrame:
    """(row, out.members): the sorted shingle hashes of every text."""

    def kernel():
        def work(texts):
            _worker_hashes()
            return {"members": pa.array([shingles(t, width).tobytes() for t in texts], pa.binary())}

        return work

    return per_text(docs, text, kernel, SETS, keep)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows cut between two signatures: whole groups, as many as a batch brings."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        last = int(np.searchsorted(keys, keys[-1], side="left"))
        if held and held[0].column(0)[0].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sig, id, hub, next): of groups of two sets or more, the least set and the one before in the group.

    Streams over rows in order of (sig, id) and holds one row, so a group of any size passes.
    """
    key = least = before = None
    for batch in batches:
        sig, ident = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(sig):
            continue
        fresh = np.empty(len(sig), bool)
        fresh[0] = key is None or sig[0] != key
        fresh[1:] = sig[1:] != sig[:-1]
        group = np.cumsum(fresh)
        heads = ident[fresh]
        hub = heads[group - 1] if fresh[0] else np.where(group == 0, least, heads[group - 1] if len(heads) else least)
        prior = np.concatenate([[before if before is not None else ident[0]], ident[:-1]])
        key, least, before = sig[-1], hub[-1], ident[-1]
        rest = ~fresh & (ident != hub)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x[rest], pa.int64()) for x in (sig, ident, hub, prior)], names=["sig", "id", "hub", "prior"]
        )


def _may_reach(n_x, n_y, bins_x: np.ndarray, bins_y: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """False where the hashed counts prove that two sets share too little."""
    low, high = threshold
    least = np.minimum(bins_x, bins_y)
    return (least.sum(axis=1, dtype=np.int64) * (low + high) >= low * (n_x + n_y)) | (least.max(axis=1) == 255)


def _bin_rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS)


def _plausible(threshold: tuple[int, int]):
    """Keeps the pairs (a, b) whose sizes and hashed counts let them be similar."""
    low, high = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            kept = (x * high >= low * y) & (y * high >= low * x)
            kept &= _may_reach(x, y, _bin_rows(batch.column(3)), _bin_rows(batch.column(5)), threshold)
            mask = pa.array(kept, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(mask) for i in (0, 1)], names=["a", "b"])

    return run


def _cells(seats: DataFrame, split: int = SPLIT) -> DataFrame:
    """(cell, id, comp, side): the seats (sig, id, comp) of every two blocks of a group.

    A group of up to ``split`` seats is one cell of side 2. A larger one is dealt into
    blocks by a hash of the id; a cell holds one block, of side 2, or two, of sides 0
    and 1, so each pair of a group meets in exactly one cell.
    """
    large = spool(
        seats.groupBy("sig").agg(F.count("*").alias("n")).where(F.col("n") > split)
        .select("sig", F.ceil(F.col("n") / F.lit(split)).cast("int").alias("blocks"))
    )
    seats = lookup_join(seats, large, "sig", "left", ["id"])
    whole = seats.where("blocks IS NULL").select(F.col("sig").alias("cell"), "id", "comp", F.lit(2).alias("side"))
    own = F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks").cast("bigint")).cast("int")
    dealt = seats.where("blocks IS NOT NULL").withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    cell = F.xxhash64("sig", F.least("own", "other"), F.greatest("own", "other"))
    return whole.unionByName(dealt.select(cell.alias("cell"), "id", "comp", side.alias("side")))


def _across(threshold: tuple[int, int]):
    """Pairs across components in a cell of a signature's group whose overlap can still suffice."""
    low, high = threshold

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        pairs, shared = np.unique(np.concatenate(held), axis=0, return_counts=True)
        columns = (pairs[:, 0], pairs[:, 1], shared)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["a", "b", "shared"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        waiting = 0
        for table in _runs(batches):
            sig, ident, comp, n, side = (table.column(c).to_numpy() for c in ("cell", "id", "comp", "n", "side"))
            bins = _bin_rows(table.column("bins"))
            starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            ends = np.append(starts[1:], len(sig))
            found = []
            for start, end in zip(starts, ends, strict=True):
                # by size, so a block meets only the blocks whose sizes can match
                order = start + np.argsort(n[start:end], kind="stable")
                for i in range(0, len(order), BLOCK):
                    one = order[i : i + BLOCK]
                    for j in range(i, len(order), BLOCK):
                        two = order[j : j + BLOCK]
                        if n[one[-1]] * high < low * n[two[0]]:
                            break
                        ok = (comp[one][:, None] != comp[two][None, :]) & (
                            n[one][:, None] * high >= low * n[two][None, :]
                        )
                        ok &= n[two][None, :] * high >= low * n[one][:, None]
                        # of two blocks only pairs across them
                        ok &= (side[one][:, None] == 2) | (side[one][:, None] != side[two][None, :])
                        if i == j:
                            ok &= np.triu(np.ones(ok.shape, bool), 1)
                        x, y = np.nonzero(ok)
                        for k in range(0, len(x), 20_000):
                            p, q = one[x[k : k + 20_000]], two[y[k : k + 20_000]]
                            enough = _may_reach(n[p], n[q], bins[p], bins[q], threshold)
                            found.append(np.stack([ident[p[enough]], ident[q[enough]]], axis=1))
            if found:
                pairs = np.concatenate(found)
                held.append(np.stack([pairs.max(axis=1), pairs.min(axis=1)], axis=1))
                waiting += len(pairs)
            if waiting > HELD:
                yield counted(held)
                held, waiting = [], 0
        if held:
            yield counted(held)

    return run


def _similar(low: int, high: int):
    """Keeps the pairs whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [[np.frombuffer(x, M) for x in batch.column(c).to_pylist()] for c in (2, 3)]
            common = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sets, strict=True)]
            kept = [
                c * high >= low * (len(x) + len(y) - c) for c, x, y in zip(common, *sets, strict=True)
            ]
            mask = pa.array(kept, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(mask) for i in (0, 1)], names=["a", "b"])

    return run


def verify(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose sets (id, members) reach the threshold."""
    first = sets.select(F.col("id").alias("a"), F.col("members").alias("x"))
    second = sets.select(F.col("id").alias("b"), F.col("members").alias("y"))
    both = pairs.join(second, "b").join(first, "a").select("a", "b", "x", "y")
    return both.mapInArrow(_similar(*threshold), "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(id, component): the least id reachable from every id that has a link (a, b).

    Large-star and small-star steps in turn, so long chains take a logarithm of rounds;
    every round is a stored table. Ids that have no link are not returned.
    """
    edges = spool(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        roots = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(roots, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.*")
            .where("a <> b")
            .distinct()
        )
        edges = spool(small)
        new = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if new == state:
            break
        state = new
    found = edges.groupBy("a").agg(F.min("b").alias("component"))
    return found.select(F.col("a").alias("id"), "component").unionByName(
        found.select(F.col("component").alias("id"), "component").distinct()
    )


def join(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    width: int = WORDS,
    threshold: tuple[int, int] = THRESHOLD,
    split: int = SPLIT,
) -> DataFrame:
    """(key, n_shingles, component_id) of every row: set size and the least key reachable by links.

    Keys are whole numbers. A null or empty text has no shingles and no link; a text
    shorter than a shingle is one shingle of all its words. Copies of a set are one
    class, told by size and a 128-bit digest, and only its least key is compared.
    Rows with a null key get their set size and a null component; repeated keys are
    linked by every text they bear. Other columns are not read.
    """
    low, high = threshold
    if not high < 2 * low <= 2 * high:
        raise ValueError("the threshold must be over one half")
    spark = docs.sparkSession
    ship(spark)
    signed = spool(
        sign(docs, text, [key], width, threshold).select(F.col("row").getField(key).cast("bigint").alias("id"), "out.*")
    )
    whole = signed.where("n > 0 AND id IS NOT NULL")
    classes = spool(
        whole.groupBy("n", "digest_a", "digest_b").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    )
    # the class of a copy; lone sets, most of them, need no lookup
    digest = ["n", "digest_a", "digest_b"]
    several = classes.where("copies > 1").drop("copies")
    member = lookup_join(whole.select("id", *digest), several, digest, "left", ["id"])
    member = spool(member.withColumn("rep", F.coalesce("rep", "id")))
    n_rows, n_ids = member.agg(F.count("*"), F.count_distinct("id")).first()
    copies = member.where("id <> rep").select("id", *digest).distinct()
    heads = whole.join(F.broadcast(copies) if fits_broadcast(copies) else copies, ["id", *digest], "left_anti")

    rows = heads.select(F.explode("signatures").alias("sig"), "id")
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(n_parts, "sig").sortWithinPartitions("sig", "id")
    groups = spool(ordered.mapInArrow(_stars, "sig bigint, id bigint, hub bigint, prior bigint"))

    # first round: least and previous set of every group, if they share many signatures
    near = (
        groups.select(F.col("id").alias("a"), F.col("hub").alias("b"))
        .unionByName(groups.where("prior <> hub").select(F.col("id").alias("a"), F.col("prior").alias("b")))
        .where("a <> b")
        .groupBy("a", "b")
        .agg(F.count("*").alias("shared"))
    )
    sketch = heads.select("id", "n", "k", "bins")
    near = near.join(sketch.select(F.col("id").alias("a"), F.col("n").alias("n_a"), "k", F.col("bins").alias("bins_a")), "a")
    near = near.where(F.col("shared") >= EARLY * F.col("k"))
    near = near.join(sketch.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("bins").alias("bins_b")), "b")
    near = near.select("a", "b", "n_a", "bins_a", "n_b", "bins_b")
    near = spool(near.mapInArrow(_plausible(threshold), "a bigint, b bigint"))
    links = spool(verify(near, _sets(docs, key, text, near, width, n_rows > n_ids), threshold))
    early = spool(components(links))

    # second round: groups that still hold several components
    seats = groups.select("sig", "id").unionByName(groups.select("sig", F.col("hub").alias("id")).distinct())
    seats = seats.join(early, "id", "left").select("sig", "id", F.coalesce("component", "id").alias("comp"))
    seats = spool(seats)
    mixed = seats.groupBy("sig").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("sig")
    cells = _cells(spool(seats.join(mixed, "sig").select("sig", "id", "comp")), split)
    cells = cells.join(sketch, "id").select("cell", "id", "comp", "n", "bins", "side")
    across = cells.repartition(n_parts, "cell").sortWithinPartitions("cell")
    across = across.mapInArrow(_across(threshold), "a bigint, b bigint, shared bigint")
    across = across.groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    for side in ("a", "b"):
        across = across.join(sketch.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("k").alias(f"k_{side}")), side)
    differ = F.floor((F.col("n_a") + F.col("n_b")) * (high - low) / (high + low))
    across = across.where(F.col("shared") >= F.least("k_a", "k_b") - differ).select("a", "b")
    across = spool(across)
    late = verify(across, _sets(docs, key, text, across, width, n_rows > n_ids), threshold)

    edges = early.where("id <> component").toDF("a", "b").unionByName(late)
    if n_rows > n_ids:
        # a key that bears several texts ties their classes
        edges = edges.unionByName(copies.join(member, ["id", *digest]).select(F.col("id").alias("a"), F.col("rep").alias("b")))
    final = components(edges)
    tied = lookup_join(member.select("id", "rep"), final.toDF("rep", "component"), "rep", "left", ["id"])
    return _every_row(signed, tied.select("id", F.coalesce("component", "rep").alias("component_id")), key)


def _sets(docs: DataFrame, key: str, text: str, pairs: DataFrame, width: int, repeated: bool) -> DataFrame:
    """(id, members) of the rows that stand in a pair, each set once."""
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = spool(wanted)
    texts = docs.select(column(key).cast("bigint").alias("id"), column(text).alias("t"))
    texts = texts.join(F.broadcast(wanted) if fits_broadcast(wanted) else wanted, "id")
    sets = members(texts, "t", ["id"], width).select("row.id", "out.members")
    return spool(sets.distinct() if repeated else sets)


def _every_row(signed: DataFrame, found: DataFrame, key: str) -> DataFrame:
    found = found.groupBy("id").agg(F.min("component_id").alias("component_id"))
    joined = signed.select("id", "n").join(found, "id", "left")
    return joined.select(
        F.col("id").alias(key),
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "id").alias("component_id"),
    )
