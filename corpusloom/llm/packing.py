"""Best-fit packing of documents into sequences under three capacities.

Every sequence has room for tokens, documents and attention cost (the sum of the
squared piece lengths, what block-diagonal attention pays). Pieces are placed in
falling size; among the open sequences that have room in *every* dimension the one
is taken whose residual after placing has the smallest weighted norm
(``rule="norm"``), or whose residual has the largest weighted dot product with the
piece's demand (``rule="dot"``).

Full pieces fill a sequence alone and are never moved. The others, a few numbers per
row, are dealt by a hash of a stored row number into groups of about ``GROUP`` pieces
each; a group is packed in one task, so memory is bounded whatever the input, and
the loss against one global packing is a fraction of a sequence per group. Texts and
token ids are not shuffled to find the plan.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import texts
from corpusloom.llm.ship import ship
from corpusloom.llm.texts import column, held, per_text
from corpusloom.llm.vocabularies import public_path
from corpusloom.sources.cache import spool

CAPACITY = 2048
#: An id that ends every document.
END = 0
#: Pieces packed together in one task.
GROUP = 20_000
#: Distinct words a worker remembers, about 200 bytes each; beyond it the table starts anew.
MAX_WORDS = 2 * texts.MAX_WORDS

_END = struct.pack("<I", END)

TOKENS = T.StructType(
    [
        T.StructField("n_ids", T.LongType(), False),
        T.StructField("crcs", T.ArrayType(T.LongType(), False), False),
        T.StructField("ids", T.BinaryType(), True),
    ]
)
PLACES = "_rid bigint, sequence_id bigint, offset bigint"


class WordBytes(dict):
    """Word -> its ids as little-endian unsigned 32-bit integers.

    The vocabulary splits at white space and never across it, so a text's ids are
    those of its words. Plain words are encoded many at a time; where the vocabulary
    marks the last token of a word, that mark tells them apart.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        known, suffix = self.tokenizer.get_vocab(), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        #: Per id, whether it ends a word; none where the vocabulary has no such mark.
        self.last = None
        if suffix:
            self.last = np.zeros(max(known.values()) + 1, bool)
            self.last[[i for token, i in known.items() if token.endswith(suffix)]] = True

    def learn(self, words: Iterable[bytes]) -> None:
        """Take in the words that are not there yet."""
        plain, odd = [], []
        for word in words:
            if word not in self:
                (plain if word.isalpha() or _PLAIN(word) else odd).append(word)
        for start in range(0, len(plain), 2000):
            some = plain[start : start + 2000]
            text = b" ".join(some).decode()
            if self.last is None:
                found = self.tokenizer.encode(text, add_special_tokens=False)
                ids, run = np.array(found.ids, "<u4"), np.array(found.word_ids)
                ends = [*(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), len(ids)]
            else:
                # no character positions are kept, which cost as much as the merging
                (found,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
                ids = np.array(found.ids, "<u4")
                ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
            if len(ends) != len(some) or ends[-1] != len(ids):
                raise ValueError("the vocabulary does not split at white space")
            raw = ids.tobytes()
            self.update(zip(some, [raw[4 * i : 4 * j] for i, j in zip([0, *ends], ends)], strict=True))
        for word in odd:
            ids = self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
            self[word] = struct.pack(f"<{len(ids)}I", *ids)

    def of(self, words: list[bytes]) -> list[bytes]:
        """The ids of every word."""
        found = list(map(self.get, words))
        new = [i for i, ids in enumerate(found) if ids is None]
        self.learn([words[i] for i in new])
        for i in new:
            found[i] = self[words[i]]
        return found


#: Letters of Latin-1 alone: one run for the vocabulary, and untouched by its normal form.
_PLAIN = re.compile(rb"[a-zA-Z]*(?:\xc3[\x80-\x96\x98-\xb6\xb8-\xbf][a-zA-Z]*)+").fullmatch


def _bytes_of(some: bytes) -> np.ndarray:
    """Whether a byte is one of some."""
    found = np.zeros(256, bool)
    found[list(some)] = True
    return found


_BLANK = _bytes_of(b" \t\n\v\f\r")
#: Punctuation behind a letter or digit up to white space is a run of its own for the vocabulary.
_MARK = _bytes_of(b".,!?;:%*&#$")
_LETTER = _bytes_of(b"abcdefghijklmnopqrstuvwxyz0123456789")
#: Second byte of a letter of Latin-1, behind 0xC3.
_ACCENTED = _bytes_of(bytes([*range(0x80, 0x97), *range(0x98, 0xB7), *range(0xB8, 0xC0)]))


def split_texts(texts: Sequence[bytes | None]) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Parts that the vocabulary encodes one by one, and the places among them where texts begin and the last one ends.

    Parts are words, and the punctuation that ends them. Case is folded as the
    vocabulary does, but for a text that may hold one of its special strings, which
    have a case.
    """
    lowered = [t if b"<|" in t else t.lower() for t in (t or b"" for t in texts)]
    raw = np.frombuffer(b"\n".join([b"", *lowered, b""]), np.uint8)
    inside, mark = ~_BLANK[raw], _MARK[raw]
    starts, ends = _edges(inside)
    first, behind = _edges(mark)
    before = raw[first - 1]
    run = _LETTER[before] | (_ACCENTED[before] & (raw[first - 2] == 0xC3))
    cuts = first[run & ~inside[behind]]
    starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])]
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), buffers)
    begins = np.cumsum([1, *(len(t) + 1 for t in lowered)])
    return np.searchsorted(starts, begins), words.dictionary_encode()


def _edges(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs begin, and the places behind their ends; neither the first nor the last value is in a run."""
    turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    return turns[::2], turns[1::2]


def piece_crcs(ids: memoryview, step: int) -> list[int]:
    """The CRC-32 of every ``step`` bytes of the ids with the closing one."""
    crcs = [zlib.crc32(ids[i : i + step]) for i in range(0, len(ids), step)]
    if len(ids) % step:
        crcs[-1] = zlib.crc32(_END, crcs[-1])
    else:
        crcs.append(zlib.crc32(_END))
    return crcs


def tokenise(
    docs: DataFrame,
    text: str = "text",
    vocabulary: str | None = None,
    capacity: int = CAPACITY,
    with_ids: bool = False,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """(row, out): number of ids with the closing one, the CRC-32 of every piece, and the ids if asked.

    A null or empty text has the closing id alone.
    """
    path = vocabulary or public_path("word_bpe_49k.json")
    step = 4 * capacity

    def kernel():
        table = held("packing", path, lambda: WordBytes(path))

        def work(batch):
            if len(table) > MAX_WORDS:
                table.clear()
            bounds, words = split_texts(batch)
            known = table.of(words.dictionary.to_numpy(zero_copy_only=False).tolist())
            ids = pa.array(known, pa.large_binary()).take(words.indices)
            _, ends, joined = ids.buffers()
            ends = np.frombuffer(ends, np.int64)[ids.offset + bounds].tolist()
            whole = memoryview(joined or b"")
            made = [whole[i:j] for i, j in zip(ends, ends[1:])]
            return {
                "n_ids": pa.array([len(m) // 4 + 1 for m in made], pa.int64()),
                "crcs": pa.array([piece_crcs(m, step) for m in made], pa.list_(pa.int64())),
                "ids": pa.array([bytes(m) + _END for m in made] if with_ids else [None] * len(made), pa.binary()),
            }

        return work

    return per_text(docs, text, kernel, TOKENS, keep)


def cut(tokens: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(row, piece, start, length, ids_crc32, ids): the pieces of at most ``capacity`` ids of every text."""
    pieces = tokens.select("row", "out.n_ids", "out.ids", F.posexplode("out.crcs").alias("piece", "ids_crc32"))
    start = F.col("piece").cast("bigint") * capacity
    length = F.least(F.lit(capacity).cast("bigint"), F.col("n_ids") - start)
    return pieces.select(
        "row",
        "piece",
        start.alias("start"),
        length.alias("length"),
        "ids_crc32",
        F.when(
            F.col("ids").isNotNull(),
            F.substring("ids", (start * 4 + 1).cast("int"), (length * 4).cast("int")),
        ).alias("ids"),
    )


def best_fit(
    lengths: np.ndarray,
    capacities: Sequence[float],
    weights: Sequence[float],
    rule: str = "norm",
) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of every piece; pieces are placed longest first, ties in the given order."""
    order = np.argsort(-lengths, kind="stable")
    room = np.array(capacities, float)
    scale = np.array(weights, float) / room
    bins = np.zeros(len(lengths), np.int64)
    offsets = np.zeros(len(lengths), np.int64)
    # columns: tokens, documents, attention cost; only sequences that may still take a piece are kept
    free = np.zeros((3, 1024))
    names = np.zeros(1024, np.int64)
    n_open = n_bins = 0
    shortest = float(lengths.min()) if len(lengths) else 0.0
    for at in order:
        size = float(lengths[at])
        need = (size, 1.0, size * size)
        view = free[:, :n_open]
        fits = np.flatnonzero((view[0] >= need[0]) & (view[1] >= need[1]) & (view[2] >= need[2]))
        if len(fits):
            left = view[:, fits]
            if rule == "norm":
                gaps = (left - np.array(need)[:, None]) * scale[:, None]
                k = int(fits[int((gaps * gaps).sum(axis=0).argmin())])
            else:
                k = int(fits[int(((scale * np.array(need)) @ (left / room[:, None])).argmax())])
        else:
            if n_open == free.shape[1]:
                free = np.concatenate([free, np.zeros_like(free)], axis=1)
                names = np.concatenate([names, np.zeros_like(names)])
            k = n_open
            free[:, k] = room
            names[k] = n_bins
            n_open, n_bins = n_open + 1, n_bins + 1
        bins[at] = names[k]
        offsets[at] = int(room[0] - free[0, k])
        free[0, k] -= need[0]
        free[1, k] -= need[1]
        free[2, k] -= need[2]
        if free[0, k] < shortest or free[1, k] < 1 or free[2, k] < shortest * shortest:
            n_open -= 1
            free[:, k] = free[:, n_open]
            names[k] = names[n_open]
    return bins, offsets


def pack(
    pieces: DataFrame,
    length: str = "length",
    capacity: int = CAPACITY,
    max_documents: int | None = None,
    max_attention: int | None = None,
    weights: Sequence[float] = (1.0, 0.05, 0.05),
    rule: str = "norm",
    group: int = GROUP,
) -> DataFrame:
    """The columns of ``pieces`` with ``sequence_id`` and ``offset`` (gapless from 0 in a sequence).

    ``max_documents`` and ``max_attention`` default to what ``capacity`` implies, so
    they bind only when set lower. A piece that exceeds a capacity by itself is
    refused with an error. Repeated rows are pieces of their own; ties in length go
    by the stored row number. An empty table stays empty.
    """
    if rule not in ("norm", "dot"):
        raise ValueError(f"rule must be norm or dot, not {rule}")
    ship(pieces.sparkSession)
    documents, attention = max_documents or capacity, max_attention or capacity * capacity
    if documents < 1:
        raise ValueError("a sequence must take a document")
    stored = spool(
        pieces.select(
            F.struct(*[column(c).alias(c) for c in pieces.columns]).alias("_row"),
            column(length).cast("bigint").alias("_length"),
            F.monotonically_increasing_id().alias("_rid"),
        )
    )
    alone = (F.col("_length") == capacity) & (F.col("_length") > 0)
    n, longest = stored.agg(
        F.coalesce(F.sum(F.when(alone, 0).otherwise(1)), F.lit(0)), F.max("_length")
    ).first()
    if longest is not None and (longest > capacity or longest * longest > attention):
        raise ValueError(f"a piece of {longest} tokens fits no sequence")
    groups = max(1, -(-n // group))
    capacities, shares = (capacity, documents, attention), tuple(weights)

    def place(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_rid")
        bins, offsets = best_fit(part["_length"].to_numpy(), capacities, shares, rule)
        base = int(part["_group"].iloc[0]) << 40
        return pd.DataFrame({"_rid": part["_rid"], "sequence_id": bins + base, "offset": offsets})

    # a number of partitions that is given keeps small groups from being merged into one task
    dealt = (
        stored.where(~alone)
        .select("_rid", "_length", F.pmod(F.xxhash64("_rid"), F.lit(groups)).cast("int").alias("_group"))
        .repartition(3 * groups, "_group")
    )
    placed = dealt.groupBy("_group").applyInPandas(place, PLACES)
    full = stored.where(alone).select("_row", (-1 - F.col("_rid")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    partial = stored.where(~alone).join(placed, "_rid").select("_row", "sequence_id", "offset")
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    return full.unionByName(partial).select(
        *[F.col("_row").getField(c).alias(c) for c in names], "sequence_id", "offset"
    )


def assemble(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, lengths): the token ids of every sequence and the lengths of its pieces, in place.

    A sequence has at most the capacity's ids, so a group is bounded.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    return (
        packed.groupBy("sequence_id")
        .agg(parts.alias("parts"))
        .select(
            "sequence_id",
            F.expr("aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.ids))").alias("ids"),
            F.col("parts.length").alias("lengths"),
        )
    )
