"""Byte-pair encoding by a deterministic automaton over tokens, and decoding by its arc labels.

The automaton starts as one state with an arc for every byte. Each merge (u, v), in
order of priority, is a gadget: where an arc u leads to a state with an arc v, u now
leads to a copy of that state without v, and a new arc uv spans both. What remains is
exactly the correct tokenizations: as each word has one, at most one path spells it.
All arcs of a label lead to one state throughout, so the automaton is a target per
token and a bit per (state, token); states with equal arcs are one, and tokens whose
arcs leave the same states share a column. Tables are bounded by the vocabulary.

A word is encoded by moving along its bytes: every prefix of it has one path, so every
position holds one state, and the labels that start there (a trie of the labels) are
followed where the state has the arc. That is linear in the word for any word, and the
arcs taken to its end are its tokens. Decoding joins the labels of the arcs.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.ship import ship
from corpusloom.llm.texts import column, held, per_text
from corpusloom.llm.vocabularies import public_path

VOCABULARY = "byte_bpe_50k.json"
#: Words a worker remembers, and bytes of a word beyond which it is not remembered.
MAX_CACHED, LONG_WORD = 500_000, 64
#: Fixed value: the pattern that splits words before byte-level encoding.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

IDS = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])
TEXT = T.StructType([T.StructField("text", T.StringType(), True)])


class Automaton(NamedTuple):
    """``target`` state and ``column`` per token; bits of states per column; the start state."""

    target: np.ndarray
    column: np.ndarray
    arcs: np.ndarray
    start: int


class Vocabulary(NamedTuple):
    """Tokens in order of their making: labels as bytes and public ids; whole strings that are one token."""

    automaton: Automaton
    labels: tuple[bytes, ...]
    ids: tuple[int, ...]
    special: tuple[tuple[str, int], ...]


def compile_merges(n_bytes: int, merges: Iterable[tuple[int, int]]) -> Automaton:
    """The automaton of merges; token numbers are ``n_bytes`` single ones and then one per merge."""
    merges = list(merges)
    n = n_bytes + len(merges)
    target = np.zeros(n, np.int64)
    # the start is entered without a label, which counts as one: no merge may take its arcs
    labels_into = [n_bytes + 1]
    # bit of a state, in words of 64 states, per token
    leaves = np.zeros((4, n), np.uint64)
    leaves[0, :n_bytes] = 1

    def split(token: int, known: int) -> None:
        """A state of the token's own, with the same arcs."""
        nonlocal leaves
        old, new = int(target[token]), len(labels_into)
        if new >= 64 * len(leaves):
            leaves = np.concatenate([leaves, np.zeros_like(leaves)])
        has = (leaves[old >> 6, :known] >> np.uint64(old & 63)) & np.uint64(1)
        leaves[new >> 6, :known] |= has << np.uint64(new & 63)
        labels_into[old] -= 1
        labels_into.append(1)
        target[token] = new

    for made, (u, v) in enumerate(merges, start=n_bytes):
        middle, behind = int(target[u]), int(target[v])
        labels_into[behind] += 1
        target[made] = behind
        if not int(leaves[middle >> 6, v]) >> (middle & 63) & 1:
            # earlier merges keep u and v from ever meeting; this one takes no part
            continue
        # behind uu the old state holds on, which counts the new token by now
        if labels_into[middle] > 1:
            split(u, made)
            middle = int(target[u])
        leaves[middle >> 6, v] &= ~np.uint64(1 << (middle & 63))
        leaves[:, made] = leaves[:, u]

    width = len(labels_into)
    leaves = np.ascontiguousarray(leaves.T).view(np.uint8)[:, : (width + 7) // 8]
    columns, column_of = _distinct(leaves)
    rows = np.unpackbits(columns, axis=1, count=width, bitorder="little").T
    rows, row_of = _distinct(np.packbits(rows, axis=1, bitorder="little"))
    arcs = np.unpackbits(rows, axis=1, count=len(columns), bitorder="little").T
    return Automaton(
        row_of[target].astype(np.int32),
        column_of.astype(np.int32),
        np.packbits(arcs, axis=1, bitorder="little"),
        int(row_of[0]),
    )


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows in order of first sight, and for every row which it is."""
    seen: dict[bytes, int] = {}
    which = np.array([seen.setdefault(row.tobytes(), len(seen)) for row in rows], np.int64)
    first = np.unique(which, return_index=True)[1]
    return np.ascontiguousarray(rows[first]), which


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for every byte: itself, or one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The compiled byte-level vocabulary of a tokenizer file.

    Every part of a merge must be a byte or made by an earlier merge, and options that
    change the encoding beyond that are an error.
    """
    with open(path, encoding="utf-8") as lines:
        told = json.load(lines)
    model, before = told["model"], told["pre_tokenizer"]
    options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "fuse_unk")
    odd = [o for o in options if model.get(o)] + [k for k in ("normalizer", "post_processor") if told.get(k)]
    odd += [k for s in told["added_tokens"] for k in ("single_word", "lstrip", "rstrip") if s[k]]
    if odd or model["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
        raise ValueError(f"not a plain byte-level vocabulary: {odd}")
    symbols = byte_symbols()
    names = list(symbols)
    number = {name: i for i, name in enumerate(names)}
    merges = []
    for pair in model["merges"]:
        u, v = pair.split(" ") if isinstance(pair, str) else pair
        if u not in number or v not in number or u + v in number:
            raise ValueError(f"merge {u} {v} comes before its parts or makes a token again")
        merges.append((number[u], number[v]))
        number[u + v] = len(names)
        names.append(u + v)
    return Vocabulary(
        compile_merges(len(symbols), merges),
        tuple(bytes(symbols[c] for c in name) for name in names),
        tuple(model["vocab"][name] for name in names),
        tuple((s["content"], s["id"]) for s in told["added_tokens"]),
    )


class Encoder(dict):
    """Word -> its ids as 32-bit integers, worked out once per distinct word while it is remembered."""

    def __init__(self, vocab: Vocabulary) -> None:
        super().__init__()
        automaton = vocab.automaton
        self.start, self.target = automaton.start, automaton.target.tolist()
        columns = [row.tobytes() for row in automaton.arcs]
        self.arcs = [columns[c] for c in automaton.column]
        self.public = np.array(vocab.ids, "<i4")
        # (node << 8 | byte) -> node, and the token that ends at a node
        self.steps: dict[int, int] = {}
        self.ends: list[int] = [-1]
        for token, label in enumerate(vocab.labels):
            node = 0
            for byte in label:
                step = node << 8 | byte
                if step not in self.steps:
                    self.steps[step] = len(self.ends)
                    self.ends.append(-1)
                node = self.steps[step]
            self.ends[node] = token
        self.find = regex.compile(WORDS).findall
        self.special = {content: np.array([i], "<i4").tobytes() for content, i in vocab.special}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")").split if self.special else lambda t: [t]

    def path(self, word: bytes) -> list[int]:
        """The tokens of the one path that spells the word."""
        n, steps, ends, arcs, target = len(word), self.steps, self.ends, self.arcs, self.target
        state, arc = [self.start] * (n + 1), [0] * (n + 1)
        came = [0] * (n + 1)
        for i in range(n):
            here = state[i]
            byte, bit = here >> 3, 1 << (here & 7)
            node = 0
            for j in range(i, n):
                node = steps.get(node << 8 | word[j], 0)
                if not node:
                    break
                token = ends[node]
                if token >= 0 and arcs[token][byte] & bit:
                    state[j + 1], arc[j + 1], came[j + 1] = target[token], token, i
        found = []
        while n:
            found.append(arc[n])
            n = came[n]
        return found[::-1]

    def __missing__(self, word: str) -> bytes:
        raw = word.encode()
        ids = self.public[self.path(raw)].tobytes()
        if len(raw) <= LONG_WORD:
            if len(self) >= MAX_CACHED:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        parts = []
        for i, piece in enumerate(self.cut(text)):
            if i % 2:
                parts.append(self.special[piece])
            else:
                parts.extend(map(self.__getitem__, self.find(piece)))
        return np.frombuffer(b"".join(parts), "<i4")


def labels_by_id(vocab: Vocabulary) -> list[bytes]:
    """The bytes of every id; none for ids that are no token."""
    known = dict(zip(vocab.ids, vocab.labels, strict=True)) | {i: content.encode() for content, i in vocab.special}
    return [known.get(i, b"") for i in range(max(known) + 1)]


def join_labels(ids: np.ndarray, labels: list[bytes]) -> str:
    """The text of ids; ids that are no token say nothing, bytes that are not UTF-8 become U+FFFD."""
    if len(ids) and (ids.min() < 0 or ids.max() >= len(labels)):
        ids = ids[(ids >= 0) & (ids < len(labels))]
    return b"".join(map(labels.__getitem__, ids.tolist())).decode("utf-8", "replace")


def encode(docs: DataFrame, text: str = "text", path: str | None = None, keep: Iterable[str] | None = None) -> DataFrame:
    """(row, out.ids): the ids of every row's whole text, as the tokenizers library gives them.

    A null or empty text has no ids. One pass over the scan, nothing is shuffled, so
    repeated rows and hot keys cost no more than their bytes; columns named like the
    result stay in ``row``. The tables are broadcast; their size is the vocabulary's.
    """
    spark = docs.sparkSession
    ship(spark)
    path = path or public_path(VOCABULARY)
    sent = spark.sparkContext.broadcast(vocabulary(path))

    def kernel():
        encoder = held("bpe_automaton", ("encoder", path), lambda: Encoder(sent.value))

        def work(texts):
            made = [encoder.encode((t or b"").decode("utf-8", "replace")) for t in texts]
            ends = np.cumsum([0, *map(len, made)])
            flat = np.concatenate(made) if made else np.zeros(0, "<i4")
            return {"ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))}

        return work

    return per_text(docs, text, kernel, IDS, keep)


def decode(rows: DataFrame, ids: str = "ids", path: str | None = None, keep: Iterable[str] | None = None) -> DataFrame:
    """(row, out.text): the text of every row's ids; null for a null list, empty for an empty one."""
    spark = rows.sparkSession
    ship(spark)
    path = path or public_path(VOCABULARY)
    sent = spark.sparkContext.broadcast(labels_by_id(vocabulary(path)))
    names = list(rows.columns if keep is None else keep)
    source = rows.select(
        F.struct(*[column(c).alias(c) for c in names]).alias("row"), column(ids).cast("array<int>").alias("ids")
    )
    schema = T.StructType([T.StructField("row", source.schema["row"].dataType), T.StructField("out", TEXT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = sent.value
        for batch in batches:
            lists = batch.column(1)
            texts = [
                join_labels(lists[i].values.drop_null().to_numpy(), labels) if lists[i].is_valid else None
                for i in range(batch.num_rows)
            ]
            out = pa.StructArray.from_arrays([pa.array(texts, pa.string())], names=["text"])
            yield pa.RecordBatch.from_arrays([batch.column(0), out], names=["row", "out"])

    return source.mapInArrow(run, schema)
