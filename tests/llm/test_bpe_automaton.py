"""The tokenization automaton against the tokenizers library and against merging by hand."""

from __future__ import annotations

import hashlib
import itertools
import random
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm import bpe_automaton
from corpusloom.llm.queries import op11_bpe_automaton
from corpusloom.llm.vocabularies import public_path

PATH = public_path(bpe_automaton.VOCABULARY)
FOLDER = "/root/testdata/sf0.001"


@lru_cache
def library():
    return Tokenizer.from_file(PATH)


@lru_cache
def encoder():
    return bpe_automaton.Encoder(bpe_automaton.vocabulary(PATH))


def expected(text):
    return library().encode(text or "", add_special_tokens=False).ids


def merged(word, n_bytes, merges):
    """Every merge in order, everywhere from the left."""
    tokens = list(word)
    for made, pair in enumerate(merges, start=n_bytes):
        done, i = [], 0
        while i < len(tokens):
            if tuple(tokens[i : i + 2]) == pair:
                done.append(made)
                i += 2
            else:
                done.append(tokens[i])
                i += 1
        tokens = done
    return tokens


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_paths_are_the_merged_words(data):
    n_bytes, merges, labels = 3, [], [b"\0", b"\1", b"\2"]
    for _ in range(data.draw(st.integers(0, 10))):
        pair = tuple(data.draw(st.integers(0, len(labels) - 1)) for _ in range(2))
        if labels[pair[0]] + labels[pair[1]] not in labels:
            merges.append(pair)
            labels.append(labels[pair[0]] + labels[pair[1]])
    automaton = bpe_automaton.compile_merges(n_bytes, merges)
    vocab = bpe_automaton.Vocabulary(automaton, tuple(labels), tuple(range(len(labels))), ())
    encode = bpe_automaton.Encoder(vocab).path
    for _ in range(10):
        word = bytes(data.draw(st.lists(st.integers(0, 2), max_size=14)))
        assert encode(word) == merged(word, n_bytes, merges)


def test_the_start_keeps_its_arcs():
    """Before the last merge only its first part still leads to the state where words start."""
    merges, labels = [(0, 1), (0, 0), (2, 0), (1, 4), (3, 0)], [b"\0", b"\1", b"\2"]
    for u, v in merges:
        labels.append(labels[u] + labels[v])
    automaton = bpe_automaton.compile_merges(3, merges)
    vocab = bpe_automaton.Vocabulary(automaton, tuple(labels), tuple(range(len(labels))), ())
    encode = bpe_automaton.Encoder(vocab).path
    for n in range(7):
        for word in map(bytes, itertools.product(range(3), repeat=n)):
            assert encode(word) == merged(word, 3, merges)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    ids = encoder().encode(text)
    assert ids.tolist() == expected(text)
    assert bpe_automaton.join_labels(ids, bpe_automaton.labels_by_id(bpe_automaton.vocabulary(PATH))) == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "e", "t", "the", " ", "  ", "\n", "\t", "<|endoftext|>", "'s", "aaa", "é", "中", "9", "½"])))
def test_blanks_marks_and_specials(parts):
    text = "".join(parts)
    assert encoder().encode(text).tolist() == expected(text)


def test_every_kind_of_character():
    step = random.Random(3)
    for code in [*range(0x3000), *(step.randrange(0x3000, 0x110000) for _ in range(5_000))]:
        if not 0xD800 <= code < 0xE000:
            text = f"a{chr(code)}b {chr(code)}1"
            assert encoder().encode(text).tolist() == expected(text)


def test_decoding_any_ids():
    labels, step = bpe_automaton.labels_by_id(bpe_automaton.vocabulary(PATH)), random.Random(5)
    for _ in range(500):
        ids = [step.randrange(50_257) for _ in range(step.randrange(12))]
        told = library().decode(ids, skip_special_tokens=False)
        assert bpe_automaton.join_labels(np.array(ids, "<i4"), labels) == told
    assert bpe_automaton.join_labels(np.array([-1, 64, 10**6], "<i4"), labels) == library().decode([64])


def test_merges_out_of_order_are_refused(tmp_path):
    import json

    with open(PATH, encoding="utf-8") as lines:
        told = json.load(lines)
    told["model"]["merges"] = told["model"]["merges"][::-1]
    (tmp_path / "odd.json").write_text(json.dumps(told))
    with pytest.raises(ValueError):
        bpe_automaton.vocabulary(str(tmp_path / "odd.json"))


def test_odd_rows_and_the_round_trip(spark):
    long = "x" * 300_000 + " lorem ipsum" * 10_000
    rows = [(1, None), (2, ""), (None, "one <|endoftext|> two"), (4, long), (4, long), (5, "Ünïcode  ok")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    found = bpe_automaton.encode(docs).select("row.*", F.col("out.ids").alias("found"))
    assert found.columns == ["doc_id", "text", "ids", "found"]
    for row in found.collect():
        assert row["found"] == expected(row["text"])
    back = bpe_automaton.decode(found.drop("ids"), "found", keep=["text"]).select("row.text", "out.text")
    assert all((a or "") == b for a, b in back.collect())
    lists = spark.createDataFrame([(None,), ([],), ([1, None],)], "ids array<int>")
    assert [r[0] for r in bpe_automaton.decode(lists).select("out.text").collect()] == [None, "", '"']
    assert bpe_automaton.encode(docs.where("false")).count() == 0
    assert bpe_automaton.decode(lists.where("false")).count() == 0


def test_query_equals_the_library(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    found = op11_bpe_automaton(spark, FOLDER).collect()
    assert len(found) == len(texts)
    for row in found:
        ids = expected(texts[row["doc_id"]])
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        told = library().decode(ids, skip_special_tokens=False)
        assert row["decoded_sha256"] == hashlib.sha256(told.encode()).hexdigest()
