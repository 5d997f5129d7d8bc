"""The ids of whole texts against the tokenizers library, and how often a batch looks words up."""

from __future__ import annotations

import zlib
from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import packing, texts
from corpusloom.llm.vocabularies import public_path

PATH = public_path("word_bpe_49k.json")
PARTS = [
    *"aBé9 É×ß½中\n\t\r\x0b\x0c\x1c\xa0　.,!?;:%*&#$'-(\x00\x85́",
    "word", "Words", "'s", ".,", "  ", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>",
]


@lru_cache
def library():
    return Tokenizer.from_file(PATH)


def expected(text):
    return library().encode(text, add_special_tokens=False).ids + [packing.END]


@lru_cache
def table():
    return packing.WordBytes(PATH)


def ids_of(batch):
    bounds, words = packing.split_texts(batch)
    known = table().of(words.dictionary.to_pylist())
    made = [known[i] for i in words.indices.to_pylist()]
    return [b"".join(made[i:j]) for i, j in zip(bounds, bounds[1:])]


def packed(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(PARTS), max_size=30).map("".join)), min_size=1, max_size=6))
def test_texts_of_a_batch_are_encoded_as_the_library_does(batch):
    found = ids_of([t if t is None else t.encode() for t in batch])
    assert found == [packed(expected(t or "")[:-1]) for t in batch]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"\xc3", b"\xff", b"\xa9", b"\xc3\xa9", b"a", b",", b" "]), max_size=12).map(b"".join))
def test_bytes_that_are_not_utf8_are_encoded_word_by_word(text):
    words = [w.decode("utf-8", "replace") for w in text.split()]
    assert ids_of([text]) == [packed(i for w in words for i in expected(w)[:-1])]


def test_pieces_end_with_the_closing_id():
    step = 4 * packing.CAPACITY
    for n in (0, 1, packing.CAPACITY - 1, packing.CAPACITY, packing.CAPACITY + 1, 2 * packing.CAPACITY):
        ids, whole = packed([7] * n), packed([7] * n + [packing.END])
        crcs = packing.piece_crcs(memoryview(ids), step)
        assert crcs == [zlib.crc32(whole[i : i + step]) for i in range(0, len(whole), step)]


@pytest.fixture
def counted(monkeypatch):
    """The kernel of ``tokenise`` and the words that it has looked up."""
    looked = []

    class Counted(packing.WordBytes):
        def get(self, word, *other):
            looked.append(word)
            return super().get(word, *other)

        def __getitem__(self, word):
            looked.append(word)
            return super().__getitem__(word)

    monkeypatch.setattr(packing, "WordBytes", Counted)
    monkeypatch.setattr(packing, "per_text", lambda docs, text, kernel, *rest: kernel())
    texts.release_others("")
    yield packing.tokenise(None, with_ids=True), looked
    texts.release_others("")


def test_a_batch_looks_every_word_up_once(counted):
    work, looked = counted
    batch = [b"One two, three! " * 4000, None, b"three two " * 4000]
    for fresh in (True, False):
        looked.clear()
        out = work(batch)
        assert out["ids"].to_pylist() == [packed(expected((t or b"").decode())) for t in batch]
        assert len(looked) <= (2 if fresh else 1) * len({b"one", b"two", b"three", b",", b"!"})
