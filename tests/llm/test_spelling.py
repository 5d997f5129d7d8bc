"""Spelling variants against all pairs compared."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows, typo=97):
    words = Counter()
    for key, text in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % typo == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                words[run] += 1
    return {w: n for w, n in words.items() if n >= 3}


def expected(words):
    forms, near = {}, {}
    for w in words:
        near[w] = [v for v in words if one_edit(w, v)]
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 2 * words[w] else None
    found = set()
    for w, n in words.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        found.add((w, forms[w], root, n, len(near[w]), words.get(forms[w])))
    return found


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("abé", min_size=1, max_size=7), st.text("abé", min_size=1, max_size=7)), min_size=1, max_size=20))
def test_one_edit(pairs):
    pairs = [sorted(p, key=len) for p in pairs]
    pairs = [p for p in pairs if len(p[1]) - len(p[0]) <= 1]
    if pairs:
        (a, n), (b, m) = (spelling.code_points(list(x)) for x in zip(*pairs))
        assert spelling.one_edit(a, b, n, m).tolist() == [one_edit(*p) for p in pairs]


@pytest.mark.parametrize("size", [1, 5, 40])
def test_every_leaf_in_reach_is_touched(size):
    step = np.random.default_rng(size)
    points = step.integers(0, 3, (300, spelling.DIMENSIONS)).astype(np.int16)
    points[:, 6:] = 0
    tree, leaves = spelling.build(points, size)
    assert sorted(np.concatenate(leaves).tolist()) == list(range(300))
    leaf = spelling.home(tree, points)
    assert all(leaf[i] == k for k, members in enumerate(leaves) for i in members)
    for more, less in ((1, 1), (1, 0)):
        asked = set(zip(*(x.tolist() for x in spelling.touched(tree, points, more, less))))
        for i in range(300):
            change = points - points[i]
            close = (np.maximum(change, 0).sum(axis=1) <= more) & (np.maximum(-change, 0).sum(axis=1) <= less)
            assert all((i, int(leaf[j])) in asked for j in np.flatnonzero(close))


def vocabulary(n, seed):
    step = random.Random(seed)
    made = set()
    while len(made) < n:
        word = "".join(step.choice("aeinrstéß") for _ in range(step.randrange(5, 9)))
        made.add(word)
        made.add(word[:-1] + step.choice("aeé") if len(word) > 5 else word + "ü")
    return {w: step.choice([3, 4, 7, 20, 60]) for w in sorted(made)}


@pytest.mark.parametrize("options", [{}, {"sample": 40, "cell": 10, "block": 8}, {"sample": 0, "cell": 5, "block": 20}])
def test_near_words_whatever_the_sample(spark, options):
    words = vocabulary(500, 1) | {"中中中中中": 9, "中中中中": 3, "x" * 300: 4, "x" * 301: 5}
    table = spark.createDataFrame(list(words.items()), "word string, n bigint")
    found = [tuple(r) for r in spelling.near_words(table, **options).collect()]
    assert len(found) == len(set(found))
    assert set(found) == {(a, b, words[b]) for a in words for b in words if one_edit(a, b)}


def test_words_of_one_outline(spark):
    # a thousand words with the same letters are in one cell, dealt in blocks
    import itertools

    words = {"".join(p): 3 for p in itertools.islice(itertools.permutations("abcdefg"), 1_000)} | {"abcdefgg": 9}
    table = spark.createDataFrame(list(words.items()), "word string, n bigint")
    found = {tuple(r) for r in spelling.near_words(table, cell=50, block=60).collect()}
    assert found == {(a, b, words[b]) for a in words for b in words if one_edit(a, b)}
    assert found


def test_words_forms_and_roots(spark):
    step = random.Random(4)
    base = list(vocabulary(60, 2))
    texts = [" ".join(step.choices(base, k=400)).title() for _ in range(30)]
    texts += [None, "", "a bb ccc dddd", "÷×÷×÷ " * 3]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)] + [(3, texts[3])] * 2 + [(99, "lorem ipsum " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(0))
    words = counted(rows, 5)
    assert {tuple(r) for r in spelling.count_words(docs, typo=5).collect()} == set(words.items())
    found = [tuple(r) for r in spelling.group(docs, typo=5).collect()]
    assert len(found) == len(words)
    assert set(found) == expected(words)


def test_forms_lead_on(spark):
    rows = [(1, "hallo " * 40), (2, "Hallö hallö " * 9), (3, "hällö " * 8), (4, "hällöp " * 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r["word"]: (r["form"], r["root"]) for r in spelling.group(docs, typo=10**12).collect()}
    assert {(w, *told) for w, told in found.items()} == {t[:3] for t in expected(counted(rows, 10**12))}
    assert found["hällö"] == ("hallö", "hallo") and found["hällöp"] == ("hällö", "hallo")


def test_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert spelling.group(docs).collect() == []
    with pytest.raises(ValueError):
        spelling.group(docs, ratio=1)
