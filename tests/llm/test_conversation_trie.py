"""The trie of conversations against one built in memory."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import conversation_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def rebuilt(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn, role or "", text or ""))
    def order(t):
        return t[0] is not None, t[0] or 0, t[1], hashlib.md5(t[2].encode()).hexdigest()

    said = {c: [t[1:] for t in sorted(turns, key=order)] for c, turns in convs.items()}
    heads = {c: zlib.crc32(str(c).encode()) % 6 for c in said}
    return {c: tuple(said.get(c - int(math.fmod(c, 100)), [])[: heads[c]]) + tuple(said[c][heads[c] :]) for c in said}


def expected(rows):
    members, ends, children, leaves, saved = defaultdict(list), defaultdict(list), Counter(), Counter(), Counter()
    for conv, turns in rebuilt(rows).items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(conv)
        ends[turns].append(conv)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, own in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(own) - 1) * len(node[-1][1]) if node else 0
            leaves[node[:d]] += not children[node]
    return {
        (
            min(own), len(node), min(members[node[:-1]]) if node else None, len(own), children[node], leaves[node],
            saved[node], hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest(),
        )
        for node, own in members.items()
    }


def found(spark, rows, **options):
    turns = spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit("clash")).withColumn("a", F.lit(1))
    made = [tuple(r) for r in conversation_trie.trie(turns, **options).collect()]
    assert len(made) == len(set(made))
    return set(made)


def chain(conv, n, prefix="t"):
    return [(conv, i, "user", f"{prefix}{i}") for i in range(n)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 10**6), max_size=40), st.lists(st.integers(1, 5), max_size=41), st.booleans())
def test_forest_sums(picks, own, one_path):
    # a tree in order of making; the weight of a node is what its subtree weighs
    parents = [-1] + [i if one_path else pick % (i + 1) for i, pick in enumerate(picks)]
    own = (own * 50)[: len(parents)] or [1] * len(parents)
    weights, values = list(own) + [1] * (len(parents) - len(own)), [[1] * len(parents), [i * i for i in range(len(parents))]]
    want = [list(v) for v in values]
    for i in range(len(parents) - 1, 0, -1):
        weights[parents[i]] += weights[i]
        for w in want:
            w[parents[i]] += w[i]
    assert conversation_trie.forest_sums(parents, weights, values) == want


@pytest.mark.parametrize("component", [12])
def test_odd_conversations(spark, component):
    rows = [
        *chain(100, 7), *chain(101, 9), *chain(102, 7), *chain(103, 2, "other"), *chain(205, 3), *chain(300, 40),
        *chain(301, 40), *[(c, 0, "user", "t0") for c in range(302, 330)],
        (104, None, None, None), (104, 1, "", None), (104, 1, "b", "y"), (104, 1, "b", "x"), (104, 1, "b", "x"),
        (None, 0, "user", "nobody"), (-3, 0, "user", "minus"), (-100, 0, "user", "base"), (0, 0, "user", "zero"),
        (105, 0, "user", "é" * 50_000), (106, 0, "user", "é" * 50_000), (2**62, 5, "system", "far"),
    ]
    assert found(spark, rows, component=component) == expected(rows)


def test_turnless_conversations_end_at_the_root(spark):
    # their base is absent and their own turns are too few
    few = [c for c in range(700, 800) if zlib.crc32(str(c).encode()) % 6 > 1 and c % 100][:3]
    rows = [(c, 0, "user", "gone") for c in few]
    assert found(spark, rows) == expected(rows)
    assert len(found(spark, rows)) == 1


def test_one_conversation_of_a_third_of_the_rows(spark):
    # longer than a range and than a component
    rows = [*chain(500, 200), *chain(501, 190), *[(c, i, "user", f"t{i % 3}") for c in range(510, 560) for i in range(8)]]
    assert found(spark, rows, component=100) == expected(rows)


def test_many_copies_of_one_conversation(spark):
    rows = [(c, i, "user", f"same{i}") for c in range(400) for i in range(9)]
    turns = spark.createDataFrame(rows, SCHEMA)
    made = {tuple(r) for r in conversation_trie.trie(turns, component=8).collect()}
    assert made == expected(rows)
    ends = turns.where("turn = 0").select(F.lit(1).cast("bigint").alias("a"), F.lit(2).cast("bigint").alias("b"), F.col("conv_id").alias("conv"))
    told = conversation_trie.list_digests(ends, piece=7).collect()
    assert [r["sha256"] for r in told] == [hashlib.sha256(",".join(map(str, range(400))).encode()).hexdigest()]


def test_no_turns(spark):
    assert found(spark, []) == set()
