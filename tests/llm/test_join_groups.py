"""Groups of one signature that are dealt into blocks."""

from __future__ import annotations

import random

from corpusloom.llm import jaccard_join


def test_one_phrase_in_all_texts(spark):
    draw = random.Random(3)
    phrase = [f"p{i}" for i in range(9)]
    texts = []
    for i in range(300):
        own = [f"w{draw.randrange(10**6)}" for _ in range(6)]
        texts.append(" ".join(phrase + own))
        if i % 10 == 0:
            # nearly the same text
            texts.append(" ".join([*phrase, *own, "more"]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    found = [{tuple(r) for r in jaccard_join.join(docs, split=n).collect()} for n in (16, 10**6)]
    assert found[0] == found[1]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    least = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                least[i] = min(least[i], least[j])
    assert found[0] == {(i, len(s), least[i]) for i, s in enumerate(sets)} and len(set(least)) == 300


def test_every_pair_meets_once(spark):
    rows = [(1, i, i) for i in range(40)] + [(2, i, i) for i in range(5)]
    seats = spark.createDataFrame(rows, "sig bigint, id bigint, comp bigint")
    cells = {}
    for cell, i, _, side in jaccard_join._cells(seats, 8).collect():
        cells.setdefault(cell, []).append((i, side))
    pairs = [
        (a, b)
        for held in cells.values()
        for a, s in held
        for b, t in held
        if a < b and (s == 2 or s != t)
    ]
    small = [(a, b) for b in range(5) for a in range(b)]
    assert sorted(pairs) == sorted([(a, b) for b in range(40) for a in range(b)] + small)
    assert max(map(len, cells.values())) <= 40 and len(cells) == 1 + 15
