"""Column functions against plain Python."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import labels as L
from corpusloom.functions import numbers as N
from corpusloom.functions import sequences as S
from corpusloom.functions import text as T
from corpusloom.functions import vectors as V

X = None


@pytest.fixture(autouse=True, scope="module")
def column(spark):
    """``F.col`` needs a running session."""
    global X
    X = F.col("x")


TEXTS = [
    "",
    "   ",
    " a  b\tc\n\nd ",
    "one",
    "été à la plage",
    "no break　space line\x1cfile\x85next\x0bvtab",
    "don't stop_now 12 3 x yy",
    "Überraschung ÉCOLE ß",
]


def test_words_follow_unicode_white_space(values):
    every = ["a" + chr(c) + "b" for c in range(1, 0x3100) if not 0xD800 <= c <= 0xDFFF]
    got = values(TEXTS + every, "string", T.words(X))
    assert got == [t.split() for t in TEXTS + every]


def test_first_words_takes_slices_like_a_list(values):
    for n in (0, 1, 3, 100, -1, -2, -50, None):
        expected = [" ".join(t.split()[:n]) if n is not None else " ".join(t.split()) for t in TEXTS]
        assert values(TEXTS, "string", T.first_words(X, n)) == expected, n


def test_terms_match_the_word_pattern(values):
    texts = TEXTS + ["αβγ δ", "a1_b", "x² ½ ٣٤"]
    assert values(texts, "string", T.terms(X)) == [re.findall(r"(?u)\b\w\w+\b", t.lower()) for t in texts]


def test_stop_words_and_ngrams(spark):
    from corpusloom.operators.tfidf import with_ngrams, with_tokens

    texts = ["the cat sat on the mat", "", "cat", "cat dog", "a very big red dog ran", "the the"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r["i"]: r["terms"] for r in with_ngrams(with_tokens(df, "text")).collect()}
    for i, text in enumerate(texts):
        toks = [t for t in re.findall(r"\w\w+", text) if t not in set(T.ENGLISH_STOP_WORDS)]
        grams = [" ".join(toks[j : j + n]) for n in (1, 2, 3) for j in range(len(toks) - n + 1)]
        assert got[i] == grams


def test_stop_word_list():
    assert len(T.ENGLISH_STOP_WORDS) == len(set(T.ENGLISH_STOP_WORDS)) == 179


def test_paragraphs_and_segments(values):
    texts = ["a\n\nb\n\n\nc", "a\nb", "", "\n\na\n\n"]
    assert values(texts, "string", T.paragraphs(X)) == [re.split("\n{2,}", t) for t in texts]
    long = "\n\n".join(f"w{i} x y" for i in range(70))
    got = values([long], "string", T.long_document(T.paragraphs(X), "</s>", 64, 2))
    assert got == [" </s> ".join(f"w{i} x" for i in range(64))]
    joined = values(["a\n\nb\n\nc"], "string", T.join_segments(T.paragraphs(X), "\n"))
    assert joined == ["a\nb\nc"]


def test_small_text_helpers(values):
    assert values(["-lrb-x-rrb- -lrb-"], "string", T.unescape_brackets(X)) == ["(x) ("]
    assert values(["in 1999, 2017 and 2029", "203x 2030", "20"], "string", T.first_match(X, T.YEAR_PATTERN)) == [
        "2017",
        None,
        None,
    ]
    assert values(["/a/b.c/Some_File.en.txt", "x"], "string", T.file_stem(X)) == ["Some_File", "x"]
    names = ["bert-base-uncased", "Org/legal_model-2b", "abc"]
    expected = [re.sub("[^a-z]+", " ", n).title().replace(" ", "") for n in names]
    assert values(names, "string", T.camel_identifier(X)) == expected
    assert values(["a b", ""], "string", T.word_count(T.pair_text(X, F.lit("c d")))) == [4, 2]


def test_fixed_rounds_like_printf(values):
    rng = random.Random(7)
    xs = [0.0, -0.0, 72.25, 72.35, 0.15, 0.25, 0.35, -0.04, 99.95, 100.0, 1e-9, 0.05, 123456.05, float("nan"), 5e9 + 0.5]
    xs += [rng.uniform(-100, 100) for _ in range(3000)]
    xs += [round(rng.uniform(0, 100), 2) for _ in range(3000)]
    xs += [k / 80 for k in range(-400, 400)]
    for digits in (0, 1, 2, 5):
        got = values(xs, "double", N.fixed(X, digits))
        wrong = [(x, g, f"{x:.{digits}f}") for x, g in zip(xs, got) if g != f"{x:.{digits}f}"]
        assert not wrong, (digits, wrong[:5])
    assert values([0.7225, 0.5], "double", N.percent(X)) == [f"{0.7225 * 100:.1f}", "50.0"]


def test_duration(values):
    rng = random.Random(3)
    xs = [0.0, 59.9999999, 59.5, 3600.0, 86399.9, 86400.0, 172800.4, 1234567.891]
    xs += [rng.uniform(0, 500000) for _ in range(500)]
    expected = [str(datetime.timedelta(seconds=x)).split(".")[0] for x in xs]
    assert values(xs, "double", N.duration(X)) == expected


def test_label_vectors(values):
    lists = [[], [0], [2, 0, 2], [5, -1, 1], None]
    assert values(lists, "array<int>", L.multi_hot(X, 3)) == [[0, 0, 0], [1, 0, 0], [1, 0, 1], [0, 1, 0], [0, 0, 0]]
    assert values(lists, "array<int>", L.label_ids(X, 3)) == [[], [0], [2, 0], [1], []]
    assert values(lists, "array<int>", L.add_zero_class(L.multi_hot(X, 3)))[0] == [0, 0, 0, 1]
    assert values(lists, "array<int>", L.zero_class_ids(L.label_ids(X, 3), 3)) == [[3], [0], [2, 0], [1], [3]]


def test_thresholds_and_argmax(values):
    scores = [[0.0, 1e-3, -1.0], [5.0, 1e-18, 2.0], [3.0, 3.0, 1.0]]
    assert values(scores, "array<double>", L.positive_indicators(X)) == [[0, 1, 0], [1, 0, 1], [1, 1, 1]]
    assert values(scores, "array<double>", L.positive_ids(X)) == [[1], [0, 2], [0, 1, 2]]
    assert values(scores, "array<double>", L.argmax(X)) == [1, 0, 0]


def test_label_validation(values):
    assert values([0, 2, 3, -1, None], "int", L.is_known_label(X, 3)) == [True, True, False, False, False]
    assert values([0, 2], "int", L.require_label(X, 3)) == [0, 2]
    with pytest.raises(Exception, match="unknown label: 3"):
        values([3], "int", L.require_label(X, 3))


def test_padding_and_masks(values):
    ids = [[], [7], [1, 2, 3, 4, 5]]
    assert values(ids, "array<int>", S.pad(X, 4)) == [[0, 0, 0, 0], [7, 0, 0, 0], [1, 2, 3, 4]]
    assert values(ids, "array<int>", S.attention_mask(X, 4)) == [[0, 0, 0, 0], [1, 0, 0, 0], [1, 1, 1, 1]]
    rows = [[[1, 2, 3], [], [4]], []]
    got = values(rows, "array<array<int>>", S.pad_matrix(X, 4, 2))
    assert got == [[[1, 2], [0, 0], [4, 0], [0, 0]], [[0, 0]] * 4]
    positions = values(rows, "array<array<int>>", S.segment_positions(S.pad_matrix(X, 4, 2)))
    assert positions == [[1, 0, 3, 0], [0, 0, 0, 0]]
    assert values([1], "int", S.global_attention(4)) == [[1, 0, 0, 0]]


def test_pair_truncation_equals_popping(spark):
    def popped(a, b, budget):
        while a + b > budget:
            if a > b:
                a -= 1
            else:
                b -= 1
        return a, b

    cases = [(a, b) for a in range(12) for b in range(12)]
    df = spark.createDataFrame(cases, "a int, b int")
    for budget in (0, 1, 7, 8, 15):
        rows = df.select("a", "b", S.pair_lengths(F.col("a"), F.col("b"), budget).alias("k")).collect()
        for r in rows:
            assert (r["k"]["first"], r["k"]["second"]) == popped(r["a"], r["b"], budget), (r, budget)


def test_token_types(values):
    assert values([2], "int", S.token_types(X, F.lit(1), 5)) == [[0, 0, 1, 0, 0]]


def test_position_encoding(values):
    import numpy as np

    dim = 6
    got = values(list(range(5)), "int", V.position_encoding(X, dim))
    for position, row in enumerate(got):
        angles = [position / np.power(10000, 2 * i / dim) for i in range(dim)]
        expected = [0.0] * dim if position == 0 else [np.sin(a) if i % 2 == 0 else np.cos(a) for i, a in enumerate(angles)]
        assert np.allclose(row, expected)
    assert values([[4.0, 5.0], []], "array<double>", V.first_element(X)) == [4.0, None]


def test_fixed_of_large_numbers_and_infinities(values):
    numbers = [float("inf"), -float("inf"), 1e15, -1e9 - 0.5, 2.5e9, 1234567890.125, 1999999999.9999999, 4503599627370495.5, 1e18]
    for digits in (0, 1, 2, 5):
        assert values(numbers, "double", N.fixed(F.col("x"), digits)) == [f"%.{digits}f" % n for n in numbers]
