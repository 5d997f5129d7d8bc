"""Curation, sampling and lookup joins."""

import contextlib
import hashlib
import io
import random
from functools import partial

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import curation as C
from corpusloom.operators import sampling as S
from corpusloom.operators.lookups import fits_broadcast, lookup_join
from corpusloom.plans import views
from corpusloom.plans.queries import QUERIES


@pytest.fixture(scope="module")
def records(spark):
    rows = [
        (1, ["b", "a"], "2016"),
        (2, ["a", "z"], "2016"),
        (3, ["c"], "2017"),
        (4, ["b", "b"], "2018"),
        (5, [], "2019"),
        (6, ["z"], "2019"),
        (7, ["c", "q"], "2015"),
        (8, ["d"], "2019"),
    ]
    return spark.createDataFrame(rows, "id int, labels array<string>, year string")


def test_top_labels_break_ties_by_label(records):
    assert [tuple(r) for r in C.top_labels(records, "labels", 3).collect()] == [("b", 3), ("a", 2), ("c", 2)]


def test_keep_single_label_reduces_the_list(records):
    top = C.top_labels(records, "labels", 3)
    kept = {r["id"]: r["labels"] for r in C.keep_single_label(records, "labels", top).collect()}
    # 1 has two top labels; 2 and 7 lose the label outside the top; 4 repeats one label
    assert kept == {2: ["a"], 3: ["c"], 4: ["b"], 7: ["c"]}


def test_semi_join_to_top_labels(records):
    top = C.top_labels(records, "labels", 1)
    pairs = C.rows_with_labels(records, "labels", "id", top).collect()
    assert sorted((r["id"], r["label"]) for r in pairs) == [(1, "b"), (4, "b")]


def test_split_names(records):
    split = C.split_by_value("year", {"train": ["2016", "2017"], "dev": ["2018"], "test": ["2019"]})
    got = {r[0]: r[1] for r in records.select("id", C.canonical_split(split)).collect()}
    assert got == {1: "train", 2: "train", 3: "train", 4: "validation", 5: "test", 6: "test", 7: None, 8: "test"}


def test_chronological_split_keeps_groups_whole(spark):
    groups = [(f"g{i:02d}", "-" if i < 3 else str(2006 + i % 5)) for i in range(20)]
    random.Random(1).shuffle(groups)
    df = spark.createDataFrame(groups, "company string, year string")
    got = {r["company"]: r["split"] for r in C.chronological_splits(df, ["year", "company"], 8, 4).collect()}
    order = sorted(groups, key=lambda g: (g[1], g[0]))
    expected = {g[0]: "train" if i < 8 else "validation" if i < 12 else "test" for i, g in enumerate(order)}
    assert got == expected


def test_positional_labels_and_counts(spark):
    keys = ["company", "line_no"]
    sentences = spark.createDataFrame([("x", i, f"s{i}") for i in range(4)], "company string, line_no int, text string")
    marks = [(0, 0), (0, 2), (2, 1)]
    annotations = spark.createDataFrame(
        [("x", i, t, "1" if (i, t) in marks else "0") for i in range(4) for t in range(3)],
        "company string, line_no int, label_type int, value string",
    )
    names = ["A", "B", "C", "D"]
    got = {r["line_no"]: r["labels"] for r in C.label_lists(sentences, annotations, keys, names).collect()}
    assert got == {0: ["A", "C"], 1: [], 2: ["B"], 3: []}
    counts = {r["measure"]: r["n"] for r in C.annotation_summary(sentences, annotations, keys, names).collect()}
    assert counts == {
        "sentences": 4,
        "A": 1,
        "B": 1,
        "C": 1,
        "D": 0,
        "annotations": 3,
        "sentences minus annotations": 1,
        "without annotation": 2,
    }


def test_line_filters(values):
    x = F.col("x")
    lines = ["1,a,2", "a,1", "1,a", "1", "12", "", "1" * 4998, "1" * 4999]
    assert values(lines, "string", C.well_formed(x)) == [True, False, False, False, True, False, True, True]
    # 4,998 characters and the terminator are still under 5,000; 4,999 are not
    assert values(lines, "string", C.not_overlong(x)) == [True] * 7 + [False]


def test_first_year_in_reading_order(spark):
    rows = [("a", 1, 0, "none"), ("a", 1, 5, "2016 then 2011"), ("a", 0, 9, "in 2018"), ("b", 0, 0, "1999")]
    df = spark.createDataFrame(rows, "company string, doc int, line int, text string")
    got = {r["company"]: r["year"] for r in C.first_years(df, "company", ["doc", "line"], "text").collect()}
    assert got == {"a": "2018", "b": "-"}


def test_dataset_card(spark):
    rows = [("t", "train", [0, 1]), ("t", "test", []), ("t", "train", [1]), ("u", "validation", [])]
    df = spark.createDataFrame(rows, "task string, split string, labels array<int>")
    got = {r["task"]: (r["train"], r["validation"], r["test"], r["n_classes"]) for r in C.dataset_card(df).collect()}
    assert got == {"t": (2, 0, 1, 2), "u": (0, 1, 0, 0)}


def expected_sample(rows, sizes, seed):
    key = lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i)
    return {
        i
        for year, n in sizes.items()
        for i in sorted((i for i, y in rows if y == year), key=key)[:n]
    }


@pytest.mark.parametrize("seed", [1, 2])
def test_sample_per_group_equals_sorting_each_group(spark, seed):
    # one year holds two thirds of all rows, one is smaller than its sample, one is unknown
    rows = [(i, "2016" if i % 3 else "2017" if i % 2 else "2018") for i in range(6_000)]
    rows += [(10_000 + i, "2019") for i in range(5)] + [(100_000 + i, "2030") for i in range(50)]
    sizes = {"2016": 1500, "2017": 1, "2018": 10_000, "2019": 7, "2020": 3}
    df = spark.createDataFrame(rows, "id int, year string").withColumn("text", F.lit("t"))
    got = S.sample_per_group(df, "year", sizes, "id", seed)
    assert got.columns.count("text") == 1 and set(got.columns) == {"id", "year", "text"}
    assert {r["id"] for r in got.collect()} == expected_sample(rows, sizes, seed)


def test_sample_ranks_inside_a_shared_bucket(spark, monkeypatch):
    # with one digit there are 16 buckets, so the border bucket holds many rows
    monkeypatch.setattr(S, "BUCKET_DIGITS", 1)
    rows = [(i, "a") for i in range(500)]
    df = spark.createDataFrame(rows, "id int, year string")
    got = {r["id"] for r in S.sample_per_group(df, "year", {"a": 123}, "id").collect()}
    assert got == expected_sample(rows, {"a": 123}, 1)


def test_sampling_helpers(spark):
    df = spark.range(100).withColumn("split", F.when(F.col("id") < 70, "train").otherwise("test"))
    assert [r["id"] for r in S.first_rows(df, 3, "id").collect()] == [0, 1, 2]
    assert S.spot_check(df, "id").count() == 3
    assert S.spot_check(df, "id", seed=1).collect() == S.spot_check(df, "id", seed=1).collect()
    got = {r["split"]: (r["n_rows"], r["n_used"]) for r in S.effective_counts(df, "split", 50).collect()}
    assert got == {"train": (70, 50), "test": (30, 30)}
    uncapped = {r["split"]: r["n_used"] for r in S.effective_counts(df, "split", None).collect()}
    assert uncapped == {"train": 70, "test": 30}


def test_lookup_join_gives_the_same_rows_on_every_path(spark):
    # a third of the facts share one key
    facts = spark.range(3_000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    lookup = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert fits_broadcast(lookup, 40) and not fits_broadcast(lookup, 39)
    texts = lookup.select("k", F.repeat(F.lit("é"), 100).alias("t"), F.array("k").alias("a"))
    assert fits_broadcast(texts, max_bytes=40 * 300) and not fits_broadcast(texts, max_bytes=40 * 200)
    with pytest.raises(ValueError):
        lookup_join(facts, lookup, "k", "full")
    for how in ("inner", "left"):
        small = sorted(map(tuple, lookup_join(facts, lookup, "k", how, ["id"]).select("id", "k", "v").fillna(-1).collect()))
        salted = lookup_join(facts, lookup, "k", how, ["id"], max_rows=10)
        plain = lookup_join(facts, lookup, "k", how, max_bytes=10)
        assert sorted(map(tuple, salted.select("id", "k", "v").fillna(-1).collect())) == small
        assert sorted(map(tuple, plain.select("id", "k", "v").fillna(-1).collect())) == small


@pytest.mark.parametrize("spread_by", [["id"], []])
def test_a_lookup_beyond_the_bounds_is_never_broadcast(spark, tmp_path, spread_by):
    # its file is far below Spark's own threshold, its rows times the salts are not
    spark.range(1_000).select(F.col("id").alias("k"), F.lit("x").alias("v")).write.parquet(f"{tmp_path}/lookup")
    lookup = spark.read.parquet(f"{tmp_path}/lookup")
    joined = lookup_join(spark.range(5_000).withColumn("k", F.col("id") % 900), lookup, "k", spread_by=spread_by, max_rows=999)
    assert joined.count() == 5_000
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        joined.explain()
    assert "SortMergeJoin" in plan.getvalue() and "Broadcast" not in plan.getvalue()


@pytest.fixture(scope="module")
def orders_folder(spark, tmp_path_factory):
    """Orders of one to three brands; the parts are many, in a file smaller than that of the lines."""
    folder = str(tmp_path_factory.mktemp("orders"))
    brand = F.concat(F.lit("Brand#"), F.col("id") % 7)
    spark.range(100_000).select(F.col("id").alias("p_partkey"), brand.alias("p_brand")).write.parquet(f"{folder}/part.parquet")
    date = F.to_timestamp(F.concat(F.col("id") % 7 + 1995, F.lit("-03-01")))
    spark.range(700).select(F.col("id").alias("o_orderkey"), date.alias("o_orderdate")).write.parquet(f"{folder}/orders.parquet")
    order, some = F.col("id") % 700, F.pmod(F.xxhash64("id"), F.lit(14_000))
    part = some * 7 + (order + some % (order % 3 + 1)) % 7
    spark.range(400_000).select(order.alias("l_orderkey"), part.alias("l_partkey")).write.parquet(f"{folder}/lineitem.parquet")
    return folder


@pytest.mark.parametrize(
    "name",
    [
        "curate_label_counts",
        "curate_label_pairs",
        "curate_single_label",
        "curate_top_labels",
        "curate_year_sample_split",
        "io_json_records",
        "io_split_json",
    ],
)
def test_queries_on_brands_do_not_broadcast_parts_beyond_the_bounds(spark, orders_folder, monkeypatch, name):
    rows = sorted(map(str, QUERIES[name](spark, orders_folder).collect()))
    monkeypatch.setattr(views, "lookup_join", partial(lookup_join, max_rows=50_000))
    # between the one page of any small broadcast and the parts once per salt
    spark.conf.set("spark.sql.maxBroadcastTableSize", "100m")
    try:
        assert rows and sorted(map(str, QUERIES[name](spark, orders_folder).collect())) == rows
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")


@pytest.mark.parametrize(
    "name",
    [
        "curate_label_pairs",
        "curate_single_label",
        "curate_top_labels",
        "curate_year_sample_split",
        "io_json_records",
        "io_split_json",
    ],
)
def test_queries_on_brands_do_not_broadcast_orders_beyond_the_bounds(spark, orders_folder, monkeypatch, name):
    # the file of the orders is far below Spark's own threshold, whatever it unpacks to
    rows = sorted(map(str, QUERIES[name](spark, orders_folder).collect()))
    made, orders_brands = [], views.orders_brands
    monkeypatch.setattr(views, "lookup_join", partial(lookup_join, max_rows=699))
    monkeypatch.setattr(views, "orders_brands", lambda *given: made.append(orders_brands(*given)) or made[-1])
    assert rows and sorted(map(str, QUERIES[name](spark, orders_folder).collect())) == rows
    for step in made:
        step.collect()
        with contextlib.redirect_stdout(io.StringIO()) as plan:
            step.explain()
        assert "SortMergeJoin" in plan.getvalue() and "Broadcast" not in plan.getvalue()
    assert made


def test_a_hundred_label_types(spark):
    names = [f"name{i}" for i in range(100)]
    sentences = spark.createDataFrame([(0,), (1,), (2,)], "line_no int")
    marks = [(0, 66, "1"), (0, 99, "1"), (0, 3, "0"), (1, 2, "1")]
    annotations = spark.createDataFrame(marks, "line_no int, label_type int, value string")
    listed = C.label_lists(sentences, annotations, ["line_no"], names).orderBy("line_no").collect()
    assert [r["labels"] for r in listed] == [["name66", "name99"], ["name2"], []]
    counts = dict(C.annotation_summary(sentences, annotations, ["line_no"], names).collect())
    assert counts["name66"] == counts["name99"] == counts["name2"] == 1 and counts["annotations"] == 3
    with pytest.raises(Exception, match="unknown label type (66|99)"):
        C.label_lists(sentences, annotations, ["line_no"], names[:50]).collect()


def test_a_group_without_an_order_key_keeps_its_place(spark):
    groups = spark.createDataFrame([(None, "a"), (2010, "b"), (2011, "c")], "year int, company string")
    split = {r["company"]: r["split"] for r in C.chronological_splits(groups, ["year", "company"], 1, 1).collect()}
    assert split == {"a": "train", "b": "validation", "c": "test"}


def test_allowed_labels_are_bounded_or_joined(spark, monkeypatch):
    rows = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["c"]), (3, [])], "id int, labels array<string>")
    allowed = spark.createDataFrame([("a",), ("c",), (None,), ("a",)], "label string")
    for bound in (100, 0):
        monkeypatch.setattr("corpusloom.operators.lookups.fits_broadcast", lambda table, *_: bound > 0)
        pairs = C.rows_with_labels(rows, "labels", "id", allowed)
        assert sorted((r["id"], r["label"]) for r in pairs.collect()) == [(1, "a"), (2, "c")]
    monkeypatch.setattr(C, "MAX_ALLOWED", 1)
    with pytest.raises(ValueError, match="more than 1 allowed"):
        C.keep_single_label(rows, "labels", allowed)
