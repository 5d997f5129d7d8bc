"""The training-data operators against brute force, round trips and held-out labels, with the odd cases."""

from __future__ import annotations

import gzip
import re
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import chat, compression_quality, decontamination, jaccard_join, packing, quality_rules
from corpusloom.llm import sharding, toxicity, url_filter, warc
from corpusloom.llm.calibration import fold
from corpusloom.llm.vocabularies import public_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "lorem ipsum dolor " * 30_000
#: Rows with a null or empty text, a null key, a repeated row, a very long text, and columns named like results.
ODD = [(1, None, "x"), (2, "", "x"), (None, "one two three", None), (4, "a b c d e f g", "y"), (4, "a b c d e f g", "y"), (5, LONG, "y")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id bigint, text string, kept string").withColumn("score", F.lit("clash"))


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


# quality rules


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
    )


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab #é|\n\t\x1c %", max_size=120))
def test_base_counts(text):
    table = quality_rules._table(public_path("piece_bpe_32k.model"))
    assert quality_rules.figures(text.encode(), table, quality_rules.BANDS)[:5] == base_counts(text)


def test_fertility_is_that_of_the_words():
    from corpusloom.llm.vocabularies import encoder

    path = public_path("piece_bpe_32k.model")
    text = "Is this здесь 漢字 ☃ fine fine?"
    row = dict(zip(quality_rules.RESULT.names, quality_rules.figures(text.encode(), quality_rules._table(path), quality_rules.BANDS)))
    tokens = [t for w in encoder(path)(text.split()) for t in w]
    share = np.unique(tokens, return_counts=True)[1] / len(tokens)
    assert row["n_tokens"] == len(tokens) and row["script"] == "latin"
    assert row["token_entropy"] == pytest.approx(-(share * np.log2(share)).sum())
    assert row["chars_per_token"] == pytest.approx(sum(map(len, text.split())) / len(tokens))
    assert row["byte_share"] > 0


def test_quality_rules_odd_rows(odd, none):
    rows = quality_rules.judge(odd).collect()
    assert len(rows) == len(ODD) and {r["row"]["kept"] for r in rows} == {"x", "y", None}
    assert [r["out"]["n_words"] for r in rows if r["row"]["text"] is None] == [0]
    assert [r["out"]["kept"] for r in rows if r["row"]["doc_id"] == 5] == [False]
    assert quality_rules.judge(none).count() == 0


def test_bands_of_a_language_reject_its_bad_texts(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet").join(labels, "doc_id")
    rows = quality_rules.judge(docs, keep=["quality"]).where("not out.base_failed").select("row.quality", "out.kept").collect()
    good, bad = ([r["kept"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert bad.count(False) >= 0.55 * len(bad) and good.count(False) <= 0.02 * len(good)


def test_band_of_a_text():
    bands = {"latin": quality_rules.Band(1, 9, 1, 1), "other": quality_rules.Band(3, 9, 1, 1), "latin-en": quality_rules.Band(2, 9, 1, 1)}
    found = [quality_rules.band_of(s, c, bands)[0] for s, c in (("latin", "en"), ("latin", "EN_gb"), ("latin", "xx"), ("latin", None), ("han", "en"))]
    assert found == [2, 2, 1, 1, 3]


# packing


def test_ids_are_the_tokenisers(spark):
    from tokenizers import Tokenizer

    texts = ["Hello, World! it's 12.5% <|endoftext|> x", "été, «naïve», ÀÉ. don't'", "", "a　b\x1cc,;: foo,'"]
    known = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    for row in packing.tokenise(docs, with_ids=True).collect():
        ids = known.encode(row["row"]["text"], add_special_tokens=False).ids + [0]
        assert bytes(row["out"]["ids"]) == struct.pack(f"<{len(ids)}I", *ids)
        assert row["out"]["crcs"] == [zlib.crc32(bytes(row["out"]["ids"]))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80), st.sampled_from(["norm", "dot"]), st.integers(2, 9))
def test_best_fit_keeps_every_capacity(lengths, rule, documents):
    sizes = np.array(lengths, np.int64)
    bins, offsets = packing.best_fit(sizes, (64, documents, 64 * 64 // 2 + 2100), (1, 0.1, 0.1), rule)
    for b in set(bins.tolist()):
        own = np.flatnonzero(bins == b)
        assert sizes[own].sum() <= 64 and len(own) <= documents and (sizes[own] ** 2).sum() <= 64 * 64 // 2 + 2100
        order = own[np.argsort(offsets[own])]
        assert offsets[order].tolist() == (np.cumsum(sizes[order]) - sizes[order]).tolist()


def test_packing_odd_rows(odd, none):
    pieces = packing.cut(packing.tokenise(odd, with_ids=True, keep=["doc_id"]))
    packed = packing.pack(pieces.select("row.doc_id", "piece", "start", "length", "ids_crc32", "ids"))
    rows = packed.toPandas()
    total = sum(r["out"]["n_ids"] for r in packing.tokenise(odd).collect())
    assert rows.length.sum() == total and rows.groupby("sequence_id").length.sum().max() <= packing.CAPACITY
    assert rows.sequence_id.nunique() == -(-total // packing.CAPACITY)
    whole = packing.assemble(packed).collect()
    assert sum(len(r["ids"]) for r in whole) == 4 * total
    assert packing.pack(packing.cut(packing.tokenise(none))).count() == 0
    with pytest.raises(ValueError):
        packing.pack(packed.select("doc_id", F.lit(5000).alias("length")))


# toxicity and quality scores


@pytest.fixture(scope="module")
def marked(spark):
    """Texts of one language, of which every fifth has words of its own."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        words = [f"w{k}" for k in rng.zipf(1.4, 60) % 500]
        if i % 5 == 0:
            words += ["vile", "nasty", "grim"] * 2
        rows.append((i, " ".join(rng.permutation(words)), int(i % 5 == 0)))
    rows.append((601, None, 0))
    return spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")


def test_toxicity_of_held_out_rows(marked):
    model = toxicity.fit(marked, marked.select("doc_id", "toxic"), fold(F.col("key"), 3) != 1)
    rows = toxicity.score(marked, model).where(fold(F.col("row.doc_id"), 3) == 1).collect()
    right = sum((r["out"]["score"] >= 0.5) == (r["row"]["toxic"] == 1) for r in rows)
    assert right >= 0.95 * len(rows) and all(0 <= r["out"]["score"] <= 1 for r in rows)


def test_text_counts_are_brute_force_counts(marked):
    found = toxicity.count(marked.select("text", F.col("toxic").alias("label"))).toPandas()
    texts = [(set((r["text"] or "").split()), r["toxic"]) for r in marked.collect()]
    assert found.ordinary.sum() == sum(len(w) for w, t in texts if not t)
    assert found.toxic.sum() == sum(len(w) for w, t in texts if t)


def test_every_expression_has_its_own_ratio(spark, marked):
    # in 2^22 places over a thousand of them would share one
    rows = [(" ".join(f"x{i}" for i in range(k * 20_000, (k + 1) * 20_000)), k % 2) for k in range(5)] * 3
    texts = spark.createDataFrame(rows, "text string, label int")
    counted = toxicity.count(texts)
    assert counted.count() == 100_000
    found, unseen = toxicity.ratios(counted)
    assert found.count() == 100_000 and {r["n"] for r in found.select("n").distinct().collect()} == {3}
    assert found.select("ratio").distinct().count() == 2
    # what no class has more than DISCOUNT times is told by neither
    few = toxicity.count(texts.limit(0).unionByName(spark.createDataFrame([("a b", 0), ("a c", 1)], "text string, label int")))
    assert toxicity.ratios(few)[0].count() == 0


def test_ratios_beyond_those_sent_score_alike(marked, odd):
    labels = marked.select("doc_id", "toxic")
    read = lambda df: sorted((r["row"]["doc_id"] or -1, tuple(round(x, 9) for x in r["out"])) for r in df.collect())
    for docs in (marked, odd):
        scored = []
        for bound in (toxicity.MAX_SENT, 40, 0):
            model = toxicity.fit(marked, labels, fold(F.col("key"), 3) != 1, max_sent=bound)
            assert len(model.sent.hashes) <= bound and (model.rest is None) == (bound == toxicity.MAX_SENT)
            scored.append(read(toxicity.score(docs, model, keep=["doc_id"])))
        assert scored[0] == scored[1] == scored[2] and len(scored[0]) == docs.count()


def test_rows_beyond_those_of_the_curve_give_counts(marked, monkeypatch):
    counted, real = [], toxicity.count
    monkeypatch.setattr(toxicity, "count", lambda rows: counted.append(rows.count()) or real(rows))
    toxicity.fit(marked, marked.select("doc_id", "toxic"), F.lit(True), curve=10)
    assert 601 - 30 <= counted[0] < 601


def test_expressions_have_no_case():
    known = toxicity.Expressions()
    assert known.of("¡Él, ÑOÑO!".encode()).tolist() == known.of("¡él ñoño".encode()).tolist() == [0, 1]


def test_scores_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 0), (2, 0, 1), (None, 1, 1), (5, None, None)], "doc_id bigint, toxic int, quality int")
    everyone = F.lit(True)
    for module, label in ((toxicity, "toxic"), (compression_quality, "quality")):
        model = module.fit(odd, labels, everyone, label=label)
        rows = module.score(odd, model).collect()
        assert len(rows) == len(ODD) and all(0 <= r["out"]["score"] <= 1 for r in rows)
        assert module.score(none, module.fit(none, labels, everyone, label=label)).count() == 0


def test_compression_tells_languages_apart(spark):
    rng = np.random.default_rng(4)
    make = lambda words: " ".join(rng.choice(words, 80))
    good, bad = [f"good{k}ness" for k in range(90)], [f"%%{k}##bad" for k in range(90)]
    rows = [(i, make(good if i % 2 else bad), i % 2) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    model = compression_quality.fit(docs, docs, fold(F.col("key"), 5) != 0)
    held = compression_quality.score(docs, model).where(fold(F.col("row.doc_id"), 5) == 0).collect()
    assert all((r["out"]["score"] >= 0.5) == (r["row"]["quality"] == 1) for r in held)


# url filter


def brute_rule(url, rules):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    raw = re.match(r"[^/?#]*", rest)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
    path = re.match(r"[^?#]*", rest[len(raw) :])[0]
    fits = []
    for verdict, rule in rules:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((-len(rule), rule, verdict))
    return host, path, min(fits)[1] if fits else None


RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def test_rules_like_brute_force(spark):
    urls = [
        None, "", "no scheme", "http://", "http://NET/", "http://a.net", "http://a.net?x=/", "https://x.example.net/en/1#t",
        "ftp://example.net/en", "http://É.Example.COM/de/ü?q", "http://myexample.com/de/", "http://w.org/fr/", "http://fr.org//fr/",
    ]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id bigint, url string, html string")
    pages = pages.unionByName(pages.limit(3)).withColumn("host", F.lit("clash"))
    rows = url_filter.judge(pages, url_filter.rule_table(spark, RULES)).collect()
    assert len(rows) == len(urls) + 3
    for r in rows:
        assert (r["host"], r["path"], r["rule"]) == brute_rule(urls[r["page_id"]], RULES)
    assert url_filter.judge(pages.where("false"), url_filter.rule_table(spark, RULES)).count() == 0


def test_distrust_flows_against_links(spark):
    link = lambda host: f'<a href="https://{host}/x">x</a>'
    pages = [
        (1, "http://bad.net/a", ""), (2, "http://farm.com/a", link("bad.net") * 3), (3, "http://ok.org/fr/a", link("good.com")),
        (4, "http://good.com/a", link("ok.org")), (5, "http://alone.com/", None),
    ]
    docs = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    rows = {r["page_id"]: r for r in url_filter.judge(docs, url_filter.rule_table(spark, RULES)).collect()}
    assert [rows[i]["verdict"] for i in range(1, 6)] == ["block", "block", "allow", "allow", "allow"]
    # personalised PageRank by power iteration
    seeds = {"bad.net": 0.0, "farm.com": 0.0, "ok.org": 1.0, "good.com": 0.0, "alone.com": 0.0}
    edges = [("farm.com", "bad.net"), ("ok.org", "good.com"), ("good.com", "ok.org")]
    rank = dict.fromkeys(seeds, 0.0)
    for _ in range(200):
        rank = {h: 0.15 * s + 0.85 * sum(rank[a] for a, b in edges if b == h) for h, s in seeds.items()}
    for r in rows.values():
        assert r["trust"] == pytest.approx(rank[r["host"]], abs=1e-5)
    back = {"bad.net": 0.15, "farm.com": 0.15 * 0.85}
    for r in rows.values():
        assert r["distrust"] == pytest.approx(back.get(r["host"], 0.0), abs=1e-5)


# decontamination


def test_tiles_like_brute_force():
    item = "one two three four five six seven eight nine ten".split()
    known = decontamination.Items([" ".join(item).encode(), b"", b"tiny"], 3)
    text = "x six seven eight nine ten y One, two three. four five z".encode()
    assert known.find(text) == [(0, 10, 10, 2)]
    assert known.find(b"a tiny one two") == [(2, 1, 1, 1)]
    assert known.find(b"one two three six seven") == [(0, 3, 10, 1)]
    # a repeated passage covers its item once
    assert known.find(b"one two three one two three") == [(0, 3, 10, 1)]


def test_items_in_accented_capitals(spark):
    item = "El niño cogió su cámara y salió después al jardín, más allá del árbol"
    benchmark = spark.createDataFrame([(1, item), (2, "ÉTÉ")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, f"Antes. {item.upper()} FIN"), (2, "un été là"), (3, "EL NINO COGIO SU CAMARA")], "doc_id bigint, text string")
    for bytes_sent in (decontamination.MAX_ITEM_BYTES, 0):
        rows = decontamination.find(docs, benchmark, max_item_bytes=bytes_sent).collect()
        assert sorted((r["row"]["doc_id"], [f["item"] for f in r["found"]]) for r in rows) == [(1, [1]), (2, [2]), (3, [])]


def test_both_ways_find_the_same(spark, odd, none):
    items = [(1, "the quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (4, "d e f"), (4, "d e f")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    docs = odd.select("doc_id", "text").unionByName(
        spark.createDataFrame([(9, "so over the lazy dog the quick brown fox jumps it is"), (10, "the quick fox")], "doc_id bigint, text string")
    )
    sent = decontamination.find(docs, benchmark)
    joined = decontamination.find(docs, benchmark, max_item_bytes=0)
    read = lambda df: sorted((str(r["row"]["doc_id"]), sorted(f["item"] for f in r["found"])) for r in df.collect())
    assert read(sent) == read(joined)
    assert ("9", [1]) in read(sent) and ("10", []) in read(sent) and read(sent).count(("4", [4, 4])) == 2
    assert decontamination.find(none, benchmark).count() == 0
    assert all(not r["found"] for r in decontamination.find(docs, benchmark.where("false")).collect())


# sharding


def plain_jump(key, shards):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash(spark):
    keys = [0, 1, -1, 7, 1 << 62, -(1 << 63), (1 << 63) - 1, None, *range(100, 400)]
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    for shards in (1, 2, 8, 9, 100, 1000):
        found = df.select("k", sharding.jump_hash(F.col("k"), shards).alias("s")).collect()
        assert all(r["s"] == plain_jump(r["k"] or 0, shards) for r in found)


def test_shards_of_odd_rows(odd, none):
    rows = sharding.assign(odd.drop("text"), "doc_id", 2).toPandas()
    assert len(rows) == len(ODD)
    for _, part in rows.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    moved = rows[rows["shard"] != rows.grown_shard]
    assert set(moved.grown_shard) <= {2}
    assert sharding.assign(none, "doc_id", 2).count() == 0


# warc


def test_warc_round_trip(spark, tmp_path):
    pages = [
        (3, "http://a/\r\nX: y", "same"), (1, "http://ü/", "same"), (2, None, None), (5, "u", ""), (4, "v", "x" * 300_000),
        (None, "n", "same"), (6, "w", "é\r\n\r\n"), (6, "w", "é\r\n\r\n"),
    ]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("sha", F.lit("clash"))
    folders = [str(tmp_path / n) for n in "ab"]
    names = []
    for folder, parts in zip(folders, (1, 5), strict=True):
        manifest = warc.write(df.repartition(parts), folder, shard_bytes=200_000, file_bytes=500).collect()
        names.append(sorted((r["name"], r["digest"], r["records"]) for r in manifest))
    assert names[0] == names[1] and len(names[0]) > 1
    rows = warc.read(spark, folders[0]).collect()
    assert len(rows) == len(pages)
    by = {}
    for r in rows:
        by.setdefault(r["page_id"], []).append(r)
    html = {p: (h or "").encode() for p, _, h in pages}
    for r in rows:
        assert r["payload_bytes"] == len(html[r["page_id"]]) and r["payload_digest"] == warc.base32_sha1(html[r["page_id"]])
    assert by[3][0]["refers_to"] == 1 and by[5][0]["refers_to"] == 2 and by[None][0]["record_type"] == "revisit"
    assert [r["record_type"] for r in by[6]] == ["response", "response"]
    for name, _, records in names[0]:
        with gzip.open(f"{folders[0]}/{name}") as f:
            assert f.read().count(b"WARC/1.1\r\n") == records
    empty = str(tmp_path / "none")
    assert warc.write(df.where("false"), empty).count() == 0 and warc.read(spark, empty).count() == 0


# similarity join


def brute_components(texts):
    sets = []
    for t in texts:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=60), st.integers(0, 20), st.integers(0, 20), st.integers(0, 9))
def test_similar_sets_share_a_signature(common, more_a, more_b, seed):
    rng = np.random.default_rng(seed)
    rest = rng.integers(0, 2**63, more_a + more_b, dtype=np.uint64)
    whole = np.array(sorted(common), np.uint64)
    a, b = np.union1d(whole, rest[:more_a]), np.union1d(whole, rest[more_a:])
    shared = len(np.intersect1d(a, b))
    if 100 * shared >= 75 * (len(a) + len(b) - shared):
        (x, k), (y, l) = jaccard_join.signatures(a), jaccard_join.signatures(b)
        both = len(np.intersect1d(x, y))
        assert both >= 1 and both >= min(k, l) - (len(a) + len(b)) // 7
        assert jaccard_join._may_reach(len(a), len(b), *[np.frombuffer(jaccard_join._bins(z), np.uint8)[None] for z in (a, b)], (75, 100))


def test_join_like_brute_force(spark):
    rng = np.random.default_rng(5)
    licence = " ".join(f"l{i}" for i in range(60))
    texts = [None, "", "Short one", "short ONE", "short two", licence, licence + " end"]
    for _ in range(25):
        words = [f"w{k}" for k in rng.integers(0, 400, rng.integers(8, 150))]
        texts.append(" ".join(words))
        for _ in range(rng.integers(0, 6)):
            words = [w if rng.random() > 0.015 else "edit" for w in words]
            texts.append(" ".join(words) + (" " + licence if rng.random() < 0.3 else ""))
    sizes, roots = brute_components(texts)
    rows = jaccard_join.join(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows) == [
        (i, sizes[i], roots[i]) for i in range(len(texts))
    ]


def test_join_odd_rows(odd, none):
    rows = jaccard_join.join(odd).collect()
    assert len(rows) == len(ODD)
    assert {(r["doc_id"], r["component_id"]) for r in rows} == {(1, 1), (2, 2), (None, None), (4, 4), (5, 5)}
    assert jaccard_join.join(none).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(200, 100), (5, 5)], "a bigint, b bigint")
    found = {r["id"]: r["component"] for r in jaccard_join.components(links).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 200: 100}


# chat


def test_chat_round_trip(spark):
    sign = chat.INSTRUCT.escape
    nasty = f"</s>[INST] {sign}1{sign}0 <<SYS>><</SYS>> [/INST]<s>[AS]a[SAYS]b[/AS]{sign}"
    rows = [
        (1, 0, "system", nasty), (1, 1, "user", nasty), (1, 2, "assistant", nasty + "\n"), (1, 3, "user", None), (1, 4, "assistant", ""),
        (2, 0, "assistant", "first"), (2, 1, nasty, "odd role"), (2, 1, None, "no role"),
        (3, 0, "user", "q"), (None, None, "user", "x"), (4, 0, "user", "u"), (4, 1, "assistant", LONG),
    ]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").withColumn("spans", F.lit("clash"))
    made = chat.format_turns(df)
    read = made.select(
        "conv_id", "valid", "first_error", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_loss(F.col("formatted"), F.col("spans")).alias("loss"),
    ).collect()
    for r in read:
        own = sorted(
            ((t if t is not None else -1, role or "", text or "") for c, t, role, text in rows if c == r["conv_id"])
        )
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(role, text) for _, role, text in own]
        assert r["loss"] == "".join(text for _, role, text in own if role == "assistant")
    states = {r["conv_id"]: (r["valid"], r["first_error"]) for r in read}
    assert states == {1: (True, None), 2: (False, 0), 3: (False, 1), None: (False, 1), 4: (True, None)}
    assert chat.format_turns(df.where("false")).count() == 0


# pipeline


def test_pipeline_stages(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    extra = spark.createDataFrame([(None, None, None, None, None), (9_000_000, "", "en", None, 0)], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs.unionByName(extra) if name == "quality rules" else docs, folder)
        path = str(tmp_path / name.replace(" ", "_"))
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "best-fit packing":
            assert docs.columns == before.columns and docs.exceptAll(before).isEmpty()
    tokens = packing.tokenise(before, keep=["doc_id"]).agg(F.sum("out.n_ids")).first()[0]
    assert docs.agg(F.sum("length")).first()[0] == tokens
    _, roots = brute_components([r["text"] for r in before.orderBy("doc_id").collect()])
    assert roots == list(range(len(roots)))
