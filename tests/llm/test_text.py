"""Tokenizing, leakage and quality against plain versions."""

import base64
import random

import numpy as np
import pytest
import regex

from strandline.llm import leakage, quality, tokenizer

TEXTS = [
    None,
    "",
    " ",
    "   \n\n  ",
    "a",
    "Hello, world's  first   tokenizer!\n\n  It's 123 4567 x",
    "foo \nbar  \t baz \n",
    "İstanbul ΣΑΣ straße ſ K ﬃ 漢字かな交じり文 🙂🙂 é",
    "tab\tnbsp  x   y　",
    "'s 't 're 've 'm 'll 'd 'S",
    "<|endoftext|> x",
    "-" * 300 + "ab" * 200,
    "\x00\x1c\x1d\x85 control ​ zero",
    "word " * 3000,
]


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    with open(f"{tokenizer.TOKENIZER_DIR}/{tokenizer.BYTE_BPE_50K}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_ids_match_a_plain_encoder(spark, reference):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("ab 1.\n\t'é ") for _ in range(rng.randint(1, 60))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "'x' as ids", "1 as words")
    for hot in (5, 1000):
        got = tokenizer.encode(df, hot_items=hot)
        found = {r.doc_id: r.ids for r in got.select("doc_id", "ids").collect()}
        assert found == {i: reference.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    back = tokenizer.decode(got.select("doc_id", "ids")).collect()
    assert {r.doc_id: r.text for r in back} == {i: t or "" for i, t in enumerate(texts)}


def test_encoding_of_no_rows_and_unknown_ids(spark):
    assert tokenizer.encode(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    rows = spark.createDataFrame([([50_256],), (None,), ([],)], "ids array<int>")
    assert [r.text for r in tokenizer.decode(rows).collect()] == [None, None, ""]


WORD = regex.compile(r"[\p{L}\p{N}]+")


def plain_leaks(docs, items):
    out = set()
    for d, text in docs:
        own = WORD.findall((text or "").lower())
        for i, passage in items:
            words = WORD.findall((passage or "").lower())
            n = min(len(words), 13)
            if n:
                grams = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}
                if any(tuple(own[k : k + n]) in grams for k in range(len(own) - n + 1)):
                    out.add((d, i))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    vocabulary = ["the", "Of", "röhre", "x1", "12", "A", "b", "c"] + [f"w{i}" for i in range(12)]

    def text(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "-", "\n", "_"]) for _ in range(n))

    items = [(i, text(rng.choice([1, 2, 3, 5, 12, 13, 14, 30]))) for i in range(40)] + [(90, None), (91, ""), (92, "--"), (93, "the the the the the the the the the the the the the the")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(80)]
    for d in range(100, 160):
        passage = rng.choice(items[:40])[1]
        cut = rng.randint(0, max(0, len(passage) // 3))
        docs.append((d, text(9) + passage[cut:].upper() + " " + text(9)))
    docs += [(200, None), (201, ""), (202, "the " * 400), (202, "the " * 400)]
    return docs, items


@pytest.mark.parametrize("bound", [0, 200_000])
def test_leaks_match_all_pairs(spark, corpus, monkeypatch, bound):
    docs, items = corpus
    monkeypatch.setattr(leakage, "BROADCAST_FINGERPRINTS", bound)
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as item", "2 as at")
    found = [tuple(r) for r in leakage.leaks(d, spark.createDataFrame(items, "item_id int, text string").selectExpr("*", "3 as doc")).collect()]
    assert len(found) == len(set(found))
    assert set(found) == plain_leaks(docs, items)


@pytest.mark.parametrize("bound", [0, 200_000])
def test_leaks_of_null_and_repeated_ids(spark, monkeypatch, bound):
    monkeypatch.setattr(leakage, "BROADCAST_FINGERPRINTS", bound)
    one, two, three = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    docs = [(None, f"x {one}"), (5, f"y {two}"), (5, f"u v w {three}"), (6, "none")]
    items = [(None, one), (1, one), (2, two), (2, "z " * 3 + three)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    found = [tuple(r) for r in leakage.leaks(d, spark.createDataFrame(items, "item_id int, text string")).collect()]
    assert len(found) == len(set(found)) and set(found) == plain_leaks(docs, items)


def test_leaks_of_empty_tables(spark, corpus):
    docs, items = corpus
    none_d, none_i = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "item_id int, text string")
    assert leakage.leaks(none_d, spark.createDataFrame(items, "item_id int, text string")).count() == 0
    assert leakage.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), none_i).count() == 0


def signs_of(text, common):
    words = WORD.findall(text.lower())
    if not words:
        return 0
    solid = [c for c in text if c not in " \t\r\n"]
    lines = [x for x in (y.strip(" \t\r") for y in text.split("\n")) if x]
    mean = sum(map(len, words)) / len(words)
    return (
        (sum(w in common for w in words) / len(words) < 0.15)
        + (sum(not WORD.match(c) for c in solid) / len(solid) > 0.2)
        + (mean < 3 or mean > 11)
        + (sum(x[-1] in ".!?;:" for x in lines) / len(lines) < 0.25)
    )


def test_quality_of_odd_texts(spark):
    texts = [*TEXTS, "The cat sat on the mat.\nThe dog, too.", "a.\r\n\r\nb:\t\n c ", "x" * 5000, "1;2;3\n4;5;6", "the\n\nthe.\n", ". . .", "İ the of"]
    common = spark.createDataFrame([("the", "en"), ("of", "en"), ("of", "xx"), (None, "en")], "word string, lang string")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "9 as signs", "8 as letters")
    got = {r.doc_id: r for r in quality.statistics(df, common).collect()}
    assert {i: r.signs for i, r in got.items()} == {i: signs_of(t or "", {"the", "of"}) for i, t in enumerate(texts)}
    assert got[0].n_words == got[1].n_words == 0 and got[0].symbol_ratio == 0.0
    found = {r.doc_id for r in quality.not_prose(df, common).collect()}
    assert found == {i for i, t in enumerate(texts) if signs_of(t or "", {"the", "of"}) >= 2}
    assert quality.not_prose(df.limit(0), common).count() == 0


def sf_tables(spark, sf="0.01"):
    return [spark.read.parquet(f"/root/testdata/sf{sf}/{t}.parquet") for t in ("documents", "common_words")]


def test_holdout_is_of_the_documents_named(spark):
    stats = {r.doc_id: r for r in quality.statistics(*sf_tables(spark)).collect()}
    assert len(quality.HOLDOUT) == 46 and len(quality.MEASURED) == 45
    for doc_id, *numbers, _ in quality.HOLDOUT + quality.MEASURED:
        assert [stats[doc_id][c] for c in quality.FEATURES] == pytest.approx(numbers, abs=0.001)
    assert not {r[0] for r in quality.HOLDOUT} & {r[0] for r in quality.MEASURED}


def test_classifier_on_documents_kept_out(spark):
    documents, common = sf_tables(spark)
    kept_out = [r[0] for r in quality.MEASURED + quality.HOLDOUT]
    stats = quality.statistics(documents.where(~documents.doc_id.isin(kept_out)), common)
    model = quality.ProseClassifier.train(stats)
    measured = np.array(quality.MEASURED, dtype=float)
    p, junk = model.probabilities(measured[:, 1:-1]), measured[:, -1] == 1
    assert ((p > 0.5) == junk).mean() >= 0.95
    assert np.mean((p - junk) ** 2) < 0.05


def test_expressions_score_as_the_trees(spark):
    rng = np.random.default_rng(5)
    x = rng.random((400, 5)) * [500, 10, 1, 1, 1]
    model = quality.ProseClassifier.fit(x, (x[:, 2] + 0.2 * rng.random(400) > 0.6).astype(float))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], quality.FEATURES)
    assert [r.p_junk for r in model.score(df).collect()] == pytest.approx(list(model.probabilities(x)))


def test_no_document_with_two_signs_is_ruled_out(spark):
    prose = "The cat of the house sat on the mat near the door. " * 5
    junk = "zq1 xv2 kj3 wq4\n" * 500
    rows = [(i, prose) for i in range(40)] + [(40 + i, junk) for i in range(40)] + [(90, "zq1 kj3\nwq4")]
    common = spark.createDataFrame([(w,) for w in ("the", "of", "on", "near")], "word string")
    found = {r.doc_id for r in quality.not_prose(spark.createDataFrame(rows, "doc_id bigint, text string"), common).collect()}
    assert found == {*range(40, 80), 90}


def test_what_is_found_takes_no_classifier(spark, monkeypatch):
    texts = [*TEXTS, "the cat of the mat", "zq1 xv2\nkj3", "zq1 xv2\nkj3", "1;2;3\n4;5;6", "the of.", None, "", ". . ."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    common = spark.createDataFrame([("the",), ("of",), (None,)], "word string")
    want = [i for i, t in enumerate(texts) if signs_of(t or "", {"the", "of"}) >= 2]
    assert 0 < len(want) < len(texts)

    def unwanted(*_):
        raise AssertionError("a stage without effect on the result")

    for name in ("train", "score"):
        monkeypatch.setattr(quality.ProseClassifier, name, unwanted)
    monkeypatch.setattr(quality, "cut_lineage", unwanted)
    found = quality.not_prose(df, common)
    assert sorted(r.doc_id for r in found.collect()) == want
    assert found._jdf.queryExecution().optimizedPlan().toString().count(quality.WORD) == 1  # words are cut once
    monkeypatch.setattr(quality, "MOST_COMMON_WORDS", 1)
    assert sorted(r.doc_id for r in quality.not_prose(df, common).collect()) == want


def test_long_lists_of_common_words_are_joined(spark, monkeypatch):
    texts = [*TEXTS, "the cat of the mat", "the cat of the mat", "dog the", None, ""]
    df = spark.createDataFrame([(None if i % 3 else i % 2, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    common = spark.createDataFrame([("the",), ("of",), ("of",), (None,)], "word string")
    want = sorted(map(repr, quality.statistics(df, common).collect()))
    monkeypatch.setattr(quality, "MOST_COMMON_WORDS", 1)
    assert sorted(map(repr, quality.statistics(df, common).collect())) == want


def test_calibration_follows_the_labels():
    margins, labels = np.array([-2.0, -1.5, -1.0, 1.0, 1.5, 2.0]), np.array([0, 0, 0, 1, 1, 1.0])
    slope, offset = quality.fit_calibration(margins, labels)
    assert slope > 0 and abs(offset) < 1
