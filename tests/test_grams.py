"""Substring search by trigrams against contains()."""

import random

import pytest

from lastrum.operators import grams


@pytest.mark.parametrize("segment", [4096, 7])
def test_same_as_contains(spark, segment, monkeypatch):
    monkeypatch.setattr(grams, "SEGMENT", segment)
    rng = random.Random(2)
    texts = {k: "".join(rng.choice("abÀé \U0001f600xyz") for _ in range(rng.randrange(0, 40))) for k in range(300)} | {400: "", 401: "a", 402: "ab", 403: None, 404: "\0", 405: "İ straße"}
    wanted = ["a", "B", "é", "ab", "YZ", "\U0001f600", " x\U0001f600", "à", "abx", "xyzx", "zzzzzzzz", "q", "qq", "", None, "straße", "\0"] + [rng.choice([t for t in texts.values() if t])[3:9] for _ in range(30)]
    docs = spark.createDataFrame([*texts.items(), (None, "abx")], "id long, body string").repartition(3)
    index = grams.build(docs, "id", "body")
    got = grams.search(index, spark.createDataFrame(list(enumerate(wanted)), "p long, w string"), "p", "w")
    assert sorted(map(tuple, got.collect())) == sorted((p, k) for p, w in enumerate(wanted) if w is not None for k, t in texts.items() if t is not None and w.lower() in t.lower())


def test_few_texts_are_looked_at(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = grams.build(docs, "doc_id", "text")
    asked = spark.createDataFrame([(1, "all rights reserved"), (2, "general public license")], "pattern long, wanted string")
    some = grams.candidates(index, asked).groupBy("pattern").count().collect()
    hits = {r["pattern"]: r["count"] for r in grams.search(index, asked, "pattern", "wanted").groupBy("pattern").count().collect()}
    assert hits == {1: docs.where("contains(lower(text), 'all rights reserved')").count(), 2: docs.where("contains(lower(text), 'general public license')").count()}
    assert all(hits[r["pattern"]] <= r["count"] <= docs.count() / 5 for r in some)


def test_lists_are_found_by_their_trigram(spark):
    """The trigrams reach the scan as filters of their column."""
    index = grams.build(spark.createDataFrame([(k, f"text number {k}") for k in range(100)], "id long, body string"), "id", "body")
    plan = index.lists.where("gram IN (5, 6)")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram, [5,6])]" in plan
