"""The extendible-hash index: results go through its directory, chains and owner ranges."""

import pytest
from pyspark.sql import functions as F

from lastrum.llm import exact_dedup


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"text {i % 300}") for i in range(1000)] + [(1000, None), (1001, "")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(8)


def classes(df):
    return {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in df.collect()}


def test_splits_keep_the_result(docs):
    whole, split = exact_dedup.find(docs), exact_dedup.find(docs, bucket_keys=7)
    assert classes(whole) == classes(split)
    assert classes(split)[1001] == (1001, 2, True) and classes(split)[999] == (999, 4, True) and classes(split)[0] == (900, 4, False)


def test_each_bucket_has_one_owner(docs):
    _, index, rows = exact_dedup.build_index(docs, bucket_keys=7)
    assert rows == 1002 and index.select("bucket").distinct().count() > 20
    owners = index.select("bucket", "h", F.input_file_name().alias("file")).groupBy("bucket", "h").agg(F.countDistinct("file").alias("n"))
    assert owners.where("n > 1").count() == 0


def test_colliding_texts_chain(docs, monkeypatch):
    """With a hash of 4 values nearly all texts collide; the bytes still tell them apart."""
    plain = F.xxhash64
    wanted = classes(exact_dedup.find(docs))
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.shiftleft(F.pmod(plain(*c), F.lit(4)), 61) if c == ("norm",) else plain(*c))
    _, index, _ = exact_dedup.build_index(docs)
    assert index.agg(F.max("slot")).first()[0] > 50 and index.select("h").distinct().count() <= 4
    assert classes(exact_dedup.find(docs)) == wanted


def test_results_need_the_directory(docs, monkeypatch):
    """A directory that loses a bucket loses its documents."""
    whole = exact_dedup.find(docs, bucket_keys=50).count()
    plain = exact_dedup.pointers
    monkeypatch.setattr(exact_dedup, "pointers", lambda *a: plain(*a).where("bucket > 0"))
    assert exact_dedup.find(docs, bucket_keys=50).count() < whole


def test_clashing_names(spark):
    rows = [(2, "A", 1, b"x", 3, 4), (1, "a", 1, b"x", 3, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, copy_id int, copy_sha binary, h int, bucket int")
    kept = exact_dedup.dedup(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [2]
