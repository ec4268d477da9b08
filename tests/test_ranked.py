"""The block index against all pairs: the same rows with most postings closed."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lastrum.operators import ranked, search
from lastrum.operators.ranked import idf, index_of, query_weights, term_lists
from lastrum.operators.tables import save


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(20_000)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for k in range(700)]
    rows += [(700 + k, rows[3][1]) for k in range(40)] + [(800, ""), (801, None), (802, "de da")]
    queries = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 15)))) for k in range(25)] + [(30, rows[3][1]), (31, "unseen"), (32, None)]
    return spark.createDataFrame(queries, "q long, text string"), spark.createDataFrame(rows, "id long, text string").repartition(3)


@pytest.mark.parametrize(("segment", "block", "batch"), [(4096, 4, 500_000), (50, 3, 40)])
def test_same_rows_as_all_pairs(spark, corpus, segment, block, batch, monkeypatch):
    for name, value in (("SEGMENT", segment), ("BLOCK", block), ("BATCH", batch)):
        monkeypatch.setattr(ranked, name, value)
    queries, docs = corpus
    wanted = search.top_k(search.semantic_scores(queries, docs, "q", "id", "text"), "q", "id", 7)
    got = ranked.top(queries, docs, "q", "id", 7)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.select("q", "id", "score", "posicao").collect()))


def test_most_postings_stay_closed(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(ranked, "spread", lambda df: df.coalesce(1))  # one segment: few documents in many give no room to close blocks
    docs, queries = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    lists = term_lists(docs, "doc_id", "text")
    idfs = idf(lists)
    weights = save(query_weights(queries, "item_id", "text", idfs), "weights")
    found, counts = ranked.search(index_of(lists, idfs), weights, 5)
    row = counts.first()
    assert found.count() == 5 * queries.count() and 0 < row["touched"] <= row["of"] / 3, row  # a tenth on ten times the documents
    pairs = lists.where("term IS NOT NULL").select("term", F.size("slots").alias("n")).join(weights, "term").agg(F.sum("n")).first()[0]
    assert row["of"] == pairs


def test_no_documents_and_no_queries(spark, corpus):
    queries, docs = corpus
    assert ranked.top(queries, docs.limit(0), "q", "id", 3).count() == 0
    assert ranked.top(queries.limit(0), docs, "q", "id", 3).count() == 0
    with pytest.raises(TypeError):
        ranked.top(queries, docs.withColumn("id", F.col("id").cast("string")), "q", "id", 3)


def test_lists_are_grouped_in_order():
    a, b = ranked._grouped(np.array([1, 0, 1, 3]), 4, np.array([5, 6, 7, 8]), np.array([1.0, 2.0, 3.0, 4.0]))
    assert a.to_pylist() == [[6], [5, 7], [], [8]] and b.to_pylist() == [[2.0], [1.0, 3.0], [], [4.0]]
