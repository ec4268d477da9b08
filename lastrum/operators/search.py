"""Lexical search: TF-IDF vectors in long form, semantic ranking by cosine, full text, and both together.

Queries and documents meet by an equi join on their terms; nothing compares each query with each document. idf(t) =
ln(N / (1 + df)) + 1 over the corpus, weights are tf idf with an L2 norm of 1, and query terms that the corpus lacks drop out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lastrum.functions.numbers import fixed
from lastrum.functions.text import tokens
from lastrum.operators.tables import save, small, spread


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf). Terms are counted where their document is read, so nothing is shuffled: key is that of one row."""
    kind = docs.schema[key].dataType

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # few texts as Python objects at once
                few = batch.slice(at, 256)
                each = [Counter(words) for words in few.column(1).to_pylist()]
                n = pa.array([i for i, counts in enumerate(each) for _ in counts], pa.int64())
                columns = [few.column(0).take(n), pa.array([t for counts in each for t in counts], pa.string()), pa.array([f for counts in each for f in counts.values()], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [key, "term", "tf"])

    schema = StructType([StructField(key, kind), StructField("term", StringType()), StructField("tf", LongType())])
    return spread(docs.select(key, tokens(text).alias("_words"))).mapInArrow(counted, schema)


def idf(counts: DataFrame, n_docs: int) -> DataFrame:
    """(term, idf). Terms are combined before the shuffle, so a very frequent term is one row of each task."""
    return counts.groupBy("term").agg(F.count("*").alias("df")).select("term", (F.log(F.lit(float(n_docs)) / (1 + F.col("df"))) + 1).alias("idf"))


def weights(counts: DataFrame, idfs: DataFrame, key: str) -> DataFrame:
    """(key, term, weight) of unit vectors; documents whose norm is 0 have none."""
    raw = counts.join(idfs, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm.where("norm > 0"), key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def tfidf(docs: DataFrame, key: str, text: str) -> DataFrame:
    counts = save(term_counts(docs, key, text), "term_counts")
    return weights(counts, small(idf(counts, docs.count())), key)


def semantic_scores(queries: DataFrame, docs: DataFrame, query_key: str, key: str, text: str, query_text: str = "text") -> DataFrame:
    """(query_key, key, score) of all pairs that share a term; cosine rounded to 6, at most 1.

    Document terms are weighed once: their squares sum to the norms, which are joined with the pairs found, and only the terms
    that some query has meet the queries."""
    counts = save(term_counts(docs, key, text), "term_counts")
    idfs = small(save(idf(counts, docs.count()), "idf"))
    raw = counts.join(idfs, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")).where("norm > 0")
    q = small(save(weights(term_counts(queries, query_key, query_text), idfs, query_key).withColumnRenamed("weight", "qw"), "query_weights"))
    dots = raw.join(q, "term").groupBy(query_key, key).agg(F.sum(F.col("qw") * F.col("w")).alias("dot"))
    return dots.join(norms, key).select(query_key, key, F.least(fixed(F.col("dot") / F.col("norm"), 6), F.lit(1.0)).alias("score"))


def top_k(scored: DataFrame, query_key: str, key: str, k: int, score: str = "score") -> DataFrame:
    """Of each query the k best documents with a positive score; ties by key."""
    place = F.row_number().over(Window.partitionBy(query_key).orderBy(F.col(score).desc(), key))
    return scored.where(F.col(score) > 0).withColumn("posicao", place).where(F.col("posicao") <= k)


def text_score(text: Column | str, phrase: str, words: list[str], any_word: bool = False) -> Column:
    """Share of the words that the text contains, or null where it matches neither the phrase nor all words (any word).

    Without words everything matches, with a score of 0 (any word: only the phrase matches)."""
    low = F.lower(F.col(text) if isinstance(text, str) else text)
    hits = F.lit(0)
    for w in words:
        hits = hits + F.when(low.contains(w), 1).otherwise(0)
    matched = low.contains(phrase.lower()) | (hits > 0 if any_word else hits == len(words))
    return F.when(matched, hits / max(len(words), 1))


def full_text(docs: DataFrame, text: str, phrase: str, words: list[str]) -> DataFrame:
    score = fixed(text_score(text, phrase, words), 4)
    return docs.withColumn("score_relevancia", score).where(F.col("score_relevancia").isNotNull())


def hybrid(semantic: DataFrame, textual: DataFrame, key: str, weight: float = 0.6) -> DataFrame:
    """(key, score_combinado, score_semantica, score_textual) from (key, s) and (key, t); only positive ones."""
    both = semantic.join(textual, key, "full").select(key, F.coalesce("s", F.lit(0.0)).alias("s"), F.coalesce("t", F.lit(0.0)).alias("t"))
    out = both.withColumn("score_combinado", fixed(F.col("s") * weight + F.col("t") * round(1 - weight, 2), 4)).where("score_combinado > 0")
    return out.select(key, "score_combinado", fixed("s", 4).alias("score_semantica"), fixed("t", 4).alias("score_textual"))


def search_with_fallback(hits: DataFrame, fallback: DataFrame, n_words: int) -> DataFrame:
    """hits, or where there are none and the query has more than three words, the rows of fallback; both with the same columns."""
    if n_words <= 3:
        return hits
    found = hits.agg((F.count("*") == 0).alias("_none"))
    return hits.unionByName(fallback.crossJoin(found).where("_none").drop("_none"))  # one row


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two arrays rounded to 6, at most 1; 0 for a zero norm or different lengths."""
    x, y = (F.col(v) if isinstance(v, str) else v for v in (a, b))
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    norms = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when((F.size(x) == F.size(y)) & (norms > 0), F.least(fixed(dot(x, y) / norms, 6), F.lit(1.0))).otherwise(0.0)
