"""Large groups of variants about the threshold: components as by brute force, from pairs that don't grow with the group's square."""

import random

from lastrum.llm import near_dedup
from tests.llm.test_queries import near

NAMES = [f"w{i}" for i in range(200)]


def variants(n, edits, seed=3):
    rnd, out = random.Random(seed), {}
    for i in range(n):
        words = list(NAMES)
        for _ in range(rnd.choice(edits)):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(10**9)}"
        out[i] = " ".join(words)
    return out


def run(spark, texts, monkeypatch):
    plain, made = near_dedup.save, []

    def save(df, name):
        out = plain(df, name)
        if name in ("pairs", "likely", "met", "family"):
            made.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "save", save)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(8)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.find(docs, 5, 80).collect()}, made


def test_variants_about_the_threshold(spark, monkeypatch):
    texts = variants(1000, (2, 3, 3, 4))
    got, made = run(spark, texts, monkeypatch)
    wanted = near(texts, 5, 80)
    assert got == wanted and len({c for _, c in wanted.values()}) > 20
    assert max(made) <= 20 * len(texts)


def test_five_thousand_near_copies(spark, monkeypatch):
    """All are linked with the unchanged text, by hand: 1 or 2 changed words of 200 leave a similarity of 0.9 or more."""
    texts = variants(5000, (0, 1, 1, 2))
    got, made = run(spark, texts, monkeypatch)
    assert {c for _, c in got.values()} == {0} and max(made) <= 40 * len(texts)
