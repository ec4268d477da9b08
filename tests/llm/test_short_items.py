"""Benchmark items too short for the q-gram lemma are found exactly, between word boundaries."""

import random

from lastrum.llm import decontaminate


def test_short_items_are_found(spark):
    texts = ["Q: What is  the\nCAPITAL of Peru? A: Lima", "what is the capital of peru", "limabean", "say: lima.", "(lima) and lima", "x", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, "What is the capital of Peru?"), (2, "Lima"), (3, "  "), (4, None), (5, "x"), (6, ""), (2, "Lima")], "item_id long, text string")
    got = sorted(tuple(r) for r in decontaminate.find(docs, items).collect())
    assert got == [(0, 1, 3, 32, 0), (0, 2, 36, 40, 0), (0, 2, 36, 40, 0), (3, 2, 5, 9, 0), (3, 2, 5, 9, 0), (4, 2, 1, 5, 0), (4, 2, 1, 5, 0), (4, 2, 11, 15, 0), (4, 2, 11, 15, 0), (5, 5, 0, 1, 0)]
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items).collect()) == [1, 2, 6, 7]


def test_short_items_as_by_brute_force():
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abé") for _ in range(rnd.randint(1, 3)))
    text = " ".join(word() + rnd.choice(("", "", "-", ".")) for _ in range(300))
    items = list({" ".join(word() for _ in range(rnd.randint(1, 5))) for _ in range(400)})
    index = decontaminate.Index(list(range(len(items))), [decontaminate.normal(x)[0] for x in items], decontaminate.Q, decontaminate.ERROR)
    inside = lambda x, at: any(i + len(x) <= len(text) and text.startswith(x, i) and (i == 0 or not text[i - 1].isalnum()) and not text[i + len(x) : i + len(x) + 1].isalnum() for i in at)
    wanted = {i for i, x in enumerate(items) if inside(x, range(len(text)))}
    got = index.hits(text)
    assert {i for i, *_ in got} == wanted and 0 < len(wanted) < len(items)
    assert all(text[s:e] == items[i] for i, s, e, _ in got)
