"""Decontamination: every place within the edit budget, in bounded memory."""

import random
import tracemalloc

import numpy as np
import pytest

from lastrum.llm import decontaminate
from lastrum.llm.decontaminate import Index, normal


def index(*items, **options):
    return Index(list(range(len(items))), [normal(x)[0] for x in items], decontaminate.Q, decontaminate.ERROR, **options)


def least_edits(item, text):
    """Fewest edits between the item and any part of the text, by the whole table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


@pytest.mark.parametrize("seed", range(4))
def test_each_passage_within_the_budget_is_found(seed):
    rnd = random.Random(seed)
    letters = "abcdefgh "[: rnd.choice((3, 9))]
    prose = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    for _ in range(40):
        item = "x" + prose(rnd.randrange(60, 160)) + "x"
        item = " ".join(item.split())
        budget = min(int(len(item) * decontaminate.ERROR), (len(item) - decontaminate.Q) // decontaminate.Q)
        copy = list(item)
        for _ in range(rnd.randrange(0, budget + 3)):
            at = rnd.randrange(len(copy))
            kind = rnd.randrange(3)
            copy[at : at + (kind != 0)] = [] if kind == 2 else [rnd.choice("klm")]
        text = " ".join(("y" + prose(50) + "y" + "".join(copy) + "z" + prose(50)).split())
        edits = least_edits(item, text)
        hits = index(item).hits(text)
        assert (edits <= budget) == bool(hits), (item, text)
        if hits:
            assert min(h[3] for h in hits) == edits
            for _, start, end, n in hits:
                assert least_edits(item, text[start:end]) == n


def test_all_places():
    item = "the quick onyx goblin jumps over the lazy dwarf and sings a song of old"
    text = f"a {item} b {item.replace('quick', 'quack')} c {item.upper()}"
    got = index(item).hits(text)
    assert [(text[s:e].lower(), n) for _, s, e, n in got] == [(item, 0), (item.replace("quick", "quack"), 1), (item, 0)]
    assert [(s, e) for _, s, e, _ in index("short one").hits("short one, Short  one; shorter one")] == [(0, 9), (11, 21)]


def test_slices_change_nothing(monkeypatch):
    item, text = "ab" * 60, "x" + "ab" * 900 + "ba" * 50
    whole = index(item).hits(text)
    for size in (500, 1000, 33_333):
        monkeypatch.setattr(decontaminate, "SLICE", size)
        assert index(item).hits(text) == whole
    assert len(whole) >= 10 and all(a[2] <= b[1] for a, b in zip(whole, whole[1:]))


def test_recurring_grams_take_no_memory():
    item, text = "-" * 400, "-" * 20_000
    found = index(item)
    tracemalloc.start()
    bands = found.bands(normal(text)[0])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert bands and peak < 120e6


def test_index_size():
    rnd = random.Random(1)
    items = ["".join(rnd.choice("abcdefghijklmnop ") for _ in range(500)) for _ in range(400)]
    found = index(*items)
    size = sum(x.nbytes for x in (found.hashes, found.item, found.pos, found.bits))
    assert size <= 28 * sum(map(len, items))
    assert len(found.maybe(np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))) < 0.1 * (1 << 16)


def test_blocks_in_turn(spark):
    items = spark.createDataFrame([(i, f"item number {i} speaks of the house by the river and of {i * i} boats") for i in range(12)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"before item number {i} speaks of the house by the river and of {i * i} boats after") for i in range(0, 20, 2)] + [(99, None), (100, "clean")], "doc_id long, text string")
    found = lambda size: sorted(tuple(r) for r in decontaminate.find(docs, items, block_chars=size).collect() if r["edits"] == 0)
    assert found(150) == found(1 << 20) and {r[0] for r in found(150)} == {0, 2, 4, 6, 8, 10}
    kept = lambda size: sorted(r.doc_id for r in decontaminate.clean(docs, items, block_chars=size).collect())
    assert kept(150) == kept(1 << 20) and {99, 100} <= set(kept(150)) and not {0, 2, 10} & set(kept(150))


def test_many_blocks_copy_no_documents(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"item number {i} speaks of the house by the river and of {i * i} boats") for i in range(12)], "item_id long, text string")
    rows = [(i, f"before item number {i} speaks of the house by the river and of {i * i} boats after", i) for i in range(0, 20, 2)]
    docs = spark.createDataFrame([*rows, *rows, (99, None, 1), (100, "clean", 2), (101, "", 3), (None, rows[0][1], 4)], "doc_id long, text string, text_hash long")
    written = []
    monkeypatch.setattr(decontaminate, "save", lambda df, name, real=decontaminate.save: written.append(df.columns) or real(df, name))
    kept = decontaminate.clean(docs, items, block_chars=150)
    assert len(written) >= 5 and all(len(c) == 1 and c != ["text"] for c in written)
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect()) == sorted(tuple(r) for r in decontaminate.clean(docs, items).collect())
