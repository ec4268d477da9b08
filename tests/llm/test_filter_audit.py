"""The filter audit against all orders applied one after the other to each document."""

import random
import re
from collections import defaultdict
from itertools import permutations

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lastrum.llm import filter_audit
from lastrum.llm.filter_audit import Chains, audit, copies, failures, features
from lastrum.llm.shared import save

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_failures(text):
    words = WORD.findall(text)
    return {
        name
        for name, fails in {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
        }.items()
        if fails
    }


def plain(rows, labels):
    """rows of (doc_id, text, lang)"""
    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, t in labels if t == 1} - {None}
    least = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    docs = [(lang or "", plain_failures(text or "") | ({"E"} if doc_id is not None and doc_id > least[text or ""] else set()), doc_id in good, doc_id in toxic) for doc_id, text, lang in rows]
    out, total = {}, defaultdict(int)
    for order in permutations("ABCDE"):
        for part in {d[0] for d in docs}:
            left = [d for d in docs if d[0] == part]
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                failing = [d for d in docs if d[0] == part and f in d[1]]
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(d[1] == {f} for d in failing), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                total[part, f] += len(gone)
    return {(part, order, step): (*v, total[part, order[step - 1]]) for (part, order, step), v in out.items()}


def check(docs, labels):
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in audit(docs, labels).collect()}
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.select("doc_id", "text", "lang").collect()]
    assert got == plain(rows, [(r["doc_id"], r["quality"], r["toxic"]) for r in labels.collect()])
    return got


def test_odd_documents(odd_docs, labels):
    assert len(check(odd_docs, labels)) == 600 * 3


def test_no_documents(no_docs, labels):
    assert audit(no_docs, labels).count() == 0


@pytest.mark.parametrize("held", [1, filter_audit.HELD])
def test_copies_in_many_tasks(spark, labels, held, monkeypatch):
    """A third of all rows is one text; chains are sent on early; rows repeat, and one id stands in two parts."""
    monkeypatch.setattr(filter_audit, "HELD", held)
    rng = random.Random(5)
    texts = [" ".join(rng.choice(("alpha", "Beta", "GAMMA", "x|y", "é")) for _ in range(n)) for n in (0, 3, 99, 100, 130, 200)]
    rows = [(rng.randrange(400), texts[3] if k % 3 == 0 else rng.choice(texts), rng.choice(("en", "de", None, ""))) for k in range(600)]
    rows += [(None, texts[3], "en")] * 3 + [(-7, texts[3], "en"), (-7, texts[3], "de"), (-7, texts[3], "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    assert len(check(docs, labels)) == 600 * 3


def test_every_distribution_of_masks(spark):
    """All 32 masks occur, so each count of each step is told apart."""
    rows = []
    for mask in range(16):
        words = ["w"] * 20 if mask & 2 else [f"w{k}" for k in range(20)]
        words = words if mask & 1 else words * 6 if mask & 2 else [f"w{k}" for k in range(120)]
        text = " ".join(w.upper() if mask & 4 else w for w in words) + " #" * bool(mask & 8) + f" t{mask}"
        rows += [(100 * mask + k, text, "en") for k in range(1 + mask % 3 + 1)]
    assert len({frozenset(plain_failures(text)) for _, text, _ in rows}) == 16
    check(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(100, 1, 0), (101, 1, 1), (701, 0, 1), (1501, 1, 1)], "doc_id long, quality int, toxic int"))


def test_equal_fingerprints_are_told_apart_by_text():
    chains = Chains()
    assert chains.meet(1, b"a", 5, {"x": 1}) is None
    assert chains.meet(1, b"b", 6, {"x": 1}) is None
    assert chains.meet(1, b"a", 7, {"y": 1})[1:] == (7, {"y": 1})
    assert chains.meet(1, b"b", 2, {"y": 1})[1:] == (6, {"x": 1})
    assert chains.meet(1, b"a", 5, {"y": 2}) is None
    assert chains.of[1][0][1:3] == [5, {"x": 1, "y": 2}]


def test_a_filter_that_lets_all_pass_changes_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"text {k % 700}", "en") for k in range(1000)], "doc_id long, text string, lang string")
    rows = save(features(docs), "features")
    wanted = sorted(range(700, 1000))
    assert sorted(r["doc_id"] for r in copies(docs, rows).collect()) == wanted
    monkeypatch.setattr(filter_audit, "FILTER_POWER", 1)
    assert sorted(r["doc_id"] for r in copies(docs, rows).collect()) == wanted


@given(st.text(alphabet="aB #é\t\x85 \x1c", max_size=300))
def test_failures_of_any_text(text):
    assert {f for k, f in enumerate("ABCD") if failures(text.encode()) >> k & 1} == plain_failures(text)


def test_pieces_of_a_long_text():
    text = "word " * 300_000 + "x" * 2_000_000 + " tail"
    assert {f for k, f in enumerate("ABCD") if failures(text.encode()) >> k & 1} == plain_failures(text)
