"""The positional index decides: against a plain version of the method, and with parts of it taken away."""

import random
import re

from lastrum.llm import licenses

MIT = next(t for t in licenses.NOTICES if t.label == "mit" and len(t.words) > 50)


def plain(texts, templates, rarest=licenses.RAREST, least=licenses.LEAST, window=licenses.WINDOW):
    """labels of each text, word by word."""
    import math

    split = [re.findall(licenses.WORD, t.lower()) for t in texts]
    known = licenses.vocabulary(templates)
    idf = {w: math.log((len(texts) + 1) / (sum(w in s for s in split) + 1)) for w in known}
    out = []
    for own in split:
        by_idf = sorted(known, key=lambda w: (-idf[w], w))
        mine = [w for w in by_idf if w in own]
        rare, rarer = mine[:rarest], set(by_idf[: by_idf.index(mine[rarest - 1]) + 1] if len(mine) >= rarest else by_idf)
        found = {}
        able = [t for t in templates if set(t.key_words) <= set(own)]
        looked = set(rare) | {max(t.key_words, key=lambda w: (idf[w], w)) for t in able} | {w for t in able if t.base for w in t.words}
        for t in able:
            span = 0 if t.base else window
            ask = sum(w in looked or w in rarer for w in t.words)
            for start in range(-len(t.words), len(own)):
                at = start + t.key_at
                if own[max(at, 0) : max(at, 0) + len(t.key_words)] != t.key_words:
                    continue
                agree = sum(w in own[max(0, start + i - span) : max(0, start + i + span + 1)] for i, w in enumerate(t.words) if w in looked)
                if ask and agree and agree / ask >= (1 if t.base else least) and at >= 0 and own[at : at + len(t.key_words)] == t.key_words:
                    found[t.label] = max(found.get(t.label, 0), agree / ask)
        out.append(found)
    return out


def run(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return licenses.digest(licenses.scan(docs, **options)).orderBy("doc_id").collect()


def made():
    rnd, out = random.Random(4), []
    for t in licenses.NOTICES:
        for spoilt in (0, 3, 10):
            w = list(t.words)
            for _ in range(spoilt):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(99)}"
            out.append("some words before " + " ".join(w) + " and after all by the way")
    return out + ["cc by cc by all rights reserved", "the general of public license rights", "", "license " * 300]


def test_agrees_with_a_plain_version(spark):
    texts = made()
    got = run(spark, texts)
    wanted = plain(texts, licenses.BASE + licenses.NOTICES)
    assert [r.labels for r in got] == [",".join(sorted(w)) for w in wanted]
    assert [round(r.score, 9) for r in got] == [round(max(w.values(), default=0), 9) for w in wanted]


def edited(rnd, words, changes):
    """A text with words put in, left out or numbered otherwise."""
    out = list(words)
    for _ in range(changes):
        at = rnd.randrange(len(out))
        out[at : at + 1] = rnd.choice(([f"x{rnd.randrange(99)}", out[at]], [], [f"x{rnd.randrange(99)}"]))
    return " ".join(out)


def test_edited_licences_are_found(spark):
    rnd = random.Random(12)
    longs = {t.label: t for t in licenses.NOTICES if len(t.words) > 40}
    cases = [(t.label, edited(rnd, t.words, n)) for t in longs.values() for n in (1, 2, 3, 4, 5) for _ in range(8)]
    got = run(spark, ["The text of the file begins. " + text + " And goes on." for _, text in cases])
    assert {"mit", "bsd", "apache-2.0"} <= set(longs)
    found = [label in r.labels.split(",") for (label, _), r in zip(cases, got, strict=True)]
    assert sum(found) >= 0.9 * len(found)
    by = [sum(f for f, (label, _) in zip(found, cases, strict=True) if label == x) for x in longs]
    assert min(by) >= 0.8 * 40
    assert not any(r.labels for r in run(spark, [" ".join(rnd.sample(t.words, len(t.words))) for t in longs.values()]))


def test_identifiers(spark):
    texts = ["# SPDX-License-Identifier: Apache-2.0", "SPDX-License-Identifier: GPL-2.0-only", "Licensed under the GPL v2", "the identifier of a license, spdx or apache 2"]
    assert [r.labels for r in run(spark, texts)] == ["apache-2.0", "gpl-2.0", "gpl-2.0", ""]


def test_key_phrase_alone_is_not_enough(spark):
    """The words of the text about the key phrase decide, by the index."""
    whole, key = "Copyright Someone. " + MIT.text, "Permission is hereby granted free of charge to the other words that say nothing of copies or notice or sublicense or substantial portions merge furnished"
    assert [r.labels for r in run(spark, [whole, key])] == ["mit", ""]
    assert [r.labels for r in run(spark, [whole, key], rarest=0)] == ["", ""]


def test_base_phrases_need_their_postings(spark):
    text = ["x all rights reserved, all rights y reserved; cc by"]
    assert [(r.n_base, r.first_word, r.last_word, r.base_labels) for r in run(spark, text, rarest=0)] == [(2, 1, 8, "cc-by,reserved")]


def test_long_text_in_linear_work(spark):
    """A text of 600,000 licence words, all looked up, takes seconds."""
    text = ("copy of the license or software notice in all copies general public license " * 50_000)
    row = run(spark, [text])[0]
    assert row.n_words == 650_000 and row.n_base == 50_000
