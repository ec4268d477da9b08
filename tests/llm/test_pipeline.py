"""Each stage of the pipeline against a brute-force version on its own input."""

import pandas as pd
import pytest

import corpus_pipeline
from lastrum.llm.shared import save, table
from tests.llm.test_queries import LOW, near


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    docs, out = table(spark, sf_dir, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = save(stage(spark, docs, sf_dir), name)
        out.append((name, before, docs))
    return {name: (before.toPandas(), after.toPandas()) for name, before, after in out}


def test_columns_stay(steps):
    for name, (before, after) in list(steps.items())[:-1]:
        assert list(before.columns) == list(after.columns), name
        assert set(after.doc_id) <= set(before.doc_id) and 0 < len(after) <= len(before)


def test_quality_keeps_good(steps, sf_dir):
    before, after = steps["quality"]
    labels = pd.read_parquet(f"{sf_dir}/labels.parquet")
    good = set(labels[labels.quality == 1].doc_id)
    assert len(good & set(after.doc_id)) > 0.95 * len(good) and len(after) < len(before)


def test_exact(steps):
    before, after = steps["exact_dedup"]
    text = before.text.map(lambda t: (t or "").translate(LOW))
    assert set(after.doc_id) == set(before.doc_id.groupby(text).max())


def test_near(steps):
    before, after = steps["near_dedup"]
    found = near(dict(zip(before.doc_id, before.text, strict=True)), 5, 80)
    assert set(after.doc_id) == {c for _, c in found.values()}


def test_benchmark(steps, sf_dir):
    before, after = steps["decontaminate"]
    flat = lambda t: " ".join((t or "").translate(LOW).split())
    items = [flat(t) for t in pd.read_parquet(f"{sf_dir}/benchmark.parquet").text]
    held = {d for d, t in zip(before.doc_id, before.text, strict=True) if any(x in flat(t) for x in items)}
    assert not held & set(after.doc_id) and len(before) - len(after) <= len(held) + 2


def test_mix_covers_its_input(steps):
    before, after = steps["mix"]
    assert sorted(before.doc_id) == sorted(after.doc_id) and (after.taken == after.copies * after["size"]).all()


def test_odd_rows_pass_all_stages(spark, odd_docs, no_docs, sf_dir):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            docs = save(stage(spark, docs, sf_dir), name)
