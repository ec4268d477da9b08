"""Pages by histograms against the global sort."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from lastrum.operators import facts, paging


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    made = []
    for k in range(3000):
        value = None if k % 17 == 0 else 7.5 if k % 3 == 0 else rng.choice((rng.gauss(0, 1e6), rng.random() * 1e-6, -1e308, 1e308, float(rng.randrange(5))))
        made.append((value, date(2020, 1, 1) + timedelta(rng.randrange(4)) if k % 11 else None, f"{rng.choice('aAé~')}{k:05d}" if k % 50 else "same"))
    return spark.createDataFrame(made, "preco double, data date, item_id string").cache()


@pytest.mark.parametrize("by", ["preco", "data"])
@pytest.mark.parametrize("descending", [True, False])
def test_pages_are_those_of_the_sort(rows, by, descending):
    order = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    wanted = [tuple(r)[:2] if r["item_id"] == "same" else tuple(r) for r in rows.orderBy(order, "item_id").collect()]
    for number, size in ((1, 10), (31, 90), (414, 7), (300, 10), (400, 10)):
        got = [tuple(r)[:2] if r["item_id"] == "same" else tuple(r) for r in paging.page(rows, number, size, by, descending, most=40).collect()]
        want = wanted[(number - 1) * size : number * size]
        assert [str(g[0 if by == "preco" else 1]) + str(g[2:]) for g in got] == [str(w[0 if by == "preco" else 1]) + str(w[2:]) for w in want]


def test_a_range_is_small(rows):
    keys = rows.select(F.col("preco").alias("x"), F.col("item_id").alias("key"))
    for rank in range(0, 3000, 730):
        p = paging.find(keys, rank, 40)
        x, key = F.col("x"), F.col("key")
        inside = keys.where(paging._after(x, key, p) & paging._upto(x, key, p)).count()
        assert inside <= 60 and keys.where(~paging._after(x, key, p)).count() == p.before <= rank < p.before + inside


def test_listing_goes_deep(rows, monkeypatch):
    wanted = facts.page(rows, 50, 30, "preco").select("item_id").collect()
    monkeypatch.setattr(paging, "MOST", 40)
    assert facts.page(rows, 50, 30, "preco").select("item_id").collect() == wanted
