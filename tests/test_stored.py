"""Stored tables: versions, reruns, jobs that end before the switch, and counters against a serial run."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lastrum.operators import ingestion, quality, usage
from lastrum.sources.stored import StoredTable


def upsert(old, new):
    return quality.upserted(old, new, "k", "v")


def rows(table, version=None):
    return sorted(map(tuple, table.read(version).collect()))


@pytest.fixture
def table(spark, tmp_path):
    return StoredTable(spark, f"file://{tmp_path}/t", "k long, v int, name string", ["k"], buckets=5)


def test_only_touched_buckets_are_written(spark, table):
    make = lambda *r: spark.createDataFrame(r, table.schema)
    assert table.merge(0, make(*((k, 0, f"a{k}") for k in range(20))), upsert) == 1
    before = table.current()["folders"]
    assert table.merge(1, make((3, 1, "new"), (3, 0, "old"), (4, -1, "late")), upsert) == 2
    after = table.current()["folders"]
    assert 3 <= sum(before[b] == after[b] for b in before) < 5
    assert rows(table) == sorted([(k, 0, f"a{k}") for k in range(20) if k != 3] + [(3, 1, "new")])
    assert rows(table, 1) == sorted((k, 0, f"a{k}") for k in range(20))


def test_rerun_and_lost_job(spark, table):
    one = spark.createDataFrame([(1, 1, "a")], table.schema)
    two = spark.createDataFrame([(1, 2, "b"), (2, 1, "c")], table.schema)
    table.merge(0, one, upsert)

    def killed():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        table.merge(1, two, upsert, before_switch=killed)
    assert rows(table) == [(1, 1, "a")] and table.current()["version"] == 1
    assert table.merge(1, two, upsert) == 2 and table.merge(1, one, upsert) == 2 and table.merge(0, one, upsert) == 2
    assert rows(table) == [(1, 2, "b"), (2, 1, "c")]


def test_two_writers(spark, table):
    one = spark.createDataFrame([(1, 1, "a")], table.schema)
    with pytest.raises(RuntimeError, match="another job"):
        table.merge(0, one, upsert, before_switch=lambda: table.merge(0, one, upsert, source="other"))
    assert table.current()["batches"] == {"other": 0}


def test_old_versions_go(spark, table):
    for b in range(4):
        table.merge(b, spark.createDataFrame([(b, b, "x")], table.schema), upsert)
    table.drop_versions(keep=1)
    assert len(rows(table)) == 4 and table._versions() == [4]


def test_deleted_rows_empty_a_bucket(spark, table):
    one = spark.createDataFrame([(1, 1, "a")], table.schema)
    table.merge(0, one, upsert)
    table.merge(1, one, lambda old, new: ingestion.deleted(old, new, "k"))
    assert rows(table) == [] and table.current()["folders"] == {}


def serial(events):
    state = {}
    for key, ts, plan in sorted(events, key=lambda e: (e[1], e[2] is None)):
        slot = state.setdefault((key, ts.strftime("%Y-%m")), [None, None, 0])
        if plan:
            slot[:] = plan, ts, 0
        elif slot[1] is None or ts > slot[1]:
            slot[2] += 1
    return sorted((k, m, *v) for (k, m), v in state.items())


def test_counters_equal_a_serial_run(spark, tmp_path):
    rng = random.Random(8)
    start = datetime(2024, 1, 1)
    events = [(rng.randrange(6), start + timedelta(hours=k // 2), rng.choice((None,) * 9 + ("pro",))) for k in range(3000)]
    table = StoredTable(spark, f"file://{tmp_path}/c", usage.COUNTERS, ["chave"], buckets=3)
    for b in (0, 1, 1, 2, 0):
        part = spark.createDataFrame(events[b * 1000 : b * 1000 + 1000], "chave long, ts timestamp_ntz, plano string")
        table.merge(b, part, usage.counted)
    assert sorted(map(tuple, table.read().collect()), key=str) == sorted(serial(events), key=str)
    assert table.current()["version"] == 3


def test_fill_of_nulls(spark, table):
    """A backfill is a merge of the keys that lack a value."""
    make = lambda *r: spark.createDataFrame(r, table.schema)
    table.merge(0, make((1, 0, None), (2, 0, "kept")), upsert)
    lacking = table.read().where("name IS NULL")
    table.merge(1, lacking, lambda old, new: old.join(new.select("k", F.lit("filled").alias("_f")), "k", "left").withColumn("name", F.coalesce("name", "_f")).drop("_f"))
    assert rows(table) == [(1, 0, "filled"), (2, 0, "kept")]
