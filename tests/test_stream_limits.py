"""Rate limits of a stream with stored windows: equal to the batch over several files, reruns, and a key with very many requests."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lastrum.operators import usage
from lastrum.sources.stored import StoredTable
from lastrum.streaming import jobs

START = datetime(2024, 1, 1)
SCHEMA = "key string, id long, ts timestamp"
OUT = "key string, id long, ts timestamp, n_janela long, reset_em timestamp, permitido boolean"


def follow(spark, tmp_path, limit=4, seconds=60, state="state", **options):
    windows = StoredTable(spark, f"file://{tmp_path}/windows", jobs.WINDOWS, ["key"], buckets=4)
    stream = spark.readStream.schema(SCHEMA).parquet(f"file://{tmp_path}/in/*")
    jobs.follow_rate_limit(stream, windows, f"file://{tmp_path}/out", f"file://{tmp_path}/{state}", limit, seconds, **options).awaitTermination(300)
    return windows


def result(spark, tmp_path):
    return sorted(map(tuple, spark.read.schema(OUT).parquet(f"file://{tmp_path}/out/batch=*").collect()), key=str)


def test_equal_to_the_batch_over_files(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for k in range(3):
        part = [(rng.choice(("a", "b", None)), 100 * k + i, None if i == 7 else START + timedelta(seconds=200 * k + rng.randrange(200))) for i in range(80)]
        rows += part
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"file://{tmp_path}/in/f{k}")
        windows = follow(spark, tmp_path)
    got = result(spark, tmp_path)
    batch = usage.rate_limited(spark.createDataFrame(rows, SCHEMA), "key", "ts", "id", 4, 60)
    assert got == sorted(map(tuple, batch.collect()), key=str) and {r[5] for r in got} == {True, False, None}
    assert windows.current()["version"] == 3


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    spark.createDataFrame([("a", i, START + timedelta(seconds=i)) for i in range(9)], SCHEMA).coalesce(1).write.parquet(f"file://{tmp_path}/in/f0")
    follow(spark, tmp_path)
    once = result(spark, tmp_path)
    windows = follow(spark, tmp_path, state="lost")  # the stream's own log is lost: batch 0 comes once more
    assert result(spark, tmp_path) == once and windows.current()["version"] == 1 and windows.read().first()["n"] == 9


def test_ended_windows_go(spark, tmp_path):
    for k, key in enumerate("ab"):
        spark.createDataFrame([(key, k, START + timedelta(hours=k))], SCHEMA).coalesce(1).write.parquet(f"file://{tmp_path}/in/f{k}")
        windows = follow(spark, tmp_path, late=60.0)
    bucket = lambda key: spark.range(1).select(F.pmod(F.xxhash64(F.lit(key)), F.lit(4))).first()[0]
    assert {r["key"] for r in windows.read().collect()} == ({"b"} if bucket("a") == bucket("b") else {"a", "b"})


def test_a_key_with_very_many_requests(spark, tmp_path):
    n = 300_000
    spark.range(n).select(F.lit("hot").alias("key"), "id", (F.lit(START).cast("timestamp") + F.make_dt_interval(secs=F.col("id") % 1000)).alias("ts")).coalesce(2).write.parquet(f"file://{tmp_path}/in/f0")
    follow(spark, tmp_path, limit=1000, seconds=100)
    per = spark.read.schema(OUT).parquet(f"file://{tmp_path}/out/batch=*").groupBy("reset_em").agg(F.count("*").alias("n"), F.max("n_janela").alias("most"), F.count_if("permitido").alias("yes")).collect()
    assert [(r["n"], r["most"], r["yes"]) for r in per] == [(30_000, 30_000, 1000)] * 10
