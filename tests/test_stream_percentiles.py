"""Streamed percentiles over several files against the batch, and no more state than open windows need."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lastrum.operators import stats
from lastrum.streaming import jobs


def test_equal_to_the_batch(spark, tmp_path):
    rng = random.Random(6)
    start = datetime(2024, 1, 1)
    schema = "ts timestamp_ntz, event_type string, value double"
    every = []
    for k in range(4):
        rows = [(start + timedelta(minutes=90 * k + rng.randrange(-5, 90)), rng.choice("ab"), rng.choice((None, 1.0, 2.0, round(rng.random(), 3)))) for _ in range(200)]
        every += rows
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/f{k}")
        stream = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in/*")
        jobs.follow_latency(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination()
    got = spark.read.schema("inicio timestamp, event_type string, n long, p50 double, p95 double").parquet(f"file://{tmp_path}/out/batch=*")
    rows = [(r["inicio"], r["event_type"], r["n"], r["p50"], r["p95"]) for r in got.collect()]
    batch = spark.createDataFrame(every, schema).withColumn("inicio", F.date_trunc("hour", F.col("ts").cast("timestamp")))
    n = F.col("n")
    wanted = stats.values_at(batch, ["inicio", "event_type"], "value", {"p50": F.floor(n / 2) + 1, "p95": F.least(F.floor(n * 0.95) + 1, n)})
    last = max(r[0] for r in every) - timedelta(minutes=10)
    closed = {(r["inicio"], r["event_type"], r["n"], r["p50"], r["p95"]) for r in wanted.collect() if r["inicio"] + timedelta(hours=1) <= last}
    assert len(rows) == len(set(rows)) and set(rows) == closed and len(closed) >= 8
