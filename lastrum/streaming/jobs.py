"""Structured Streaming forms of the behaviours that follow a stream: request metrics, rate limits, ingestion by month."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lastrum.operators import usage
from lastrum.operators.stats import values_of
from lastrum.sources.landing import PAGES, contracts
from lastrum.sources.stored import StoredTable


def request_metrics(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Per window and kind: n, media, erros. State is kept until the watermark passes a window."""
    stream = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return stream.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("media"), F.count_if(F.col("event_type") == "error").alias("erros")).select(F.col("w.start").alias("inicio"), "event_type", "n", "media", "erros")


def latency_counts(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(inicio, event_type, _v, _c): how often each value occurs in each window and kind. State is one count for each value; it goes when
    the watermark passes the window, and all counts of a window come out in the same batch."""
    stream = events.where("value IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = stream.groupBy(F.window("ts", every).alias("w"), "event_type", F.col("value").cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    return counted.select(F.col("w.start").alias("inicio"), "event_type", "_v", "_c")


def latency_percentiles(counts: DataFrame) -> DataFrame:
    """Per closed window and kind: n, p50 and p95, exact, from latency_counts()."""
    n = F.col("n")
    keys = ["inicio", "event_type"]
    return values_of(counts, keys, {"p50": F.floor(n / 2) + 1, "p95": F.least(F.floor(n * 0.95) + 1, n)}).select(*keys, "n", "p50", "p95")


def follow_latency(events: DataFrame, out: str, state: str, every: str = "1 hour", late: str = "10 minutes"):
    """Runs over what there is: percentiles of the windows that close are written to a folder for each batch, which a rerun of the
    batch overwrites."""

    def closed(counts: DataFrame, batch: int) -> None:
        latency_percentiles(counts).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return latency_counts(events, every, late).writeStream.foreachBatch(closed).option("checkpointLocation", state).trigger(availableNow=True).start()


LIMITED = "key string, ts timestamp, n_janela long, reset_em timestamp, permitido boolean"


def rate_limit(requests: DataFrame, limit: int, seconds: float, late: str = "10 minutes") -> DataFrame:
    """Requests (key, ts) with n_janela, reset_em and permitido. A key's state is one count and one time; it goes when the watermark
    passes the end of its window. Requests of a key that come in one batch are taken in order of time."""
    span = pd.Timedelta(seconds=seconds)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, reset = state.get if state.exists else (0, 0)
        reset_at = pd.Timestamp(reset, unit="us")
        times = pd.concat([b["ts"] for b in batches]).sort_values()
        rows = []
        for ts in times:
            count, reset_at = (1, ts + span) if count == 0 or ts >= reset_at else (count + 1, reset_at)
            rows.append((key[0], ts, count, reset_at, count <= limit))
        state.update((count, int(reset_at.timestamp() * 1_000_000)))
        state.setTimeoutTimestamp(max(int(reset_at.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["key", "ts", "n_janela", "reset_em", "permitido"])

    keyed = requests.select(F.col("key").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return keyed.groupBy("key").applyInPandasWithState(run, LIMITED, "count long, reset long", "append", GroupStateTimeout.EventTimeTimeout)


WINDOWS = "key string, n long, ate timestamp"


def _of_keys(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """rows that share a key, null too, with keys (left_semi) or with none of them (left_anti)."""
    keys = keys.select(F.col("key").alias("_key"))
    return rows.join(keys, F.col("key").eqNullSafe(F.col("_key")), how)


def follow_rate_limit(requests: DataFrame, windows: StoredTable, out: str, checkpoint: str, limit: int, seconds: float, late: float = 600, **trigger):
    """rate_limit() over requests (key, ts, id) for keys of any size: the requests of a batch are sorted by Spark, which spills, and read as
    a stream that holds one count; windows, a stored table of WINDOWS by key, carries them from batch to batch.

    A batch is written to its own folder before windows changes, and windows names the last batch, so a batch that comes again is
    either written anew from the same windows or left as it is. Of the buckets that a batch touches, windows that ended more than
    late seconds before its newest request are dropped. Requests of a batch are taken in order of time, then id; batches as they come.
    """

    def run(rows: DataFrame, batch: int) -> None:
        if batch <= windows.current()["batches"].get("", -1):
            return
        folder = f"{out}/batch={batch}"
        rows = rows.select(F.col("key").cast("string").alias("key"), F.col("id"), F.col("ts").cast("timestamp").alias("ts"))
        limited = usage.rate_limited(rows, "key", "ts", "id", limit, seconds, _of_keys(windows.read(), rows, "left_semi"))
        limited.write.mode("overwrite").parquet(folder)
        done = windows.spark.read.schema(limited.schema).parquet(folder).where("reset_em IS NOT NULL")
        newest = done.agg(F.max("ts").alias("t")).first()["t"]
        if newest is None:
            return
        ends = done.groupBy("key").agg(F.max(F.struct(F.col("reset_em").alias("ate"), F.col("n_janela").alias("n"))).alias("w")).select("key", "w.n", "w.ate")
        limit_of_age = F.lit(newest - timedelta(seconds=late))
        windows.merge(batch, ends, lambda old, new: _of_keys(old, new, "left_anti").unionByName(new).where(F.col("ate") > limit_of_age))

    return requests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def ingest_pages(spark, landed: str, out: str, checkpoint: str):
    """Takes up the JSON pages that have landed since the last run, as contracts by month, and stops when there are no more."""
    pages = spark.readStream.schema(PAGES).option("columnNameOfCorruptRecord", "_bad").option("multiLine", True).json(landed)
    rows = contracts(pages).withColumn("mes", F.date_format("data_publicacao", "yyyy-MM"))
    return rows.writeStream.format("parquet").partitionBy("mes").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
