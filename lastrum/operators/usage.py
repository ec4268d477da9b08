"""Alerts, request metrics, metering and rate limits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lastrum.functions.numbers import fixed
from lastrum.functions.pricing import deviation, deviation_alert, normal_percentile
from lastrum.operators.stats import values_at

STATUSES = ("CRITICO", "ATENCAO", "NORMAL")


def with_reference(df: DataFrame, reference: DataFrame, category: str = "categoria", state: str = "uf") -> DataFrame:
    """df with mediana, dp and n of its category and state in reference(category, state, mediana, dp, n), else the mean over the
    states of the category; null for an unknown category. reference is a row per category and state."""
    exact = reference.select(category, state, F.struct("mediana", "dp", "n").alias("_exact"))
    mean = reference.groupBy(category).agg(F.struct(F.avg("mediana").alias("mediana"), F.avg("dp").alias("dp"), F.sum("n").alias("n")).alias("_mean"))
    out = df.join(exact, [category, state], "left").join(mean, category, "left")
    ref = F.coalesce("_exact", "_mean")
    return out.withColumns({c: ref[c] for c in ("mediana", "dp", "n")}).drop("_exact", "_mean")


def alerts(df: DataFrame, reference: DataFrame, price: str = "preco") -> DataFrame:
    """df with its reference, desvio_pct, percentil and status."""
    out = with_reference(df, reference)
    percent = F.when(F.col("mediana").isNotNull(), deviation(price, "mediana"))
    return out.withColumn("desvio_pct", percent).withColumns({"percentil": normal_percentile(price, "mediana", "dp"), "status": deviation_alert("desvio_pct")})


def alert_statistics(alerted: DataFrame, by: str, statuses: Sequence[str] = STATUSES) -> DataFrame:
    """Number of alerts per status; prices without a reference don't count."""
    known = alerted.where(F.col("status").isin(*statuses))
    return known.groupBy(by).pivot("status", list(statuses)).agg(F.count(F.lit(1))).fillna(0)


def latency(df: DataFrame, keys: Sequence[str], value: str, error) -> DataFrame:
    """Per group: n, media, erros, p50 and p95 by index (n // 2, and 0.95 n cut to a whole number), without interpolation."""
    n = F.col("n")
    placed = values_at(df, keys, value, {"p50": F.floor(n / 2) + 1, "p95": F.least(F.floor(n * 0.95) + 1, n)})
    sums = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(fixed(F.avg(value), 4).alias("media"), F.count_if(error).alias("erros"))
    return placed.join(sums, list(keys)).select(*keys, "n", "media", "erros", "p50", "p95")


def metering(events: DataFrame, plans: DataFrame, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Per user and month: consultas, relatorios, limite, percentual, permitido (fewer than the limit). plans(plano, limite) is a
    small dimension, joined on plano, which events carry."""
    used = events.groupBy(user, "plano", F.trunc(F.col(ts).cast("date"), "MM").alias("mes")).agg(F.count_if(F.col("event_type") == "view").alias("consultas"), F.count_if(F.col("event_type") == "purchase").alias("relatorios"))
    out = used.join(plans, "plano", "left")
    return out.withColumns({"percentual": fixed(F.col("consultas") / F.col("limite") * 100, 1), "permitido": F.col("consultas") < F.col("limite")})


def rate_limited(requests: DataFrame, key: str, ts: str, order: str, limit: int, seconds: float, state: DataFrame | None = None) -> DataFrame:
    """(key, order, ts, n_janela, reset_em, permitido): each request's number in its window, and when that ends; null where ts is.

    A window begins with the first request after the last window, so requests are folded in order: those of a key are sorted in
    one partition and read as a stream, of which only the last key, count and end are held. state(key, n, ate), a row for each key
    at most, is the window that a key is in before its first request.
    """
    span = round(seconds * 1_000_000)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count, reset = object(), 0, 0
        micros = lambda x: x.cast(pa.timestamp("us", x.type.tz)).cast(pa.int64()).to_pylist()
        for batch in batches:
            times = batch.column(ts)
            counts, resets, asked = [], [], []
            for k, t, n, end in zip(batch.column(key).to_pylist(), micros(times), batch.column("_n").to_pylist(), micros(batch.column("_ate")), strict=True):
                asked.append(n is None)
                if n is not None:
                    last, count, reset = k, n, end
                elif t is not None:
                    if k != last or t >= reset:
                        last, count, reset = k, 0, t + span
                    count += 1
                counts.append(None if t is None else count)
                resets.append(None if t is None else reset)
            ends = pa.array(resets, pa.int64()).cast(pa.timestamp("us", times.type.tz))
            allowed = pa.array([None if n is None else n <= limit for n in counts], pa.bool_())
            out = pa.RecordBatch.from_arrays([batch.column(key), batch.column(order), times, pa.array(counts, pa.int64()), ends, allowed], [key, order, ts, "n_janela", "reset_em", "permitido"])
            yield out.filter(pa.array(asked, pa.bool_()))

    kinds = dict(requests.dtypes)
    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, {ts} {kinds[ts]}, n_janela bigint, reset_em {kinds[ts]}, permitido boolean"
    null = lambda kind: F.lit(None).cast(kind)
    rows = requests.select(key, order, ts, null("long").alias("_n"), null(kinds[ts]).alias("_ate"))
    if state is not None:
        rows = rows.unionAll(state.select(F.col(key).cast(kinds[key]), null(kinds[order]), null(kinds[ts]), F.col("n").cast("long"), F.col("ate").cast(kinds[ts])))
    return rows.repartition(key).sortWithinPartitions(key, F.col("_n").asc_nulls_last(), ts, order).mapInArrow(fold, schema)


def requests_per_day(events: DataFrame, first: str, last: str, ts: str = "ts") -> DataFrame:
    """A row per day from first to last, days without requests too."""
    days = events.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("dia"))
    counts = events.groupBy(F.col(ts).cast("date").alias("dia")).agg(F.count("*").alias("n"))
    return days.join(counts, "dia", "left").select("dia", F.coalesce("n", F.lit(0)).alias("n"))


def key_usage(events: DataFrame, key: str = "user_id", ts: str = "ts") -> DataFrame:
    return events.groupBy(key).agg(F.count("*").alias("usos"), F.max(ts).alias("ultimo_uso"))


def feedback_report(feedback: DataFrame, kind: str = "tipo", grade: str = "nota") -> DataFrame:
    """Per kind: n and mean of the valid grades (1 to 5); the others are left to quarantined()."""
    return feedback.where(F.col(grade).between(1, 5)).groupBy(kind).agg(F.count("*").alias("n"), fixed(F.avg(grade), 2).alias("media"))


def quarantined(feedback: DataFrame, grade: str = "nota") -> DataFrame:
    return feedback.where(~F.coalesce(F.col(grade).between(1, 5), F.lit(False)))


COUNTERS = "chave long, mes string, plano string, desde timestamp_ntz, n long"


def counted(old: DataFrame, new: DataFrame) -> DataFrame:
    """COUNTERS after the events new(chave, ts, plano): an event without a plan is a use of its month, one with a plan changes it and sets the
    month's count to 0. Batches come in order of time; uses at or before a change of plan that is known don't count."""
    events = new.withColumn("mes", F.date_format("ts", "yyyy-MM"))
    changed = F.col("plano").isNotNull()
    switched = events.where(changed).groupBy("chave", "mes").agg(F.max_by("plano", F.struct("ts", "plano")).alias("_plano"), F.max("ts").alias("_ts"))
    # a month that only had uses so far has the plan null
    state = old.select("chave", "mes", F.col("plano").alias("_was"), F.col("desde").alias("_desde"), F.col("n").alias("_n"))
    known = state.join(switched, ["chave", "mes"], "full").select("chave", "mes", F.coalesce("_plano", "_was").alias("_p"), F.coalesce("_ts", "_desde").alias("_since"), F.when(F.col("_ts").isNull(), F.col("_n")).otherwise(0).alias("_kept"))
    uses = events.where(~changed).join(known.select("chave", "mes", "_since"), ["chave", "mes"], "left").where(F.col("_since").isNull() | (F.col("ts") > F.col("_since")))
    uses = uses.groupBy("chave", "mes").agg(F.count("*").alias("_uses"))
    out = known.join(uses, ["chave", "mes"], "full")
    return out.select("chave", "mes", F.col("_p").alias("plano"), F.col("_since").alias("desde"), (F.coalesce("_kept", F.lit(0)) + F.coalesce("_uses", F.lit(0))).cast("long").alias("n"))
