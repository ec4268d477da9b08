"""Queries over the event log: metrics, metering, rate limits, logs; in batch and as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lastrum.functions.numbers import fixed
from lastrum.operators import usage
from lastrum.operators.tables import new_path, shared_dir
from lastrum.plans.domain import read
from lastrum.plans.registry import Registry
from lastrum.sources.stored import StoredTable
from lastrum.streaming import jobs

registry = Registry()
query = registry.query

PLANS = (("gratuito", 3), ("profissional", 10), ("empresa", 100))
_PLAN = "['gratuito', 'profissional', 'empresa'][user_id % 3 + 1]"


def _events(spark, sf_dir):
    return read(spark, sf_dir, "events")


@query("""WITH g AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n, round(avg(value), 4) AS media, count(*) FILTER (event_type = 'error') AS erros FROM events GROUP BY 1)
    SELECT event_type, n, media, erros, v[n // 2 + 1] AS p50, v[least(CAST(floor(n * 0.95::DOUBLE) AS BIGINT) + 1, n)] AS p95 FROM g""")
def q_latency_percentiles(spark, sf_dir):
    return usage.latency(_events(spark, sf_dir), ["event_type"], "value", F.col("event_type") == "error")


@query("SELECT CAST(json_extract_string(props, '$.k') AS INT) % 10 AS tipo, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1")
def q_errors_by_type(spark, sf_dir):
    kind = F.get_json_object("props", "$.k").try_cast("int") % 10
    return _events(spark, sf_dir).where("event_type = 'error'").groupBy(kind.alias("tipo")).agg(F.count("*").alias("n"))


@query(f"""WITH u AS (SELECT user_id, {_PLAN} AS plano, CAST(date_trunc('month', ts) AS DATE) AS mes, count(*) FILTER (event_type = 'view') AS consultas, count(*) FILTER (event_type = 'purchase') AS relatorios FROM events GROUP BY 1, 2, 3),
    p AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {x})" for n, x in PLANS)}) v(plano, limite))
    SELECT plano, user_id, mes, consultas, relatorios, CAST(limite AS INT) AS limite, round(consultas / limite * 100, 1) AS percentual, consultas < limite AS permitido FROM u LEFT JOIN p USING (plano)""")
def q_usage_metering(spark, sf_dir):
    plan = F.get(F.array(*[F.lit(n) for n, _ in PLANS]), F.pmod("user_id", F.lit(3)).cast("int"))
    return usage.metering(_events(spark, sf_dir).withColumn("plano", plan), spark.createDataFrame(PLANS, "plano string, limite int"))


_BOUGHT = "CASE WHEN event_type = 'purchase' THEN 'plan ' || CAST(event_id % 3 AS VARCHAR) END"


@query(f"""WITH e AS (SELECT user_id AS chave, ts, strftime(ts, '%Y-%m') AS mes, {_BOUGHT} AS plano FROM events),
    c AS (SELECT chave, mes, max(ts) FILTER (plano IS NOT NULL) AS desde, arg_max(plano, ts) FILTER (plano IS NOT NULL) AS plano FROM e GROUP BY 1, 2)
    SELECT c.chave, c.mes, c.plano, c.desde, count(*) FILTER (e.plano IS NULL AND (c.desde IS NULL OR e.ts > c.desde)) AS n FROM c JOIN e USING (chave, mes) GROUP BY ALL""")
def q_usage_counters(spark, sf_dir):
    """Monthly counters of a stored table after the events came in three batches, of which the second came twice."""
    plan = F.when(F.col("event_type") == "purchase", F.concat(F.lit("plan "), (F.col("event_id") % 3).cast("string")))
    events = _events(spark, sf_dir).select(F.col("user_id").alias("chave"), "ts", plan.alias("plano"))
    table = StoredTable(spark, new_path(spark, "counters"), usage.COUNTERS, ["chave"], buckets=16)
    day = F.dayofmonth("ts")
    for batch, part in ((0, day <= 10), (1, (day > 10) & (day <= 20)), (1, (day > 10) & (day <= 20)), (2, day > 20)):
        table.merge(batch, events.where(part), usage.counted)
    return table.read()


LIMIT, SECONDS = 3, 172_800
_LIMITED = f"""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    f AS (SELECT user_id, event_id, ts, k, CAST(1 AS BIGINT) AS n, ts + INTERVAL {SECONDS} SECOND AS reset FROM e WHERE k = 1
          UNION ALL SELECT e.user_id, e.event_id, e.ts, e.k, CASE WHEN e.ts >= f.reset THEN 1 ELSE f.n + 1 END, CASE WHEN e.ts >= f.reset THEN e.ts + INTERVAL {SECONDS} SECOND ELSE f.reset END FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
    SELECT user_id, event_id, n AS n_janela, reset AS reset_em, n <= {LIMIT} AS permitido FROM f"""


@query(_LIMITED)
def q_rate_limit(spark, sf_dir):
    return usage.rate_limited(_events(spark, sf_dir), "user_id", "ts", "event_id", LIMIT, SECONDS).drop("ts")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def q_json_props(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("""WITH d AS (SELECT CAST(unnest(generate_series(DATE '2023-12-25', DATE '2024-02-05', INTERVAL 1 DAY)) AS DATE) AS dia), c AS (SELECT CAST(ts AS DATE) AS dia, count(*) AS n FROM events GROUP BY 1)
    SELECT d.dia, coalesce(n, 0) AS n FROM d LEFT JOIN c USING (dia)""")
def q_requests_per_day(spark, sf_dir):
    return usage.requests_per_day(_events(spark, sf_dir), "2023-12-25", "2024-02-05").withColumn("n", F.col("n").cast("long"))


@query("SELECT user_id, count(*) AS usos, max(ts) AS ultimo_uso FROM events GROUP BY 1")
def q_key_usage(spark, sf_dir):
    return usage.key_usage(_events(spark, sf_dir))


_GRADE = "CAST(json_extract_string(props, '$.k') AS INT) % 7"


@query(f"SELECT event_type AS tipo, count(*) AS n, round(avg({_GRADE}), 2) AS media FROM events WHERE {_GRADE} BETWEEN 1 AND 5 GROUP BY 1")
def q_feedback_report(spark, sf_dir):
    grade = F.get_json_object("props", "$.k").try_cast("int") % 7
    return usage.feedback_report(_events(spark, sf_dir).select(F.col("event_type").alias("tipo"), grade.alias("nota")))


@query(f"SELECT event_id FROM events WHERE NOT coalesce({_GRADE} BETWEEN 1 AND 5, false)")
def q_feedback_quarantine(spark, sf_dir):
    grade = F.get_json_object("props", "$.k").try_cast("int") % 7
    return usage.quarantined(_events(spark, sf_dir).withColumn("nota", grade)).select("event_id")


@query("SELECT event_id, ts, user_id, event_type FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 50 OFFSET 50")
def q_audit_page(spark, sf_dir):
    log = _events(spark, sf_dir).where("event_type = 'error'").orderBy(F.col("ts").desc(), "event_id")
    return log.offset(50).limit(50).select("event_id", "ts", "user_id", "event_type")


@query("""WITH m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS w FROM events)
    SELECT date_trunc('hour', ts) AS inicio, event_type, count(*) AS n, round(avg(value), 4) AS media, count(*) FILTER (event_type = 'error') AS erros FROM events, m
    WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= w GROUP BY 1, 2""")
def q_stream_metrics(spark, sf_dir):
    """The windows that the watermark has closed, from a stream over the event files."""
    base = shared_dir(spark).rstrip("/")
    out = f"{base}/lastrum/{uuid.uuid4().hex}"
    stream = spark.readStream.schema(_events(spark, sf_dir).schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    job = jobs.request_metrics(stream).writeStream.format("parquet").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows")
    job.awaitTermination()
    rows = spark.read.schema("inicio timestamp, event_type string, n long, media double, erros long").parquet(f"{out}/rows")
    return rows.select(F.col("inicio").cast("timestamp_ntz").alias("inicio"), "event_type", "n", fixed("media", 4).alias("media"), "erros")


@query("""WITH m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS w FROM events),
    g AS (SELECT date_trunc('hour', ts) AS inicio, event_type, list_sort(list(value)) AS v, count(value) AS n FROM events, m WHERE value IS NOT NULL AND date_trunc('hour', ts) + INTERVAL 1 HOUR <= w GROUP BY 1, 2)
    SELECT inicio, event_type, n, v[n // 2 + 1] AS p50, v[least(CAST(floor(n * 0.95::DOUBLE) AS BIGINT) + 1, n)] AS p95 FROM g""")
def q_stream_percentiles(spark, sf_dir):
    """p50 and p95 of the windows that the watermark has closed, from a stream over the event files."""
    base = new_path(spark, "stream_percentiles")
    stream = spark.readStream.schema(_events(spark, sf_dir).schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    jobs.follow_latency(stream, f"{base}/rows", f"{base}/state").awaitTermination()
    rows = spark.read.schema("inicio timestamp, event_type string, n long, p50 double, p95 double").parquet(f"{base}/rows/batch=*")
    return rows.withColumn("inicio", F.col("inicio").cast("timestamp_ntz"))


@query(_LIMITED)
def q_stream_rate_limit(spark, sf_dir):
    """q_rate_limit from a stream over the event files, with the windows of the keys in a stored table."""
    base = new_path(spark, "stream_rate_limit")
    events = spark.readStream.schema(_events(spark, sf_dir).schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    requests = events.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts")
    windows = StoredTable(spark, f"{base}/windows", jobs.WINDOWS, ["key"], buckets=16)
    jobs.follow_rate_limit(requests, windows, f"{base}/rows", f"{base}/state", LIMIT, SECONDS).awaitTermination()
    rows = spark.read.schema("key string, id long, ts timestamp, n_janela long, reset_em timestamp, permitido boolean").parquet(f"{base}/rows/batch=*")
    return rows.select(F.col("key").cast("long").alias("user_id"), F.col("id").alias("event_id"), "n_janela", F.col("reset_em").cast("timestamp_ntz").alias("reset_em"), "permitido")
