"""Queries that replay time-dependent state."""

from __future__ import annotations

from pyspark.sql import functions as F

from litspan.operators import state as S
from litspan.plans.registering import query
from litspan.sources.tables import table


def _events(spark, sf_dir):
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", seconds.alias("seconds"))


LOG = "SELECT event_id, user_id, event_type, epoch_us(ts) / 1e6 AS seconds, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events"


@query(f"""WITH RECURSIVE l AS ({LOG}), w AS (
    SELECT event_id, user_id, r, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'MISS' END AS outcome, CASE WHEN event_type = 'error' THEN NULL ELSE seconds END AS stored FROM l WHERE r = 1
    UNION ALL
    SELECT l.event_id, l.user_id, l.r, CASE WHEN seconds <= stored + 86400 THEN 'HIT' WHEN event_type = 'error' THEN CASE WHEN seconds <= stored + 86400 + 172800 THEN 'STALE' ELSE 'ERROR' END ELSE 'MISS' END,
        CASE WHEN seconds <= stored + 86400 OR event_type = 'error' THEN stored ELSE seconds END FROM w JOIN l ON l.user_id = w.user_id AND l.r = w.r + 1)
    SELECT event_id, outcome FROM w""")
def cache_replay(spark, sf_dir):
    """ST1, ST2: hits, misses and stale answers of a cache with a day's life."""
    rows = _events(spark, sf_dir).withColumn("down", F.col("event_type") == "error")
    return S.cache_replay(rows, "user_id", "seconds", "event_id", failed="down", ttl=86_400.0, stale=172_800.0).select("event_id", "outcome")


@query(f"""WITH RECURSIVE l AS ({LOG}), w AS (
    SELECT event_id, user_id, r, seconds, true AS granted, 1.0::DOUBLE AS tokens FROM l WHERE r = 1
    UNION ALL
    SELECT l.event_id, l.user_id, l.r, l.seconds, least(2.0, tokens + (l.seconds - w.seconds) * 0.00002) >= 1, least(2.0, tokens + (l.seconds - w.seconds) * 0.00002) - CASE WHEN least(2.0, tokens + (l.seconds - w.seconds) * 0.00002) >= 1 THEN 1 ELSE 0 END
    FROM w JOIN l ON l.user_id = w.user_id AND l.r = w.r + 1)
    SELECT event_id, granted FROM w""")
def token_bucket_replay(spark, sf_dir):
    """ST4: which requests find a token."""
    return S.token_bucket(_events(spark, sf_dir), "user_id", "seconds", "event_id", rate=0.00002, burst=2).select("event_id", "granted")


@query("SELECT user_id, event_type, CAST(floor(epoch_us(ts) / 1e6 / 86400) AS BIGINT) AS day, min(struct_pack(seconds := epoch_us(ts), event_id := event_id)).event_id AS event_id, count(*) - 1 AS waiters FROM events GROUP BY ALL")
def single_flight(spark, sf_dir):
    """ST3: leaders and waiters of requests for one key on one day."""
    rows = _events(spark, sf_dir).withColumn("day", F.floor(F.col("seconds") / 86400).cast("long"))
    return S.single_flight(rows, ["user_id", "event_type", "day"], ["seconds", "event_id"]).drop("seconds")


CALLS = "SELECT event_id, CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 429 WHEN 1 THEN 503 WHEN 2 THEN 200 WHEN 3 THEN 404 END AS status, CASE WHEN event_id % 5 = 4 THEN CASE WHEN event_id % 2 = 0 THEN 'ReadTimeout' ELSE 'ValueError' END END AS error, CAST(event_id % 6 + 1 AS INT) AS attempt, CASE WHEN event_id % 3 = 0 THEN '7' WHEN event_id % 3 = 1 THEN 'soon' END AS retry_after, CAST(event_id % 100 AS DOUBLE) AS elapsed FROM events"


@query(f"""SELECT event_id, outcome, CASE WHEN outcome = 'retry' THEN least(CASE WHEN status = 429 AND retry_after = '7' THEN 7 ELSE 0.5 * power(2, attempt - 1) END, greatest(0, 90 - elapsed)) END::DOUBLE AS wait FROM (SELECT *, CASE WHEN error IS NULL AND status < 400 THEN 'done'
    WHEN attempt > 3 OR NOT (coalesce(status, 0) IN (429, 503) OR coalesce(error, '') = 'ReadTimeout') THEN 'fail' WHEN elapsed >= 90 THEN 'deadline' ELSE 'retry' END AS outcome FROM ({CALLS}))""")
def retry_decisions(spark, sf_dir):
    """ST6, S13, E7: which failures are tried again, how long later, and when a chain of attempts ends."""
    n = F.col("event_id")
    calls = table(spark, sf_dir, "events").select(
        "event_id", F.when(n % 5 == 0, 429).when(n % 5 == 1, 503).when(n % 5 == 2, 200).when(n % 5 == 3, 404).alias("status"), F.when(n % 5 == 4, F.when(n % 2 == 0, "ReadTimeout").otherwise("ValueError")).alias("error"),
        (n % 6 + 1).cast("int").alias("attempt"), F.when(n % 3 == 0, "7").when(n % 3 == 1, "soon").alias("retry_after"), (n % 100).cast("double").alias("elapsed"),
    )
    outcome, wait = S.retry_decision(*[F.col(c) for c in ("status", "error", "attempt", "retry_after", "elapsed")])
    return calls.select("event_id", outcome.alias("outcome"), wait.alias("wait"))


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS turns, max_by(event_type, (ts, event_id)) AS last_action FROM events GROUP BY user_id")
def session_get_or_create(spark, sf_dir):
    """ST7: the state of each session after its log."""
    rows = _events(spark, sf_dir)
    return rows.groupBy("user_id").agg(F.count("*").alias("turns"), F.max_by("event_type", F.struct("seconds", "event_id")).alias("last_action"))


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 504 WHEN 'click' THEN 502 WHEN 'view' THEN 500 END AS status FROM events")
def upstream_errors(spark, sf_dir):
    """How failures of the upstream are answered."""
    kinds = F.when(F.col("event_type") == "error", "ReadTimeout").when(F.col("event_type") == "click", "HTTPStatusError").when(F.col("event_type") == "view", "ValueError")
    return table(spark, sf_dir, "events").select("event_id", S.upstream_status(kinds).alias("status"))
