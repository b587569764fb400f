"""Time-dependent state replayed over request logs: cache, single flight, rate limit, retries, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litspan.functions import text as T
from litspan.operators.folds import fold

TTL, STALE = 600.0, 3600.0  # seconds
RATE, BURST = 2.0, 5
RETRY_BASE, RETRIES, RETRY_BUDGET = 0.5, 3, 90.0


def cache_replay(requests: DataFrame, key: str, seconds: str, tie: str, failed: str | None = None, ttl: float = TTL, stale: float = STALE) -> DataFrame:
    """``outcome`` of each request: HIT while fresh, else MISS (fetched and stored); where the upstream ``failed``, STALE within the stale window, else ERROR."""

    def step(stored, value):
        now, down = value
        if stored >= 0 and now <= stored + ttl:
            return stored, ("HIT",)
        if down:
            return stored, ("STALE" if stored >= 0 and now <= stored + ttl + stale else "ERROR",)
        return now, ("MISS",)

    rows = requests.withColumn("__down", F.col(failed) if failed else F.lit(False))
    return fold(rows, [key], [seconds, tie], [seconds, "__down"], lambda: -1.0, step, "outcome string")


def token_bucket(requests: DataFrame, key: str, seconds: str, tie: str, rate: float = RATE, burst: int = BURST) -> DataFrame:
    """Whether each request finds a token, and how long it would have to wait: ``granted``, ``wait``."""

    def step(state, value):
        tokens, last = state
        (now,) = value
        tokens = min(float(burst), tokens + (now - last) * rate) if last is not None else float(burst)
        if tokens >= 1.0:
            return (tokens - 1.0, now), (True, 0.0)
        return (tokens, now), (False, (1.0 - tokens) / rate)

    return fold(requests, [key], [seconds, tie], [seconds], lambda: (float(burst), None), step, "granted boolean, wait double")


def single_flight(requests: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the requests of one key in one batch the first leads and the others wait for its result: leader's order columns, ``waiters``."""
    first = F.min(F.struct(*order)).alias("__l")
    return requests.groupBy(*keys).agg(first, (F.count("*") - 1).alias("waiters")).select(*keys, *[F.col(f"__l.{c}").alias(c) for c in order], "waiters")


def retry_schedule(attempts: Column, base: float = RETRY_BASE, most: int = RETRIES, budget: float = RETRY_BUDGET) -> Column:
    """Waits before each retry: doubling, at most ``most`` of them, clipped to what is left of the budget."""
    n = F.least(attempts, F.lit(most))
    raw = F.transform(F.sequence(F.lit(1), n), lambda i: F.lit(base) * F.pow(F.lit(2.0), i - 1))
    clipped = F.transform(raw, lambda w, i: F.greatest(F.lit(0.0), F.least(w, F.lit(budget) - (F.lit(base) * (F.pow(F.lit(2.0), i) - 1)))))
    return F.when(n < 1, F.array().cast("array<double>")).otherwise(clipped)


def retry_decision(status: Column, error: Column, attempt: Column, retry_after: Column, elapsed: Column, base: float = RETRY_BASE, most: int = RETRIES, budget: float = RETRY_BUDGET) -> tuple[Column, Column]:
    """What follows an attempt (from 1) at the upstream after ``elapsed`` seconds of the chain: ``done``, ``retry``, ``fail`` or ``deadline``, and the wait before a retry.

    429, 502, 503, 504 and errors of the network are tried again; a 429 waits as long as its Retry-After says if that is a number. No wait goes beyond the budget, and a chain that has used it up ends.
    """
    transient = status.isin(429, 502, 503, 504) | F.lower(T.text(error)).isin("readtimeout", "connecttimeout", "remoteprotocolerror", "connecterror")
    transient = F.coalesce(transient, F.lit(False))
    left = F.lit(budget) - elapsed
    told = (status == 429) & F.rlike(T.text(retry_after), F.lit(r"^[0-9]+$"))
    wait = F.when(F.coalesce(told, F.lit(False)), retry_after.cast("double")).otherwise(F.lit(base) * F.pow(F.lit(2.0), attempt - 1))
    ended = F.when((T.text(error) == "") & (status < 400), "done").when(~transient | (attempt > most), "fail").when(left <= 0, "deadline").otherwise("retry")
    return ended, F.when(ended == "retry", F.least(wait, F.greatest(left, F.lit(0.0))))


def active_paper(turns: DataFrame, session: str, turn: str, opened: Column) -> DataFrame:
    """The paper opened last, at each turn of a session."""
    so_far = Window.partitionBy(session).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("active_paper", F.last(opened, ignorenulls=True).over(so_far))


def confirmations(turns: DataFrame, session: str, turn: str, kind: str, asks: str) -> DataFrame:
    """What a pending search comes to: each turn may answer it (``yes`` runs it, ``no`` and ``cancel`` drop it, anything else drops it and goes on) and ask anew.

    ``kind`` is the answer's kind, ``asks`` whether the turn leaves a search pending. Adds ``resolved``: run, stay, cleared or none.
    """

    def step(pending, value):
        kind, asks = value
        result = "none"
        if pending:
            result = {"yes": "run", "no": "stay", "cancel": "stay"}.get(kind, "cleared")
        return bool(asks), (result,)

    return fold(turns, [session], [turn], [kind, asks], lambda: False, step, "resolved string")


def upstream_status(error: Column) -> Column:
    """The status that an upstream failure (timeout, http, connect or anything else) is answered with; null without one."""
    kind = F.lower(F.coalesce(error, F.lit("")))
    return F.when(kind == "", None).when(F.contains(kind, F.lit("timeout")), 504).when(F.contains(kind, F.lit("http")) | F.contains(kind, F.lit("connect")), 502).otherwise(500)
