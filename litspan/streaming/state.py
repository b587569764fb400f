"""The services' state as Structured Streaming: cache outcomes, single flight, active papers, windows of requests.

Event time decides, so a replay gives the same answers as the stream did.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_time(events: DataFrame, column: str = "ts") -> DataFrame:
    """Timestamps without zone as UTC, as watermarks need them."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def cache_outcomes(requests: DataFrame, key: str, time: str, request: str, ttl: float = 600.0, delay: str = "1 hour") -> DataFrame:
    """HIT or MISS of each request, by the time its key was last fetched; keys idle beyond the watermark are forgotten.

    State is one number for each key. Rows of a batch are taken in the order of their time.
    """
    kind = requests.schema[key].dataType.simpleString()
    rid = requests.schema[request].dataType.simpleString()

    def step(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        stored = state.get[0] if state.exists else -1.0
        rows = pd.concat(list(parts)).sort_values(["__s", request], kind="stable")
        out = []
        for now in rows["__s"]:
            hit = stored >= 0 and now <= stored + ttl
            stored = stored if hit else now
            out.append("HIT" if hit else "MISS")
        state.update((stored,))
        state.setTimeoutTimestamp(max(int((stored + ttl) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: keys[0], request: rows[request].to_numpy(), "outcome": out})

    timed = requests.withWatermark(time, delay).withColumn("__s", F.unix_micros(time) / 1e6)
    return timed.select(key, request, time, "__s").groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, `{request}` {rid}, outcome string", "stored double", "append", GroupStateTimeout.EventTimeTimeout)


def single_flight(requests: DataFrame, keys: list[str], time: str, within: str = "10 seconds") -> DataFrame:
    """The first request of each key within the watermark; later ones wait for its result."""
    return requests.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


def request_windows(requests: DataFrame, time: str, by: str, window: str = "5 minutes", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Requests counted by window and kind; late ones within the delay still count."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    counted = requests.withWatermark(time, delay).groupBy(w, by).agg(F.count("*").alias("requests"))
    return counted.select(F.col("window.start").alias("window_start"), by, "requests")


def active_paper(turns: DataFrame, session: str, time: str, opened: Column) -> DataFrame:
    """The paper opened last in each session (complete or update mode)."""
    rows = turns.withColumn("__o", opened).where(F.col("__o").isNotNull())
    return rows.groupBy(session).agg(F.max_by("__o", time).alias("active_paper"), F.max(time).alias("opened_at"))


def upsert_sink(path: str, key: str, order: str) -> Any:
    """A foreachBatch function that keeps a batch's last row of each key under its batch number: a batch that is run again overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c != key]
        last = batch.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(key, "r.*")
        last.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
