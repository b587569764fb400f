"""Settings of the engine, from the session's configuration under ``litspan.``."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """Defaults as the services have them; seconds, rows and characters."""

    cache_ttl: float = 600.0
    cache_stale: float = 3600.0
    rate: float = 2.0
    burst: int = 5
    retries: int = 3
    retry_base: float = 0.5
    retry_budget: float = 90.0
    page_most: int = 500
    page_size: int = 10
    prefetch: int = 200
    loaded_most: int = 5000
    shown_candidates: int = 10
    chunk_tokens: int = 600
    overlap_tokens: int = 100
    chars_per_token: int = 4
    vision_pages_most: int = 60

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        """Each ``litspan.<name>`` of the session in place of its default."""
        found = {}
        for f in fields(cls):
            value = spark.conf.get(f"litspan.{f.name}", None)
            if value is not None:
                found[f.name] = type(f.default)(value)
        return cls(**found)
