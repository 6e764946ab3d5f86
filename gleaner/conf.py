"""Engine settings: an immutable record with defaults, read from the environment, the session, or given in code."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Conf:
    remote: bool = True
    cache_read: bool = True
    cache_write: bool = True
    cache_life_seconds: int = 7 * 24 * 3600
    ignore_cached_before: str | None = None
    remote_timeout: float = 60.0
    hard_timeout_extra: float = 20.0
    remote_retries: int = 2
    locality: str = "wide"
    sampling: str = "identity"
    min_depth: int = 0
    max_depth: int = 2**31 - 1
    checkpoint_interval: int = 4
    auditing: str = "both"
    error_dump: bool = True
    proxy: str | None = None
    trust_all: bool = False
    headers: tuple[tuple[str, str], ...] = ()

    def preview(self) -> Conf:
        """One row of each batch and two levels of exploration."""
        return replace(self, sampling="first:1", min_depth=0, max_depth=2)

    @classmethod
    def load(cls, spark: SparkSession | None = None, **given: object) -> Conf:
        """Precedence: given in code, environment (GLEANER_NAME), session setting (gleaner.name), default."""
        found: dict[str, object] = {}
        for f in fields(cls):
            raw = os.environ.get("GLEANER_" + f.name.upper())
            if raw is None and spark is not None:
                raw = spark.conf.get("gleaner." + f.name, None)
            if raw is not None and not isinstance(f.default, tuple):
                kind = type(f.default) if f.default is not None else str
                found[f.name] = raw.lower() == "true" if kind is bool else kind(raw)
        return cls(**(found | given))
