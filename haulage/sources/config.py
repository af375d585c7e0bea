"""Options of the engine, from a TOML file or from the session's settings."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import SparkSession

PREFIX = "haulage."
REJECTIONS = ("reject", "drop_oldest", "drop_lowest_priority")


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Options:
    """0 means none for sizes, timeouts and intervals."""

    heartbeat_timeout_secs: int = 30
    queue_aging_secs: int = 30
    max_queue_size: int = 0
    queue_timeout_secs: int = 0
    queue_rejection: str = "reject"
    health_interval_secs: int = 5
    probe_interval_secs: int = 60
    probe_bytes: int = 256 * 1024
    metrics_interval_secs: int = 60
    autoscale_interval_secs: int = 0
    task_timeout_secs: int = 30
    result_cache_entries: int = 0
    result_cache_ttl_secs: int = 0
    checkpoint_path: str = ""

    def timers(self) -> dict[str, int]:
        """Seconds between runs by timer."""
        return {"health": self.health_interval_secs, "probe": self.probe_interval_secs, "metrics": self.metrics_interval_secs, "autoscale": self.autoscale_interval_secs}


def _options(given: dict) -> Options:
    kinds = {f.name: type(f.default) for f in fields(Options)}
    for k, v in given.items():
        if k not in kinds:
            raise ConfigError(f"unknown option {k}")
        if type(v) is not kinds[k] or (kinds[k] is int and v < 0):
            raise ConfigError(f"bad value for {k}: {v!r}")
    options = Options(**given)
    if options.queue_rejection not in REJECTIONS:
        raise ConfigError(f"bad value for queue_rejection: {options.queue_rejection!r}")
    return options


def parse(text: str) -> Options:
    try:
        return _options(tomllib.loads(text))
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"not TOML: {e}") from e


def load(path: str | None) -> Options:
    """Options of a file, which has to exist; the defaults without one."""
    return Options() if path is None else parse(Path(path).read_text())


def from_session(spark: SparkSession) -> Options:
    """Options set in the session as haulage.<name>."""
    given = {}
    for f in fields(Options):
        if (v := spark.conf.get(PREFIX + f.name, None)) is not None:
            try:
                given[f.name] = type(f.default)(v)
            except ValueError as e:
                raise ConfigError(f"bad value for {f.name}: {v!r}") from e
    return _options(given)
