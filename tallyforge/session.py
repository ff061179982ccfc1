"""Session defaults: UTC, ANSI arithmetic, adaptive execution, RocksDB state."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults; ``conf`` names settings with underscores for dots."""
    builder = SparkSession.builder.config(map=DEFAULTS | {k.replace("_", "."): v for k, v in conf.items()})
    return (builder.master(master) if master else builder).getOrCreate()
