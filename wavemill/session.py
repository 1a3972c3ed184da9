"""One place for the session settings that the engine's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "wavemill", master: str | None = None, **conf: str) -> SparkSession:
    """Return a session: UTC, adaptive execution, skew joins split at run time.

    Shuffle partitions are left to the cluster's own setting; ``conf`` overrides anything.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
