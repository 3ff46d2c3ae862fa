"""Session settings the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Day arithmetic is done in UTC. Noting the Python line of every column expression
# doubles the time to build a plan. Sizing is left to Spark and the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """Build or get a session. ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    extra = {key.replace("__", "."): value for key, value in conf.items()}
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
