"""Session factory and the table reader shared by every query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Settings that hold for local work and for a cluster alike; a session that already exists keeps its own.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """The active session, or a new one for local work."""
    builder = SparkSession.builder.master(master).appName("pagelens")
    for key, value in {**DEFAULTS, "spark.sql.shuffle.partitions": str(shuffle_partitions), **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
