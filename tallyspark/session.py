"""The session's settings that the engine's queries rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with ``CONF`` and what is given; the number of shuffle partitions is the cluster's to set."""
    b = SparkSession.builder.config(map=CONF | conf)
    return (b.master(master) if master else b).getOrCreate()
