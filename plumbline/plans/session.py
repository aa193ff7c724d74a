"""Session settings the jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Periods and hashes must not depend on where the driver runs.
    "spark.sql.session.timeZone": "UTC",
    # Re-plan joins and split skewed partitions at run time.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}
# Checks and detectors put a hundred conditions into one function; the JVM never compiles
# one of more than 8000 bytes, so Spark is to split those up.
SURVEY_SETTINGS = {"spark.sql.codegen.hugeMethodLimit": "8000"}
# Only a new session can take these.
STATIC_SETTINGS = {
    # Recording a call site per column costs more than the plans it describes.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def prepare(spark: SparkSession, extra: dict[str, str] | None = None) -> SparkSession:
    """Apply the settings and ``extra`` ones to a running session."""
    for name, value in {**SETTINGS, **(extra or {})}.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def session(name: str, master: str | None = None, extra: dict[str, str] | None = None) -> SparkSession:
    """A new session with all settings and ``extra`` ones."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **SURVEY_SETTINGS, **STATIC_SETTINGS, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
