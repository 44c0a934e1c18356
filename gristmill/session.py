"""Session settings that the library's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "gristmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution on; conf adds or overrides settings (dots as in Spark)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
