"""Session settings the library is tested with. A cluster's own settings win where they are given."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "weftline", **conf: str) -> SparkSession:
    """A session with UTC times, adaptive execution and, without a master of its own, local cores."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
