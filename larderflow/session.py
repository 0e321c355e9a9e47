"""A session with the settings that the engine is tested with."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName("larderflow")
    if master:
        b = b.master(master)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.ui.showConsoleProgress": "false"}
    return b.config(map=base | conf).getOrCreate()
