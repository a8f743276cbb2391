"""Spark session with the settings that the engine is written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "quillweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session: adaptive plans, UTC.  On a cluster spark-submit gives master and sizes; locally all cores are used."""
    builder = SparkSession.builder.appName(name)
    builder = builder.master(master or f"local[{os.environ.get('BENCH_CPUS', '*')}]")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8)),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    return builder.config(map=settings | conf).getOrCreate()
