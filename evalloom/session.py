"""The one place that decides session settings."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, app: str = "evalloom", **conf: str) -> SparkSession:
    """A session with the settings every job here relies on; conf overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | conf).getOrCreate()


def kept(df: DataFrame, name: str) -> DataFrame:
    """df computed once: written to the folder of spark.checkpoint.dir and read from there, until that is emptied."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; where it is unset, in one of our own, on a single machine only."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if top is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='evalloom-')}"
    return f"{top}/{name}-{uuid.uuid4().hex}"
