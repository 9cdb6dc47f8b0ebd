"""Session defaults and table access."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "sparrowdoc", master: str | None = None, **conf: str) -> SparkSession:
    """A session with this library's defaults; ``conf`` overrides them (dots as in Spark's keys)."""
    builder = SparkSession.builder.appName(app)
    master = master or os.environ.get("SPARK_MASTER")
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a scale folder; only Spark opens the path, so any store it knows will do."""
    return spark.read.parquet(table_path(sf_dir, name))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session names it.

    Where it names none, one is made on the machine that is driver and executor at once (a local master, as in tests);
    on a cluster that would be a folder no executor sees, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="sparrowdoc-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")
