"""A Spark session with the settings that the engine expects."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession


def get_spark(app: str = "hemiciclo", **conf: str) -> SparkSession:
    """The running session, or a new one: UTC, adaptive execution, skewed joins split at run time."""
    builder = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only a session whose executors are this machine, and which names none, gets a folder of its own, removed at exit; on
    a cluster that is an error, as a folder of the driver's machine would be no one else's.
    """
    if not (named := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        named = tempfile.mkdtemp(prefix="hemiciclo-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", named)
    return named
