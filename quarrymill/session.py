"""Session settings shared by tests, bench and the entry point."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_own_folders: dict[str, str] = {}


def build_session(app: str = "quarrymill", master: str | None = None, **conf: str) -> SparkSession:
    """A local session with the settings the library is tested under; a cluster's own settings win where they are set."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("QUARRYMILL_DRIVER_MEMORY", "8g"),
        "spark.sql.shuffle.partitions": "8",
    }
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, a local session (tests) gets a temporary one; a cluster has to name it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        path = _own_folders.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="quarrymill-")
        _own_folders[spark.sparkContext.applicationId] = path
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")
