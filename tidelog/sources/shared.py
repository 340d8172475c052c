"""The folder that driver and executors share, and scratch space in it."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_local: list[str] = []
_homes: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder; where neither is set, a temporary one under a local master, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = at.get() if at.isDefined() else None
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="tidelog-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return _local[0]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    app, root = spark.sparkContext.applicationId, shared_dir(spark)
    if (key := f"{app} {root}") not in _homes:
        home = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/tidelog-{app}-{uuid.uuid4().hex[:8]}")
        files = home.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        files.mkdirs(home)
        files.deleteOnExit(home)
        _homes[key] = home.toString()
    return f"{_homes[key]}/{name}-{uuid.uuid4().hex}"
