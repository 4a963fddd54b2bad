"""What a session needs for the library's Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def reachable(spark: SparkSession) -> None:
    """Python workers find this library where the driver does, if the folder exists there (local runs)."""
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if _HOME not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, _HOME]))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all machines share (``spark.checkpoint.dir``). Where it is unset, a local session gets a folder of its own and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="rankloom-")
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"
