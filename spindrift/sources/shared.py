"""The folder that the driver and all executors share, for scratch tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where that is unset, a temporary folder for a session on one machine, and an error
    on a cluster, whose executors would not see such a folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("on a cluster spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spindrift-")
    return _own[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path there."""
    return f"{shared_dir(spark)}/spindrift/{name}-{uuid.uuid4().hex}"
