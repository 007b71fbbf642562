"""Folders for tables that a job writes and reads again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder where `spark.checkpoint.dir` says; where that is unset and Spark runs in one process (tests), in a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        root = _own.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="plenum-scratch-")
        _own[app] = root
    return f"{root.rstrip('/')}/scratch/{name}-{uuid.uuid4().hex}"
