"""Where queries that write put their files: the session's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def workspace(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that spark.checkpoint.dir names; a local one only where none is named."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return f"{root or tempfile.mkdtemp(prefix='quern-work-')}/quern-{label}-{uuid.uuid4().hex}"
