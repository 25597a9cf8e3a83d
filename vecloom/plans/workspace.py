"""A folder for index files that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def workspace(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, on one machine only, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: an index needs a folder that all executors share")
        root = tempfile.mkdtemp(prefix="vecloom-")
        spark.conf.set("spark.checkpoint.dir", f"file://{root}")
        root = f"file://{root}"
    if "://" not in root and root.startswith("/"):
        root = f"file://{root}"
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
