"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; only a local master may go without that setting."""
    context = spark.sparkContext
    top = context.getConf().get("spark.checkpoint.dir") or getattr(context, "_tracklake_tables", None)
    if not top:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = context._tracklake_tables = "file://" + tempfile.mkdtemp(prefix="spark-tracklake-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
