"""Shared scratch space for written intermediates and stream checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh directory name under the shared folder of ``spark.checkpoint.dir``.

    A machine-local folder serves only a session that runs on one machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="messlab-")
    return f"{root.rstrip('/')}/messlab/{label}-{uuid.uuid4().hex}"
