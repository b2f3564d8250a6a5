"""Making the package importable where Python workers run."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Settings of the C library and of Arrow: large blocks are mapped one by one, freed ends of the heap returned.
GIVE_BACK = {"MALLOC_MMAP_THRESHOLD_": str(8 << 20), "MALLOC_TRIM_THRESHOLD_": str(32 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}


def importable(spark: SparkSession) -> None:
    """Adds this checkout to the workers' PYTHONPATH.

    It helps where workers see the same folder, as in local mode; on a cluster
    the package comes with ``--py-files`` or the image.  Workers live on between
    stages, so they are told to give freed memory back.
    """
    for name, value in GIVE_BACK.items():
        spark.sparkContext.environment.setdefault(name, value)
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
