"""Written intermediates: they cut lineage and survive the loss of an executor."""

from __future__ import annotations

from pyspark.sql import DataFrame

from messlab.sources.workspace import scratch


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back with its own schema."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
