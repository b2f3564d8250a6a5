"""Table sinks and the row count read back after a load."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F


def save_table(df: DataFrame, table: str, *, path: str | None = None, mode: str = "append") -> None:
    """Create the table if it is absent and append; ``path`` makes it an external table."""
    writer = df.write.format("parquet").mode(mode)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def register(spark: SparkSession, table: str, path: str) -> None:
    """Make the partitioned files under ``path`` a table, or add new partitions to it; repeating it changes nothing."""
    if not spark.catalog.tableExists(table):
        spark.catalog.createTable(table, path=path, source="parquet")
    spark.catalog.recoverPartitions(table)
    spark.catalog.refreshTable(table)


def save_jdbc(df: DataFrame, url: str, table: str, *, properties: Mapping[str, str] | None = None,
              mode: str = "append", rows_per_insert: int = 10_000, connections: int | None = None) -> None:
    """Append over JDBC, one connection per task; ``connections`` bounds how many there are."""
    part = df.coalesce(connections) if connections else df
    (part.write.format("jdbc").mode(mode).options(url=url, dbtable=table, batchsize=rows_per_insert)
     .options(**(properties or {})).save())


def table_rows(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table).agg(F.count("*").alias("actual_rows"))
