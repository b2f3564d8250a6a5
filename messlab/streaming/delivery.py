"""Daily directories delivered as a stream.

Streams run with ``availableNow``: they take what has arrived, commit it and
stop.  The file sink's commit log makes each append exactly-once across
retries; checkpoints belong in shared storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from messlab.functions.columns import to_ntz
from messlab.functions.rng import ntz_micros, quote


def read_days(spark: SparkSession, path: str, schema: T.StructType, *, files_per_batch: int = 100) -> DataFrame:
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
            .parquet(path))


def deliver(stream: DataFrame, path: str, checkpoint: str, *, partition_by: str | None = None,
            timeout: int | None = None) -> None:
    """Append everything that has arrived to the Parquet directory ``path``, then stop.

    ``timeout``: seconds after which a caller gives up; without it a delivery takes the time it needs.
    """
    writer = (stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
              .option("checkpointLocation", checkpoint).option("path", path))
    query = (writer.partitionBy(partition_by) if partition_by else writer).start()
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"stream to {path} did not finish within {timeout} s")


def daily_counts(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """Rows per tumbling day once the watermark has closed it.

    A watermark needs TIMESTAMP, so a zone-free time is read as UTC and the day
    is given back zone-free.
    """
    instant = F.expr(f"timestamp_micros({ntz_micros(quote(time))})")
    return (stream.withColumn("__time", instant)
            .withWatermark("__time", delay)
            .groupBy(F.window("__time", "1 day").alias("w")).agg(F.count("*").alias("rows"))
            .select(F.expr(to_ntz("unix_micros(w.start)")).alias("day_start"), "rows"))
