"""Increments: daily batches as one job, appends, and per-day accounting."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from messlab.functions.columns import DAY, Window


def day_count(start: str, end: str) -> int:
    """Days from ``start`` to ``end``, both included; one when they are reversed."""
    return max(0, (date.fromisoformat(end) - date.fromisoformat(start)).days) + 1


def with_day(df: DataFrame, row: str, rows_per_day: int, start: str) -> DataFrame:
    """Add the day of each row and that day's window in epoch seconds.

    Rows are numbered through: day 0 has rows 0..k-1, day 1 the next k, and so
    on, so all days are generated by one job.
    """
    return (df.withColumn("day", F.date_add(F.lit(start).cast("date"),
                                            F.expr(f"CAST(`{row}` div {rows_per_day}L AS INT)")))
            .withColumn("day_start", F.unix_date("day").cast("long") * DAY)
            .withColumn("day_end", F.col("day_start") + DAY))


def day_window(**options) -> Window:
    return Window("`day_start`", "`day_end`", **options)


def daily_rows(spark: SparkSession, start: str, end: str, rows_per_day: int) -> DataFrame:
    """Row numbers for every day of [start, end] with their day and window."""
    rows = spark.range(day_count(start, end) * max(rows_per_day, 1)).withColumnRenamed("id", "__row")
    return with_day(rows, "__row", max(rows_per_day, 1), start)


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both; a column that one side lacks is null there."""
    return old.toDF(*old.columns).unionByName(new, allowMissingColumns=True)


def accounting(df: DataFrame, day: str = "day") -> DataFrame:
    """Rows appended per day, not the running total."""
    return df.groupBy(F.col(day).alias("day")).agg(F.count("*").alias("rows"))
