"""Batch twins of the watermark rules: which rows come too late, which lie behind."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from messlab.operators.index import running_max


def mark_late(df: DataFrame, time: str, arrival: Sequence[str] | str, delay_hours: int, *,
              name: str = "dropped", by: Sequence[str] | str = ()) -> DataFrame:
    """True where the row's day had already closed when it arrived.

    A day closes when the largest earlier time, of the same ``by`` if given, minus the delay reaches its end.
    """
    marked = running_max(df, time, arrival, "__seen", by=by)
    closes = F.to_date(time).cast("timestamp_ntz") + F.expr("INTERVAL '1' DAY")
    watermark = F.col("__seen") - F.expr(f"INTERVAL '{delay_hours}' HOUR")
    return marked.withColumn(name, F.coalesce(watermark >= closes, F.lit(False))).drop("__seen")


def late_by_day(df: DataFrame, time: str, arrival: Sequence[str] | str, delay_hours: int) -> DataFrame:
    """Rows per day of event time, and how many of them a watermark would drop."""
    marked = mark_late(df, time, arrival, delay_hours)
    return marked.groupBy(F.to_date(time).alias("day")).agg(
        F.count("*").alias("rows"), F.count_if("dropped").alias("late_rows"))


def mark_stale(df: DataFrame, time: str, arrival: Sequence[str] | str, hours: int, *,
               name: str = "stale", by: Sequence[str] | str = ()) -> DataFrame:
    """True where the time lies more than ``hours`` behind the largest earlier one, of the same ``by`` if given."""
    marked = running_max(df, time, arrival, "__seen", by=by)
    behind = F.col(time) < F.col("__seen") - F.expr(f"INTERVAL '{hours}' HOUR")
    return marked.withColumn(name, F.coalesce(behind, F.lit(False))).drop("__seen")
