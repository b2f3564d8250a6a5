import datetime

import pytest
from pyspark.sql import functions as F

from messlab.operators import batches
from messlab.sources.workspace import scratch
from messlab.streaming import delivery, late


def day_rows(spark, day, n, start):
    return spark.range(start, start + n).select("id", F.expr(
        f"TIMESTAMP_NTZ '2024-01-{day:02d} 00:00:00' + INTERVAL '1' MINUTE * (id - {start})").alias("ts"))


def test_each_day_is_appended_once(spark):
    source, sink, check = (scratch(spark, f"test-{n}") for n in ("in", "out", "check"))
    schema = day_rows(spark, 1, 1, 0).schema
    for day in (1, 2, 3):
        day_rows(spark, day, 100, day * 1000).coalesce(1).write.mode("append").parquet(source)
        for _ in range(2):
            delivery.deliver(delivery.read_days(spark, source, schema, files_per_batch=1), sink, check)
        assert spark.read.parquet(sink).count() == 100 * day
    assert spark.read.parquet(sink).select("id").distinct().count() == 300


def test_watermark_drops_what_the_batch_twin_marks(spark):
    source, sink, check = (scratch(spark, f"test-{n}") for n in ("in", "out", "check"))
    schema = day_rows(spark, 1, 1, 0).schema
    arrivals = [(1, 100, 1000), (2, 100, 2000), (9, 100, 9000), (1, 30, 9500), (9, 10, 9800), (20, 5, 20_000)]
    everything = None
    for day, n, start in arrivals:
        part = day_rows(spark, day, n, start)
        part.coalesce(1).write.mode("append").parquet(source)
        everything = part if everything is None else everything.unionByName(part)
        stream = delivery.read_days(spark, source, schema, files_per_batch=1)
        delivery.deliver(delivery.daily_counts(stream, "ts", "2 days"), sink, check)
    counted = {r["day_start"].day: r["rows"] for r in spark.read.parquet(sink).collect()}
    twin = {r["day"].day: r["rows"] - r["late_rows"] for r in late.late_by_day(everything, "ts", "id", 48).collect()}
    assert counted == {1: 100, 2: 100, 9: 110}
    assert {d: n for d, n in twin.items() if d in counted} == counted


def test_stream_ignores_the_session_zone(spark):
    source, sink, check = (scratch(spark, f"test-{n}") for n in ("in", "out", "check"))
    rows = day_rows(spark, 1, 1440, 0).unionByName(day_rows(spark, 9, 1, 5000))
    rows.coalesce(1).write.parquet(source)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        stream = delivery.read_days(spark, source, rows.schema)
        delivery.deliver(delivery.daily_counts(stream, "ts", "1 day"), sink, check)
        assert [(r["day_start"], r["rows"]) for r in spark.read.parquet(sink).collect()] == [
            (datetime.datetime(2024, 1, 1), 1440)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_stale_marks(spark):
    rows = spark.createDataFrame([(0, "2024-01-05"), (1, "2024-01-03"), (2, "2024-01-04"), (3, "2024-01-06"),
                                  (4, "2024-01-06")], "id int, d string").withColumn("ts", F.col("d").cast("timestamp_ntz"))
    marked = late.mark_stale(rows, "ts", "id", 24).orderBy("id").collect()
    assert [r["stale"] for r in marked] == [False, True, False, False, False]


@pytest.mark.parametrize("start, end, days", [("2024-01-01", "2024-01-01", 1), ("2024-02-28", "2024-03-01", 3),
                                              ("2024-01-05", "2024-01-01", 1)])
def test_daily_rows(spark, start, end, days):
    rows = batches.daily_rows(spark, start, end, 10)
    assert batches.day_count(start, end) == days
    counts = [r["rows"] for r in batches.accounting(rows).collect()]
    assert counts == [10] * days
    assert rows.filter("day_end - day_start <> 86400").isEmpty()


def test_append_fills_missing_columns(spark):
    both = batches.append(spark.range(2), spark.range(3).withColumn("extra", F.lit(1)))
    assert both.count() == 5 and both.filter("extra IS NULL").count() == 2


def test_stale_within_each_group(spark):
    """Null is a group of its own; a row is measured against earlier rows of its group only."""
    rows = [(0, "a", 10), (1, None, 1), (2, "b", 2), (3, "a", 3), (4, None, 9), (5, "b", 3), (6, None, 2)]
    df = spark.createDataFrame(rows, "id long, g string, day int").selectExpr(
        "id", "g", "make_timestamp_ntz(2024, 1, day, 0, 0, 0) AS t")
    marked = late.mark_stale(df, "t", "id", 24, by="g").orderBy("id").select("id", "stale").collect()
    assert [r["id"] for r in marked if r["stale"]] == [3, 6] and len(marked) == len(rows)


def test_days_close_alike_in_every_zone(spark):
    """A zone-free day starts at midnight, also where the session's zone skips that hour."""
    rows = [(0, "2018-11-04 00:10:00"), (1, "2018-11-05 00:30:00"), (2, "2018-11-04 23:00:00"),
            (3, "2018-11-05 01:00:00")]
    df = spark.createDataFrame(rows, "id long, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/Sao_Paulo", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            marked = late.mark_late(df, "t", "id", 0).orderBy("id").select("dropped").collect()
            assert [r[0] for r in marked] == [False, False, True, False]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
