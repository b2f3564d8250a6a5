"""Dates as text: every directive, whatever the session zone."""

import datetime

import pytest
from pyspark.sql import functions as F

from messlab.functions.columns import Window, generate
from messlab.functions.formats import PARTS, text_sql
from messlab.operators import shape

#: Clocks in Sao Paulo skipped this hour, and the UTC day before it has other texts in both zones.
GAP = datetime.datetime(2018, 11, 4, 0, 10, 5, 250)


@pytest.fixture(params=["UTC", "America/Sao_Paulo", "Asia/Kolkata"])
def zone(spark, request):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", before)


def test_generated_date_strings(spark, zone):
    """One row with a window of one second: its text is known."""
    start = int((GAP.replace(microsecond=0) - datetime.datetime(1970, 1, 1)).total_seconds())
    columns = [{"name": "plain", "type": "date_str"}, {"name": "long", "type": "date_str", "format": "%d/%m/%Y %H:%M:%S"}]
    found = generate(spark.range(3), "id", columns, total=3, window=Window(start, start))
    assert {tuple(r) for r in found.collect()} == {("2018-11-04", "04/11/2018 00:10:05")}


def test_mixed_dates_in_every_format(spark, zone):
    """All files hit: a date and a time are written as one of the formats, the other stays; nulls stay null."""
    rows = spark.range(60).select(
        F.col("id").alias("file_date"), F.lit("2018-11-04").cast("date").alias("d"),
        F.when(F.col("id") < 59, F.lit(str(GAP)).cast("timestamp_ntz")).alias("t"))
    found = shape.mixed_dates(rows, "file_date", ["d", "t"], pct=1.0).collect()
    texts = {GAP.strftime(f) for f in shape.DATE_FORMATS}
    days, times = {r["d"] for r in found} - texts, {r["t"] for r in found if r["file_date"] < 59} - texts
    assert len(days) == 1 and days.pop().startswith("2018-11-04") and times == {"2018-11-04 00:10:05.00025"}
    assert {r[c] for r in found for c in "dt"} >= texts
    assert all((r["d"] in texts) != (r["t"] in texts) for r in found if r["file_date"] < 59)
    assert found and [r["t"] for r in found if r["file_date"] == 59] == [None]


def test_directives_equal_strftime(spark, zone):
    times = [GAP, datetime.datetime(1999, 12, 31, 12, 0), datetime.datetime(2024, 2, 29, 23, 59, 59, 999999), None]
    rows = spark.createDataFrame([(i, str(t) if t else None) for i, t in enumerate(times)], "i int, s string")
    rows = rows.select("i", F.col("s").cast("timestamp_ntz").alias("t"))
    formats = [f"%{d}" for d in PARTS] + ["%Y-%m-%d", "it's %% %d\\", "at %H"]
    found = rows.orderBy("i").select(*[F.expr(text_sql("t", f)) for f in formats]).collect()
    assert [tuple(r) for r in found] == [tuple(t and t.strftime(f) for f in formats) for t in times]
