"""Positions, samples and running values, on keys that are hot, null, textual or composite."""

import random

import pytest
from pyspark.sql import functions as F

from messlab.operators import index


@pytest.fixture(autouse=True)
def many_ranges(monkeypatch):
    monkeypatch.setattr(index, "ROWS_PER_RANGE", 50)


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows share one leading value, another part has none."""
    return spark.range(0, 9000, 1, 12).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 5).when(F.col("id") % 7 == 0, None)
        .otherwise(F.col("id") % 11).cast("int").alias("lead"),
        F.concat(F.lit('k"\\é,'), F.lpad(F.col("id").cast("string"), 5, "0")).alias("text"),
        (F.col("id") * 7919 % 9001).alias("value"))


@pytest.mark.parametrize("order", [["id"], ["lead", "id"], ["text"], ["lead", "text"], ["value"]])
def test_dense_index_is_the_sorted_position(hot, order):
    found = index.dense_index(hot, order, total="n").toPandas().sort_values("ix")
    wanted = hot.toPandas().sort_values(order, na_position="first")
    assert list(found["ix"]) == list(range(9000))
    assert list(found["id"]) == list(wanted["id"])
    assert set(found["n"]) == {9000}


@pytest.mark.parametrize("order", [["lead", "id"], ["text"]])
def test_sampled_split_points_give_the_same_positions(hot, monkeypatch, order):
    exact = index.dense_index(hot, order).select("id", "ix")
    monkeypatch.setattr(index, "KEYS_PER_RANGE", 4)
    monkeypatch.setattr(index, "ROWS_PER_RANGE", 300)
    sampled = index.dense_index(hot, order).select("id", "ix")
    assert sampled.exceptAll(exact).isEmpty()
    top = index.running_max(hot, "value", "id", "top").agg(F.max("top")).first()[0]
    assert top == hot.agg(F.max("value")).first()[0]


def test_a_hot_leading_value_is_split(hot):
    buckets = index.with_range_bucket(hot, ["lead", "id"], 24)
    biggest = buckets.groupBy(index.BUCKET).count().agg(F.max("count")).first()[0]
    assert biggest < 9000 / 10


@pytest.mark.parametrize("window, broadcast", [(1 << 20, 1 << 20), (1000, 1 << 20), (10, 1 << 20), (10, 0)])
def test_positions_within_groups(hot, monkeypatch, window, broadcast):
    """Groups of any size, also the null group and one with a third of the rows."""
    monkeypatch.setattr(index, "ROWS_PER_WINDOW", window)
    monkeypatch.setattr(index, "BROADCAST_BYTES", broadcast)
    ranked = index.hash_index(hot, "id", by="lead", total="n").toPandas()
    assert len(ranked) == 9000
    for _, part in ranked.groupby("lead", dropna=False):
        assert sorted(part["ix"]) == list(range(len(part))) and set(part["n"]) == {len(part)}
    monkeypatch.setattr(index, "ROWS_PER_WINDOW", 1 << 20)
    again = index.hash_index(hot, "id", by="lead").toPandas()
    assert list(again.sort_values("id")["ix"]) == list(ranked.sort_values("id")["ix"])


def test_a_hot_group_is_ranked_by_many_tasks(spark, hot, monkeypatch):
    monkeypatch.setattr(index, "ROWS_PER_WINDOW", 50)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = index.hash_index(hot, "id", by="lead").groupBy(F.spark_partition_id()).count()
        assert tasks.agg(F.max("count")).first()[0] < 9000 / 5
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_known_small_tables_are_ranked_by_one_window(hot):
    quick = index.hash_index(hot, "id", rows=9000).select("id", "ix")
    bucketed = index.hash_index(hot, "id").select("id", "ix")
    assert quick.exceptAll(bucketed).isEmpty() and quick.schema == bucketed.schema


@pytest.mark.parametrize("k", [0, 1, 2, 4500, 8999, 9000, 20_000])
def test_samples_are_exact(hot, k):
    drawn = index.sample(hot, "id", k)
    assert drawn.count() == min(k, 9000) == drawn.select("id").distinct().count()


def test_samples_by_text_key_and_fraction(hot):
    assert index.sample(hot, ["text"], fraction=0.013).count() == 117
    assert index.sample(hot, ["text"], fraction=0.00001).count() == 1
    assert index.sample(hot, ["lead", "text"], fraction=0).count() == 0


def test_sample_nests(hot):
    small = index.sample(hot, "id", 100).select("id")
    large = index.sample(hot, "id", 900).select("id")
    assert small.join(large, "id", "left_anti").isEmpty()


@pytest.mark.parametrize("k", [0, 1, 777, 8999, 9000])
def test_first_rows(hot, k):
    kept = hot.filter(index.first_rows(hot, ["lead", "id"], k, 9000)).toPandas()
    wanted = hot.toPandas().sort_values(["lead", "id"], na_position="first").head(k)
    assert set(kept["id"]) == set(wanted["id"])


def test_running_max(hot):
    found = index.running_max(hot, "value", "id", "top").toPandas().sort_values("id")
    wanted = found["value"].cummax().shift()
    assert found["top"].iloc[0] != found["top"].iloc[0] or found["top"].iloc[0] is None
    assert list(found["top"].iloc[1:]) == list(wanted.iloc[1:])


def test_microsecond_bounds(spark):
    rows = spark.range(500).select("id", F.expr(
        "TIMESTAMP_NTZ '2024-01-01 00:00:00' + INTERVAL '0.000001' SECOND * (id * 3 % 500)").alias("at"))
    found = index.dense_index(rows, ["at"]).toPandas().sort_values("ix")
    assert list(found["at"]) == sorted(found["at"]) and list(found["ix"]) == list(range(500))


def test_result_does_not_depend_on_parallelism(spark, hot):
    def positions(partitions):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        frame = hot.repartition(random.randint(2, 9))
        return (index.hash_index(frame, "id").toPandas().sort_values("id")["ix"].tolist(),
                sorted(index.sample(frame, "id", 321).toPandas()["id"]))
    try:
        assert positions("3") == positions("40")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_empty_table(spark, hot):
    none = hot.filter("id < 0")
    assert index.dense_index(none, "id").count() == 0
    assert index.hash_index(none, "id").count() == 0
    assert index.sample(none, "id", 5).count() == 0
    assert index.running_max(none, "value", "id", "top").count() == 0
