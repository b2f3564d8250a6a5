import datetime
import math

import pytest
from pyspark.sql import functions as F

from messlab.operators import audit, index, keys, mess, skew

N = 20_000


@pytest.fixture(scope="module")
def base(spark):
    return spark.range(0, N, 1, 8).select(
        "id", F.concat(F.lit("k"), F.col("id")).alias("code"), (F.col("id") % 100 + 1).alias("whole"),
        (F.col("id") / 7).alias("real"), (F.col("id") % 2 == 0).alias("flag"),
        F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + INTERVAL '1' SECOND * id").alias("at"),
        F.expr("date_add(DATE '2024-01-01', CAST(id % 300 AS INT))").alias("day"),
        F.expr("date_format(date_add(DATE '2024-01-01', CAST(id % 300 AS INT)), 'dd/MM/yyyy')").alias("day_text"))


def within(count, p, n=N):
    return abs(count - n * p) < 5 * math.sqrt(n * p * (1 - p)) + 1


def test_null_rates_and_independence(base):
    dirty = mess.nulls(base, "id", ["code", "real"], 0.1)
    code, real, both, other = dirty.agg(*[F.count_if(c) for c in (
        F.col("code").isNull(), F.col("real").isNull(), F.col("code").isNull() & F.col("real").isNull(),
        F.col("at").isNull())]).first()
    assert within(code, 0.1) and within(real, 0.1) and within(both, 0.01) and other == 0
    assert mess.nulls(base, "id", ["code"], 0).exceptAll(base).isEmpty()
    assert mess.nulls(base, "id", ["code"], 1.0).filter("code IS NOT NULL").isEmpty()


def test_faults_repeat_and_ignore_partitioning(base):
    once = mess.nulls(base, "id", ["code"], 0.3)
    again = mess.nulls(base.repartition(3), "id", ["code"], 0.3)
    assert once.exceptAll(again).isEmpty() and again.exceptAll(once).isEmpty()
    other = mess.nulls(base, "id", ["code"], 0.3, seed=43)
    assert not once.exceptAll(other).isEmpty()


@pytest.mark.parametrize("pct, key", [(0.02, "id"), (0.5, "code"), (1.0, "id"), (0.00001, "id")])
def test_duplicate_keys_are_exact(base, pct, key):
    dirty = mess.duplicate_keys(base, key, "code", pct)
    k = max(1, int(N * pct))
    assert dirty.columns == base.columns and dirty.count() == N
    pairs = dirty.alias("d").join(base.alias("b"), "id").select(F.col("d.code").alias("new"), F.col("b.code").alias("old"))
    moved = pairs.filter("new <> old")
    assert k - 15 <= moved.count() <= k
    assert moved.groupBy("new").count().filter("count > 1").isEmpty()
    assert dirty.join(base, "code", "left_anti").isEmpty()


def test_negatives_spare_keys_and_flags(base):
    dirty = mess.negatives(base, "id", 0.05, exclude=["id"])
    found = {r["column"]: r["negatives"] for r in audit.negative_profile(dirty).collect()}
    assert found["id"] == 0 and within(found["whole"], 0.05) and within(found["real"], 0.05)
    assert dirty.schema == base.schema or [f.dataType for f in dirty.schema] == [f.dataType for f in base.schema]


def test_impossible_dates_by_type(base):
    dirty = mess.impossible_dates(base, "id", ["at", "day", "day_text"], 0.1)
    for c, future in (("at", datetime.datetime(2099, 12, 31)), ("day", datetime.date(2099, 12, 31)),
                      ("day_text", "2099-12-31")):
        past = type(future)(1900, 1, 1) if c != "day_text" else "1900-01-01"
        assert within(dirty.filter(F.col(c) == F.lit(future)).count(), 0.05)
        assert within(dirty.filter(F.col(c) == F.lit(past)).count(), 0.05)


def test_version_gate_counts_1900_as_old_and_leaves_undated_rows(base):
    dirty = mess.nulls(mess.impossible_dates(base, "id", ["at"], 0.1), "id", ["at"], 0.1)
    gated = mess.schema_versions(dirty, "at", [{"from": "2024-01-01", "added_fields": ["code", "absent"]},
                                               {"added_fields": ["real"]}])
    assert gated.filter("at < TIMESTAMP_NTZ '2024-01-01 00:00:00' AND code IS NOT NULL").isEmpty()
    assert gated.filter("at < TIMESTAMP_NTZ '2024-01-01 00:00:00'").count() > 500
    assert gated.filter("(at IS NULL OR at >= TIMESTAMP_NTZ '2024-01-01 00:00:00') AND code IS NULL").isEmpty()
    assert gated.filter("real IS NULL").isEmpty()


def test_version_gate_reads_text_dates(base):
    gated = mess.schema_versions(base, "day_text", [{"from": "2024-06-01", "added_fields": ["code"]}],
                                 base_format="%d/%m/%Y")
    assert gated.filter("day < DATE '2024-06-01' AND code IS NOT NULL").isEmpty()
    assert gated.filter("day >= DATE '2024-06-01' AND code IS NULL").isEmpty()
    unread = mess.schema_versions(base, "code", [{"from": "2024-06-01", "added_fields": ["real"]}])
    assert unread.filter("real IS NULL").isEmpty()


def test_stale_times_go_back_whole_hours(base):
    moved = mess.stale_watermark(base, "id", "at", 0.1).join(base.select("id", F.col("at").alias("was")), "id")
    hours = moved.filter("at <> was").select(F.expr("timestampdiff(SECOND, at, was)").alias("s"))
    low, high, n, odd = hours.agg(F.min("s"), F.max("s"), F.count("*"), F.count_if(F.col("s") % 3600 != 0)).first()
    assert low == 3600 and high == 71 * 3600 and odd == 0 and within(n, 0.1)
    days = mess.stale_watermark(base, "id", "day", 1.0).join(base.select("id", F.col("day").alias("was")), "id")
    assert {r[0] for r in days.select(F.datediff("was", "day")).distinct().collect()} == {1, 2, 3}
    text = mess.stale_watermark(base, "id", "day_text", 1.0, strftime="%d/%m/%Y")
    assert text.filter(~F.col("day_text").rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:00:00$")).isEmpty()


def test_late_rows_move_back_and_stay_in_the_window(base):
    moved = mess.late_arrivals(base, "id", "at", 0.2, max_days=2, low="2023-12-31", high="2024-01-01 03:00:00")
    low, high = moved.agg(F.min("at"), F.max("at")).first()
    assert low == datetime.datetime(2023, 12, 31) and high == datetime.datetime(2024, 1, 1, 3)
    assert mess.clip(mess.nulls(base, "id", ["at"], 1.0), "at", low="2024-01-01").filter("at IS NOT NULL").isEmpty()


def test_soft_delete_only_when_asked(base):
    assert mess.soft_delete(base, "id", 0).columns == base.columns
    assert within(mess.soft_delete(base, "id", 0.05).filter("is_deleted").count(), 0.05)


def test_apply_keeps_order_and_identity(base):
    columns = [{"name": "id", "type": "integer", "primary_key": True, "nullable": True},
               {"name": "code", "type": "string", "nullable": True}, {"name": "whole", "type": "integer"},
               {"name": "at", "type": "timestamp", "temporal": True, "nullable": True}]
    rates = {"null_pct": 0.2, "dup_pk_pct": 0.1, "negative_numeric_pct": 0.1, "impossible_date_pct": 0.1}
    dirty = mess.apply(base, "id", columns, rates, pk="id")
    assert dirty.columns == base.columns and dirty.count() == N
    found = {r["column"]: r["nulls"] for r in audit.null_profile(dirty).collect()}
    assert within(found["code"], 0.2) and abs(found["id"] - 0.2 * N) < 300
    assert within(found["at"], 0.2 * 0.9) and found["real"] == 0
    assert dirty.filter("id < 0").isEmpty()


# --------------------------------------------------------------------- keys

def test_pool_ignores_nulls_and_repeats(spark):
    parent = spark.sql("SELECT * FROM VALUES (1), (1), (NULL), (7), (9) AS t(k)")
    pool = keys.key_pool(parent, "k")
    assert pool.size == 3
    assert sorted(pool.frame.collect()) == sorted(pool.frame.distinct().collect())
    assert {r["key"] for r in pool.frame.collect()} == {1, 7, 9}
    assert sorted(r["ix"] for r in pool.frame.collect()) == [0, 1, 2]


@pytest.mark.parametrize("cap", [1, 10, 1000, 19_999, 20_000, None])
def test_pool_cap_is_exact(base, cap):
    pool = keys.key_pool(base, "code", cap)
    size = min(cap or N, N)
    assert pool.size == size == pool.frame.select("key").distinct().count()
    assert pool.frame.agg(F.max("ix")).first()[0] == size - 1


def test_capped_pool_of_a_hot_parent_key(spark):
    parent = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"))
    assert keys.key_pool(parent, "k", 100).frame.count() == 100


def test_foreign_keys_point_at_parents(base, spark):
    pool = keys.key_pool(base, "code", 50)
    child = keys.fk_sample(spark.range(N), "id", pool, "fk", orphan_pct=0.1)
    profile = audit.orphan_profile(child, "fk", base, "code").first()
    assert profile["rows"] == N and within(profile["orphans"], 0.1)
    assert audit.orphan_rows(child, "fk", base, "code").count() == profile["orphans"]
    share = child.join(pool.frame, child["fk"] == pool.frame["key"]).groupBy("fk").count()
    low, high = share.agg(F.min("count"), F.max("count")).first()
    assert 250 < low and high < 480


def test_foreign_key_types_and_empty_parent(spark):
    parent = spark.range(10)
    numeric = keys.fk_sample(spark.range(100), "id", keys.key_pool(parent, "id"), "fk")
    assert numeric.schema["fk"].dataType.simpleString() == "bigint"
    orphaned = keys.fk_sample(spark.range(100), "id", keys.key_pool(parent, "id"), "fk", orphan_pct=1.0)
    assert orphaned.filter(F.length("fk") != 36).isEmpty()
    nobody = keys.fk_sample(spark.range(100), "id", keys.key_pool(parent.filter("id < 0"), "id"), "fk")
    assert nobody.select("fk").distinct().count() == 100


def test_large_pools_are_joined_without_broadcast(base, spark, monkeypatch):
    pool = keys.key_pool(base, "code", None)
    wide = keys.fk_sample(spark.range(N), "id", pool, "fk", orphan_pct=0.1)
    monkeypatch.setattr(index, "BROADCAST_BYTES", 1000)
    pool = keys.key_pool(base, "code", None)
    shuffled = keys.fk_sample(spark.range(N), "id", pool, "fk", orphan_pct=0.1)
    assert wide.exceptAll(shuffled).isEmpty() and shuffled.count() == N


def test_same_day_keys_with_a_hot_day(spark, monkeypatch):
    day = F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 40).cast("int")
    parent = spark.range(3000).select("id", F.date_add(F.lit("2024-01-01").cast("date"), day).alias("day"))
    child = spark.range(12_000).select("id", F.date_add(F.lit("2024-01-01").cast("date"), day + 2).alias("day"))
    made = keys.fk_sample_within(child, "id", "day", parent, "day", "id", "fk", orphan_pct=0.1)
    held = made.join(parent.select(F.col("id").cast("string").alias("fk"), F.col("day").alias("its_day")), "fk")
    assert made.count() == 12_000
    assert held.filter("day <> its_day").isEmpty()
    known = child.join(parent, "day", "left_semi").count()
    assert within(held.count(), 0.9, known)
    monkeypatch.setattr(index, "BROADCAST_BYTES", 1)
    monkeypatch.setattr(index, "ROWS_PER_WINDOW", 100)
    for few in (5, 5000):
        monkeypatch.setattr(skew, "HOT_ROWS", 10)
        monkeypatch.setattr(keys, "FEW_PARENTS", few)
        split = keys.fk_sample_within(child, "id", "day", parent, "day", "id", "fk", orphan_pct=0.1)
        assert split.exceptAll(made).isEmpty() and made.exceptAll(split).isEmpty()
    monkeypatch.setattr(skew, "HOT_ROWS", 1 << 20)
    again = keys.fk_sample_within(child, "id", "day", parent, "day", "id", "fk", orphan_pct=0.1)
    assert again.exceptAll(made).isEmpty() and made.exceptAll(again).isEmpty()


def test_hot_values(spark, monkeypatch):
    rows = spark.range(30_000).select(F.expr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 5 = 0 THEN NULL ELSE id END").alias("k"))
    assert skew.hot_values(rows, "k") == []
    monkeypatch.setattr(skew, "HOT_ROWS", 100)
    assert skew.hot_values(rows, "k") == [7, None]
    assert skew.hot_values(rows.filter("k < 0"), "k") == []


@pytest.mark.parametrize("known", [True, False])
def test_orphans_of_a_hot_key(spark, monkeypatch, known):
    child = spark.range(30_000).select("id", F.expr(
        "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 5 = 0 THEN NULL ELSE id END").alias("k"))
    parent = spark.range(20_000).select(F.expr("CASE WHEN id % 2 = 0 THEN 8 ELSE id END").alias("p")).filter(
        "true" if known else "p <> 7")
    plain, marked = audit.orphan_rows(child, "k", parent, "p"), audit.mark_orphans(child, "k", parent, "p")
    monkeypatch.setattr(skew, "HOT_ROWS", 100)
    split, flagged = audit.orphan_rows(child, "k", parent, "p"), audit.mark_orphans(child, "k", parent, "p")
    assert split.exceptAll(plain).isEmpty() and plain.exceptAll(split).isEmpty() and split.columns == child.columns
    assert flagged.exceptAll(marked).isEmpty() and flagged.count() == 30_000
    counted = audit.orphan_profile(child, "k", parent, "p").first()
    assert counted["orphans"] == plain.count() == marked.filter("orphan").count()
    assert counted["null_keys"] == 4000 and plain.filter("k = 7").count() == (0 if known else 10_001)


def test_rows_without_parent_do_not_meet_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(index, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pool = keys.key_pool(spark.range(500), "id")
        child = keys.fk_sample(spark.range(N), "id", pool, "fk", orphan_pct=0.7)
        assert child.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < N / 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
