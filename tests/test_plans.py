"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from messlab.functions.columns import Window, generate
from messlab.operators import audit, index, keys, mess, shape
from messlab.plans import samples
from messlab.plans.build import Builder


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def read_schema(text: str) -> set[str]:
    return {name for part in re.findall(r"ReadSchema: struct<([^>]*)>", text) for name in
            re.findall(r"(\w+):", part)}


@pytest.fixture(scope="module")
def orders(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet")


def test_faults_are_projections(orders):
    columns, rates = samples.ORDER_SPEC, {**samples.ORDER_RATES, "dup_pk_pct": 0.0}
    dirty = mess.apply(orders, "o_orderkey", columns, rates, pk="o_orderkey", versions=samples.VERSIONS)
    dirty = mess.stale_watermark(mess.soft_delete(dirty, "o_orderkey", 0.1), "o_orderkey", "o_orderdate", 0.1)
    assert "Exchange" not in plan(dirty) and "Join" not in plan(dirty)
    assert "Python" not in plan(dirty)


def test_faults_read_only_what_is_asked(orders):
    dirty = mess.negatives(mess.nulls(orders, "o_orderkey", ["o_custkey"], 0.1), "o_orderkey", 0.1, exclude=["o_orderkey"])
    assert read_schema(plan(dirty.select("o_custkey"))) == {"o_orderkey", "o_custkey"}
    assert read_schema(plan(dirty.select("o_orderstatus"))) == {"o_orderstatus"}


def test_filters_reach_the_scan_through_faults(orders):
    dirty = mess.nulls(orders, "o_orderkey", ["o_custkey"], 0.1).filter("o_orderdate > TIMESTAMP_NTZ '1999-01-01 00:00:00'")
    assert "GreaterThan(o_orderdate" in plan(dirty)


def test_audits_read_only_their_columns(orders):
    assert read_schema(plan(audit.null_profile(orders, ["o_custkey"]))) == {"o_custkey"}
    assert read_schema(plan(audit.duplicate_key_profile(orders, "o_orderkey"))) == {"o_orderkey"}


def test_generation_is_one_stage(spark):
    columns = [*samples.KEY_COLUMNS, *samples.TEXT_COLUMNS, *samples.SCALAR_COLUMNS, *samples.TIME_COLUMNS]
    made = generate(spark.range(100), "id", columns, total=100, window=Window.of(*samples.WINDOW))
    assert "Exchange" not in plan(made) and "Python" not in plan(made)


def test_generated_duplicates_need_no_join(spark):
    raw = samples.parent_child(10, 100)
    raw["database"]["entities"][1]["columns"] = [
        c for c in raw["database"]["entities"][1]["columns"] if c["type"] != "foreign_key"]
    builder = Builder.of(spark, raw)
    made = builder.table(builder.entity("children"))
    assert "Exchange" not in plan(made) and "Join" not in plan(made)


def test_duplicate_keys_leave_other_rows_unmoved(orders):
    text = plan(mess.duplicate_keys(orders, "o_orderkey", "o_orderkey", 0.02))
    first_branch = text.split("Union")[1].split("Project [__source")[0].split(":- ")[1]
    assert "Exchange" not in first_branch


def test_samples_filter_the_scan(orders):
    assert "Exchange" not in plan(index.sample(orders, "o_orderkey", 100))


def test_positions_use_no_single_task_window_over_rows(orders, monkeypatch):
    monkeypatch.setattr(index, "ROWS_PER_RANGE", 100)
    for made in (index.dense_index(orders, "o_orderkey"), index.hash_index(orders, "o_orderkey")):
        text = plan(made)
        rows = [line for line in text.splitlines() if "row_number()" in line and "Window" in line]
        assert rows and all("[__bucket" in line.split("AS _we")[-1] for line in rows)


def test_small_pools_are_broadcast(orders):
    pool = keys.key_pool(orders, "o_custkey")
    assert "BroadcastHashJoin" in plan(keys.fk_sample(orders, "o_orderkey", pool, "fk"))


def test_sheet_split_moves_no_rows(orders):
    assert "Exchange" not in plan(shape.sheet_split(orders, "o_orderkey"))


def test_key_audits_fold_rows_before_the_join(orders):
    text = plan(audit.orphan_profile(orders, "o_custkey", orders, "o_orderkey"))
    assert "partial_count" in text
    assert text.index("Join") < text.index("partial_count")


def test_per_file_draws_prune_partitions(spark, orders, tmp_path):
    path = str(tmp_path / "dated")
    orders.withColumn("file_date", F.trunc(F.to_date("o_orderdate"), "year")).write.partitionBy("file_date").parquet(path)
    marked = shape.dropped_column(spark.read.parquet(path), "file_date", ["o_custkey"], pct=0.5)
    assert "PartitionFilters: [CASE WHEN" in plan(marked.filter(F.col("dropped").eqNullSafe("o_custkey"))) or \
        "PartitionFilters: [(CASE WHEN" in plan(marked.filter(F.col("dropped").eqNullSafe("o_custkey")))
