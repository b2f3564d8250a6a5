"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the
local threads.  Results go to the no-op sink, so whole rows are computed.
"""

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from messlab.functions.columns import Window, generate
from messlab.plans.catalog import QUERIES

HEADLINES = [
    "fk_sample_orphans", "orphan_audit", "key_pool_after_faults", "dense_positions", "hash_positions_by_group",
    "sample_without_replacement", "gen_keys", "gen_text_columns", "gen_patterns", "gen_scalars", "gen_times",
    "gen_date_strings", "inject_nulls", "null_profile", "inject_duplicate_keys", "duplicate_key_audit",
    "inject_negatives", "negative_audit", "inject_impossible_dates", "date_audit", "schema_version_audit",
    "all_faults_in_order", "late_rows_daily", "stale_audit", "page_envelope", "page_roundtrip", "repaginate_append",
    "summary_row", "sheet_split", "csv_lines_drift", "mixed_date_formats", "missing_header",
    "schema_evolution_roundtrip", "json_shape_variation", "json_shape_audit", "schema_audit", "file_windows",
    "daily_batches", "incremental_append", "stream_daily_append", "stream_closed_days", "spec_tables", "spec_days",
]
GENERATED_ROWS = 4_000_000
SHIPMENT = [
    {"name": "id", "type": "uuid", "primary_key": True}, {"name": "customer", "type": "name"},
    {"name": "city", "type": "city"}, {"name": "status", "type": "choice", "choices": ["new", "sent", "done"]},
    {"name": "quantity", "type": "integer", "min": 1, "max": 50}, {"name": "price", "type": "float"},
    {"name": "paid", "type": "boolean"}, {"name": "created_at", "type": "timestamp"},
]


def generated(spark: SparkSession) -> DataFrame:
    """Four million rows of eight typed columns."""
    return generate(spark.range(GENERATED_ROWS), "id", SHIPMENT, total=GENERATED_ROWS, entity="bench",
                    window=Window.of("2023-01-01", "2024-12-31"))


def timed(make) -> float:
    started = time.time()
    make().write.format("noop").mode("overwrite").save()
    return round(time.time() - started, 3)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("messlab-bench")
             .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
             .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
             .getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    timed(lambda: spark.read.parquet(f"{sf}/lineitem.parquet"))
    seconds = {name: timed(lambda name=name: QUERIES[name](spark, sf)) for name in HEADLINES}
    seconds["generate_4m_rows"] = timed(lambda: generated(spark))
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": sf.rsplit("sf", 1)[-1], "cpus": cpus,
                      "generated_rows_per_second": round(GENERATED_ROWS / seconds["generate_4m_rows"])}))
    spark.stop()


if __name__ == "__main__":
    main()
