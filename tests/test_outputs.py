"""Pages, files, tables and their listings."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from messlab.operators import audit, pages, shape
from messlab.sources import files, tables
from messlab.sources.workspace import scratch


def records(spark, n, start=0):
    return spark.range(start, start + n, 1, 4).select(
        "id", F.concat(F.lit("v"), "id").alias("v"), F.when(F.col("id") % 5 != 0, F.col("id") / 2).alias("x"))


def stored(spark, dump, per_block):
    path = scratch(spark, "test-pages")
    pages.write_pages(dump, path)
    return pages.read_pages(spark, path, dump.schema["data"].dataType.elementType)


@pytest.mark.parametrize("n, size", [(0, 10), (1, 10), (10, 10), (11, 10), (95, 10), (30, 1)])
def test_pages_round_trip(spark, n, size):
    frame = records(spark, n)
    dump = stored(spark, pages.page_dump(frame, "id", "api", size, pages_per_block=3), 3)
    lines = {r["page"]: r for r in dump.collect()}
    wanted = max(1, -(-n // size))
    assert sorted(lines) == list(range(1, wanted + 1))
    for page, line in lines.items():
        assert (line["api"], line["page_size"], line["total_pages"], line["total_records"]) == ("api", size, wanted, n)
        assert [r["id"] for r in line["data"]] == list(range((page - 1) * size, min(page * size, n)))
        assert line["block"] == (page - 1) // 3
    back = pages.records(dump)
    assert back.drop("ix").exceptAll(frame).isEmpty() and back.count() == n


@pytest.mark.parametrize("old, new, size", [(0, 5, 10), (10, 5, 10), (17, 30, 10), (17, 0, 10), (25, 1, 5), (3, 3, 100)])
def test_append_pages_again(spark, old, new, size):
    first = stored(spark, pages.page_dump(records(spark, old), "id", "api", size, pages_per_block=2), 2)
    both = pages.append_pages(first, records(spark, new, 1000), "id")
    lines = sorted(stored(spark, both, 2).collect(), key=lambda r: r["page"])
    total = old + new
    ids = [*range(old), *range(1000, 1000 + new)]
    assert [r["id"] for line in lines for r in line["data"]] == ids
    assert [line["page"] for line in lines] == list(range(1, max(1, -(-total // size)) + 1))
    assert {(line["total_records"], line["total_pages"]) for line in lines} == {(total, max(1, -(-total // size)))}


def test_browsing_prunes_directories(spark):
    dump = stored(spark, pages.page_dump(records(spark, 95), "id", "api", 10, pages_per_block=3), 3)
    page = pages.browse(dump, 7)
    assert [r["id"] for r in page.first()["data"]] == list(range(60, 70))
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(block" in plan
    assert pages.browse(dump, 11).isEmpty()


def test_page_dump_groups_with_one_shuffle_of_rows(spark):
    paged = records(spark, 95).withColumn("ix", F.col("id")).withColumn("total_records", F.lit(95))
    dump = pages.envelopes(pages.with_pages(paged, 10), "api", 10, ["id", "v", "x"])
    plan = dump._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def dated(spark, n=400):
    return records(spark, n).select(
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 40).cast("int")).alias("file_date"), "id", "v", "x",
        F.expr("TIMESTAMP_NTZ '2024-01-01 10:00:00' + INTERVAL '1' MINUTE * id").alias("at"))


def test_csv_files_differ_as_drawn(spark):
    path = scratch(spark, "test-csv")
    frame = dated(spark)
    files.write_csv(frame, path, missing_header_pct=0.4, order_drift=True, mixed_dates=True)
    marked = shape.order_variant(shape.header_missing(frame, "file_date", 0.4), "file_date", 4)
    wanted = {str(r["file_date"]): (not r["headerless"], None if r["headerless"] else r["order_variant"] == 0)
              for r in marked.select("file_date", "headerless", "order_variant").distinct().collect()}
    found = audit.header_profile(spark.read.text(path), ["id", "v", "x", "at"])
    seen = {r["path"].split("file_date=")[1][:10]: (r["has_header"], r["in_order"]) for r in found.collect()}
    assert seen == wanted
    assert len(set(wanted.values())) == 3


def test_mixed_dates_touch_one_column_of_a_file(spark):
    frame = dated(spark).withColumn("due", F.col("at"))
    mixed = shape.mixed_dates(frame, "file_date", ["at", "due"])
    plain = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"
    odd = r"^(\d{2}/\d{2}/\d{4}|\d{2}-\d{2}-\d{4}|\d{8})$"
    assert mixed.filter(~(F.col("at").rlike(plain) | F.col("at").rlike(odd))).isEmpty()
    assert mixed.filter(F.col("at").rlike(odd) & F.col("due").rlike(odd)).isEmpty()
    per_file = mixed.groupBy("file_date").agg(F.countDistinct(F.col("at").rlike(plain)).alias("kinds"))
    assert per_file.filter("kinds > 1").isEmpty()
    share = mixed.filter(F.col("at").rlike(odd) | F.col("due").rlike(odd)).select("file_date").distinct().count()
    assert 8 <= share <= 32


def test_parquet_evolution_keeps_the_key(spark):
    path = scratch(spark, "test-parquet")
    frame = dated(spark).withColumn("x", F.coalesce("x", F.lit(0.0)))
    files.write_parquet(frame, path, keep=["id"], schema_evolution=True)
    back = files.read_evolved(spark, path)
    assert back.count() == 400 and back.filter("id IS NULL").isEmpty()
    lacking = back.filter("v IS NULL OR x IS NULL OR at IS NULL")
    dropped = shape.dropped_column(frame, "file_date", ["v", "x", "at"]).filter("dropped IS NOT NULL")
    assert lacking.count() == dropped.count() > 0


def test_json_nulls_nesting_and_missing_keys(spark):
    frame = records(spark, 3000).select("id", "v", F.lit(None).cast("string").alias("gone"), "x")
    made = shape.json_records(frame, "id", ["v", "gone", "x"]).collect()
    kinds = {}
    for row in made:
        record = json.loads(row["record"])
        nested = "details" in record
        if nested:
            assert list(record) == ["v", "details"] and list(record["details"]) == ["gone", "x"]
            assert record["details"]["gone"] is None
        elif "gone" in record:
            assert record["gone"] is None
        kinds[nested, "gone" in record] = kinds.get((nested, "gone" in record), 0) + 1
    assert abs(sum(n for (nested, _), n in kinds.items() if nested) - 600) < 120
    assert abs(kinds[False, False] - 3000 * 0.8 * 0.3) < 130


def test_json_top_level_may_be_empty(spark):
    frame = spark.range(300).select("id", *[F.lit(None).cast("string").alias(c) for c in "abc"])
    made = {r["record"] for r in shape.json_records(frame, "id", ["a", "b", "c"]).collect()}
    assert made == {'{}', '{"a":null,"b":null,"c":null}', '{"details":{"b":null,"c":null}}',
                    '{"a":null,"details":{"b":null,"c":null}}'}


def test_two_columns_never_nest(spark):
    frame = records(spark, 200)
    assert shape.json_records(frame, "id", ["id", "v"], nested=1.0).filter("record LIKE '%details%'").isEmpty()


def test_summary_row(spark):
    total = shape.summary_row(records(spark, 10)).filter("id = 'Total'").first()
    assert total["v"] is None and total["x"] == sum(i / 2 for i in range(10) if i % 5)
    blank = shape.summary_row(records(spark, 3).select("v")).collect()
    assert len(blank) == 4 and sum(r["v"] is None for r in blank) == 1
    assert shape.summary_row(records(spark, 0)).isEmpty()


@pytest.mark.parametrize("n, halves", [(0, {}), (1, {"S": 1}), (2, {"S": 2}), (3, {"S_1": 1, "S_2": 2}),
                                       (101, {"S_1": 50, "S_2": 51})])
def test_sheet_split(spark, n, halves):
    split = shape.sheet_split(records(spark, n), "id", sheet="S")
    assert {r["sheet"]: r["count"] for r in split.groupBy("sheet").count().collect()} == halves
    if n > 2:
        assert split.filter("sheet = 'S_1'").agg(F.max("id")).first()[0] == n // 2 - 1


def test_workbooks(spark):
    path = scratch(spark, "test-sheets")
    frame = records(spark, 30).select(
        "id", "x", F.date_add(F.lit("2024-01-01").cast("date"), F.expr("CAST(id div 10 AS INT)")).alias("file_date"),
        (F.col("id") % 10).alias("position"))
    files.write_sheets(frame, path, rows_per_file=10, summary=True, split=True)
    back = spark.read.parquet(path)
    counts = {(str(r["file_date"]), r["sheet"]): r["count"] for r in back.groupBy("file_date", "sheet").count().collect()}
    assert counts == {(f"2024-01-0{d}", s): n for d in (1, 2, 3) for s, n in (("Sheet1_1", 5), ("Sheet1_2", 6))}
    assert back.filter("id = 'Total'").count() == 3


@pytest.mark.parametrize("frequency, third", [("daily", "2024-01-17"), ("weekly", "2024-01-29"),
                                              ("monthly", "2024-03-15"), ("odd", "2024-01-17")])
def test_file_dates(spark, frequency, third):
    dates = files.file_dates(spark.range(30), "id", 10, "2024-01-15", frequency=frequency, end="2024-01-17")
    last = dates.filter("file_no = 2").first()
    assert str(last["file_date"]) == third
    assert last["file_end"] <= 1705449600


def test_manifest(spark):
    path = scratch(spark, "test-manifest")
    files.write_parquet(dated(spark), path)
    found = files.file_manifest(spark.read.parquet(path), "e", "parquet")
    assert found.agg(F.sum("rows")).first()[0] == 400
    assert found.filter("size_kb <= 0").isEmpty() and found.columns == ["entity", "format", "path", "rows", "size_kb"]


def test_table_append_and_count(spark):
    name = f"t_{uuid.uuid4().hex}"
    path = scratch(spark, "test-table")
    for _ in range(2):
        tables.save_table(records(spark, 5), name, path=path)
    assert tables.table_rows(spark, name).first()["actual_rows"] == 10
    found = audit.row_counts({"t": spark.table(name)}, {"t": 12}).first()
    assert (found["target_rows"], found["actual_rows"], found["missing_rows"]) == (12, 10, 2)


def test_schema_profile(spark):
    found = audit.schema_profile(records(spark, 1), {"id": "bigint", "v": "int", "w": "string"})
    assert {r["column"]: r["issue"] for r in found.collect()} == {"id": "ok", "v": "type", "w": "missing", "x": "extra"}


def test_profiles_of_an_empty_table(spark):
    none = records(spark, 0)
    assert [r["rate"] for r in audit.null_profile(none).collect()] == [0.0] * 3
    assert audit.duplicate_key_profile(none, "id").first()["rate"] == 0.0
    assert audit.orphan_profile(none, "id", none, "id").first()["orphans"] == 0


def test_json_types(spark):
    lines = spark.createDataFrame([('{"a":1,"b":"x","c":[1]}',), ('{"a":"1","b":null,"d":true}',)], "j string")
    found = audit.json_type_profile(lines, "j", {"a": "number", "b": "string", "e": "object"})
    assert sorted((r["column"], r["found"] or "", r["rows"], r["issue"]) for r in found.collect()) == [
        ("a", "number", 1, "ok"), ("a", "string", 1, "type"), ("b", "null", 1, "null"), ("b", "string", 1, "ok"),
        ("c", "array", 1, "extra"), ("d", "boolean", 1, "extra"), ("e", "", 0, "missing")]


def test_scratch_names_are_fresh(spark):
    first, second = scratch(spark, "x"), scratch(spark, "x")
    assert "/messlab/x-" in first and first != second


@pytest.mark.parametrize("zone", ["UTC", "America/Sao_Paulo", "Asia/Kolkata"])
def test_csv_keeps_fractions_and_ignores_the_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        texts = ["2018-11-04 00:10:00", "2023-01-01 10:00:00.123456", "2023-01-01 10:00:00.5", None]
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string").select(
            "id", F.col("t").cast("timestamp_ntz").alias("t"), F.lit("2023-01-01").cast("date").alias("file_date"))
        path = scratch(spark, "test-csv")
        files.write_csv(df, path)
        back = spark.read.schema("id long, t timestamp_ntz").options(header=True, **files.TIMES).csv(path)
        assert [r[0] for r in back.orderBy("id").select(F.col("t").cast("string")).collect()] == texts
        lines = shape.csv_lines(df, "file_date", ["id", "t"], pct=0.0).orderBy("id").select("line").collect()
        assert [r[0] for r in lines] == [f"{i},{t or ''}" for i, t in enumerate(texts)]
        mixed = shape.mixed_dates(df, "file_date", "t", pct=0.0).orderBy("id").select("t").collect()
        assert [r[0] for r in mixed] == texts
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_variants_read_their_source_once(spark):
    """Headers, orders and evolved schemas, though each needs many writes; a second fresh write replaces the first."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch
    rows = dated(spark)
    source, n = rows.mapInArrow(count, rows.schema), rows.count()
    path = scratch(spark, "test-once")
    for k in (1, 2):
        files.write_csv(source, f"{path}/csv", missing_header_pct=0.5, order_drift=True, fresh=True)
        files.write_parquet(source, f"{path}/parquet", keep=["id"], schema_evolution=True, fresh=True)
        assert seen.value == 2 * k * n
    assert files.read_evolved(spark, f"{path}/parquet").count() == n
    headers = spark.read.text(f"{path}/csv").filter("value LIKE '%id%'").count()
    assert spark.read.text(f"{path}/csv").count() - headers == n
