import tempfile

import pytest
from pyspark.sql import functions as F

from messlab.operators import audit, pages
from messlab.plans import runs
from messlab.plans.build import Builder
from messlab.plans.conformance import check, fill_regex
from messlab.plans.spec import faults, fill_pattern, normalise, rates, share


@pytest.mark.parametrize("value, rate", [(5, 0.05), (1, 1.0), (0.3, 0.3), (0, 0.0), ("20", 0.2), (100, 1.0)])
def test_share(value, rate):
    assert share(value) == rate


@pytest.mark.parametrize("pattern, fill", [
    ("^WH-[A-Z]{2}-[0-9]{3}$", "WH-??-###"), ("1Z[A-Z0-9]{12}", "1Z************"), (r"SKU\d{3}", "SKU###"),
    ("[A-Z]{2,4}", "??"), ("[0-9]+", "########"), ("[a-z]*x", "????????x"), ("A[0-9]?B", "AB"), ("??-###", "??-###"),
    ("plain", "plain"), (r"a\.b[0-9]", "a.b#"), ("x.y", "x*y"), (r"\w{3}", "***"), ("[xyz]{2}", "??"),
])
def test_regular_expressions_become_fill_patterns(pattern, fill):
    assert fill_pattern(pattern) == fill


def test_fault_names():
    assert faults({"null_rate": 5, "duplicate_rate": 2, "impossible_values": True, "naming_inconsistencies": True,
                   "orphaned_fk_pct": 3, "summary_rows": True, "unheard_of": 1}) == {
        "null_pct": 0.05, "dup_pk_pct": 0.02, "negative_numeric_pct": 0.02, "impossible_date_pct": 0.01,
        "column_order_drift": True, "orphaned_fk_pct": 0.03, "summary_rows": True}
    assert faults({"impossible_values": True, "negative_numeric_pct": 50})["negative_numeric_pct"] == 0.5


UNIFIED = {
    "project": "shop",
    "global_settings": {"temporal_range": ["2024-01-01", "2024-03-31"], "default_null_pct": 10},
    "entities": [
        {"name": "children", "target": "kids", "volume": 3000, "schema_versions": [
            {"from": "2024-02-01", "added_fields": ["channel"]}],
         "messiness": {"duplicate_rate": 2, "orphaned_fk_pct": 5, "negative_numeric_pct": 2, "impossible_date_pct": 0.01},
         "columns": [{"name": "id", "type": "uuid", "primary_key": True},
                     {"name": "parent_id", "logical_link": "parents.id"},
                     {"name": "amount", "type": "decimal", "range": [0, 500]},
                     {"name": "status", "type": "enum", "values": ["a", "b", "c", "d"]},
                     {"name": "shipped", "type": "date", "nullable_pct": 3},
                     {"name": "channel", "type": "varchar", "pattern": "^CH-[A-Z]{2}$"},
                     {"name": "created_at", "type": "datetime", "temporal": True}]},
        {"name": "parents", "volume": 300, "columns": {"id": {"type": "int", "primary_key": True, "max": 10**6},
                                                       "name": "person", "kind": ["x", "y"], "rank": {"max": 9}}},
        {"name": "ship", "source_type": "file", "volume": 1400, "path_structure": "out/ship/year={year}/m={month}/",
         "messiness": {"missing_header_pct": 30, "dup_pk_pct": 10},
         "columns": {"tracking": {"type": "uuid", "primary_key": True}, "at": "timestamp"}},
        {"name": "book", "source_type": "file", "format": "excel", "num_files": 3, "rows_per_file": 10,
         "messiness": {"summary_rows": True, "multi_sheet_split": True}, "columns": {"n": {"max": 9}, "at": "date"}},
        {"name": "notes", "source_type": "file", "format": "json", "num_files": 2, "rows_per_file": 50,
         "messiness": {"null_vs_missing_keys": True}, "columns": {"a": "name", "b": "city", "c": "email"}},
        {"name": "courier", "source_type": "api_dump", "approx_record_count": 250,
         "response_structure": {"page_size": 100}, "messiness": {"soft_delete_pct": 5, "stale_watermark_pct": 5},
         "fields": [{"name": "t", "type": "string", "pattern": "1Z[A-Z0-9]{12}"}, {"name": "n", "type": "integer",
                    "primary_key": True, "min": 0, "max": 10**6}, {"name": "at", "type": "timestamp"}]},
    ],
}


def test_unified_layout():
    spec = normalise(UNIFIED)
    kids, parents = spec["tables"]
    assert (kids["name"], kids["row_count"], parents["row_count"]) == ("kids", 3000, 300)
    by_name = {c["name"]: c for c in kids["columns"]}
    assert by_name["parent_id"] == {"name": "parent_id", "type": "foreign_key", "ref": "parents.id"}
    assert (by_name["amount"]["type"], by_name["amount"]["max"]) == ("float", 500)
    assert by_name["status"] == {"name": "status", "type": "choice", "choices": ["a", "b", "c", "d"]}
    assert by_name["shipped"]["nullable"] and by_name["channel"]["pattern"] == "CH-??"
    assert [c["type"] for c in parents["columns"]] == ["integer", "name", "choice", "integer"]
    ship, book, _ = spec["files"]
    assert (ship["output_format"], ship["num_files"], ship["rows_per_file"]) == ("csv", 2, 700)
    assert (ship["output_dir"], ship["filename_pattern"]) == ("out/ship", "ship_{date}.csv")
    assert book["filename_pattern"].endswith(".xlsx")
    api = spec["apis"][0]
    assert (api["total_records"], api["page_size"], api["filename_pattern"]) == (250, 100, "page_{page}.json")
    assert spec["faults"] == {"null_pct": 0.1} and rates(spec, kids)["dup_pk_pct"] == 0.02


def test_plain_layout_keeps_patterns_and_text():
    spec = normalise({"temporal": {"start_date": "2024-01-01", "end_date": "2024-01-02"}, "global_messiness": {},
                      "database": {"entities": [{"name": "t", "row_count": 5, "columns": [
                          {"name": "a", "type": "text"}, {"name": "b", "type": "string", "pattern": "A.[#]"}]}]}})
    assert [c["type"] for c in spec["tables"][0]["columns"]] == ["text", "string"]
    assert spec["tables"][0]["columns"][1]["pattern"] == "A.[#]" and spec["faults"] == {}


def test_defaults_and_unknown_sources():
    assert normalise({"entities": []})["temporal"]["start_date"] == "2023-01-01"
    assert normalise({"entities": []})["faults"]["null_pct"] == 0.04
    with pytest.raises(ValueError, match="source_type"):
        normalise({"entities": [{"name": "x", "source_type": "queue"}]})


def test_tables_follow_the_specification(spark):
    made = Builder.of(spark, UNIFIED).tables()
    kids, parents = made["kids"], made["parents"]
    assert kids.columns == [c["name"] for c in UNIFIED["entities"][0]["columns"]] and kids.count() == 3000
    profile = audit.duplicate_key_profile(kids, "id").first()
    assert 55 <= profile["surplus_rows"] <= 60
    orphans = audit.orphan_profile(kids, "parent_id", parents, "id").first()
    assert 100 < orphans["orphans"] < 210
    assert 210 < kids.filter("shipped IS NULL").count() < 390
    assert audit.version_profile(kids, "created_at", [{"from": "2024-02-01", "added_fields": ["channel"]}]
                                 ).first()["early"] == 0


def test_cycles_and_missing_parents_get_fresh_keys(spark):
    def entity(name, ref):
        return {"name": name, "volume": 20, "columns": [{"name": "id", "type": "integer", "primary_key": True},
                                                        {"name": "other", "type": "foreign_key", "ref": ref}]}
    made = Builder.of(spark, {"entities": [entity("a", "b.id"), entity("b", "a.id"), entity("c", "c.id"),
                                           entity("d", "nobody.id")]}).tables()
    for name in "cd":
        assert made[name].filter(F.length("other") != 36).isEmpty()
    assert made["a"].count() == made["b"].count() == 20


@pytest.fixture(scope="module")
def finished(spark):
    out = tempfile.mkdtemp(prefix="messlab-run-")
    runs.run(spark, UNIFIED, out)
    runs.run_increment(spark, UNIFIED, out, 40)
    runs.run_days(spark, UNIFIED, out, "2024-04-01", "2024-04-03", 30)
    return out


def test_runs_append_and_account(spark, finished):
    lines = {(r["run"], r["name"]): r for r in runs.summary(spark, finished).collect()}
    assert [lines[i, "kids"]["rows"] for i in range(3)] == [3000, 40, 90]
    assert [lines[i, "kids"]["total_rows"] for i in range(3)] == [3000, 3040, 3130]
    assert [lines[i, "ship"]["rows"] for i in range(3)] == [1400, 80, 90]
    assert [(lines[i, "courier"]["total_rows"], lines[i, "courier"]["pages"]) for i in range(3)] == [
        (250, 3), (290, 3), (380, 4)]
    assert [r["total_records"] for r in runs.totals(spark, finished).collect()] == [
        3000 + 300 + 1400 + 30 + 100 + 250, 40 + 40 + 80 + 120 + 80 + 40, 90 * 6]


def test_keys_stay_unique_over_runs(spark, finished):
    parents = spark.read.parquet(f"{finished}/tables/parents")
    assert parents.count() == 430 == parents.select("id").distinct().count()
    kids = spark.read.parquet(f"{finished}/tables/kids")
    assert audit.duplicate_key_profile(kids, "id").first()["surplus_rows"] <= 60 + 1 + 3


def test_increment_points_at_its_own_parents(spark, finished):
    kids = spark.read.parquet(f"{finished}/tables/kids")
    parents = spark.read.parquet(f"{finished}/tables/parents")
    assert audit.orphan_profile(kids, "parent_id", parents, "id").first()["rate"] < 0.08


def test_days_stay_in_their_window(spark, finished):
    kids = spark.read.parquet(f"{finished}/tables/kids").filter(
        "created_at >= TIMESTAMP_NTZ '2024-04-01 00:00:00' AND created_at < TIMESTAMP_NTZ '2050-01-01 00:00:00'")
    counts = {str(r["d"]): r["count"] for r in kids.groupBy(F.to_date("created_at").alias("d")).count().collect()}
    assert set(counts) == {"2024-04-01", "2024-04-02", "2024-04-03"} and all(27 <= n <= 30 for n in counts.values())


def test_files_have_one_directory_a_date(spark, finished):
    ship = spark.read.schema("tracking string, at timestamp_ntz, file_date date").csv(f"{finished}/files/out/ship")
    rows = ship.filter(F.length("tracking") == 36)
    counts = {str(r["file_date"]): r["count"] for r in rows.groupBy("file_date").count().collect()}
    assert counts == {"2024-01-01": 740, "2024-01-02": 740, "2024-04-01": 30, "2024-04-02": 30, "2024-04-03": 30}
    per_file = rows.filter("file_date = DATE '2024-01-01'")
    assert 65 <= 740 - per_file.select("tracking").distinct().count() <= 74


def test_dump_keeps_old_pages_and_its_faults(spark, finished):
    schema = Builder.of(spark, UNIFIED).api_records(normalise(UNIFIED)["apis"][0]).drop("__row").schema
    first, last = (pages.records(pages.read_pages(spark, f"{finished}/apis/courier/version={v}", schema)) for v in (0, 2))
    assert first.exceptAll(last).isEmpty() and last.count() == 380
    assert 5 <= last.filter("is_deleted").count() <= 40
    assert last.select("n").distinct().count() == 380


def test_finished_runs_are_not_overwritten(spark, finished):
    with pytest.raises(ValueError, match="finished"):
        runs.run(spark, UNIFIED, finished)


def test_a_failed_run_is_repeated(spark, monkeypatch):
    """The first run stops after its tables, the increment after its files; both are repeated."""
    out = tempfile.mkdtemp(prefix="messlab-repeat-")
    schema = "tracking string, at timestamp_ntz, file_date date"

    def stop(*_):
        raise RuntimeError("stopped")

    def attempt(step, *arguments):
        with monkeypatch.context() as patched:
            patched.setattr(runs, step, stop)
            with pytest.raises(RuntimeError):
                arguments[0](spark, UNIFIED, out, *arguments[1:])
    attempt("_write_file_source", runs.run)
    runs.run(spark, UNIFIED, out)
    attempt("_write_api", runs.run_increment, 40)
    attempt("_write_api", runs.run_increment, 40)
    runs.run_increment(spark, UNIFIED, out, 40)
    clean = tempfile.mkdtemp(prefix="messlab-clean-")
    runs.run(spark, UNIFIED, clean)
    runs.run_increment(spark, UNIFIED, clean, 40)
    for name in ("tables/kids", "tables/parents"):
        one, two = (spark.read.parquet(f"{d}/{name}") for d in (out, clean))
        assert one.count() == two.count() and one.exceptAll(two).isEmpty()
    one, two = (spark.read.schema(schema).csv(f"{d}/files/out/ship") for d in (out, clean))
    assert one.count() == two.count() and one.exceptAll(two).isEmpty()
    same = [r.drop("run_timestamp", "execution_seconds", "path") for r in (runs.summary(spark, out), runs.summary(spark, clean))]
    assert same[0].exceptAll(same[1]).isEmpty() and same[0].count() == same[1].count()


def test_registered_table_takes_a_repeated_run(spark):
    out = tempfile.mkdtemp(prefix="messlab-catalog-")
    spark.sql("CREATE DATABASE IF NOT EXISTS repeated")
    builder = Builder.of(spark, UNIFIED)
    for _ in range(2):
        runs.write_outputs(builder, out, 0, "repeated")
    assert spark.table("repeated.kids").count() == 3000
    runs.run(spark, UNIFIED, out, database="repeated")
    runs.run_increment(spark, UNIFIED, out, 40, database="repeated")
    assert spark.table("repeated.kids").count() == 3040
    spark.sql("DROP DATABASE repeated CASCADE")


def test_clean_tables_conform_and_faults_show(spark):
    spec = normalise(UNIFIED)
    kids = {**spec["tables"][0], "messiness": {}}
    clean = Builder.of(spark, {**UNIFIED, "entities": [
        {**e, "messiness": {}, "schema_versions": []} for e in UNIFIED["entities"][:2]]}).tables()
    window = ("2024-01-01", "2024-03-31")
    parents = {"parents": clean["parents"]}
    found = check(clean["kids"], kids, window=window, parents=parents)
    assert found.filter("violations > 0").isEmpty() and found.count() >= 12
    dirty = Builder.of(spark, UNIFIED).tables()["kids"].drop("status").withColumn("more", F.lit(1))
    bad = {(r["rule"], r["column"]) for r in check(dirty, kids, window=window, parents=parents).filter(
        "violations > 0").collect()}
    assert {("unique key", "id"), ("foreign key", "parent_id"), ("range", "amount"), ("window", "shipped"),
            ("window", "created_at"), ("missing column", "status"), ("extra column", "more")} <= bad


def test_fill_patterns_as_regular_expressions():
    assert fill_regex("WH-??-###.x") == r"^WH\-[A-Z][A-Z]\-[0-9][0-9][0-9]\.x$"


@pytest.mark.parametrize("raw, found", [
    ({"null_pct": 0.1, "null_rate": 0.2}, {"null_pct": 0.2}), ({"null_rate": 0.2, "null_pct": 0.1}, {"null_pct": 0.2}),
    ({"dup_pk_pct": 0.1, "duplicate_rate": 0.3, "duplicate_pct": 0.2}, {"dup_pk_pct": 0.3}),
    ({"duplicate_pct": 0.2, "dup_pk_pct": 0.1}, {"dup_pk_pct": 0.1})])
def test_first_name_of_a_rate_counts(raw, found):
    assert faults(raw) == found


def test_unified_layout_prefers_its_own_counts():
    spec = normalise({"entities": [
        {"name": "t", "source_type": "database", "volume": 5, "row_count": 7, "columns": {"id": "integer"}},
        {"name": "a", "source_type": "api", "approx_record_count": 5, "total_records": 7, "columns": {"id": "integer"}}]})
    assert spec["tables"][0]["row_count"] == 5 and spec["apis"][0]["total_records"] == 5
    plain = normalise({"temporal": {}, "global_messiness": {}, "database": {"entities": [
        {"name": "t", "volume": 5, "row_count": 7, "columns": []}]}, "api_dumps": [
        {"name": "a", "approx_record_count": 5, "total_records": 7, "columns": []}]})
    assert plain["tables"][0]["row_count"] == 7 and plain["apis"][0]["total_records"] == 7
