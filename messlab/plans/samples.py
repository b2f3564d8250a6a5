"""Column lists and specifications the catalogue runs on the test tables."""

from __future__ import annotations

WINDOW = ("2023-01-01", "2024-01-01")

KEY_COLUMNS = [
    {"name": "id", "type": "uuid", "primary_key": True},
    {"name": "number", "type": "integer", "primary_key": True, "min": 1, "max": 2_000_000},
    {"name": "pooled_id", "type": "uuid"},
    {"name": "parent_id", "type": "foreign_key", "ref": "nowhere.id"},
]
TEXT_COLUMNS = [{"name": f"c_{kind}", "type": kind} for kind in (
    "name", "company", "email", "phone", "address", "job_title", "state", "ipv4", "country", "city", "text",
    "product_name")]
PATTERN_COLUMNS = [
    {"name": "plain_text", "type": "string"},
    {"name": "bin_code", "type": "string", "pattern": "WH-??-###"},
    {"name": "tracking", "type": "string", "pattern": "1Z************"},
]
SCALAR_COLUMNS = [
    {"name": "flag", "type": "boolean"},
    {"name": "status", "type": "choice", "choices": ["new", "paid", "sent", "it's back"]},
    {"name": "level", "type": "choice", "choices": [10, 20, 30]},
    {"name": "no_choice", "type": "choice"},
    {"name": "count", "type": "integer"},
    {"name": "score", "type": "integer", "min": -50, "max": 50},
    {"name": "amount", "type": "float"},
    {"name": "ratio", "type": "float", "min": -1.0, "max": 1.0, "precision": 4},
    {"name": "strange", "type": "no such type"},
]
TIME_COLUMNS = [{"name": "at", "type": "timestamp"}, {"name": "on_day", "type": "date"}]
GROWTH_COLUMNS = [{"name": "at", "type": "timestamp", "pattern": "temporal_growth"}]
DATE_TEXT_COLUMNS = [
    {"name": "iso", "type": "date_str"},
    {"name": "european", "type": "date_str", "format": "%d/%m/%Y at %H:%M"},
    {"name": "long_form", "type": "date_str", "format": "%A %d %B %Y, %I:%M %p"},
    {"name": "compact", "type": "date_str", "format": "%y%j-%H%M%S"},
]
VERSIONS = [{"from": "1997-01-01", "added_fields": ["o_orderpriority"]},
            {"from": "1999-06-01", "added_fields": ["o_orderstatus", "not_there"]}]
ORDER_SPEC = [
    {"name": "o_orderkey", "type": "integer", "primary_key": True},
    {"name": "o_custkey", "type": "integer", "nullable": True},
    {"name": "o_orderstatus", "type": "string"},
    {"name": "o_totalprice", "type": "float", "nullable": True},
    {"name": "o_orderdate", "type": "timestamp", "temporal": True, "nullable": True},
    {"name": "o_orderpriority", "type": "string"},
]
ORDER_RATES = {"null_pct": 0.1, "dup_pk_pct": 0.03, "negative_numeric_pct": 0.04, "impossible_date_pct": 0.05}
CHECK_SPEC = {
    "name": "orders", "row_count": 10_000, "schema_versions": VERSIONS, "columns": [
        {"name": "o_orderkey", "type": "integer", "primary_key": True},
        {"name": "o_custkey", "type": "foreign_key", "ref": "customer.c_custkey"},
        {"name": "o_orderstatus", "type": "choice", "choices": ["F", "O"]},
        {"name": "o_totalprice", "type": "float", "min": 1000, "max": 400_000, "nullable": True},
        {"name": "o_orderdate", "type": "timestamp", "temporal": True},
        {"name": "o_orderpriority", "type": "string", "pattern": "#-??????"},
        {"name": "o_clerk", "type": "name"}]}
RECORD_TYPES = {"event_id": "number", "event_type": "string", "user_id": "string", "cents": "number",
                "props": "string", "details": "object", "absent": "string"}

CHILD_FAULTS = {"dup_pk_pct": 0.02, "orphaned_fk_pct": 0.05, "negative_numeric_pct": 0.02, "null_pct": 0.1}


def parent_child(parents: int, children: int) -> dict:
    return {
        "temporal": {"start_date": "2024-01-01", "end_date": "2024-12-31"},
        "global_messiness": {"null_pct": 0.0},
        "database": {"entities": [
            {"name": "parents", "row_count": parents, "columns": [
                {"name": "id", "type": "integer", "primary_key": True, "min": 1, "max": 4_000_000_000}]},
            {"name": "children", "row_count": children, "messiness": CHILD_FAULTS,
             "schema_versions": [{"from": "2024-07-01", "added_fields": ["channel"]}], "columns": [
                 {"name": "id", "type": "integer", "primary_key": True, "min": 0, "max": 3_999_999_999},
                 {"name": "parent_id", "type": "foreign_key", "ref": "parents.id"},
                 {"name": "amount", "type": "float", "min": 0, "max": 500},
                 {"name": "status", "type": "choice", "choices": ["a", "b", "c", "d"]},
                 {"name": "shipped", "type": "date", "nullable": True},
                 {"name": "channel", "type": "choice", "choices": ["web", "shop"]},
                 {"name": "created_at", "type": "timestamp", "temporal": True}]}]},
    }


def shipments(files: int, rows_per_file: int, records: int) -> dict:
    return {
        "temporal": {"start_date": "2024-01-01", "end_date": "2024-12-31"},
        "global_messiness": {"null_pct": 0.1}, "database": {"entities": []},
        "file_sources": [{
            "name": "ship", "output_format": "csv", "num_files": files, "rows_per_file": rows_per_file,
            "frequency": "weekly", "messiness": {"dup_pk_pct": 0.02}, "columns": [
                {"name": "tracking", "type": "integer", "primary_key": True, "min": 0, "max": 3_999_999_999},
                {"name": "at", "type": "timestamp"},
                {"name": "quantity", "type": "integer", "min": 1, "max": 9, "nullable": True},
                {"name": "mode", "type": "choice", "choices": ["air", "road", "sea"]}]}],
        "api_dumps": [{
            "name": "courier", "total_records": records, "page_size": 100,
            "messiness": {"soft_delete_pct": 0.05, "stale_watermark_pct": 0.05, "negative_numeric_pct": 0.02},
            "columns": [{"name": "code", "type": "string", "pattern": "1Z****"},
                        {"name": "weight", "type": "integer"}, {"name": "at", "type": "timestamp"}]}],
    }
