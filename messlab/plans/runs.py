"""Runs of a specification: write everything under one directory, append to it, summarise.

Layout: ``tables/<name>/run_no=<run>``, ``files/<dir>/run_no=<run>/file_date=...``,
``apis/<dir>/version=<run>`` and ``summary``, one JSON line per output and run.
A page dump is rewritten by an append, so every run writes a new version next to
the one it reads.

A run is committed by its summary lines, which come last.  All it writes lies in
directories of its own number, and it replaces what is there.  So a run that
failed is repeated under the same number and leaves the same rows as one that did not
fail.  Rows sent over JDBC are appended each time.
"""

from __future__ import annotations

import time
from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from messlab.operators import pages
from messlab.plans.build import ROW, Builder, primary_key
from messlab.plans.spec import Spec, rates
from messlab.sources import files, tables

RUN = "run_no"
SUMMARY = ("run int, run_timestamp string, schema_version string, kind string, name string, format string, "
           "path string, target_rows bigint, rows bigint, total_rows bigint, pages bigint, next_row bigint, "
           "execution_seconds double")


def run(spark: SparkSession, raw: Mapping, out: str, *, seed: int = 42, database: str | None = None,
        jdbc: Mapping[str, str] | None = None) -> DataFrame:
    """First run: all tables, files and page dumps.  Returns the summary of this run.

    ``database`` registers the tables in the catalog; ``jdbc`` (url, user, ...)
    also appends them to an external database.  A directory that holds a finished run is refused.
    """
    if _finished(spark, out) is not None:
        raise ValueError(f"{out} holds finished runs; append with run_increment or run_days")
    return _write(Builder.of(spark, raw, seed=seed), out, 0, database, jdbc)


def run_increment(spark: SparkSession, raw: Mapping, out: str, rows: int, *, seed: int = 42,
                  database: str | None = None, jdbc: Mapping[str, str] | None = None) -> DataFrame:
    """Append ``rows`` rows to every output; foreign keys see this batch's parents only."""
    number, offset = _progress(spark, out)
    return _write(Builder.of(spark, raw, seed=seed, rows=rows, offset=offset), out, number, database, jdbc)


def run_days(spark: SparkSession, raw: Mapping, out: str, start: str, end: str, rows_per_day: int, *,
             seed: int = 42, database: str | None = None, jdbc: Mapping[str, str] | None = None) -> DataFrame:
    """Append ``rows_per_day`` rows per output for each day of [start, end], all days in one job."""
    number, offset = _progress(spark, out)
    builder = Builder.of(spark, raw, seed=seed, rows=max(rows_per_day, 1), days=(start, end), offset=offset)
    return _write(builder, out, number, database, jdbc)


def summary(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(SUMMARY).json(f"{out}/summary")


def totals(spark: SparkSession, out: str) -> DataFrame:
    """Per run: outputs, rows appended and seconds."""
    return (summary(spark, out).groupBy("run", "run_timestamp", "schema_version")
            .agg(F.count("*").alias("outputs"), F.sum("rows").alias("total_records"),
                 F.max("execution_seconds").alias("execution_seconds")).orderBy("run"))


def _finished(spark: SparkSession, out: str) -> tuple[int, int] | None:
    """Number of the last finished run and the first row number no finished run has used."""
    try:
        row = summary(spark, out).agg(F.max("run").alias("run"), F.max("next_row").alias("next")).first()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return None if row["run"] is None else (row["run"], row["next"])


def _progress(spark: SparkSession, out: str) -> tuple[int, int]:
    """Number and first row of the next run."""
    last = _finished(spark, out)
    if last is None:
        raise ValueError(f"no earlier run under {out}")
    return last[0] + 1, last[1]


def _write(builder: Builder, out: str, number: int, database: str | None,
           jdbc: Mapping[str, str] | None) -> DataFrame:
    started = time.time()
    lines = write_outputs(builder, out, number, database, jdbc)
    seconds = round(time.time() - started, 2)
    stamp = datetime.now(timezone.utc).isoformat()
    fields = [f.split()[0] for f in SUMMARY.split(", ")]
    rows = [tuple({"run": number, "run_timestamp": stamp, "schema_version": builder.spec["version"],
                   "execution_seconds": seconds, **line}.get(f) for f in fields) for line in lines]
    done = builder.spark.createDataFrame(rows, SUMMARY)
    done.coalesce(1).write.mode("append").json(f"{out}/summary")
    return done


def write_outputs(builder: Builder, out: str, number: int, database: str | None = None,
                  jdbc: Mapping[str, str] | None = None) -> list[Spec]:
    """All outputs of a run, not yet committed; returns the lines of its summary."""
    spec = builder.spec
    for entity in [*spec["tables"], *spec["files"]]:
        if any(c["name"].lower() == RUN for c in entity["columns"]):
            raise ValueError(f"{entity['name']}: {RUN} is the column of the run's number")
    lines = []
    for entity in _parents_first(spec["tables"]):
        lines.append(_write_table(builder, entity, out, number, database, jdbc))
    for source in spec["files"]:
        lines.append(_write_file_source(builder, source, out, number))
    for api in spec["apis"]:
        lines.append(_write_api(builder, api, out, number))
    return lines


def _parents_first(entities: list[Spec]) -> list[Spec]:
    """Parents before children, so that a child reads its parent's written keys."""
    names, done, order = {e["name"]: e for e in entities}, set(), []

    def visit(entity: Spec) -> None:
        if entity["name"] in done:
            return
        done.add(entity["name"])
        for spec in entity["columns"]:
            if spec["type"] == "foreign_key" and str(spec["ref"]).split(".")[0] in names:
                visit(names[str(spec["ref"]).split(".")[0]])
        order.append(entity)

    for entity in entities:
        visit(entity)
    return order


def _write_table(builder: Builder, entity: Spec, out: str, number: int, database: str | None,
                 jdbc: Mapping[str, str] | None) -> Spec:
    name, path = entity["name"], f"{out}/tables/{entity['name']}"
    first = builder.offset == 0 and not builder.days
    seen = Observation(f"rows of {name}")
    frame = builder.table(entity).observe(seen, F.count(F.lit(1)).alias("rows"))
    frame.write.mode("overwrite").parquet(f"{path}/{RUN}={number}")
    if database:
        tables.register(builder.spark, f"{database}.{name}", path)
    if jdbc:
        properties = {k: v for k, v in jdbc.items() if k != "url"}
        tables.save_jdbc(builder.table(entity), jdbc["url"], name, properties=properties)
    if first and primary_key(entity):
        builder.parents[name] = builder.spark.read.parquet(f"{path}/{RUN}={number}")
    stored = builder.spark.read.parquet(path).where(F.col(RUN) <= number)
    return {"kind": "table", "name": name, "format": "parquet", "path": path,
            "target_rows": builder.volume(entity["row_count"]), "rows": seen.get["rows"],
            "total_rows": stored.count(), "next_row": builder.offset + builder.volume(entity["row_count"])}


def _write_file_source(builder: Builder, source: Spec, out: str, number: int) -> Spec:
    root, kind = f"{out}/files/{source['output_dir']}", source["output_format"]
    path = f"{root}/{RUN}={number}"
    names = [c["name"] for c in source["columns"]]
    settings = rates(builder.spec, source)
    rows = builder.file_source(source)
    # Rows are generated file by file, so each task already holds few files.
    scope = {"seed": builder.seed, "scope": source["name"], "clustered": True, "fresh": True}
    per_file = builder.rows or source["rows_per_file"]
    body = rows.select(files.FILE_KEY, *names)
    if kind == "csv":
        files.write_csv(body, path, missing_header_pct=settings.get("missing_header_pct", 0.0),
                        order_drift=settings.get("column_order_drift", False),
                        mixed_dates=settings.get("mixed_date_formats", False), **scope)
    elif kind == "json":
        files.write_json(rows, path, key=ROW, columns=names,
                         nested=settings.get("nested_structure_depth_variation", False),
                         missing=settings.get("null_vs_missing_keys", False), **scope)
    elif kind == "excel":
        placed = rows.withColumn("position", F.expr(f"(`{ROW}` - {builder.offset}L) % {per_file}L"))
        files.write_sheets(placed.select(*names, files.FILE_KEY, "position"), path, rows_per_file=per_file,
                           summary=settings.get("summary_rows", False),
                           split=settings.get("multi_sheet_split", False), sheet=source["sheet_name"], fresh=True)
    else:
        keep = [c["name"] for c in source["columns"] if c.get("primary_key")]
        files.write_parquet(body, path, keep=keep, schema_evolution=settings.get("schema_evolution", False),
                            **scope)
    made = builder.file_rows(source)
    return {"kind": "file", "name": source["name"], "format": kind, "path": root, "target_rows": made, "rows": made,
            "next_row": builder.offset + made}


def _write_api(builder: Builder, api: Spec, out: str, number: int) -> Spec:
    root = f"{out}/apis/{api['output_dir']}"
    records = builder.api_records(api)
    names = [c for c in records.columns if c != ROW]
    indexed = records.withColumn("ix", F.col(ROW) - builder.offset)
    size, made = api["page_size"], builder.volume(api["total_records"])
    path = f"{root}/version={number}"
    schema = records.select(*names).schema
    if number == 0:
        counted = indexed.withColumn("total_records", F.lit(made).cast("long"))
        dump = (pages.envelopes(pages.with_pages(counted, size), api["name"], size, names)
                if made else pages.empty_page(records, api["name"], size, names))
    else:
        old = pages.read_pages(builder.spark, f"{root}/version={number - 1}", schema)
        dump = pages.append_pages(old, indexed)
    # A version belongs to one run, so a repeated run replaces what a failed one left.
    pages.write_pages(dump, path, mode="overwrite")
    written = pages.read_pages(builder.spark, path, schema)
    found = files.page_manifest(written, api["name"]).first()
    return {"kind": "api", "name": api["name"], "format": "json", "path": path, "target_rows": made, "rows": made,
            "total_rows": found["records"], "pages": found["pages"], "next_row": builder.offset + made}
