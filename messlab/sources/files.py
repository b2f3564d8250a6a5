"""File sources: one directory per file date, with faults that differ from file to file.

A "file" of the specification is one ``file_date=...`` directory, so a large
one is written by many tasks.  Spark writes one schema and one header mode per
call.  Where files differ in either, the rows are computed once and staged by
variant; each variant's append reads its own part only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, DataFrameWriter, Row, SparkSession, functions as F, types as T

from messlab.operators import shape
from messlab.sources.workspace import scratch

FILE_KEY = "file_date"
#: Options that read the times of written CSV files, with or without a fraction of a second.
TIMES = dict.fromkeys(("timestampNTZFormat", "timestampFormat"), "yyyy-MM-dd HH:mm:ss[.SSSSSS]")
# What a frequency advances the date by.
STEP_DAYS = {"daily": 1, "weekly": 7}


def file_dates(df: DataFrame, row: str, rows_per_file: int, start: str, *, frequency: str = "daily",
               end: str | None = None) -> DataFrame:
    """Add file_no, file_date and the file's window [file_start, file_end] in epoch seconds."""
    first = F.lit(start).cast("date")
    numbered = df.withColumn("file_no", F.expr(f"`{row}` div {rows_per_file}L"))
    if frequency == "monthly":
        day = F.add_months(first, F.col("file_no").cast("int"))
    else:
        day = F.date_add(first, (F.col("file_no") * STEP_DAYS.get(frequency, 1)).cast("int"))
    last = F.col("file_start") + 86_400
    if end is not None:
        last = F.least(last, F.unix_date(F.lit(end).cast("date")).cast("long") * 86_400)
    return (numbered.withColumn(FILE_KEY, day)
            .withColumn("file_start", F.unix_date(FILE_KEY).cast("long") * 86_400)
            .withColumn("file_end", last))


def file_name(pattern: str) -> str:
    """SQL text of the file name for a pattern with ``{date}`` and ``{week}``."""
    text = pattern.replace("\\", "\\\\").replace("'", "\\'")
    return (f"replace(replace('{text}', '{{date}}', CAST(file_date AS STRING)), "
            f"'{{week}}', CAST(file_no + 1 AS STRING))")


def gathered(df: DataFrame, file_key: str, clustered: bool) -> DataFrame:
    """Rows of a file brought together unless they already are.

    Rebalancing lets adaptive execution merge small files and split a large
    one, so a date with a third of the rows is still written by many tasks.
    """
    return df if clustered else df.hint("rebalance", file_key)


def staged(marked: DataFrame, keys: Sequence[str]) -> Iterator[tuple[Row, DataFrame]]:
    """The rows by their values of ``keys``, few combinations, without these columns.

    ``marked`` is computed once and written by combination; each part is then read alone.
    """
    spark, path = marked.sparkSession, scratch(marked.sparkSession, "variants")
    marked.write.partitionBy(*keys).parquet(path)
    rows = spark.read.schema(marked.schema).parquet(path)
    for variant in rows.select(*keys).distinct().orderBy(*keys).collect():
        same = [F.col(k).eqNullSafe(F.lit(variant[k])) for k in keys]
        yield variant, rows.filter(reduce(and_, same)).drop(*keys)


def sink(df: DataFrame, fresh: bool) -> DataFrameWriter:
    """A writer that appends, or one that first empties the directory."""
    return df.write.mode("overwrite").option("partitionOverwriteMode", "static") if fresh else df.write.mode("append")


def write_csv(df: DataFrame, path: str, *, file_key: str = FILE_KEY, missing_header_pct: float = 0.0,
              order_drift: bool = False, mixed_dates: bool = False, clustered: bool = False, seed: int = 42,
              scope: str = "", fresh: bool = False) -> None:
    """Append CSV files; headers, column orders and date formats vary per file as asked.  ``fresh`` replaces ``path``."""
    columns = [c for c in df.columns if c != file_key]
    if mixed_dates:
        times = [f.name for f in df.schema.fields
                 if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]
        df = shape.mixed_dates(df, file_key, times, seed=seed, scope=scope)
    orders = shape.column_orders(columns, seed=seed) if order_drift else [columns]
    marked = shape.header_missing(df, file_key, missing_header_pct, seed=seed, scope=scope)
    marked = shape.order_variant(marked, file_key, max(len(orders) - 1, 1),
                                 pct=shape.ORDER_DRIFT if order_drift else 0.0, seed=seed, scope=scope)
    # At most two header modes times five column orders; a single one needs no staging.
    one = [(Row(headerless=False, order_variant=0), df)]
    several = missing_header_pct > 0 or order_drift
    for variant, part in staged(marked, ["headerless", "order_variant"]) if several else one:
        chosen = part.select(file_key, *shape.csv_refs(part, orders[variant["order_variant"]]))
        (sink(gathered(chosen, file_key, clustered), fresh).partitionBy(file_key)
         .options(header=not variant["headerless"]).csv(path))
        fresh = False


def write_parquet(df: DataFrame, path: str, *, file_key: str = FILE_KEY, keep: Sequence[str] = (),
                  schema_evolution: bool = False, clustered: bool = False, seed: int = 42,
                  scope: str = "", fresh: bool = False) -> None:
    """Append Parquet files; with evolution some files lack one column not in ``keep``."""
    if not schema_evolution:
        sink(gathered(df, file_key, clustered), fresh).partitionBy(file_key).parquet(path)
        return
    candidates = [c for c in df.columns if c != file_key and c not in keep]
    marked = shape.dropped_column(df, file_key, candidates, seed=seed, scope=scope)
    for variant, part in staged(marked, ["dropped"]):
        kept = part.drop(variant["dropped"]) if variant["dropped"] else part
        sink(gathered(kept, file_key, clustered), fresh).partitionBy(file_key).parquet(path)
        fresh = False


def read_evolved(spark: SparkSession, path: str) -> DataFrame:
    """Files of several schema versions as one table; absent columns are null."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def write_json(df: DataFrame, path: str, *, file_key: str = FILE_KEY, key: Sequence[str] | str | None = None,
               columns: Sequence[str] | None = None, nested: bool = False, missing: bool = False,
               clustered: bool = False, seed: int = 42, scope: str = "",
               fresh: bool = False) -> None:
    """Append JSON Lines; nesting and missing keys vary per record as asked."""
    columns = list(columns or [c for c in df.columns if c != file_key])
    lines = shape.json_records(df, key or columns[0], columns, nested=shape.NESTED if nested else 0.0,
                               missing=shape.MISSING_KEYS if missing else 0.0, name="value", seed=seed,
                               scope=scope)
    sink(gathered(lines.select(file_key, "value"), file_key, clustered), fresh).partitionBy(file_key).text(path)


def write_sheets(df: DataFrame, path: str, *, rows_per_file: int, position: str = "position",
                 file_key: str = FILE_KEY, summary: bool = False, split: bool = False,
                 sheet: str = "Sheet1", fresh: bool = False) -> None:
    """Append the tables of one workbook per file, as Parquet under file_date=/sheet=.

    The column ``position`` is the row's place in its file.  The total row
    counts as the file's last line, so it takes part in the split.
    """
    lines = rows_per_file + (1 if summary else 0)
    halves = split and lines > 2
    first = F.col(position) < lines // 2
    name = F.when(first, f"{sheet}_1").otherwise(f"{sheet}_2") if halves else F.lit(sheet)
    body = df.withColumn("sheet", name).drop(position)
    if summary:
        closing = shape.total_rows(df.drop(position), by=file_key).withColumn(
            "sheet", F.lit(f"{sheet}_2" if halves else sheet))
        body = shape.with_total_type(body).unionByName(closing)
    sink(body, fresh).partitionBy(file_key, "sheet").parquet(path)


def file_manifest(files: DataFrame, entity: str, fmt: str) -> DataFrame:
    """entity, format, path, rows and size_kb of every file that a file scan ``files`` reads."""
    return (files.groupBy(F.col("_metadata.file_path").alias("path"))
            .agg(F.count("*").alias("rows"), F.max("_metadata.file_size").alias("bytes"))
            .select(F.lit(entity).alias("entity"), F.lit(fmt).alias("format"), "path", "rows",
                    (F.floor(F.col("bytes") / 1024 * 10) / 10).alias("size_kb")))


def page_manifest(pages: DataFrame, api: str) -> DataFrame:
    """name, pages, records and size_kb of a written page dump."""
    return (pages.groupBy(F.col("_metadata.file_path").alias("path"))
            .agg(F.count("*").alias("pages"), F.sum(F.size("data")).alias("records"),
                 F.max("_metadata.file_size").alias("bytes"))
            .agg(F.sum("pages").alias("pages"), F.sum("records").alias("records"),
                 (F.floor(F.sum("bytes") / 1024 * 10) / 10).alias("size_kb"))
            .select(F.lit(api).alias("name"), "pages", "records", "size_kb"))
