"""File-shape faults: column order, header, date formats, dropped columns, totals, sheets, JSON shape.

Whatever varies per file is a draw on the file's key, so all rows of a file
agree without being brought together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from messlab.functions.columns import literal
from messlab.functions.formats import text_sql
from messlab.functions.rng import Dice, quote, roll, unroll
from messlab.operators.index import columns_of, first_rows, refs

# Share of files or records hit, and the competing date formats.
ORDER_DRIFT = 0.3
MIXED_DATES = 0.5
SCHEMA_EVOLUTION = 0.2
NESTED = 0.2
MISSING_KEYS = 0.3
DATE_FORMATS = ["%d/%m/%Y", "%m-%d-%Y", "%Y%m%d"]

JSON_TIMES = {"timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
              "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}
KEEP_NULLS = {**JSON_TIMES, "ignoreNullFields": "false"}


def per_file(df: DataFrame, file_key: str, seed: int, scope: str) -> tuple[DataFrame, Dice]:
    return roll(df, file_key, seed, f"{scope}|file")


def header_missing(df: DataFrame, file_key: str, pct: float, *, name: str = "headerless", seed: int = 42,
                   scope: str = "") -> DataFrame:
    rolled, dice = per_file(df, file_key, seed, scope)
    return unroll(rolled.withColumn(name, F.expr(dice.chance(pct, "header"))), dice)


def time_text(time: Column) -> Column:
    """A time as text with the digits of its seconds that are not zero; zone-free times pass no zone."""
    return time.cast("timestamp_ntz").cast("string")


def csv_refs(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """The columns, times as text, so that a CSV writer cuts no fraction of a second."""
    times = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))}
    return [time_text(ref).alias(c) if c in times else ref for c, ref in zip(columns, refs(columns))]


def column_orders(columns: Sequence[str], count: int = 4, seed: int = 42) -> list[list[str]]:
    """The given order, then ``count`` shuffled ones; the shuffle depends on seed and names only."""
    def rank(i: int):
        return lambda name: hashlib.md5(f"{seed}|order|{i}|{name}".encode()).hexdigest()
    return [list(columns), *[sorted(columns, key=rank(i)) for i in range(count)]]


def order_variant(df: DataFrame, file_key: str, variants: int, *, pct: float = ORDER_DRIFT,
                  name: str = "order_variant", seed: int = 42, scope: str = "") -> DataFrame:
    """0 for files in the given order, else the number of the shuffled order they use."""
    rolled, dice = per_file(df, file_key, seed, scope)
    drawn = f"CASE WHEN {dice.chance(pct, 'order')} THEN 1 + {dice.pick(variants, 'which order')} ELSE 0 END"
    return unroll(rolled.withColumn(name, F.expr(drawn).cast("int")), dice)


def csv_lines(df: DataFrame, file_key: str, columns: Sequence[str], *, pct: float = ORDER_DRIFT,
              seed: int = 42, scope: str = "", name: str = "line") -> DataFrame:
    """Each row as a CSV line in the column order of its file, next to ``order_variant``."""
    orders = column_orders(columns, seed=seed)
    staged = order_variant(df, file_key, len(orders) - 1, pct=pct, seed=seed, scope=scope)
    line = F.to_csv(F.struct(*csv_refs(df, orders[0])))
    for i, order in enumerate(orders[1:], 1):
        line = F.when(F.col("order_variant") == i, F.to_csv(F.struct(*csv_refs(df, order)))).otherwise(line)
    return staged.withColumn(name, line)


def mixed_dates(df: DataFrame, file_key: str, columns: Sequence[str], *, pct: float = MIXED_DATES,
                seed: int = 42, scope: str = "") -> DataFrame:
    """In some files one of the time columns is written in another format; all become text."""
    columns = columns_of(columns)
    if not columns:
        return df
    rolled, dice = per_file(df, file_key, seed, scope)
    which = f"CASE WHEN {dice.chance(pct, 'mixed dates')} THEN {dice.pick(len(columns), 'which date')} END"
    staged = rolled.withColumns({"__which": F.expr(which),
                                 "__format": F.expr(dice.pick(len(DATE_FORMATS), "date format"))})
    changes = {}
    for i, c in enumerate(columns):
        value = time_text(F.col(quote(c)))
        for j, fmt in enumerate(DATE_FORMATS):
            hit = (F.col("__which") == i) & (F.col("__format") == j)
            is_date = isinstance(df.schema[c].dataType, T.DateType)
            value = F.when(hit, F.expr(text_sql(quote(c), fmt, is_date=is_date))).otherwise(value)
        changes[c] = value
    return unroll(staged.withColumns(changes).drop("__which", "__format"), dice)


def dropped_column(df: DataFrame, file_key: str, candidates: Sequence[str], *,
                   pct: float = SCHEMA_EVOLUTION, name: str = "dropped", seed: int = 42,
                   scope: str = "") -> DataFrame:
    """Name of the column that the row's file lacks, or null."""
    if not candidates:
        return df.withColumn(name, F.lit(None).cast("string"))
    rolled, dice = per_file(df, file_key, seed, scope)
    options = ", ".join(literal(c) for c in candidates)
    pick = dice.pick(len(candidates), "which column")
    drawn = (f"CASE WHEN {dice.chance(pct, 'schema evolution')} "
             f"THEN element_at(array({options}), CAST(1 + {pick} AS INT)) END")
    return unroll(rolled.withColumn(name, F.expr(drawn)), dice)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def with_total_type(df: DataFrame) -> DataFrame:
    """The first column as text when a total row will put a word into it."""
    first = df.columns[0]
    return df.withColumn(first, F.col(quote(first)).cast("string")) if numeric_columns(df) else df


def total_rows(df: DataFrame, by: Sequence[str] | str = ()) -> DataFrame:
    """One closing row per non-empty group: "Total" first, sums of numbers, nulls elsewhere.

    Without a numeric column the row is blank.
    """
    by = columns_of(by)
    body = [c for c in df.columns if c not in by]
    numbers = [c for c in numeric_columns(df) if c not in by]
    sums = df.groupBy(*refs(by)).agg(F.count("*").alias("__n"), *[
        F.sum(F.col(quote(c))).alias(c) for c in numbers if c != body[0]])

    def cell(c: str) -> Column:
        if c in by:
            return F.col(quote(c))
        if numbers and c == body[0]:
            return F.lit("Total").alias(c)
        return F.col(quote(c)) if c in numbers else F.lit(None).cast(df.schema[c].dataType).alias(c)

    return sums.filter("__n > 0").select(*[cell(c) for c in df.columns])


def summary_row(df: DataFrame, by: Sequence[str] | str = ()) -> DataFrame:
    """The table followed by its total row, one per group of ``by``."""
    return with_total_type(df).unionByName(total_rows(df, by))


def sheet_split(df: DataFrame, order_by: Sequence[str] | str, *, sheet: str = "Sheet1",
                name: str = "sheet") -> DataFrame:
    """First half of the rows to ``{sheet}_1``, the rest to ``{sheet}_2``, if there are more than two."""
    n = df.count()
    if n <= 2:
        return df.withColumn(name, F.lit(sheet))
    first = first_rows(df, order_by, n // 2, n)
    return df.withColumn(name, F.when(first, F.lit(f"{sheet}_1")).otherwise(F.lit(f"{sheet}_2")))


def json_records(df: DataFrame, key: Sequence[str] | str, columns: Sequence[str], *,
                 nested: float = NESTED, missing: float = MISSING_KEYS, name: str = "record", seed: int = 42,
                 scope: str = "") -> DataFrame:
    """Each row as JSON text: some records nest their last two keys, some lack their null keys.

    Null keys are removed at the top level only; the nested object is rendered
    on its own and spliced in, because the writer's option would empty it too.
    """
    columns = list(columns)
    rolled, dice = roll(df, key, seed, scope)
    drop = F.expr(dice.chance(missing, "missing keys"))

    def render(names: Sequence[str]) -> Column:
        record = F.struct(*refs(names))
        return F.when(drop, F.to_json(record, JSON_TIMES)).otherwise(F.to_json(record, KEEP_NULLS))

    text = render(columns)
    if len(columns) >= 3 and nested > 0:
        top = render(columns[:-2])
        details = F.to_json(F.struct(*refs(columns[-2:])), KEEP_NULLS)
        opened = F.when(top == "{}", F.lit("{")).otherwise(
            F.concat(F.regexp_replace(top, r"\}$", ""), F.lit(",")))
        spliced = F.concat(opened, F.lit('"details":'), details, F.lit("}"))
        text = F.when(F.expr(dice.chance(nested, "nested")), spliced).otherwise(text)
    return unroll(rolled.withColumn(name, text), dice)
