"""Audits: one-pass aggregates that measure on a table what the faults put into it.

Per-column audits aggregate all columns in a single pass and return one row per
column.  Key audits aggregate per key before they join or compare, so a key
that holds a third of the rows is folded on the map side.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from messlab.functions.rng import quote
from messlab.operators.mess import FAR_FUTURE, FAR_PAST, as_timestamp
from messlab.operators.shape import numeric_columns
from messlab.operators.skew import lookup

ISO_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def profile(df: DataFrame, metrics: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    """(column, rows, metric...) from conditions counted per column in one pass."""
    names = list(next(iter(metrics.values())))
    counted = df.agg(F.count("*").alias("rows"), *[
        F.count_if(F.coalesce(condition, F.lit(False))).alias(f"{i}_{name}")
        for i, conditions in enumerate(metrics.values()) for name, condition in conditions.items()])
    lines = [F.struct(F.lit(column).alias("column"), *[F.col(f"{i}_{n}").alias(n) for n in names])
             for i, column in enumerate(metrics)]
    return counted.select("rows", F.explode(F.array(*lines)).alias("line")).select(
        "line.column", "rows", *[f"line.{n}" for n in names])


def rate(part: str, name: str = "rate", whole: str = "rows") -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0).alias(name)


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    found = profile(df, {c: {"nulls": F.col(quote(c)).isNull()} for c in columns or df.columns})
    return found.select("*", rate("nulls"))


def negative_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    found = profile(df, {c: {"negatives": F.col(quote(c)) < 0} for c in columns or numeric_columns(df)})
    return found.select("*", rate("negatives"))


def date_profile(df: DataFrame, columns: Sequence[str], start: str, end: str) -> DataFrame:
    """Sentinel dates and dates outside the window [start, end], both ends included."""
    def of(c: str) -> dict[str, Column]:
        stamp = as_timestamp(df, c)
        low, high = (F.lit(v).cast("timestamp_ntz") for v in (start, end))
        return {"far_future": stamp == F.lit(FAR_FUTURE).cast("timestamp_ntz"),
                "far_past": stamp == F.lit(FAR_PAST).cast("timestamp_ntz"),
                "outside": (stamp < low) | (stamp > high)}
    return profile(df, {c: of(c) for c in columns})


def date_text_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text that does not have the form YYYY-MM-DD."""
    return profile(df, {c: {"malformed": ~F.col(quote(c)).rlike(ISO_DATE)} for c in columns})


def range_profile(df: DataFrame, ranges: Mapping[str, tuple]) -> DataFrame:
    return profile(df, {c: {"below": F.col(quote(c)) < F.lit(low), "above": F.col(quote(c)) > F.lit(high)}
                        for c, (low, high) in ranges.items()})


def choice_profile(df: DataFrame, choices: Mapping[str, Sequence]) -> DataFrame:
    return profile(df, {c: {"unlisted": ~F.col(quote(c)).isin(list(options))}
                        for c, options in choices.items()})


def duplicate_keys(df: DataFrame, pk: str) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(F.col(quote(pk)).alias("key")).agg(F.count("*").alias("rows")).filter(
        (F.col("rows") > 1) & F.col("key").isNotNull())


def duplicate_key_profile(df: DataFrame, pk: str) -> DataFrame:
    """rows, null_keys, distinct_keys, repeated_keys, surplus_rows (beyond one a key) and their rate."""
    keys = df.groupBy(F.col(quote(pk)).alias("key")).agg(F.count("*").alias("n"))
    real = F.col("key").isNotNull()
    found = keys.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0)).alias("null_keys"),
        F.count("key").alias("distinct_keys"),
        F.count_if(real & (F.col("n") > 1)).alias("repeated_keys"),
        F.coalesce(F.sum(F.when(real, F.col("n") - 1)), F.lit(0)).alias("surplus_rows"))
    return found.select("*", rate("surplus_rows"))


def _known(parent: DataFrame, pk: str) -> DataFrame:
    return parent.select(F.col(quote(pk)).cast("string").alias("__pk")).na.drop().distinct()


def orphan_rows(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Child rows whose non-null key has no parent."""
    used = child.withColumn("__fk", F.col(quote(fk)).cast("string")).filter("__fk IS NOT NULL")
    return lookup(used, "__fk", _known(parent, pk), "__pk", "left_anti").drop("__fk")


def mark_orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str, name: str = "orphan") -> DataFrame:
    """Child rows with a flag for a non-null key that has no parent."""
    used = child.withColumn("__fk", F.col(quote(fk)).cast("string"))
    marked = lookup(used, "__fk", _known(parent, pk), "__pk", "left")
    return marked.withColumn(name, F.col("__fk").isNotNull() & F.col("__pk").isNull()).drop("__fk", "__pk")


def orphan_profile(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """rows, null_keys, orphans and rate; child rows are folded per key before the join."""
    used = child.groupBy(F.col(quote(fk)).cast("string").alias("fk")).agg(F.count("*").alias("n"))
    known = _known(parent, pk)
    found = used.join(known, F.col("fk") == F.col("__pk"), "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(F.col("fk").isNull(), F.col("n"))), F.lit(0)).alias("null_keys"),
        F.coalesce(F.sum(F.when(F.col("fk").isNotNull() & F.col("__pk").isNull(), F.col("n"))),
                   F.lit(0)).alias("orphans"))
    return found.select("*", rate("orphans"))


def version_profile(df: DataFrame, base: str, versions: Iterable[Mapping]) -> DataFrame:
    """Rows per added field that carry it although they are dated before its version."""
    stamp = as_timestamp(df, base)
    return profile(df, {
        f"{version['from']}.{name}": {"early": (stamp < F.lit(str(version["from"])).cast("timestamp_ntz"))
                                      & F.col(quote(name)).isNotNull()}
        for version in versions for name in version["added_fields"] if name in df.columns})


def soft_delete_profile(df: DataFrame, flag: str = "is_deleted") -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.count_if(F.col(flag)).alias("deleted")).select(
        "*", rate("deleted"))


def row_counts(tables: Mapping[str, DataFrame], targets: Mapping[str, int]) -> DataFrame:
    """table, target_rows, actual_rows, missing_rows for every table in one job."""
    lines = [df.agg(F.count("*").alias("actual_rows")).select(
        F.lit(name).alias("table"), F.lit(targets.get(name)).cast("long").alias("target_rows"), "actual_rows")
        for name, df in tables.items()]
    out = lines[0]
    for line in lines[1:]:
        out = out.unionByName(line)
    return out.withColumn("missing_rows", F.col("target_rows") - F.col("actual_rows"))


def schema_profile(df: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """Columns that are missing, extra or of another type than the specification says."""
    found = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    lines = []
    for name in [*expected, *[n for n in found if n not in expected]]:
        want, have = expected.get(name), found.get(name)
        issue = "missing" if have is None else "extra" if want is None else "type" if want != have else "ok"
        lines.append((name, want, have, issue))
    schema = "column string, expected string, found string, issue string"
    return df.sparkSession.createDataFrame(lines, schema)


def json_type_profile(records: DataFrame, text: str, expected: Mapping[str, str]) -> DataFrame:
    """Rows per top-level key and JSON type of ``text``, against the type the specification names.

    Types are object, array, string, number, boolean and null; a key that no
    record holds shows up with no rows and the issue "missing".
    """
    parsed = records.select(F.parse_json(F.col(quote(text))).alias("v")).alias("record")
    keys = parsed.lateralJoin(records.sparkSession.tvf.variant_explode(F.col("record.v").outer()).alias("entry"))
    kind = F.schema_of_variant("entry.value")
    named = (F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array")
             .when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean")
             .when(kind == "VOID", "null").otherwise("number"))
    seen = keys.groupBy(F.col("entry.key").alias("column"), named.alias("found")).agg(F.count("*").alias("rows"))
    want = F.create_map(*[F.lit(x) for pair in expected.items() for x in pair])[F.col("column")]
    judged = seen.withColumn("expected", want)
    issue = (F.when(F.col("expected").isNull(), "extra").when(F.col("found") == "null", "null")
             .when(F.col("expected") != F.col("found"), "type").otherwise("ok"))
    names = records.sparkSession.createDataFrame([(n, t) for n, t in expected.items()],
                                                 "column string, expected string")
    absent = names.join(seen, "column", "left_anti").select(
        "column", "expected", F.lit(None).cast("string").alias("found"), F.lit(0).cast("long").alias("rows"),
        F.lit("missing").alias("issue"))
    return judged.select("column", "expected", "found", "rows", issue.alias("issue")).unionByName(absent)


def json_shape_profile(records: DataFrame, text: str, columns: Sequence[str],
                       nest: str = "details") -> DataFrame:
    """Per column: records that hold it, hold a null, hold it one level down, or lack it."""
    flat = T.MapType(T.StringType(), T.StringType())
    parsed = records.select(F.from_json(F.col(quote(text)), flat).alias("top")).withColumn(
        "below", F.from_json(F.col("top")[nest], flat))

    def entries(source: str, nested: bool) -> Column:
        return F.transform(F.map_entries(source), lambda e: F.struct(
            e["key"].alias("key"), e["value"].alias("value"), F.lit(nested).alias("nested")))

    # One entry without a key per record counts the records themselves.
    mark = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"),
                            F.lit(False).alias("nested")))
    lines = F.concat(mark, F.coalesce(entries("top", False), F.array()), F.coalesce(entries("below", True), F.array()))
    found = parsed.select(F.explode(lines).alias("entry")).filter(
        F.col("entry.key").isNull() | F.col("entry.key").isin(list(columns))).groupBy("entry.key").agg(
        F.count("*").alias("held"), F.count("entry.value").alias("present"), F.count_if("entry.nested").alias("nested"))

    def of(c: str | None, count: str) -> Column:
        match = F.col("key").isNull() if c is None else F.col("key") == c
        return F.coalesce(F.sum(F.when(match, F.col(count))), F.lit(0))

    wide = found.agg(of(None, "held").alias("rows"), *[
        of(c, count).alias(f"{i}_{count}") for i, c in enumerate(columns) for count in ("held", "present", "nested")])
    each = [F.struct(F.lit(c).alias("column"), F.col(f"{i}_present").alias("present"),
                     (F.col(f"{i}_held") - F.col(f"{i}_present")).alias("null_value"),
                     F.col(f"{i}_nested").alias("nested"),
                     (F.col("rows") - F.col(f"{i}_held")).alias("missing")) for i, c in enumerate(columns)]
    return wide.select("rows", F.explode(F.array(*each)).alias("line")).select(
        "line.column", "rows", "line.present", "line.null_value", "line.nested", "line.missing")


def header_profile(lines: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per CSV file: whether it starts with a header, and whether its columns are in order.

    ``lines`` is a text scan.  A file's first line is the one with the lowest
    offset, found by a partial aggregate over blocks and lines.
    """
    placed = lines.select("value", F.col("_metadata.file_path").alias("path"),
                          F.struct(F.col("_metadata.file_block_start").alias("block"),
                                   F.monotonically_increasing_id().alias("line")).alias("at"))
    firsts = placed.groupBy("path").agg(F.min_by("value", "at").alias("line"))
    fields = F.split("line", ",")
    given = F.array(*[F.lit(c) for c in columns])
    return firsts.select(
        "path", (F.array_sort(fields) == F.array_sort(given)).alias("has_header"),
        F.when(F.array_sort(fields) == F.array_sort(given), fields == given).alias("in_order"))
