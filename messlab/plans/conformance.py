"""A table checked against its specification: one row per rule and column with its violations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

from messlab.functions.formats import spark_pattern
from messlab.functions.rng import quote
from messlab.operators import audit
from messlab.operators.mess import as_timestamp
from messlab.plans.build import primary_key
from messlab.plans.spec import Spec

UUID = "^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"
SYMBOLS = {"#": "[0-9]", "?": "[A-Z]", "*": "[A-Z0-9]"}
# Spark types a column type may have; text columns are strings.
KINDS = {"integer": (T.IntegralType,), "float": (T.FractionalType,), "boolean": (T.BooleanType,),
         "timestamp": (T.TimestampNTZType, T.TimestampType), "date": (T.DateType,)}


def fill_regex(pattern: str) -> str:
    """The regular expression that values filled from ``pattern`` match."""
    literal = set(r".^$+(){}[]|\/-")
    return "^" + "".join(SYMBOLS.get(ch, "\\" + ch if ch in literal else ch) for ch in pattern) + "$"


def column_rules(df: DataFrame, entity: Spec, window: tuple[str, str] | None) -> dict[tuple[str, str], Column]:
    """Condition of a violation for each (rule, column) the specification implies."""
    gated = {f for v in entity.get("schema_versions") or () for f in v.get("added_fields", ())}
    rules: dict[tuple[str, str], Column] = {}
    for spec in entity["columns"]:
        name, kind = spec["name"], spec["type"]
        if name not in df.columns:
            rules["missing column", name] = F.lit(True)
            continue
        value, have = F.col(quote(name)), df.schema[name].dataType
        if kind in KINDS and not isinstance(have, KINDS[kind]):
            rules["column type", name] = F.lit(True)
            continue
        if not spec.get("nullable") and name not in gated:
            rules["not null", name] = value.isNull()
        if kind in ("integer", "float") and ("min" in spec or "max" in spec):
            rules["range", name] = (value < F.lit(spec.get("min", float("-inf")))) | (
                value > F.lit(spec.get("max", float("inf"))))
        if kind == "choice":
            rules["choices", name] = ~value.isin(list(spec.get("choices") or ["unknown"]))
        if kind == "uuid":
            rules["uuid", name] = ~value.rlike(UUID)
        if kind == "string" and "pattern" in spec:
            rules["pattern", name] = ~value.rlike(fill_regex(spec["pattern"]))
        if kind == "date_str":
            pattern = spark_pattern(spec.get("format", "%Y-%m-%d"))
            rules["date text", name] = value.isNotNull() & F.try_to_timestamp(value, F.lit(pattern)).isNull()
        if kind in ("timestamp", "date") and window:
            stamp = as_timestamp(df, name)
            low, high = (F.lit(day).cast("timestamp_ntz") for day in window)
            rules["window", name] = (stamp < low) | (stamp > high)
    for name in set(df.columns) - {c["name"] for c in entity["columns"]}:
        rules["extra column", name] = F.lit(True)
    return rules


def check(df: DataFrame, entity: Spec, *, window: tuple[str, str] | None = None,
          parents: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """(rule, column, rows, violations): column rules in one pass, keys folded before they are compared.

    ``parents`` maps entity names to tables for the foreign keys; a reference
    ``entity.column`` is checked against that column.
    """
    rules = column_rules(df, entity, window)
    names = {f"{i}": rule for i, rule in enumerate(rules)}
    counted = audit.profile(df, {i: {"violations": rules[rule]} for i, rule in names.items()})
    label = F.create_map(*[F.lit(x) for i, rule in names.items() for x in (i, f"{rule[0]}|{rule[1]}")])
    parts = F.split(label[F.col("column")], r"\|", 2)
    out = counted.select(parts[0].alias("rule"), parts[1].alias("column"), "rows", "violations")

    def line(frame: DataFrame, rule: str, name: str, violations: str) -> DataFrame:
        return frame.select(F.lit(rule).alias("rule"), F.lit(name).alias("column"), "rows",
                            F.col(violations).alias("violations"))

    pk = primary_key(entity)
    if pk and pk["name"] in df.columns:
        out = out.unionByName(line(audit.duplicate_key_profile(df, pk["name"]), "unique key", pk["name"], "surplus_rows"))
    for spec in entity["columns"]:
        parent, _, key = str(spec.get("ref", "")).partition(".")
        if parent in (parents or {}) and spec["name"] in df.columns:
            found = audit.orphan_profile(df, spec["name"], parents[parent], key)
            out = out.unionByName(line(found, "foreign key", spec["name"], "orphans"))
    if "row_count" in entity:
        target = F.abs(F.col("rows") - F.lit(int(entity["row_count"])))
        total = df.agg(F.count("*").alias("rows")).withColumn("off", target.cast("long"))
        out = out.unionByName(line(total, "row count", "", "off"))
    return out
