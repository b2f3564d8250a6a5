"""The specification: plain dicts in two accepted layouts, brought to one.

The plain layout lists ``database.entities``, ``file_sources`` and
``api_dumps`` next to ``temporal`` and ``global_messiness``.  The unified
layout lists everything under ``entities`` with a ``source_type`` and allows
aliases, percentages above 1, column shorthand and regular expressions.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import Any

Spec = dict[str, Any]

# Accepted names of the column types.
TYPE_NAMES = {
    "decimal": "float", "numeric": "float", "number": "float", "double": "float", "real": "float",
    "int": "integer", "bigint": "integer", "smallint": "integer", "serial": "integer", "bigserial": "integer",
    "varchar": "string", "char": "string", "text": "string", "enum": "choice", "bool": "boolean",
    "datetime": "timestamp", "person": "name", "full_name": "name", "ip": "ipv4",
}
# Fault settings, as rates and as switches, and other names for them.
RATES = ("null_pct", "dup_pk_pct", "orphaned_fk_pct", "negative_numeric_pct", "impossible_date_pct",
         "missing_header_pct", "soft_delete_pct", "stale_watermark_pct")
SWITCHES = ("column_order_drift", "mixed_date_formats", "multi_sheet_split", "summary_rows",
            "schema_evolution", "nested_structure_depth_variation", "null_vs_missing_keys")
# Names of one rate; of several given, the first here counts.
RATE_NAMES = {"null_pct": ("null_rate", "null_pct"), "dup_pk_pct": ("duplicate_rate", "dup_pk_pct", "duplicate_pct")}
IMPOSSIBLE_VALUES = {"negative_numeric_pct": 0.02, "impossible_date_pct": 0.01}
# Defaults.
DEFAULT_WINDOW = ("2023-01-01", "2024-12-31")
DEFAULT_NULL_PCT = 0.04
ROWS_PER_FILE = 500
UNBOUNDED_LENGTH = 8
EXTENSIONS = {"parquet": "parquet", "excel": "xlsx", "json": "json"}


def share(value: object) -> float:
    """A rate; anything above 1 is a whole-number percentage."""
    number = float(value)
    return number / 100 if number > 1 else number


def faults(raw: Mapping | None) -> Spec:
    out: Spec = {}
    raw = raw or {}
    if raw.get("impossible_values"):
        out.update(IMPOSSIBLE_VALUES)
    if raw.get("naming_inconsistencies"):
        out["column_order_drift"] = True
    for name in RATES:
        given = [n for n in RATE_NAMES.get(name, (name,)) if n in raw]
        if given:
            out[name] = share(raw[given[0]])
    out.update({name: bool(raw[name]) for name in SWITCHES if name in raw})
    return out


def first_count(raw: Mapping, names: Sequence[str], default: int) -> int:
    """The first of the named counts that is given and not zero."""
    return int(next((raw[n] for n in names if raw.get(n)), default))


def column_list(raw: object) -> list[Spec]:
    """Column dicts from a list, or from the shorthand mapping of name to type, choices or dict."""
    if not isinstance(raw, Mapping):
        return [dict(c) for c in raw or () if isinstance(c, Mapping)]
    out = []
    for name, value in raw.items():
        if isinstance(value, Mapping):
            out.append({"type": "integer", **value, "name": name})
        elif isinstance(value, (list, tuple)):
            out.append({"name": name, "type": "choice", "choices": list(value)})
        else:
            out.append({"name": name, "type": value if isinstance(value, str) else "string"})
    return out


def column(raw: Mapping, plain: bool = False) -> Spec:
    """A column in canonical names; the plain layout has fill patterns and a ``text`` type."""
    out = dict(raw)
    given = str(out.get("type", "string")).lower()
    out["type"] = given if plain and given == "text" else TYPE_NAMES.get(given, given)
    if out["type"] == "choice" and "values" in out:
        out.setdefault("choices", out.pop("values"))
    bounds = out.pop("range", None)
    if isinstance(bounds, (list, tuple)) and len(bounds) == 2:
        out["min"], out["max"] = bounds
    if "logical_link" in out:
        out.update(type="foreign_key", ref=out.pop("logical_link"))
    if out.pop("nullable_pct", None) is not None:
        out["nullable"] = True
    if out["type"] == "string" and "pattern" in out and not plain:
        out["pattern"] = fill_pattern(str(out["pattern"]))
    return out


CLASS_SYMBOLS = {r"\d": "#", r"\w": "*", ".": "*"}
TOKEN = re.compile(r"(?P<unit>\[[^\]]*\]|\\.|.)(?P<times>\{\d+(?:,\d*)?\}|[+*?])?", re.S)


def fill_pattern(pattern: str) -> str:
    """A regular expression as a fill pattern: ``^WH-[A-Z]{2}-\\d{3}$`` gives ``WH-??-###``.

    Text without regular-expression syntax already is a fill pattern.  A
    repetition range counts with its lower bound, an open one with eight.
    """
    if not re.search(r"[\[\\^$+.{]", pattern):
        return pattern
    body = pattern.removeprefix("^").removesuffix("$")
    out = ""
    for token in TOKEN.finditer(body):
        unit, times = token["unit"], token["times"]
        if unit[0] == "[" and len(unit) > 1:
            letters = bool(re.search(r"[A-Za-z]-[A-Za-z]", unit))
            symbol = "#" if "0-9" in unit and not letters else "*" if "0-9" in unit else "?"
        elif unit in CLASS_SYMBOLS:
            symbol = CLASS_SYMBOLS[unit]
        elif unit in "?*+":
            symbol = "*"
        else:
            symbol = unit[-1]
        out += symbol * repetitions(times)
    return out


def repetitions(times: str | None) -> int:
    if times is None:
        return 1
    if times == "?":
        return 0
    if times in "+*":
        return UNBOUNDED_LENGTH
    return int(re.match(r"\{(\d+)", times)[1])


def columns_of(entity: Mapping, plain: bool) -> list[Spec]:
    return [column(c, plain) for c in column_list(entity.get("columns") or entity.get("fields"))]


def table(raw: Mapping, plain: bool = False) -> Spec:
    out = {k: raw[k] for k in ("chunk_size", "entity_intro_days_offset", "schema_versions") if k in raw}
    return {**out, "name": raw.get("target", raw["name"]), "columns": columns_of(raw, plain),
            "row_count": first_count(raw, ("row_count", "volume") if plain else ("volume", "row_count"), 100),
            "messiness": faults(raw.get("messiness"))}


def file_source(raw: Mapping, plain: bool = False) -> Spec:
    name, kind = raw["name"], str(raw.get("output_format", raw.get("format", "csv"))).lower()
    volume = int(raw.get("volume") or raw.get("row_count") or 1000)
    files = int(raw.get("num_files") or max(1, volume // ROWS_PER_FILE))
    steps = str(raw.get("path_structure", "")).replace("\\", "/").split("/")
    fixed = "/".join(s for s in steps if s and "{" not in s and "=" not in s)
    return {"name": name, "output_format": kind, "columns": columns_of(raw, plain), "num_files": files,
            "rows_per_file": int(raw.get("rows_per_file") or volume // files),
            "frequency": str(raw.get("frequency", "daily")).lower(),
            "output_dir": raw.get("output_dir") or fixed or name,
            "filename_pattern": raw.get("filename_pattern") or f"{name}_{{date}}.{EXTENSIONS.get(kind, 'csv')}",
            "sheet_name": raw.get("sheet_name", "Sheet1"),
            "schema_versions": raw.get("schema_versions", []), "messiness": faults(raw.get("messiness"))}


def api_dump(raw: Mapping, plain: bool = False) -> Spec:
    response = raw.get("response_structure") or {}
    totals = ("total_records", "approx_record_count")
    return {"name": raw["name"], "columns": columns_of(raw, plain), "output_dir": raw.get("output_dir") or raw["name"],
            "total_records": first_count(raw, totals if plain else totals[::-1], 1000),
            "page_size": int(response.get("page_size") or raw.get("page_size") or 100),
            "filename_pattern": raw.get("filename_pattern", "page_{page}.json"),
            "schema_versions": raw.get("schema_versions", []), "messiness": faults(raw.get("messiness"))}


def normalise(raw: Mapping) -> Spec:
    """Either layout as one dict: project, version, temporal, faults, tables, files, apis."""
    plain = {"temporal", "database", "global_messiness"} <= raw.keys()
    settings = raw.get("global_settings") or {}
    start, end = settings.get("temporal_range") or DEFAULT_WINDOW
    temporal = {"start_date": start, "end_date": end, **(raw.get("temporal") or {})}
    everywhere = faults(raw.get("global_messiness"))
    if not plain:
        everywhere.setdefault("null_pct", share(settings.get("default_null_pct", DEFAULT_NULL_PCT)))
    kinds: dict[str, list] = {"database": [], "file": [], "api_dump": []}
    for entity in raw.get("entities") or ():
        source = str(entity.get("source_type", "database")).lower()
        source = "api_dump" if source == "api" else source
        if source not in kinds:
            raise ValueError(f"unknown source_type {source!r} of {entity.get('name')}")
        kinds[source].append(entity)
    kinds["database"] += (raw.get("database") or {}).get("entities") or []
    kinds["file"] += raw.get("file_sources") or []
    kinds["api_dump"] += raw.get("api_dumps") or []
    cache = raw.get("fk_cache") if isinstance(raw.get("fk_cache"), Mapping) else {}
    return {
        "project": raw.get("project", "unnamed_project"), "version": str(raw.get("version", "1.0.0")),
        "temporal": {"start_date": str(temporal["start_date"]), "end_date": str(temporal["end_date"]),
                     "late_arriving_pct": share(temporal.get("late_arriving_pct", 0.0)),
                     "late_arriving_max_days": int(temporal.get("late_arriving_max_days", 10))},
        "faults": everywhere, "key_pool_cap": int(cache["sample_size"]) if cache.get("sample_size") else None,
        "tables": [table(e, plain) for e in kinds["database"]],
        "files": [file_source(e, plain) for e in kinds["file"]],
        "apis": [api_dump(e, plain) for e in kinds["api_dump"]],
    }


def rates(spec: Mapping, entity: Mapping) -> Spec:
    """Fault settings of an entity: its own, else the global ones."""
    return {**spec["faults"], **entity["messiness"]}
