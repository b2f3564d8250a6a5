"""A normalised specification as lazy DataFrames: tables, file sources, page dump records."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from messlab.functions.columns import Window, epoch, generate, source_row
from messlab.operators import batches, keys, mess
from messlab.plans.spec import Spec, normalise, rates
from messlab.sources.files import FILE_KEY, file_dates

ROW, KEY_ROW, DAY_NAME = "__row", "__key_row", "__day"
ROWS_PER_TASK = 2_000_000


@dataclass
class Builder:
    """Frames of one run.

    ``rows`` overrides every volume (an increment).  ``days`` = (first, last)
    generates that many rows for each day of the range.  ``offset`` numbers the
    rows after those of earlier runs, so keys and draws do not repeat.
    ``parents`` may hold already written parent tables, which then serve as
    key source in place of the generated frame.
    """

    spark: SparkSession
    spec: Spec
    seed: int = 42
    rows: int | None = None
    days: tuple[str, str] | None = None
    offset: int = 0
    parents: dict[str, DataFrame] = field(default_factory=dict)
    _pools: dict[str, keys.KeyPool | None] = field(default_factory=dict)
    _open: set[str] = field(default_factory=set)

    @classmethod
    def of(cls, spark: SparkSession, raw: Mapping, **options) -> Builder:
        return cls(spark, normalise(raw), **options)

    # ------------------------------------------------------------------ rows

    def per_day(self, volume: int) -> int:
        return max(self.rows or volume, 1) if self.days else self.rows or volume

    def volume(self, volume: int) -> int:
        return self.per_day(volume) * (batches.day_count(*self.days) if self.days else 1)

    def numbered(self, volume: int) -> DataFrame:
        total = self.volume(volume)
        tasks = max(self.spark.sparkContext.defaultParallelism, -(-total // ROWS_PER_TASK))
        rows = self.spark.range(self.offset, self.offset + total, 1, tasks).withColumnRenamed("id", ROW)
        if not self.days:
            return rows
        first = rows.withColumn("__day_row", F.col(ROW) - self.offset)
        return batches.with_day(first, "__day_row", self.per_day(volume), self.days[0]).drop("__day_row")

    def window(self, intro_days: int = 0) -> Window:
        temporal = self.spec["temporal"]
        late = {"late_pct": temporal["late_arriving_pct"], "late_max_days": temporal["late_arriving_max_days"],
                "intro_days": intro_days}
        if self.days:
            return batches.day_window(**late)
        return Window(epoch(temporal["start_date"]), epoch(temporal["end_date"]), **late)

    # ---------------------------------------------------------------- tables

    def entity(self, name: str) -> Spec | None:
        return next((e for e in self.spec["tables"] if e["name"] == name), None)

    def tables(self) -> dict[str, DataFrame]:
        return {e["name"]: self.table(e) for e in self.spec["tables"]}

    def table(self, entity: Spec, *, keep_day: bool = False) -> DataFrame:
        volume = entity["row_count"]
        chunk = self.per_day(volume) if self.days else int(entity.get("chunk_size") or self.volume(volume))
        settings = rates(self.spec, entity)
        base = self.numbered(volume)
        keep = [ROW, KEY_ROW, *(["day", "day_start", "day_end"] if self.days else [])]
        out = self._values(base, entity, chunk, self.window(int(entity.get("entity_intro_days_offset", 0))),
                           settings, keep)
        for spec in entity["columns"]:
            if spec["type"] == "foreign_key":
                out = self._point(out, entity, spec, settings.get("orphaned_fk_pct", 0.0))
        out = self._faults(out, entity, settings)
        names = [c["name"] for c in entity["columns"]]
        if keep_day:
            out = out.withColumnRenamed("day", DAY_NAME)
            names = [*names, DAY_NAME]
        return out.select(*names)

    def _values(self, base: DataFrame, entity: Spec, chunk: int, window: Window, settings: Spec,
                keep: list[str]) -> DataFrame:
        total = self.offset + self.volume(entity["row_count"])
        duplicates = settings.get("dup_pk_pct", 0.0)
        pk = primary_key(entity)
        by_row = f"`{ROW}`"
        if pk and pk["type"] != "foreign_key" and duplicates > 0:
            by_row = shifted_source(self.offset, total, chunk, duplicates, self.seed, entity["name"])
        staged = base.withColumn(KEY_ROW, F.expr(by_row))
        return generate(staged, ROW, entity["columns"], seed=self.seed, entity=entity["name"], total=total,
                        chunk_size=chunk, window=window, keep=keep, key_row=KEY_ROW)

    def _point(self, out: DataFrame, entity: Spec, spec: Spec, orphan_pct: float) -> DataFrame:
        parent = str(spec["ref"]).split(".")[0]
        if self.days:
            target = self.entity(parent)
            pk = primary_key(target) if target else None
            if pk is None or parent in self._open or parent == entity["name"]:
                return out
            self._open.add(entity["name"])
            frame = self.table(target, keep_day=True)
            self._open.discard(entity["name"])
            return keys.fk_sample_within(out.drop(spec["name"]), ROW, "day", frame, DAY_NAME, pk["name"],
                                         spec["name"], orphan_pct=orphan_pct, seed=self.seed,
                                         scope=entity["name"])
        pool = self.pool(parent, asking=entity["name"])
        if pool is None:
            return out
        return keys.fk_sample(out.drop(spec["name"]), ROW, pool, spec["name"], orphan_pct=orphan_pct,
                              seed=self.seed, scope=entity["name"])

    def pool(self, name: str, asking: str) -> keys.KeyPool | None:
        """Keys of a parent after its faults; none for an unknown, keyless or cyclic parent."""
        target = self.entity(name)
        pk = primary_key(target) if target else None
        if pk is None or name in self._open or name == asking:
            return None
        if name not in self._pools:
            self._open.add(asking)
            frame = self.parents.get(name)
            frame = self.table(target) if frame is None else frame
            self._pools[name] = keys.key_pool(frame, pk["name"], self.spec["key_pool_cap"], seed=self.seed)
            self._open.discard(asking)
        return self._pools[name]

    def _faults(self, out: DataFrame, entity: Spec, settings: Spec) -> DataFrame:
        """Row faults; a generated key already carries its duplicates, so it is nulled by its source row."""
        pk = primary_key(entity)
        scope = {"seed": self.seed, "scope": entity["name"]}
        generated = pk is not None and pk["type"] != "foreign_key"
        columns = entity["columns"]
        if generated:
            if pk.get("nullable"):
                out = mess.nulls(out, KEY_ROW, [pk["name"]], settings.get("null_pct", 0.0), **scope)
            columns = [{**c, "nullable": False} if c is pk else c for c in columns]
            settings = {**settings, "dup_pk_pct": 0.0}
        return mess.apply(out, ROW, columns, settings, pk=pk["name"] if pk else None,
                          versions=entity.get("schema_versions") or (), **scope)

    # ----------------------------------------------------------------- files

    def file_rows(self, source: Spec) -> int:
        files = batches.day_count(*self.days) if self.days else source["num_files"]
        return files * (self.rows or source["rows_per_file"])

    def file_source(self, source: Spec) -> DataFrame:
        """Rows of all files of a source with their file number and date, faults included."""
        per_file = self.rows or source["rows_per_file"]
        temporal = self.spec["temporal"]
        start, end = self.days or (temporal["start_date"], temporal["end_date"])
        total = self.file_rows(source)
        plan = replace(self, days=None, rows=None, parents={}, _pools={}, _open=set())
        rows = plan.numbered(total)
        dated = file_dates(rows.withColumn("__at", F.col(ROW) - self.offset), "__at", per_file, start,
                           frequency="daily" if self.days else source["frequency"],
                           end=None if self.days else end)
        late = self.window()
        window = Window("`file_start`", "`file_end`", late_pct=late.late_pct, late_max_days=late.late_max_days)
        settings = rates(self.spec, source)
        keep = [ROW, KEY_ROW, "file_no", FILE_KEY, "file_start", "file_end"]
        sized = {**source, "row_count": total}
        out = plan._values(dated, sized, per_file, window, settings, keep)
        out = plan._faults(out, source, settings)
        return out.select(ROW, "file_no", FILE_KEY, *[c["name"] for c in source["columns"]])

    # ------------------------------------------------------------------ apis

    def api_records(self, api: Spec) -> DataFrame:
        """Records of a dump: no primary key, foreign keys without parent, API faults included."""
        settings = rates(self.spec, api)
        columns = [{**c, "primary_key": c.get("primary_key", False)} for c in api["columns"]]
        entity = {**api, "columns": columns, "row_count": api["total_records"]}
        base = self.numbered(api["total_records"])
        keep = [ROW, KEY_ROW, *(["day", "day_start", "day_end"] if self.days else [])]
        plain = {**settings, "dup_pk_pct": 0.0}
        out = self._values(base, entity, self.per_day(api["page_size"]), self.window(), plain, keep)
        scope = {"seed": self.seed, "scope": api["name"]}
        out = mess.apply(out, ROW, columns, plain, versions=api.get("schema_versions") or (), **scope)
        out = mess.soft_delete(out, ROW, settings.get("soft_delete_pct", 0.0), **scope)
        times = [c for c in columns if c["type"] in ("timestamp", "date", "date_str")]
        if times:
            out = mess.stale_watermark(out, ROW, times[-1]["name"], settings.get("stale_watermark_pct", 0.0),
                                       strftime=times[-1].get("format"), **scope)
        names = [c["name"] for c in columns]
        flag = ["is_deleted"] if settings.get("soft_delete_pct", 0.0) > 0 else []
        return out.select(ROW, *names, *flag)


def primary_key(entity: Spec | None) -> Spec | None:
    return next((c for c in entity["columns"] if c.get("primary_key")), None) if entity else None


def shifted_source(offset: int, total: int, chunk: int, pct: float, seed: int, entity: str) -> str:
    """Source rows of an increment lie inside the increment, whose rows start at ``offset``."""
    inner = source_row(f"(`{ROW}` - {offset}L)", total - offset, chunk, pct, seed, f"{entity}|{offset}")
    return f"({offset}L + {inner})" if offset else inner

