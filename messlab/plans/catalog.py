"""Every operator as a query over the test tables: name -> function of (spark, directory)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from messlab.functions.columns import Window, generate
from messlab.operators import audit, batches, index, keys, mess, pages, shape
from messlab.plans import runs, samples
from messlab.plans.build import Builder
from messlab.plans.conformance import check
from messlab.sources import files, tables
from messlab.sources.workspace import scratch
from messlab.streaming import delivery, late

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
ORDERS, LINES, EVENTS = {"scope": "orders"}, {"scope": "lineitem"}, {"scope": "events"}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def plain(df: DataFrame) -> DataFrame:
    """Dates and times as text, the one form every engine prints alike."""
    def cell(f: T.StructField):
        if isinstance(f.dataType, T.DateType):
            return F.col(f.name).cast("string").alias(f.name)
        if isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)):
            # Padded to microseconds; a cast reads zone-free times as they are.
            return F.expr(f"substr(concat(rpad(`{f.name}`, 20, '.'), substr(`{f.name}`, 21), '000000'), 1, 26)").alias(
                f.name)
        return F.col(f.name)
    return df.select(*[cell(f) for f in df.schema.fields])


def month(column: str) -> Column:
    return F.trunc(F.col(column).cast("date"), "month")


# ------------------------------------------------------------ keys and joins

def order_children(spark, sf, customer: DataFrame) -> DataFrame:
    pool = keys.key_pool(customer, "c_custkey")
    return keys.fk_sample(load(spark, sf, "orders").select("o_orderkey"), "o_orderkey", pool, "customer_key",
                          orphan_pct=0.05, **ORDERS)


@query
def fk_sample_orphans(spark, sf):
    """One child per order pointing at a real customer, 5 % orphans, found again by their lack of a parent."""
    customer = load(spark, sf, "customer")
    return audit.mark_orphans(order_children(spark, sf, customer), "customer_key", customer, "c_custkey")


@query
def orphan_rows(spark, sf):
    customer = load(spark, sf, "customer")
    return audit.orphan_rows(order_children(spark, sf, customer), "customer_key", customer, "c_custkey")


@query
def orphan_audit(spark, sf):
    customer = load(spark, sf, "customer")
    return audit.orphan_profile(order_children(spark, sf, customer), "customer_key", customer, "c_custkey")


@query
def key_pool_topk(spark, sf):
    """Capped key pool: the positions and keys of a uniform choice of 1,000 customers."""
    return keys.key_pool(load(spark, sf, "customer"), "c_custkey", 1000).frame


@query
def key_pool_after_faults(spark, sf):
    """Pool of a key column that faults have nulled and repeated."""
    customer = load(spark, sf, "customer")
    dirty = mess.nulls(customer.withColumn("key", F.col("c_custkey")), "c_custkey", ["key"], 0.1, scope="customer")
    dirty = mess.duplicate_keys(dirty, "c_custkey", "key", 0.2, scope="customer")
    return keys.key_pool(dirty, "key", None).frame


@query
def fresh_foreign_keys(spark, sf):
    return keys.fresh_keys(load(spark, sf, "orders").select("o_orderkey"), "o_orderkey", "parent", **ORDERS)


@query
def dense_positions(spark, sf):
    return index.dense_index(load(spark, sf, "events").select("event_id", "ts"), ["ts", "event_id"]).select(
        "event_id", "ix")


@query
def hash_positions_by_group(spark, sf):
    orders = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return index.hash_index(orders, "o_orderkey", by="o_orderstatus", total="group_size")


@query
def sample_without_replacement(spark, sf):
    return index.sample(load(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", fraction=0.1)


# -------------------------------------------------------------- generators

def generated(spark, sf, table, key, columns, scope, **options) -> DataFrame:
    frame = load(spark, sf, table).select(key)
    return generate(frame, key, columns, entity=scope, total=frame.count(), keep=[key], **options)


@query
def gen_keys(spark, sf):
    return generated(spark, sf, "orders", "o_orderkey", samples.KEY_COLUMNS, "keys", chunk_size=4000)


@query
def gen_text_columns(spark, sf):
    return generated(spark, sf, "orders", "o_orderkey", samples.TEXT_COLUMNS, "text", chunk_size=4000)


@query
def gen_patterns(spark, sf):
    return generated(spark, sf, "orders", "o_orderkey", samples.PATTERN_COLUMNS, "patterns")


@query
def gen_scalars(spark, sf):
    return generated(spark, sf, "orders", "o_orderkey", samples.SCALAR_COLUMNS, "scalars")


@query
def gen_times(spark, sf):
    window = Window.of(*samples.WINDOW, late_pct=0.1, late_max_days=10)
    return plain(generated(spark, sf, "events", "event_id", samples.TIME_COLUMNS, "times", window=window))


@query
def gen_times_growth(spark, sf):
    window = Window.of(*samples.WINDOW, intro_days=10)
    return plain(generated(spark, sf, "events", "event_id", samples.GROWTH_COLUMNS, "growth", window=window))


@query
def gen_times_past_end(spark, sf):
    """An introduction offset beyond the window: every value is the window's end."""
    window = Window.of(*samples.WINDOW, intro_days=400)
    return plain(generated(spark, sf, "events", "event_id", samples.TIME_COLUMNS[:1], "past", window=window))


@query
def gen_date_strings(spark, sf):
    window = Window.of(*samples.WINDOW)
    return generated(spark, sf, "events", "event_id", samples.DATE_TEXT_COLUMNS, "dates", window=window)


# ------------------------------------------------------------------- faults

def nulled_orders(spark, sf) -> DataFrame:
    return mess.nulls(load(spark, sf, "orders"), "o_orderkey", ["o_orderpriority", "o_orderdate", "o_custkey"],
                      0.1, **ORDERS)


@query
def inject_nulls(spark, sf):
    return plain(nulled_orders(spark, sf))


@query
def null_profile(spark, sf):
    return audit.null_profile(nulled_orders(spark, sf))


def repeated_orders(spark, sf) -> DataFrame:
    return mess.duplicate_keys(load(spark, sf, "orders"), "o_orderkey", "o_orderkey", 0.02, **ORDERS)


@query
def inject_duplicate_keys(spark, sf):
    return plain(repeated_orders(spark, sf))


@query
def duplicate_key_audit(spark, sf):
    return audit.duplicate_key_profile(repeated_orders(spark, sf), "o_orderkey")


@query
def duplicate_key_rows(spark, sf):
    return audit.duplicate_keys(load(spark, sf, "lineitem"), "l_orderkey")


def negated_lines(spark, sf) -> DataFrame:
    return mess.negatives(load(spark, sf, "lineitem"), LINE_KEY, 0.02, exclude=LINE_KEY, **LINES)


@query
def inject_negatives(spark, sf):
    return plain(negated_lines(spark, sf))


@query
def negative_audit(spark, sf):
    return audit.negative_profile(negated_lines(spark, sf))


def misdated_orders(spark, sf) -> DataFrame:
    orders = load(spark, sf, "orders").withColumn("date_text", F.date_format("o_orderdate", "dd/MM/yyyy"))
    return mess.impossible_dates(orders, "o_orderkey", ["o_orderdate", "date_text"], 0.05, **ORDERS)


@query
def inject_impossible_dates(spark, sf):
    return plain(misdated_orders(spark, sf).select("o_orderkey", "o_orderdate", "date_text"))


@query
def date_audit(spark, sf):
    return audit.date_profile(misdated_orders(spark, sf), ["o_orderdate", "date_text"], "1996-01-01", "2000-12-31")


@query
def date_text_audit(spark, sf):
    return audit.date_text_profile(misdated_orders(spark, sf), ["date_text"])


def versioned_orders(spark, sf) -> DataFrame:
    return mess.schema_versions(misdated_orders(spark, sf), "o_orderdate", samples.VERSIONS)


@query
def schema_version_gate(spark, sf):
    return plain(versioned_orders(spark, sf))


@query
def schema_version_audit(spark, sf):
    """Before and after the gate: rows that carry a field older than its version."""
    before = audit.version_profile(misdated_orders(spark, sf), "o_orderdate", samples.VERSIONS)
    after = audit.version_profile(versioned_orders(spark, sf), "o_orderdate", samples.VERSIONS)
    return before.withColumnRenamed("early", "early_before").join(
        after.select("column", F.col("early").alias("early_after")), "column")


def dirty_orders(spark, sf) -> DataFrame:
    return mess.apply(load(spark, sf, "orders"), "o_orderkey", samples.ORDER_SPEC, samples.ORDER_RATES,
                      pk="o_orderkey", versions=samples.VERSIONS, scope="mess")


@query
def all_faults_in_order(spark, sf):
    """Nulls, repeated keys, negatives, impossible dates and version gating on one table."""
    return plain(dirty_orders(spark, sf))


@query
def conformance(spark, sf):
    """The faulty orders against a specification: violations per rule and column."""
    return check(dirty_orders(spark, sf), samples.CHECK_SPEC, window=("1996-01-01", "2000-12-31"),
                 parents={"customer": load(spark, sf, "customer")})


def late_events(spark, sf) -> DataFrame:
    return mess.late_arrivals(load(spark, sf, "events").select("event_id", "ts", "event_type"), "event_id", "ts",
                              0.1, max_days=10, low="2024-01-01", high="2024-01-31", **EVENTS)


@query
def late_arrivals(spark, sf):
    return plain(late_events(spark, sf))


@query
def late_rows_daily(spark, sf):
    return plain(late.late_by_day(late_events(spark, sf), "ts", "event_id", 48))


@query
def clip_to_window(spark, sf):
    events = load(spark, sf, "events").select("event_id", "ts", "value")
    return plain(mess.clip(mess.clip(events, "ts", "2024-01-05", "2024-01-20"), "value", 2.0, 10.0))


def stale_events(spark, sf) -> DataFrame:
    events = load(spark, sf, "events").select("event_id", "ts", F.date_format("ts", "yyyy-MM-dd").alias("day_text"),
                                              "event_type")
    moved = mess.stale_watermark(events, "event_id", "ts", 0.05, **EVENTS)
    return mess.stale_watermark(moved, "event_id", "day_text", 0.05, **EVENTS)


@query
def stale_watermark(spark, sf):
    return plain(stale_events(spark, sf))


@query
def stale_audit(spark, sf):
    marked = late.mark_stale(stale_events(spark, sf), "ts", "event_id", 24)
    return marked.groupBy("event_type").agg(F.count("*").alias("rows"), F.count_if("stale").alias("stale_rows"))


@query
def stale_audit_by_user(spark, sf):
    events = load(spark, sf, "events").select("event_id", "ts", "user_id")
    moved = mess.stale_watermark(events, "event_id", "ts", 0.05, **EVENTS)
    marked = late.mark_stale(moved, "ts", "event_id", 24, by="user_id")
    return marked.groupBy("user_id").agg(F.count("*").alias("rows"), F.count_if("stale").alias("stale_rows"))


@query
def soft_delete(spark, sf):
    return mess.soft_delete(load(spark, sf, "events").select("event_id"), "event_id", 0.05, **EVENTS)


@query
def soft_delete_audit(spark, sf):
    return audit.soft_delete_profile(soft_delete(spark, sf))


# -------------------------------------------------------------------- pages

PAGE = 100
PAGE_COLUMNS = ["event_id", "user_id", "event_type", "value"]


def page_rows(envelopes: DataFrame) -> DataFrame:
    """Envelope fields and the page's event numbers in their order."""
    ids = F.array_join(F.transform("data", lambda r: r["event_id"].cast("string")), ",")
    return envelopes.select("api", "page", "page_size", "total_pages", "total_records", ids.alias("event_ids"))


def event_pages(spark, sf) -> DataFrame:
    return pages.page_dump(load(spark, sf, "events"), "event_id", "events", PAGE, columns=PAGE_COLUMNS)


def written_pages(spark, dump: DataFrame, label: str) -> DataFrame:
    path = scratch(spark, label)
    pages.write_pages(dump, path)
    return pages.read_pages(spark, path, dump.schema["data"].dataType.elementType)


@query
def paginate(spark, sf):
    return pages.paginate(load(spark, sf, "events").select("event_id"), "event_id", PAGE)


@query
def page_envelope(spark, sf):
    return page_rows(event_pages(spark, sf))


@query
def page_roundtrip(spark, sf):
    """Write the dump, read it back, flatten it."""
    return pages.records(written_pages(spark, event_pages(spark, sf), "pages"))


@query
def page_browse(spark, sf):
    """Page 3 of a written dump, found by partition pruning."""
    return page_rows(pages.browse(written_pages(spark, event_pages(spark, sf), "browse"), 3))


@query
def repaginate_append(spark, sf):
    """A dump of the events to 20 January, then the later ones appended and paged again."""
    events = load(spark, sf, "events")
    early = F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")
    first = pages.page_dump(events.filter(early), "event_id", "events", PAGE, columns=PAGE_COLUMNS)
    stored = written_pages(spark, first, "pages-0")
    both = pages.append_pages(stored, events.filter(~early), "event_id")
    return page_rows(written_pages(spark, both, "pages-1"))


@query
def browse_blocks(spark, sf):
    """Page 3 of a dump with two pages a block, a layout that the reader is not told."""
    dump = pages.page_dump(load(spark, sf, "events"), "event_id", "events", PAGE, columns=PAGE_COLUMNS, pages_per_block=2)
    return page_rows(pages.browse(written_pages(spark, dump, "browse-blocks"), 3))


@query
def repaginate_append_blocks(spark, sf):
    """Appending to a dump with three pages a block, whose tail page is part full."""
    events = load(spark, sf, "events")
    early = F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")
    first = pages.page_dump(events.filter(early), "event_id", "events", PAGE, columns=PAGE_COLUMNS, pages_per_block=3)
    both = pages.append_pages(written_pages(spark, first, "blocks-0"), events.filter(~early), "event_id")
    return page_rows(written_pages(spark, both, "blocks-1"))


@query
def page_counts(spark, sf):
    return pages.page_counts(load(spark, sf, "events"), 77)


@query
def page_manifest(spark, sf):
    return files.page_manifest(written_pages(spark, event_pages(spark, sf), "manifest"), "events").drop("size_kb")


# -------------------------------------------------------------- file shapes

def monthly_orders(spark, sf) -> DataFrame:
    return load(spark, sf, "orders").select(
        month("o_orderdate").alias("file_date"), "o_orderkey", "o_custkey", "o_orderstatus",
        F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice"), "o_orderdate", "o_orderpriority")


EARLY_ORDERS = "o_orderdate < TIMESTAMP_NTZ '1998-01-01 00:00:00'"
LATER_ORDERS = f"NOT {EARLY_ORDERS}"
ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query
def summary_row(spark, sf):
    cents = F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long")
    return shape.summary_row(load(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", cents.alias("cents")))


@query
def summary_row_per_file(spark, sf):
    cents = F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long")
    rows = load(spark, sf, "orders").select("o_orderkey", cents.alias("cents"), month("o_orderdate").alias("file_date"))
    return plain(shape.total_rows(rows, by="file_date"))


@query
def sheet_split(spark, sf):
    return shape.sheet_split(load(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query
def csv_lines_drift(spark, sf):
    return plain(shape.csv_lines(monthly_orders(spark, sf), "file_date", ORDER_COLUMNS, **ORDERS).select(
        "o_orderkey", "file_date", "order_variant", "line"))


@query
def mixed_date_formats(spark, sf):
    rows = monthly_orders(spark, sf).select("o_orderkey", "file_date", "o_orderdate",
                                            (F.col("o_orderdate") + F.expr("INTERVAL '36' HOUR")).alias("due"))
    return plain(shape.mixed_dates(rows, "file_date", ["o_orderdate", "due"], **ORDERS))


@query
def missing_header(spark, sf):
    """CSV files per month, some without header, some in another column order, audited from the text."""
    path = scratch(spark, "csv")
    files.write_csv(monthly_orders(spark, sf), path, missing_header_pct=0.3, order_drift=True, **ORDERS)
    found = audit.header_profile(spark.read.text(path), ORDER_COLUMNS)
    return found.select(F.regexp_extract("path", "file_date=([0-9-]+)", 1).alias("file_date"),
                        "has_header", "in_order").distinct()


@query
def csv_append(spark, sf):
    """Two appends to one CSV directory, read back; nulls are empty fields."""
    rows = monthly_orders(spark, sf)
    rows = mess.nulls(rows, "o_orderkey", ["o_orderpriority", "o_custkey"], 0.1, **ORDERS)
    path = scratch(spark, "csv")
    for part in (EARLY_ORDERS, LATER_ORDERS):
        files.write_csv(rows.filter(part), path, scope="orders")
    schema = T.StructType([rows.schema[c] for c in ORDER_COLUMNS] + [rows.schema["file_date"]])
    back = spark.read.schema(schema).options(header=True, **files.TIMES).csv(path)
    return plain(back.withColumn("o_totalprice", F.col("o_totalprice").cast("double")))


@query
def json_append(spark, sf):
    """Two appends of JSON Lines, read back with their schema."""
    rows = mess.nulls(monthly_orders(spark, sf), "o_orderkey", ["o_orderpriority", "o_custkey"], 0.1, **ORDERS)
    path = scratch(spark, "json")
    for part in (EARLY_ORDERS, LATER_ORDERS):
        files.write_json(rows.filter(part), path, key="o_orderkey", columns=ORDER_COLUMNS, missing=True, scope="orders")
    schema = T.StructType([rows.schema[c] for c in ORDER_COLUMNS])
    back = spark.read.schema(schema).options(**shape.JSON_TIMES).json(path)
    return plain(back.select(*ORDER_COLUMNS).withColumn("o_totalprice", F.col("o_totalprice").cast("double")))


SHIP_COLUMNS = ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag"]


@query
def schema_evolution_roundtrip(spark, sf):
    """Parquet files per month, some lacking a column, appended, then read as one schema."""
    rows = load(spark, sf, "lineitem").select(month("l_shipdate").alias("file_date"), *SHIP_COLUMNS)
    path = scratch(spark, "parquet")
    files.write_parquet(rows, path, keep=["l_orderkey"], schema_evolution=True, **LINES)
    return plain(files.read_evolved(spark, path).select("file_date", *SHIP_COLUMNS))


def event_records(spark, sf) -> DataFrame:
    events = load(spark, sf, "events").select(
        "event_id", "event_type", "user_id", F.floor(F.col("value") * 100 + 0.5).cast("long").alias("cents"), "props")
    events = mess.nulls(events, "event_id", ["event_type", "user_id", "cents", "props"], 0.2, **EVENTS)
    return shape.json_records(events, "event_id", ["event_id", "event_type", "user_id", "cents", "props"], **EVENTS)


@query
def json_shape_variation(spark, sf):
    return event_records(spark, sf).select("event_id", "record")


@query
def json_shape_audit(spark, sf):
    return audit.json_shape_profile(event_records(spark, sf), "record",
                                    ["event_id", "event_type", "user_id", "cents", "props"])


@query
def schema_audit(spark, sf):
    """JSON types found per key, against the specification."""
    return audit.json_type_profile(event_records(spark, sf), "record", samples.RECORD_TYPES)


@query
def file_date_sequence(spark, sf):
    """Twenty files of events, weekly, and monthly for comparison."""
    events = load(spark, sf, "events").select("event_id")
    size = max(events.count() // 20, 1)
    weekly = files.file_dates(events, "event_id", size, "2024-01-01", frequency="weekly", end="2024-04-01")
    monthly = files.file_dates(events, "event_id", size, "2024-01-31", frequency="monthly")
    both = weekly.withColumn("frequency", F.lit("weekly")).unionByName(
        monthly.withColumn("frequency", F.lit("monthly")))
    return plain(both.withColumn("file_name", F.expr(files.file_name("events_{date}_w{week}.csv")))
                 .groupBy("frequency", "file_no", "file_date", "file_start", "file_end", "file_name")
                 .agg(F.count("*").alias("rows")))


@query
def file_windows(spark, sf):
    """Times generated inside the window of each row's file."""
    events = load(spark, sf, "events").select("event_id")
    total = events.count()
    dated = files.file_dates(events, "event_id", max(total // 20, 1), "2024-01-01")
    return plain(generate(dated, "event_id", [{"name": "at", "type": "timestamp"}], entity="files", total=total,
                          window=Window("`file_start`", "`file_end`"),
                          keep=["event_id", "file_date", "file_start", "file_end"])
                 .select("event_id", "file_date", "at"))


@query
def file_manifest(spark, sf):
    """Files written per month, listed with their rows and sizes; paths differ from run to run."""
    path = scratch(spark, "manifest")
    files.write_parquet(monthly_orders(spark, sf), path)
    found = files.file_manifest(spark.read.parquet(path), "orders", "parquet")
    date = F.regexp_extract("path", "file_date=([0-9-]+)", 1)
    return found.groupBy("entity", "format", date.alias("file_date")).agg(
        F.sum("rows").alias("rows"), (F.min("size_kb") > 0).alias("sized")).orderBy("file_date")


@query
def table_summary(spark, sf):
    """Tables created by a first load, loaded once more, and counted after that."""
    sources = {n: load(spark, sf, n) for n in ("region", "nation", "customer", "supplier", "part", "orders")}
    stored = {}
    for name, df in sources.items():
        path = scratch(spark, name)
        table = f"messlab_{name}_{path[-12:]}"
        for _ in range(2):
            tables.save_table(df, table, path=path)
        stored[name] = spark.table(table)
    return audit.row_counts(stored, {n: 2 * df.count() for n, df in sources.items()})


# ------------------------------------------------------------------ batches

@query
def daily_batches(spark, sf):
    """Each line item points at an order of its own day, or is an orphan."""
    orders = load(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate"))
    lines = load(spark, sf, "lineitem").select(*LINE_KEY, F.to_date("l_shipdate").alias("day"))
    return plain(keys.fk_sample_within(lines, LINE_KEY, "day", orders, "day", "o_orderkey", "order_key",
                                       orphan_pct=0.05, **LINES))


@query
def daily_windows(spark, sf):
    """A batch a day for thirty days: the day, a key and a time inside its window, in one job."""
    events = load(spark, sf, "events").select("event_id")
    total = events.count()
    per_day = max(total // 30, 1)
    days = batches.with_day(events, "event_id", per_day, "2024-01-01")
    return plain(generate(days, "event_id", [{"name": "id", "type": "uuid", "primary_key": True},
                                             {"name": "at", "type": "timestamp"}], entity="days", total=total,
                          chunk_size=per_day, window=batches.day_window(),
                          keep=["event_id", "day", "day_start", "day_end"])
                 .drop("day_start", "day_end"))


@query
def incremental_append(spark, sf):
    """A first batch, then one with a new column, appended and read as one table."""
    orders = load(spark, sf, "orders")
    path = scratch(spark, "increment")
    first = orders.filter(EARLY_ORDERS).select("o_orderkey", "o_totalprice")
    second = orders.filter(LATER_ORDERS).select("o_orderkey", "o_totalprice", F.col("o_orderpriority").alias("channel"))
    first.write.mode("append").parquet(path)
    second.write.mode("append").parquet(path)
    return files.read_evolved(spark, path).select("o_orderkey", "o_totalprice", "channel")


@query
def append_rows(spark, sf):
    """Union by name: a column that one side lacks is null there."""
    customers = load(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"),
                                                   F.col("c_mktsegment").alias("segment"))
    suppliers = load(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return batches.append(customers, suppliers)


@query
def daily_accounting(spark, sf):
    lines = load(spark, sf, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    return plain(batches.accounting(lines))


# ------------------------------------------------------------------ streams

@query
def stream_daily_append(spark, sf):
    """Day directories of events delivered by a stream; rows and key sums per day as appended."""
    events = load(spark, sf, "events").withColumn("day", F.to_date("ts"))
    source, sink, check = (scratch(spark, f"stream-{n}") for n in ("in", "out", "checkpoint"))
    events.write.partitionBy("day").parquet(source)
    stream = delivery.read_days(spark, source, events.schema, files_per_batch=50)
    delivery.deliver(stream, sink, check, partition_by="day")
    return plain(spark.read.parquet(sink).groupBy("day").agg(
        F.count("*").alias("rows"), F.sum("event_id").alias("id_sum")))


@query
def stream_closed_days(spark, sf):
    """Days that a watermark of eleven days has closed, with their rows; no row is that late."""
    events = late_events(spark, sf)
    source, sink, check = (scratch(spark, f"stream-{n}") for n in ("in", "out", "checkpoint"))
    events.write.parquet(source)
    stream = delivery.read_days(spark, source, events.schema, files_per_batch=1_000_000)
    delivery.deliver(delivery.daily_counts(stream, "ts", "11 days"), sink, check)
    return plain(spark.read.parquet(sink))


# ------------------------------------------------------------------- audits

@query
def range_audit(spark, sf):
    return audit.range_profile(load(spark, sf, "lineitem"),
                               {"l_quantity": (5.0, 40.0), "l_discount": (0.01, 0.05), "l_linenumber": (2, 6)})


@query
def choice_audit(spark, sf):
    return audit.choice_profile(load(spark, sf, "lineitem"), {"l_returnflag": ["A", "R"], "l_linestatus": ["O"]})


@query
def row_count_audit(spark, sf):
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
             "embeddings", "pages", "benchmark", "labels", "conversations")
    return audit.row_counts({n: load(spark, sf, n) for n in names}, {n: 1000 for n in names})


@query
def spec_tables(spark, sf):
    """A parent and a child table from a specification sized by the test tables."""
    raw = samples.parent_child(load(spark, sf, "customer").count(), load(spark, sf, "orders").count())
    return plain(Builder.of(spark, raw).tables()["children"])


@query
def spec_days(spark, sf):
    """The same specification for thirty days, a thirtieth of the customers' number of rows each."""
    per_day = max(load(spark, sf, "customer").count() // 30, 1)
    builder = Builder.of(spark, samples.parent_child(1, 1), rows=per_day, days=("2024-01-01", "2024-01-30"))
    return plain(builder.table(builder.entity("children"), keep_day=True).withColumnRenamed("__day", "day"))


@query
def spec_increment(spark, sf):
    """A second batch as large as the customer table, numbered on after as many rows as there are orders."""
    first, more = load(spark, sf, "orders").count(), load(spark, sf, "customer").count()
    builder = Builder.of(spark, samples.parent_child(1, 1), rows=more, offset=first)
    return plain(builder.tables()["children"])


def repeated_runs(spark, sf) -> str:
    """Directory of a first run, an increment that stops before its end, and the same increment again."""
    first, more = load(spark, sf, "orders").count(), load(spark, sf, "customer").count()
    raw, out = samples.parent_child(more, first), scratch(spark, "runs")
    runs.run(spark, raw, out)
    runs.write_outputs(Builder.of(spark, raw, rows=more, offset=first), out, 1)  # never committed
    runs.run_increment(spark, raw, out, more)
    return out


@query
def run_repeated(spark, sf):
    """Child rows of both runs, the second of which was repeated after a stop."""
    return plain(spark.read.parquet(f"{repeated_runs(spark, sf)}/tables/children"))


@query
def run_totals(spark, sf):
    """Outputs and rows of each finished run, and the rows that the written tables hold after it."""
    out = repeated_runs(spark, sf)
    held = runs.summary(spark, out).groupBy("run").agg(F.sum("total_rows").alias("held_rows"))
    return runs.totals(spark, out).join(held, "run").select("run", "outputs", "total_records", "held_rows")


def shipment_builder(spark, sf) -> Builder:
    n = load(spark, sf, "events").count()
    return Builder.of(spark, samples.shipments(20, max(n // 20, 1), n))


@query
def spec_files(spark, sf):
    """A file source of twenty weekly files as large as the events together."""
    builder = shipment_builder(spark, sf)
    return plain(builder.file_source(builder.spec["files"][0]).drop("__row"))


@query
def spec_api(spark, sf):
    """Records of a page dump with deletion flags and stale times, one per event."""
    builder = shipment_builder(spark, sf)
    return plain(builder.api_records(builder.spec["apis"][0]).withColumnRenamed("__row", "row"))
