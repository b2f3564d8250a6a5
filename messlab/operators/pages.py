"""Paged JSON dumps: fixed-size pages in an envelope, browsing, and appending.

Pages are written as JSON Lines, one envelope a line, in a directory per block
of pages.  A block holds a bounded number of rows and is the shuffle key, so a
dump takes one shuffle and browsing a page reads one block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from messlab.operators.index import columns_of, dense_index, refs
from messlab.operators.shape import KEEP_NULLS

PAGES_PER_BLOCK = 1000
ROWS_PER_BLOCK = 1_000_000


def block_pages(page_size: int) -> int:
    """Pages per block: a thousand, fewer when pages are so large that a block would pass a million rows."""
    return max(1, min(PAGES_PER_BLOCK, ROWS_PER_BLOCK // page_size))


def paginate(df: DataFrame, order_by: Sequence[str] | str, page_size: int) -> DataFrame:
    """Add ix, page, total_records and total_pages in the order of the unique ``order_by``."""
    return with_pages(dense_index(df, order_by, name="ix", total="total_records"), page_size)


def with_pages(indexed: DataFrame, page_size: int) -> DataFrame:
    return (indexed
            .withColumn("page", F.expr(f"ix div {page_size}L") + 1)
            .withColumn("total_pages", F.expr(f"(total_records + {page_size - 1}L) div {page_size}L")))


def envelopes(paged: DataFrame, api: str, page_size: int, columns: Sequence[str], *,
              pages_per_block: int | None = None) -> DataFrame:
    """One row per page: block, api, page, page_size, total_pages, total_records, data."""
    pages_per_block = pages_per_block or block_pages(page_size)
    record = F.struct(*refs(columns))
    rows = paged.select(
        F.expr(f"(page - 1) div {pages_per_block}L").alias("block"), "page", "total_pages", "total_records",
        F.struct(F.col("ix"), record.alias("record")).alias("item"))
    pages = (rows.repartition("block").groupBy("block", "page")
             .agg(F.max("total_pages").alias("total_pages"), F.max("total_records").alias("total_records"),
                  F.sort_array(F.collect_list("item")).alias("items")))
    return pages.select(
        "block", F.lit(api).alias("api"), "page", F.lit(page_size).cast("long").alias("page_size"),
        "total_pages", "total_records", F.transform("items", lambda item: item["record"]).alias("data"))


def empty_page(like: DataFrame, api: str, page_size: int, columns: Sequence[str]) -> DataFrame:
    """The single page of a dump without rows."""
    record = T.StructType([like.schema[c] for c in columns])
    return like.sparkSession.range(1).select(
        F.lit(0).cast("long").alias("block"), F.lit(api).alias("api"), F.lit(1).cast("long").alias("page"),
        F.lit(page_size).cast("long").alias("page_size"), F.lit(1).cast("long").alias("total_pages"),
        F.lit(0).cast("long").alias("total_records"),
        F.from_json(F.lit("[]"), T.ArrayType(record)).alias("data"))


def page_dump(df: DataFrame, order_by: Sequence[str] | str, api: str, page_size: int, *,
              columns: Sequence[str] | None = None, pages_per_block: int | None = None) -> DataFrame:
    columns = list(columns or df.columns)
    if df.isEmpty():
        return empty_page(df, api, page_size, columns)
    return envelopes(paginate(df, order_by, page_size), api, page_size, columns,
                     pages_per_block=pages_per_block)


def write_pages(pages: DataFrame, path: str, mode: str = "errorifexists") -> None:
    pages.write.mode(mode).options(**KEEP_NULLS).partitionBy("block").json(path)


def page_schema(record: T.StructType) -> T.StructType:
    return T.StructType([
        T.StructField("api", T.StringType()), T.StructField("page", T.LongType()),
        T.StructField("page_size", T.LongType()), T.StructField("total_pages", T.LongType()),
        T.StructField("total_records", T.LongType()), T.StructField("data", T.ArrayType(record)),
        T.StructField("block", T.LongType())])


def read_pages(spark: SparkSession, path: str, record: T.StructType) -> DataFrame:
    return spark.read.schema(page_schema(record)).options(**KEEP_NULLS).json(path)


def layout(pages: DataFrame) -> int | None:
    """Pages per block of a written dump, from the first page of block 1; None if block 0 holds all pages."""
    first = pages.filter("block = 1").agg(F.min("page")).first()[0]
    return None if first is None else first - 1


def browse(pages: DataFrame, page: int) -> DataFrame:
    """One page of a written dump of any layout; the block filter prunes all other directories."""
    return pages.filter((F.col("block") == (page - 1) // (layout(pages) or page)) & (F.col("page") == page))


def records(pages: DataFrame) -> DataFrame:
    """Rows of the pages in their place: ix and the record's columns."""
    return (pages.select("page", "page_size", F.posexplode("data").alias("at", "record"))
            .select(((F.col("page") - 1) * F.col("page_size") + F.col("at")).alias("ix"), "record.*"))


def append_pages(pages: DataFrame, new: DataFrame, order_by: Sequence[str] | str | None = None) -> DataFrame:
    """The dump after appending ``new``: full pages keep their rows, only the tail is paged again.

    The layout is the dump's own; one that fits into block 0 goes on with its page size's usual blocks.
    Without ``order_by`` the new rows already hold their positions in ``ix``.
    Every envelope gets the new totals; write the result to a new directory.
    """
    head = pages.filter("block = 0 AND page = 1").select("api", "page_size", "total_records").first()
    api, size, old_total = head["api"], head["page_size"], head["total_records"]
    added = new.count()
    total = old_total + added
    total_pages = max(1, -(-total // size))
    full = old_total // size
    columns = [f.name for f in pages.schema["data"].dataType.elementType.fields]
    kept = pages.filter(F.col("page") <= full).withColumns({
        "total_pages": F.lit(total_pages).cast("long"), "total_records": F.lit(total).cast("long")})
    pages_per_block = layout(pages) or max(block_pages(size), -(-old_total // size))
    tail = browse(pages, full + 1) if old_total % size else None
    indexed = new if order_by is None else dense_index(new, columns_of(order_by))
    shifted = indexed.select((F.col("ix") + old_total).alias("ix"), *refs(columns))
    rows = shifted if tail is None else records(tail).unionByName(shifted)
    placed = with_pages(rows.withColumn("total_records", F.lit(total).cast("long")), size)
    fresh = envelopes(placed, api, size, columns, pages_per_block=pages_per_block)
    return kept.select(*fresh.columns).unionByName(fresh)


def page_counts(df: DataFrame, page_size: int) -> DataFrame:
    """total_records and total_pages, at least one page."""
    return df.agg(F.count("*").alias("total_records")).withColumn(
        "total_pages", F.greatest(F.lit(1).cast("long"),
                                  F.expr(f"(total_records + {page_size - 1}L) div {page_size}L")))
