"""Row positions, exact samples and running values without a single-task window.

Rows are cut into buckets by a function of the row itself, either its hash or
its place among literal split points.  Bucket sizes come from a map-side
aggregate over the key columns; their prefix sums place every bucket, and only
the order inside one bucket is left to a window.  Because the bucket depends on
nothing but the row, a retried or re-run stage lands on the same positions, so
no checkpoint is needed between the passes.

Key columns must be unique per row; a shared leading value is split by the
columns that follow it.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from messlab.functions.rng import quote, roll, unroll

HASH, BUCKET, OFFSET, TOTAL = "__hash", "__bucket", "__offset", "__total"
# What one task sorts without trouble, and what is sent to every executor.
ROWS_PER_WINDOW = 1 << 20
BROADCAST_BYTES = 64 << 20
# Rows a range has at least, and keys sampled per range, when a table is cut into ranges of like size.
ROWS_PER_RANGE = 10_000
KEYS_PER_RANGE = 500
JSON_FORMATS = {
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
}


def columns_of(names: Sequence[str] | str) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def refs(names: Sequence[str]) -> list[Column]:
    return [F.col(quote(n)) for n in names]


def key_width(names: Sequence[str]) -> Column:
    """Bytes of the columns as text, an upper bound of their width for the usual types."""
    widths = [F.coalesce(F.octet_length(F.col(quote(n)).cast("string")), F.lit(0)) for n in names]
    return sum(widths[1:], widths[0]).cast("long")


def fits(rows: int, width: int) -> bool:
    """Small enough to broadcast: key bytes plus 40 bytes a row for the hash table."""
    return width + 40 * rows <= BROADCAST_BYTES


def parallelism(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bucket_bits(df: DataFrame) -> int:
    """Hash buckets: 64 per shuffle partition, between 2**10 and 2**18."""
    return min(max((64 * parallelism(df) - 1).bit_length(), 10), 18)


# ---------------------------------------------------------------- hash order

def with_hash(df: DataFrame, key: Sequence[str] | str, seed: int, scope: str, bits: int) -> DataFrame:
    rolled, dice = roll(df, key, seed, scope)
    hashed = rolled.withColumn(HASH, F.expr(dice.draw("order")))
    return unroll(hashed, dice).withColumn(BUCKET, F.shiftright(HASH, 32 - bits).cast("int"))


def _offsets(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows before each bucket, and rows in all; a group has a bounded number of buckets."""
    before = Window.partitionBy(*refs(by)).orderBy(BUCKET).rowsBetween(
        Window.unboundedPreceding, -1)
    return (counts
            .withColumn(OFFSET, F.coalesce(F.sum("count").over(before), F.lit(0)))
            .withColumn(TOTAL, F.sum("count").over(Window.partitionBy(*refs(by))))
            .drop("count"))


def _placed(bucketed: DataFrame, order: Sequence[Column], name: str, total: str | None) -> DataFrame:
    offsets = _offsets(bucketed.groupBy(BUCKET).count(), ())
    rank = F.row_number().over(Window.partitionBy(BUCKET).orderBy(*order))
    placed = bucketed.join(F.broadcast(offsets), BUCKET).withColumn(name, rank + F.col(OFFSET) - 1)
    if total:
        placed = placed.withColumn(total, F.col(TOTAL))
    return placed.drop(BUCKET, OFFSET, TOTAL, HASH)


def hash_index(df: DataFrame, key: Sequence[str] | str, *, by: Sequence[str] | str = (), seed: int = 42,
               scope: str = "index", name: str = "ix", total: str | None = None,
               rows: int | None = None) -> DataFrame:
    """Positions 0..n-1 in the order of (hash, key), within each group of ``by``.

    ``rows`` is the number of rows where the caller has counted them: what one
    task can sort is ranked by one window without buckets.
    """
    key, by = columns_of(key), columns_of(by)
    if by:
        return _group_index(df, key, by, seed, scope, name, total)
    hashed = with_hash(df, key, seed, scope, bucket_bits(df))
    order = [F.col(HASH), *refs(key)]
    if rows is not None and rows <= ROWS_PER_WINDOW and not total:
        ranked = hashed.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long") - 1)
        return ranked.drop(HASH, BUCKET)
    return _placed(hashed, order, name, total)


def _group_index(df: DataFrame, key: Sequence[str], by: Sequence[str], seed: int, scope: str, name: str,
                 total: str | None) -> DataFrame:
    """Positions within groups; a group larger than a window's share is cut into hash buckets.

    Group sizes decide how many: a group of n rows gets the power of two that
    leaves about ROWS_PER_WINDOW rows a bucket, so one group with a third of
    the table is ranked by many tasks and small groups cost nothing extra.
    """
    hashed = with_hash(df, key, seed, scope, 0)
    order = [F.col(HASH), *refs(key)]
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col(TOTAL) / ROWS_PER_WINDOW))).cast("int")
    sizes = df.groupBy(*refs(by)).agg(F.count("*").alias(TOTAL)).withColumn("__bits", bits)
    large = sizes.filter("__bits > 0")
    buckets = F.expr("shiftleft(1L, __bits)")
    parts, width = large.agg(F.coalesce(F.sum(buckets), F.lit(0)),
                             F.coalesce(F.sum(buckets * key_width(by)), F.lit(0))).first()
    if not parts:
        group = Window.partitionBy(*refs(by))
        placed = hashed.withColumn(name, F.row_number().over(group.orderBy(*order)).cast("long") - 1)
        if total:
            placed = placed.withColumn(total, F.count("*").over(group))
        return placed.drop(HASH, BUCKET)
    # Large groups are few, one per ROWS_PER_WINDOW rows of the table at most; the rest keep one bucket.
    small = fits(parts, width)
    sized = _match(hashed, large, by, broadcast=small)
    bucketed = sized.withColumn(BUCKET, F.expr(f"CAST(shiftright({HASH}, 32 - coalesce(__bits, 0)) AS INT)"))
    counts = bucketed.filter("__bits > 0").groupBy(*refs(by), BUCKET).count()
    joined = _match(bucketed, _offsets(counts, by).drop(TOTAL), [*by, BUCKET], broadcast=small)
    bucket = Window.partitionBy(*refs(by), BUCKET)
    placed = joined.withColumn(
        name, F.row_number().over(bucket.orderBy(*order)) + F.coalesce(F.col(OFFSET), F.lit(0)) - 1)
    if total:
        placed = placed.withColumn(total, F.coalesce(F.col(TOTAL), F.count("*").over(bucket)))
    return placed.drop(BUCKET, OFFSET, TOTAL, HASH, "__bits")


def _match(df: DataFrame, side: DataFrame, on: Sequence[str], *, broadcast: bool) -> DataFrame:
    """Left join on columns that may be null; null matches null."""
    marks = {c: f"__on_{i}" for i, c in enumerate(on)}
    right = side.withColumnsRenamed(marks)
    match = F.lit(True)
    for c, mark in marks.items():
        match &= F.col(quote(c)).eqNullSafe(F.col(mark))
    return df.join(F.broadcast(right) if broadcast else right, match, "left").drop(*marks.values())


def sample_condition(df: DataFrame, key: Sequence[str] | str, k: int | None = None, *,
                     fraction: float | None = None, seed: int = 42,
                     scope: str = "sample") -> tuple[DataFrame, Column, int]:
    """Exactly ``k`` rows (or max(1, floor(n * fraction))) drawn without replacement.

    Returns the frame with its hash column, the condition that holds for the
    drawn rows, and k.  The draw is the k smallest (hash, key); a histogram of
    hash buckets finds the one bucket the cut falls in, and the last drawn key
    of that bucket becomes a literal, so the table itself is not shuffled.
    """
    key = columns_of(key)
    bits = bucket_bits(df)
    hashed = with_hash(df, key, seed, scope, bits)
    sizes = hashed.groupBy(BUCKET).count().orderBy(BUCKET).collect()
    n = sum(size["count"] for size in sizes)
    if k is None:
        k = max(1, int(n * fraction)) if fraction > 0 else 0
    k = min(k, n)
    if k == n or k == 0:
        return hashed, F.lit(k > 0), k
    seen = 0
    for size in sizes:
        if seen + size["count"] >= k:
            break
        seen += size["count"]
    order = [HASH, *key]
    last = (hashed.filter(F.col(BUCKET) == size[BUCKET])
            .select(*refs(order)).orderBy(*refs(order)).offset(k - seen - 1).limit(1)
            .select(F.to_json(F.struct(*refs(order)), JSON_FORMATS).alias("key")).first()["key"])
    cut = json.loads(last)[HASH]
    # The hash alone decides nearly every row; only ties look at the key.
    tied = (F.col(HASH) == cut) & (F.struct(*refs(order)) <= _literal(hashed, order, last))
    return hashed, (F.col(HASH) < cut) | tied, k


def sample(df: DataFrame, key: Sequence[str] | str, k: int | None = None, *,
           fraction: float | None = None, seed: int = 42, scope: str = "sample") -> DataFrame:
    hashed, drawn, _ = sample_condition(df, key, k, fraction=fraction, seed=seed, scope=scope)
    return hashed.filter(drawn).drop(HASH, BUCKET)


# ------------------------------------------------------------- natural order

def _schema(df: DataFrame, order_by: Sequence[str]) -> T.StructType:
    return T.StructType([df.schema[name] for name in order_by])


def _literal(df: DataFrame, order_by: Sequence[str], json_text: str) -> Column:
    return F.from_json(F.lit(json_text), _schema(df, order_by), JSON_FORMATS)


def split_points(df: DataFrame, order_by: Sequence[str], parts: int) -> list[str]:
    """First key, as JSON, of each range partition Spark makes of a sample of the key columns.

    Any points give right positions; a sample is enough for ranges of like size.
    A small table gets fewer than ``parts`` ranges.
    """
    keys = df.select(*refs(order_by))
    n = max(keys.count(), 1)
    parts = min(parts, -(-n // ROWS_PER_RANGE))
    share = KEYS_PER_RANGE * parts / n
    if share < 0.5:
        keys = keys.sample(share, seed=1)
    firsts = (keys.repartitionByRange(parts, *refs(order_by))
              .groupBy(F.spark_partition_id().alias("part"))
              .agg(F.min(F.struct(*refs(order_by))).alias("first"))
              .orderBy("part")
              .select(F.to_json("first", JSON_FORMATS).alias("first")))
    return [row["first"] for row in firsts.collect()]


def with_range_bucket(df: DataFrame, order_by: Sequence[str], parts: int | None = None) -> DataFrame:
    """Add the number of the range the row's key falls in, by binary search over literals."""
    points = split_points(df, order_by, parts or min(4 * parallelism(df), 8192))
    # An array literal: one constant in the plan, folded before execution.
    bounds = F.from_json(F.lit("[" + ",".join(points[1:]) + "]"),
                         T.ArrayType(_schema(df, order_by)), JSON_FORMATS)
    bucketed = df.withColumn(BUCKET, F.lit(0))
    step = 1 << (max(len(points) - 1, 1).bit_length() - 1)
    while step and len(points) > 1:
        reached = F.struct(*refs(order_by)) >= F.get(bounds, F.col(BUCKET) + (step - 1))
        bucketed = bucketed.withColumn(
            BUCKET, F.col(BUCKET) + F.when(F.coalesce(reached, F.lit(False)), step).otherwise(0))
        step >>= 1
    return bucketed


def dense_index(df: DataFrame, order_by: Sequence[str] | str, *, name: str = "ix",
                total: str | None = None) -> DataFrame:
    """Positions 0..n-1 in the order of the unique columns ``order_by``."""
    order_by = columns_of(order_by)
    return _placed(with_range_bucket(df, order_by), refs(order_by), name, total)


def first_rows(df: DataFrame, order_by: Sequence[str] | str, k: int, n: int) -> Column:
    """Condition for the first ``k`` of ``n`` rows in order; the table is not shuffled."""
    order_by = columns_of(order_by)
    if k <= 0 or k >= n:
        return F.lit(k >= n)
    keys = with_range_bucket(df.select(*refs(order_by)), order_by)
    seen = 0
    for row in keys.groupBy(BUCKET).count().orderBy(BUCKET).collect():
        if seen + row["count"] >= k:
            break
        seen += row["count"]
    last = (keys.filter(F.col(BUCKET) == row[BUCKET]).orderBy(*refs(order_by))
            .offset(k - seen - 1).limit(1)
            .select(F.to_json(F.struct(*refs(order_by)), JSON_FORMATS).alias("key")).first()["key"])
    return F.struct(*refs(order_by)) <= _literal(df, order_by, last)


def running_max(df: DataFrame, value: str, order_by: Sequence[str] | str, name: str, *,
                by: Sequence[str] | str = ()) -> DataFrame:
    """Largest ``value`` among the earlier rows of the same ``by``; null for the first row.

    A group is spread over the ranges of the order, so a hot one is no single
    task; the tops of ranges are broadcast only where there are no groups.
    """
    order_by, by = columns_of(order_by), columns_of(by)
    bucketed = with_range_bucket(df, order_by)
    tops = bucketed.groupBy(*refs(by), BUCKET).agg(F.max(F.col(quote(value))).alias("top"))
    earlier = Window.partitionBy(*refs(by)).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    groups = {f"__by{i}": c for i, c in enumerate(by)}
    tops = tops.select(*[ref.alias(g) for g, ref in zip(groups, refs(by))], F.col(BUCKET).alias("__range"),
                       F.max("top").over(earlier).alias("__top"))
    same = F.col(BUCKET) == F.col("__range")
    for group, column in groups.items():
        same = same & F.col(quote(column)).eqNullSafe(F.col(group))
    within = Window.partitionBy(*refs(by), BUCKET).orderBy(*refs(order_by)).rowsBetween(
        Window.unboundedPreceding, -1)
    return (bucketed.join(tops if by else F.broadcast(tops), same)
            .withColumn(name, F.greatest("__top", F.max(F.col(quote(value))).over(within)))
            .drop(BUCKET, "__range", "__top", *groups))
