"""Key pools and foreign keys that point at real parent keys."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, types as T

from messlab.functions.rng import Dice, quote, roll, unroll, uuid_sql
from messlab.operators import skew
from messlab.operators.index import columns_of, fits, hash_index, key_width, sample
from messlab.sources.workspace import scratch

FEW_PARENTS = 1000

PICK = "__pick"


@dataclass(frozen=True)
class KeyPool:
    """``frame`` holds (ix, key) with ix dense from 0; ``small`` if it may be broadcast."""

    frame: DataFrame
    size: int
    small: bool
    key_type: T.DataType

    def joinable(self) -> DataFrame:
        return F.broadcast(self.frame) if self.small else self.frame


def measured(df: DataFrame, columns: Sequence[str]) -> bool:
    """Whether the rows, counted and weighed by these columns, may be broadcast."""
    rows, width = df.agg(F.count("*"), F.coalesce(F.sum(key_width(columns)), F.lit(0))).first()
    return fits(rows, width)


def candidate_keys(df: DataFrame, pk: str, cap: int | None, seed: int) -> DataFrame:
    """Distinct non-null keys, thinned by hash before the distinct when far above ``cap``.

    The cap smallest (hash, key) are wanted and a hash threshold commutes with
    distinct, so a parent of any size shuffles little more than ``cap`` keys.
    The thinned keys are written once; the steps that follow read those.
    """
    keys = df.select(F.col(quote(pk)).alias("key")).na.drop()
    if cap is None:
        return stored(keys.distinct(), "keys")
    expected = keys.agg(F.approx_count_distinct("key", 0.02).alias("n")).first()["n"]
    share = 1.0 if expected <= 1.5 * cap else 1.5 * cap / expected
    rolled, dice = roll(keys, "key", seed, "key pool")
    while share < 1:
        kept = rolled.filter(F.expr(f"{dice.draw('order')} < {round(share * (1 << 32))}L"))
        thinned = stored(unroll(kept, dice).distinct(), "keys")
        if thinned.count() >= cap:
            return thinned
        share *= 2
    return keys.distinct()


def stored(df: DataFrame, label: str) -> DataFrame:
    """The frame written to shared scratch space and read back."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def key_pool(df: DataFrame, pk: str, cap: int | None = None, *, seed: int = 42) -> KeyPool:
    """Distinct non-null keys of ``pk``: all of them, or a uniform choice of ``cap`` if there are more.

    The pool is written once, so every foreign key that draws from it reads the
    same few keys instead of deriving them from the parent again.
    """
    keys = candidate_keys(df, pk, cap, seed)
    size = keys.count()
    if cap is not None and size > cap:
        keys = sample(keys, "key", cap, seed=seed, scope="key pool")
        size = cap
    indexed = hash_index(keys, "key", seed=seed, scope="key pool", rows=size)
    pool = stored(indexed.select("ix", "key"), "pool")
    return KeyPool(pool, size, measured(pool, ["key"]), df.schema[pk].dataType)


def fk_sample(child: DataFrame, key: Sequence[str] | str, pool: KeyPool, name: str, *,
              orphan_pct: float = 0.0, seed: int = 42, scope: str = "") -> DataFrame:
    """Add ``name``: a parent key per row, uniform with replacement, some rows orphaned.

    Orphans, and all rows when the pool is empty, hold fresh uuids.  The join is
    on a uniform position, so no parent key can make it skewed.
    """
    rolled, dice = roll(child, key, seed, scope)
    fresh = uuid_sql(dice, name)
    if pool.size == 0:
        return unroll(rolled.withColumn(name, F.expr(fresh)), dice)
    pick = dice.pick(pool.size, name, "parent")
    if orphan_pct > 0:
        pick = f"CASE WHEN {dice.chance(orphan_pct, name, 'orphan')} THEN {nowhere(dice, name)} ELSE {pick} END"
    parents = pool.joinable().select(F.col("ix").alias(PICK), F.col("key").alias("__parent"))
    joined = rolled.withColumn(PICK, F.expr(pick)).join(parents, PICK, "left")
    value = F.col("__parent")
    if orphan_pct > 0:
        value = F.when(F.col(PICK) < 0, F.expr(fresh)).otherwise(value.cast("string"))
    return unroll(joined.withColumn(name, value).drop(PICK, "__parent"), dice)


def nowhere(dice: Dice, name: str) -> str:
    """A negative position, which no parent has.

    Rows without a parent keep apart in a shuffle this way; nulls would all
    meet in one task.
    """
    return f"(-1L - {dice.draw(name, 'nowhere')})"


def fk_sample_within(child: DataFrame, key: Sequence[str] | str, child_by: str, parent: DataFrame,
                     parent_by: str, parent_key: str, name: str, *, orphan_pct: float = 0.0,
                     seed: int = 42, scope: str = "") -> DataFrame:
    """Like :func:`fk_sample`, with the parents of the same group (day) only.

    Rows whose group has no parent hold fresh uuids.  Group sizes and the pool
    are broadcast only after their size was measured; beyond that the joins
    shuffle, with the rows of hot groups split off.
    """
    pairs = stored(parent.select(F.col(quote(parent_by)).alias("__by"), F.col(quote(parent_key)).alias("__parent"))
                   .na.drop().distinct(), "pairs")
    groups = pairs.groupBy("__by").agg(F.count("*").alias("__size"))
    small_groups, small_pool = measured(groups, ["__by"]), measured(pairs, ["__by", "__parent"])
    pool = hash_index(pairs, ["__by", "__parent"], by="__by", seed=seed, scope="key pool", name="__ix")

    rolled, dice = roll(child, key, seed, scope)
    if small_groups:
        sized = rolled.join(F.broadcast(groups), rolled[child_by] == groups["__by"], "left").drop("__by")
    else:
        sized = skew.lookup(rolled, child_by, groups, "__by", "left").drop("__by")
    pick = dice.wide_pick("`__size`", name, "parent")
    orphan = dice.chance(orphan_pct, name, "orphan")
    sized = sized.withColumn(PICK, F.expr(
        f"CASE WHEN `__size` IS NULL OR {orphan} THEN {nowhere(dice, name)} ELSE {pick} END"))
    same = (F.col(quote(child_by)) == F.col("__by")) & (F.col(PICK) == F.col("__ix"))
    hot = [] if small_pool else skew.hot_values(child, child_by)
    if small_pool:
        joined = sized.join(F.broadcast(pool), same, "left")
    elif hot:
        # A hot group with few parents has hot parents: at most a hundred groups times FEW_PARENTS keys.
        few = pool.filter(skew.is_among("__by", hot) & (F.col("__ix") < FEW_PARENTS))
        crowded = skew.is_among(child_by, hot) & (F.coalesce(F.col("__size"), F.lit(0)) <= FEW_PARENTS)
        joined = skew.split_join(sized, pool, same, "left", crowded, few)
    else:
        joined = sized.join(pool, same, "left")
    value = F.when(F.col(PICK) < 0, F.expr(uuid_sql(dice, name))).otherwise(F.col("__parent").cast("string"))
    return unroll(joined.withColumn(name, value).drop(PICK, "__ix", "__size", "__by", "__parent"), dice)


def fresh_keys(df: DataFrame, key: Sequence[str] | str, name: str, *, seed: int = 42,
               scope: str = "") -> DataFrame:
    """Add ``name``: one fresh uuid per row, as for a foreign key that has no parent."""
    rolled, dice = roll(df, columns_of(key), seed, scope)
    return unroll(rolled.withColumn(name, F.expr(uuid_sql(dice, name))), dice)
