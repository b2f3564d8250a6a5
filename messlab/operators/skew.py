"""Joins whose left side may hold a third of its rows under one value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from messlab.functions.rng import quote

# A value is hot when it holds one row in a hundred and more than a task should take.
HOT_SHARE = 0.01
HOT_ROWS = 1 << 20


def hot_values(df: DataFrame, column: str) -> list:
    """The hot values of a column, null included, at most a hundred, from one sketch aggregate.

    The list steers the plan only; results are the same for any list.
    """
    top = F.expr(f"approx_top_k({quote(column)}, 100, 10000)")
    found = df.agg(F.count("*").alias("n"), top.alias("top")).first()
    least = max(HOT_SHARE * found["n"], HOT_ROWS)
    return [t["item"] for t in found["top"] or () if t["count"] >= least]


def is_among(column: str, values: Sequence) -> Column:
    ref = F.col(quote(column))
    listed = ref.isin([v for v in values if v is not None])
    return listed | ref.isNull() if None in values else listed


def split_join(left: DataFrame, right: DataFrame, on: Column, how: str, is_hot: Column,
               hot_right: DataFrame) -> DataFrame:
    """Join the hot left rows to the few right rows they can meet by broadcast, the others as usual.

    ``hot_right`` must be bounded by construction and hold every match of a hot row.
    """
    hot = F.coalesce(is_hot, F.lit(False))
    broadcast = left.filter(hot).join(F.broadcast(hot_right), on, how)
    return broadcast.unionByName(left.filter(~hot).join(right, on, how))


def lookup(left: DataFrame, column: str, right: DataFrame, key: str, how: str,
           hot: Sequence | None = None) -> DataFrame:
    """``how`` (left, left_anti, inner) join on a right key that is distinct; hot left values are split off."""
    on = F.col(quote(column)) == F.col(quote(key))
    hot = hot_values(left, column) if hot is None else list(hot)
    if not hot:
        return left.join(right, on, how)
    return split_join(left, right, on, how, is_among(column, hot), right.filter(is_among(key, hot)))
