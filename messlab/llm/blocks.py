"""Comparing all members of a bucket with each other in blocks of bounded size.

A bucket of up to ``size`` members is one block.  A larger one is dealt by hash
into parts, and every pair of parts becomes a block that holds both, so no
block exceeds about twice ``size`` and hot buckets spread over the cluster.
Blocks are runs of sorted rows; nothing is emitted per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def blocked(rows: DataFrame, bucket: list[str], member: str, size: int, weight: Column | None = None) -> DataFrame:
    """Rows of buckets with two members or more, with columns ``block`` and ``side``, sorted by bucket and block.

    ``side`` is 0 in a block that compares all its rows with each other, else 1
    or 2 for rows that are compared with the other side only.  With ``weight``
    the rows of a part sum up to about 1 at most, too.
    """
    parts = F.ceil(F.greatest(F.col("_n") / size, F.col("_weight"))).cast("int")
    counts = rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n"), F.sum(
        F.lit(0.0) if weight is None else weight).alias("_weight")).where("_n > 1")
    home, other = F.col("_home"), F.col("_other")
    dealt = (rows.join(counts, bucket)
             .withColumn("_parts", parts)
             .withColumn("_home", F.pmod(F.xxhash64(F.col(member), F.lit(17)), F.col("_parts")).cast("int"))
             .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
             .withColumn("block", F.least(home, other) * F.col("_parts") + F.greatest(home, other))
             .withColumn("side", F.when(home == other, 0).when(home < other, 1).otherwise(2))
             .drop("_n", "_weight", "_parts", "_home", "_other"))
    return dealt.repartition(*[F.col(c) for c in [*bucket, "block"]]).sortWithinPartitions(*bucket, "block")


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches as tables that end between runs of equal keys, with the offsets of their runs."""
    rest: pa.Table | None = None

    def starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for k in keys:
            values = table.column(k).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        at = starts(table)
        if len(at) > 1:
            yield table.slice(0, at[-1]), at
            table = table.slice(at[-1])
        rest = table.combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest, np.array([0, rest.num_rows])


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For n members and links i-j: the smallest position each member reaches."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        # The old labels' holders move too, so long chains close in few rounds.
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
