"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from messlab.llm.storage import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of ``edges(a long, b long)``; the component is its smallest node.

    Each round moves the larger neighbours of a node to its smallest neighbour
    (large star), then the smaller ones (small star), both as joins with a
    minimum per node, so a node with many neighbours is one row of a split
    join and never a collected list.  A round is written out; rounds grow with
    the logarithm of the longest path.  Nodes that only meet themselves are kept.
    """
    a, b, u, v, m = map(F.col, "abuvm")
    edges = stored(edges.select("a", "b").distinct(), "edges")
    pairs = edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    before = None
    while True:
        both = pairs.unionAll(pairs.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least(u, m).alias("m"))
        large = both.join(least, "u").where(v > u).select(v.alias("u"), m.alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.when(v == m, u).otherwise(v).alias("u"), m.alias("v"))
        pairs = stored(small.where(u != v).distinct(), "stars")
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    tops = edges.select(a.alias("node")).unionAll(edges.select(b)).distinct()
    return tops.join(pairs.select(u.alias("node"), v.alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"))
