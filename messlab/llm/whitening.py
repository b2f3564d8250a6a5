"""Operator 12, whitening of embeddings from an exact bit-sliced scatter.

An entry c becomes the integer x = floor(256 c).  The fit list is each distinct
integer vector once, of all rows.  Each task shifts its vectors by the least
entry of every dimension, packs each bit of a dimension across rows into words,
and adds the bits that two planes share, weighed by both places: the exact
cross-products of the shifted entries, from which those of the unshifted ones
follow.  Spark sums the products of all tasks as decimals.  The covariance is
centred in whole numbers, n * product - sum * sum, before it becomes floating
point and is taken apart by ``eigh`` in a task for each vector length.

Vectors of different lengths have nothing in common: each length has a fit of its own
and ``n`` counts its fit list.  Components are numbered by falling eigenvalue;
the entry of a component that is largest in magnitude (the first such) is positive.  Directions in which
the fit list does not vary cannot be whitened and have no rows, so a
length with one distinct vector gives none, and neither do empty vectors.

Rows with a null vector or a null or non-finite entry are dropped, and so are
rows with an entry of magnitude 2^23 or more, for which exact sums would outgrow a
decimal.  All other rows, repeated ones and null ids included, give their rows.  ``deviation`` is null where it
outgrows a long.  Other columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from messlab.llm.storage import stored

COMPONENTS = 4
#: Magnitude of an entry, rows that are sliced together, bytes of fits that may be broadcast, copies of fits otherwise.
LIMIT, ROWS, BROADCAST, COPIES = 1 << 23, 1 << 14, 64 << 20, 64


def cross_products(x: np.ndarray) -> np.ndarray:
    """Exact sums over rows of the products of two columns of a long matrix, as Python integers where they outgrow longs."""
    n, d = x.shape
    low = x.min(0)
    y = (x - low).astype(np.uint64)
    bits = max(1, int(y.max()).bit_length())
    exact = object if 2 * int(np.abs(x).max()).bit_length() + n.bit_length() > 58 else np.int64
    # planes[b, i]: bit b of dimension i, 64 rows in a word.
    padded = np.zeros((-(-n // 64) * 64, d), np.uint64)
    padded[:n] = y
    across = np.ascontiguousarray(padded.T)
    planes = np.stack([np.packbits((across >> np.uint64(b) & np.uint64(1)).astype(np.uint8), axis=1).view(np.uint64)
                       for b in range(bits)])
    flat = planes.reshape(bits * d, -1)
    shifted = np.zeros((d, d), exact)
    for a in range(bits):
        for i in range(d):
            shared = np.bitwise_count(planes[a, i] & flat[a * d:]).sum(1, dtype=np.int64).reshape(bits - a, d)
            for b in range(a, bits):
                weighed = shared[b - a].astype(exact) << (a + b)
                shifted[i] += weighed
                if b > a:  # the same pair of planes with the dimensions' parts exchanged
                    shifted[:, i] += weighed
    sums, low = y.astype(np.int64).sum(0).astype(exact), low.astype(exact)
    return shifted + np.outer(low, sums) + np.outer(sums, low) + n * np.outer(low, low)


SCATTER = ["d", "i", "j", "product"]


def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (x), distinct integer vectors: this task's sums of products by (length, i, j), i <= j.

    Row and sums come as products with a constant entry, j = -1: (i, -1) is a sum, (-1, -1) the number of rows.
    """
    totals: dict[int, list] = {}
    for batch in batches:
        lists = batch.column("x")
        lengths = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy()
        starts = np.cumsum(lengths) - lengths
        for d in np.unique(lengths).tolist():
            if not d:
                continue
            own = starts[lengths == d]
            for k in range(0, len(own), ROWS):
                x = flat[own[k:k + ROWS, None] + np.arange(d)].astype(np.int64)
                found = totals.setdefault(d, [0, np.zeros(d, object), np.zeros((d, d), object)])
                found[0] += len(x)
                found[1] += x.sum(0).astype(object)
                found[2] += cross_products(x).astype(object)
    for d, (n, sums, products) in totals.items():
        i, j = np.triu_indices(d)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(1 + d + len(i), d, np.int32)), pa.array(np.concatenate([[-1], np.arange(d), i]).astype(np.int32)),
             pa.array(np.concatenate([np.full(1 + d, -1), j]).astype(np.int32)),
             pa.array([n, *sums.tolist(), *products[i, j].tolist()], pa.decimal128(38, 0))], SCATTER)


def fitted(components: int):
    """For applyInPandas over a length's sums: one row with n, sums and up to ``components`` components."""
    def fit(sums: pd.DataFrame) -> pd.DataFrame:
        d = int(sums["d"].iloc[0])
        i, j = sums["i"].to_numpy(), sums["j"].to_numpy()
        value = np.array([int(v) for v in sums["product"]], object)
        n = int(value[(i < 0)][0])
        total = np.zeros(d, object)
        total[i[(i >= 0) & (j < 0)]] = value[(i >= 0) & (j < 0)]
        centred = np.zeros((d, d), object)
        pair = j >= 0
        centred[i[pair], j[pair]] = value[pair]
        centred[j[pair], i[pair]] = value[pair]
        centred = centred * n - np.outer(total, total)
        v = np.array([[c / (n * n) for c in row] for row in centred.tolist()], float)  # a quotient of whole numbers
        e, vectors = np.linalg.eigh(v)
        order = np.argsort(-e, kind="stable")
        trace = float(np.trace(v))
        order = [k for k in order.tolist() if e[k] > trace * d * 1e-14][:components]
        axes = vectors[:, order].T
        largest = np.abs(axes).argmax(1)
        axes = axes * np.sign(axes[np.arange(len(axes)), largest])[:, None]
        return pd.DataFrame({"d": [d], "n": [n], "sums": [[int(s) for s in total]], "mean": [[s / n for s in total]],
                             "axes": [axes.tolist()], "root": [[float(np.sqrt(e[k])) for k in order]],
                             "explained": [[float(e[k] / trace) for k in order]]})
    return fit


FIT = ("d int, n long, sums array<long>, mean array<double>, axes array<array<double>>, root array<double>, "
       "explained array<double>")


def integral(embeddings: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, x) of the rows that remain, x as an array of int."""
    v = F.col(vector)
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LIMIT)
    rows = embeddings.select(F.col(id).alias("id"), v.alias("v")).where(F.col("v").isNotNull() & F.forall("v", fine))
    return rows.select("id", F.transform("v", lambda c: F.floor(c.cast("double") * 256).cast("int")).alias("x"))


def with_fit(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """Rows with the fit of their length; one length may hold nearly all rows, so small fits travel and large ones are copied."""
    held = fits.agg(F.coalesce(F.sum(F.col("d").cast("long") * 8 * (COMPONENTS + 2) + 100), F.lit(0)).alias("b")).first()["b"]
    if held <= BROADCAST:
        return rows.join(F.broadcast(fits), F.size("x") == F.col("d"))
    copies = fits.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    dealt = rows.withColumn("copy", F.pmod(F.monotonically_increasing_id(), F.lit(COPIES)).cast("int"))
    return dealt.withColumn("d", F.size("x")).join(copies, ["d", "copy"]).drop("copy")


def projected(rows: DataFrame) -> DataFrame:
    """Rows with a fit, one for each component: component, whitened, explained."""
    axis, mean = F.col("axes")[F.col("k")], F.col("mean")
    centred = F.zip_with("x", mean, lambda x, m: x - m)
    parts = rows.withColumn("centred", centred).withColumn("k", F.explode(F.sequence(F.lit(0), F.size("root") - 1)))
    dot = F.aggregate(F.zip_with("centred", axis, lambda x, a: x * a), F.lit(0.0), lambda s, v: s + v)
    return (parts.withColumn("whitened", dot / F.col("root")[F.col("k")])
            .withColumn("component", F.col("k") + 1).withColumn("explained", F.col("explained")[F.col("k")])
            .drop("centred", "k"))


def identity_errors(distinct: DataFrame, fits: DataFrame) -> DataFrame:
    """(d, identity_error): the largest entry of the whitened fit list's covariance minus the identity, in magnitude."""
    whole = with_fit(distinct, fits.where(F.size("root") > 0))
    centred = whole.withColumn("c", F.zip_with("x", "mean", lambda x, m: x - m))
    w = F.transform(F.arrays_zip("axes", "root"), lambda a: F.aggregate(
        F.zip_with("c", a["axes"], lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v) / a["root"])
    own = centred.select("d", w.alias("w"))
    kept = range(COMPONENTS)
    at = lambda a: F.get(F.col("w"), a)
    sums = own.groupBy("d").agg(*[F.avg(at(a)).alias(f"m{a}") for a in kept],
                                *[F.avg(at(a) * at(b)).alias(f"p{a}_{b}") for a in kept for b in range(a, COMPONENTS)])
    worst = F.greatest(*[F.coalesce(F.abs(F.col(f"p{a}_{b}") - F.col(f"m{a}") * F.col(f"m{b}") - (1.0 if a == b else 0.0)),
                                    F.lit(0.0)) for a in kept for b in range(a, COMPONENTS)])
    return sums.select(F.col("d").alias("e_d"), worst.alias("identity_error"))


def whitened(embeddings: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per remaining row and component: id, component, n, deviation, whitened, explained, identity_error."""
    rows = integral(embeddings, id, vector)
    distinct = stored(rows.select("x").distinct(), "distinct-vectors")
    parts = distinct.mapInArrow(scatter, "d int, i int, j int, product decimal(38,0)")
    sums = parts.groupBy("d", "i", "j").agg(F.sum("product").cast("decimal(38,0)").alias("product"))
    fits = stored(sums.groupBy("d").applyInPandas(fitted(COMPONENTS), FIT), "fits")
    errors = identity_errors(distinct, fits)
    fits = stored(fits.join(errors, F.col("d") == F.col("e_d")).drop("e_d"), "fits-measured")
    whole = with_fit(rows, fits)
    # Longs hold the sum of squares while n times the widest entry, squared and summed, stays below 2^62.
    bound = F.aggregate("x", F.lit(0), lambda m, x: F.greatest(m, F.abs(x)))
    short = (F.col("n") * 2.0 * F.greatest(bound, F.aggregate(
        "mean", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x))))) ** 2 * F.col("d") < float(1 << 62)
    long = F.aggregate(F.zip_with("x", "sums", lambda x, s: (F.col("n") * x - s) * (F.col("n") * x - s)),
                       F.lit(0).cast("long"), lambda a, b: a + b)
    wide = F.zip_with("x", "sums", lambda x, s: F.col("n").cast("decimal(18,0)") * x.cast("decimal(18,0)")
                      - s.cast("decimal(19,0)"))
    exact = F.aggregate(wide, F.lit(0).cast("decimal(38,0)"),
                        lambda a, b: F.try_add(a, F.try_multiply(b, b).cast("decimal(38,0)")).cast("decimal(38,0)"))
    measured = whole.withColumn("deviation", F.when(short, long).otherwise(exact.try_cast("long")))
    return projected(measured).select(F.col("id").alias(id), "component", "n", "deviation", "whitened", "explained",
                                      "identity_error")
