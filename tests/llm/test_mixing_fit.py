"""Rates of op8 against a long accelerated projected gradient over all documents."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from messlab.llm import mixing


def made(shares, soft, seed=0, n=4000):
    draw = np.random.default_rng(seed)
    kind = draw.choice(3, n, p=shares)
    odds = draw.normal(size=(n, 3)) * soft
    odds[np.arange(n), kind] += 4
    p = np.exp(odds)
    return draw.integers(20, 2000, n), p / p.sum(1, keepdims=True)


def least(tokens, p, targets, floor, ceiling):
    """The least squared residual that rates within the limits reach."""
    longest = np.linalg.norm((p * tokens[:, None]).T @ p, 2)
    r = y = np.clip(np.ones(len(tokens)), floor, ceiling)
    a = 1.0
    for _ in range(20_000):
        q = np.clip(y - p @ ((y * tokens) @ p - targets) / longest, floor, ceiling)
        b = (1 + np.sqrt(1 + 4 * a * a)) / 2
        back = ((y - q) * tokens) @ (q - r) > 0
        y, a, r = (q, 1.0, q) if back else (q + (a - 1) / b * (q - r), b, q)
    return r


@pytest.mark.parametrize("shares, soft, weights, floor, ceiling", [
    ((0.949, 0.001, 0.05), 1.5, mixing.WEIGHTS, 0.0, float("inf")),
    ((0.8999, 0.1, 0.0001), 0.3, mixing.WEIGHTS, 0.0, float("inf")),
    ((0.93, 0.001, 0.069), 1.0, (0.93, 0.0, 0.07), 1.0, 4.0),
    ((0.6, 0.3, 0.1), 1.0, mixing.WEIGHTS, 0.5, 1.5)])
def test_fit_is_least_squares(spark, shares, soft, weights, floor, ceiling):
    tokens, p = made(shares, soft)
    table = spark.createDataFrame([(int(t), list(map(float, x))) for t, x in zip(tokens, p)],
                                  "tokens long, posterior array<double>")
    steps, targets = mixing.fit_rates(table, weights, None, floor, ceiling)
    found = table.withColumn("rate", mixing.rate_of(F.col("posterior"), steps, floor, ceiling)).select("rate").toPandas()
    rate = found.rate.to_numpy()
    assert rate.min() >= floor and rate.max() <= ceiling

    def squared(r):
        return (((r * tokens) @ p - targets) ** 2).sum() / targets.sum() ** 2
    assert squared(rate) <= squared(least(tokens, p, targets, floor, ceiling)) * 1.0001 + 1e-10
