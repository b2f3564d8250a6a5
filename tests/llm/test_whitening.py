"""Whitening against plain numpy over whole numbers."""

import math
import random

import numpy as np
import pytest

from messlab.llm import whitening
from messlab.llm.workers import importable


@pytest.fixture(scope="module", autouse=True)
def workers(spark):
    importable(spark)


def plain(rows):
    """{(id, component): (n, deviation, |whitened|, explained)} by matrix products of Python integers."""
    kept = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = {}
    for d in {len(x) for _, x in kept} - {0}:
        own = [(i, x) for i, x in kept if len(x) == d]
        fit = np.array(sorted({tuple(x) for _, x in own}), object)
        n, sums = len(fit), fit.sum(0)
        v = ((fit * n - sums).T @ (fit * n - sums)).astype(float) / float(n) ** 3
        e, axes = np.linalg.eigh(v)
        order = [k for k in np.argsort(-e) if e[k] > 1e-12 * np.trace(v)][:4]
        for i, x in own:
            centred = np.array([(n * a - s) / n for a, s in zip(x, sums)])
            for c, k in enumerate(order):
                out[i, c + 1] = (n, sum((n * a - s) ** 2 for a, s in zip(x, sums)),
                                 abs(centred @ axes[:, k]) / math.sqrt(e[k]), e[k] / np.trace(v))
    return out


def same(found, wanted):
    assert {(r.vec_id, r.component) for r in found} == set(wanted) and len(found) == len(wanted)
    for r in found:
        n, deviation, whitened, explained = wanted[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(r.whitened) == pytest.approx(whitened, abs=1e-7) and r.explained == pytest.approx(explained, rel=1e-9)
        assert r.identity_error < 1e-9


def test_embeddings(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    same(whitening.whitened(table).collect(), plain([(r.vec_id, r.embedding) for r in table.collect()]))


def made(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


@pytest.mark.parametrize("span", [3.0, 1e4, 6e6])
def test_ranges(spark, span):
    """Short and long bit planes; the widest entries outgrow a long in products."""
    draw = random.Random(5)
    rows = [(k, [draw.uniform(-span, span) * (j + 1) / 3 for j in range(3)]) for k in range(150)]
    found, wanted = whitening.whitened(made(spark, rows)).collect(), plain(rows)
    for r in found:
        assert r.deviation == (wanted[r.vec_id, r.component][1] if wanted[r.vec_id, r.component][1] < 1 << 63 else None)
        assert abs(r.whitened) == pytest.approx(wanted[r.vec_id, r.component][2], rel=1e-6, abs=1e-7)
    assert len(found) == len(wanted)


def test_signs_agree(spark):
    draw = np.random.default_rng(1)
    rows = [(k, draw.normal(size=5).tolist()) for k in range(200)]
    found = whitened_array(spark, rows)
    assert np.abs(np.cov(found.T, bias=True) - np.eye(4)).max() < 1e-6


def whitened_array(spark, rows):
    out = np.zeros((len(rows), 4))
    for r in whitening.whitened(made(spark, rows)).collect():
        out[r.vec_id, r.component - 1] = r.whitened
    return out


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None), (1, [1.0, None]), (2, [nan, 1.0]), (3, [1.0, inf]), (4, []), (5, [1.0, 2.0]), (6, [1.0, 2.0]),
            (7, [-1.5, 2.25]), (8, [0.25, -7.0]), (9, [4.0]), (10, [0.0, 0.0, 0.0]), (11, [1.0, 1.0, 1.0]), (12, [-0.0, 0.0, 0.0]),
            (13, [1e30, 0.0])]
    same(whitening.whitened(made(spark, rows)).collect(), plain(rows[:13]))


def test_columns_and_empty_tables(spark):
    table = spark.createDataFrame([(None, [1.0, 2.0], 1, "x"), (None, [1.0, 2.0], 1, "x"), (3, [5.0, 1.0], 2, "y")],
                                  "vec_id long, embedding array<float>, x int, component string")
    assert whitening.whitened(table).count() == 3
    assert whitening.whitened(table.limit(0)).count() == 0
    assert whitening.whitened(table.where("vec_id is null")).count() == 0  # one distinct vector


@pytest.mark.parametrize("least", [0, 1 << 40])
def test_fits_beyond_the_broadcast_bound(spark, monkeypatch, least):
    monkeypatch.setattr(whitening, "BROADCAST", least)
    draw = random.Random(2)
    rows = [(k, [draw.uniform(-2, 2) for _ in range(1 + k % 5)]) for k in range(300)]
    same(whitening.whitened(made(spark, rows)).collect(), plain(rows))


def test_cross_products():
    draw = np.random.default_rng(0)
    for n, d, span in [(1, 1, 1), (63, 3, 5), (64, 4, 1000), (1000, 7, 1 << 20), (130, 2, 1 << 31)]:
        x = draw.integers(-span, span, (n, d))
        assert (whitening.cross_products(x) == x.astype(object).T @ x.astype(object)).all()
