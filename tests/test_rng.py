import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from messlab.functions import rng


def reference(words, salt):
    """The draw in Python integers."""
    x = salt[0]
    for i, word in enumerate(words):
        x = x ^ word ^ (salt[1] if i == 1 else 0)
        x = ((x * rng.ABSORB[i % 2]) >> 15) & rng.MASK
    for const, odd in rng.FINISH:
        x = (((x ^ const) * odd) >> 15) & rng.MASK
    return x


def split(key):
    return [key & rng.MASK, (key >> 32) & rng.MASK]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(-2**63, 2**63 - 1), min_size=1, max_size=20), st.integers(0, 99))
def test_draw_matches_integers(spark, keys, seed):
    frame = spark.createDataFrame([(k,) for k in keys], "k bigint")
    dice = rng.Dice(("k",), seed, "scope")
    found = [r[0] for r in frame.select(F.expr(dice.draw("c", 1))).collect()]
    assert found == [reference(split(k), rng.salt_words(seed, "scope", "c", 1)) for k in keys]


def test_independent_of_partitioning(spark):
    def total(parts):
        dice = rng.Dice(("id",), 1, "x")
        return spark.range(0, 10_000, 1, parts).agg(F.sum(F.hash("id", F.expr(dice.draw("c"))))).first()[0]
    assert total(2) == total(7) == total(1)


def test_uniform_and_uncorrelated(spark):
    dice = rng.Dice(("id",), 42, "t")
    frame = spark.range(0, 200_000).select(*[F.expr(dice.unit(f"c{i}")).alias(f"c{i}") for i in range(4)]).toPandas()
    for c in frame:
        counts = np.histogram(frame[c], 100, (0, 1))[0]
        chi = ((counts - 2000) ** 2 / 2000).sum()
        assert 50 < chi < 160
    corr = np.corrcoef(frame.to_numpy().T) - np.eye(4)
    assert abs(corr).max() < 0.012


@pytest.mark.parametrize("n", [1, 2, 7, 5000, 2**31, 2**40])
def test_pick_in_range(spark, n):
    dice = rng.Dice(("id",), 42, "t")
    low, high, distinct = spark.range(50_000).select(F.expr(dice.pick(n, "p")).alias("p")).agg(
        F.min("p"), F.max("p"), F.countDistinct("p")).first()
    assert 0 <= low and high < n
    if n <= 5000:
        assert distinct >= n - 3
    else:
        assert high > 0.99 * n


def test_uuid_shape_and_uniqueness(spark):
    dice = rng.Dice(("id",), 42, "t")
    frame = spark.range(100_000).select(F.expr(rng.uuid_sql(dice, "u")).alias("u"))
    shape = "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-a[0-9a-f]{3}-[0-9a-f]{12}$"
    assert frame.filter(~F.col("u").rlike(shape)).isEmpty()
    assert frame.distinct().count() == 100_000


def test_keys_of_all_types(spark):
    frame = spark.sql("""SELECT * FROM VALUES
        (1, 'a', DATE '2024-01-01', TIMESTAMP_NTZ '2024-01-01 00:00:00.000001', 1.5D),
        (2, 'b', DATE '2024-01-02', TIMESTAMP_NTZ '2024-01-01 00:00:00.000002', 2.5D),
        (3, NULL, NULL, NULL, NULL) AS t(i, s, d, n, x)""")
    for name in frame.columns:
        rolled, dice = rng.roll(frame, name)
        drawn = rng.unroll(rolled.withColumn("r", F.expr(dice.draw("q"))), dice)
        assert drawn.columns == [*frame.columns, "r"]
        assert drawn.select("r").distinct().count() == 3


def test_zone_free_key_ignores_session_zone(spark):
    def drawn():
        frame = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-31 02:30:00.5' AS n")
        rolled, dice = rng.roll(frame, "n")
        return rolled.select(F.expr(dice.draw("q"))).first()[0]
    here = drawn()
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        assert drawn() == here
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
