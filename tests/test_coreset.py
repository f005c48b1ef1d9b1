"""The memory bank's picks against the plain farthest-point method."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelscope.operators import coreset

NAMES = "sample_id bigint, lighting string, zone string, vector array<double>"


def plain(rows, ratio):
    """sample_ids in the order in which they are picked."""
    rows = sorted(rows)
    x, left = np.array([v for _, v in rows]), max(1, int(len(rows) * ratio))
    picks, far = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(picks) < left:
        far[picks] = -1
        picks.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[picks[-1]]) ** 2).sum(axis=1))
    return [rows[i][0] for i in picks]


@pytest.fixture(scope="module")
def units():
    """A unit with most of the rows, one with many equal vectors, one of a single row."""
    rng = np.random.default_rng(4)
    hot = [(int(i), "l", "hot", rng.normal(size=5).round(2).tolist()) for i in rng.permutation(400)]
    equal = [(i, "l", "equal", [float(i % 7), 0.0, 0.0, 0.0, 0.0]) for i in range(90)]
    return hot + equal + [(5, "m", "one", [1.0] * 5)]


@pytest.mark.parametrize("candidates, size, parts", [(1024, 1024, 1), (16, 50, 7), (1, 7, 3), (60, 1000, 2)])
def test_picks_are_the_plain_ones(spark, units, candidates, size, parts):
    df = spark.createDataFrame(units, NAMES).union(spark.createDataFrame([(9999, "l", "hot", None)], NAMES)).repartition(parts)
    ratio = 0.2 if candidates > 1 else 0.03
    got = coreset.memory_bank(df, ratio, candidates=candidates, size=size).orderBy("pick_no").collect()
    for unit in {r[1:3] for r in units}:
        mine = [r for r in got if (r["lighting"], r["zone"]) == unit]
        assert [r["sample_id"] for r in mine] == plain([(r[0], r[3]) for r in units if r[1:3] == unit], ratio)
        assert [r["pick_no"] for r in mine] == list(range(1, len(mine) + 1))
        assert all(r["vector"] == next(u[3] for u in units if u[0] == r["sample_id"] and u[1:3] == unit) for r in mine)


def test_no_rows_no_picks(spark):
    assert coreset.memory_bank(spark.createDataFrame([], NAMES)).count() == 0


def test_every_row_may_be_picked(spark):
    rows = [(i, "l", "z", [float(i % 3)]) for i in range(9)]
    got = coreset.memory_bank(spark.createDataFrame(rows, NAMES), 1.0, candidates=4)
    assert got.count() == 9 and got.select("sample_id").distinct().count() == 9


def test_types_of_the_input_stay(spark):
    df = spark.range(5).select(F.col("id").alias("sample_id"), F.lit("l").alias("lighting"), F.lit("z").alias("zone"), F.array(F.col("id").cast("float")).alias("vector"))
    assert dict(coreset.memory_bank(df).dtypes)["vector"] == "array<float>"


def test_lowering_by_products_is_exact():
    rng = np.random.default_rng(2)
    x, centres = rng.normal(size=(200, 6)) + 1e4, rng.normal(size=(30, 6)) + 1e4
    want = np.min([coreset.squared(x, c) for c in centres], axis=0)
    assert (coreset.lowered(x, np.full(200, np.inf), centres) == want).all()
    assert (coreset.lowered(x, want / 2, centres) == want / 2).all()
