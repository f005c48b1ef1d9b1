import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelscope.operators import ranks


def frame(spark, rows, cols):
    return spark.createDataFrame(rows, cols)


@pytest.mark.parametrize("seed", [1, 2])
def test_rank_passes_match_plain_python_with_a_hot_key(spark, seed):
    rng = random.Random(seed)
    # one key holds most rows and one value a third of them
    rows = [("hot" if i % 10 else "cold", 0.5 if i % 3 == 0 else round(rng.random(), 3), i % 4 == 0) for i in range(3000)]
    df = frame(spark, [(k, v, int(p)) for k, v, p in rows], "k string, v double, p int")
    got = {r["k"]: r for r in ranks.quantiles(df, ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.99}).collect()}
    cuts = {r["k"]: r for r in ranks.rank_cut(df, ["k"], "v", {"t": 0.05}).collect()}
    roc = {r["k"]: r["auroc"] for r in ranks.auroc(df, ["k"], "v", "p").collect()}
    for key in ("hot", "cold"):
        vals = np.array([v for k, v, _ in rows if k == key])
        for name, q in (("a", 0.1), ("b", 0.5), ("c", 0.99)):
            assert got[key][name] == pytest.approx(np.quantile(vals, q))
        desc = sorted(vals, reverse=True)
        assert cuts[key]["t"] == desc[max(0, int(len(desc) * 0.05) - 1)]
        pos = [v for k, v, p in rows if k == key and p]
        neg = [v for k, v, p in rows if k == key and not p]
        wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
        assert roc[key] == pytest.approx(wins / (len(pos) * len(neg)), abs=6e-5)


def test_auroc_known_cases(spark):
    cases = {
        "sep": ([0.1, 0.2, 0.3], [0.7, 0.8, 0.9]),
        "rev": ([0.4, 0.45, 0.5], [0.2, 0.25, 0.3, 0.35]),
        "mix": ([0.1, 0.3, 0.5, 0.7, 0.9], [0.2, 0.4, 0.6, 0.8, 1.0]),
    }
    rows = [(k, v, p) for k, (train, ng) in cases.items() for vals, p in ((train, 0), (ng, 1)) for v in vals]
    got = {r["k"]: r["auroc"] for r in ranks.auroc(frame(spark, rows, "k string, v double, p int"), ["k"], "v", "p").collect()}
    assert got["sep"] == 1.0 and got["rev"] == 0.0 and 0.5 <= got["mix"] <= 0.7


def test_auroc_without_one_side_is_null(spark):
    assert ranks.auroc(frame(spark, [("a", 0.1, 0)], "k string, v double, p int"), ["k"], "v", "p").first()["auroc"] is None


def test_islands_bridge_a_gap_of_one(spark):
    df = frame(spark, [(1, p) for p in (1, 2, 4, 7, 8)], "k int, p int")
    got = ranks.islands(df, ["k"], "p").groupBy("run").agg(F.min("p").alias("a"), F.max("p").alias("b")).collect()
    assert sorted((r["a"], r["b"]) for r in got) == [(1, 4), (7, 8)]
