"""Nearest rows by cells and bounds against all pairs."""

import numpy as np
import pytest

from panelscope.operators import nearest as module
from panelscope.operators.nearest import nearest, nearest_with_pairs

NAMES = "sample_id bigint, lighting string, zone string, vector array<double>"


def frame(spark, rows):
    return spark.createDataFrame([(int(i), u, "z", None if v is None else [float(c) for c in v]) for i, u, v in rows], NAMES)


def plain(queries, bank, k, metric):
    out = {}
    for i, u, q in queries:
        d = []
        for j, w, b in bank:
            if u == w and q is not None and b is not None:
                q_, b_ = np.array(q, float), np.array(b, float)
                n = np.linalg.norm(q_) * np.linalg.norm(b_)
                d.append((1 - (q_ @ b_ / n if n else 0.0) if metric == "cosine" else np.sqrt(((q_ - b_) ** 2).sum()), j))
        out[i] = [(j, s) for s, j in sorted((round(s, 9), j) for s, j in d)[:k]]
    return {i: v for i, v in out.items() if v}


def rows(n, start, seed, units=("a", "a", "a", "b", "c")):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(0).normal(size=(12, 4)) * 20
    out = [(start + i, units[i % len(units)], (centres[rng.integers(12)] + rng.normal(size=4)).round(3)) for i in range(n)]
    return out + [(start + n, "a", [0.0] * 4), (start + n + 1, "a", None)]


@pytest.mark.parametrize("metric, k, size, pivots, small", [
    ("l2", 1, 1024, 64, 0), ("cosine", 7, 16, 9, 0), ("l2", 7, 16, 9, 0), ("cosine", 400, 50, 5, 0), ("l2", 7, 16, 9, 4096), ("cosine", 400, 50, 5, 4096),
])
def test_nearest_equals_all_pairs(spark, monkeypatch, metric, k, size, pivots, small):
    monkeypatch.setattr(module, "SMALL", small)
    bank = rows(300, 0, 1)
    queries = rows(120, 1000, 2) + [(5000, "nowhere", [1.0] * 4), (6000, "b", bank[3][2])]
    got = {}
    for r in nearest(frame(spark, queries).repartition(3), frame(spark, bank), k=k, metric=metric, size=size, pivots=pivots).orderBy("rank").collect():
        got.setdefault(r["sample_id"], []).append((r["bank_id"], round(r["distance"], 9)))
    want = plain(queries, bank, k, metric)
    assert got.keys() == want.keys()
    for i in want:
        assert [s for _, s in got[i]] == pytest.approx([s for _, s in want[i]], abs=1e-8)
        assert len({j for j, _ in got[i]}) == len(want[i])


def test_ties_go_to_smaller_ids(spark, monkeypatch):
    monkeypatch.setattr(module, "SMALL", 0)
    bank = [(i, "a", [float(i % 2), 0.0]) for i in range(40)]
    got = nearest(frame(spark, [(1, "a", [0.0, 0.0])]), frame(spark, bank), k=3, size=4, pivots=6).orderBy("rank").collect()
    assert [r["bank_id"] for r in got] == [0, 2, 4]


def test_cells_that_cannot_hold_a_neighbour_do_not_meet(spark, monkeypatch):
    monkeypatch.setattr(module, "SMALL", 0)
    bank, queries = rows(2000, 0, 1, ("a",)), rows(500, 5000, 2, ("a",))
    met = nearest_with_pairs(frame(spark, queries), frame(spark, bank), k=3, size=128).met.first()
    assert met["pairs_of_units"] == 501 * 2001 and met["pairs_met"] < met["pairs_of_units"] / 4


def test_without_keys_or_rows(spark):
    bank = rows(50, 0, 1)
    got = nearest(frame(spark, bank), frame(spark, bank), [], 1).collect()
    assert {r["sample_id"]: r["distance"] for r in got} == {i: 0.0 for i, _, v in bank if v is not None}
    assert nearest(frame(spark, []), frame(spark, bank)).count() == 0 and nearest(frame(spark, bank), frame(spark, [])).count() == 0


def test_ties_with_many_copies_stay_small():
    import tracemalloc

    x, ids = np.ones((512, 128)) / np.sqrt(128), np.arange(512)
    tracemalloc.start()
    got = module.best(ids, x, ids, x, 3, "cosine")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got["bank_id"].tolist() == [0, 1, 2] * 512
    assert peak < 384 << 20  # all pairs of vectors at once took 524 MiB
