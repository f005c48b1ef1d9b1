"""Scores of the models against plain fits."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from panelscope.operators import learn as L


def rows_of(seed, n, width=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(scale=0.5, size=n) > 0.6).astype(int)
    return x, y


def plain_logreg(x, y):
    """Balanced weights, C = 1, intercept without penalty: Newton steps."""
    n = len(y)
    weight = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    a = np.hstack([x, np.ones((n, 1))])
    ridge = np.diag([1.0] * x.shape[1] + [0.0])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve(a.T @ (a * (weight * p * (1 - p))[:, None]) + ridge, a.T @ (weight * (p - y)) + ridge @ w)
    return 1 / (1 + np.exp(-a @ w))


def test_logreg_scores_match_newton_steps(spark):
    x, y = rows_of(1, 300)
    train = spark.createDataFrame([(i, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, y))], "sample_id bigint, v array<double>, label int")
    train = train.select("sample_id", array_to_vector("v").alias("features"), "label")
    got = {r["sample_id"]: r for r in L.logreg_scores(train, train).collect()}
    want = plain_logreg(x, y)
    assert all(abs(got[i]["score"] - p) < 2e-3 and got[i]["label"] == y[i] and got[i]["prediction"] == int(got[i]["score"] > 0.5) for i, p in enumerate(want))


def test_manifest_rows_keep_their_scores(spark):
    x, y = rows_of(2, 120)
    known = spark.createDataFrame([(f"c{i}", v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, y))], "crop_path string, v array<double>, label int")
    known = known.select("crop_path", array_to_vector("v").alias("features"), "label")
    manifest = spark.createDataFrame([(1, "c3", "bad", "ok"), (2, "c4", "good", "ok"), (3, None, "bad", "ok"), (4, "c999", "bad", "ok"), (5, "c5", "bad", "failed")], "line_no int, crop_path string, label string, status string")
    got = {r["line_no"]: r for r in L.classify_manifest(manifest, known.select("crop_path", "features"), L.fit_logreg(known), "bad").collect()}
    want = plain_logreg(x, y)
    assert set(got) == {1, 2, 3, 4} and got[3]["score"] is None and got[4]["score"] is None
    assert abs(got[1]["score"] - want[3]) < 2e-3 and abs(got[2]["score"] - want[4]) < 2e-3 and [got[i]["is_positive"] for i in (1, 2)] == [1, 0]


def test_comparison_scores_and_metrics(spark):
    x, y = rows_of(3, 200)
    rows = [(i, f"g{i // 4}", int(t), v.tolist()) for i, (v, t) in enumerate(zip(x, y))]
    vectors = spark.createDataFrame(rows, "sample_id bigint, glass string, is_positive int, vector array<double>")
    folds = spark.createDataFrame([(f"g{i}", i % 2) for i in range(50)], "glass string, fold int")
    got = L.compare(vectors, folds, 2, gbt_rounds=2, inner=2).toPandas()
    fold = np.array([(i // 4) % 2 for i in range(200)])
    assert len(got) == 200 * 9 and (got.fold.to_numpy() == fold[got.sample_id.to_numpy()]).all() and got.score.between(0, 1).all()
    # nearest neighbours: five others by cosine
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    knn = got[(got.model == "knn") & (got.calibration == "none")].set_index("sample_id").score
    for i in range(0, 200, 9):
        others = np.flatnonzero(fold != fold[i])
        near = others[np.lexsort((others, -(unit[others] @ unit[i]).round(12)))[:5]]
        assert abs(knn[i] - y[near].mean()) < 1e-9
    logreg = got[(got.model == "logreg") & (got.calibration == "none")].set_index("sample_id").score
    for f in (0, 1):
        train = fold != f
        mean, sd = x[train].mean(axis=0), x[train].std(axis=0, ddof=1)
        z = (x - mean) / sd
        # a plain fit on the training fold, applied to the other: fitted values of the training rows fix the weights
        a = np.hstack([z[train], np.ones((train.sum(), 1))])
        w = np.linalg.lstsq(a, np.log(plain_logreg(z[train], y[train]) / (1 - plain_logreg(z[train], y[train]))), rcond=None)[0]
        want = 1 / (1 + np.exp(-(np.hstack([z, np.ones((200, 1))]) @ w)))
        assert all(abs(logreg[i] - want[i]) < 5e-3 for i in np.flatnonzero(~train))
    metrics = L.compare_metrics(spark.createDataFrame(got)).toPandas()
    assert len(metrics) == 9
    for r in metrics.itertuples():
        own = got[(got.model == r.model) & (got.calibration == r.calibration)]
        pos, neg = own[own.is_positive == 1].score.to_numpy(), own[own.is_positive == 0].score.to_numpy()
        auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
        assert abs(r.auc - auc) < 1e-9 and abs(r.brier - ((own.score - own.is_positive) ** 2).mean()) < 1e-9 and r.n == 200
    # cross-fitted maps keep the order of what they map
    assert metrics.set_index(["model", "calibration"]).loc[("logreg", "sigmoid")].auc > 0.8
    with pytest.raises(ValueError):
        L.compare(vectors, folds, 2, inner=1)
