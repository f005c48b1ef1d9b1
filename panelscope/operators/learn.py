"""Sampling, nearest-neighbour scoring and model quality (M ids)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelscope.operators import ranks
from panelscope.operators.nearest import UNIT, nearest
from panelscope.session import cut_lineage


def seeded_key(*cols: str, seed: int = 42) -> Column:
    """Fixed pseudo-random order of rows."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def seeded_number(*cols: str, seed: int = 42) -> Column:
    """60 bits of ``seeded_key`` as a number."""
    return F.conv(F.substring(seeded_key(*cols, seed=seed), 1, 15), 16, 10).cast("bigint")


def nn_score(vectors: DataFrame, bank: DataFrame, keys: Sequence[str] = UNIT) -> DataFrame:
    """Distance to the nearest bank row of the own unit."""
    return nearest(vectors, bank, keys).select("sample_id", F.col("distance").alias("score"))


def score_into_cache(scores: DataFrame, cache: DataFrame, bundle: int) -> DataFrame:
    """Upsert per (tile, bundle): new scores replace stored ones."""
    new = scores.select(F.col("sample_id").alias("tile_id"), F.lit(bundle).alias("bundle_id"), "score")
    return cache.join(new, ["tile_id", "bundle_id"], "left_anti").unionByName(new)


def score_counters(tiles: DataFrame, scores: DataFrame, cache: DataFrame, bundle: int) -> DataFrame:
    """Tiles asked for, scored, skipped without a score, and those whose stored score was replaced."""
    own = cache.where(F.col("bundle_id") == bundle).select(F.col("tile_id").alias("sample_id"), F.lit(1).alias("_old"))
    joined = tiles.select("sample_id").join(scores.select("sample_id", F.lit(1).alias("_new")), "sample_id", "left").join(own, "sample_id", "left")
    scored = F.col("_new").isNotNull()
    return joined.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(scored).alias("scored"), F.count_if(~scored).alias("skipped"), F.count_if(scored & F.col("_old").isNotNull()).alias("replaced")
    )


def classify_manifest(manifest: DataFrame, vectors: DataFrame, model, positive: str) -> DataFrame:
    """Every row with status ok, with is_positive and the score of ``model``.

    ``vectors``: crop_path, features.  Rows without a crop, or whose crop has no
    vector, are skipped: their score is null.
    """
    rows = manifest.where("status = 'ok'").withColumn("is_positive", (F.col("label") == positive).cast("int"))
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(vectors).select("crop_path", vector_to_array("probability")[1].alias("score"))
    return rows.join(scored, "crop_path", "left")


def classify_counters(classified: DataFrame) -> DataFrame:
    """Total, done and skipped rows."""
    return classified.agg(F.count(F.lit(1)).alias("total"), F.count("score").alias("done"), F.count_if(F.col("score").isNull()).alias("skipped"))


def pool_patches(patches: DataFrame, mode: str = "cls+top5") -> DataFrame:
    """Image vector from patch vectors.  ``patches``: sample_id, patch_no,
    is_cls, vector; patches of one image are few (a 37 x 37 grid)."""
    kinds = {"cls": 0, "max": 1, "cls+max": 2, "cls+anomalous": 3, "cls+top5": 4}
    if mode not in kinds:
        raise ValueError(f"unknown pooling {mode}")

    def pool(pdf: pd.DataFrame) -> pd.DataFrame:
        cls = np.stack(pdf.loc[pdf["is_cls"], "vector"].to_numpy())[0]
        grid = np.stack(pdf.loc[~pdf["is_cls"]].sort_values("patch_no")["vector"].to_numpy()).astype(float)
        away = np.linalg.norm(grid - grid.mean(axis=0), axis=1)
        top = np.argsort(-away, kind="stable")
        part = {
            "cls": [cls], "max": [grid.max(axis=0)], "cls+max": [cls, grid.max(axis=0)],
            "cls+anomalous": [cls, grid[top[0]]], "cls+top5": [cls, grid[top[:5]].mean(axis=0)],
        }[mode]
        return pd.DataFrame({"sample_id": [pdf["sample_id"].iloc[0]], "vector": [np.concatenate(part).tolist()]})

    return patches.groupBy("sample_id").applyInPandas(pool, "sample_id bigint, vector array<double>")


def embed_missing(samples: DataFrame, cache: DataFrame, prep_id: str) -> DataFrame:
    """Samples whose embedding is not cached for this preprocessing."""
    have = cache.where(F.col("preprocessing_id") == prep_id).select("sample_id")
    return samples.join(have, "sample_id", "left_anti")


def id_digest(samples: DataFrame) -> DataFrame:
    """One row that tells sets of sample ids apart: their count and the sum of their hashes, whatever their order."""
    return samples.agg(F.count(F.lit(1)).alias("n"), F.sum(seeded_number("sample_id").cast("decimal(38,0)")).cast("string").alias("digest"))


def load_samples(manifest: DataFrame, listing: DataFrame, positive: str) -> DataFrame:
    """Good rows with an existing crop, a 0/1 label and lenient numbers."""
    files = listing.select(F.col("path").alias("crop_path")).distinct()
    return manifest.where("status = 'ok' AND crop_path <> ''").join(files, "crop_path", "left_semi").select(
        "*", (F.col("label") == positive).cast("int").alias("is_positive"), F.col("ai_score").try_cast("double").alias("score_value")
    )


def group_folds(samples: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """Fold per glass, glasses of a stratum dealt in turn, the largest first.

    A glass belongs to the stratum of its most frequent (label, prefix, source).
    Where one of those has fewer than ``k`` rows, the prefix is left out; if
    that is too few as well, it is an error.
    """
    fine, coarse = F.concat_ws("|", "label", "prefix", "source_type"), F.concat_ws("|", "label", "source_type")
    least = [samples.groupBy(s.alias("s")).count().agg(F.min("count")).first()[0] for s in (fine, coarse)]
    if least[1] is not None and least[1] < k:
        raise ValueError(f"a stratum has {least[1]} rows, fewer than {k} folds")
    stratum = fine if least[0] is not None and least[0] >= k else coarse
    strata = samples.groupBy("glass", stratum.alias("stratum")).agg(F.count(F.lit(1)).alias("n"))
    main = strata.groupBy("glass").agg(F.max(F.struct("n", "stratum")).alias("m"), F.sum("n").alias("rows"))
    # order within a stratum: more rows first, then by hash
    keyed = main.select("glass", F.col("m.stratum").alias("stratum"), "rows", (seeded_number("glass", seed=seed) % (1 << 40)).alias("key"))
    sizes = keyed.groupBy("stratum", "rows").agg(F.count(F.lit(1)).alias("larger"))
    larger = ranks.running_sums(sizes, ["stratum"], "rows", ["larger"], ascending=False).select("stratum", "rows", "before_larger")
    hist = keyed.groupBy("stratum", "rows", "key").agg(F.count(F.lit(1)).alias("cnt"))
    equal = ranks.running_sums(hist, ["stratum", "rows"], "key", ["cnt"]).select("stratum", "rows", "key", "before_cnt")
    return keyed.join(larger, ["stratum", "rows"]).join(equal, ["stratum", "rows", "key"]).select(
        "glass", "stratum", "rows", ((F.col("before_larger") + F.col("before_cnt")) % k).cast("int").alias("fold")
    )


def calibration_split(samples: DataFrame, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Whole glasses in seeded order until ``share`` of the rows."""
    g = samples.groupBy("glass").agg(F.count(F.lit(1)).alias("rows")).withColumn("key", seeded_number("glass", seed=seed))
    run = ranks.running_sums(g.groupBy("key").agg(F.sum("rows").alias("rows")), [], "key", ["rows"])
    total = g.agg(F.sum("rows")).scalar()
    return g.join(run.select("key", "before_rows"), "key").select(
        "glass", "rows", (F.col("before_rows") < total * F.lit(share)).alias("is_calibration")
    )


def fit_logreg(train: DataFrame, max_iter: int = 100):
    """Balanced logistic regression with C = 1; ``train``: features, label."""
    from pyspark.ml.classification import LogisticRegression

    counts = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per label
    rows = sum(counts.values())
    weight = F.lit(0.0)
    for label, n in counts.items():
        weight = F.when(F.col("label") == label, rows / (len(counts) * n)).otherwise(weight)
    # weights add up to the row count, so the penalty per unit weight is 1 / n
    model = LogisticRegression(weightCol="weight", regParam=1.0 / max(rows, 1), standardization=False, maxIter=max_iter)
    return model.fit(train.withColumn("weight", weight))


def logreg_scores(train: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (features and others) with the score and prediction of a model of ``train``."""
    from pyspark.ml.functions import vector_to_array

    out = fit_logreg(train).transform(rows).withColumn("score", vector_to_array("probability")[1])
    return out.withColumn("prediction", F.col("prediction").cast("int")).drop("rawPrediction", "probability", "features")


def base_scores(train: DataFrame, test: DataFrame, gbt_rounds: int, neighbours: int) -> dict[str, DataFrame]:
    """sample_id, label, score of ``test`` by each model of ``train``; features standardised on ``train``."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import vector_to_array

    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(train)
    train, test = scaler.transform(train), scaler.transform(test)
    out = {}
    for name, model in (("logreg", fit_logreg(train)), ("gbt", GBTClassifier(maxIter=gbt_rounds, maxDepth=3, seed=42).fit(train))):
        out[name] = model.transform(test).select("sample_id", "label", vector_to_array("probability")[1].alias("score"))
    near = nearest(test.select("sample_id", "vector"), train.select("sample_id", "vector"), [], neighbours, "cosine")
    votes = near.join(train.select(F.col("sample_id").alias("bank_id"), F.col("label").alias("near_label")), "bank_id").groupBy("sample_id").agg(F.avg("near_label").alias("score"))
    out["knn"] = test.select("sample_id", "label").join(votes, "sample_id")
    return out


def compare(vectors: DataFrame, folds: DataFrame, k: int, gbt_rounds: int = 10, inner: int = 3, neighbours: int = 5) -> DataFrame:
    """Test scores of logistic regression, boosted trees and k nearest
    neighbours over folds, plain and calibrated (isotonic, sigmoid).

    ``vectors``: sample_id, glass, is_positive, vector; ``folds``: glass, fold.
    Rows: fold, model, calibration, sample_id, is_positive, score.  Calibration
    maps are cross-fitted: the training glasses of a fold are cut into ``inner``
    parts, and each part is scored by models of the others.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    if inner < 2:
        raise ValueError("cross-fitting takes two parts or more")
    # read by every fit, so both are tables: the rows, and all scores of a fold
    data = cut_lineage(vectors.join(folds.select("glass", "fold"), "glass").select(
        "sample_id", "fold", (seeded_number("glass", seed=7) % inner).alias("part"), F.col("is_positive").cast("double").alias("label"),
        array_to_vector(F.col("vector").cast("array<double>")).alias("raw"), "vector",
    ), "compare-rows")
    out = None
    for fold in range(k):
        train, test = data.where(F.col("fold") != fold), data.where(F.col("fold") == fold)
        halves = [(train.where(F.col("part") != p), train.where(F.col("part") == p), False) for p in range(inner)] + [(train, test, True)]
        both = None
        for known, asked, is_test in halves:
            for name, rows in base_scores(known, asked, gbt_rounds, neighbours).items():
                one = rows.select(F.lit(name).alias("model"), F.lit(is_test).alias("is_test"), "sample_id", "label", "score")
                both = one if both is None else both.unionByName(one)
        both = cut_lineage(both.withColumn("x", array_to_vector(F.array("score"))), "compare-scores")
        for name in ("logreg", "gbt", "knn"):
            rows = both.where((F.col("model") == name) & F.col("is_test"))
            fit_on = both.where((F.col("model") == name) & ~F.col("is_test"))
            maps = {
                "none": rows.select("*", F.col("score").alias("final")),
                "isotonic": IsotonicRegression(featuresCol="score", predictionCol="final").fit(fit_on).transform(rows),
                "sigmoid": LogisticRegression(featuresCol="x").fit(fit_on).transform(rows).withColumn("final", vector_to_array("probability")[1]),
            }
            for kind, done in maps.items():
                one = done.select(
                    F.lit(fold).alias("fold"), "model", F.lit(kind).alias("calibration"), "sample_id", F.col("label").cast("int").alias("is_positive"), F.col("final").alias("score")
                )
                out = one if out is None else out.unionByName(one)
    return out


def compare_metrics(scored: DataFrame) -> DataFrame:
    """Per model and calibration n, positives, AUC (ties count half), Brier score and log loss; no group is ranked in one task."""
    keys = ["model", "calibration"]
    hist = scored.groupBy(*keys, "score").agg(F.sum("is_positive").alias("pos"), F.count_if(F.col("is_positive") == 0).alias("neg"))
    below = ranks.running_sums(hist, keys, "score", ["neg"])
    wins = below.groupBy(*keys).agg(F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)).alias("wins"))
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("score")))
    sums = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("is_positive").alias("positives"), F.avg(F.pow(F.col("score") - F.col("is_positive"), F.lit(2))).alias("brier"),
        F.avg(-F.when(F.col("is_positive") == 1, F.log(p)).otherwise(F.log(1 - p))).alias("log_loss"),
    )
    pairs = F.col("positives") * (F.col("n") - F.col("positives"))
    return sums.join(wins, keys).select(*keys, "n", "positives", F.when(pairs > 0, F.col("wins") / pairs).alias("auc"), "brier", "log_loss")


def knn_score(train: DataFrame, test: DataFrame, k: int = 7) -> DataFrame:
    """Share of positives among the k nearest by cosine."""
    near = nearest(test, train, [], k, "cosine").join(
        train.select(F.col("sample_id").alias("bank_id"), "is_positive"), "bank_id"
    )
    return near.groupBy("sample_id").agg(F.avg("is_positive").alias("score"))


def fold_thresholds(scored: DataFrame) -> DataFrame:
    """Per fold the greatest true-NG score of train (realistic) and test
    (oracle) and the share of test positives strictly above each.

    ``scored``: fold, part (train / test), is_true_ng, is_positive, score.
    """
    low = F.lit(float("-inf"))
    ng = F.col("is_true_ng") == 1
    cuts = scored.groupBy("fold").agg(
        F.coalesce(F.max(F.when(ng & (F.col("part") == "train"), F.col("score"))), low).alias("realistic"),
        F.coalesce(F.max(F.when(ng & (F.col("part") == "test"), F.col("score"))), low).alias("oracle"),
    )
    test = scored.where("part = 'test' AND is_positive = 1").join(cuts, "fold")
    above = lambda c: F.avg((F.col("score") > F.col(c)).cast("int"))
    got = test.groupBy("fold").agg(above("realistic").alias("realistic_recall"), above("oracle").alias("oracle_recall"))
    return cuts.join(got, "fold", "left").fillna(0.0, ["realistic_recall", "oracle_recall"])


def conformal(calibration: DataFrame, test: DataFrame, safety: float = 1.1) -> DataFrame:
    """Threshold from calibration true-NG scores, recall and leak on test."""
    top = calibration.where("is_true_ng = 1").agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("m")).select(
        F.least(F.col("m") * safety, F.lit(0.9999)).alias("t")
    )
    hit = F.col("score") > top.scalar()
    pos, ng = F.col("is_positive") == 1, F.col("is_true_ng") == 1
    return test.agg(
        F.max(top.scalar()).alias("threshold"),
        (F.count_if(pos & hit) / F.greatest(F.lit(1), F.count_if(pos))).alias("recall"),
        (F.count_if(ng & hit) / F.greatest(F.lit(1), F.count_if(ng))).alias("leak"),
    )


def missed(scored: DataFrame, cuts: DataFrame) -> DataFrame:
    """Test positives at or below the realistic threshold of their fold."""
    return scored.where("part = 'test' AND is_positive = 1").join(cuts.select("fold", "realistic"), "fold").where("score <= realistic")


def calibrate(scores: DataFrame, seed: int = 42, sample: int = 100, threshold: float = 0.5) -> DataFrame:
    """100 seeded train scores and all NG scores per unit, with the
    constant threshold; the row limit is applied before the shuffle."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*UNIT).orderBy("_key", "sample_id")
    train = scores.where("is_ng = 0").withColumn("_key", seeded_key("sample_id", seed=seed)).withColumn("_rn", F.row_number().over(w))
    return train.where(F.col("_rn") <= sample).drop("_key", "_rn").unionByName(scores.where("is_ng = 1")).withColumn("threshold", F.lit(threshold))


def training_table(pool: DataFrame, units: int = 10, minimum: int = 30) -> DataFrame:
    """Used tiles per unit; nothing is published unless every unit has
    enough.  Ids stay rows, so a unit of any size fits."""
    used = pool.where("source = 'ok' AND decision = 'accept'")
    counts = used.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= minimum)
    ready = counts.agg(F.count(F.lit(1)).alias("u")).scalar()
    return used.join(counts, list(UNIT)).where(ready == units).select(*UNIT, "id", "n")


def append_history(history: DataFrame, entry: DataFrame) -> DataFrame:
    """M19."""
    return history.unionByName(entry, allowMissingColumns=True)


def newest_entry(history: DataFrame) -> DataFrame:
    return ranks.latest_by(history, ["lighting", "zone"], ["trained_at", "entry_no"])
