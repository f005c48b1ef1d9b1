"""Look-ups between inspection and re-inspection, and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelscope.functions.text import ric_judgment
from panelscope.operators import ranks
from panelscope.operators.search import ai_err, ai_ng, aoi_ng, day_range


def share(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(F.when(whole > 0, part * 100.0 / whole).otherwise(0.0), digits)


def same_day_latest(accuracy: DataFrame, records: DataFrame) -> DataFrame:
    """Id of the latest record of the same glass and day.

    Records are reduced per (glass, day) first, so the join keeps one row per
    accuracy row and a hot glass never meets itself.
    """
    latest = (
        records.groupBy(F.col("glass_id").alias("pnl_id"), F.to_date("request_time").alias("_day"))
        .agg(F.max(F.struct("request_time", "id")).alias("m"))
        .select("pnl_id", "_day", F.col("m.id").alias("inference_record_id"))
    )
    return accuracy.withColumn("_day", F.to_date("time_stamp")).join(latest, ["pnl_id", "_day"], "left").drop("_day")


def accuracy_with_reviews(
    accuracy: DataFrame, miss: DataFrame, over: DataFrame, start: str | None = None, end: str | None = None
) -> DataFrame:
    """J02."""
    return (
        accuracy.where(day_range("time_stamp", start, end))
        .join(
            miss.select(F.col("client_record_id").alias("id"), F.col("category").alias("miss_category"), F.col("note").alias("miss_note")),
            "id", "left",
        )
        .join(
            over.select(F.col("client_record_id").alias("id"), F.col("category").alias("over_category"), F.col("note").alias("over_note")),
            "id", "left",
        )
    )


def ric_comparison(records: DataFrame, ric: DataFrame, batch_id: int | None = None) -> DataFrame:
    """Record with the last loaded re-inspection row of its glass."""
    if batch_id is not None:
        ric = ric.where(F.col("batch_id") == batch_id)
    last = ranks.latest_by(
        ric.select(F.col("pnl_id").alias("glass_id"), F.col("id").alias("ric_id"), "mach_id", "datastr", "ric_judgment"),
        ["glass_id"], ["ric_id"],
    )
    prefix = lambda c: F.substring(c, 1, 6)
    return records.join(last, "glass_id", "left").select(
        "id", "glass_id", "machine_no", "machine_judgment", "ai_judgment", "created_at",
        F.coalesce("ric_judgment", F.lit("OK")).alias("ric_judgment"),
        F.coalesce("datastr", F.lit("")).alias("ric_datastr"),
        F.col("ric_id").isNotNull().alias("ric_found"),
        F.coalesce(prefix("mach_id") == prefix("machine_no"), F.lit(False)).alias("machine_match"),
    )


def dust_affected(images: DataFrame, edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Records with a dust-only image, or a good image owning a dusty edge."""
    dusty_edges = edges.where("is_dust = 1").select(F.col("image_result_id").alias("id")).distinct()
    only = images.where("is_dust_only = 1").select("record_id")
    owned = images.where("is_ng = 0").join(dusty_edges, "id", "left_semi").select("record_id")
    found = only.unionByName(owned).distinct()
    if ids is not None:
        found = found.join(ids, "record_id", "left_semi")
    return found


def rescue_stats(tiles: DataFrame, images: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Rescued tiles and their distinct images per record.

    Tiles are counted per image first: the distinct count then needs no
    expansion of the rows.
    """
    per_image = tiles.where("scratch_filtered = 1").groupBy("image_result_id").agg(F.count(F.lit(1)).alias("n"))
    joined = per_image.join(images.select(F.col("id").alias("image_result_id"), "record_id"), "image_result_id")
    stats = joined.groupBy("record_id").agg(F.count(F.lit(1)).alias("images"), F.sum("n").alias("tiles"))
    if ids is not None:
        stats = stats.join(ids, "record_id", "left_semi")
    return stats


def machine_stats(records: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """The window per machine; the all-machines row has machine NULL."""
    since = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS")
    measured = [
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("ai_judgment") == "OK").alias("ok"),
        F.count_if(ai_ng()).alias("ng"),
        F.count_if(ai_err()).alias("err"),
        F.round(F.avg("processing_seconds"), 6).alias("avg_seconds"),
        F.max("processing_seconds").alias("max_seconds"),
        F.min("processing_seconds").alias("min_seconds"),
    ]
    return records.where(F.col("created_at") >= since).rollup("machine_no").agg(*measured)


def shift_start(ts: str = "request_time") -> Column:
    """Start of the 12-hour shift (08:00 or 20:00) holding ``ts``."""
    hours = F.floor((F.hour(ts) + 4) / 12)  # 0: before 08:00, 1: day, 2: night
    day = F.date_trunc("DAY", F.col(ts)).cast("timestamp_ntz")
    return F.when(hours == 0, day - F.expr("INTERVAL 4 HOURS")).when(hours == 1, day + F.expr("INTERVAL 8 HOURS")).otherwise(
        day + F.expr("INTERVAL 20 HOURS")
    )


def shift_stats(records: DataFrame) -> DataFrame:
    """Every shift; rates are over the rows without an error."""
    g = records.groupBy(shift_start().alias("shift_start")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("ai_judgment") == "OK").alias("ok"),
        F.count_if(ai_ng()).alias("ng"),
        F.count_if(ai_err()).alias("err"),
        F.round(F.avg("processing_seconds"), 6).alias("avg_seconds"),
        F.sum("omit_overexposed").alias("overexposed"),
    )
    valid = F.col("total") - F.col("err")
    return g.withColumns(
        {
            "shift": F.when(F.hour("shift_start") == 8, "day").otherwise("night"),
            "ok_rate": share(F.col("ok"), valid),
            "ng_rate": share(F.col("ng"), valid),
        }
    )


def _window(records: DataFrame, start: str | None, end: str | None) -> DataFrame:
    return records.where(day_range("request_time", start, end))


def cross_matrix(records: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """A03."""
    aoi, ng, err = aoi_ng(), ai_ng(), ai_err()
    return _window(records, start, end).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(aoi).alias("aoi_ng"),
        F.count_if(ng).alias("ai_ng"),
        F.count_if(aoi & (F.col("ai_judgment") == "OK")).alias("ai_revival"),
        F.count_if(err).alias("err"),
        F.count_if(~aoi & ~ng & ~err).alias("ok_ok"),
        F.count_if(aoi & ~ng & ~err).alias("ng_ok"),
        F.count_if(~aoi & ng & ~err).alias("ok_ng"),
        F.count_if(aoi & ng & ~err).alias("ng_ng"),
    )


def daily_trend(records: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """A04."""
    return (
        _window(records, start, end)
        .groupBy(F.date_format("request_time", "yyyy-MM-dd").alias("day"))
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(aoi_ng()).alias("aoi_ng"),
            F.count_if(ai_ng()).alias("ai_ng"),
            F.count_if(ai_err()).alias("err"),
        )
    )


def machine_rates(records: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """A05."""
    n = F.count(F.lit(1))
    return (
        _window(records, start, end)
        .groupBy("machine_no")
        .agg(
            n.alias("total"),
            F.round(F.count_if(aoi_ng()) * 100.0 / n, 1).alias("aoi_ng_rate"),
            F.round(F.count_if(ai_ng()) * 100.0 / n, 1).alias("ai_ng_rate"),
        )
    )


def model_counts(records: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """A06."""
    return _window(records, start, end).groupBy("model_id").agg(F.count(F.lit(1)).alias("total"))


def error_types(records: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """A07."""
    blank = F.lit("")
    kind = F.coalesce(
        F.nullif(F.trim(F.expr("substring(ai_judgment, 5)")), blank), F.nullif(F.trim("error_message"), blank), F.lit("Unknown")
    )
    return _window(records, start, end).where(ai_err()).groupBy(kind.alias("error_type")).agg(F.count(F.lit(1)).alias("total"))


def ric_accuracy(records: DataFrame, ric: DataFrame, batch_id: int | None = None) -> DataFrame:
    """Overall, per day and per machine in one pass (grouping sets)."""
    two = lambda c: F.when(F.col(c) == "OK", "OK").otherwise("NG")
    rows = ric_comparison(records, ric, batch_id).select(
        F.date_format("created_at", "yyyy-MM-dd").alias("day"),
        "machine_no",
        two("machine_judgment").alias("aoi"),
        two("ai_judgment").alias("ai"),
        F.col("ric_judgment").alias("ric"),
    )
    aoi, ai, truth = F.col("aoi"), F.col("ai"), F.col("ric")
    n = F.count(F.lit(1))

    def over(side):
        return F.count_if((side == "NG") & (truth == "OK"))

    def missed(side):
        return F.count_if((side == "OK") & (truth == "NG"))

    return rows.groupingSets([[], ["day"], ["machine_no"]], "day", "machine_no").agg(
        n.alias("total"),
        F.count_if(aoi == truth).alias("aoi_correct"),
        F.count_if(ai == truth).alias("ai_correct"),
        share(F.count_if(aoi == truth), n).alias("aoi_accuracy"),
        share(F.count_if(ai == truth), n).alias("ai_accuracy"),
        F.count_if(aoi == "NG").alias("aoi_ng"),
        F.count_if(ai == "NG").alias("ai_ng"),
        F.count_if(truth == "NG").alias("ric_ng"),
        over(aoi).alias("aoi_over"),
        share(over(aoi), n).alias("aoi_over_rate"),
        missed(aoi).alias("aoi_miss"),
        share(missed(aoi), n).alias("aoi_miss_rate"),
        over(ai).alias("ai_over"),
        share(over(ai), n).alias("ai_over_rate"),
        missed(ai).alias("ai_miss"),
        share(missed(ai), n).alias("ai_miss_rate"),
    )


def client_rows(joined: DataFrame) -> DataFrame:
    """A09 rows: empty verdicts read OK, the truth comes from ``datastr``."""
    filled = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "OK").otherwise(F.col(c))
    return joined.withColumns({"eqp": filled("result_eqp"), "ai": filled("result_ai"), "ric_j": ric_judgment("datastr")})


def _client_counts() -> dict[str, Column]:
    eqp, ai, ric = F.col("eqp"), F.col("ai"), F.col("ric_j")
    return {
        "total": F.count(F.lit(1)),
        "aoi_correct": F.count_if(eqp == ric),
        "ai_correct": F.count_if(ai == ric),
        "aoi_over": F.count_if((eqp == "NG") & (ric == "OK")),
        "ai_over": F.count_if((ai == "NG") & (ric == "OK")),
        "ai_miss": F.count_if((ai == "OK") & (ric == "NG")),
    }


def client_summary(joined: DataFrame) -> DataFrame:
    """One row of counts, rates and review progress."""
    rows = client_rows(joined)
    eqp, ai, ric = F.col("eqp"), F.col("ai"), F.col("ric_j")
    c = _client_counts()
    revival = F.count_if((eqp == "NG") & (ai == "OK") & (ric == "OK"))
    over_done = F.count_if((ai == "NG") & (ric == "OK") & F.col("over_category").isNotNull())
    miss_done = F.count_if((ai == "OK") & (ric == "NG") & F.col("miss_category").isNotNull())
    sums = rows.agg(
        *[v.alias(k) for k, v in c.items()],
        F.count_if(eqp == "NG").alias("aoi_ng"),
        F.count_if(ai == "NG").alias("ai_ng"),
        F.count_if(ric == "NG").alias("ric_ng"),
        revival.alias("revival"),
        over_done.alias("over_reviewed"),
        miss_done.alias("miss_reviewed"),
    )
    total = F.col("total")
    return sums.withColumns(
        {
            "aoi_over_rate": share(F.col("aoi_over"), total),
            "ai_over_rate": share(F.col("ai_over"), total),
            "ai_miss_rate": share(F.col("ai_miss"), total),
            "revival_rate": share(F.col("revival"), total),
            "over_unreviewed": F.col("ai_over") - F.col("over_reviewed"),
            "miss_unreviewed": F.col("ai_miss") - F.col("miss_reviewed"),
        }
    )


def client_combos(joined: DataFrame) -> DataFrame:
    return client_rows(joined).groupBy(F.concat_ws("/", "eqp", "ai", "ric_j").alias("combo")).agg(F.count(F.lit(1)).alias("n"))


def client_daily(joined: DataFrame) -> DataFrame:
    return (
        client_rows(joined)
        .groupBy(F.date_format("time_stamp", "yyyy-MM-dd").alias("day"))
        .agg(*[v.alias(k) for k, v in _client_counts().items()])
    )


def review_categories(joined: DataFrame, over: list[str], miss: list[str]) -> DataFrame:
    """Reviewed rows per category; every category appears, even at zero.

    The categories are columns of one aggregate, turned to rows at the end.
    """
    rows = client_rows(joined)
    counts = {("over", c): (F.col("ai") == "NG") & (F.col("ric_j") == "OK") & (F.col("over_category") == c) for c in over}
    counts |= {("miss", c): (F.col("ai") == "OK") & (F.col("ric_j") == "NG") & (F.col("miss_category") == c) for c in miss}
    sums = rows.agg(*[F.count_if(cond).alias(f"{k}__{c}") for (k, c), cond in counts.items()])
    entries = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.lit(c).alias("category"), F.col(f"{k}__{c}").alias("n")) for k, c in counts
    ])
    return sums.select(F.inline(entries))


def client_records(joined: DataFrame, dust: DataFrame, rescue: DataFrame) -> DataFrame:
    """A09 rows with the dust flag and rescue counts of their record."""
    return (
        client_rows(joined)
        .join(dust.select(F.col("record_id").alias("inference_record_id"), F.lit(True).alias("_d")), "inference_record_id", "left")
        .join(
            rescue.select(
                F.col("record_id").alias("inference_record_id"), F.col("images").alias("rescued_images"), F.col("tiles").alias("rescued_tiles")
            ),
            "inference_record_id", "left",
        )
        .withColumn("has_dust_filtering", F.coalesce("_d", F.lit(False)))
        .drop("_d")
    )


def rescue_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count_if(F.col("rescued_tiles").isNotNull()).alias("panels"),
        F.coalesce(F.sum("rescued_images"), F.lit(0)).alias("images"),
        F.coalesce(F.sum("rescued_tiles"), F.lit(0)).alias("tiles"),
    )


def confusion(scored: DataFrame, thresholds: list[float], score: str = "score", positive: str = "is_positive") -> DataFrame:
    """A10: counts at each threshold, one pass over the scores.

    Positive rows are those to be flipped; a flip is ``score > thr``.
    """
    cells = {}
    for no, t in enumerate(thresholds):
        hit = F.col(score) > t
        cells[f"tp{no}"] = F.count_if(hit & (F.col(positive) == 1))
        cells[f"fp{no}"] = F.count_if(hit & (F.col(positive) == 0))
    sums = scored.agg(
        F.count_if(F.col(positive) == 1).alias("p"), F.count_if(F.col(positive) == 0).alias("n"), *[v.alias(k) for k, v in cells.items()]
    )
    rows = F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp")) for i, t in enumerate(thresholds)
    ])
    return sums.select("p", "n", F.inline(rows)).select(
        "threshold", "tp", "fp",
        (F.col("n") - F.col("fp")).alias("tn"),
        (F.col("p") - F.col("tp")).alias("fn"),
        F.when(F.col("p") > 0, F.col("tp") / F.col("p")).otherwise(0.0).alias("recall"),
        F.when(F.col("n") > 0, F.col("fp") / F.col("n")).otherwise(0.0).alias("leak"),
    )


def unit_metrics(scores: DataFrame, threshold: float = 0.5, keys=("lighting", "zone")) -> DataFrame:
    """A11 with A12: quality of each unit from its train and NG scores.

    ``scores`` has keys, ``score`` and ``is_ng`` (0/1).
    """
    keys = list(keys)
    n = F.col("n")
    ng = ranks.order_values(
        scores.where("is_ng = 1"), keys, "score",
        {"ng_p10": F.floor(n * 0.10), "ng_median": F.floor(n / 2)},
    ).drop("n")
    base = scores.groupBy(*keys).agg(
        F.max(F.when(F.col("is_ng") == 0, F.col("score"))).alias("train_max"),
        F.count_if(F.col("is_ng") == 0).alias("train_count"),
        F.count_if(F.col("is_ng") == 1).alias("ng_count"),
        F.min(F.when(F.col("is_ng") == 1, F.col("score"))).alias("ng_min"),
        F.max(F.when(F.col("is_ng") == 1, F.col("score"))).alias("ng_max"),
        F.count_if((F.col("is_ng") == 1) & (F.col("score") >= threshold)).alias("ng_caught"),
    )
    curve = ranks.auroc(scores, keys, "score", "is_ng").select(*keys, "auroc")
    from panelscope.functions.text import grade

    r = lambda c: F.round(c, 4)
    joined = base.join(ng, keys, "left").join(curve, keys, "left")
    return joined.select(
        *keys, "train_count", "ng_count",
        r("train_max").alias("train_max"), r("ng_min").alias("ng_min"), r("ng_p10").alias("ng_p10"),
        r("ng_median").alias("ng_median"), r("ng_max").alias("ng_max"),
        r(F.col("ng_median") - F.col("train_max")).alias("separation"),
        "ng_caught",
        r(F.when(F.col("ng_count") > 0, F.col("ng_caught") / F.col("ng_count"))).alias("ng_caught_rate"),
        "auroc", grade("auroc").alias("grade"),
    )


def score_buckets(tiles: DataFrame, cache: DataFrame, bundle_id: int) -> DataFrame:
    """top5 / top20 / rest by the score at two rank positions."""
    scored = tiles.join(
        cache.where(F.col("bundle_id") == bundle_id).select(F.col("tile_id").alias("id"), "score"), "id", "left"
    )
    cuts = ranks.rank_cut(scored, [], "score", {"top5": 0.05, "top20": 0.20})
    top5, top20 = cuts.select("top5").scalar(), cuts.select("top20").scalar()
    return scored.withColumn(
        "bucket",
        F.when(F.col("score").isNull(), None)
        .when(F.col("score") >= top5, "top5")
        .when(F.col("score") >= top20, "top20")
        .otherwise("rest"),
    )


def pending_changes(pool: DataFrame, used: DataFrame, history_units: DataFrame) -> DataFrame:
    """Accepted OK tiles against those of the last training, per unit.

    ``used`` has (lighting, zone, id); ``history_units`` the units that have a
    record of their last training.  A unit without one counts its rejects.
    """
    ok = pool.where("source = 'ok'")
    keys = ["lighting", "zone"]
    diff = ranks.sym_diff(ok.where("decision = 'accept'").select(*keys, "id"), used, [*keys, "id"])
    changed = diff.groupBy(*keys).agg(F.count(F.lit(1)).alias("changed"))
    rejected = ok.where("decision = 'reject'").groupBy(*keys).agg(F.count(F.lit(1)).alias("rejected"))
    units = changed.select(*keys).unionByName(rejected.select(*keys)).distinct()
    out = (
        units.join(history_units.select(*keys, F.lit(1).alias("_known")).distinct(), keys, "left")
        .join(changed, keys, "left")
        .join(rejected, keys, "left")
        .select(
            *keys,
            F.when(F.col("_known") == 1, F.coalesce("changed", F.lit(0))).otherwise(F.coalesce("rejected", F.lit(0))).alias("pending"),
        )
    )
    return out.where("pending > 0")


def export_summary(manifest: DataFrame) -> DataFrame:
    """A16."""
    return manifest.groupBy("status", F.when(F.col("status") == "ok", F.col("label")).alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    )


SCORE_BANDS = ((0.0, "0"), (0.3, "<.3"), (0.4, "<.4"), (0.5, "<.5"), (0.6, "<.6"))


def score_band(score: Column) -> Column:
    out = F.when(score <= 0, "0")
    for top, name in SCORE_BANDS[1:]:
        out = out.when(score < top, name)
    return out.otherwise(">=.6")


def miss_report(panels: DataFrame) -> DataFrame:
    """Panels that were found, by reason and band of their highest score, with detections at .50 and .60."""
    top = F.col("max_score")
    return panels.where("found").groupBy("reason", score_band(top).alias("band")).agg(
        F.count(F.lit(1)).alias("panels"), F.count_if(top >= 0.5).alias("at_50"), F.count_if(top >= 0.6).alias("at_60")
    )


def dust_threshold_sim(panels: DataFrame, thresholds: list[float]) -> DataFrame:
    """Panels hidden only by dust that reappear when dust needs an
    overlap of at least t.  Panels have ``only_dust``, ``top_score``, ``max_iou``."""
    hidden = (F.col("only_dust") == 1) & (F.col("top_score") >= 0.5)
    sums = panels.agg(
        F.count(F.lit(1)).alias("panels"),
        F.count_if(hidden).alias("hidden"),
        *[F.count_if(hidden & (F.col("max_iou") < t)).alias(f"r{i}") for i, t in enumerate(thresholds)],
    )
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"r{i}").alias("recovered")) for i, t in enumerate(thresholds)])
    return sums.select("panels", "hidden", F.inline(rows))


def false_positive_sim(ok_panels: DataFrame, thresholds: list[float]) -> DataFrame:
    """Good panels that would turn NG at a score threshold, or when their
    dust no longer counts."""
    sums = ok_panels.agg(
        F.count(F.lit(1)).alias("panels"),
        *[F.count_if(F.col("free_score") >= t).alias(f"s{i}") for i, t in enumerate(thresholds)],
        *[F.count_if(F.col("dust_iou_of_filtered") < t).alias(f"d{i}") for i, t in enumerate(thresholds)],
    )
    rows = F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"s{i}").alias("by_score"), F.col(f"d{i}").alias("by_dust"))
        for i, t in enumerate(thresholds)
    ])
    return sums.select("panels", F.inline(rows))


def anomaly_summary(tiles: DataFrame, edges: DataFrame) -> DataFrame:
    """Per image; positions are a list bounded by the tile grid."""
    t = tiles.where("is_anomaly = 1").groupBy("image_result_id").agg(
        F.count(F.lit(1)).alias("anomalies"),
        F.max("score").alias("max_score"),
        F.round(F.avg("score"), 6).alias("mean_score"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("tile_id", "x", "y"))),
                lambda s: F.concat_ws(":", s["tile_id"], s["x"], s["y"]),
            ),
            ";",
        ).alias("positions"),
    )
    e = edges.where("is_dust = 0 AND is_bomb = 0 AND is_cv_ok = 0").groupBy("image_result_id").agg(F.count(F.lit(1)).alias("real_edges"))
    return t.join(e, "image_result_id", "full_outer").select(
        "image_result_id",
        F.coalesce("anomalies", F.lit(0)).alias("anomalies"), "max_score", "mean_score",
        F.coalesce("positions", F.lit("")).alias("positions"),
        F.coalesce("real_edges", F.lit(0)).alias("real_edges"),
    )


def describe_by_label(features: DataFrame, cols: list[str], label: str = "label") -> DataFrame:
    """N, mean and exact quantiles of each feature per label."""
    long = features.select(
        label, F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols]))
    ).where("value IS NOT NULL")
    keys = [label, "feature"]
    q = ranks.quantiles(long, keys, "value", {"p10": 0.1, "median": 0.5, "p90": 0.9, "p95": 0.95})
    mean = long.groupBy(*keys).agg(F.round(F.avg("value"), 6).alias("mean"))
    r = lambda c: F.round(c, 6).alias(c)
    return q.join(mean, keys).select(*keys, "n", "mean", r("p10"), r("median"), r("p90"), r("p95"))


def best_threshold(features: DataFrame, col: str, higher_is_fp: bool, positive: str = "is_positive", steps: int = 60) -> DataFrame:
    """Of 60 quantile cuts the first that maximises filtered false
    positives plus kept positives minus one.

    Each value is filed under the number of cuts below it; the counts beyond
    every cut are then running sums over at most 61 rows.
    """
    clean = features.select(F.col(col).cast("double").alias("v"), F.col(positive).alias("pos")).where("v IS NOT NULL")
    cuts = ranks.quantiles_long(clean, [], "v", [0.01 + 0.98 * i / (steps - 1) for i in range(steps)])
    listed = cuts.agg(F.array_sort(F.collect_list(F.struct("no", "value"))).alias("a")).scalar()  # one entry per cut
    hist = ranks.histogram(clean, [], "v", p=F.col("pos"), q=1 - F.col("pos")).withColumn("cuts", listed)
    below = F.size(F.filter("cuts", lambda c: (c["value"] < F.col("v")) if higher_is_fp else (c["value"] <= F.col("v"))))
    filed = hist.groupBy(below.alias("below")).agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    slots = filed.agg(
        F.sum("p").alias("np"), F.sum("q").alias("nq"), F.collect_list(F.struct("below", "p", "q")).alias("slots")
    )  # at most 61 entries
    def beyond(s, no):
        return (s["below"] > no) if higher_is_fp else (s["below"] <= no)

    def count(field, no):
        return F.aggregate(
            F.filter("slots", lambda s: beyond(s, no)), F.lit(0).cast("long"), lambda acc, s: acc + s[field]
        )

    scored = (
        slots.select("np", "nq", "slots", F.inline(listed))
        .withColumns({"f": count("q", F.col("no")), "l": count("p", F.col("no"))})
        .select(
            "no", F.col("value").alias("cut"),
            (F.col("f") / F.col("nq")).alias("fp_filtered"), (1 - F.col("l") / F.col("np")).alias("pos_kept"),
        )
        .withColumn("gain", F.round(F.col("fp_filtered") + F.col("pos_kept") - 1, 9))
    )
    return scored.orderBy(F.col("gain").desc(), F.col("no").asc()).limit(1)


def bomb_summary(tiles: DataFrame, edges: DataFrame) -> DataFrame:
    """A23."""
    both = tiles.where("is_bomb = 1").select("image_result_id", "bomb_code", F.lit(1).alias("t"), F.lit(0).alias("e")).unionByName(
        edges.where("is_bomb = 1").select("image_result_id", "bomb_code", F.lit(0).alias("t"), F.lit(1).alias("e"))
    )
    return both.groupBy("image_result_id", "bomb_code").agg(F.sum("t").alias("tiles"), F.sum("e").alias("edges"))


def recall_breakdown(scored: DataFrame, attr: str, threshold: float, score: str = "score") -> DataFrame:
    """Flagged share of the positives by attribute."""
    return (
        scored.where("is_positive = 1")
        .groupBy(F.col(attr).alias("value"))
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(score) > threshold).alias("flagged"))
        .withColumn("recall", F.round(F.col("flagged") / F.col("total"), 6))
    )


def pooled_recall(per_fold: DataFrame) -> DataFrame:
    """Folds pooled by whole counts, int(round(r * n)) each."""
    return per_fold.groupBy("value").agg(
        F.sum("total").alias("total"), F.sum(F.round(F.col("recall") * F.col("total")).cast("long")).alias("flagged")
    ).withColumn("recall", F.round(F.col("flagged") / F.col("total"), 6))


def fold_summary(folds: DataFrame, col: str = "oracle_recall") -> DataFrame:
    """Mean, population deviation and the go / no-go word."""
    s = folds.agg(
        F.count(F.lit(1)).alias("folds"), F.round(F.avg(col), 6).alias("mean"), F.round(F.stddev_pop(col), 6).alias("std")
    )
    return s.withColumn("verdict", F.when(F.col("mean") >= 0.5, "GO").when(F.col("mean") >= 0.3, "PARTIAL").otherwise("NO-GO"))


def score_distribution(scored: DataFrame, label: str = "class") -> DataFrame:
    """Quantiles per class."""
    q = ranks.quantiles(scored, [label], "score", {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9})
    ends = scored.groupBy(label).agg(F.min("score").alias("lowest"), F.max("score").alias("highest"))
    r = lambda c: F.round(c, 6).alias(c)
    return q.join(ends, label).select(label, "n", r("lowest"), r("p10"), r("p25"), r("median"), r("p75"), r("p90"), r("highest"))


def score_bins(scored: DataFrame, label: str = "class") -> DataFrame:
    """Ten equal bins on [0, 1], the last one closed."""
    return scored.groupBy(label, F.least(F.floor(F.col("score") * 10), F.lit(9)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def collection_diagnostics(joined: DataFrame, images: DataFrame, tiles: DataFrame, edges: DataFrame) -> DataFrame:
    """Counters by the reason a row, image, tile or edge was dropped."""
    from panelscope.functions.text import ric_per_prefix, sample_label
    from panelscope.operators.verdict import candidate_images

    label = sample_label(F.col("result_ric"), F.col("over_category"))
    heads = joined.withColumn("label", label).withColumn(
        "reason",
        F.when(F.col("result_ai") != "NG", "ai_not_ng")
        .when(F.col("result_ric") == "NG", "ric_ng_kept")
        .when((F.col("result_ric") == "OK") & F.col("label").isNull(), "ric_ok_empty")
        .when(F.col("result_ric") == "OK", "ric_ok_filled")
        .otherwise("ric_other"),
    )
    kept = F.col("reason").isin("ric_ng_kept", "ric_ok_filled")
    row_counts = heads.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    unlinked = heads.where(kept & F.col("inference_record_id").isNull()).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("missing_inference_id").alias("reason"), "n"
    )
    linked = heads.where(kept & F.col("inference_record_id").isNotNull()).select(
        F.col("inference_record_id").alias("record_id"), F.col("id").alias("accuracy_id"), "label",
        ric_per_prefix("datastr").alias("_per_prefix"),
    )
    judged = candidate_images(linked, images)
    image_counts = judged.where("image_drop IS NOT NULL").groupBy(F.col("image_drop").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    ids = judged.where("image_drop IS NULL").select(F.col("image_id").alias("image_result_id"))
    findings = tiles.select(
        "image_result_id",
        F.when(F.col("is_bomb") == 1, "tiles_bomb_skipped").when(F.col("is_anomaly") == 0, "tiles_not_anomaly").otherwise("final_candidates").alias("reason"),
    ).unionByName(
        edges.select("image_result_id", F.when(F.col("is_bomb") == 1, "edges_bomb_skipped").otherwise("final_candidates").alias("reason"))
    )
    found = findings.groupBy("image_result_id", "reason").agg(F.count(F.lit(1)).alias("n"))
    final = ids.join(found, "image_result_id").groupBy("reason").agg(F.sum("n").alias("n"))
    return row_counts.unionByName(unlinked).unionByName(image_counts).unionByName(final)
