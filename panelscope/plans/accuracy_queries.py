"""Registered statistics: equi joins J01-J08 and A ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelscope.functions import text
from panelscope.operators import accuracy as A
from panelscope.operators import ranks
from panelscope.operators import verdict as V
from panelscope.plans.inspection import MISS_CATEGORIES, OVER_CATEGORIES
from panelscope.plans.registry import query
from panelscope.plans.store_queries import AS_OF


def joined(d):
    return A.same_day_latest(A.accuracy_with_reviews(d.accuracy, d.miss_review, d.over_review), d.records)


@query("J01_same_day_latest", "SELECT id, coalesce(inference_record_id, -1) AS inference_record_id FROM same_day")
def j01(d):
    return A.same_day_latest(d.accuracy, d.records).select("id", F.coalesce("inference_record_id", F.lit(-1)).alias("inference_record_id"))


@query("J02_accuracy_with_reviews", """SELECT id, pnl_id, time_stamp, miss_category, miss_note, over_category, over_note FROM joined
WHERE time_stamp >= TIMESTAMP '2026-04-03' AND time_stamp < TIMESTAMP '2026-04-21'""")
def j02(d):
    return A.accuracy_with_reviews(d.accuracy, d.miss_review, d.over_review, "2026-04-03", "2026-04-20").select(
        "id", "pnl_id", "time_stamp", "miss_category", "miss_note", "over_category", "over_note"
    )


def _ric_sql(batch: str) -> str:
    return f"""SELECT r.id, r.glass_id, coalesce(x.ric_judgment, 'OK') AS ric_judgment, coalesce(x.datastr, '') AS ric_datastr,
x.pnl_id IS NOT NULL AS ric_found, coalesce(substr(x.mach_id, 1, 6) = substr(r.machine_no, 1, 6), false) AS machine_match
FROM records r LEFT JOIN (SELECT * FROM ric WHERE {batch} QUALIFY row_number() OVER (PARTITION BY pnl_id ORDER BY id DESC) = 1) x
ON x.pnl_id = r.glass_id"""


_RIC_COLS = ["id", "glass_id", "ric_judgment", "ric_datastr", "ric_found", "machine_match"]


@query("J03_ric_comparison", _ric_sql("true"))
def j03(d):
    return A.ric_comparison(d.records, d.ric).select(_RIC_COLS)


@query("J03_ric_comparison_batch", _ric_sql("batch_id = 2"))
def j03_batch(d):
    return A.ric_comparison(d.records, d.ric, 2).select(_RIC_COLS)


_DUST_SQL = """SELECT record_id FROM images WHERE is_dust_only = 1 UNION
SELECT record_id FROM images WHERE is_ng = 0 AND id IN (SELECT image_result_id FROM edges WHERE is_dust = 1)"""


@query("J04_dust_affected", f"SELECT record_id FROM ({_DUST_SQL}) WHERE record_id IN (SELECT inference_record_id FROM same_day)")
def j04(d):
    ids = A.same_day_latest(d.accuracy, d.records).select(F.col("inference_record_id").alias("record_id"))
    return A.dust_affected(d.images, d.edges, ids)


@query("J05_rescue_stats", """SELECT i.record_id, count(DISTINCT i.id) AS images, count(*) AS tiles FROM tiles t
JOIN image_names i ON i.id = t.image_result_id WHERE scratch_filtered = 1 GROUP BY 1""")
def j05(d):
    return A.rescue_stats(d.tiles, d.image_names)


@query("A01_machine_stats", """SELECT machine_no, count(*) AS total, count(*) FILTER (ai_judgment = 'OK') AS ok,
count(*) FILTER (ai_judgment ILIKE 'NG%') AS ng, count(*) FILTER (ai_judgment ILIKE 'ERR%') AS err,
round(avg(processing_seconds), 6) AS avg_seconds, max(processing_seconds) AS max_seconds, min(processing_seconds) AS min_seconds,
(SELECT count(*) FROM records) AS all_time
FROM records WHERE created_at >= TIMESTAMP '2026-04-20' GROUP BY ROLLUP (machine_no)""")
def a01(d):
    stats = A.machine_stats(d.records, AS_OF, 10)
    return stats.withColumn("all_time", d.records.agg(F.count(F.lit(1)).alias("n")).scalar())


@query("A02_shift_stats", """SELECT time_bucket(INTERVAL 12 HOURS, request_time, TIMESTAMP '2026-01-01 08:00:00') AS shift_start,
CASE WHEN hour(shift_start) = 8 THEN 'day' ELSE 'night' END AS shift, count(*) AS total,
count(*) FILTER (ai_judgment = 'OK') AS ok, count(*) FILTER (ai_judgment ILIKE 'NG%') AS ng, count(*) FILTER (ai_judgment ILIKE 'ERR%') AS err,
round(avg(processing_seconds), 6) AS avg_seconds, CAST(sum(omit_overexposed) AS BIGINT) AS overexposed,
CASE WHEN count(*) > err THEN round(ok * 100.0 / (count(*) - err), 1) ELSE 0 END AS ok_rate,
CASE WHEN count(*) > err THEN round(ng * 100.0 / (count(*) - err), 1) ELSE 0 END AS ng_rate
FROM records GROUP BY 1""")
def a02(d):
    return A.shift_stats(d.records)


_AOI, _NG, _ERR = "machine_judgment NOT IN ('', 'OK')", "ai_judgment ILIKE 'NG%'", "ai_judgment ILIKE 'ERR%'"
_RANGE = "request_time >= TIMESTAMP '2026-04-02' AND request_time < TIMESTAMP '2026-04-29'"
_DATES = ("2026-04-02", "2026-04-28")


@query("A03_cross_matrix", f"""SELECT count(*) AS total, count(*) FILTER ({_AOI}) AS aoi_ng, count(*) FILTER ({_NG}) AS ai_ng,
count(*) FILTER ({_AOI} AND ai_judgment = 'OK') AS ai_revival, count(*) FILTER ({_ERR}) AS err,
count(*) FILTER (NOT {_AOI} AND NOT {_NG} AND NOT {_ERR}) AS ok_ok, count(*) FILTER ({_AOI} AND NOT {_NG} AND NOT {_ERR}) AS ng_ok,
count(*) FILTER (NOT {_AOI} AND {_NG} AND NOT {_ERR}) AS ok_ng, count(*) FILTER ({_AOI} AND {_NG} AND NOT {_ERR}) AS ng_ng
FROM records WHERE {_RANGE}""".replace("NOT machine_judgment NOT IN", "machine_judgment IN"))
def a03(d):
    return A.cross_matrix(d.records, *_DATES)


@query("A04_daily_trend", f"""SELECT strftime(request_time, '%Y-%m-%d') AS day, count(*) AS total, count(*) FILTER ({_AOI}) AS aoi_ng,
count(*) FILTER ({_NG}) AS ai_ng, count(*) FILTER ({_ERR}) AS err FROM records WHERE {_RANGE} GROUP BY 1""")
def a04(d):
    return A.daily_trend(d.records, *_DATES)


@query("A05_machine_rates", f"""SELECT machine_no, count(*) AS total, round(count(*) FILTER ({_AOI}) * 100.0 / count(*), 1) AS aoi_ng_rate,
round(count(*) FILTER ({_NG}) * 100.0 / count(*), 1) AS ai_ng_rate FROM records WHERE {_RANGE} GROUP BY 1""")
def a05(d):
    return A.machine_rates(d.records, *_DATES)


@query("A06_model_counts", f"SELECT model_id, count(*) AS total FROM records WHERE {_RANGE} GROUP BY 1")
def a06(d):
    return A.model_counts(d.records, *_DATES)


@query("A07_error_types", f"""SELECT coalesce(nullif(trim(substr(ai_judgment, 5)), ''), nullif(trim(error_message), ''), 'Unknown') AS error_type,
count(*) AS total FROM records WHERE {_ERR} AND {_RANGE} GROUP BY 1""")
def a07(d):
    return A.error_types(d.records, *_DATES)


@query("A08_ric_accuracy", f"""
WITH c AS ({_ric_sql('true')}),
v AS (SELECT strftime(r.created_at, '%Y-%m-%d') AS day, r.machine_no, CASE WHEN r.machine_judgment = 'OK' THEN 'OK' ELSE 'NG' END AS aoi,
 CASE WHEN r.ai_judgment = 'OK' THEN 'OK' ELSE 'NG' END AS ai, c.ric_judgment AS ric FROM records r JOIN c ON c.id = r.id)
SELECT day, machine_no, count(*) AS total, count(*) FILTER (aoi = ric) AS aoi_correct, count(*) FILTER (ai = ric) AS ai_correct,
round(count(*) FILTER (aoi = ric) * 100.0 / count(*), 1) AS aoi_accuracy, round(count(*) FILTER (ai = ric) * 100.0 / count(*), 1) AS ai_accuracy,
count(*) FILTER (aoi = 'NG') AS aoi_ng, count(*) FILTER (ai = 'NG') AS ai_ng, count(*) FILTER (ric = 'NG') AS ric_ng,
count(*) FILTER (aoi = 'NG' AND ric = 'OK') AS aoi_over, round(count(*) FILTER (aoi = 'NG' AND ric = 'OK') * 100.0 / count(*), 1) AS aoi_over_rate,
count(*) FILTER (aoi = 'OK' AND ric = 'NG') AS aoi_miss, round(count(*) FILTER (aoi = 'OK' AND ric = 'NG') * 100.0 / count(*), 1) AS aoi_miss_rate,
count(*) FILTER (ai = 'NG' AND ric = 'OK') AS ai_over, round(count(*) FILTER (ai = 'NG' AND ric = 'OK') * 100.0 / count(*), 1) AS ai_over_rate,
count(*) FILTER (ai = 'OK' AND ric = 'NG') AS ai_miss, round(count(*) FILTER (ai = 'OK' AND ric = 'NG') * 100.0 / count(*), 1) AS ai_miss_rate
FROM v GROUP BY GROUPING SETS ((), (day), (machine_no))""")
def a08(d):
    return A.ric_accuracy(d.records, d.ric)


_COUNTS = """count(*) AS total, count(*) FILTER (eqp = ric_j) AS aoi_correct, count(*) FILTER (ai = ric_j) AS ai_correct,
count(*) FILTER (eqp = 'NG' AND ric_j = 'OK') AS aoi_over, count(*) FILTER (ai = 'NG' AND ric_j = 'OK') AS ai_over,
count(*) FILTER (ai = 'OK' AND ric_j = 'NG') AS ai_miss"""


@query("A09_client_summary", f"""SELECT {_COUNTS}, count(*) FILTER (eqp = 'NG') AS aoi_ng, count(*) FILTER (ai = 'NG') AS ai_ng,
count(*) FILTER (ric_j = 'NG') AS ric_ng, count(*) FILTER (eqp = 'NG' AND ai = 'OK' AND ric_j = 'OK') AS revival,
count(*) FILTER (ai = 'NG' AND ric_j = 'OK' AND over_category IS NOT NULL) AS over_reviewed,
count(*) FILTER (ai = 'OK' AND ric_j = 'NG' AND miss_category IS NOT NULL) AS miss_reviewed,
round(aoi_over * 100.0 / total, 1) AS aoi_over_rate, round(ai_over * 100.0 / total, 1) AS ai_over_rate,
round(ai_miss * 100.0 / total, 1) AS ai_miss_rate, round(revival * 100.0 / total, 1) AS revival_rate,
ai_over - over_reviewed AS over_unreviewed, ai_miss - miss_reviewed AS miss_unreviewed FROM verdicts""")
def a09(d):
    return A.client_summary(joined(d))


@query("A09_client_combos", "SELECT eqp || '/' || ai || '/' || ric_j AS combo, count(*) AS n FROM verdicts GROUP BY 1")
def a09_combos(d):
    return A.client_combos(joined(d))


@query("A09_client_daily", f"SELECT strftime(time_stamp, '%Y-%m-%d') AS day, {_COUNTS} FROM verdicts GROUP BY 1")
def a09_daily(d):
    return A.client_daily(joined(d))


@query("A09_review_categories", f"""
SELECT 'over' AS kind, c AS category, (SELECT count(*) FROM verdicts WHERE ai = 'NG' AND ric_j = 'OK' AND over_category = c) AS n
FROM (SELECT unnest({OVER_CATEGORIES}) AS c)
UNION ALL SELECT 'miss', c, (SELECT count(*) FROM verdicts WHERE ai = 'OK' AND ric_j = 'NG' AND miss_category = c)
FROM (SELECT unnest({MISS_CATEGORIES}) AS c)""")
def a09_categories(d):
    return A.review_categories(joined(d), OVER_CATEGORIES, MISS_CATEGORIES)


def _client(d):
    return A.client_records(joined(d), A.dust_affected(d.images, d.edges), A.rescue_stats(d.tiles, d.image_names))


_RESCUE_SQL = """(SELECT i.record_id, count(DISTINCT i.id) AS images, count(*) AS tiles FROM tiles t
JOIN image_names i ON i.id = t.image_result_id WHERE scratch_filtered = 1 GROUP BY 1)"""


@query("A09_client_records", f"""SELECT v.id, coalesce(v.inference_record_id, -1) AS inference_record_id, eqp, ai, ric_j, x.record_id IS NOT NULL AS has_dust_filtering,
coalesce(r.images, 0) AS rescued_images, coalesce(r.tiles, 0) AS rescued_tiles FROM verdicts v
LEFT JOIN ({_DUST_SQL}) x ON x.record_id = v.inference_record_id LEFT JOIN {_RESCUE_SQL} r ON r.record_id = v.inference_record_id""")
def a09_records(d):
    return _client(d).select(
        "id", F.coalesce("inference_record_id", F.lit(-1)).alias("inference_record_id"), "eqp", "ai", "ric_j", "has_dust_filtering",
        F.coalesce("rescued_images", F.lit(0)).alias("rescued_images"), F.coalesce("rescued_tiles", F.lit(0)).alias("rescued_tiles"),
    )


@query("A09_rescue_totals", f"""SELECT count(*) FILTER (r.tiles IS NOT NULL) AS panels, CAST(coalesce(sum(r.images), 0) AS BIGINT) AS images,
CAST(coalesce(sum(r.tiles), 0) AS BIGINT) AS tiles FROM same_day v LEFT JOIN {_RESCUE_SQL} r ON r.record_id = v.inference_record_id""")
def a09_rescue(d):
    return A.rescue_totals(_client(d))


_THRESHOLDS = [0.1, 0.3, 0.5, 0.7, 0.9]


@query("A10_confusion", f"""
WITH s AS (SELECT scratch_score AS score, CAST(is_dust = 1 AS INT) AS p FROM tiles)
SELECT CAST(t AS DOUBLE) AS threshold, tp, fp, n - fp AS tn, p_all - tp AS fn, tp / p_all AS recall, fp / n AS leak
FROM (SELECT unnest({_THRESHOLDS}) AS t) x,
LATERAL (SELECT count(*) FILTER (p = 1 AND score > CAST(t AS DOUBLE)) AS tp, count(*) FILTER (p = 0 AND score > CAST(t AS DOUBLE)) AS fp,
  count(*) FILTER (p = 1) AS p_all, count(*) FILTER (p = 0) AS n FROM s)""")
def a10(d):
    return A.confusion(d.tiles.select(F.col("scratch_score").alias("score"), F.col("is_dust").alias("is_positive")), _THRESHOLDS)


def unit_scores(d):
    """Tile scores per (lighting prefix, zone); anomalous tiles are the NG side."""
    return d.tiles.select(
        F.substring_index("image_name", "_", 1).alias("lighting"), "zone", F.col("scratch_score").alias("score"),
        F.col("is_dust").alias("is_ng"),
    )


_UNITS = "(SELECT split_part(image_name, '_', 1) AS lighting, zone, scratch_score AS score, is_dust AS is_ng FROM tiles)"
_AUROC = """(SELECT lighting, zone, round((sum(rk) FILTER (is_ng = 1) - np * (np + 1) / 2.0) / (CAST(np AS DOUBLE) * nn), 4) AS auroc FROM
(SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY lighting, zone, score) - 1) / 2.0 AS rk,
 count(*) FILTER (is_ng = 1) OVER (PARTITION BY lighting, zone) AS np, count(*) FILTER (is_ng = 0) OVER (PARTITION BY lighting, zone) AS nn
 FROM {u} WINDOW w AS (PARTITION BY lighting, zone ORDER BY score)) GROUP BY lighting, zone, np, nn)"""


@query("A11_unit_metrics", f"""
SELECT lighting, zone, train_count, ng_count, round(train_max, 4) AS train_max, round(s[1], 4) AS ng_min,
round(s[CAST(floor(ng_count * 0.10) AS INT) + 1], 4) AS ng_p10, round(s[ng_count // 2 + 1], 4) AS ng_median, round(s[ng_count], 4) AS ng_max,
round(s[ng_count // 2 + 1] - train_max, 4) AS separation, ng_caught, round(ng_caught / ng_count, 4) AS ng_caught_rate, auroc,
CASE WHEN auroc >= 0.95 THEN 'excellent' WHEN auroc >= 0.85 THEN 'good' WHEN auroc >= 0.70 THEN 'fair' WHEN auroc >= 0.55 THEN 'poor' ELSE 'fail' END AS grade
FROM (SELECT lighting, zone, count(*) FILTER (is_ng = 0) AS train_count, count(*) FILTER (is_ng = 1) AS ng_count,
  max(score) FILTER (is_ng = 0) AS train_max, list_sort(list(score) FILTER (is_ng = 1)) AS s,
  count(*) FILTER (is_ng = 1 AND score >= 0.5) AS ng_caught FROM {_UNITS} GROUP BY 1, 2) JOIN {_AUROC.format(u=_UNITS)} USING (lighting, zone)""")
def a11(d):
    return A.unit_metrics(unit_scores(d))


@query("A12_auroc", f"SELECT lighting, zone, auroc FROM {_AUROC.format(u=_UNITS)}")
def a12(d):
    return ranks.auroc(unit_scores(d), ["lighting", "zone"], "score", "is_ng").select("lighting", "zone", "auroc")


@query("A12_auroc_overall", f"SELECT round(avg(auroc), 6) AS mean_auroc, count(*) AS units FROM {_AUROC.format(u=_UNITS)}")
def a12_mean(d):
    return ranks.auroc(unit_scores(d), ["lighting", "zone"], "score", "is_ng").agg(
        F.round(F.avg("auroc"), 6).alias("mean_auroc"), F.count(F.lit(1)).alias("units")
    )


def _bucket_sql(rows: str) -> str:
    return f"""WITH s AS ({rows}),
c AS (SELECT list_sort(list(score) FILTER (score IS NOT NULL), 'DESC') AS l, count(score) AS n FROM s),
k AS (SELECT l[greatest(0, CAST(floor(n * 0.05) AS INT) - 1) + 1] AS top5, l[greatest(0, CAST(floor(n * 0.20) AS INT) - 1) + 1] AS top20 FROM c)
SELECT id, score, CASE WHEN score IS NULL THEN NULL WHEN score >= (SELECT top5 FROM k) THEN 'top5'
WHEN score >= (SELECT top20 FROM k) THEN 'top20' ELSE 'rest' END AS bucket FROM s"""


@query("A13_score_buckets", _bucket_sql("SELECT p.id, c.score FROM tile_pool p LEFT JOIN score_cache c ON c.tile_id = p.id AND c.bundle_id = 10"))
def a13(d):
    return A.score_buckets(d.tile_pool, d.score_cache, 10).select("id", "score", "bucket")


@query("A13_score_buckets_tiles", _bucket_sql("SELECT id, CASE WHEN is_exclude_zone = 0 THEN score END AS score FROM tiles"))
def a13_tiles(d):
    cache = d.tiles.where("is_exclude_zone = 0").selectExpr("id AS tile_id", "1 AS bundle_id", "score")
    return A.score_buckets(d.tiles.select("id"), cache, 1).select("id", "score", "bucket")


@query("A14_pending_changes", """
WITH ok AS (SELECT * FROM tile_pool WHERE source = 'ok'),
used AS (SELECT lighting, zone, id FROM ok WHERE lighting <> 'STANDARD' AND id % 5 <> 0),
d AS (SELECT lighting, zone, count(*) AS n FROM (SELECT a.lighting, a.zone, a.id FROM ok a WHERE decision = 'accept'
   AND NOT EXISTS (FROM used u WHERE u.id = a.id AND u.lighting = a.lighting AND u.zone = a.zone)
 UNION ALL SELECT u.lighting, u.zone, u.id FROM used u WHERE NOT EXISTS (FROM ok a WHERE decision = 'accept' AND u.id = a.id)) GROUP BY 1, 2),
r AS (SELECT lighting, zone, count(*) AS n FROM ok WHERE decision = 'reject' GROUP BY 1, 2),
h AS (SELECT DISTINCT lighting, zone FROM used)
SELECT lighting, zone, pending FROM (SELECT u.lighting, u.zone,
 CASE WHEN h.zone IS NOT NULL THEN coalesce(d.n, 0) ELSE coalesce(r.n, 0) END AS pending
 FROM (SELECT DISTINCT lighting, zone FROM ok) u LEFT JOIN d USING (lighting, zone) LEFT JOIN r USING (lighting, zone) LEFT JOIN h USING (lighting, zone))
WHERE pending > 0""")
def a14(d):
    used = d.tile_pool.where("source = 'ok' AND lighting <> 'STANDARD' AND id % 5 <> 0").select("lighting", "zone", "id")
    return A.pending_changes(d.tile_pool, used, used)


_LABEL = """CASE WHEN result_ric = 'NG' THEN 'true_ng' WHEN result_ric = 'OK' AND over_category IS NOT NULL THEN 'over_' || over_category END"""
HEADS_SQL = f"""(SELECT j.*, {_LABEL} AS label FROM joined j WHERE result_ai = 'NG')"""
JUDGED_SQL = f"""(SELECT h.id AS accuracy_id, h.pnl_id AS glass_id, h.label, h.result_ric, coalesce(h.over_category, '') AS over_category, i.record_id, i.id AS image_id, i.image_name,
split_part(i.image_name, '_', 1) AS prefix,
CASE WHEN i.is_bomb = 1 THEN 'images_bomb_skipped' WHEN starts_with(i.image_name, 'B0F') THEN 'images_b0f_skipped'
 WHEN h.label = 'true_ng' AND h.datastr <> '' AND NOT contains(h.datastr, split_part(i.image_name, '_', 1) || ',NG') THEN 'images_ric_ok_skipped' END AS image_drop
FROM {HEADS_SQL} h JOIN images i ON i.record_id = h.inference_record_id WHERE h.label IS NOT NULL)"""


@query("A15_collection_diagnostics", f"""
WITH h AS (SELECT j.*, {_LABEL} AS label FROM joined j), ju AS {JUDGED_SQL}
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN result_ai <> 'NG' THEN 'ai_not_ng' WHEN result_ric = 'NG' THEN 'ric_ng_kept'
  WHEN label IS NULL THEN 'ric_ok_empty' ELSE 'ric_ok_filled' END AS reason FROM h) GROUP BY 1
UNION ALL SELECT 'missing_inference_id', count(*) FROM h WHERE result_ai = 'NG' AND label IS NOT NULL AND inference_record_id IS NULL
UNION ALL SELECT image_drop, count(*) FROM ju WHERE image_drop IS NOT NULL GROUP BY 1
UNION ALL SELECT reason, count(*) FROM (
  SELECT CASE WHEN t.is_bomb = 1 THEN 'tiles_bomb_skipped' WHEN is_anomaly = 0 THEN 'tiles_not_anomaly' ELSE 'final_candidates' END AS reason
  FROM ju JOIN tiles t ON t.image_result_id = ju.image_id WHERE image_drop IS NULL
  UNION ALL SELECT CASE WHEN e.is_bomb = 1 THEN 'edges_bomb_skipped' ELSE 'final_candidates' END FROM ju JOIN edges e ON e.image_result_id = ju.image_id
  WHERE image_drop IS NULL) GROUP BY 1""")
def a15(d):
    return A.collection_diagnostics(joined(d), d.images, d.tiles, d.edges)


@query("A16_export_summary", "SELECT status, CASE WHEN status = 'ok' THEN label END AS label, count(*) AS n FROM manifest GROUP BY 1, 2")
def a16(d):
    return A.export_summary(d.manifest)


def panels(d):
    """Per record: dust, bombs, scores and known defects; a record without tiles was not found."""
    g = d.tiles.groupBy("record_id").agg(
        F.count(F.lit(1)).alias("n_tiles"), F.sum("is_dust").alias("dusty"), F.sum("is_bomb").alias("bombs"), F.sum("is_aoi_coord").alias("n_gt"),
        F.count_if((F.col("is_aoi_coord") == 1) & (F.col("is_exclude_zone") == 0)).alias("gt_in_tile"), F.max("score").alias("top_score"), F.max("dust_iou").alias("max_iou"),
        (F.min("is_dust") == 1).cast("int").alias("only_dust"),
        F.max(F.when(V.is_real(), F.col("score"))).alias("free_score"),
        F.max(F.when(F.col("is_dust") == 1, F.col("dust_iou"))).alias("dust_iou_of_filtered"),
    )
    heads = d.records.select(F.col("id").alias("record_id"), "machine_judgment", F.col("ai_judgment").startswith("ERR:D").alias("has_error"), (F.col("omit_overexposed") == 1).alias("is_duplicate"))
    out = heads.join(g, "record_id", "left").fillna(0, ["n_tiles", "dusty", "bombs", "n_gt", "gt_in_tile"])
    return out.withColumns({"found": F.col("n_tiles") > 0, "max_score": F.coalesce("top_score", F.lit(0.0))})


_PANELS = """(SELECT r.id AS record_id, machine_judgment, coalesce(n_tiles, 0) AS n_tiles, coalesce(dusty, 0) AS dusty, coalesce(bombs, 0) AS bombs,
starts_with(ai_judgment, 'ERR:D') AS has_error, omit_overexposed = 1 AS is_duplicate, coalesce(n_tiles, 0) > 0 AS found, coalesce(top_score, 0) AS max_score,
coalesce(n_gt, 0) AS n_gt, coalesce(gt_in_tile, 0) AS gt_in_tile, top_score, max_iou, only_dust, free_score, dust_iou_of_filtered FROM records r LEFT JOIN
(SELECT record_id, count(*) AS n_tiles, sum(is_dust) AS dusty, sum(is_bomb) AS bombs, sum(is_aoi_coord) AS n_gt,
count(*) FILTER (is_aoi_coord = 1 AND is_exclude_zone = 0) AS gt_in_tile, max(score) AS top_score,
max(dust_iou) AS max_iou, CAST(min(is_dust) = 1 AS INT) AS only_dust,
max(score) FILTER (is_bomb = 0 AND is_dust = 0 AND is_exclude_zone = 0 AND scratch_filtered = 0 AND is_anomaly = 1) AS free_score,
max(dust_iou) FILTER (is_dust = 1) AS dust_iou_of_filtered FROM tiles GROUP BY 1) t ON t.record_id = r.id)"""
REASON_SQL = """CASE WHEN NOT found THEN 'PANEL_NOT_FOUND' WHEN has_error THEN 'INFERENCE_ERROR' WHEN is_duplicate THEN 'DUPLICATE_PANEL'
WHEN dusty > 0 AND bombs > 0 THEN 'FILTERED_BY_DUST_AND_BOMB' WHEN dusty > 0 THEN 'FILTERED_BY_DUST' WHEN bombs > 0 THEN 'FILTERED_BY_BOMB'
WHEN max_score < 0.3 THEN 'MODEL_UNDETECTABLE' WHEN max_score < 0.6 THEN 'THRESHOLD_TOO_HIGH' WHEN n_gt > 0 AND gt_in_tile = 0 THEN 'GT_OUTSIDE_TILES' ELSE 'THRESHOLD_TOO_HIGH' END"""


@query("A17_miss_report", f"""SELECT reason, CASE WHEN max_score <= 0 THEN '0' WHEN max_score < 0.3 THEN '<.3' WHEN max_score < 0.4 THEN '<.4'
WHEN max_score < 0.5 THEN '<.5' WHEN max_score < 0.6 THEN '<.6' ELSE '>=.6' END AS band, count(*) AS panels,
count(*) FILTER (max_score >= 0.5) AS at_50, count(*) FILTER (max_score >= 0.6) AS at_60
FROM (SELECT *, {REASON_SQL} AS reason FROM {_PANELS}) WHERE found GROUP BY 1, 2""")
def a17(d):
    return A.miss_report(V.miss_reason(panels(d)))


_T = [0.0, 0.02, 0.05, 0.10, 0.30]


@query("A18_dust_threshold_sim", f"""SELECT CAST(t AS DOUBLE) AS threshold, (SELECT count(*) FROM {_PANELS}) AS panels,
(SELECT count(*) FROM {_PANELS} WHERE only_dust = 1 AND top_score >= 0.5) AS hidden,
(SELECT count(*) FROM {_PANELS} WHERE only_dust = 1 AND top_score >= 0.5 AND max_iou < CAST(t AS DOUBLE)) AS recovered
FROM (SELECT unnest({_T}) AS t)""")
def a18(d):
    return A.dust_threshold_sim(panels(d), _T)


@query("A19_false_positive_sim", f"""SELECT CAST(t AS DOUBLE) AS threshold, (SELECT count(*) FROM {_PANELS} WHERE machine_judgment = 'OK') AS panels,
(SELECT count(*) FROM {_PANELS} WHERE machine_judgment = 'OK' AND free_score >= CAST(t AS DOUBLE)) AS by_score,
(SELECT count(*) FROM {_PANELS} WHERE machine_judgment = 'OK' AND dust_iou_of_filtered < CAST(t AS DOUBLE)) AS by_dust
FROM (SELECT unnest({_T + [0.7]}) AS t)""")
def a19(d):
    return A.false_positive_sim(panels(d).where("machine_judgment = 'OK'"), _T + [0.7])


@query("A20_anomaly_summary", """SELECT coalesce(t.image_result_id, e.image_result_id) AS image_result_id, coalesce(anomalies, 0) AS anomalies, max_score, mean_score,
coalesce(positions, '') AS positions, coalesce(real_edges, 0) AS real_edges FROM
(SELECT image_result_id, count(*) AS anomalies, max(score) AS max_score, round(avg(score), 6) AS mean_score,
 string_agg(tile_id || ':' || x || ':' || y, ';' ORDER BY tile_id) AS positions FROM tiles WHERE is_anomaly = 1 GROUP BY 1) t
FULL JOIN (SELECT image_result_id, count(*) AS real_edges FROM edges WHERE is_dust = 0 AND is_bomb = 0 AND is_cv_ok = 0 GROUP BY 1) e
ON e.image_result_id = t.image_result_id""")
def a20(d):
    return A.anomaly_summary(d.tiles, d.edges)


@query("A21_describe_by_label", """
WITH l AS (SELECT side AS label, 'area' AS feature, CAST(area AS DOUBLE) AS v FROM edges UNION ALL SELECT side, 'max_diff', CAST(max_diff AS DOUBLE) FROM edges)
SELECT label, feature, count(*) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.5), 6) AS median,
round(quantile_cont(v, 0.9), 6) AS p90, round(quantile_cont(v, 0.95), 6) AS p95 FROM l GROUP BY 1, 2""")
def a21(d):
    return A.describe_by_label(d.edges.withColumnRenamed("side", "label"), ["area", "max_diff"])


@query("A22_best_threshold", f"""
WITH f AS (SELECT CAST(area AS DOUBLE) AS v, is_dust AS pos FROM edges),
ql AS (SELECT quantile_cont(v, {[0.01 + 0.98 * i / 59 for i in range(60)]}) AS cuts FROM f),
q AS (SELECT i AS no, cuts[i + 1] AS cut FROM ql, range(60) r(i)),
g AS (SELECT no, cut, (SELECT count(*) FILTER (pos = 0 AND v > cut) / count(*) FILTER (pos = 0) FROM f) AS fp_filtered,
 (SELECT 1 - count(*) FILTER (pos = 1 AND v > cut) / count(*) FILTER (pos = 1) FROM f) AS pos_kept FROM q)
SELECT CAST(no AS INT) AS no, round(cut, 6) AS cut, round(fp_filtered, 6) AS fp_filtered, round(pos_kept, 6) AS pos_kept, round(fp_filtered + pos_kept - 1, 6) AS gain
FROM g ORDER BY round(fp_filtered + pos_kept - 1, 9) DESC, no LIMIT 1""")
def a22(d):
    r = lambda c: F.round(c, 6).alias(c)
    best = A.best_threshold(d.edges.select("area", F.col("is_dust").alias("is_positive")), "area", True)
    return best.select("no", r("cut"), r("fp_filtered"), r("pos_kept"), r("gain"))


@query("A23_bomb_summary", """SELECT image_result_id, bomb_code, CAST(sum(t) AS BIGINT) AS tiles, CAST(sum(e) AS BIGINT) AS edges FROM
(SELECT image_result_id, bomb_code, 1 AS t, 0 AS e FROM tiles WHERE is_bomb = 1 UNION ALL SELECT image_result_id, bomb_code, 0, 1 FROM edges WHERE is_bomb = 1) GROUP BY 1, 2""")
def a23(d):
    return A.bomb_summary(d.tiles, d.edges)


_SCORED = """(SELECT id, record_id, split_part(image_name, '_', 1) AS prefix, scratch_score AS score, is_dust AS is_positive,
CASE WHEN is_dust = 1 THEN 'positive' WHEN is_anomaly = 1 THEN 'true_ng' ELSE 'other' END AS class, record_id % 5 AS fold FROM tiles)"""


def scored_tiles(d):
    return d.tiles.selectExpr(
        "id", "record_id", "substring_index(image_name, '_', 1) AS prefix", "scratch_score AS score", "is_dust AS is_positive",
        "CASE WHEN is_dust = 1 THEN 'positive' WHEN is_anomaly = 1 THEN 'true_ng' ELSE 'other' END AS class", "record_id % 5 AS fold",
    )


@query("A24_recall_breakdown", f"""SELECT prefix AS value, count(*) AS total, count(*) FILTER (score > 0.5) AS flagged,
round(count(*) FILTER (score > 0.5) / count(*), 6) AS recall FROM {_SCORED} WHERE is_positive = 1 GROUP BY 1""")
def a24(d):
    return A.recall_breakdown(scored_tiles(d), "prefix", 0.5)


@query("A24_pooled_recall", f"""WITH f AS (SELECT fold, prefix AS value, count(*) AS total, round(count(*) FILTER (score > 0.5) / count(*), 6) AS recall
 FROM {_SCORED} WHERE is_positive = 1 GROUP BY 1, 2)
SELECT value, CAST(sum(total) AS BIGINT) AS total, CAST(sum(CAST(round(recall * total) AS BIGINT)) AS BIGINT) AS flagged,
round(sum(CAST(round(recall * total) AS BIGINT)) / sum(total), 6) AS recall FROM f GROUP BY 1""")
def a24_pooled(d):
    folds = scored_tiles(d).where("is_positive = 1").groupBy("fold", F.col("prefix").alias("value")).agg(
        F.count(F.lit(1)).alias("total"), F.round(F.count_if(F.col("score") > 0.5) / F.count(F.lit(1)), 6).alias("recall")
    )
    return A.pooled_recall(folds)


@query("A25_fold_summary", f"""WITH f AS (SELECT fold, count(*) FILTER (score > 0.5) / count(*) AS r FROM {_SCORED} WHERE is_positive = 1 GROUP BY 1)
SELECT count(*) AS folds, round(avg(r), 6) AS mean, round(stddev_pop(r), 6) AS std,
CASE WHEN avg(r) >= 0.5 THEN 'GO' WHEN avg(r) >= 0.3 THEN 'PARTIAL' ELSE 'NO-GO' END AS verdict FROM f""")
def a25(d):
    folds = scored_tiles(d).where("is_positive = 1").groupBy("fold").agg(
        (F.count_if(F.col("score") > 0.5) / F.count(F.lit(1))).alias("oracle_recall")
    )
    return A.fold_summary(folds)


@query("A26_score_distribution", f"""SELECT class, count(*) AS n, round(min(score), 6) AS lowest, round(quantile_cont(score, 0.1), 6) AS p10,
round(quantile_cont(score, 0.25), 6) AS p25, round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.75), 6) AS p75,
round(quantile_cont(score, 0.9), 6) AS p90, round(max(score), 6) AS highest FROM {_SCORED} GROUP BY 1""")
def a26(d):
    return A.score_distribution(scored_tiles(d))


@query("A26_score_bins", f"SELECT class, CAST(least(floor(score * 10), 9) AS BIGINT) AS bin, count(*) AS n FROM {_SCORED} GROUP BY 1, 2")
def a26_bins(d):
    return A.score_bins(scored_tiles(d))


@query("A26_top_true_ng", f"SELECT id, score FROM {_SCORED} WHERE class = 'true_ng' ORDER BY score DESC, id LIMIT 10")
def a26_top(d):
    return scored_tiles(d).where("class = 'true_ng'").orderBy(F.col("score").desc(), "id").limit(10).select("id", "score")


@query("W01_latest_by", "SELECT glass_id, id, request_time FROM records QUALIFY row_number() OVER (PARTITION BY glass_id ORDER BY request_time DESC, id DESC) = 1")
def w01(d):
    return ranks.latest_by(d.records.select("glass_id", "id", "request_time"), ["glass_id"], ["request_time", "id"])


@query("W02_last_loaded_by", "SELECT pnl_id, id, ric_judgment FROM ric QUALIFY row_number() OVER (PARTITION BY pnl_id ORDER BY id DESC) = 1")
def w02(d):
    return ranks.latest_by(d.ric.select("pnl_id", "id", "ric_judgment"), ["pnl_id"], ["id"])


@query("W03_latest_file", """SELECT record_id, prefix, id FROM (SELECT record_id, split_part(image_name, '_', 1) AS prefix, id FROM image_names)
QUALIFY row_number() OVER (PARTITION BY record_id, prefix ORDER BY id DESC) = 1""")
def w03(d):
    files = d.image_names.select("record_id", text.image_prefix("image_name").alias("prefix"), "id")
    return ranks.latest_by(files, ["record_id", "prefix"], ["id"])


@query("W04_rank_cut", """WITH l AS (SELECT zone, list_sort(list(score), 'DESC') AS s, count(*) AS n FROM tiles GROUP BY 1)
SELECT zone, n, s[greatest(0, CAST(floor(n * 0.05) AS INT) - 1) + 1] AS top5, s[greatest(0, CAST(floor(n * 0.20) AS INT) - 1) + 1] AS top20 FROM l""")
def w04(d):
    return ranks.rank_cut(d.tiles, ["zone"], "score", {"top5": 0.05, "top20": 0.20})


@query("W05_tie_rank", """SELECT zone, score, ties, first_rank + (ties - 1) / 2.0 AS avg_rank FROM
(SELECT zone, score, count(*) AS ties, min(rk) AS first_rank FROM (SELECT zone, score, rank() OVER (PARTITION BY zone ORDER BY score) AS rk FROM tiles) GROUP BY 1, 2)""")
def w05(d):
    return ranks.tie_rank(d.tiles, ["zone"], "score")


@query("W06_islands", """
WITH p AS (SELECT DISTINCT record_id, peak_x // 512 AS col FROM tiles),
s AS (SELECT *, CASE WHEN col - lag(col) OVER w <= 2 THEN 0 ELSE 1 END AS st FROM p WINDOW w AS (PARTITION BY record_id ORDER BY col)),
r AS (SELECT *, sum(st) OVER (PARTITION BY record_id ORDER BY col) AS run FROM s)
SELECT record_id, CAST(run AS BIGINT) AS run, min(col) AS first_col, max(col) AS last_col, count(*) AS n FROM r GROUP BY 1, 2""")
def w06(d):
    cols = d.tiles.select("record_id", F.expr("peak_x div 512").alias("col")).distinct()
    return ranks.islands(cols, ["record_id"], "col").groupBy("record_id", "run").agg(
        F.min("col").alias("first_col"), F.max("col").alias("last_col"), F.count(F.lit(1)).alias("n")
    )


@query("W07_top_k_mean", """SELECT record_id, round(avg(score), 6) AS top_mean, count(*) AS used FROM
(SELECT record_id, score FROM tiles QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY score DESC) <= 3) GROUP BY 1""")
def w07(d):
    return ranks.top_k_mean(d.tiles, ["record_id"], "score", 3).select("record_id", F.round("top_mean", 6).alias("top_mean"), "used")


@query("W08_sym_diff", """WITH a AS (SELECT DISTINCT image_result_id AS id FROM tiles WHERE is_bomb = 1), b AS (SELECT DISTINCT image_result_id AS id FROM edges)
SELECT id, 'a' AS side FROM (SELECT id FROM a EXCEPT SELECT id FROM b) UNION ALL SELECT id, 'b' FROM (SELECT id FROM b EXCEPT SELECT id FROM a)""")
def w08(d):
    a = d.tiles.where("is_bomb = 1").select(F.col("image_result_id").alias("id"))
    return ranks.sym_diff(a, d.edges.select(F.col("image_result_id").alias("id")), ["id"])


@query("W08_union_distinct", "SELECT image_result_id AS id FROM tiles WHERE is_dust = 1 UNION SELECT image_result_id FROM edges WHERE is_dust = 1")
def w08_union(d):
    part = lambda t: t.where("is_dust = 1").select(F.col("image_result_id").alias("id"))
    return part(d.tiles).unionByName(part(d.edges)).distinct()
