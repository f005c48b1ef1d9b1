"""Registered learning jobs, streams and rewrites (M, T, R ids)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelscope.operators import coreset
from panelscope.operators import learn as L
from panelscope.operators import maintain as R
from panelscope.operators import ranks
from panelscope.plans.inspection import OVER_CATEGORIES
from panelscope.plans.registry import query
from panelscope.plans.source_queries import S01_SQL, S15_SQL, listing, request_lines
from panelscope.plans.store_queries import BUNDLES_SQL, bundle_table
from panelscope.session import scratch_path
from panelscope.streaming import jobs as T


def bank(d):
    return d.samples.where("is_normal").select("lighting", "zone", "sample_id", "vector")


@query("M01_memory_bank", """
WITH RECURSIVE u AS (SELECT lighting, zone, greatest(1, CAST(floor(count(*) * CAST(0.1 AS DOUBLE)) AS BIGINT)) AS want, list(sample_id ORDER BY sample_id) AS ids,
 list(CAST(vector AS DOUBLE[]) ORDER BY sample_id) AS vs FROM samples WHERE is_normal GROUP BY 1, 2),
g AS (SELECT lighting, zone, want, 1 AS pick_no, CAST(1 AS BIGINT) AS pos, ids, vs, list_transform(vs, lambda v, i: CASE WHEN i = 1 THEN -1 ELSE pow(list_distance(v, vs[1]), 2) END) AS far FROM u
 UNION ALL SELECT lighting, zone, want, pick_no + 1, p, ids, vs, list_transform(far, lambda f, i: CASE WHEN i = p OR f = -1 THEN -1 ELSE least(f, pow(list_distance(vs[i], vs[p]), 2)) END)
 FROM (SELECT *, CAST(list_position(far, list_max(far)) AS BIGINT) AS p FROM g WHERE pick_no < want))
SELECT lighting, zone, ids[pos] AS sample_id, CAST(pick_no AS BIGINT) AS pick_no FROM g""")
def m01(d):
    return coreset.memory_bank(bank(d)).select("lighting", "zone", "sample_id", "pick_no")


@query("M02_nn_score", """SELECT q.sample_id, round(min(list_distance(CAST(q.vector AS DOUBLE[]), CAST(b.vector AS DOUBLE[]))), 4) AS score
FROM samples q JOIN samples b ON b.is_normal AND b.lighting = q.lighting AND b.zone = q.zone WHERE NOT q.is_normal GROUP BY 1""")
def m02(d):
    return L.nn_score(d.samples.where("NOT is_normal"), bank(d)).select("sample_id", F.round("score", 4).alias("score"))


@query("M03_score_into_cache", """WITH n AS (SELECT q.sample_id AS tile_id, 10 AS bundle_id, round(min(list_distance(CAST(q.vector AS DOUBLE[]), CAST(b.vector AS DOUBLE[]))), 4) AS score
FROM samples q JOIN samples b ON b.is_normal AND b.lighting = q.lighting AND b.zone = q.zone WHERE NOT q.is_normal GROUP BY 1)
SELECT tile_id, bundle_id, score FROM score_cache WHERE tile_id NOT IN (SELECT tile_id FROM n) UNION ALL SELECT * FROM n""")
def m03(d):
    scores = L.nn_score(d.samples.where("NOT is_normal"), bank(d)).select("sample_id", F.round("score", 4).alias("score"))
    return L.score_into_cache(scores, d.score_cache, 10)


@query("M07_load_samples", """SELECT line_no, CAST(label = 'over_surface_dirt' AS INT) AS is_positive FROM manifest WHERE status = 'ok' AND crop_path <> '' AND line_no IN (SELECT id FROM tiles WHERE is_exclude_zone = 0)""")
def m07(d):
    files = d.tiles.where("is_exclude_zone = 0").select(F.concat(F.lit("crop/"), F.col("id").cast("string"), F.lit(".png")).alias("path"))
    return L.load_samples(d.manifest, files, "over_surface_dirt").select("line_no", "is_positive")


_NUMBER = "CAST('0x' || substr(md5('42:' || {0}), 1, 15) AS BIGINT)"


@query("M03_counters", """SELECT count(*) AS total, count(*) FILTER (NOT is_normal) AS scored, count(*) FILTER (is_normal) AS skipped,
count(*) FILTER (NOT is_normal AND score < CAST(0.7 AS DOUBLE)) AS replaced FROM samples""")
def m03_counters(d):
    scores = L.nn_score(d.samples.where("NOT is_normal"), bank(d))
    return L.score_counters(d.samples, scores, d.score_cache, 10)


def labelled(d):
    from pyspark.ml.functions import array_to_vector

    vector = array_to_vector(F.col("vector").cast("array<double>"))
    return d.samples.select("sample_id", F.concat(F.lit("crop/"), F.col("sample_id").cast("string"), F.lit(".png")).alias("crop_path"), vector.alias("features"), (F.col("label") == "true_ng").cast("int").alias("label"))


@query("M04_classify_manifest", """SELECT count(*) AS total, count(*) FILTER (sample_id IS NOT NULL) AS done, count(*) FILTER (sample_id IS NULL) AS skipped
FROM (SELECT crop_path FROM manifest WHERE status = 'ok') m LEFT JOIN (SELECT 'crop/' || sample_id || '.png' AS crop_path, sample_id FROM samples) s USING (crop_path)""")
def m04(d):
    known = labelled(d)
    return L.classify_counters(L.classify_manifest(d.manifest, known.select("crop_path", "features"), L.fit_logreg(known), "over_surface_dirt"))


def patches(d):
    """Every ten vectors are one picture: the first is its class vector."""
    return d.raw("embeddings").selectExpr("vec_id div 10 AS sample_id", "vec_id % 10 AS patch_no", "vec_id % 10 = 0 AS is_cls", "embedding AS vector")


@query("M05_pool_patches", """WITH p AS (SELECT vec_id // 10 AS s, vec_id % 10 AS k, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT s, i, avg(v) AS mean FROM p WHERE k > 0 GROUP BY 1, 2), a AS (SELECT s, k, sqrt(sum((v - mean) * (v - mean))) AS away FROM p JOIN m USING (s, i) WHERE k > 0 GROUP BY 1, 2),
t AS (SELECT s, k FROM a QUALIFY row_number() OVER (PARTITION BY s ORDER BY away DESC, k) <= 5)
SELECT c.s AS sample_id, c.n + 64 AS size, round(c.cls, 3) AS cls_sum, round(q.top, 3) AS top_sum FROM (SELECT s, count(*) AS n, sum(v) AS cls FROM p WHERE k = 0 GROUP BY 1) c
JOIN (SELECT s, sum(avg_v) AS top FROM (SELECT s, i, avg(v) AS avg_v FROM p JOIN t USING (s, k) GROUP BY 1, 2) GROUP BY 1) q ON q.s = c.s""")
def m05(d):
    total = lambda a, b: F.round(F.aggregate(F.slice("vector", a, b), F.lit(0.0), lambda x, y: x + y), 3)
    return L.pool_patches(patches(d)).select("sample_id", F.size("vector").cast("long").alias("size"), total(1, 64).alias("cls_sum"), total(65, 64).alias("top_sum"))


@query("M06_embed_missing", f"""SELECT count(*) AS n, CAST(sum({_NUMBER.format('sample_id')}::HUGEINT) AS VARCHAR) AS digest FROM samples WHERE NOT (score < CAST(0.7 AS DOUBLE))""")
def m06(d):
    cache = d.score_cache.select(F.col("tile_id").alias("sample_id"), F.lit("v1").alias("preprocessing_id"))
    return L.id_digest(L.embed_missing(d.samples, cache, "v1"))


@query("M08_group_folds", f"""WITH f AS (SELECT *, label || '|' || prefix || '|' || source_type AS fine, label || '|' || source_type AS coarse FROM samples),
l AS (SELECT min(n) >= 5 AS ok FROM (SELECT count(*) AS n FROM f GROUP BY fine)),
g AS (SELECT glass, CASE WHEN (SELECT ok FROM l) THEN fine ELSE coarse END AS stratum, count(*) AS n FROM f GROUP BY 1, 2),
m AS (SELECT glass, arg_max(stratum, (n, stratum)) AS stratum, CAST(sum(n) AS BIGINT) AS rows FROM g GROUP BY 1)
SELECT glass, stratum, rows, CAST((row_number() OVER (PARTITION BY stratum ORDER BY rows DESC, {_NUMBER.format('glass')} % 1099511627776) - 1) % 5 AS INT) AS fold FROM m""")
def m08(d):
    return L.group_folds(d.samples)


@query("M09_calibration_split", f"""WITH g AS (SELECT glass, count(*) AS rows, {_NUMBER.format('glass')} AS key FROM samples GROUP BY 1)
SELECT glass, rows, coalesce(sum(rows) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < (SELECT sum(rows) FROM g) * CAST(0.2 AS DOUBLE) AS is_calibration FROM g""")
def m09(d):
    return L.calibration_split(d.samples)


@query("M10_logreg", "SELECT count(*) AS n, CAST(count(*) FILTER (label = 'true_ng') AS BIGINT) AS positives FROM samples")
def m10(d):
    known = labelled(d)
    return L.fit_logreg(known).transform(known).where("prediction IN (0.0, 1.0)").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"))


@query("M10_scores")
def m10_scores(d):
    """A score and prediction per sample; tested against a plain fit."""
    known = labelled(d)
    return L.logreg_scores(known, known).select("sample_id", "label", "prediction", "score")


@query("M04_scores")
def m04_scores(d):
    """The manifest's rows with their scores."""
    known = labelled(d)
    return L.classify_manifest(d.manifest, known.select("crop_path", "features"), L.fit_logreg(known), "over_surface_dirt").select("line_no", "crop_path", "is_positive", "score")


@query("M15_compare", """SELECT model, calibration, count(*) AS n, CAST(count(*) FILTER (label = 'true_ng') AS BIGINT) AS positives
FROM samples, (SELECT unnest(['logreg', 'gbt', 'knn']) AS model), (SELECT unnest(['none', 'isotonic', 'sigmoid']) AS calibration) GROUP BY 1, 2""")
def m15(d):
    data = d.samples.withColumn("is_positive", (F.col("label") == "true_ng").cast("int"))
    scored = L.compare(data, L.group_folds(d.samples, 2), 2, 2, inner=2)
    return scored.where("score BETWEEN 0 AND 1").groupBy("model", "calibration").agg(F.count(F.lit(1)).alias("n"), F.sum("is_positive").alias("positives"))


@query("M11_knn_score", """WITH p AS (SELECT q.sample_id, CAST(b.label = 'true_ng' AS INT) AS pos, row_number() OVER (PARTITION BY q.sample_id ORDER BY
 list_cosine_distance(CAST(q.vector AS DOUBLE[]), CAST(b.vector AS DOUBLE[])), b.sample_id) AS rk FROM samples q, samples b)
SELECT sample_id, round(avg(pos), 6) AS score FROM p WHERE rk <= 7 GROUP BY 1""")
def m11(d):
    train = d.samples.withColumn("is_positive", (F.col("label") == "true_ng").cast("int"))
    return L.knn_score(train, d.samples).select("sample_id", F.round("score", 6).alias("score"))


def fold_scores(d):
    return d.tiles.selectExpr(
        "id", "record_id % 5 AS fold", "CASE WHEN zone = 'edge' THEN 'test' ELSE 'train' END AS part", "is_anomaly * (1 - is_dust) AS is_true_ng",
        "is_dust AS is_positive", "CASE WHEN is_dust = 1 THEN (part_no % 1000) / 1000.0D ELSE (part_no % 700) / 1000.0D END AS score",
    )


_FS = """(SELECT id, record_id % 5 AS fold, CASE WHEN zone = 'edge' THEN 'test' ELSE 'train' END AS part, is_anomaly * (1 - is_dust) AS is_true_ng, is_dust AS is_positive,
CASE WHEN is_dust = 1 THEN CAST(part_no % 1000 AS DOUBLE) / 1000 ELSE CAST(part_no % 700 AS DOUBLE) / 1000 END AS score FROM tiles)"""
_CUTS = f"(SELECT fold, max(score) FILTER (is_true_ng = 1 AND part = 'train') AS realistic, max(score) FILTER (is_true_ng = 1 AND part = 'test') AS oracle FROM {_FS} GROUP BY 1)"


@query("M12_fold_thresholds", f"""SELECT fold, realistic, oracle, round(count(*) FILTER (score > realistic) / count(*), 6) AS realistic_recall, round(count(*) FILTER (score > oracle) / count(*), 6) AS oracle_recall
FROM {_FS} JOIN {_CUTS} USING (fold) WHERE part = 'test' AND is_positive = 1 GROUP BY 1, 2, 3""")
def m12(d):
    r = lambda c: F.round(c, 6).alias(c)
    return L.fold_thresholds(fold_scores(d)).select("fold", "realistic", "oracle", r("realistic_recall"), r("oracle_recall"))


@query("M13_average_precision", f"""WITH g AS (SELECT fold, score, sum(is_positive) AS p, count(*) AS n FROM {_FS} GROUP BY 1, 2),
c AS (SELECT fold, p, sum(p) OVER w AS tp, sum(n) OVER w AS nn FROM g WINDOW w AS (PARTITION BY fold ORDER BY score DESC))
SELECT fold, round(sum(p * CAST(tp AS DOUBLE) / CAST(nn AS DOUBLE)) / CAST(sum(p) AS DOUBLE), 6) AS average_precision FROM c GROUP BY 1""")
def m13(d):
    return ranks.average_precision(fold_scores(d), ["fold"], "score", "is_positive")


@query("M14_conformal", f"""WITH t AS (SELECT least(max(score) * CAST(1.1 AS DOUBLE), CAST(0.9999 AS DOUBLE)) AS t FROM {_FS} WHERE is_true_ng = 1 AND part = 'train')
SELECT t AS threshold, round(count(*) FILTER (is_positive = 1 AND score > t) / count(*) FILTER (is_positive = 1), 6) AS recall,
round(count(*) FILTER (is_true_ng = 1 AND score > t) / count(*) FILTER (is_true_ng = 1), 6) AS leak FROM {_FS}, t WHERE part = 'test' GROUP BY 1""")
def m14(d):
    s = fold_scores(d)
    return L.conformal(s.where("part = 'train'"), s.where("part = 'test'")).select("threshold", F.round("recall", 6).alias("recall"), F.round("leak", 6).alias("leak"))


@query("M16_missed", f"SELECT id, fold, score FROM {_FS} JOIN {_CUTS} USING (fold) WHERE part = 'test' AND is_positive = 1 AND score <= realistic")
def m16(d):
    s = fold_scores(d)
    return L.missed(s, L.fold_thresholds(s)).select("id", "fold", "score")


@query("M17_calibrate", """WITH s AS (SELECT sample_id, lighting, zone, CAST(NOT is_normal AS INT) AS is_ng FROM samples)
SELECT sample_id, is_ng FROM s WHERE is_ng = 1 UNION ALL SELECT sample_id, is_ng FROM (SELECT * FROM s WHERE is_ng = 0
QUALIFY row_number() OVER (PARTITION BY lighting, zone ORDER BY md5('42:' || sample_id), sample_id) <= 100)""")
def m17(d):
    return L.calibrate(d.samples.select("sample_id", "lighting", "zone", "score", (~F.col("is_normal")).cast("int").alias("is_ng"))).select("sample_id", "is_ng")


@query("M18_training_table", """WITH u AS (SELECT * FROM tile_pool WHERE source = 'ok' AND decision = 'accept'), c AS (SELECT lighting, zone, count(*) AS n FROM u GROUP BY 1, 2 HAVING count(*) >= 30)
SELECT lighting, zone, id, n FROM u JOIN c USING (lighting, zone) WHERE (SELECT count(*) FROM c) = 10""")
def m18(d):
    return L.training_table(d.tile_pool)


@query("M18_training_table_small", """WITH u AS (SELECT * FROM tile_pool WHERE source = 'ok' AND decision = 'accept'), c AS (SELECT lighting, zone, count(*) AS n FROM u GROUP BY 1, 2 HAVING count(*) >= 20)
SELECT lighting, zone, id, n FROM u JOIN c USING (lighting, zone) WHERE (SELECT count(*) FROM c) = 10""")
def m18_small(d):
    return L.training_table(d.tile_pool, minimum=20)


@query("M19_newest_entry", """SELECT lighting, zone, max(sample_id) AS entry_no FROM samples GROUP BY 1, 2""")
def m19(d):
    rows = d.samples.select("lighting", "zone", F.lit(1).alias("trained_at"), F.col("sample_id").alias("entry_no"))
    history = L.append_history(rows.where("zone = 'inner'"), rows.where("zone = 'edge'"))
    return L.newest_entry(history).select("lighting", "zone", "entry_no")


# ---- streams ------------------------------------------------------------------


def event_stream(d):
    schema = d.raw("events").schema
    return T.read_stream(d.spark, d.sf_dir, "events.parquet", schema).selectExpr(
        "event_id AS id", "cast(ts AS timestamp) AS request_time", "concat('MACH', cast(1401 + user_id % 7 AS string)) AS machine_no",
        "CASE event_type WHEN 'error' THEN 'ERR:x' WHEN 'purchase' THEN 'NG' WHEN 'signup' THEN 'NG@a' ELSE 'OK' END AS ai_judgment",
        "concat('GLS', cast(user_id AS string)) AS pnl_id", "value AS seconds",
    )


_EV = """(SELECT event_id AS id, ts, 'MACH' || (1401 + user_id % 7) AS machine_no, CASE event_type WHEN 'error' THEN 'ERR:x' WHEN 'purchase' THEN 'NG' WHEN 'signup' THEN 'NG@a' ELSE 'OK' END AS ai FROM events)"""


@query("T02_stream_counters", f"""SELECT machine_no, count(*) AS total, count(*) FILTER (ai = 'OK') AS ok, count(*) FILTER (ai LIKE 'NG%') AS ng, count(*) FILTER (ai LIKE 'ERR%') AS err,
arg_max(ai, (ts, id)) AS last_verdict FROM {_EV} GROUP BY 1""")
def t02(d):
    return T.latest_state(d.spark, T.run_state(T.stream_counters(event_stream(d)), "t02", ["machine_no"]))


@query("T01_stream_requests", S01_SQL)
def t01(d):
    folder = scratch_path(d.spark, "t01-lines")
    request_lines(d).select("value").write.text(folder)
    rows = T.table_of(d.spark, f"{T.run_append(T.stream_requests(d.spark, folder), 't01').folder}/rows")
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return rows.select(blank("error"), blank("glass_id"), F.coalesce("res_w", F.lit(0)).alias("res_w"), blank("machine_judgment"), blank("image_dir"))


@query("T03_stream_shift", f"""SELECT time_bucket(INTERVAL 12 HOURS, ts, TIMESTAMP '2024-01-01 08:00:00') AS shift_start, count(*) AS total, count(*) FILTER (ai LIKE 'NG%') AS ng,
count(*) FILTER (ai LIKE 'ERR%') AS err FROM {_EV} GROUP BY 1""")
def t03(d):
    return T.latest_state(d.spark, T.run_state(T.stream_shift(event_stream(d)), "t03", ["shift_start"]))


@query("T04_stream_import", "SELECT ts AS request_time, 'GLS' || user_id AS pnl_id, min(event_id) AS id FROM events GROUP BY 1, 2")
def t04(d):
    rows = T.table_of(d.spark, f"{T.run_import(event_stream(d), 't04').folder}/rows")
    return rows.select(F.col("request_time").cast("timestamp_ntz").alias("request_time"), "pnl_id", "id")


@query("T05_stream_duplicates", S15_SQL)
def t05(d):
    folder = scratch_path(d.spark, "t05-listing")
    listing(d).write.parquet(folder)
    done = T.run_duplicates(T.read_stream(d.spark, folder, "*.parquet", listing(d).schema), "t05", 4)
    return T.latest_panels(d.spark, done)


def change_stream(d):
    schema = d.raw("events").schema
    return T.read_stream(d.spark, d.sf_dir, "events.parquet", schema).selectExpr(
        "user_id AS tile_id", "event_id AS change_no", "round(value, 3) AS score", "cast(event_type = 'error' AS int) AS deleted"
    )


_BEFORE = "(SELECT c_custkey AS tile_id, round(c_acctbal, 3) AS score FROM customer)"


@query("T06_stream_upsert", f"""WITH c AS (SELECT user_id AS tile_id, event_id AS n, round(value, 3) AS score, event_type = 'error' AS gone FROM events),
l AS (SELECT tile_id, arg_max(score, n) AS score, arg_max(gone, n) AS gone FROM c GROUP BY 1)
SELECT tile_id, score FROM l WHERE NOT gone UNION ALL SELECT tile_id, score FROM {_BEFORE} WHERE tile_id NOT IN (SELECT tile_id FROM l)""")
def t06(d):
    before = d.raw("customer").selectExpr("c_custkey AS tile_id", "round(c_acctbal, 3) AS score")
    done = T.run_upsert(change_stream(d), "t06", before, ["tile_id"], "score")
    return T.latest_state(d.spark, done).select("tile_id", "score")


@query("T06_upsert_history", f"""WITH c AS (SELECT user_id AS tile_id, event_id AS change_no, CASE WHEN event_type <> 'error' THEN round(value, 3) END AS new_value FROM events)
SELECT c.tile_id, change_no, CASE WHEN row_number() OVER w = 1 THEN b.score ELSE lag(new_value) OVER w END AS old_value, new_value
FROM c LEFT JOIN {_BEFORE} b ON b.tile_id = c.tile_id WINDOW w AS (PARTITION BY c.tile_id ORDER BY change_no)""")
def t06_history(d):
    before = d.raw("customer").selectExpr("c_custkey AS tile_id", "round(c_acctbal, 3) AS score")
    done = T.run_upsert(change_stream(d), "t06h", before, ["tile_id"], "score")
    return T.table_of(d.spark, f"{done.folder}/history").drop("epoch")


@query("T07_stream_machines", f"SELECT date_trunc('hour', ts) AS hour, machine_no, count(*) AS n FROM {_EV} GROUP BY 1, 2")
def t07(d):
    return T.latest_state(d.spark, T.run_state(T.stream_machines(event_stream(d)), "t07", ["hour", "machine_no"]))


# ---- rewrites -----------------------------------------------------------------


@query("R01_retain", """
WITH k AS (SELECT id, created_at FROM records WHERE created_at >= CASE WHEN ai_judgment = 'OK' THEN TIMESTAMP '2026-04-20' ELSE TIMESTAMP '2026-04-10' END)
SELECT 'records' AS part, count(*) AS n FROM k UNION ALL SELECT 'tiles', count(*) FROM tiles JOIN k ON k.id = record_id WHERE created_at >= TIMESTAMP '2026-04-15'
UNION ALL SELECT 'edges', count(*) FROM edges JOIN k ON k.id = record_id UNION ALL SELECT 'heat', count(*) FROM image_names n JOIN k ON k.id = record_id WHERE heatmap_path <> '' AND created_at >= TIMESTAMP '2026-04-25'""")
def r01(d):
    out = R.retain(d.records, d.image_names, d.tiles, d.edges, "2026-04-30 10:00:00", 10, 20, 15, 5)
    n = F.count(F.lit(1)).alias("n")
    rows = {"records": out["records"], "tiles": out["tiles"], "edges": out["edges"], "heat": out["images"].where("heatmap_path <> ''")}
    result = None
    for part, df in rows.items():
        one = df.agg(n).select(F.lit(part).alias("part"), "n")
        result = one if result is None else result.unionByName(one)
    return result


@query("R02_delete_batch", "SELECT id, batch_id FROM ric WHERE batch_id <> 2")
def r02(d):
    return R.delete_batch(d.ric, 2).select("id", "batch_id")


@query("R03_count_accuracy", "SELECT count(*) AS n FROM accuracy")
def r03(d):
    return R.count_accuracy(d.accuracy)


@query("R04_save_reviews", """SELECT client_record_id, CASE WHEN m THEN 'bubble' ELSE category END AS category, CASE WHEN m THEN 'new' ELSE note END AS note FROM
(SELECT *, client_record_id IN (SELECT client_record_id FROM miss_review) AS m FROM over_review)
UNION ALL SELECT client_record_id, 'bubble', 'new' FROM miss_review WHERE client_record_id NOT IN (SELECT client_record_id FROM over_review)""")
def r04(d):
    change = d.miss_review.select("client_record_id", F.lit("bubble").alias("category"), F.lit("new").alias("note"), F.lit(1).alias("change_no"), F.lit(0).alias("deleted"))
    bad = d.miss_review.select("client_record_id", F.lit("nonsense").alias("category"), F.lit("x").alias("note"), F.lit(2).alias("change_no"), F.lit(0).alias("deleted"))
    return R.save_reviews(d.over_review, change.unionByName(bad), d.accuracy, OVER_CATEGORIES)


@query("R05_mark", "SELECT id AS tile_result_id FROM tiles WHERE scratch_filtered = 1 AND (score >= CAST(0.8 AS DOUBLE) OR is_dust = 1)")
def r05(d):
    return R.mark(d.rescue_review, d.tiles, d.tiles.where("is_dust = 1").select(F.col("id").alias("tile_result_id"))).select("tile_result_id")


@query("R05_unmark", "SELECT tile_result_id FROM rescue_review JOIN tiles t ON t.id = tile_result_id WHERE is_dust = 0")
def r05_un(d):
    return R.unmark(d.rescue_review, d.tiles.where("is_dust = 1").select(F.col("id").alias("tile_result_id"))).select("tile_result_id")


def param_changes(d):
    return d.raw("events").selectExpr(
        "event_id AS change_no", "concat('p', cast(user_id AS string)) AS name",
        "CASE event_type WHEN 'error' THEN 'true' WHEN 'purchase' THEN cast(user_id AS string) WHEN 'signup' THEN '1.5' ELSE '\"x\"' END AS value", "event_type AS reason",
    )


def stored_params(d):
    return d.raw("customer").selectExpr("concat('p', cast(c_custkey AS string)) AS name", "cast(c_nationkey AS string) AS value", "'int' AS tag")


_CHANGES = """(SELECT event_id AS change_no, 'p' || user_id AS name, CASE event_type WHEN 'error' THEN 'true' WHEN 'purchase' THEN CAST(user_id AS VARCHAR) WHEN 'signup' THEN '1.5' ELSE '"x"' END AS value, event_type AS reason FROM events)"""
_PARAMS = "(SELECT 'p' || c_custkey AS name, CAST(c_nationkey AS VARCHAR) AS value, 'int' AS tag FROM customer)"


@query("R06_params", f"""WITH e AS (SELECT name, arg_min(value, change_no) AS f, arg_max(value, change_no) AS l FROM {_CHANGES} GROUP BY 1)
SELECT coalesce(e.name, p.name) AS name, coalesce(l, p.value) AS value, coalesce(tag, CASE WHEN f = 'true' THEN 'bool' WHEN f = '1.5' THEN 'float' WHEN f = '"x"' THEN 'str' ELSE 'int' END) AS tag
FROM e FULL JOIN {_PARAMS} p ON p.name = e.name""")
def r06(d):
    return R.set_params(stored_params(d), param_changes(d))[0]


@query("R06_history", f"""SELECT change_no, c.name, coalesce(lag(c.value) OVER (PARTITION BY c.name ORDER BY change_no), p.value, '') AS old_value, c.value AS new_value, reason
FROM {_CHANGES} c LEFT JOIN {_PARAMS} p ON p.name = c.name""")
def r06_history(d):
    return R.set_params(stored_params(d), param_changes(d))[1]


@query("R07_pool", """SELECT id, CASE WHEN id IN (SELECT sample_id FROM samples WHERE score > CAST(0.5 AS DOUBLE)) THEN 'reject' ELSE decision END AS decision FROM tile_pool
UNION ALL SELECT id, 'accept' FROM tiles WHERE is_bomb = 1 AND id NOT IN (SELECT id FROM tile_pool)""")
def r07_pool(d):
    new = d.tiles.where("is_bomb = 1").selectExpr("id", "substring_index(image_name, '_', 1) AS lighting", "zone", "'ng' AS source")
    pool = R.decide_tiles(d.tile_pool, "J1", d.samples.where("score > 0.5D").select(F.col("sample_id").alias("id")), "reject")
    both = R.insert_pool(pool, "J2", new)
    return both.select("id", "decision")


@query("R07_cleanup", "SELECT id FROM tile_pool")
def r07_cleanup(d):
    new = d.tiles.where("is_bomb = 1").selectExpr("id", "substring_index(image_name, '_', 1) AS lighting", "zone", "'ng' AS source")
    return R.cleanup_pool(R.insert_pool(d.tile_pool, "J2", new), "J2").select("id")


@query("R07_job_state", """SELECT c_custkey AS job_id, CASE WHEN c_acctbal > 0 THEN CASE WHEN c_nationkey % 2 = 0 THEN 'completed' ELSE 'train' END ELSE 'review' END AS state,
CASE WHEN c_acctbal > 0 AND c_nationkey % 2 = 0 THEN TIMESTAMP '2026-05-01' END AS completed_at FROM customer""")
def r07_state(d):
    jobs = d.raw("customer").selectExpr("c_custkey AS job_id", "'review' AS state", "cast(NULL AS timestamp_ntz) AS completed_at", "c_acctbal", "c_nationkey")
    change = jobs.where("c_acctbal > 0").selectExpr("job_id", "CASE WHEN c_nationkey % 2 = 0 THEN 'completed' ELSE 'train' END AS new_state", "timestamp_ntz'2026-05-01' AS changed_at")
    return R.set_state(jobs, change)


@query("R07_bundles", f"""WITH b AS (SELECT * FROM {BUNDLES_SQL} WHERE id % 2 = 0)
SELECT id, is_active FROM b WHERE id NOT IN (SELECT s_suppkey FROM supplier) UNION ALL
SELECT id, 0 FROM {BUNDLES_SQL} WHERE id % 2 = 1 AND bundle_path NOT IN (SELECT bundle_path FROM b) AND id NOT IN (SELECT s_suppkey FROM supplier)""")
def r07_bundles(d):
    table = bundle_table(d)
    both = R.register_bundles(table.where("id % 2 = 0"), table.where("id % 2 = 1"))
    return R.delete_bundles(both, d.raw("supplier").selectExpr("s_suppkey AS id")).select("id", "is_active")


@query("R09_threshold", """SELECT lighting, zone, CASE WHEN lighting = 'G0F00000' AND zone = 'inner' THEN CAST(1.2346 AS DOUBLE) ELSE m END AS threshold
FROM (SELECT lighting, zone, max(score) AS m FROM samples GROUP BY 1, 2)""")
def r09(d):
    table = d.samples.groupBy("lighting", "zone").agg(F.max("score").alias("threshold"))
    return R.set_threshold(table, "G0F00000", "inner", 1.23456)


@query("R08_seed_params", "SELECT p_name || p_partkey AS name, CASE WHEN p_size > 10 THEN p_brand ELSE p_type END AS value FROM part")
def r08(d):
    p = d.raw("part").withColumn("name", F.concat("p_name", F.col("p_partkey").cast("string")))
    return R.seed_params(p.where("p_size > 10").select("name", F.col("p_brand").alias("value")), p.select("name", F.col("p_type").alias("value")))
