"""Registered reads over the store: Q ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelscope.operators import search as S
from panelscope.plans.registry import query

HEAD = ["id", "glass_id", "machine_no", "machine_judgment", "ai_judgment", "created_at"]
HEAD_SQL = "id, glass_id, machine_no, machine_judgment, ai_judgment, created_at"
AS_OF = "2026-04-30 00:00:00"


@query("Q01_by_glass", f"SELECT {HEAD_SQL} FROM records WHERE glass_id = 'GLS000077'")
def q01(d):
    return S.by_glass(d.records, "GLS000077").select(HEAD)


@query("Q02_by_range", f"""SELECT {HEAD_SQL} FROM records
WHERE created_at BETWEEN TIMESTAMP '2026-04-05 00:00:00' AND TIMESTAMP '2026-04-09 12:00:00'""")
def q02(d):
    return S.by_range(d.records, "2026-04-05 00:00:00", "2026-04-09 12:00:00").select(HEAD)


@query("Q03_recent", f"SELECT {HEAD_SQL} FROM records ORDER BY created_at DESC, id DESC LIMIT 50")
def q03(d):
    return S.recent(d.records).select(HEAD)


@query("Q04_paged", f"""SELECT {HEAD_SQL}, (SELECT count(*) FROM records) AS total_count,
CAST(ceil((SELECT count(*) FROM records) / 100.0) AS BIGINT) AS pages
FROM records ORDER BY created_at DESC, id DESC LIMIT 100 OFFSET 200""")
def q04(d):
    return S.paged(d.records, 100, 200).select(*HEAD, "total_count", "pages")


@query("Q05_overexposed", f"""SELECT {HEAD_SQL}, (SELECT count(*) FROM records WHERE omit_overexposed = 1) AS total_count
FROM records WHERE omit_overexposed = 1 ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 50""")
def q05(d):
    return S.overexposed(d.records, 50, 50).select(*HEAD, "total_count")


@query("Q06_search", f"""SELECT {HEAD_SQL} FROM records WHERE glass_id ILIKE '%gls0%' AND machine_no ILIKE '%140%'
AND ai_judgment ILIKE '%ng%' AND created_at >= TIMESTAMP '2026-04-03' AND created_at <= TIMESTAMP '2026-04-20 23:59:59'""")
def q06(d):
    return S.search(
        d.records, glass_id="gls0", machine_no="140", ai_judgment="ng", start_date="2026-04-03", end_date="2026-04-20"
    ).select(HEAD)


@query("Q06_search_cross", f"""SELECT {HEAD_SQL} FROM records WHERE machine_judgment NOT IN ('', 'OK')
AND NOT ai_judgment ILIKE 'NG%' AND NOT ai_judgment ILIKE 'ERR%' AND CAST(id AS VARCHAR) LIKE '%7%'
AND CAST(request_time AS DATE) BETWEEN DATE '2026-04-02' AND DATE '2026-04-28'""")
def q06_cross(d):
    return S.search(
        d.records, record_id="7", cross_filter="ng_ok", start_date="2026-04-02", end_date="2026-04-28"
    ).select(HEAD)


@query("Q06_search_page", f"""SELECT {HEAD_SQL}, count(*) OVER () AS total_count FROM records
WHERE created_at >= TIMESTAMP '2026-04-24' AND created_at <= TIMESTAMP '2026-04-30 23:59:59'
ORDER BY created_at DESC, id DESC LIMIT 50""")
def q06_page(d):
    return S.search_page(d.records, as_of=AS_OF).select(*HEAD, "total_count")


@query("Q07_record_detail", """
WITH tl AS (SELECT image_result_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY
  CASE WHEN is_dust = 0 AND is_bomb = 0 THEN 0 WHEN is_bomb = 1 THEN 1 WHEN is_dust = 1 THEN 2 ELSE 3 END, score DESC, tile_id) AS t
  FROM tiles GROUP BY 1),
el AS (SELECT image_result_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY is_dust, max_diff DESC, patchcore_score DESC, id) AS e
  FROM edges GROUP BY 1),
im AS (SELECT i.record_id, string_agg(CAST(i.id AS VARCHAR) || '(' || t || ')(' || coalesce(e, '') || ')', ';' ORDER BY i.id) AS tree,
  count(*) AS n_images FROM images i LEFT JOIN tl ON tl.image_result_id = i.id LEFT JOIN el ON el.image_result_id = i.id GROUP BY 1)
SELECT id, glass_id, n_images, tree FROM records JOIN im ON record_id = id""")
def q07(d):
    tree = S.record_detail(d.records, d.images, d.tiles, d.edges).where("images IS NOT NULL")
    ids = lambda a: F.array_join(F.transform(F.coalesce(a, F.array()), lambda s: s["id"].cast("string")), ",")
    line = F.transform("images", lambda i: F.concat(i["id"].cast("string"), F.lit("("), ids(i["tiles"]), F.lit(")("), ids(i["edges"]), F.lit(")")))
    return tree.select("id", "glass_id", F.size("images").cast("long").alias("n_images"), F.array_join(line, ";").alias("tree"))


@query("Q08_log_search", """
SELECT line_no, line FROM (SELECT doc_id AS line_no, text AS line FROM documents)
WHERE contains(lower(line), 'data')""")
def q08(d):
    return S.log_search(d.raw("documents").selectExpr("doc_id AS line_no", "text AS line"), None, text="DATA")


_RESCUED_SQL = """FROM tiles t JOIN image_names i ON i.id = t.image_result_id JOIN records r ON r.id = i.record_id
LEFT JOIN rescue_review s ON s.tile_result_id = t.id WHERE t.scratch_filtered = 1"""


def _rescued_sql(extra: str, order: str, limit: int | None = None) -> str:
    return f"""SELECT t.id, t.tile_id, r.id AS record_id, r.glass_id, i.image_name, r.created_at, t.x, t.y, t.score, t.scratch_score,
coalesce(nullif(t.heatmap_path, ''), nullif(i.heatmap_path, ''), '') AS heatmap,
coalesce(s.is_misrescue, 0) AS is_misrescue, s.id IS NOT NULL AS reviewed {_RESCUED_SQL} {extra} ORDER BY {order}{f' LIMIT {limit}' if limit else ''}"""


@query("Q09_rescued_pending", _rescued_sql("AND s.id IS NULL AND CAST(r.created_at AS DATE) <= DATE '2026-04-25'", "r.created_at DESC, t.id DESC", 100))
def q09(d):
    return S.rescued_tiles(d.tiles, d.image_names, d.records, d.rescue_review, limit=100, end="2026-04-25")


@query("Q09_rescued_marked", _rescued_sql("AND s.is_misrescue = 1", "t.scratch_score, r.created_at DESC, t.id DESC"))
def q09m(d):
    return S.rescued_tiles(d.tiles, d.image_names, d.records, d.rescue_review, "marked", "score_asc")


@query("Q10_misrescued", """SELECT t.id, t.tile_id, r.id AS record_id, t.image_result_id, r.glass_id, i.image_name, i.image_path, t.x, t.y,
t.width, t.height, t.score, t.scratch_score, r.created_at, r.ai_judgment, s.note AS review_note
FROM tiles t JOIN image_names i ON i.id = t.image_result_id JOIN records r ON r.id = i.record_id
JOIN rescue_review s ON s.tile_result_id = t.id WHERE t.scratch_filtered = 1 AND s.is_misrescue = 1""")
def q10(d):
    return S.misrescued_tiles(d.tiles, d.image_names, d.records, d.rescue_review)


@query("Q11_rescue_counts", f"""SELECT count(*) AS total, count(*) FILTER (s.is_misrescue = 1) AS marked,
count(*) - count(*) FILTER (s.is_misrescue = 1) AS pending {_RESCUED_SQL}""")
def q11(d):
    return S.rescue_counts(d.tiles, d.image_names, d.records, d.rescue_review)


@query("Q12_tile_pool", "SELECT id, lighting, zone, source, decision FROM tile_pool WHERE job_id = 'J1' AND zone = 'inner' AND source = 'ok' AND decision = 'accept'")
def q12(d):
    return S.tile_pool(d.tile_pool, "J1", zone="inner", source="ok", decision="accept").select("id", "lighting", "zone", "source", "decision")


@query("Q12_tile_pool_ng", "SELECT id, lighting, zone, source, decision FROM tile_pool WHERE source = 'ng' AND lighting = 'G0F00000'")
def q12_ng(d):
    return S.tile_pool(d.tile_pool, "J1", lighting="G0F00000", zone="edge", source="ng").select("id", "lighting", "zone", "source", "decision")


@query("Q13_ok_panels", f"""SELECT {HEAD_SQL} FROM records WHERE machine_judgment = 'OK' AND model_id = 'GN140HCAL010S'
AND created_at >= TIMESTAMP '2026-04-27 00:00:00' """)
def q13(d):
    return S.ok_panels(d.records, AS_OF, "GN140HCAL010S", days=3).select(HEAD)


def bundle_table(d):
    """One bundle per part: machine from the brand, newest id active."""
    return d.raw("part").selectExpr(
        "p_partkey AS id", "p_brand AS machine_id", "concat('bundle/', cast(p_partkey % 700 AS string)) AS bundle_path",
        "timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(cast(p_partkey % 97 AS int), 0, 0, 0) AS trained_at",
        "cast(p_size = 1 AS int) AS is_active", "concat('J', cast(p_partkey % 3 AS string)) AS job_id",
    )


BUNDLES_SQL = """(SELECT p_partkey AS id, p_brand AS machine_id, 'bundle/' || CAST(p_partkey % 700 AS VARCHAR) AS bundle_path,
TIMESTAMP '2026-01-01' + to_days(CAST(p_partkey % 97 AS INT)) AS trained_at, CAST(p_size = 1 AS INT) AS is_active,
'J' || CAST(p_partkey % 3 AS VARCHAR) AS job_id FROM part)"""


@query("Q14_bundles", f"""SELECT b.* FROM {BUNDLES_SQL} b WHERE machine_id IN (SELECT min(p_brand) FROM part)
AND bundle_path IN (SELECT 'bundle/' || CAST(s_suppkey AS VARCHAR) FROM supplier)""")
def q14(d):
    files = d.raw("supplier").selectExpr("concat('bundle/', cast(s_suppkey AS string)) AS bundle_path")
    first = d.raw("part").agg(F.min("p_brand")).scalar()
    table = bundle_table(d)
    return S.bundles(table.where(F.col("machine_id") == first), files=files).select(table.columns)


@query("Q14_bundles_by_machine", f"""SELECT machine_id, count(*) AS n_bundles, max(trained_at) AS newest,
arg_max(id, (epoch(trained_at), id)) AS newest_id, CAST(sum(is_active) AS BIGINT) AS n_active FROM {BUNDLES_SQL} GROUP BY 1""")
def q14_by(d):
    return S.bundles_by_machine(bundle_table(d))


def job_table(d):
    return d.raw("customer").selectExpr(
        "c_custkey AS job_id",
        "element_at(array('preprocess', 'review', 'train', 'completed', 'failed'), cast(1 + c_nationkey % 5 AS int)) AS state",
        "timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(cast(c_custkey % 60 AS int), 0, 0, 0) AS started_at",
        "concat('[\"p', cast(c_custkey AS string), '\",\"q\"]') AS panel_paths",
        "CASE WHEN c_acctbal > 0 THEN '[\"full\",\"corner\"]' END AS panel_modes",
    )


@query("Q15_active_jobs", """SELECT c_custkey AS job_id, (['preprocess','review','train','completed','failed'])[CAST(1 + c_nationkey % 5 AS INT)] AS state,
'p' || CAST(c_custkey AS VARCHAR) || ',q' AS panel_list, CASE WHEN c_acctbal > 0 THEN 'full,corner' ELSE 'full,full' END AS mode_list
FROM customer WHERE c_nationkey % 5 < 3""")
def q15(d):
    return S.active_jobs(job_table(d)).select(
        "job_id", "state", F.array_join("panels", ",").alias("panel_list"), F.array_join("modes", ",").alias("mode_list")
    )


@query("Q16_config_history", """SELECT event_id AS id, 'p' || CAST(user_id AS VARCHAR) AS name, CAST(value AS VARCHAR) IS NOT NULL AS has_value, ts AS changed_at
FROM events WHERE user_id = 7""")
def q16(d):
    history = d.raw("events").selectExpr("event_id AS id", "concat('p', cast(user_id AS string)) AS name", "value IS NOT NULL AS has_value", "ts AS changed_at")
    return S.config_history(history, "p7")


def settings_table(d):
    """One setting per part, of every type."""
    return d.raw("part").selectExpr(
        "concat('set', cast(p_partkey AS string)) AS name",
        "element_at(array('int', 'float', 'bool', 'dict', 'str'), cast(1 + p_partkey % 5 AS int)) AS tag",
        """CASE p_partkey % 5 WHEN 0 THEN cast(p_size AS string) WHEN 1 THEN cast(p_size / 4 AS string) WHEN 2 THEN CASE WHEN p_size > 20 THEN 'true' ELSE 'false' END
           WHEN 3 THEN concat('{"size":', cast(p_size AS string), '}') ELSE concat('"', p_brand, '"') END AS value""",
    )


@query("Q16_decoded_settings", """SELECT 'set' || p_partkey AS name, CASE WHEN p_partkey % 5 = 0 THEN CAST(p_size AS BIGINT) END AS int_value,
CASE WHEN p_partkey % 5 = 1 THEN CAST(p_size AS DOUBLE) / 4 END AS float_value, CASE WHEN p_partkey % 5 = 2 THEN p_size > 20 END AS bool_value,
CASE WHEN p_partkey % 5 = 3 THEN '{"size":' || p_size || '}' END AS dict_value, CASE WHEN p_partkey % 5 = 4 THEN p_brand END AS text_value FROM part""")
def q16_settings(d):
    return S.decoded_settings(settings_table(d)).select("name", "int_value", "float_value", "bool_value", "dict_value", "text_value")


@query("Q17_ric_batches", """SELECT batch_id AS id, count(*) AS total_records, max(r.request_time) AS imported_at
FROM ric JOIN (SELECT id AS rid, request_time FROM records) r ON rid = ric.id GROUP BY 1""")
def q17(d):
    batches = d.ric.join(d.records.select("id", "request_time"), "id").groupBy(F.col("batch_id").alias("id")).agg(
        F.count(F.lit(1)).alias("total_records"), F.max("request_time").alias("imported_at")
    )
    return S.ric_batches(batches)


@query("Q18_gallery", """SELECT sample_id, label, prefix, collected_at, line_no FROM manifest
WHERE status = 'ok' AND label = 'true_ng' AND prefix = 'G0F00000' ORDER BY collected_at DESC, sample_id, line_no LIMIT 100 OFFSET 100""")
def q18(d):
    return S.gallery(d.manifest, "true_ng", "G0F00000", 2, 100).select("sample_id", "label", "prefix", "collected_at", "line_no")


@query("Q18_gallery_counts", "SELECT label, prefix, count(*) AS n FROM manifest WHERE status = 'ok' GROUP BY 1, 2")
def q18_counts(d):
    return S.gallery_counts(d.manifest)


@query("Q19_latest_panel", """
WITH newest AS (SELECT n.id, n.record_id, n.image_name, r.glass_id FROM image_names n JOIN records r ON r.id = n.record_id
  WHERE n.heatmap_path <> '' ORDER BY r.created_at DESC, n.id DESC LIMIT 1)
SELECT n.record_id, t.image_result_id, n.image_name, n.glass_id, t.tile_id, t.score,
CASE WHEN is_exclude_zone = 1 THEN 'EXCLUDED' WHEN t.is_bomb = 1 THEN 'BOMB' WHEN is_dust = 1 THEN 'DUST' WHEN is_anomaly = 1 THEN 'NG' ELSE 'OK' END AS status
FROM tiles t JOIN newest n ON n.id = t.image_result_id WHERE t.heatmap_path <> '' ORDER BY is_anomaly DESC, score DESC, tile_id LIMIT 8""")
def q19(d):
    return S.latest_panel(d.records, d.images, d.tiles)


@query("Q20_training_summary", f"""SELECT b.id, b.job_id, coalesce(ok_count, 0) AS ok_count, coalesce(ng_count, 0) AS ng_count
FROM {BUNDLES_SQL} b LEFT JOIN (SELECT job_id, count(*) FILTER (source = 'ok') AS ok_count, count(*) FILTER (source = 'ng') AS ng_count
FROM tile_pool GROUP BY 1) p USING (job_id)""")
def q20(d):
    return S.training_summary(d.tile_pool, bundle_table(d))
