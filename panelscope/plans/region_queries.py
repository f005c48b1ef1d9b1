"""Registered joins on the picture plane and tile geometry (J03.., G ids)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelscope.functions import geometry as G
from panelscope.operators import joins as J
from panelscope.operators import regions as R
from panelscope.plans.registry import query

_ZONES = [(1, 0, 0, 600, 600, 1), (2, 3000, 1500, 800, 400, 1), (3, 5000, 0, 100, 100, 0)]


def zones(d):
    return d.spark.createDataFrame(_ZONES, "zone_no int, x int, y int, w int, h int, enabled int")


def bombs(d):
    """Planted-defect rules in product units 1920 x 1080, one per supplier, for the model and image it stands for."""
    return d.raw("supplier").selectExpr(
        "cast(s_suppkey AS int) AS rule_no", "concat('GN140', substring('BHJKG', cast(1 + s_suppkey % 5 AS int), 1), 'CAL010S') AS model_id",
        "element_at(array('G0F00000','R0F00000','W0F00000','WGF50500','STANDARD','B0F00000','OMIT0000'), cast(1 + (s_suppkey div 5) % 7 AS int)) AS image_prefix",
        "concat('PC', cast(s_suppkey AS string)) AS code", "CASE WHEN s_suppkey % 4 = 0 THEN 'line' ELSE 'point' END AS kind",
        """CASE WHEN s_suppkey % 4 = 0 THEN array(named_struct('x', cast(s_suppkey * 37 % 1920 AS int), 'y', 1), named_struct('x', cast(s_suppkey * 37 % 1920 AS int), 'y', 1080))
           ELSE array(named_struct('x', cast(s_suppkey * 37 % 1920 AS int), 'y', cast(s_suppkey * 53 % 1080 AS int)),
                      named_struct('x', cast(s_suppkey * 71 % 1920 AS int), 'y', cast(s_suppkey * 29 % 1080 AS int))) END AS coords""",
    )


def with_model(d, df):
    """``df`` (record_id) with the model of its record."""
    return df.join(d.records.select(F.col("id").alias("record_id"), "model_id"), "record_id")


def with_bounds(df):
    return df.withColumns(
        {"rx1": F.lit(20), "ry1": F.lit(20), "rx2": F.lit(6164), "ry2": F.lit(4116), "pw": F.lit(1920), "ph": F.lit(1080),
         "img_w": F.lit(6200), "img_h": F.lit(4200)}
    )


_SX, _SY = "(6144 / CAST(1920 AS DOUBLE))", "(4096 / CAST(1080 AS DOUBLE))"
_TX, _TY = f"CAST(trunc(50 * {_SX}) AS INT)", f"CAST(trunc(50 * {_SY}) AS INT)"
BOMBS_SQL = """(SELECT CAST(s_suppkey AS INT) AS rule_no, 'GN140' || substr('BHJKG', CAST(1 + s_suppkey % 5 AS INT), 1) || 'CAL010S' AS model_id,
(['G0F00000','R0F00000','W0F00000','WGF50500','STANDARD','B0F00000','OMIT0000'])[CAST(1 + (s_suppkey // 5) % 7 AS INT)] AS prefix, 'PC' || s_suppkey AS code,
CASE WHEN s_suppkey % 4 = 0 THEN 'line' ELSE 'point' END AS kind,
CASE WHEN s_suppkey % 4 = 0 OR q = 0 THEN s_suppkey * 37 % 1920 ELSE s_suppkey * 71 % 1920 END AS cbx,
CASE WHEN s_suppkey % 4 = 0 THEN 1 WHEN q = 0 THEN s_suppkey * 53 % 1080 ELSE s_suppkey * 29 % 1080 END AS cby,
CASE WHEN s_suppkey % 4 = 0 OR q = 0 THEN s_suppkey * 37 % 1920 ELSE s_suppkey * 71 % 1920 END AS cbx2,
CASE WHEN s_suppkey % 4 = 0 THEN 1080 WHEN q = 0 THEN s_suppkey * 53 % 1080 ELSE s_suppkey * 29 % 1080 END AS cby2
FROM supplier, range(2) r(q) WHERE s_suppkey % 4 <> 0 OR q = 0)"""
_MODEL = "(SELECT id AS rid, model_id FROM records)"


def _mx(v):
    return f"CAST(trunc({v} * {_SX} + 20) AS INT)"


def _my(v):
    return f"CAST(trunc({v} * {_SY} + 20) AS INT)"


def _bomb_cond(px, py, line=""):
    return f"""((kind = 'point' AND abs({px} - {_mx('cbx')}) <= {_TX} AND abs({py} - {_my('cby')}) <= {_TY}) OR
(kind = 'line' {line} AND {px} BETWEEN least({_mx('cbx')}, {_mx('cbx2')}) - {_TX} AND greatest({_mx('cbx')}, {_mx('cbx2')}) + {_TX}
 AND {py} BETWEEN least({_my('cby')}, {_my('cby2')}) AND greatest({_my('cby')}, {_my('cby2')})))"""


def _bomb_sql(table, px, py, line=""):
    """``table`` must have record_id and image_name."""
    return f"""(SELECT t.id, arg_min(code, rule_no) AS bomb FROM {table} t JOIN {_MODEL} m ON rid = t.record_id JOIN {BOMBS_SQL} b ON b.model_id = m.model_id
AND b.prefix = split_part(t.image_name, '_', 1) AND {_bomb_cond(px, py, line)} GROUP BY 1)"""


@query("J06_new_only", """SELECT DISTINCT sample_id, batch_no FROM manifest WHERE batch_no = 3 AND sample_id NOT IN (SELECT sample_id FROM manifest WHERE batch_no < 3)""")
def j06(d):
    rows = d.manifest.where("batch_no = 3").select("sample_id", "batch_no").distinct()
    return J.new_only(rows, d.manifest.where("batch_no < 3").select("sample_id"))


@query("J07_with_scores", "SELECT p.id, c.score FROM tile_pool p LEFT JOIN score_cache c ON c.tile_id = p.id AND c.bundle_id = 10")
def j07(d):
    return J.with_scores(d.tile_pool, d.score_cache, 10).select("id", "score")


@query("J08_drop_scores", """SELECT tile_id, bundle_id, score FROM score_cache WHERE NOT (bundle_id = 10 AND tile_id IN
(SELECT id FROM tile_pool WHERE lighting = 'G0F00000' AND zone = 'inner'))""")
def j08(d):
    return J.drop_scores(d.score_cache, d.tile_pool, bundle=10, lighting="G0F00000", zone="inner")


@query("J09_in_zone", """SELECT id, coalesce((SELECT min(n) FROM (VALUES (1,0,0,600,600),(2,3000,1500,800,400)) z(n,zx,zy,w,h)
WHERE peak_x BETWEEN zx AND zx + w AND peak_y BETWEEN zy AND zy + h), -1) AS zone_no FROM tiles""")
def j09(d):
    points = d.tiles.select("id", F.col("peak_x").alias("px"), F.col("peak_y").alias("py"))
    return R.in_zone(points, zones(d)).select("id", F.coalesce("zone_no", F.lit(-1)).alias("zone_no"))


@query("J10_drop_overlapping", """SELECT id FROM edges WHERE NOT EXISTS (SELECT 1 FROM (VALUES (0,0,600,600),(3000,1500,800,400)) z(zx,zy,w,h)
WHERE bbox_x + bbox_w > zx AND bbox_x < zx + w AND bbox_y + bbox_h > zy AND bbox_y < zy + h)""")
def j10(d):
    rects = d.edges.selectExpr("id", "bbox_x AS bx", "bbox_y AS by", "bbox_w AS bw", "bbox_h AS bh")
    return R.drop_overlapping(rects, zones(d)).select("id")


@query("J11_exclusion_overlap", """SELECT id, overlap FROM (SELECT id, coalesce((SELECT max(greatest(0, least(x + 512, x2) - greatest(x, x1)) * greatest(0, least(y + 512, y2) - greatest(y, y1)) / CAST(262144 AS DOUBLE))
FROM (VALUES (100,100,900,700),(3000,1500,3800,1900)) z(x1,y1,x2,y2)), 0.0) AS overlap FROM tiles) WHERE overlap <= 0.3""")
def j11(d):
    regions = d.spark.createDataFrame([(100, 100, 900, 700), (3000, 1500, 3800, 1900)], "x1 int, y1 int, x2 int, y2 int")
    return R.exclusion_overlap(d.tiles, regions, 0.3).select("id", "overlap")


_LINE = "AND t.part_no % 3 <> 0"


@query("J12_bomb_match", f"""SELECT t.id, coalesce(bomb, '') AS bomb FROM tiles t LEFT JOIN {_bomb_sql('tiles', 'peak_x', 'peak_y', _LINE)} m ON m.id = t.id""")
def j12(d):
    tiles = d.tiles.withColumn("stem", F.regexp_replace("image_name", r"\.tif$", "")).withColumn("is_line", F.col("part_no") % 3 != 0)
    points = with_bounds(with_model(d, tiles))
    return R.bomb_match(points, bombs(d), 50, "peak_x", "peak_y").select("id", F.coalesce("bomb", F.lit("")).alias("bomb"))


_OWN = """EXISTS (SELECT 1 FROM %s b JOIN %s m ON m.model_id = b.model_id WHERE m.rid = t.record_id AND b.prefix = split_part(t.image_name, '_', 1) AND
((kind = 'point' AND abs(px - cbx) <= 50 AND abs(py - cby) <= 50) OR (kind = 'line' AND px BETWEEN least(cbx, cbx2) - 50 AND greatest(cbx, cbx2) + 50 AND py BETWEEN least(cby, cby2) AND greatest(cby, cby2))))""" % (BOMBS_SQL, _MODEL)


@query("J13_mark_bombs", f"""
WITH t AS (SELECT *, CAST(part_no % 1920 AS INT) AS px, CAST(part_no % 1080 AS INT) AS py, x + 256 AS mx, y + 256 AS my FROM tiles)
SELECT t.id, 'tile' AS kind, CASE WHEN is_aoi_coord = 1 AND NOT {_OWN} THEN '' ELSE coalesce(a.bomb, CASE WHEN is_aoi_coord = 1 THEN b.bomb END, '') END AS bomb
FROM t LEFT JOIN {_bomb_sql('t', 'peak_x', 'peak_y', _LINE)} a ON a.id = t.id LEFT JOIN {_bomb_sql('t', 'mx', 'my', _LINE)} b ON b.id = t.id
UNION ALL SELECT e.id, 'edge', coalesce(m.bomb, '') FROM edges e
LEFT JOIN {_bomb_sql('(SELECT e.*, n.image_name FROM edges e JOIN image_names n ON n.id = e.image_result_id)', 'center_x', 'center_y')} m ON m.id = e.id WHERE is_cv_ok = 0""")
def j13(d):
    stem = F.regexp_replace("image_name", r"\.tif$", "")
    # lines are dealt by record once: that serves numbers, names and models of tiles and edges
    lines = d.spread(d.raw("lineitem"), "l_orderkey")
    tiles = with_bounds(with_model(d, d._tiles(lines).withColumn("stem", stem))).withColumns(
        {"product_x": (F.col("part_no") % 1920).cast("int"), "product_y": (F.col("part_no") % 1080).cast("int"), "is_line": F.col("part_no") % 3 != 0}
    )
    names = d._image_names(d.spread(d.raw("lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey")).where("id IS NOT NULL").select(F.col("id").alias("_id"), F.col("record_id").alias("_record"), "image_name")
    # an image is one record's, which is the key of the join; a key or filter of the image would make the lines of edges others than those of tiles, and shuffle them again
    own = (F.col("record_id") == F.col("_record")) & F.coalesce(F.col("image_result_id") == F.col("_id"), F.lit(False))
    edges = with_bounds(with_model(d, d._edges(lines).join(names, own).drop("_id", "_record").withColumn("stem", stem)))
    t, e = R.mark_bombs(tiles, edges, bombs(d))
    code = F.coalesce("bomb", F.lit("")).alias("bomb")
    return t.select("id", F.lit("tile").alias("kind"), code).unionByName(e.select("id", F.lit("edge").alias("kind"), code))


@query("J13_bomb_code", f"""SELECT id, coalesce(k.code, n.code, 'UNKNOWN') AS code
FROM (SELECT i.id, split_part(image_name, '_', 1) AS p, CASE WHEN i.id % 2 = 0 THEN 'line' ELSE 'point' END AS kd, model_id AS mo FROM image_names i JOIN {_MODEL} ON rid = record_id) a
LEFT JOIN (SELECT model_id, prefix, kind, arg_min(code, rule_no) AS code FROM {BOMBS_SQL} GROUP BY 1, 2, 3) k ON k.model_id = mo AND k.prefix = p AND k.kind = kd
LEFT JOIN (SELECT model_id, prefix, arg_min(code, rule_no) AS code FROM {BOMBS_SQL} GROUP BY 1, 2) n ON n.model_id = mo AND n.prefix = p""")
def j13_code(d):
    asked = with_model(d, d.image_names).select(
        "id", "model_id", F.substring_index("image_name", "_", 1).alias("image_prefix"), F.when(F.col("id") % 2 == 0, "line").otherwise("point").alias("kind")
    )
    return R.bomb_code(asked, bombs(d)).select("id", "code")


@query("J14_gt_in_tile", f"""
WITH g AS (SELECT id AS defect_id, record_id, CASE WHEN part_no % 4 = 0 THEN image_name || 'x' ELSE split_part(image_name, '_', 1) END AS gt_stem,
  CASE WHEN part_no % 8 = 0 THEN image_name ELSE '' END AS gt_name, CAST(trunc((part_no % 1920) * {_SX} + 20) AS INT) AS gx,
  CAST(trunc((part_no % 1080) * {_SY} + 20) AS INT) AS gy FROM tiles WHERE is_anomaly = 1),
m AS (SELECT g.defect_id, arg_min(t.tile_id, (t.image_result_id, t.tile_id, t.score)) AS tile_id, arg_min(t.score, (t.image_result_id, t.tile_id, t.score)) AS s
 FROM g JOIN tiles t ON t.record_id = g.record_id AND (split_part(t.image_name, '_', 1) = g.gt_stem OR t.image_name = g.gt_name) AND gx BETWEEN x AND x + 512 AND gy BETWEEN y AND y + 512 GROUP BY 1)
SELECT g.defect_id, coalesce(m.tile_id, -1) AS tile_id, coalesce(m.s, 0) AS gt_score FROM g LEFT JOIN m USING (defect_id)""")
def j14(d):
    lit = F.lit
    prefix = F.substring_index("image_name", "_", 1)
    defects = d.tiles.where("is_anomaly = 1").select(
        F.col("id").alias("defect_id"), "record_id", F.when(F.col("part_no") % 4 == 0, F.concat("image_name", lit("x"))).otherwise(prefix).alias("gt_stem"),
        F.when(F.col("part_no") % 8 == 0, F.col("image_name")).otherwise("").alias("gt_name"),
        G.map_coord(F.col("part_no") % 1920, lit(20), lit(6164), lit(1920)).alias("gx"),
        G.map_coord(F.col("part_no") % 1080, lit(20), lit(4116), lit(1080)).alias("gy"),
    )
    tiles = d.tiles.withColumn("stem", F.regexp_replace("image_name", r"\.tif$", ""))
    return R.gt_in_tile(defects, tiles).select("defect_id", "tile_id", "gt_score")


_PLACES_SQL = f"""(SELECT model_id, prefix, row_number() OVER (PARTITION BY rule_no ORDER BY cbx, cby) + rule_no * 10 AS point_no, {_mx('cbx')} AS place_x, {_my('cby')} AS place_y
FROM {BOMBS_SQL} WHERE kind = 'point')"""
_FOUND_SQL = f"""(SELECT id AS det_id, record_id, model_id, split_part(image_name, '_', 1) AS prefix, peak_x, peak_y FROM tiles JOIN {_MODEL} ON rid = record_id WHERE is_anomaly = 1)"""


def planted_places(d):
    """Places of point rules in pixels, numbered by rule and order."""
    lit = F.lit
    per_rule = F.transform(
        F.array_sort("coords"),
        lambda c, i: F.struct(
            (F.col("rule_no") * 10 + i + 1).cast("long").alias("point_no"), G.map_coord(c["x"], lit(20), lit(6164), lit(1920)).alias("bx"), G.map_coord(c["y"], lit(20), lit(4116), lit(1080)).alias("by")
        ),
    )
    return bombs(d).where("kind = 'point'").select("model_id", F.col("image_prefix").alias("prefix"), F.inline(per_rule))


def anomalies(d):
    return with_model(d, d.tiles.where("is_anomaly = 1")).select("record_id", "model_id", F.substring_index("image_name", "_", 1).alias("prefix"), F.col("id").alias("det_id"), "peak_x", "peak_y")


@query("J15_nearest_detection", f"""SELECT record_id, bomb_no, coalesce(det_id, -1) AS det_id, round(coalesce(dd, -1), 6) AS distance, coalesce(matched, false) AS matched FROM (
SELECT record_id, b.point_no AS bomb_no, arg_min(det_id, (dd, det_id)) FILTER (det_id IS NOT NULL) AS det_id, min(dd) AS dd, bool_or(abs(peak_x - place_x) <= {_TX} AND abs(peak_y - place_y) <= {_TY}) AS matched
FROM (SELECT r.rid AS record_id, b.point_no, place_x, place_y, t.det_id, peak_x, peak_y, sqrt(pow(peak_x - place_x, 2) + pow(peak_y - place_y, 2)) AS dd FROM {_MODEL} r JOIN {_PLACES_SQL} b USING (model_id)
LEFT JOIN {_FOUND_SQL} t ON t.record_id = r.rid AND t.prefix = b.prefix) b GROUP BY 1, 2)""")
def j15(d):
    points = planted_places(d).withColumnRenamed("point_no", "bomb_no")
    tol = lambda size, pixels: F.lit(int(50 * pixels / size))
    prefix = F.substring_index("image_name", "_", 1).alias("prefix")
    # lines are dealt by record: that serves tile numbers, lists of detections and their records
    tiles = d._tiles(d.spread(d.raw("lineitem"), "l_orderkey"))
    found = tiles.where("is_anomaly = 1").select("record_id", prefix, F.col("id").alias("det_id"), F.col("peak_x").alias("dx"), F.col("peak_y").alias("dy")).withColumns({"tx": tol(1920, 6144), "ty": tol(1080, 4096)})
    records = d.records.select(F.col("id").alias("record_id"), "model_id")
    return R.nearest_per_record(records, points, found).select("record_id", "bomb_no", "det_id", "distance", "matched")


@query("J15_nearest_point", f"""SELECT det_id, coalesce(arg_min(point_no, (dd, point_no)), -1) AS point_no, round(coalesce(min(dd), -1), 6) AS distance
FROM (SELECT det_id, point_no, sqrt(pow(peak_x - place_x, 2) + pow(peak_y - place_y, 2)) AS dd FROM {_FOUND_SQL} t LEFT JOIN {_PLACES_SQL} b USING (model_id, prefix)) GROUP BY 1""")
def j15_point(d):
    asked = anomalies(d).withColumnsRenamed({"peak_x": "px", "peak_y": "py"})
    return R.nearest_point(asked, planted_places(d)).select("det_id", F.coalesce("point_no", F.lit(-1)).alias("point_no"), F.round(F.coalesce("distance", F.lit(-1.0)), 6).alias("distance"))


@query("J16_clean_by_datastr", """
WITH a AS (SELECT inference_record_id, datastr FROM joined QUALIFY row_number() OVER (PARTITION BY inference_record_id ORDER BY length(datastr) DESC, datastr) = 1)
SELECT line_no, coalesce(CASE WHEN coalesce(datastr, '') = '' THEN NULL WHEN NOT contains(datastr, prefix || ',') THEN 'prefix_not_in_datastr(' || prefix || ')'
WHEN contains(datastr, prefix || ',OK') THEN 'ric_ok' END, 'kept') AS reason
FROM manifest m LEFT JOIN a USING (inference_record_id) WHERE label = 'true_ng'""")
def j16(d):
    from panelscope.plans.accuracy_queries import joined

    return R.clean_by_datastr(d.manifest, joined(d).select("inference_record_id", "datastr")).select(
        "line_no", F.coalesce("reason", F.lit("kept")).alias("reason")
    )


@query("J17_clean_bombs", """SELECT line_no FROM manifest m WHERE image_result_id NOT IN (SELECT id FROM images WHERE is_bomb = 1)
AND NOT EXISTS (SELECT 1 FROM tiles t WHERE t.is_bomb = 1 AND t.image_result_id = m.image_result_id AND CAST(t.tile_id AS VARCHAR) = m.tile_idx)
AND line_no NOT IN (SELECT id FROM edges WHERE is_bomb = 1)""")
def j17(d):
    m = d.manifest.withColumn("edge_defect_id", F.col("line_no").cast("string"))
    return R.clean_bombs(m, d.images, d.tiles, d.edges).select("line_no")


# ---- tile geometry ----------------------------------------------------------


def image_bounds(d):
    """Bounds per image that differ from image to image."""
    return d.image_names.selectExpr(
        "id", "cast(100 + id % 50 AS int) AS x1", "cast(60 + id % 30 AS int) AS y1",
        "cast(2100 + id % 700 AS int) AS x2", "cast(1500 + id % 300 AS int) AS y2", "2600 AS img_w", "1900 AS img_h",
    )


BOUNDS_SQL = """(SELECT id, CAST(100 + id % 50 AS INT) AS x1, CAST(60 + id % 30 AS INT) AS y1, CAST(2100 + id % 700 AS INT) AS x2,
CAST(1500 + id % 300 AS INT) AS y2, 2600 AS img_w, 1900 AS img_h FROM image_names)"""
_AXIS = "(SELECT b.*, list_sort(list_distinct(list_concat(range({lo}, {hi} - 511, 512), [CAST({hi} - 512 AS BIGINT)]))) AS p FROM {t} b)"
GRID_SQL = f"""(SELECT id, x1, y1, x2, y2, img_w, img_h, xs, ys, CAST(xs[i] AS INT) AS tx, CAST(ys[j] AS INT) AS ty, i - 1 AS ix, j - 1 AS iy, len(xs) AS nx, len(ys) AS ny FROM
(SELECT b.*, list_sort(list_distinct(list_concat(range(x1, x2 - 511, 512), [CAST(x2 - 512 AS BIGINT)]))) AS xs,
 list_sort(list_distinct(list_concat(range(y1, y2 - 511, 512), [CAST(y2 - 512 AS BIGINT)]))) AS ys FROM {BOUNDS_SQL} b) g, range(1, 12) ri(i), range(1, 12) rj(j)
 WHERE i <= len(xs) AND j <= len(ys))"""


@query("G04_tile_grid", f"""SELECT id, CAST(iy * nx + ix AS INT) AS tile_id, tx, ty, CAST(ix = 0 AS INT) AS is_left, CAST(ix = nx - 1 AS INT) AS is_right,
CAST(iy = 0 AS INT) AS is_top, CAST(iy = ny - 1 AS INT) AS is_bottom FROM {GRID_SQL}""")
def g04(d):
    return R.tile_grid(image_bounds(d)).select("id", "tile_id", "tx", "ty", "is_left", "is_right", "is_top", "is_bottom")


@query("G05_outer_ring", f"""
WITH g AS (SELECT DISTINCT id, x1, y1, x2, y2, img_w, img_h, xs, ys FROM {GRID_SQL}),
a AS (SELECT *, x1 - least(256, x1) AS lx, x2 - 512 + least(256, img_w - x2) AS rx, y1 - least(256, y1) AS ty0, y2 - 512 + least(256, img_h - y2) AS by0,
  least(256, greatest(0, img_w - x2)) > 0 AS has_r, least(256, greatest(0, img_h - y2)) > 0 AS has_b FROM g),
ex AS (SELECT id, unnest(list_transform(xs, lambda v, i: {{'at': v, 'ring': 0, 'e': CAST(i = 1 OR i = len(xs) AS INT)}})) AS v FROM a
  UNION ALL SELECT id, {{'at': lx::BIGINT, 'ring': 1, 'e': 1}} FROM a UNION ALL SELECT id, {{'at': rx::BIGINT, 'ring': 1, 'e': 1}} FROM a WHERE has_r),
ey AS (SELECT id, unnest(list_transform(ys, lambda v, i: {{'at': v, 'ring': 0, 'e': CAST(i = 1 OR i = len(ys) AS INT)}})) AS v FROM a
  UNION ALL SELECT id, {{'at': ty0::BIGINT, 'ring': 1, 'e': 1}} FROM a UNION ALL SELECT id, {{'at': by0::BIGINT, 'ring': 1, 'e': 1}} FROM a WHERE has_b)
SELECT id, CAST(ex.v.at AS INT) AS tx, CAST(ey.v.at AS INT) AS ty, greatest(ex.v.ring, ey.v.ring) AS is_ring,
CAST(ex.v.e = 1 AND ey.v.e = 1 AND ex.v.ring = ey.v.ring AS INT) AS is_corner, greatest(ex.v.e, ey.v.e) AS is_outermost FROM ex JOIN ey USING (id)""")
def g05(d):
    return R.outer_ring(image_bounds(d)).select("id", "tx", "ty", "is_ring", "is_corner", "is_outermost")


_PX1, _PY1, _PX2, _PY2 = "(x1 + id % 300)", "(y1 + id % 200)", "(x2 - id % 100)", "(y2 - id % 90)"
_COV = f"""(greatest(0, least(tx + 512, {_PX2}) - greatest(tx, {_PX1})) * greatest(0, least(ty + 512, {_PY2}) - greatest(ty, {_PY1})) / CAST(262144 AS DOUBLE))"""


def _touch_sql():
    near = []
    for cx in ("tx", "tx + 512"):
        for cy in ("ty", "ty + 512"):
            near.append(f"((abs({cx} - {_PX1}) <= 1 OR abs({cx} - {_PX2}) <= 1 OR abs({cy} - {_PY1}) <= 1 OR abs({cy} - {_PY2}) <= 1))")
    return "(" + " OR ".join(near) + ")"


@query("G06_classify_zone", f"""SELECT id, tx, ty, CAST(round(cov * 262144) AS BIGINT) AS covered_px, CASE WHEN cov < 0.3 THEN 'outside' WHEN cov < 1 - 1e-6 THEN 'edge' WHEN {_touch_sql()} THEN 'edge'
WHEN ix = 0 OR iy = 0 OR ix = nx - 1 OR iy = ny - 1 THEN 'edge' ELSE 'inner' END AS zone FROM (SELECT *, {_COV} AS cov FROM {GRID_SQL})""")
def g06(d):
    c = F.col
    tiles = R.tile_grid(image_bounds(d)).withColumns(
        {
            "size": F.lit(512),
            "is_outermost": F.greatest("is_left", "is_right", "is_top", "is_bottom"),
            "polygon": G.polygon(
                (c("x1") + c("id") % 300, c("y1") + c("id") % 200), (c("x2") - c("id") % 100, c("y1") + c("id") % 200),
                (c("x2") - c("id") % 100, c("y2") - c("id") % 90), (c("x1") + c("id") % 300, c("y2") - c("id") % 90),
            ),
        }
    )
    return R.classify_zone(tiles).select("id", "tx", "ty", F.round(F.col("coverage") * 262144).cast("long").alias("covered_px"), "zone")


_COORD = f"""(SELECT id, CAST(trunc((part_no % 1920) * {_SX} + 20) AS INT) AS ix, CAST(trunc((part_no % 1080) * {_SY} + 20) AS INT) AS iy FROM tiles WHERE is_aoi_coord = 1)"""


def _defects(d):
    return with_bounds(
        d.tiles.where("is_aoi_coord = 1").selectExpr(
            "id", "image_result_id", "cast(part_no % 1920 AS int) AS product_x", "cast(part_no % 1080 AS int) AS product_y",
            "30 AS ox1", "30 AS oy1", "6150 AS ox2", "4100 AS oy2", "cast(startswith(image_name, 'B0F') AS int) AS is_skip",
        )
    )


@query("G23_coord_tiles", f"""SELECT id, ix, iy, greatest(0, least(ix - 256, 5688)) AS tx, greatest(0, least(iy - 256, 3688)) AS ty, CAST(ix - 20 < 256 AS INT) AS is_left,
CAST(6164 - ix < 256 AS INT) AS is_right, CAST(iy - 20 < 256 AS INT) AS is_top, CAST(4116 - iy < 256 AS INT) AS is_bottom FROM {_COORD}""")
def g23(d):
    return R.coord_tiles(_defects(d)).select("id", "ix", "iy", "tx", "ty", "is_left", "is_right", "is_top", "is_bottom")


@query("G23_coord_tiles_old", f"""SELECT id, CASE WHEN (ix - 30 < 256 OR 6150 - ix < 256 OR iy - 30 < 256 OR 4100 - iy < 256) AND NOT b THEN 'edge' ELSE 'tile' END AS route
FROM {_COORD} JOIN (SELECT id, starts_with(image_name, 'B0F') AS b FROM tiles) USING (id)""")
def g23_old(d):
    return R.coord_tiles(_defects(d), mode="old").select("id", "route")


@query("G23_number_after", """SELECT t.id, CAST(m.last + row_number() OVER (PARTITION BY t.image_result_id ORDER BY t.id) AS INT) AS tile_id FROM tiles t
JOIN (SELECT image_result_id, max(tile_id) AS last FROM tiles GROUP BY 1) m USING (image_result_id) WHERE is_aoi_coord = 1""")
def g23_number(d):
    new = R.coord_tiles(_defects(d)).withColumnRenamed("id", "defect_id")
    return R.number_after(new, d.tiles).select(F.col("defect_id").alias("id"), "tile_id")


@query("G24_coord_only", "SELECT id FROM tiles WHERE is_aoi_coord = 1")
def g24(d):
    return R.coord_only(d.tiles, False).select("id")


@query("G27_crop_rect", """
SELECT id, 'patchcore_tile' AS kind, greatest(0, x) AS x1, greatest(0, y) AS y1, least(5900, x + 512) AS x2, least(4000, y + 512) AS y2,
greatest(0, 512 - (least(5900, x + 512) - greatest(0, x))) AS pad_right, greatest(0, 512 - (least(4000, y + 512) - greatest(0, y))) AS pad_bottom FROM tiles
UNION ALL SELECT id, 'edge_defect', cx, cy, least(5900, cx + 512), least(4000, cy + 512), 0, 0 FROM
(SELECT id, greatest(0, least(greatest(0, center_x - 256), 5388)) AS cx, greatest(0, least(greatest(0, center_y - 256), 3488)) AS cy FROM edges)""")
def g27(d):
    t = d.tiles.selectExpr("id", "'patchcore_tile' AS kind", "x", "y", "width AS w", "height AS h", "x + 256 AS cx", "y + 256 AS cy")
    e = d.edges.selectExpr("id", "'edge_defect' AS kind", "0 AS x", "0 AS y", "512 AS w", "512 AS h", "center_x AS cx", "center_y AS cy")
    both = t.unionByName(e).withColumn("img_w", F.lit(5900)).withColumn("img_h", F.lit(4000))
    return R.crop_rect(both).select("id", "kind", "x1", "y1", "x2", "y2", "pad_right", "pad_bottom")


@query("G29_relative_region", f"""SELECT id, greatest(x1, ax - 300) AS rx1, greatest(y1, ay - 200) AS ry1, ax AS rx2, ay AS ry2 FROM
(SELECT *, CASE WHEN id % 2 = 0 THEN x2 ELSE CAST(x2 - 7 AS INT) END AS ax, CASE WHEN id % 2 = 0 THEN y2 ELSE CAST(y2 - 5 AS INT) END AS ay FROM {BOUNDS_SQL})""")
def g29(d):
    c = F.col
    images = image_bounds(d).withColumn(
        "polygon", F.when(c("id") % 2 == 1, G.polygon((0, 0), (0, 0), (c("x2") - 7, c("y2") - 5), (0, 0)))
    )
    r = R.relative_region(images, 300, 200)
    return r.select("id", *[c(f"region.{a}").alias(f"r{a}") for a in ("x1", "y1", "x2", "y2")])


_SIDES = {
    "left": {"width": 200, "first": 10, "last": 20, "threshold": 3},
    "right": {"width": 5000, "first": 10, "last": 20, "threshold": 4},
    "top": {"width": 150, "first": 30, "last": 2600, "threshold": 5},
    "bottom": {"width": 150, "first": 30, "last": 40, "threshold": 6},
}


@query("G30_side_strips", f"""
SELECT * FROM (SELECT id, 'left' AS side, x1 AS sx1, y1 + 10 AS sy1, least(x1 + 200, x2) AS sx2, y2 - 20 AS sy2, 3 AS threshold FROM {BOUNDS_SQL}
UNION ALL SELECT id, 'right', greatest(x2 - 5000, x1), y1 + 10, x2, y2 - 20, 4 FROM {BOUNDS_SQL}
UNION ALL SELECT id, 'top', x1 + 30, y1, x2 - 2600, least(y1 + 150, y2), 5 FROM {BOUNDS_SQL}
UNION ALL SELECT id, 'bottom', x1 + 30, greatest(y2 - 150, y1), x2 - 40, y2, 6 FROM {BOUNDS_SQL}) WHERE sx2 > sx1 AND sy2 > sy1""")
def g30(d):
    return R.side_strips(image_bounds(d), _SIDES).select("id", "side", "sx1", "sy1", "sx2", "sy2", "threshold")


@query("G02_bounds_offset", f"""SELECT id, nx1 AS x1, ny1 AS y1, nx2 AS x2, ny1 + least(h, greatest(512, h - 1200)) AS y2 FROM (SELECT *, ny2 - ny1 AS h FROM
(SELECT id, greatest(0, x1 + 5) AS nx1, greatest(0, y1 + 5) AS ny1, least(img_w, x2 - 5) AS nx2, least(img_h, y2 - 5) AS ny2 FROM {BOUNDS_SQL}))""")
def g02_offset(d):
    raw = image_bounds(d).selectExpr("id", "x1 AS rx1", "y1 AS ry1", "x2 AS rx2", "y2 AS ry2", "img_w", "img_h")
    return R.bounds_with_offset(raw, 5, 1200).select("id", "x1", "y1", "x2", "y2")
