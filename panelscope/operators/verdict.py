"""Verdict rules over tile, edge and image rows (V ids)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelscope.functions import text


def is_real() -> Column:
    """A tile that counts as a defect."""
    return (
        (F.col("is_bomb") == 0)
        & (F.col("is_dust") == 0)
        & (F.col("is_exclude_zone") == 0)
        & (F.col("scratch_filtered") == 0)
        & (F.col("is_anomaly") == 1)
    )


def is_real_edge() -> Column:
    return (F.col("is_dust") == 0) & (F.col("is_bomb") == 0) & (F.col("is_cv_ok") == 0)


def _detail_rows(tiles: DataFrame, edges: DataFrame | None) -> DataFrame:
    peak_known = (F.col("peak_x") >= 0) & (F.col("peak_y") >= 0)
    stem = F.regexp_replace("image_name", r"\.[^.]*$", "")
    rows = tiles.select(
        "record_id",
        is_real().cast("int").alias("real"),
        F.lit(0).alias("part"),
        "id",
        F.when(
            is_real(),
            F.struct(
                stem.alias("image"),
                F.lit("tile").alias("type"),
                F.col("tile_id").cast("long").alias("no"),
                "x",
                "y",
                F.when(peak_known, F.col("peak_x")).otherwise((F.col("x") + F.expr("width div 2")).cast("int")).alias("peak_x"),
                F.when(peak_known, F.col("peak_y")).otherwise((F.col("y") + F.expr("height div 2")).cast("int")).alias("peak_y"),
                F.round("score", 4).alias("score"),
            ),
        ).alias("detail"),
    )
    if edges is None:
        return rows
    real = is_real_edge()
    return rows.unionByName(
        edges.select(
            "record_id",
            real.cast("int").alias("real"),
            F.lit(1).alias("part"),
            "id",
            F.when(
                real,
                F.struct(
                    F.col("image_result_id").cast("string").alias("image"),
                    F.concat(F.lit("cv_edge_"), "side").alias("type"),
                    F.col("id").alias("no"),
                    F.col("bbox_x").alias("x"),
                    F.col("bbox_y").alias("y"),
                    F.col("center_x").alias("peak_x"),
                    F.col("center_y").alias("peak_y"),
                    F.col("max_diff").cast("double").alias("score"),
                ),
            ).alias("detail"),
        )
    )


def panel_verdict(tiles: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """V02 (tiles only) and V03 (with edges): verdict and details per record.

    The detail list is per panel, so its length is bounded by the tile count
    of one panel.
    """
    return (
        _detail_rows(tiles, edges)
        .groupBy("record_id")
        .agg(
            F.max("real").alias("any_real"),
            F.sum("real").alias("n_details"),
            F.array_sort(
                F.collect_list(F.when(F.col("real") == 1, F.struct("part", "id", "detail")))
            ).alias("found"),
        )
        .select(
            "record_id",
            F.when(F.col("any_real") == 1, "NG").otherwise("OK").alias("verdict"),
            "n_details",
            F.to_json(F.transform("found", lambda d: d["detail"])).alias("details"),
        )
    )


def image_flags(tiles: DataFrame, edges: DataFrame) -> DataFrame:
    """Flags per image; tiles and edges share one shuffle."""
    real = is_real().cast("int")
    rows = tiles.select(
        "image_result_id",
        F.lit(1).alias("tile"),
        real.alias("real"),
        "is_dust",
        "is_bomb",
        "score",
        "scratch_filtered",
        F.lit(0).alias("edge"),
    ).unionByName(
        edges.select(
            "image_result_id",
            F.lit(0).alias("tile"),
            F.lit(0).alias("real"),
            F.lit(0).alias("is_dust"),
            F.lit(0).alias("is_bomb"),
            F.lit(None).cast("double").alias("score"),
            F.lit(0).alias("scratch_filtered"),
            is_real_edge().cast("int").alias("edge"),
        )
    )
    sums = rows.groupBy("image_result_id").agg(
        F.sum("tile").alias("anomaly_count"),
        F.sum("real").alias("real_tiles"),
        F.sum("is_dust").alias("dusty"),
        F.sum("is_bomb").alias("bombs"),
        F.sum("edge").alias("edge_defect_count"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("max_score"),
        F.sum("scratch_filtered").alias("scratch_filter_count"),
    )
    clean_edges = F.col("edge_defect_count") == 0
    return sums.select(
        "image_result_id",
        ((F.col("real_tiles") > 0) | ~clean_edges).cast("int").alias("is_ng"),
        ((F.col("anomaly_count") > 0) & (F.col("dusty") == F.col("anomaly_count")) & clean_edges)
        .cast("int")
        .alias("is_dust_only"),
        ((F.col("bombs") > 0) & (F.col("real_tiles") == 0) & clean_edges).cast("int").alias("is_bomb"),
        "anomaly_count",
        "edge_defect_count",
        "max_score",
        "scratch_filter_count",
    )


def tile_rows(kept: DataFrame) -> DataFrame:
    """Rows to store of the tiles that V15 keeps; those it flags as below their threshold are no anomalies."""
    return kept.withColumn("is_anomaly", 1 - F.col("below_threshold"))


def simple_verdict(ai: Column) -> Column:
    return (
        F.when(F.coalesce(ai, F.lit("")) == "", "")
        .when(ai == "OK", "OK")
        .when(ai.startswith("NG"), "NG")
        .when(ai.startswith("ERR"), "ERR")
        .otherwise(ai)
    )


def image_status(images: DataFrame) -> DataFrame:
    """V06 for images: dust, then bomb, then NG."""
    return images.withColumn(
        "status",
        F.when(F.col("is_dust_only") == 1, "DUST")
        .when(F.col("is_bomb") == 1, "BOMB")
        .when(F.col("is_ng") == 1, "NG")
        .otherwise("OK"),
    )


def tile_status(tiles: DataFrame) -> DataFrame:
    """V06 for tiles: badge and notes; later rules override earlier badges."""
    coord, anomalous = F.col("is_aoi_coord") == 1, F.col("is_anomaly") == 1
    excluded, dust = F.col("is_exclude_zone") == 1, F.col("is_dust") == 1
    bomb = F.col("is_bomb") == 1
    rescued = (F.col("scratch_filtered") == 1) & ~bomb & ~dust
    badge = (
        F.when(rescued, "badge-ok")
        .when(bomb, "badge-err")
        .when(excluded, "badge-ok")
        .when(dust, "badge-err")
        .when(coord & ~anomalous, "badge-ok")
        .otherwise("badge-ng")
    )
    note = F.concat_ws(
        "|",
        F.when(coord, F.concat(F.lit("aoi:"), "aoi_defect_code", F.when(anomalous, ":NG").otherwise(":OK"))),
        F.when(excluded, "excluded").when(dust, "dust"),
        F.when(bomb, F.concat(F.lit("bomb:"), "bomb_code")),
        F.when(rescued, "rescued"),
    )
    return tiles.withColumn("badge", badge).withColumn("note", note)


def panel_gate(requests: DataFrame, known_models: DataFrame) -> DataFrame:
    """HY short cut, then missing model, directory or images."""
    joined = requests.join(known_models.withColumn("_known", F.lit(1)), "model_id", "left")
    return joined.withColumn(
        "gate",
        F.when(F.col("machine_judgment") == "HY", "ERR:HY")
        .when(F.col("_known").isNull(), "ERR:MODEL_NOT_FOUND")
        .when(F.coalesce(F.col("image_dir"), F.lit("")) == "", "ERR:DIR_NOT_FOUND")
        .when(F.coalesce(F.col("image_count"), F.lit(0)) == 0, "ERR:NO_IMAGES"),
    ).drop("_known")


def scratch_filter(tiles: DataFrame, conformal: float, safety: float = 1.1) -> DataFrame:
    """Flip tiles whose scratch score passes the safe threshold."""
    threshold = min(conformal * safety, 0.9999)
    flip = (
        (F.col("scratch_score") > threshold)
        & ~F.col("image_name").startswith("B0F")
        & (F.col("is_bomb") == 0)
        & (F.col("is_anomaly") == 1)
    )
    return tiles.withColumn("scratch_filtered", flip.cast("int"))


def route(tiles: DataFrame, thresholds: DataFrame, default: float = 0.75) -> DataFrame:
    """Threshold by (prefix, zone), else by prefix alone, else default."""
    zoned = thresholds.where("zone IS NOT NULL").select("prefix", "zone", F.col("threshold").alias("t_zone"))
    flat = thresholds.where("zone IS NULL").select("prefix", F.col("threshold").alias("t_flat"))
    return (
        tiles.join(zoned, ["prefix", "zone"], "left")
        .join(flat, "prefix", "left")
        .withColumn("threshold", F.coalesce("t_zone", "t_flat", F.lit(default)))
        .drop("t_zone", "t_flat")
    )


def keep_tiles(scored: DataFrame) -> DataFrame:
    """Keep by threshold; AOI tiles below it stay, flagged; black-image
    AOI tiles without any response stay flagged as well."""
    below = F.col("score") < F.col("threshold")
    black_quiet = F.col("image_name").startswith("B0F") & (F.col("score") <= 0)
    coord = F.col("is_aoi_coord") == 1
    return scored.where(~below | coord).withColumn(
        "below_threshold", (coord & (below | black_quiet)).cast("int")
    )


REFERENCE_ORDER = {
    # Order of preference for the picture the panel is measured on.
    "new": ["STANDARD", "G0F", "W0F", "R0F", "WGF"],
    "old": ["W0F", "WGF", "G0F", "R0F", "STANDARD"],
}


def reference_image(images: DataFrame, mode: str = "new") -> DataFrame:
    """Preferred image per record; black images never qualify."""
    rank = F.lit(None).cast("int")
    for no, prefix in reversed(list(enumerate(REFERENCE_ORDER[mode]))):
        rank = F.when(F.col("image_name").startswith(prefix), F.lit(no)).otherwise(rank)
    return (
        images.withColumn("_rank", rank)
        .where("_rank IS NOT NULL")
        .groupBy("record_id")
        .agg(F.min(F.struct("_rank", "image_name", "id")).alias("best"))
        .select("record_id", F.col("best.image_name").alias("image_name"), F.col("best.id").alias("image_id"))
    )


def representative(edges: DataFrame, keys: list[str]) -> DataFrame:
    """One defect per key: real, then patchcore, then largest."""
    best = F.max(
        F.struct(
            (F.lit(0) - F.col("is_dust")).alias("real"),
            (F.col("source_inspector") == "patchcore").cast("int").alias("pc"),
            "area",
            "max_diff",
            (-F.col("id")).alias("neg_id"),
        )
    )
    return edges.groupBy(*keys).agg(best.alias("b")).select(
        *keys,
        (-F.col("b.neg_id")).alias("id"),
        (-F.col("b.real")).alias("is_dust"),
        F.when(F.col("b.pc") == 1, "patchcore").otherwise("cv").alias("source_inspector"),
        F.col("b.area").alias("area"),
        F.col("b.max_diff").alias("max_diff"),
    )


def ok_reason(score, threshold, area, min_area) -> Column:
    """V18."""
    return F.when(score < threshold, "Score<Thr").when(area < min_area, "Area<Min").otherwise("")


# Why a known defect was not reported, in order of the first that holds.
MISS_REASONS = {
    "not_found": "PANEL_NOT_FOUND", "error": "INFERENCE_ERROR", "duplicate": "DUPLICATE_PANEL", "dust_bomb": "FILTERED_BY_DUST_AND_BOMB", "dust": "FILTERED_BY_DUST",
    "bomb": "FILTERED_BY_BOMB", "undetectable": "MODEL_UNDETECTABLE", "threshold": "THRESHOLD_TOO_HIGH", "outside": "GT_OUTSIDE_TILES",
}


def miss_reason(panels: DataFrame) -> DataFrame:
    """Adds ``reason``.  ``panels``: found, has_error, is_duplicate, dusty,
    bombs, max_score of the panel, n_gt known defects, gt_in_tile of them."""
    r = MISS_REASONS
    return panels.withColumn(
        "reason",
        F.when(~F.col("found"), r["not_found"])
        .when(F.col("has_error"), r["error"])
        .when(F.col("is_duplicate"), r["duplicate"])
        .when((F.col("dusty") > 0) & (F.col("bombs") > 0), r["dust_bomb"])
        .when(F.col("dusty") > 0, r["dust"])
        .when(F.col("bombs") > 0, r["bomb"])
        .when(F.col("max_score") < 0.30, r["undetectable"])
        .when(F.col("max_score") < 0.60, r["threshold"])
        .when((F.col("n_gt") > 0) & (F.col("gt_in_tile") == 0), r["outside"])
        .otherwise(r["threshold"]),
    )


def candidates(
    joined: DataFrame, images: DataFrame, tiles: DataFrame, edges: DataFrame, include_true_ng: bool = True
) -> DataFrame:
    """Crop candidates of AI-NG panels, one row per tile or edge finding.

    ``joined`` is accuracy with ``inference_record_id`` and ``over_category``.
    """
    head = labelled_accuracy(joined).where("label IS NOT NULL")
    if not include_true_ng:
        head = head.where("label <> 'true_ng'")
    head = head.where("inference_record_id IS NOT NULL").select(
        F.col("inference_record_id").alias("record_id"),
        F.col("id").alias("accuracy_id"),
        F.col("glass_id"),
        "label",
        F.col("result_ric").alias("ric_judgment"),
        F.coalesce("over_category", F.lit("")).alias("over_review_category"),
        text.ric_per_prefix(F.col("datastr")).alias("_per_prefix"),
    )
    kept = candidate_images(head, images).where("image_drop IS NULL")
    by_image = kept.select(
        "accuracy_id", "glass_id", "label", "record_id", F.col("image_id").alias("image_result_id"),
        "image_name", "prefix", "ric_judgment", "over_review_category",
    )
    from_tiles = by_image.join(
        tiles.where("is_bomb = 0 AND is_anomaly = 1").select(
            "image_result_id", "tile_id", "x", "y", "width", "height", "score"
        ),
        "image_result_id",
    ).select(
        *by_image.columns,
        text.sample_id("glass_id", "image_name", "tile", "tile_id").alias("sample_id"),
        F.lit("patchcore_tile").alias("source_type"),
        F.col("score").alias("ai_score"),
        (F.col("x") + F.expr("width div 2")).cast("int").alias("defect_x"),
        (F.col("y") + F.expr("height div 2")).cast("int").alias("defect_y"),
        F.concat(F.lit("tile"), F.col("tile_id").cast("string")).alias("sample_key"),
    )
    from_edges = by_image.join(
        edges.where("is_bomb = 0").select(
            "image_result_id", F.col("id").alias("edge_id"), "center_x", "center_y", "max_diff"
        ),
        "image_result_id",
    ).select(
        *by_image.columns,
        text.sample_id("glass_id", "image_name", "edge", "edge_id").alias("sample_id"),
        F.lit("edge_defect").alias("source_type"),
        F.col("max_diff").cast("double").alias("ai_score"),
        F.col("center_x").alias("defect_x"),
        F.col("center_y").alias("defect_y"),
        F.concat(F.lit("edge"), F.col("edge_id").cast("string")).alias("sample_key"),
    )
    return from_tiles.unionByName(from_edges)


def labelled_accuracy(joined: DataFrame) -> DataFrame:
    """AI-NG accuracy rows with their sample label."""
    glass = F.col("pnl_id").alias("glass_id")
    return joined.where("result_ai = 'NG'").select(
        "*", glass, text.sample_label(F.col("result_ric"), F.col("over_category")).alias("label")
    )


def candidate_images(head: DataFrame, images: DataFrame) -> DataFrame:
    """Images of labelled panels, with the reason an image is left out."""
    prefix = text.image_prefix(F.col("image_name"))
    verdict = F.try_element_at(F.col("_per_prefix"), F.col("prefix"))
    return (
        head.join(
            images.select("record_id", F.col("id").alias("image_id"), "image_name", F.col("is_bomb").alias("image_bomb")),
            "record_id",
        )
        .withColumn("prefix", prefix)
        .withColumn(
            "image_drop",
            F.when(F.col("image_bomb") == 1, "images_bomb_skipped")
            .when(F.col("image_name").startswith("B0F"), "images_b0f_skipped")
            .when(
                (F.col("label") == "true_ng")
                & (F.size("_per_prefix") > 0)
                & (F.coalesce(verdict, F.lit("")) != "NG"),
                "images_ric_ok_skipped",
            ),
        )
    )


def candidate_outcome(
    candidates: DataFrame, sizes: DataFrame, crops: DataFrame, size: int = 512
) -> DataFrame:
    """Status, crop path; ``sizes`` has image width/height (absent = no
    source), ``crops`` the overexposed flag per sample."""
    half = size // 2
    inside_w = F.least(F.col("image_w"), F.col("defect_x") + half) - F.greatest(F.lit(0), F.col("defect_x") - half)
    inside_h = F.least(F.col("image_h"), F.col("defect_y") + half) - F.greatest(F.lit(0), F.col("defect_y") - half)
    inside = F.greatest(F.lit(0), inside_w) * F.greatest(F.lit(0), inside_h)
    joined = candidates.join(sizes, "image_result_id", "left").join(crops, "sample_id", "left")
    status = (
        F.when(F.col("image_w").isNull(), "skipped_no_source")
        .when((F.col("source_type") == "edge_defect") & (inside < size * size * 0.25), "skipped_out_of_bounds")
        .when((F.col("label") == "true_ng") & (F.coalesce(F.col("overexposed"), F.lit(0)) == 1), "skipped_overexposure")
        .otherwise("ok")
    )
    name = text.sample_filename("glass_id", "image_name", "sample_key", F.col("taken_at"))
    return joined.withColumn("status", status).withColumn(
        "crop_path",
        F.when(F.col("status") == "ok", F.concat_ws("/", "label", "prefix", F.lit("crop"), name)).otherwise(""),
    )


def training_tiles(tiles: DataFrame, panels: DataFrame, full_panels: int = 3) -> DataFrame:
    """The first panels keep all tiles, the rest only corner tiles.

    ``panels`` holds (record_id, input_no); input order is given, so no global
    window is needed.
    """
    return (
        tiles.join(panels.select("record_id", "input_no"), "record_id")
        .withColumn("mode", F.when(F.col("input_no") <= full_panels, "full").otherwise("corner"))
        .where("mode = 'full' OR is_corner = 1")
    )


def sample_ng(manifest: DataFrame, per_lighting: int = 100, seed: int = 42, band: int = 768) -> DataFrame:
    """Zone of true_ng crops and a seeded sample per lighting."""
    zoned = manifest.where("label = 'true_ng' AND status = 'ok'").withColumn(
        "zone",
        F.when(F.col("defect_y").isNull(), None).when(F.col("defect_y") < band, "edge").otherwise("inner"),
    )
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("sample_id")))
    w = W.partitionBy("prefix").orderBy("_key", "sample_id")
    return (
        zoned.withColumn("_key", key)
        .withColumn("pick_no", F.row_number().over(w))
        .where(F.col("pick_no") <= per_lighting)
        .drop("_key")
    )


def zone_pools(sampled: DataFrame, units: DataFrame, minimum: int = 5) -> DataFrame:
    """NG rows used per unit; a zone with too few takes all NG rows.

    Counts are taken per prefix in the same pass, so no second scan is made.
    """
    counts = sampled.groupBy(F.col("prefix").alias("lighting")).agg(
        F.count(F.lit(1)).alias("all_ng"),
        F.count_if(F.col("zone") == "inner").alias("inner_ng"),
        F.count_if(F.col("zone") == "edge").alias("edge_ng"),
    )
    own = F.when(F.col("zone") == "inner", F.col("inner_ng")).otherwise(F.col("edge_ng"))
    return units.join(counts, "lighting", "left").select(
        "lighting",
        "zone",
        F.coalesce(F.when(own < minimum, F.col("all_ng")).otherwise(own), F.lit(0)).alias("ng_used"),
        F.coalesce(own < minimum, F.lit(True)).alias("fell_back"),
    )


def config_for(requests: DataFrame, configs: DataFrame, fallback: str) -> DataFrame:
    """Configuration of the request's model, else the fallback one."""
    return requests.join(configs, "model_id", "left").withColumn(
        "config", F.coalesce("config", F.lit(fallback))
    )


def zones_for(requests: DataFrame, zones: DataFrame) -> DataFrame:
    """Enabled zones of the model's resolution code, else of the first
    group.  Zones are grouped per code first, so the join adds no rows."""
    groups = zones.groupBy("code").agg(
        F.min("group_no").alias("group_no"),
        F.array_sort(
            F.collect_list(F.when(F.col("enabled") == 1, F.struct("zone_no", "x", "y", "w", "h")))
        ).alias("zones"),
    )
    first = groups.agg(F.min(F.struct("group_no", "zones")).alias("g")).select(F.col("g.zones"))
    return requests.withColumn("code", F.upper(F.substring("model_id", 6, 1))).join(
        groups.select("code", "zones"), "code", "left"
    ).withColumn("zones", F.coalesce("zones", first.scalar()))


def mark_region(images: DataFrame, fallback: tuple[int, int, int, int]) -> DataFrame:
    """First image of the panel that has a mark region, else fallback."""
    return (
        images.groupBy("record_id")
        .agg(F.min(F.when(F.col("region").isNotNull(), F.struct("order_no", "region"))).alias("m"))
        .select(
            "record_id",
            F.coalesce(F.col("m.region"), F.array(*[F.lit(int(v)) for v in fallback])).alias("region"),
        )
    )


def activate(bundles: DataFrame, bundle_id: int, scope: str = "all") -> DataFrame:
    """One active bundle overall, or one per machine."""
    chosen = F.col("id") == bundle_id
    if scope == "all":
        return bundles.withColumn("is_active", chosen.cast("int"))
    machine = bundles.where(chosen).select("machine_id").scalar()
    return bundles.withColumn(
        "is_active",
        F.when(F.col("machine_id") == machine, chosen.cast("int")).otherwise(F.col("is_active")),
    )


def relabel(manifest: DataFrame, edits: DataFrame, labels: list[str], key: str = "sample_id") -> DataFrame:
    """Apply (``key``, new_label) edits; ``new_label`` NULL deletes.

    Unknown labels are ignored, a changed label rewrites the crop path.  An
    edit holds for all rows of its key, which has one edit at most; where sample ids
    come more than once, edits name the line.
    """
    valid = edits.where(F.col("new_label").isNull() | F.col("new_label").isin(labels)).withColumn("_edit", F.lit(1))
    joined = manifest.join(valid, key, "left")
    changed = F.col("new_label").isNotNull() & (F.col("new_label") != F.col("label"))
    return (
        joined.where(~(F.col("_edit").isNotNull() & F.col("new_label").isNull()))
        .withColumn(
            "crop_path",
            F.when(
                changed & (F.col("crop_path") != ""),
                F.concat_ws("/", "new_label", "prefix", F.lit("crop"), F.element_at(F.split("crop_path", "/"), -1)),
            ).otherwise(F.col("crop_path")),
        )
        .withColumn("label", F.coalesce("new_label", "label"))
        .drop("new_label", "_edit")
    )


def decide(pool: DataFrame, request: DataFrame, decision: str) -> DataFrame:
    """Set the decision of the requested tiles, or of none of them when
    any is not an OK tile of its job.

    The check is a scalar aggregate in the plan: no collect on the driver.
    """
    if decision not in ("accept", "reject"):
        raise ValueError("decision must be accept or reject")
    allowed = pool.where("source = 'ok'").select("job_id", "id")
    bad = request.join(allowed, ["job_id", "id"], "left_anti").agg(F.count(F.lit(1)).alias("n"))
    hit = request.dropDuplicates(["job_id", "id"]).withColumn("_hit", F.lit(1))
    return (
        pool.join(hit, ["job_id", "id"], "left")
        .withColumn(
            "decision",
            F.when((F.col("_hit") == 1) & (bad.scalar() == 0), F.lit(decision)).otherwise(F.col("decision")),
        )
        .drop("_hit")
    )
