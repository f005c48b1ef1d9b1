"""Filters, pages and detail reads over the store (Q ids)."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelscope.functions.text import check_date
from panelscope.operators import ranks

NEWEST = ("created_at", "id")


def _ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _newest_first() -> list[Column]:
    return [F.col(c).desc() for c in NEWEST]


def day_range(column: str, start: str | None, end: str | None) -> Column:
    """Whole-day bounds on the raw column, so that files can be pruned."""
    cond = F.lit(True)
    if start:
        cond = cond & (F.col(column) >= _ntz(check_date(start)))
    if end:
        cond = cond & (F.col(column) < _ntz(check_date(end)) + F.expr("INTERVAL 1 DAY"))
    return cond


def by_glass(records: DataFrame, glass_id: str) -> DataFrame:
    return records.where(F.col("glass_id") == glass_id).orderBy(*_newest_first())


def _at_most(df: DataFrame, limit: int | None) -> DataFrame:
    """``df`` or its first rows; without a limit all of them."""
    if limit is not None and limit < 1:
        raise ValueError("a limit must be positive")
    return df if limit is None else df.limit(limit)


def by_range(records: DataFrame, start: str, end: str, limit: int | None = None) -> DataFrame:
    """Q02: both bounds inclusive as timestamps."""
    hits = records.where((F.col("created_at") >= _ntz(start)) & (F.col("created_at") <= _ntz(end)))
    return _at_most(hits.orderBy(*_newest_first()), limit)


def recent(records: DataFrame, n: int = 50) -> DataFrame:
    return records.orderBy(*_newest_first()).limit(n)


def _page(df: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """One page with the total of the whole selection as a scalar subquery."""
    if limit < 1 or offset < 0:
        raise ValueError("a page needs a positive limit and an offset of 0 or more")
    total = df.agg(F.count(F.lit(1)).alias("n"))
    return df.orderBy(*order).offset(offset).limit(limit).withColumn("total_count", total.scalar())


def paged(records: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    page = _page(records, _newest_first(), limit, offset)
    return page.withColumn("pages", F.ceil(F.col("total_count") / limit))


def overexposed(records: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    return paged(records.where("omit_overexposed = 1"), limit, offset)


def aoi_ng() -> Column:
    return (F.col("machine_judgment") != "") & (F.col("machine_judgment") != "OK")


def ai_ng() -> Column:
    return F.col("ai_judgment").ilike("NG%")


def ai_err() -> Column:
    return F.col("ai_judgment").ilike("ERR%")


def search(
    records: DataFrame, record_id: str = "", glass_id: str = "", machine_no: str = "", ai_judgment: str = "",
    start_date: str = "", end_date: str = "", cross_filter: str = "", as_of: str | None = None,
) -> DataFrame:
    """Q06: all conditions met; without any, the last seven days of ``as_of``."""
    if not any([record_id, glass_id, machine_no, ai_judgment, start_date, end_date, cross_filter]):
        if as_of is None:
            raise ValueError("give a filter or as_of")
        end_date = as_of[:10]
        start_date = (datetime.strptime(end_date, "%Y-%m-%d") - timedelta(days=6)).strftime("%Y-%m-%d")
    cond = F.lit(True)
    for column, part in (("glass_id", glass_id), ("machine_no", machine_no)):
        if part:
            cond = cond & F.col(column).ilike(f"%{part}%")
    if record_id:
        cond = cond & F.col("id").cast("string").ilike(f"%{record_id}%")
    if cross_filter == "ng_ok":
        cond = cond & aoi_ng() & ~ai_ng() & ~ai_err()
    elif cross_filter == "ok_ng":
        cond = cond & ~aoi_ng() & ai_ng() & ~ai_err()
    elif ai_judgment:
        cond = cond & F.col("ai_judgment").ilike(f"%{ai_judgment}%")
    if cross_filter:
        cond = cond & day_range("request_time", start_date, end_date)
    else:
        if start_date:
            cond = cond & (F.col("created_at") >= _ntz(start_date))
        if end_date:
            cond = cond & (F.col("created_at") <= _ntz(f"{end_date} 23:59:59"))
    return records.where(cond)


def search_page(records: DataFrame, limit: int = 50, offset: int = 0, **filters) -> DataFrame:
    return _page(search(records, **filters), _newest_first(), limit, offset)


def record_detail(
    records: DataFrame, images: DataFrame, tiles: DataFrame, edges: DataFrame, record_id: int | None = None
) -> DataFrame:
    """Q07: record with its image tree; without an id, every record's tree.

    Lists are per image and per panel, both bounded by the tile grid.
    """
    if record_id is not None:
        records = records.where(F.col("id") == record_id)
        images = images.where(F.col("record_id") == record_id)
        tiles = tiles.where(F.col("record_id") == record_id)
        edges = edges.where(F.col("record_id") == record_id)
    rank = (
        F.when((F.col("is_dust") == 0) & (F.col("is_bomb") == 0), 0)
        .when(F.col("is_bomb") == 1, 1)
        .when(F.col("is_dust") == 1, 2)
        .otherwise(3)
    )
    tile_lists = tiles.groupBy("image_result_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(rank.alias("rank"), (-F.col("score")).alias("neg"), "tile_id", "id", "score", "is_dust", "is_bomb")
            )
        ).alias("tiles")
    )
    edge_lists = edges.groupBy("image_result_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct("is_dust", (-F.col("max_diff")).alias("neg_diff"), (-F.col("patchcore_score")).alias("neg_pc"), "id", "side")
            )
        ).alias("edges")
    )
    per_image = (
        images.join(tile_lists, images["id"] == tile_lists["image_result_id"], "left")
        .drop("image_result_id")
        .join(edge_lists, images["id"] == edge_lists["image_result_id"], "left")
        .drop("image_result_id")
    )
    trees = per_image.groupBy("record_id").agg(
        F.array_sort(F.collect_list(F.struct("id", "image_name", "is_ng", "tiles", "edges"))).alias("images")
    )
    return records.join(trees, records["id"] == trees["record_id"], "left").drop("record_id")


def log_search(lines: DataFrame, n: int | None = 500, level: str = "", text: str = "") -> DataFrame:
    """Q08: the last n lines (by ``line_no``, None: all), then level and text filters."""
    tail = lines if n is None else _at_most(lines.orderBy(F.col("line_no").desc()), n)
    cond = F.lit(True)
    if level:
        cond = cond & F.col("line").contains(level.upper())
    if text:
        cond = cond & F.lower("line").contains(text.lower())
    return tail.where(cond)


def _rescued(tiles: DataFrame, images: DataFrame, records: DataFrame, start: str | None, end: str | None) -> DataFrame:
    heads = records.where(day_range("created_at", start, end)).select(
        F.col("id").alias("record_id"), "glass_id", "machine_no", "created_at", "ai_judgment"
    )
    named = images.select(
        F.col("id").alias("image_result_id"), "image_name", F.col("heatmap_path").alias("image_heatmap"),
        *([F.col("image_path")] if "image_path" in images.columns else []),
    )
    return (
        tiles.where("scratch_filtered = 1")
        .drop("image_name")
        .join(named, "image_result_id")
        .join(heads, "record_id")
    )


def rescued_tiles(
    tiles: DataFrame, images: DataFrame, records: DataFrame, review: DataFrame,
    state: str = "pending", order: str = "latest", limit: int | None = None, offset: int = 0,
    start: str | None = None, end: str | None = None,
) -> DataFrame:
    """Q09."""
    joined = _rescued(tiles, images, records, start, end).join(
        review.select(F.col("tile_result_id").alias("id"), "is_misrescue", F.col("id").alias("review_id"), "note"),
        "id",
        "left",
    )
    if state == "pending":
        joined = joined.where("review_id IS NULL")
    elif state == "marked":
        joined = joined.where("is_misrescue = 1")
    keys = (
        [F.col("scratch_score").asc(), F.col("created_at").desc(), F.col("id").desc()]
        if order == "score_asc"
        else [F.col("created_at").desc(), F.col("id").desc()]
    )
    blank = F.lit("")
    if offset < 0:
        raise ValueError("an offset must be 0 or more")
    ordered = joined.orderBy(*keys)
    return (
        _at_most(ordered.offset(offset) if offset else ordered, limit)
        .select(
            "id", "tile_id", "record_id", "glass_id", "image_name", "created_at", "x", "y", "score", "scratch_score",
            F.coalesce(F.nullif("heatmap_path", blank), F.nullif("image_heatmap", blank), blank).alias("heatmap"),
            F.coalesce("is_misrescue", F.lit(0)).alias("is_misrescue"),
            F.col("review_id").isNotNull().alias("reviewed"),
        )
    )


def misrescued_tiles(tiles, images, records, review, start: str | None = None, end: str | None = None) -> DataFrame:
    """Q10: marked tiles with the geometry needed to cut them again."""
    marked = review.where("is_misrescue = 1").select(F.col("tile_result_id").alias("id"), F.col("note").alias("review_note"))
    return (
        _rescued(tiles, images, records, start, end)
        .join(marked, "id")
        .select(
            "id", "tile_id", "record_id", "image_result_id", "glass_id", "image_name", "image_path", "x", "y", "width",
            "height", "score", "scratch_score", "created_at", "ai_judgment", "review_note",
        )
    )


def rescue_counts(tiles, images, records, review, start: str | None = None, end: str | None = None) -> DataFrame:
    """Q11."""
    joined = _rescued(tiles, images, records, start, end).join(
        review.select(F.col("tile_result_id").alias("id"), "is_misrescue"), "id", "left"
    )
    counts = joined.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce(F.col("is_misrescue") == 1, F.lit(False))).alias("marked")
    )
    return counts.withColumn("pending", F.greatest(F.lit(0).cast("long"), F.col("total") - F.col("marked")))


def tile_pool(pool: DataFrame, job: str, lighting=None, zone=None, source=None, decision=None) -> DataFrame:
    """Q12: the zone does not narrow NG tiles, which are kept per lighting."""
    cond = F.col("job_id") == job
    if source == "ng":
        zone = None
    for name, value in (("lighting", lighting), ("zone", zone), ("source", source), ("decision", decision)):
        if value is not None:
            cond = cond & (F.col(name) == value)
    return pool.where(cond).orderBy("id")


def ok_panels(records: DataFrame, as_of: str, model: str = "", days: int = 3, limit: int | None = None) -> DataFrame:
    """Q13: OK panels of the last 1 to 3 days."""
    if not 1 <= days <= 3:
        raise ValueError("days must lie in 1..3")
    rows = records.where("machine_judgment = 'OK'").where(
        F.col("created_at") >= _ntz(as_of) - F.expr(f"INTERVAL {days} DAYS")
    )
    if model:
        rows = rows.where(F.col("model_id") == model)
    return _at_most(rows.orderBy(*_newest_first()), limit)


def bundles(table: DataFrame, machine: str | None = None, files: DataFrame | None = None) -> DataFrame:
    """Q14: active first, then newest; with ``files`` only those with a model."""
    if machine:
        table = table.where(F.col("machine_id") == machine)
    if files is not None:
        table = table.join(files.select("bundle_path").distinct(), "bundle_path", "left_semi")
    return table.orderBy(F.col("is_active").desc(), F.col("trained_at").desc(), F.col("id").desc())


def bundles_by_machine(table: DataFrame) -> DataFrame:
    """Q14, grouped: one row per machine with its newest bundle and count; the
    members stay rows so that no machine becomes one huge list."""
    return table.groupBy("machine_id").agg(
        F.count(F.lit(1)).alias("n_bundles"),
        F.max("trained_at").alias("newest"),
        F.max_by("id", F.struct("trained_at", "id")).alias("newest_id"),
        F.sum("is_active").alias("n_active"),
    )


ACTIVE_STATES = ("preprocess", "review", "train")


def active_jobs(jobs: DataFrame) -> DataFrame:
    """Q15: unfinished jobs; missing panel modes mean "full" for each panel."""
    paths = F.from_json("panel_paths", "array<string>")
    modes = F.from_json("panel_modes", "array<string>")
    return (
        jobs.where(F.col("state").isin(*ACTIVE_STATES))
        .withColumn("panels", F.coalesce(paths, F.array().cast("array<string>")))
        .withColumn("modes", F.coalesce(modes, F.expr("array_repeat('full', size(panels))")))
        .orderBy(F.col("started_at").desc(), F.col("job_id").desc())
    )


def config_history(history: DataFrame, name: str | None = None, limit: int | None = None) -> DataFrame:
    """Q16."""
    if name:
        history = history.where(F.col("name") == name)
    return _at_most(history.orderBy(F.col("changed_at").desc(), F.col("id").desc()), limit)


def decoded_settings(params: DataFrame, name: str | None = None) -> DataFrame:
    """Q16: all parameters, or one, with the value as its tag reads it.

    ``params``: name, value (JSON), tag (int, float, bool, dict or str); the
    decoded value stands in the column of its type.  A value that can't be read
    is null there and stands in text_value as it is.
    """
    if name:
        params = params.where(F.col("name") == name)
    tag, value = F.col("tag"), F.col("value")
    number = value.try_cast("double")
    decoded = params.select(
        "name", "value", "tag", F.when(tag == "int", number.cast("bigint")).alias("int_value"), F.when(tag == "float", number).alias("float_value"),
        F.when(tag == "bool", value.try_cast("boolean")).alias("bool_value"),
        F.when(tag == "dict", F.get_json_object(value, "$")).alias("dict_value"),
    )
    none = F.coalesce(F.col("int_value").cast("string"), F.col("float_value").cast("string"), F.col("bool_value").cast("string"), "dict_value").isNull()
    text = F.coalesce(F.get_json_object(F.concat(F.lit("["), "value", F.lit("]")), "$[0]"), "value")
    return decoded.withColumn("text_value", F.when(none, text)).orderBy("name")


def ric_batches(batches: DataFrame) -> DataFrame:
    return batches.orderBy(F.col("imported_at").desc(), F.col("id").desc())


def gallery(manifest: DataFrame, label: str = "", prefix: str = "", page: int = 1, limit: int = 50) -> DataFrame:
    """Q18: one page of good samples; a page past the end becomes the last."""
    if limit < 1 or page < 1:
        raise ValueError("page and limit must be positive")
    good = manifest.where("status = 'ok'")
    chosen = good
    if label:
        chosen = chosen.where(F.col("label") == label)
    if prefix:
        chosen = chosen.where(F.col("prefix") == prefix)
    order = [F.col("collected_at").desc(), F.col("sample_id").asc(), F.col("line_no").asc()]
    n = chosen.count()
    first = (min(page, max(1, -(-n // limit))) - 1) * limit
    return chosen.orderBy(*order).offset(first).limit(limit)


def gallery_counts(manifest: DataFrame) -> DataFrame:
    """Q18: counts per label and prefix before any filter."""
    return manifest.where("status = 'ok'").groupBy("label", "prefix").agg(F.count(F.lit(1)).alias("n"))


def latest_panel(records: DataFrame, images: DataFrame, tiles: DataFrame, n_tiles: int = 8) -> DataFrame:
    """Q19: newest image with a heat map and its top tiles with a status."""
    heads = records.select(F.col("id").alias("record_id"), "created_at", "glass_id", "ai_judgment")
    newest = (
        images.where("heatmap_path <> ''")
        .select("record_id", F.col("id").alias("image_result_id"), "is_ng", "image_name")
        .join(heads, "record_id")
        .orderBy(F.col("created_at").desc(), F.col("image_result_id").desc())
        .limit(1)
    )
    status = (
        F.when(F.col("is_exclude_zone") == 1, "EXCLUDED")
        .when(F.col("is_bomb") == 1, "BOMB")
        .when(F.col("is_dust") == 1, "DUST")
        .when(F.col("is_anomaly") == 1, "NG")
        .otherwise("OK")
    )
    return (
        tiles.where("heatmap_path <> ''")
        .select("image_result_id", "tile_id", "score", "is_anomaly", "is_dust", "is_bomb", "is_exclude_zone")
        .join(newest, "image_result_id")
        .orderBy(F.col("is_anomaly").desc(), F.col("score").desc(), F.col("tile_id").asc())
        .limit(n_tiles)
        .select("record_id", "image_result_id", "image_name", "glass_id", "tile_id", "score", status.alias("status"))
    )


def training_summary(pool: DataFrame, bundles: DataFrame) -> DataFrame:
    """Q20: OK and NG tile counts of each bundle's job."""
    counts = pool.groupBy("job_id").agg(
        F.count_if(F.col("source") == "ok").alias("ok_count"), F.count_if(F.col("source") == "ng").alias("ng_count")
    )
    return bundles.join(counts, "job_id", "left").select(
        "id", "job_id", F.coalesce("ok_count", F.lit(0)).alias("ok_count"), F.coalesce("ng_count", F.lit(0)).alias("ng_count")
    )
