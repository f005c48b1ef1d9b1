"""Rewrites of stored tables: retention, reviews, parameters (R ids)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def retain(
    records: DataFrame, images: DataFrame, tiles: DataFrame, edges: DataFrame, as_of: str,
    ok_days: int = 30, ng_days: int = 90, tile_days: int = 60, heat_days: int = 14,
) -> dict[str, DataFrame]:
    """Old records go with their children, old tiles go alone, old heat
    map paths are blanked.  Cuts lie at midnight."""

    def cut(days):
        return F.to_date(F.lit(as_of).cast("timestamp_ntz")) - F.expr(f"INTERVAL {int(days)} DAYS")

    at = F.col("created_at")
    good = F.col("ai_judgment") == "OK"
    kept = records.where(F.when(good, at >= cut(ok_days)).otherwise(at >= cut(ng_days)))
    fresh_heat = at >= cut(heat_days)
    ids = kept.select(F.col("id").alias("record_id"), (at >= cut(tile_days)).alias("_tiles"), fresh_heat.alias("_heat"))
    kept_images = images.join(ids.select("record_id", "_heat"), "record_id").withColumn(
        "heatmap_path", F.when(F.col("_heat"), F.col("heatmap_path")).otherwise("")
    ).drop("_heat")
    return {
        "records": kept,
        "images": kept_images,
        "tiles": tiles.join(ids.where("_tiles").select("record_id"), "record_id", "left_semi"),
        "edges": edges.join(ids.select("record_id"), "record_id", "left_semi"),
    }


def delete_batch(ric: DataFrame, batch_id: int) -> DataFrame:
    """R02."""
    return ric.where(F.col("batch_id") != batch_id)


def count_accuracy(accuracy: DataFrame) -> DataFrame:
    """R03; clearing is an overwrite with ``accuracy.limit(0)``."""
    return accuracy.agg(F.count(F.lit(1)).alias("n"))


def merge_latest(target: DataFrame, changes: DataFrame, keys: list[str], order: str = "change_no") -> DataFrame:
    """Upsert: the last change of a key wins over the stored row; a change
    with ``deleted`` = 1 removes it."""
    cols = [c for c in target.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max(F.struct(order, "deleted", *cols)).alias("m"))
    new = last.where("m.deleted = 0").select(*keys, *[F.col(f"m.{c}").alias(c) for c in cols])
    return target.join(last.select(*keys), keys, "left_anti").unionByName(new)


def save_reviews(table: DataFrame, changes: DataFrame, accuracy: DataFrame, categories: list[str]) -> DataFrame:
    """Upserts with a known category for an existing accuracy row."""
    valid = changes.where((F.col("deleted") == 1) | F.col("category").isin(categories)).join(
        accuracy.select(F.col("id").alias("client_record_id")), "client_record_id", "left_semi"
    )
    return merge_latest(table, valid, ["client_record_id"])


def mark(review: DataFrame, tiles: DataFrame, ids: DataFrame) -> DataFrame:
    """Rescued tiles among ``ids`` are marked; others are ignored."""
    known = tiles.where("scratch_filtered = 1").select(F.col("id").alias("tile_result_id"))
    # tiles have ids of their own, so the few rescued ones need no distinct
    new = known.join(ids.select("tile_result_id"), "tile_result_id", "left_semi").join(review.select("tile_result_id"), "tile_result_id", "left_anti")
    return review.unionByName(new.select(F.col("tile_result_id").alias("id"), "tile_result_id", F.lit(1).alias("is_misrescue"), F.lit("").alias("note")))


def unmark(review: DataFrame, ids: DataFrame) -> DataFrame:
    return review.join(ids.select("tile_result_id"), "tile_result_id", "left_anti")


def value_tag(value: Column) -> Column:
    """Type of a JSON value: bool, int, float, else str."""
    return (
        F.when(value.isin("true", "false"), "bool").when(value.rlike(r"^-?[0-9]+$"), "int")
        .when(value.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), "float").otherwise("str")
    )


def set_params(params: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New parameter table and one history row per change, equal values too.

    ``params``: name, value (JSON), tag.  ``changes``: change_no, name, value,
    reason, in the order of change_no.  The tag of a new name follows the first
    value; a stored tag stays.
    """
    order = W.partitionBy("name").orderBy("change_no")
    stored = params.select("name", F.col("value").alias("stored"))
    history = changes.join(stored, "name", "left").select(
        "change_no", "name", F.coalesce(F.lag("value").over(order), "stored", F.lit("")).alias("old_value"), F.col("value").alias("new_value"), "reason"
    )
    ends = changes.groupBy("name").agg(F.min(F.struct("change_no", "value")).alias("f"), F.max(F.struct("change_no", "value")).alias("l"))
    joined = params.join(ends, "name", "full_outer")
    table = joined.select("name", F.coalesce("l.value", "value").alias("value"), F.coalesce("tag", value_tag(F.col("f.value"))).alias("tag"))
    return table, history


def seed_params(params: DataFrame, defaults: DataFrame) -> DataFrame:
    """Only names not yet stored are added."""
    return params.unionByName(defaults.join(params.select("name"), "name", "left_anti"))


def set_threshold(thresholds: DataFrame, lighting: str, zone: str, value: float) -> DataFrame:
    """R09."""
    if not 0 <= value <= 10:
        raise ValueError("threshold must lie in 0..10")
    unit = (F.col("lighting") == lighting) & (F.col("zone") == zone)
    return thresholds.withColumn("threshold", F.when(unit, F.lit(round(value, 4))).otherwise(F.col("threshold")))


def set_state(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """Job state; ``completed_at`` is set once on completed or failed."""
    done = F.col("new_state").isin("completed", "failed")
    joined = jobs.join(changes.select("job_id", "new_state", "changed_at"), "job_id", "left")
    return joined.select(
        "job_id", F.coalesce("new_state", "state").alias("state"),
        F.when(done, F.coalesce("completed_at", "changed_at")).otherwise(F.col("completed_at")).alias("completed_at"),
    )


def insert_pool(pool: DataFrame, job_id: str, tiles: DataFrame) -> DataFrame:
    """Tiles of a job join the pool, undecided; ids of the pool stay as they are."""
    new = tiles.join(pool.select("id"), "id", "left_anti").withColumns({"job_id": F.lit(job_id), "decision": F.lit("accept")})
    return pool.unionByName(new.select(*pool.columns))


def decide_tiles(pool: DataFrame, job_id: str, ids: DataFrame, decision: str) -> DataFrame:
    """The decision of a job's tiles among ``ids``."""
    if decision not in ("accept", "reject"):
        raise ValueError(f"unknown decision {decision}")
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    changed = F.col("_hit") & (F.col("job_id") == job_id)
    return pool.join(hit, "id", "left").withColumn("decision", F.when(changed, decision).otherwise(F.col("decision"))).select(*pool.columns)


def cleanup_pool(pool: DataFrame, job_id: str) -> DataFrame:
    """A job's tiles leave the pool."""
    return pool.where(F.col("job_id") != job_id)


def register_bundles(table: DataFrame, new: DataFrame) -> DataFrame:
    """Bundles start inactive; those of a path that is known already are left out."""
    fresh = new.join(table.select("bundle_path"), "bundle_path", "left_anti").withColumn("is_active", F.lit(0))
    return table.unionByName(fresh.select(*table.columns))


def delete_bundles(table: DataFrame, ids: DataFrame) -> DataFrame:
    """R07."""
    return table.join(ids.select("id"), "id", "left_anti")
