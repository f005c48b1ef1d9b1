"""Writes to the inspection store as whole-table rewrites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def import_accuracy(existing: DataFrame, batch: DataFrame, order: str = "arrival", keys: Sequence[str] = ("time_stamp", "pnl_id")) -> DataFrame:
    """Rows of the batch to insert: first per key by arrival, none that
    exists already."""
    keys = list(keys)
    rest = [c for c in batch.columns if c not in keys and c != order]
    first = batch.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("_m")).select(
        *keys, F.col(f"_m.{order}").alias(order), *[F.col(f"_m.{c}").alias(c) for c in rest]
    )
    return first.join(existing.select(*keys), keys, "left_anti")


def import_counts(batch: DataFrame, inserted: DataFrame) -> DataFrame:
    """Inserted and skipped."""
    seen = batch.agg(F.count(F.lit(1)).alias("n")).scalar()
    return inserted.agg(F.count(F.lit(1)).alias("inserted")).withColumn("skipped", seen - F.col("inserted"))


# Fixed value: note that marks a panel sent twice.
DUPLICATE_NOTE = "[DUPLICATE_PANEL] 重複投片，已依建立時間選取最新圖片推論"


def error_text(duplicate: Column, judgment: Column) -> Column:
    """The note about a panel sent twice and an error verdict, each on its own line."""
    return F.concat_ws("\n", F.when(duplicate, DUPLICATE_NOTE), F.when(judgment.startswith("ERR"), judgment))


def persist(nested: DataFrame) -> dict[str, DataFrame]:
    """Nested panels to the four tables.

    ``nested``: record columns with is_duplicate, and images
    ARRAY<STRUCT<..., tiles, edges>>.  Ids of children are texts of the record
    and their places in the panel, so they can't collide.
    """

    def child_id(parent: str) -> Column:
        return F.concat_ws("-", F.col(parent).cast("string"), F.col("no").cast("string")).alias("id")

    images = nested.select(F.col("id").alias("record_id"), F.posexplode("images").alias("no", "img"))
    image_rows = images.select(
        child_id("record_id"), "record_id", F.col("img.image_name").alias("image_name"),
        F.coalesce("img.is_ng", F.lit(0)).alias("is_ng"), F.col("img.tiles").alias("tiles"), F.col("img.edges").alias("edges"),
    )
    tiles = image_rows.select(F.col("id").alias("image_result_id"), F.posexplode("tiles").alias("no", "t")).select(
        child_id("image_result_id"), "image_result_id", F.col("t.*")
    )
    edges = image_rows.select(F.col("id").alias("image_result_id"), F.posexplode("edges").alias("no", "e")).select(
        child_id("image_result_id"), "image_result_id", F.col("e.*")
    )
    heads = nested.select(
        *[c for c in nested.columns if c not in ("images", "error_message", "is_duplicate")],
        error_text(F.col("is_duplicate"), F.col("ai_judgment")).alias("error_message"),
        F.size("images").alias("total_images"),
        F.aggregate("images", F.lit(0), lambda acc, i: acc + F.coalesce(i["is_ng"], F.lit(0))).alias("ng_images"),
    )
    return {"records": heads, "images": image_rows.drop("tiles", "edges"), "tiles": tiles, "edges": edges}


def rerun(tables: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The children of re-judged records are replaced and their heads
    updated; every other row stays.

    ``new``: records (id and changed columns), images, tiles, edges.
    """
    ids = new["records"].select("id")
    old_images = tables["images"].join(ids.withColumnRenamed("id", "record_id"), "record_id", "left_semi").select(
        F.col("id").alias("image_result_id")
    )
    out = {
        "images": tables["images"].join(ids.withColumnRenamed("id", "record_id"), "record_id", "left_anti").unionByName(new["images"], True)
    }
    for child in ("tiles", "edges"):
        out[child] = tables[child].join(old_images, "image_result_id", "left_anti").unionByName(new[child], True)
    changed = [c for c in new["records"].columns if c != "id"]
    fresh = new["records"].select("id", *[F.col(c).alias(f"_new_{c}") for c in changed], F.lit(True).alias("_hit"))
    heads = tables["records"].join(fresh, "id", "left")
    for c in changed:
        heads = heads.withColumn(c, F.when(F.col("_hit"), F.coalesce(f"_new_{c}", c)).otherwise(F.col(c)))
    out["records"] = heads.drop("_hit", *[f"_new_{c}" for c in changed])
    return out
