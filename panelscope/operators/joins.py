"""Equi joins against earlier results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_only(candidates: DataFrame, known_ids: DataFrame) -> DataFrame:
    """Candidates not named in any earlier manifest, whatever its status."""
    return candidates.join(known_ids.select("sample_id").distinct(), "sample_id", "left_anti")


def with_scores(tiles: DataFrame, cache: DataFrame, bundle: int) -> DataFrame:
    """The cache holds one row per (tile, bundle)."""
    scores = cache.where(F.col("bundle_id") == bundle).select(F.col("tile_id").alias("id"), "score")
    return tiles.join(scores, "id", "left")


def drop_scores(
    cache: DataFrame, pool: DataFrame | None = None, bundle: int | None = None, tile_ids: DataFrame | None = None,
    lighting: str | None = None, zone: str | None = None,
) -> DataFrame:
    """Cache rows that stay.  Exactly one way of naming rows is allowed:
    a bundle, tiles, or a bundle with lighting and zone."""
    unit = lighting is not None or zone is not None
    if tile_ids is not None and (bundle is not None or unit):
        raise ValueError("give tiles or a bundle, not both")
    if unit and (bundle is None or lighting is None or zone is None or pool is None):
        raise ValueError("a unit needs bundle, lighting, zone and the pool")
    if tile_ids is not None:
        return cache.join(tile_ids.select(F.col("id").alias("tile_id")).distinct(), "tile_id", "left_anti")
    if bundle is None:
        raise ValueError("name the rows to drop")
    if not unit:
        return cache.where(F.col("bundle_id") != bundle)
    dropped = pool.where((F.col("lighting") == lighting) & (F.col("zone") == zone)).select(
        F.col("id").alias("tile_id"), F.lit(bundle).alias("bundle_id")
    )
    return cache.join(dropped.distinct(), ["tile_id", "bundle_id"], "left_anti")
