"""Per-tile statistics, scene summaries and runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift.constants import SceneGrid
from skysift.functions import tilemath as M
from skysift.operators.grid import assign_tile, block_keys, tile_bbox
from skysift.operators.resample import overlap_tile_counts

TILE = ("scene_id", "tile_row", "tile_col")


def fine_tile_counts(px: DataFrame, grid: SceneGrid, flags: Sequence[str]) -> DataFrame:
    """Flagged 10 m pixels per tile. In place when the table is placed by block."""
    extra = block_keys(px)
    return (
        assign_tile(px, grid)
        .groupBy("scene_id", *extra, "tile_row", "tile_col")
        .agg(F.count(F.lit(1)).alias("pixels"), *[F.sum(F.col(f).cast("int")).alias(f) for f in flags])
        .drop(*extra)
    )


def tile_stats(
    counts: DataFrame, grid: SceneGrid, cloud: str = "cloud", nodata: str = "nodata", keys: Sequence[str] = TILE,
) -> DataFrame:
    """Counts -> percent, no-data fraction and verdict; a partial tile is an error."""
    px = grid.tile_pixels
    n = F.when(F.col("pixels") == px, F.col(cloud)).otherwise(
        F.raise_error(F.lit("tile is not complete")).cast("bigint"))
    fraction = F.col(nodata).cast("double") / F.lit(px)
    return counts.withColumn("cloud_pixels", n).withColumns({
        "cloud_cover_percent": M.cloud_percent(F.col("cloud_pixels"), px),
        "nodata_fraction": fraction,
        "valid": M.valid_rule(F.col("cloud_pixels"), fraction, px),
    }).select(*keys, "cloud_pixels", "cloud_cover_percent", "nodata_fraction", "valid")


def locate_tiles(stats: DataFrame, scenes: DataFrame, grid: SceneGrid) -> DataFrame:
    """Attach the WGS84 box; ``scenes`` has scene_id, epsg, origin_e, origin_n."""
    joined = stats.join(scenes.select("scene_id", "epsg", "origin_e", "origin_n"), "scene_id")
    return tile_bbox(joined, grid).select(
        *stats.columns, "min_latitude", "min_longitude", "max_latitude", "max_longitude")


def run_tiles(masks: DataFrame, grid: SceneGrid, scale: int, detectors: dict[str, str], nodata: str = "nodata") -> DataFrame:
    """Tile rows of several detectors from one pass over a coarse mask table.

    ``detectors`` maps the detector name to its boolean column.
    """
    counts = overlap_tile_counts(masks, grid, scale, [*detectors.values(), nodata])
    pairs = F.array(*[F.struct(F.lit(n).alias("detector"), F.col(c).alias("cloud")) for n, c in detectors.items()])
    long = counts.select(*TILE, "pixels", nodata, F.inline(pairs))
    return tile_stats(long, grid, nodata=nodata, keys=(*TILE, "detector"))


def scene_cloud_percent(stats: DataFrame, grid: SceneGrid, keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Mean of the tile percentages; tiles have equal area, so integers are summed."""
    n = F.count(F.lit(1))
    total = F.lit(100.0) * F.sum("cloud_pixels") / (n * grid.tile_pixels)
    return stats.groupBy(*keys).agg(F.when(n > 0, total).otherwise(0.0).alias("scene_cloud_percent"))


def scene_summary(stats: DataFrame, grid: SceneGrid, keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    n = F.count(F.lit(1))
    return stats.groupBy(*keys).agg(
        F.count_if("valid").alias("valid_tiles"),
        F.count_if(~F.col("valid")).alias("invalid_tiles"),
        F.sum("cloud_pixels").alias("cloud_pixels_total"),
        F.max("nodata_fraction").alias("max_nodata_fraction"),
        (F.lit(100.0) * F.sum("cloud_pixels") / (n * grid.tile_pixels)).alias("scene_cloud_percent"),
    )


def cover_distribution(stats: DataFrame, keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """How the tiles lie around the cut."""
    pct = F.col("cloud_cover_percent")
    return stats.groupBy(*keys).agg(
        F.count_if(pct.between(25.0, 35.0)).alias("in_25_35"),
        F.count_if(pct.between(20.0, 40.0)).alias("in_20_40"),
        F.count_if(F.col("cloud_pixels") == 0).alias("clear"),
        F.min(pct).alias("lowest"), F.max(pct).alias("highest"),
        F.max(F.when(F.col("valid"), pct)).alias("closest_valid"),
        F.min(F.when(~F.col("valid"), pct)).alias("closest_invalid"),
    )
