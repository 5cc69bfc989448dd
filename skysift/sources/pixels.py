"""Stored pixel tables: one row per pixel, one column per band.

Two layouts. Folders by scene, sorted by position, suit window reads: a scene
filter prunes folders, y/x ranges skip row groups, and only the wanted bands are
read. Tables bucketed by block suit whole-catalogue jobs: tables of all
resolutions join and aggregate without an exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.constants import SceneGrid
from skysift.operators.grid import BLOCK, with_block

Window = tuple[int, int, int, int]


def write_scene_folders(px: DataFrame, grid: SceneGrid, resolution: int, path: str, dealt: bool = False) -> None:
    """``scene_id=...`` folders; a file holds one band of block rows, sorted by position.

    ``dealt`` rows have come through ``deal_rows``, before they were enlarged: they are
    written as they stand, without another exchange or sort.
    """
    if not dealt:
        px = with_block(px.drop("brow", "bcol"), grid, resolution).repartition("scene_id", "brow").sortWithinPartitions("scene_id", "y", "x")
    px.drop("brow", "bcol").write.partitionBy("scene_id").parquet(path)


def deal_rows(px: DataFrame) -> DataFrame:
    """Coarse rows dealt by scene and block row, in order; what is enlarged from them stays so by coarse cell."""
    return px.repartition("scene_id", "brow").sortWithinPartitions("scene_id", "y", "x")


def store_by_block(px: DataFrame, grid: SceneGrid, resolution: int, table: str, buckets: int, path: str) -> None:
    """Catalogue table bucketed by block; use the same bucket count at every resolution."""
    placed = with_block(px.drop("brow", "bcol"), grid, resolution).repartition(buckets, *BLOCK)
    placed.write.bucketBy(buckets, *BLOCK).sortBy(*BLOCK).option("path", path).saveAsTable(table)


def scan_window(
    spark: SparkSession, path: str, schema: str, columns: Sequence[str], scenes: Sequence[int] | None = None, window: Window | None = None,
) -> DataFrame:
    """Some bands of some scenes in a half-open (y0, y1, x0, x1) window of the table's own grid."""
    px = spark.read.schema(schema).parquet(path)
    if scenes is not None:
        px = px.filter(F.col("scene_id").isin(list(scenes)))
    if window is not None:
        y0, y1, x0, x1 = window
        px = px.filter((F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1))
    return px.select("scene_id", "y", "x", *columns)


def scan_class_mask(spark: SparkSession, path: str) -> DataFrame:
    """Three byte channels -> opaque, cirrus and snow booleans."""
    names = ("opaque", "cirrus", "snow")
    px = spark.read.schema("scene_id bigint, y int, x int, " + ", ".join(f"{n} int" for n in names)).parquet(path)
    return px.select("scene_id", "y", "x", *[(F.col(n) > 0).alias(n) for n in names])
