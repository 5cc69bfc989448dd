"""Tile counts of pixel files as they arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skysift.constants import SceneGrid
from skysift.operators.detect import Detector
from skysift.operators.tiles import fine_tile_counts


def screen_arrivals(
    spark: SparkSession, path: str, schema, grid: SceneGrid, detector: Detector, flags: Sequence[str] = ("cloud",),
) -> DataFrame:
    """Running tile counts over a folder of pixel files on the 10 m grid.

    A scene may arrive in several files; the state is one row per tile.
    """
    px = spark.readStream.schema(schema).parquet(path)
    return fine_tile_counts(detector(px), grid, list(flags))


def to_files(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the tiles that changed in each batch below ``path``; a batch that is run again replaces its own files."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_counts(spark: SparkSession, path: str) -> DataFrame:
    """The counts of each tile from the last batch that changed it."""
    rows = spark.read.parquet(path)
    kept = [c for c in rows.columns if c not in ("scene_id", "tile_row", "tile_col", "batch")]
    newest = rows.groupBy("scene_id", "tile_row", "tile_col").agg(F.max_by(F.struct(*kept), "batch").alias("_last"))
    return newest.select("scene_id", "tile_row", "tile_col", "_last.*")


def to_table(counts: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Keep the current counts in a memory table: for tests only, all counts go to the driver."""
    return (
        counts.writeStream.outputMode("complete").format("memory").queryName(name)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
