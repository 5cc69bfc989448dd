"""The screening job: many scenes from masks to delivered and checked outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift.constants import SceneGrid
from skysift.operators import checks as H
from skysift.operators import grid as G
from skysift.operators import tiles as T
from skysift.session import cut_lineage
from skysift.sources import sinks as O
from skysift.sources import tables as L


def screen(
    scenes: DataFrame, masks: DataFrame, px10: DataFrame, grid: SceneGrid, factor: int, detector: str, out: str,
    flag: str = "cloud", parameters: dict[str, float | None] | None = None,
) -> DataFrame:
    """Report, chips, masks and summary of every sound scene below ``out``; gives the check rows of what was written.

    ``scenes`` has scene_id, nrows, ncols, the geocoding, footprint_bbox and f_*
    box columns; ``masks`` the detector's flag and nodata on a grid of ``factor``
    times 10 m; ``px10`` the display RGB. Scenes whose size is not the grid's are
    kept out of everything and listed in ``out``/quarantine. The tiles are counted
    once and written; every output follows from that table, and every check reads
    the files, against the list of sound scenes.
    """
    spark = scenes.sparkSession
    guarded = cut_lineage(G.grid_guard(scenes, grid), "guarded")
    guarded.filter("not grid_ok").drop("grid_ok").write.parquet(f"{out}/quarantine")
    sound = guarded.filter("grid_ok").drop("grid_ok", "nrows", "ncols")
    listed = sound.select("scene_id")
    of_sound = masks.join(listed, "scene_id", "left_semi")
    stats = cut_lineage(T.run_tiles(of_sound, grid, factor, {detector: flag}), "stats")
    O.write_tile_report(T.locate_tiles(stats.drop("detector"), sound, grid), f"{out}/report")
    O.write_chips(O.valid_chips(px10, stats.filter("valid"), grid), f"{out}/chips")
    O.write_run_summary(O.run_summaries(
        T.scene_summary(stats, grid, ("scene_id", "detector")), sound, {detector: parameters or {}}), f"{out}/summary")
    return checks_of(spark, out, sound, grid)


def checks_of(spark, out: str, scenes: DataFrame, grid: SceneGrid) -> DataFrame:
    """Checks of a delivered folder against the scenes it should hold; the rows are written, so that they can be read again."""
    texts = L.scan_tile_report(spark, f"{out}/report")
    report = cut_lineage(L.typed_report(L.identify_tiles(texts, scenes, grid)), "report")
    chips = O.chip_listing(spark, f"{out}/chips")
    summary = L.scan_run_summary(spark, f"{out}/summary").select(F.col("scene.scene_id").alias("scene_id"), "results.scene_cloud_percent")
    lines = spark.read.schema("value string, scene_id bigint").text(f"{out}/report")
    windows = H.tile_windows(report.filter("tile_row is not null"), grid)
    rows = H.check_grid_cover(windows, grid, scenes)
    for more in (
        H.check_report_schema(lines, grid, scenes), H.check_report_values(texts, grid, scenes), H.check_geography(report, scenes, grid),
        H.expected(H.check_consistency(report, summary, chips), scenes, "CK6"),
    ):
        rows = rows.unionByName(more)
    return cut_lineage(rows, "checks")
