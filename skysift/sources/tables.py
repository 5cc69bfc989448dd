"""Readers of configuration, reports, summaries and verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.constants import REPORT_COLUMNS, SceneGrid
from skysift.functions.geodesy import with_utm
from skysift.functions.tilemath import percent_to_count

VERDICTS = ("cloud", "thin_cloud", "clear")
REPORT_SCHEMA = ", ".join(f"{c} string" for c in REPORT_COLUMNS)
SUMMARY_SCHEMA = (
    "detector string, parameters map<string,double>, "
    "scene struct<scene_id: bigint, epsg: int, origin_easting: double, origin_northing: double, footprint_bbox: array<double>>, "
    "results struct<scene_cloud_percent: double, valid_tiles: bigint, invalid_tiles: bigint, cloud_pixels_total: bigint, max_nodata_fraction: double>"
)
VERDICT_SCHEMA = "row int, col int, character string, reason string, verdict string, notes string"


def parse_config(texts: DataFrame, raw: str, schema: str, required: Sequence[str]) -> DataFrame:
    """JSON configuration texts -> columns. A malformed text or a missing key fails the job."""
    keys = F.json_object_keys(raw)
    lacking = F.array_except(F.array(*[F.lit(k) for k in required]), keys)
    checked = F.when(F.coalesce(F.size(lacking), F.lit(-1)) == 0, F.col(raw)).otherwise(
        F.raise_error(F.concat(F.lit("configuration lacks "), F.coalesce(F.array_join(lacking, ","), F.lit("everything: not valid JSON")))))
    return texts.withColumn("_c", F.from_json(checked, schema, {"mode": "FAILFAST"})).select(
        *[c for c in texts.columns if c != raw], "_c.*")


def scan_detector_config(spark: SparkSession, path: str, schema: str, required: Sequence[str], whole: bool = True) -> DataFrame:
    """Configuration files (or one document per line) as rows."""
    texts = spark.read.option("wholetext", str(whole).lower()).text(path)
    return parse_config(texts.select(F.col("value").alias("_raw")), "_raw", schema, required)


def effective(override: Column, configured: Column, default: float) -> Column:
    """Argument over file over default."""
    return F.coalesce(override, configured, F.lit(default))


def off_if_zero(value: Column) -> Column:
    """0 spells 'off'."""
    return F.nullif(value, F.lit(0))


def scan_tile_report(spark: SparkSession, path: str, folders: str = "") -> DataFrame:
    """Report files below ``scene_id=...`` folders, as text columns; the header must match. ``folders`` declares further ones."""
    return spark.read.option("header", "true").option("enforceSchema", "false").schema(REPORT_SCHEMA + f", {folders}scene_id bigint").csv(path)


def identify_tiles(report: DataFrame, scenes: DataFrame, grid: SceneGrid) -> DataFrame:
    """Recover (tile_row, tile_col) of report rows from their printed box.

    Files have no row order in Spark. The box centre, projected to the scene's
    grid, lies in its tile however the corners were rounded; outside the grid, or
    without geocoding, both are NULL.
    """
    middle = lambda a, b: (F.col(a).cast("double") + F.col(b).cast("double")) / 2
    placed = report.join(scenes.select("scene_id", F.col("epsg").alias("_epsg"), F.col("origin_e").alias("_e0"), F.col("origin_n").alias("_n0")), "scene_id", "left")
    centred = placed.withColumns({"_lat": middle("min_latitude", "max_latitude"), "_lon": middle("min_longitude", "max_longitude")})
    metres = grid.tile_px * grid.metres
    cell = lambda gap, most: F.when((gap >= 0) & (gap < most * metres), F.floor(gap / metres).cast("int"))
    found = with_utm(centred, [("_lat", "_lon", "_e", "_n")], "_epsg").withColumns({
        "tile_row": cell(F.col("_n0") - F.col("_n"), grid.rows), "tile_col": cell(F.col("_e") - F.col("_e0"), grid.cols)})
    return found.drop("_epsg", "_e0", "_n0", "_lat", "_lon", "_e", "_n")


def typed_report(report: DataFrame) -> DataFrame:
    numbers = [c for c in REPORT_COLUMNS if c != "valid"]
    return report.withColumns({**{c: F.col(c).cast("double") for c in numbers}, "valid": F.col("valid") == "True"})


def load_runs(spark: SparkSession, path: str, scenes: DataFrame, grid: SceneGrid) -> DataFrame:
    """Tile rows of finished runs from their report files below ``detector=...`` folders.

    A printed percentage of six decimals gives the pixel count back exactly.
    """
    return typed_report(identify_tiles(scan_tile_report(spark, path, "detector string, "), scenes, grid)).select(
        "detector", "scene_id", "tile_row", "tile_col", "cloud_cover_percent",
        percent_to_count(F.col("cloud_cover_percent"), grid.tile_pixels).alias("cloud_pixels"), "valid")


def scan_run_summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUMMARY_SCHEMA).option("mode", "FAILFAST").json(path)


def scan_audit_verdicts(spark: SparkSession, path: str, expected: int = 16) -> DataFrame:
    """Human verdicts per scene; a wrong word or a wrong number of rows fails the job, whatever columns are asked for."""
    rows = spark.read.option("header", "true").option("enforceSchema", "false").schema(VERDICT_SCHEMA + ", scene_id bigint").csv(path)
    known = F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False))
    rows = rows.filter(F.assert_true(known, F.concat(F.lit("unknown verdict: "), F.coalesce("verdict", F.lit("none")))).isNull())
    counts = rows.groupBy("scene_id").agg(F.count(F.lit(1)).alias("_n"))
    sized = rows.join(counts, "scene_id").filter(F.assert_true(F.col("_n") == expected, F.concat(F.lit("verdict rows: "), F.col("_n"))).isNull())
    return sized.withColumnsRenamed({"row": "tile_row", "col": "tile_col"}).drop("_n")
