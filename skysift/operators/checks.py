"""Checks of delivered outputs: rows of (scene_id, check_id, ok, skipped, detail)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.constants import REPORT_COLUMNS, SceneGrid
from skysift.functions import tilemath as M
from skysift.operators import analysis as A
from skysift.operators import compare as C
from skysift.operators import delivered as D
from skysift.operators import outline as V
from skysift.operators.grid import tile_bbox
from skysift.session import cut_lineage

ROW = ("scene_id", "check_id", "ok", "skipped", "detail")


def _row(df: DataFrame, check_id: str, ok: Column, detail: Column, skipped: Column | None = None) -> DataFrame:
    return df.select(
        "scene_id", F.lit(check_id).alias("check_id"), F.coalesce(ok, F.lit(False)).alias("ok"),
        (F.lit(False) if skipped is None else skipped).alias("skipped"), detail.alias("detail"))


def expected(result: DataFrame, scenes: DataFrame, check_id: str, missing: str = "no report") -> DataFrame:
    """A row of the check for every scene of the list; a scene without one fails."""
    listed = scenes.select("scene_id").distinct()
    return listed.join(result, "scene_id", "left").select(
        "scene_id", F.coalesce("check_id", F.lit(check_id)).alias("check_id"), F.coalesce("ok", F.lit(False)).alias("ok"),
        F.coalesce("skipped", F.lit(False)).alias("skipped"), F.coalesce("detail", F.lit(missing)).alias("detail"))


def tile_windows(tiles: DataFrame, grid: SceneGrid) -> DataFrame:
    """Pixel window of each tile: y0, y1, x0, x1 (half open)."""
    t = grid.tile_px
    return tiles.withColumns({
        "y0": F.col("tile_row") * t, "y1": (F.col("tile_row") + 1) * t, "x0": F.col("tile_col") * t, "x1": (F.col("tile_col") + 1) * t})


def check_grid_cover(windows: DataFrame, grid: SceneGrid, scenes: DataFrame | None = None) -> DataFrame:
    """CK1: the windows cover every pixel exactly once, by interval arithmetic.

    Equal squares on distinct multiples of the tile edge, inside the scene and
    as many as the grid has, are a partition.
    """
    t = grid.tile_px
    square = (
        (F.col("y1") - F.col("y0") == t) & (F.col("x1") - F.col("x0") == t)
        & (F.col("y0") % t == 0) & (F.col("x0") % t == 0)
        & F.col("y0").between(0, grid.height - t) & F.col("x0").between(0, grid.width - t)
    )
    seen = windows.groupBy("scene_id", "y0", "x0").agg(F.count(F.lit(1)).alias("n"), F.every(square).alias("square"))
    sums = seen.groupBy("scene_id").agg(
        F.sum("n").alias("tiles"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(~F.col("square")).alias("misplaced"))
    ok = (F.col("tiles") == grid.rows * grid.cols) & (F.col("repeated") == 0) & (F.col("misplaced") == 0)
    rows = _row(sums, "CK1", ok, F.format_string("%d tiles, %d repeated, %d misplaced", "tiles", "repeated", "misplaced"))
    return rows if scenes is None else expected(rows, scenes, "CK1", "no tiles")


def check_report_schema(lines: DataFrame, grid: SceneGrid, scenes: DataFrame | None = None) -> DataFrame:
    """CK2: exact header and row count, on the text lines of the reports.

    Here and below ``scenes`` lists the scenes that were to be delivered; without
    it only those that are there can be judged.
    """
    header = F.col("value") == ",".join(REPORT_COLUMNS)
    sums = lines.groupBy("scene_id").agg(F.count_if(header).alias("headers"), F.count_if(~header).alias("rows"))
    ok = (F.col("headers") == 1) & (F.col("rows") == grid.rows * grid.cols)
    rows = _row(sums, "CK2", ok, F.format_string("%d header, %d data rows", "headers", "rows"))
    return rows if scenes is None else expected(rows, scenes, "CK2")


def check_report_values(report: DataFrame, grid: SceneGrid, scenes: DataFrame | None = None) -> DataFrame:
    """CK3: range, decimals, verdict words, and no valid row over the cut.

    An invalid row under the cut is allowed: it may have too much no-data.
    """
    percent = F.col("cloud_cover_percent").try_cast("double")
    bad = (
        percent.isNull() | ~percent.between(0.0, 100.0) | ~M.enough_decimals(F.col("cloud_cover_percent"))
        | ~F.col("valid").isin("True", "False")
        | ((F.col("valid") == "True") & ~M.within_cut(M.percent_to_count(percent, grid.tile_pixels), grid.tile_pixels))
    )
    sums = report.groupBy("scene_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce(bad, F.lit(True))).alias("bad"))
    rows = _row(sums, "CK3", F.col("bad") == 0, F.format_string("%d of %d rows are wrong", "bad", "rows"))
    return rows if scenes is None else expected(rows, scenes, "CK3")


def check_geography(identified: DataFrame, scenes: DataFrame, grid: SceneGrid) -> DataFrame:
    """CK4: boxes equal the grid's to 1e-6 degrees, their union the footprint to 1e-4.

    ``identified`` is a typed report with tile ids; ``scenes`` has the geocoding
    (skipped where it is unknown) and the footprint box as f_* columns, NULL if unknown.
    A scene without report rows fails, and so does a row whose tile was not found.
    """
    names = list(REPORT_COLUMNS[:4])
    given = identified.select("scene_id", "tile_row", "tile_col", *[F.col(n).alias(f"r_{n}") for n in names])
    # A row of no tile is measured against the first one, and counted as lost.
    joined = given.join(scenes, "scene_id").withColumns({"_row": F.col("tile_row"), "tile_row": F.coalesce("tile_row", F.lit(0)), "tile_col": F.coalesce("tile_col", F.lit(0))})
    located = tile_bbox(joined, grid).withColumn("tile_row", F.col("_row"))
    gap = F.greatest(*[F.abs(F.col(n) - F.col(f"r_{n}")) for n in names])
    sums = (
        located.groupBy("scene_id").agg(
            F.max(gap).alias("worst"), F.count_if(F.col("tile_row").isNull()).alias("lost"),
            F.count_if((F.col("r_min_latitude") >= F.col("r_max_latitude")) | (F.col("r_min_longitude") >= F.col("r_max_longitude"))).alias("flat"),
            F.max(F.col("epsg").isNull()).alias("unknown"),
            F.greatest(
                F.abs(F.min("r_min_latitude") - F.min("f_min_latitude")), F.abs(F.min("r_min_longitude") - F.min("f_min_longitude")),
                F.abs(F.max("r_max_latitude") - F.max("f_max_latitude")), F.abs(F.max("r_max_longitude") - F.max("f_max_longitude"))).alias("edge"))
    )
    ok = F.col("unknown") | ((F.col("lost") == 0) & (F.col("flat") == 0) & (F.col("worst") <= 1e-6) & (F.coalesce("edge", F.lit(0.0)) <= 1e-4))
    detail = F.when(F.col("unknown"), "no geocoding").otherwise(
        F.concat(F.when((F.col("worst") <= 1e-6) & (F.col("lost") == 0), "boxes match").otherwise("boxes differ"), F.lit("; "),
                 F.when(F.col("edge").isNull(), "no footprint").when(F.col("edge") <= 1e-4, "union matches").otherwise("union differs")))
    return expected(_row(sums, "CK4", ok, detail, F.col("unknown")), scenes, "CK4")


def check_chips(chips: DataFrame, report: DataFrame, fidelity: DataFrame, grid: SceneGrid, scenes: DataFrame | None = None) -> DataFrame:
    """CK5: the chips are those of the valid rows, whole, and true to the source.

    ``chips`` has name and cells; ``fidelity`` the per-tile differences (at most 3
    grey levels on average, 2 per channel mean). Every chip is compared. A scene of
    ``scenes`` that the report lacks fails.
    """
    problems = C.chips_vs_report(chips, report).groupBy("scene_id").agg(F.count(F.lit(1)).alias("mismatched"))
    sizes = chips.groupBy("scene_id").agg(F.count(F.lit(1)).alias("chips"), F.count_if(F.size("cells") != grid.tile_pixels).alias("torn"))
    faith = fidelity.groupBy("scene_id").agg(F.count_if((F.col("mean_abs_diff") > 3.0) | (F.col("channel_gap") > 2.0)).alias("unlike"))
    reported = report.select("scene_id").distinct()
    joined = reported.join(problems, "scene_id", "left").join(sizes, "scene_id", "left").join(faith, "scene_id", "left").fillna(0)
    ok = (F.col("mismatched") == 0) & (F.col("torn") == 0) & (F.col("unlike") == 0)
    rows = _row(joined, "CK5", ok, F.format_string("%d chips, %d mismatched, %d torn, %d unlike", "chips", "mismatched", "torn", "unlike"))
    return rows if scenes is None else expected(rows, scenes, "CK5")


def check_consistency(report: DataFrame, summary: DataFrame, chips: DataFrame) -> DataFrame:
    """CK6: mean of the tiles equals the summary to 1e-3; as many chips as valid rows."""
    rows = report.groupBy("scene_id").agg(F.avg("cloud_cover_percent").alias("mean"), F.count_if("valid").alias("valid_rows"))
    found = chips.groupBy("scene_id").agg(F.count(F.lit(1)).alias("chips"))
    joined = rows.join(summary.select("scene_id", "scene_cloud_percent"), "scene_id", "left").join(found, "scene_id", "left").fillna(0, ["chips"])
    near = F.abs(F.col("mean") - F.col("scene_cloud_percent")) <= 1e-3
    return _row(joined, "CK6", near & (F.col("valid_rows") == F.col("chips")), F.format_string("%d valid rows, %d chips", "valid_rows", "chips"))


def check_features(features: DataFrame, mask_area: DataFrame, footprints: DataFrame, tolerance: float = 1e-3, delivered: DataFrame | None = None) -> DataFrame:
    """CK7: rings are sound, lie inside the footprint, and have the mask's area.

    ``delivered`` lists the scenes that promised a collection; others are skipped.
    A collection without any ring for a mask that has area fails.
    """
    features = cut_lineage(features, "features")
    rings = V.ring_validity(features).groupBy("scene_id").agg(F.count(F.lit(1)).alias("rings"), F.count_if(~F.col("ok")).alias("broken"))
    outside = V.feature_extent_check(features, footprints).groupBy("scene_id").agg(F.count_if(~F.col("ok")).alias("outside"))
    area = V.feature_area_check(features, mask_area, tolerance).groupBy("scene_id").agg(F.count_if(~F.col("ok")).alias("off_area"))
    joined = area.join(rings, "scene_id", "left").join(outside, "scene_id", "left")
    if delivered is None:
        joined = joined.withColumn("_skip", F.lit(False))
    else:
        promised = delivered.select("scene_id", F.lit(True).alias("_promised")).distinct()
        joined = joined.join(promised, "scene_id", "left").withColumn("_skip", F.col("_promised").isNull()).drop("_promised")
    filled = joined.fillna(0)
    ok = F.col("_skip") | ((F.col("broken") == 0) & (F.col("outside") == 0) & (F.col("off_area") == 0))
    return _row(filled, "CK7", ok, F.format_string("%d rings, %d broken, %d outside, %d classes off in area", "rings", "broken", "outside", "off_area"), F.col("_skip"))


def check_geojson(
    lines: DataFrame, mask_area: DataFrame, shape: tuple[int, int], metres: int, promised: DataFrame, tolerance: float = 1e-3,
) -> DataFrame:
    """CK7 on the delivered documents: form, rings, holes, extent, area and number of features.

    ``lines`` and ``mask_area`` as in ``delivered_figures``. ``promised`` lists the
    scenes that were to have a collection, with the number of its features; other
    scenes are skipped. A promised scene without a document fails unless its mask
    is empty.
    """
    said = promised.select("scene_id", F.col("features").alias("_said"))
    figures = D.delivered_figures(lines, mask_area, shape, metres, tolerance)
    joined = figures.join(said, "scene_id", "full").withColumn("found", F.coalesce("found", F.lit(False)))
    joined = joined.fillna(0, [c for c in figures.columns if c not in ("scene_id", "found")])
    skipped = F.col("_said").isNull() & ~F.col("found")
    faults = {
        "document incomplete": F.col("bad_lines") > 0, "rings broken": F.col("broken") > 0, "rings cross": F.col("crossings") > 0,
        "holes outside": F.col("stray") > 0, "outside the footprint": F.col("outside") > 0, "area differs": F.col("off_area") > 0,
        "features missing": F.col("features") != F.coalesce("_said", "features"),
    }
    sound = ~F.greatest(*faults.values())
    detail = F.concat_ws("; ", F.format_string("%d features, %d rings", "features", "rings"), *[F.when(c, name) for name, c in faults.items()])
    return _row(joined, "CK7", skipped | sound, F.when(skipped, "no collection").otherwise(detail), skipped)


def check_determinism(
    first: DataFrame, second: DataFrame, chips_first: DataFrame, chips_second: DataFrame, scenes: DataFrame | None = None,
) -> DataFrame:
    """CK8: two runs have identical report rows and chip names; a scene of ``scenes`` that both lack fails."""
    rows = C.same_rows(first, second).select("scene_id", F.lit(1).alias("r"), F.lit(0).alias("c"))
    names = C.same_rows(chips_first.select("scene_id", "name"), chips_second.select("scene_id", "name")).select("scene_id", F.lit(0).alias("r"), F.lit(1).alias("c"))
    every = first.select("scene_id", F.lit(0).alias("r"), F.lit(0).alias("c")).distinct()
    sums = every.unionByName(rows).unionByName(names).groupBy("scene_id").agg(F.sum("r").alias("rows"), F.sum("c").alias("names"))
    rows = _row(sums, "CK8", (F.col("rows") == 0) & (F.col("names") == 0), F.format_string("%d rows and %d chip names differ", "rows", "names"))
    return rows if scenes is None else expected(rows, scenes, "CK8", "in neither run")


def check_class_mask(px: DataFrame, declared: DataFrame, offset: float, quantification: float) -> DataFrame:
    """Class mask: no double label, shares as declared to 5e-3, opaque brighter than cirrus.

    ``declared`` has scene_id, cloud_pct, snow_pct. All figures come from one
    aggregate over the pixels.
    """
    n = F.count(F.lit(1))
    visible = F.col("b02") + F.col("b03") + F.col("b04")
    sums = px.groupBy("scene_id").agg(
        F.count_if(F.col("opaque") & F.col("cirrus")).alias("double"),
        (F.lit(100.0) * F.count_if(F.col("opaque") | F.col("cirrus")) / n).alias("cloud"),
        (F.lit(100.0) * F.count_if("snow") / n).alias("snow"),
        *[F.sum(F.when(F.col(c), visible)).alias(f"{c}_s") for c in ("opaque", "cirrus")],
        *[F.count_if(c).alias(f"{c}_n") for c in ("opaque", "cirrus")],
    )
    mean = {c: A.mean_reflectance(F.col(f"{c}_s"), F.col(f"{c}_n") * 3, offset, quantification) for c in ("opaque", "cirrus")}
    order = F.coalesce(mean["opaque"] > mean["cirrus"], F.lit(True))
    joined = sums.join(declared, "scene_id")
    shares = (F.abs(F.col("cloud") - F.col("cloud_pct")) <= 5e-3) & (F.abs(F.col("snow") - F.col("snow_pct")) <= 5e-3)
    ok = (F.col("double") == 0) & shares & order
    detail = F.concat_ws("; ", F.when(F.col("double") > 0, "classes overlap"), F.when(~shares, "shares differ"), F.when(~order, "opaque not brighter"))
    return _row(joined, "CLASS", ok, detail)


def require_boolean(masks: DataFrame, columns: Sequence[str]) -> None:
    """A probability or an interpolated label must never pass for a mask."""
    wrong = [c for c in columns if masks.schema[c].dataType.simpleString() != "boolean"]
    if wrong:
        raise TypeError(f"not boolean masks: {wrong}")


def check_mask_shape(masks: DataFrame, columns: Sequence[str], counts: DataFrame, grid: SceneGrid) -> DataFrame:
    """Only boolean masks, and every tile whole."""
    require_boolean(masks, columns)
    sums = counts.groupBy("scene_id").agg(F.count(F.lit(1)).alias("tiles"), F.count_if(F.col("pixels") != grid.tile_pixels).alias("partial"))
    ok = (F.col("tiles") == grid.rows * grid.cols) & (F.col("partial") == 0)
    return _row(sums, "SHAPE", ok, F.format_string("%d tiles, %d partial", "tiles", "partial"))


def check_totals(*results: DataFrame) -> DataFrame:
    """Passed, failed and skipped checks per scene."""
    rows = results[0]
    for r in results[1:]:
        rows = rows.unionByName(r)
    status = F.when(~F.col("ok"), "FAIL").when(F.col("skipped"), "SKIP").otherwise("PASS")
    return rows.groupBy("scene_id").agg(*[F.count_if(status == s).alias(s.lower()) for s in ("PASS", "FAIL", "SKIP")])


def assert_checks(results: DataFrame, path: str | None = None) -> None:
    """Fail the job if any check failed.

    The message counts the failures of each check and names the first scene; the
    full list is written to ``path`` if one is given.
    """
    failed = results.filter(~F.col("ok"))
    if path:
        failed.write.parquet(path)
        failed = results.sparkSession.read.parquet(path)
    first = F.min(F.struct("scene_id", "detail")).alias("first")
    counts = failed.groupBy("check_id").agg(F.count(F.lit(1)).alias("n"), first).orderBy("check_id").collect()
    if counts:
        raise AssertionError("; ".join(f"{r.n} failed, first scene {r.first.scene_id} {r.check_id}: {r.first.detail}" for r in counts))
