"""Output checks. Defects are planted by rules on the data, so both outcomes occur."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift.functions import tilemath as M
from skysift.operators import analysis as A
from skysift.operators import checks as H
from skysift.operators import grid as G
from skysift.operators import outline as V
from skysift.operators import resample as S
from skysift.operators import tiles as T
from skysift.operators.screening import screen
from skysift.plans import fixtures as X
from skysift.plans.aggregates import scene_footprints
from skysift.plans.outputs import located_model, stored_chips, stored_report
from skysift.plans.registry import query
from skysift.plans.scalars import KEY, inverse_views, tile_runs
from skysift.plans.vectors import RING_VIEWS, features, rings
from skysift.session import cut_lineage, scratch_path
from skysift.sources import geojson as J
from skysift.sources import sinks as O
from skysift.sources import tables as L

I = X._idiv


def _expect(check_id: str, ok: str, detail: str, source: str) -> str:
    return f"select scene_id, '{check_id}' as check_id, {ok} as ok, false as skipped, {detail} as detail from {source}"


def ids(spark, sf):
    return X.px60(spark, sf, placed=False).select("scene_id").distinct()


@query("check_grid_cover", X.sql(_expect(
    "CK1", "scene_id % 4 <> 1", "case when scene_id % 4 = 1 then '239 tiles, 0 repeated, 1 misplaced' else '240 tiles, 0 repeated, 0 misplaced' end", "ids")))
def check_grid_cover(spark, sf):
    """In every fourth scene one tile is missing and one is shifted by a pixel."""
    tiles = G.tile_grid(ids(spark, sf), X.GRID).filter(~((F.col("scene_id") % 4 == 1) & (F.col("tile_index") == 37)))
    shifted = (F.col("scene_id") % 4 == 1) & (F.col("tile_index") == 100)
    windows = H.tile_windows(tiles, X.GRID).withColumns({c: F.col(c) + shifted.cast("int") for c in ("x0", "x1")})
    return H.check_grid_cover(windows, X.GRID)


@query("check_report_schema", X.sql(_expect(
    "CK2", "scene_id % 5 <> 3", "case when scene_id % 5 = 3 then 'no report' else '1 header, 240 data rows' end", "ids")))
def check_report_schema(spark, sf):
    """Report files against the list of scenes; every fifth report was not delivered."""
    lines = spark.read.schema("value string, scene_id bigint").text(stored_report(spark, sf))
    return H.check_report_schema(lines.filter("scene_id % 5 <> 3"), X.GRID, ids(spark, sf))


def texts(spark, sf):
    """Report rows as text, with a wrong verdict on some valid-looking tiles and short decimals on others."""
    rows = O.report_rows(located_model(spark, sf))
    over = (F.col("tile_row") == 2) & (F.col("valid") == "False")
    short = (F.col("tile_row") == 9) & (F.col("tile_col") == 4) & (F.col("scene_id") % 2 == 0)
    return rows.withColumns({
        "valid": F.when(over, "True").otherwise(F.col("valid")),
        "cloud_cover_percent": F.when(short, F.format_string("%.2f", F.col("cloud_cover_percent").cast("double"))).otherwise(F.col("cloud_cover_percent"))})


@query("check_report_values", X.sql(_expect(
    "CK3", "bad = 0", "printf('%d of 240 rows are wrong', bad)",
    "(select scene_id, count(*) filter ((tile_row = 2 and 100 * cloud_pixels > 6750) or (tile_row = 9 and tile_col = 4 and scene_id % 2 = 0)) as bad from tiles where detector = 'model' group by scene_id)")))
def check_report_values(spark, sf):
    return H.check_report_values(texts(spark, sf), X.GRID)


def footprint_scenes(spark, sf):
    foot = scene_footprints(spark, sf)
    return foot.select("scene_id", "epsg", "origin_e", "origin_n", *[c.alias(f"f_{n}") for n, c in A.footprint_bbox(F.col("footprint")).items()])


@query("check_geography", X.sql(
    "select scene_id, 'CK4' as check_id, scene_id % 3 <> 1 as ok, scene_id % 3 = 2 as skipped, case scene_id % 3 when 0 then 'boxes match; union matches' when 1 then 'boxes differ; union matches' else 'no geocoding' end as detail from ids"))
def check_geography(spark, sf):
    """Printed boxes against the grid; in some scenes a box is moved, in others the geocoding is unknown."""
    rows = O.report_rows(located_model(spark, sf))
    moved = (F.col("scene_id") % 3 == 1) & (F.col("tile_row") == 6) & (F.col("tile_col") == 7)
    # The defect is in the printed text, before any tile is known.
    shifted = F.format_string("%.8f", F.col("max_latitude").cast("double") + F.when(moved, 1e-5).otherwise(0.0))
    printed = rows.withColumn("max_latitude", shifted).drop("tile_row", "tile_col")
    report = L.typed_report(L.identify_tiles(printed, X.scenes(spark, sf), X.GRID))
    scenes = footprint_scenes(spark, sf).withColumn("epsg", F.when(F.col("scene_id") % 3 != 2, F.col("epsg")))
    return H.check_geography(report, scenes, X.GRID)


@query("check_chips", X.sql(_expect(
    "CK5", "bad = 0", "printf('%d chips, %d mismatched, 0 torn, 0 unlike', chips, bad)",
    "(select scene_id, count(*) filter (valid) as chips, count(*) filter (valid and tile_row = 0 and scene_id % 2 = 1) as bad from tiles where detector = 'model' group by scene_id)")))
def check_chips(spark, sf):
    """All stored chips against a report that calls row 0 of odd scenes invalid."""
    chips = spark.read.parquet(stored_chips(spark, sf))
    cells = chips.select("scene_id", "tile_row", "tile_col", F.posexplode("cells").alias("pos", "c"))
    t = X.GRID.tile_px
    back = cells.select(
        "scene_id", (F.col("tile_row") * t + G.idiv(F.col("pos"), t)).alias("y"), (F.col("tile_col") * t + F.col("pos") % t).alias("x"), "c.r", "c.g", "c.b")
    faith = A.rgb_fidelity(back, X.px10(spark, sf).drop("brow", "bcol"), X.GRID)
    report = tile_runs(spark, sf).filter(F.col("detector") == "model")
    said = report.withColumn("valid", F.col("valid") & ~((F.col("tile_row") == 0) & (F.col("scene_id") % 2 == 1)))
    return H.check_chips(chips, said, faith, X.GRID)


@query("check_consistency", X.sql(_expect(
    "CK6", "scene_id % 5 <> 2", "printf('%d valid rows, %d chips', v, v)",
    "(select scene_id, count(*) filter (valid) as v from tiles where detector = 'model' group by scene_id)")))
def check_consistency(spark, sf):
    """Report, summary and chips; every fifth summary is off by 0.01."""
    report = tile_runs(spark, sf).filter(F.col("detector") == "model")
    summary = T.scene_summary(report, X.GRID).withColumn(
        "scene_cloud_percent", F.col("scene_cloud_percent") + F.when(F.col("scene_id") % 5 == 2, 0.01).otherwise(0.0))
    return H.check_consistency(report, summary, report.filter("valid").select("scene_id", M.tile_name(F.col("tile_row"), F.col("tile_col")).alias("name")))


@query("check_features", X.sql(
    "select scene_id, 'CK7' as check_id, scene_id % 4 <> 2 as ok, scene_id % 4 = 3 as skipped from ids"))
def check_features(spark, sf):
    """Rings, extent and area of the written regions; some scenes lost all theirs, others never promised any."""
    foot = scene_footprints(spark, sf)
    box = foot.select("scene_id", *[c.alias(n) for n, c in A.footprint_bbox(F.col("footprint")).items()])
    area = A.layer_area(X.masks60(spark, sf).withColumnsRenamed({"a": "threshold", "ref": "class_mask"}), ["threshold", "class_mask"], 60)
    kept = features(spark, sf).filter("scene_id % 4 < 2")
    return H.check_features(kept, area, box, delivered=ids(spark, sf).filter("scene_id % 4 <> 3")).drop("detail")


def geojson_scenes(spark, sf):
    """Geocoding and footprint box of each scene, to be carried along with the lines of its document."""
    foot = scene_footprints(spark, sf)
    return foot.select("scene_id", "epsg", "origin_e", "origin_n", *[c.alias(n) for n, c in A.footprint_bbox(F.col("footprint")).items()])


def _last_component(rows):
    """Each scene's last region of the rule's mask."""
    return rows.filter("class = 'threshold'").groupBy("scene_id").agg(F.max("component").alias("last"))


def faulty_documents(spark, sf) -> tuple[str, DataFrame]:
    """Documents by scene_id % 6: sound, coordinates swapped, a hole given to another region, a region lost, cut off, none."""
    traced = cut_lineage(rings(spark, sf), "traced")
    fault = F.col("scene_id") % 6
    first_hole = traced.filter("hole and seq = 0 and class = 'threshold'").groupBy("scene_id").agg(F.min("ring").alias("moved"))
    marked = traced.join(_last_component(traced), "scene_id", "left").join(first_hole, "scene_id", "left")
    of_rule = F.col("class") == "threshold"
    moved = (fault == 2) & of_rule & F.coalesce(F.col("ring") == F.col("moved"), F.lit(False))
    lost = (fault == 3) & of_rule & (F.col("component") == F.col("last"))
    changed = marked.withColumn("component", F.when(moved, F.col("last")).otherwise(F.col("component"))).filter(~lost & (fault != 5)).drop("last", "moved")
    located = V.features_wgs84(changed, X.scenes(spark, sf), 60)
    swapped = located.withColumns({"lon": F.when(fault == 1, F.col("lat")).otherwise(F.col("lon")), "lat": F.when(fault == 1, F.col("lon")).otherwise(F.col("lat"))})
    lines = O.geojson_lines(cut_lineage(swapped, "located")).filter(~((fault == 4) & (F.col("class") == "\uffff")))
    path = scratch_path(spark, "documents")
    O.write_geojson_lines(lines, path)
    return path, traced


@query("scan_geojson", X.sql(
    "select scene_id, class, ring, hole, seq, cast(round_even(lon * 1e6, 0) as bigint) as lon_micro, cast(round_even(lat * 1e6, 0) as bigint) as lat_micro from "
    "(select *, dense_rank() over (partition by scene_id order by class, component, hole, id) as ring from located)",
    RING_VIEWS + ", " + inverse_views(
        "select * exclude (ring), ring as id, cast(600000 + 3000*(scene_id % 10) + vx*60 as double) as e, "
        f"cast(5500020 - 1800*{I('scene_id', 10)} - vy*60 as double) as n from (select * exclude (n) from vert)"), recursive=True))
def scan_geojson(spark, sf):
    """Vertices of the written documents, rings numbered as they stand in the file."""
    path = scratch_path(spark, "geojson")
    O.write_geojson(features(spark, sf), path)
    micro = lambda c: F.rint(F.col(c) * 1e6).cast("bigint").alias(f"{c}_micro")
    return J.scan_geojson(spark, path).filter("kind = 'P'").select("scene_id", "class", "ring", "hole", "seq", micro("lon"), micro("lat"))


@query("check_geojson", X.sql(
    "select scene_id, 'CK7' as check_id, fault in (0, 5) or (fault = 2 and not holed) as ok, fault = 5 as skipped, "
    "case when fault = 5 then 'no collection' else printf('%d features, %d rings', features - case when fault = 3 then 1 else 0 end, rings - case when fault = 3 then lost_rings else 0 end) || "
    "case fault when 1 then '; rings broken; outside the footprint; area differs' when 2 then case when holed then '; holes outside' else '' end "
    "when 3 then case when 1000 * lost_px > px then '; area differs' else '' end || '; features missing' when 4 then '; document incomplete' else '' end end as detail "
    "from (select scene_id, scene_id % 6 as fault, count(*) filter (not hole) as features, count(*) as rings, count(*) filter (class = 'threshold' and component = last) as lost_rings, "
    "coalesce(bool_or(hole and class = 'threshold'), false) as holed from (select distinct scene_id, class, component, ring, hole from vert) join lastc using (scene_id) group by scene_id) "
    "join (select scene_id, sum(x1 - x0 + 1) as px, sum(x1 - x0 + 1) filter (component = last) as lost_px from comp join lastc using (scene_id) where class = 'threshold' group by scene_id) using (scene_id)",
    RING_VIEWS + ", lastc as (select scene_id, max(component) as last from comp where class = 'threshold' group by scene_id)", recursive=True))
def check_geojson(spark, sf):
    """Delivered documents with planted faults against masks and the promised number of features."""
    path, traced = faulty_documents(spark, sf)
    promised = traced.filter("seq = 0 and not hole and scene_id % 6 < 5").groupBy("scene_id").agg(F.count(F.lit(1)).alias("features"))
    area = A.layer_area(X.masks60(spark, sf).withColumnsRenamed({"a": "threshold", "ref": "class_mask"}), ["threshold", "class_mask"], 60)
    lines = J.scan_geojson(spark, path, geojson_scenes(spark, sf))
    return H.check_geojson(lines, area, X.COARSE_SHAPE, 60, promised)


@query("check_determinism", X.sql(_expect(
    "CK8", "scene_id % 6 <> 5", "case when scene_id % 6 = 5 then '2 rows and 0 chip names differ' else '0 rows and 0 chip names differ' end", "ids")))
def check_determinism(spark, sf):
    """Exact weights against enlarging the mask; one percentage is altered in some scenes."""
    masks = X.masks60(spark, sf)
    first = T.run_tiles(masks, X.GRID, 6, {"model": "b"}).drop("detector")
    fine = S.upsample_nearest(masks.select(*KEY, "brow", "bcol", "b", "nodata"), 6)
    second = T.tile_stats(T.fine_tile_counts(fine, X.GRID, ["b", "nodata"]), X.GRID, cloud="b")
    altered = (F.col("scene_id") % 6 == 5) & (F.col("tile_row") == 4) & (F.col("tile_col") == 4)
    second = second.withColumn("cloud_cover_percent", F.col("cloud_cover_percent") + F.when(altered, 0.5).otherwise(0.0))
    names = lambda df: df.filter("valid").select("scene_id", M.tile_name(F.col("tile_row"), F.col("tile_col")).alias("name"))
    return H.check_determinism(first, second, names(first), names(second))


@query("check_class_mask", X.sql(
    "select scene_id, 'CLASS' as check_id, shares and bright as ok, false as skipped, concat_ws('; ', case when not shares then 'shares differ' end, case when not bright then 'opaque not brighter' end) as detail from "
    "(select scene_id, scene_id % 7 <> 3 as shares, coalesce(sum(b02+b03+b04) filter (opaque) / (count(*) filter (opaque) * 3e0) > sum(b02+b03+b04) filter (cirrus) / (count(*) filter (cirrus) * 3e0), true) as bright from px60 group by scene_id)"))
def check_class_mask(spark, sf):
    """Shares against the declared ones, which are off in some scenes."""
    declared = X.scenes(spark, sf).select(
        "scene_id", (F.col("cloud_pct") + F.when(F.col("scene_id") % 7 == 3, 0.1).otherwise(0.0)).alias("cloud_pct"), "snow_pct")
    return H.check_class_mask(X.px60(spark, sf), declared, X.OFFSET, X.QUANT)


@query("check_mask_dtype_shape", X.sql(_expect("SHAPE", "true", "'240 tiles, 0 partial'", "ids")))
def check_mask_dtype_shape(spark, sf):
    masks = X.masks60(spark, sf)
    counts = S.overlap_tile_counts(masks, X.GRID, 6, ["a"])
    return H.check_mask_shape(masks, ["a", "b", "ref", "nodata"], counts, X.GRID)


@query("screen_catalog", X.sql("select scene_id, cast(5 as bigint) as pass, cast(0 as bigint) as fail, cast(0 as bigint) as skip from ids where scene_id % 3 <> 2"))
def screen_catalog(spark, sf):
    """The whole job over all scenes, a third of which declare a wrong size; totals of the checks of its files."""
    foot = footprint_scenes(spark, sf)
    box = F.array("f_min_latitude", "f_min_longitude", "f_max_latitude", "f_max_longitude")
    scenes = foot.withColumns({
        "footprint_bbox": box, "nrows": F.lit(X.GRID.height) - F.when(F.col("scene_id") % 3 == 2, 6).otherwise(0), "ncols": F.lit(X.GRID.width)})
    out = scratch_path(spark, "screened")
    rows = screen(scenes, X.masks60(spark, sf), X.px10(spark, sf), X.GRID, 6, "model", out, flag="b", parameters={"prob_threshold": X.MODEL_THRESHOLD})
    H.assert_checks(rows)
    return H.check_totals(rows)


@query("check_runs", X.sql(
    "select scene_id, 6 - f as pass, f as fail, cast(case when scene_id % 3 = 2 then 1 else 0 end as bigint) as skip from (select scene_id, "
    "cast((case when scene_id % 4 = 1 then 1 else 0 end) + (case when bad > 0 then 1 else 0 end) + (case when scene_id % 3 = 1 then 1 else 0 end) + (case when scene_id % 5 = 2 then 1 else 0 end) + (case when scene_id % 6 = 5 then 1 else 0 end) as bigint) as f from "
    "(select scene_id, count(*) filter ((tile_row = 2 and 100 * cloud_pixels > 6750) or (tile_row = 9 and tile_col = 4 and scene_id % 2 = 0)) as bad from tiles where detector = 'model' group by scene_id))"
).replace("select scene_id, 6 - f as pass", "select scene_id, cast(6 - f - (case when scene_id % 3 = 2 then 1 else 0 end) as bigint) as pass"))
def check_runs(spark, sf):
    """Totals over six of the checks above."""
    return H.check_totals(
        check_grid_cover(spark, sf), check_report_values(spark, sf), check_geography(spark, sf),
        check_consistency(spark, sf), check_determinism(spark, sf), check_mask_dtype_shape(spark, sf))
