"""Grid, resampling, neighbourhood and pixel-join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysift.constants import FULL_GRID, PROB_SCALE
from skysift.functions import radiometry as R
from skysift.functions import tilemath as M
from skysift.operators import cells as E
from skysift.operators import detect
from skysift.operators import grid as G
from skysift.operators import neighborhood as N
from skysift.operators import resample as S
from skysift.operators import tiles as T
from skysift.plans import fixtures as X
from skysift.plans.registry import query
from skysift.plans.scalars import BOX_VIEWS, KEY

I = X._idiv
BOX = ("min_latitude", "min_longitude", "max_latitude", "max_longitude")


@query("tile_grid", X.sql("select scene_id, tile_row, tile_col, tile_row*20 + tile_col as tile_index from tgrid"))
def tile_grid(spark, sf):
    return G.tile_grid(X.px60(spark, sf, placed=False).select("scene_id").distinct(), X.GRID)


@query("row_major_index", X.sql(
    "select scene_id, tile_row, tile_col, tile_row*20 + tile_col as tile_index, cloud_pixels from tiles where detector = 'model'"))
def row_major_index(spark, sf):
    """Tile rows in report order."""
    rows = T.run_tiles(X.masks60(spark, sf), X.GRID, 6, {"model": "b"})
    index = G.row_major_index(F.col("tile_row"), F.col("tile_col"), X.GRID)
    return rows.select("scene_id", "tile_row", "tile_col", index.alias("tile_index"), "cloud_pixels").orderBy("scene_id", "tile_index")


@query("assign_tile", X.sql(
    f"select scene_id, {I('y', 15)} as tile_row, {I('x', 15)} as tile_col, count(*) as pixels, "
    "cast(sum((y % 15) * b02) as bigint) as py_dn, cast(sum((x % 15) * b02) as bigint) as px_dn from px10 group by all"))
def assign_tile(spark, sf):
    """Tile and in-tile offset of every 10 m pixel, as position-weighted sums."""
    px = G.assign_tile(X.px10(spark, sf), X.GRID, offsets=True)
    return px.groupBy("scene_id", "brow", "bcol", "tile_row", "tile_col").agg(
        F.count(F.lit(1)).alias("pixels"),
        F.sum(F.col("py") * F.col("b02")).alias("py_dn"), F.sum(F.col("px") * F.col("b02")).alias("px_dn"),
    ).drop("brow", "bcol")


@query("block_mean", X.sql(
    f"select scene_id, {I('y', 6)} as y, {I('x', 6)} as x, " + ", ".join(f"sum({b}) / 36e0 as {b}" for b in ("b02", "b03", "b04"))
    + " from px10 group by all"))
def block_mean(spark, sf):
    return S.block_mean(X.px10(spark, sf), ["b02", "b03", "b04"], 6).drop("brow", "bcol")


_SUMMED = ("select scene_id, {r} as tile_row, {c} as tile_col, count(*) as pixels, cast(sum(v) as bigint) as total, "
           "cast(sum(v * (y % 15) * (x % 15 + 1)) as bigint) as placed from {src} group by all")


def placed_sums(px, value):
    """Position-weighted integer sums per tile: a compact image of a raster."""
    tiled = G.assign_tile(px, X.GRID, offsets=True)
    return tiled.groupBy("scene_id", "tile_row", "tile_col").agg(
        F.count(F.lit(1)).alias("pixels"), F.sum(value).cast("bigint").alias("total"),
        F.sum(value * F.col("py") * (F.col("px") + 1)).cast("bigint").alias("placed"))


@query("upsample_nearest", X.sql(_SUMMED.format(r=I("y", 15), c=I("x", 15), src="up"),
    "up as (select scene_id, y*6+i as y, x*6+j as x, q24 as v from px60 cross join i6 cross join j6)"))
def upsample_nearest(spark, sf):
    up = S.upsample_nearest(X.px60(spark, sf).select(*KEY, "q24"), 6)
    return placed_sums(up, F.col("q24"))


@query("resize_linear", X.sql(_SUMMED.format(r=I("y", 15), c=I("x", 15), src="bil"),
    "dst as (select scene_id, cast(r.range as bigint) as y, cast(c.range as bigint) as x, (r.range + 0.5e0)/6e0 - 0.5e0 as sy, (c.range + 0.5e0)/6e0 - 0.5e0 as sx "
    "from ids cross join range(180) r cross join range(300) c), "
    "nb as (select *, cast(floor(sy) as bigint) as y0, cast(floor(sx) as bigint) as x0, sy - floor(sy) as wy, sx - floor(sx) as wx from dst), "
    "bil as (select d.scene_id, d.y, d.x, cast(round(144e0 * ((1-wy)*((1-wx)*p.b10 + wx*q.b10) + wy*((1-wx)*s.b10 + wx*t.b10))) as bigint) as v from nb d "
    "join px60 p on p.scene_id = d.scene_id and p.y = greatest(y0, 0) and p.x = greatest(x0, 0) "
    "join px60 q on q.scene_id = d.scene_id and q.y = greatest(y0, 0) and q.x = least(x0 + 1, 49) "
    "join px60 s on s.scene_id = d.scene_id and s.y = least(y0 + 1, 29) and s.x = greatest(x0, 0) "
    "join px60 t on t.scene_id = d.scene_id and t.y = least(y0 + 1, 29) and t.x = least(x0 + 1, 49))"))
def resize_linear(spark, sf):
    """Bilinear enlargement of the cirrus band; values are exact in 1/144 DN."""
    out = S.resize_linear(X.px60(spark, sf), "b10", 6, X.COARSE_SHAPE, edge=X.EDGE)
    return placed_sums(out, F.rint(F.col("b10") * 144).cast("bigint"))


@query("regrid_10m", X.sql(
    "select scene_id, y*2 + i as y, x*2 + j as x, b11 from px20 cross join i6 cross join j6 "
    "where i < 2 and j < 2 and y*2+i between 37 and 95 and x*2+j between 51 and 133"))
def regrid_10m(spark, sf):
    """20 m band on a 10 m window whose edges fall inside coarse pixels."""
    coarse = X.px20(spark, sf, (37 // 2, 48, 51 // 2, 67)).select(*KEY, "b11")
    return S.regrid_fine(coarse, 2, (37, 96, 51, 134))


@query("overlap_tile_counts", X.sql(
    "select scene_id, tile_row, tile_col, pixels, a, b, ref, nodata from tiles_wide"))
def overlap_tile_counts(spark, sf):
    """Exact tile counts straight from the coarse masks."""
    return S.overlap_tile_counts(X.masks60(spark, sf), X.GRID, 6, ["a", "b", "ref", "nodata"])


@query("rounded_edge_tiles", X.sql(
    "select d.scene_id, cast(r.range as bigint) as tile_row, cast(c.range as bigint) as tile_col, count(*) as cells, "
    "1e2 * count(*) filter (b) / count(*) as percent, 1e2 * count(*) filter (b) / count(*) > 30e0 as invalid "
    "from det d join range(12) r on d.y >= round_even(r.range * 2.5e0, 0) and d.y < round_even((r.range + 1) * 2.5e0, 0) "
    "join range(20) c on d.x >= round_even(c.range * 2.5e0, 0) and d.x < round_even((c.range + 1) * 2.5e0, 0) group by all"))
def rounded_edge_tiles(spark, sf):
    return S.rounded_edge_tiles(X.masks60(spark, sf), X.GRID, 6, "b")


@query("majority_downsample", X.sql(
    f"select scene_id, {I('y', 6)} as y, {I('x', 6)} as x, count(*) filter (b02 > 4000) > 18 as bright from px10 group by all"))
def majority_downsample(spark, sf):
    fine = X.px10(spark, sf).withColumn("bright", F.col("b02") > 4000)
    return S.majority_downsample(fine, "bright", 6).drop("brow", "bcol")


@query("rgb_thumbnail", X.sql(
    f"select scene_id, {I('y', 6)} as y, {I('x', 6)} as x, " + ", ".join(f"cast(floor(sum({c}) / 36e0) as bigint) as {c}" for c in "rgb")
    + " from px10 group by all"))
def rgb_thumbnail(spark, sf):
    return S.rgb_thumbnail(X.px10(spark, sf), 6).drop("brow", "bcol")


def disk_views(radius: int) -> str:
    return (f"disk as (select cast(dy.range as bigint) - {radius} as dy, cast(dx.range as bigint) - {radius} as dx "
            f"from range({2 * radius + 1}) dy cross join range({2 * radius + 1}) dx "
            f"where (dy.range - {radius})*(dy.range - {radius}) + (dx.range - {radius})*(dx.range - {radius}) <= {radius * radius})")


REFLECT_Y = "case when y + dy < 0 then -1 - (y + dy) when y + dy > 29 then 59 - (y + dy) else y + dy end"
REFLECT_X = "case when x + dx < 0 then -1 - (x + dx) when x + dx > 49 then 99 - (x + dx) else x + dx end"


@query("disk_average", X.sql(
    "select t.scene_id, t.y, t.x, cast(sum(s.q24) as bigint) / cast(count(*) * 16777216 as double) as prob "
    f"from (select scene_id, y, x, {REFLECT_Y} as sy, {REFLECT_X} as sx from px60 cross join disk) t "
    "join px60 s on s.scene_id = t.scene_id and s.y = t.sy and s.x = t.sx group by all", disk_views(4)))
def disk_average(spark, sf):
    return N.disk_average(X.px60(spark, sf), "q24", 4, X.COARSE_SHAPE, edge=X.EDGE)


@query("disk_dilate", X.sql(
    "select p.scene_id, p.y, p.x, h.y is not null as b from px60 p left join "
    "(select distinct scene_id, y + dy as y, x + dx as x from det cross join disk where b) h using (scene_id, y, x)", disk_views(2)))
def disk_dilate(spark, sf):
    return N.disk_dilate(X.masks60(spark, sf), "b", 2, X.COARSE_SHAPE, edge=X.EDGE)


@query("mask_outline", X.sql(
    "select scene_id, y, x, ref, ref and not (coalesce(lag(ref) over wx, false) and coalesce(lead(ref) over wx, false) "
    "and coalesce(lag(ref) over wy, false) and coalesce(lead(ref) over wy, false)) as outline from det "
    "window wx as (partition by scene_id, y order by x), wy as (partition by scene_id, x order by y)"))
def mask_outline(spark, sf):
    return N.mask_outline(X.masks60(spark, sf), "ref", X.COARSE_SHAPE, edge=X.EDGE)


@query("prob_morph_mask", X.sql(
    "select p.scene_id, p.y, p.x, h.y is not null as cloud from px60 p left join "
    "(select distinct scene_id, y + dy as y, x + dx as x from hot cross join disk where dy*dy + dx*dx <= 1) h using (scene_id, y, x)",
    disk_views(2) + ", hot as (select t.scene_id, t.y, t.x "
    f"from (select scene_id, y, x, {REFLECT_Y} as sy, {REFLECT_X} as sx from px60 cross join disk) t "
    "join px60 s on s.scene_id = t.scene_id and s.y = t.sy and s.x = t.sx group by all having sum(s.q24) > 0.55e0 * 13 * 16777216)"))
def prob_morph_mask(spark, sf):
    """Average over radius 2, threshold at 0.55, dilate by 1."""
    return N.prob_morph_mask(X.px60(spark, sf), "q24", 0.55, 2, 1, X.COARSE_SHAPE, edge=X.EDGE)


@query("grid_guard", X.sql(
    "select scene_id, cast(min(y) as bigint) = 0 and (max(y)+1)*6 - 6*(scene_id % 3 // 2) = 180 and (max(x)+1)*6 = 300 as grid_ok from px60 group by scene_id"))
def grid_guard(spark, sf):
    """Scenes whose declared size is not the whole grid are flagged."""
    sizes = X.px60(spark, sf, placed=False).groupBy("scene_id").agg(
        ((F.max("y") + 1) * 6).alias("nrows"), ((F.max("x") + 1) * 6).alias("ncols"))
    declared = sizes.withColumn("nrows", F.col("nrows") - F.expr("6 * ((scene_id % 3) div 2)"))
    return G.grid_guard(declared, X.GRID).select("scene_id", "grid_ok")


@query("reassemble_scene", X.sql("select scene_id, y, x, cast(case when b then 36 else 0 end as bigint) as cloud from det"))
def reassemble_scene(spark, sf):
    """Per-tile masks cut and put together again, counted per 60 m cell."""
    fine = S.upsample_nearest(X.masks60(spark, sf).select(*KEY, "brow", "bcol", "b"), 6)
    from skysift.sources.sinks import tile_masks

    scene = G.reassemble_scene(tile_masks(fine, X.GRID, "b"), X.GRID)
    cell = scene.groupBy("scene_id", G.idiv(F.col("y"), 6).alias("y"), G.idiv(F.col("x"), 6).alias("x"))
    return cell.agg(F.sum(R.mask_binarize(F.col("value")).cast("int")).cast("int").alias("cloud"))


@query("band_stack", X.sql(
    "select scene_id, y, x, b02 as \"B02\", b03 as \"B03\", b04 as \"B04\", b10 as \"B10\", b11 as \"B11\" from px60"))
def band_stack(spark, sf):
    """Long band rows pivoted to one row per pixel, bands in fixed order."""
    bands = ("B02", "B03", "B04", "B10", "B11")
    pairs = F.array(*[F.struct(F.lit(b).alias("band"), F.col(b.lower()).alias("dn")) for b in bands])
    long = X.px60(spark, sf).select(*KEY, "brow", "bcol", F.inline(pairs))
    return detect.band_stack(long, bands).drop("brow", "bcol")


_STACK = ("stack as (select f.scene_id, f.y, f.x, f.b02, f.b03, f.b04, m.b11, c.b10 from px10 f "
          f"join px20 m on m.scene_id = f.scene_id and m.y = {I('f.y', 2)} and m.x = {I('f.x', 2)} "
          f"join px60 c on c.scene_id = f.scene_id and c.y = {I('f.y', 6)} and c.x = {I('f.x', 6)}), "
          "fine_rule as (select *, (b02 = 0) as nodata, (cast((r2+r3+r4)/cast(3 as float) as float) > cast(0.30 as float) and "
          "case when r3+r11 <> 0 then cast((r3-r11)/(r3+r11) as float) else cast(0 as float) end > cast(-0.20 as float)) or r10 > cast(0.0110 as float) as cloud "
          f"from (select *, {X._sql_refl('b02')} as r2, {X._sql_refl('b03')} as r3, {X._sql_refl('b04')} as r4, {X._sql_refl('b11')} as r11, {X._sql_refl('b10')} as r10 from stack))")
FINE_TILES = _STACK + (f", fine_tiles as (select scene_id, {I('y', 15)} as tile_row, {I('x', 15)} as tile_col, "
                       "count(*) filter (cloud) as cloud_pixels, count(*) filter (nodata) as nd from fine_rule group by all)")


def fine_stack(spark, sf):
    """Five bands on the 10 m grid, joined by cell."""
    return E.fine_stack(X.cells10(spark, sf), X.cells20(spark, sf), X.px60(spark, sf, placed=True))


@query("multires_join", X.sql(
    f"select scene_id, {I('y', 15)} as tile_row, {I('x', 15)} as tile_col, count(*) as pixels, "
    "cast(sum(b02) as bigint) as b02, cast(sum(b11 * (y % 15)) as bigint) as b11, cast(sum(b10 * (x % 15)) as bigint) as b10 from stack group by all", _STACK))
def multires_join(spark, sf):
    """10, 20 and 60 m bands on one grid, joined by their cell."""
    px = G.assign_tile(fine_stack(spark, sf), X.GRID, offsets=True)
    return px.groupBy("scene_id", "brow", "bcol", "tile_row", "tile_col").agg(
        F.count(F.lit(1)).alias("pixels"), F.sum("b02").alias("b02"),
        F.sum(F.col("b11") * F.col("py")).alias("b11"), F.sum(F.col("b10") * F.col("px")).alias("b10"),
    ).drop("brow", "bcol")


def fine_tile_stats(spark, sf):
    rule = detect.build("threshold", **X.RULE_A, offset=X.OFFSET, quantification=X.QUANT)
    px = rule(fine_stack(spark, sf)).withColumn("nodata", R.nodata_flag(F.col("b02")))
    return T.tile_stats(T.fine_tile_counts(px, X.GRID, ["cloud", "nodata"]), X.GRID)


@query("tile_stats", X.sql(
    "select scene_id, tile_row, tile_col, cloud_pixels, 1e2 * cloud_pixels / 225 as cloud_cover_percent, cast(nd as double) / 225 as nodata_fraction, "
    "100*cloud_pixels <= 30*225 and cast(nd as double)/225 <= 0.5 as valid, " + ", ".join(f"round({b}, 8) as {b}" for b in BOX)
    + " from fine_tiles join boxes using (scene_id, tile_row, tile_col)", FINE_TILES + ", " + BOX_VIEWS))
def tile_stats(spark, sf):
    """Which tiles of each scene are at most 30 % cloud, and where are they?"""
    located = T.locate_tiles(fine_tile_stats(spark, sf), X.scenes(spark, sf), X.GRID)
    return located.withColumns({b: F.round(b, 8) for b in BOX})
