"""Tile, class, agreement and probe queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysift.constants import NAIVE_RULE
from skysift.functions import geodesy
from skysift.functions import radiometry as R
from skysift.functions import tilemath as M
from skysift.operators import analysis as A
from skysift.operators import compare as C
from skysift.operators import grid as G
from skysift.operators import resample as S
from skysift.operators import tiles as T
from skysift.plans import fixtures as X
from skysift.plans.gridding import FINE_TILES, fine_tile_stats
from skysift.plans.registry import query
from skysift.plans.scalars import BOX_VIEWS, DETECTORS, KEY, inverse_views, tile_runs

I = X._idiv
RUN = ("scene_id", "detector")
SUN = {"zenith": 53.52, "azimuth": 168.40}
HEIGHTS = (300.0, 600.0, 1000.0)


@query("scene_cloud_percent", X.sql(
    "select scene_id, 1e2 * sum(cloud_pixels) / (count(*) * 225) as scene_cloud_percent from fine_tiles group by scene_id", FINE_TILES))
def scene_cloud_percent(spark, sf):
    return T.scene_cloud_percent(fine_tile_stats(spark, sf), X.GRID)


@query("scene_summary", X.sql(
    "select scene_id, detector, count(*) filter (valid) as valid_tiles, count(*) filter (not valid) as invalid_tiles, "
    "cast(sum(cloud_pixels) as bigint) as cloud_pixels_total, max(nodata_fraction) as max_nodata_fraction, "
    "1e2 * sum(cloud_pixels) / (count(*) * 225) as scene_cloud_percent from tiles group by all"))
def scene_summary(spark, sf):
    return T.scene_summary(tile_runs(spark, sf), X.GRID, RUN)


@query("cover_distribution", X.sql(
    "select scene_id, detector, count(*) filter (cloud_cover_percent between 25 and 35) as in_25_35, "
    "count(*) filter (cloud_cover_percent between 20 and 40) as in_20_40, count(*) filter (cloud_pixels = 0) as clear, "
    "min(cloud_cover_percent) as lowest, max(cloud_cover_percent) as highest, max(cloud_cover_percent) filter (valid) as closest_valid, "
    "min(cloud_cover_percent) filter (not valid) as closest_invalid from tiles group by all"))
def cover_distribution(spark, sf):
    return T.cover_distribution(tile_runs(spark, sf), RUN)


@query("class_shares", X.sql(
    "select scene_id, 1e2 * count(*) filter (opaque) / count(*) as opaque, 1e2 * count(*) filter (cirrus) / count(*) as cirrus, "
    "1e2 * count(*) filter (snow) / count(*) as snow, 1e2 * count(*) filter (ref) / count(*) as total from det group by scene_id"))
def class_shares(spark, sf):
    return A.class_shares(X.masks60(spark, sf), ["opaque", "cirrus", "snow"], F.col("ref"))


@query("class_mean_brightness", X.sql(
    "select *, coalesce(opaque_mean > cirrus_mean, true) as ok from (select scene_id, "
    "(sum(b02+b03+b04) filter (opaque) / (count(*) filter (opaque) * 3e0) + -1000e0) / 10000e0 as opaque_mean, "
    "(sum(b02+b03+b04) filter (cirrus) / (count(*) filter (cirrus) * 3e0) + -1000e0) / 10000e0 as cirrus_mean from px60 group by scene_id)"))
def class_mean_brightness(spark, sf):
    return A.class_mean_brightness(X.px60(spark, sf), X.OFFSET, X.QUANT)


SCORES_SQL = ("*, case when precision + recall = 0 then 0 else 2 * precision * recall / (precision + recall) end as f1 from (select *, "
              "case when tp + fp = 0 then 0e0 else tp / cast(tp + fp as double) end as precision, case when tp + fn = 0 then 0e0 else tp / cast(tp + fn as double) end as recall, "
              "case when tp + fp + fn = 0 then 0e0 else tp / cast(tp + fp + fn as double) end as iou, (tp + tn) / cast(tp + fp + fn + tn as double) as pixel_agreement from ({src}))")
COUNTS_SQL = "count(*) filter ({p} and {r}) as tp, count(*) filter ({p} and not {r}) as fp, count(*) filter (not {p} and {r}) as fn, count(*) filter (not {p} and not {r}) as tn"


@query("confusion_counts", X.sql("select scene_id, " + COUNTS_SQL.format(p="a", r="ref") + " from det group by scene_id"))
def confusion_counts(spark, sf):
    return A.confusion_counts(X.masks60(spark, sf), "a", "ref")


@query("agreement_scores", X.sql(
    "select " + SCORES_SQL.format(src="select scene_id, " + COUNTS_SQL.format(p="b", r="ref") + " from det group by scene_id")))
def agreement_scores(spark, sf):
    return A.with_scores(A.confusion_counts(X.masks60(spark, sf), "b", "ref"))


@query("layer_area", X.sql(
    "select scene_id, unnest(['opaque','cirrus']) as class, unnest([cast(o * 3600 as double), cast(c * 3600 as double)]) as area_m2 from "
    "(select scene_id, count(*) filter (opaque) as o, count(*) filter (cirrus) as c from px60 group by scene_id)"))
def layer_area(spark, sf):
    return A.layer_area(X.px60(spark, sf), ["opaque", "cirrus"], 60)


FOOT_VIEWS = inverse_views(
    "select scene_id, cast(oe + dx.range*3000 as double) as e, cast(orn - dy.range*1800 as double) as n "
    f"from (select scene_id, 600000 + 3000*(scene_id % 10) as oe, 5500020 - 1800*{I('scene_id', 10)} as orn from ids) cross join range(2) dx cross join range(2) dy"
).replace("g0 as", "f0 as").replace("from g0", "from f0").replace("g1 as", "f1 as").replace("from g1", "from f1").replace(
    "g2 as", "f2 as").replace("from g2", "from f2").replace("g3 as", "f3 as").replace("from g3", "from f3").replace("located as", "corners as")


def scene_footprints(spark, sf):
    """Scenes with their corner ring as an array of (lat, lon), in degrees."""
    s = X.scenes(spark, sf).withColumns({
        "e1": F.col("origin_e") + X.GRID.width * 10, "n1": F.col("origin_n") - X.GRID.height * 10})
    corners = [("origin_e", "origin_n", "la0", "lo0"), ("e1", "origin_n", "la1", "lo1"), ("e1", "n1", "la2", "lo2"), ("origin_e", "n1", "la3", "lo3")]
    located = geodesy.with_lonlat(s, corners)
    ring = F.array(*[F.struct(F.round(F.col(f"la{i}"), 8).alias("lat"), F.round(F.col(f"lo{i}"), 8).alias("lon")) for i in (0, 1, 2, 3, 0)])
    return located.select(*s.drop("e1", "n1").columns, ring.alias("footprint"))


@query("bbox_union", X.sql(
    "select u.scene_id, " + ", ".join(f"round(u.{c}, 8) as {c}" for c in ("min_latitude", "min_longitude", "max_latitude", "max_longitude"))
    + ", greatest(abs(u.min_latitude - f.a), abs(u.min_longitude - f.b), abs(u.max_latitude - f.c), abs(u.max_longitude - f.d)) <= 1e-4 as matches_footprint from "
    "(select scene_id, min(min_latitude) as min_latitude, min(min_longitude) as min_longitude, max(max_latitude) as max_latitude, max(max_longitude) as max_longitude from boxes group by scene_id) u "
    "join (select scene_id, min(lat) as a, min(lon) as b, max(lat) as c, max(lon) as d from corners group by scene_id) f using (scene_id)",
    BOX_VIEWS + ", " + FOOT_VIEWS))
def bbox_union(spark, sf):
    """Union of all tile boxes against the box of the scene footprint."""
    scenes = scene_footprints(spark, sf)
    tiles = G.tile_bbox(G.tile_grid(scenes.drop("footprint"), X.GRID), X.GRID)
    union = A.bbox_union(tiles)
    foot = scenes.select("scene_id", *[c.alias(f"f_{n}") for n, c in A.footprint_bbox(F.col("footprint")).items()])
    names = [c for c in union.columns if c != "scene_id"]
    gap = F.greatest(*[F.abs(F.col(n) - F.col(f"f_{n}")) for n in names])
    return union.join(foot, "scene_id").select(
        "scene_id", *[F.round(n, 8).alias(n) for n in names], (gap <= 1e-4).alias("matches_footprint"))


@query("band_median", X.sql(
    f"select scene_id, {I('y', 15)} as tile_row, {I('x', 15)} as tile_col, (quantile_cont(cast(b03 as double), 0.5) - 1000e0) / 10000e0 as median from px10 group by all"))
def band_median(spark, sf):
    """Exact median reflectance of one band in every tile."""
    px = G.assign_tile(X.px10(spark, sf), X.GRID)
    med = A.exact_median(px, ["b03"], ["scene_id", "brow", "bcol", "tile_row", "tile_col"])
    return med.select("scene_id", "tile_row", "tile_col", ((F.col("b03") + X.OFFSET) / X.QUANT).alias("median"))


@query("class_spectra", X.sql(
    "select label, count(*) as pixels, (sum(b03) / cast(count(*) as double) + -1000e0) / 10000e0 as mean_b03, (sum(b11) / cast(count(*) as double) + -1000e0) / 10000e0 as mean_b11, "
    "cast(sum(cast(round_even(cast(ndsi as double) * 16777216e0, 0) as bigint)) as bigint) / cast(count(*) as double) / 16777216e0 as mean_ndsi from "
    "(select *, case when opaque then 'opaque' when cirrus then 'cirrus' else 'ground' end as label from t60) group by label"))
def class_spectra(spark, sf):
    label = F.when(F.col("opaque"), "opaque").when(F.col("cirrus"), "cirrus").otherwise("ground")
    return A.class_spectra(X.px60(spark, sf).withColumn("label", label), "label", X.OFFSET, X.QUANT)


@query("cirrus_floor", X.sql(
    "select *, mean_b10 / nullif(floor, 0) as ratio from (select *, min(mean_b10) over (partition by scene_id) as floor from "
    f"(select scene_id, {I('(y*6+i)', 15)} as tile_row, {I('(x*6+j)', 15)} as tile_col, (sum(b10) / cast(count(*) as double) + -1000e0) / 10000e0 as mean_b10 "
    "from px60 cross join i6 cross join j6 group by all))"))
def cirrus_floor(spark, sf):
    return A.cirrus_floor(X.px60(spark, sf), X.GRID, 6, X.OFFSET, X.QUANT)


@query("cohort_medians", X.sql(
    "select cohort, (quantile_cont(cast(b02+b03+b04 as double), 0.5) / 3e0 + -1000e0) / 10000e0 as brightness, (quantile_cont(cast(b10 as double), 0.5) + -1000e0) / 10000e0 as b10 "
    "from (select *, case when ref then 'reference' when b then 'model_only' else 'clear' end as cohort from det) group by cohort"))
def cohort_medians(spark, sf):
    return A.cohort_medians(X.masks60(spark, sf), "b", "ref", X.OFFSET, X.QUANT)


@query("marginal_recall", X.sql(
    "select scene_id, case when p + r = 0 then 0 else 2 * p * r / (p + r) end as cirrus_f1, case when missed = 0 then 0 else rec / cast(missed as double) end as recovered_share, "
    "nf / cast(n as double) as new_false_share from (select *, case when tp + fp = 0 then 0 else tp / cast(tp + fp as double) end as p, case when tp + fn = 0 then 0 else tp / cast(tp + fn as double) end as r from "
    "(select scene_id, count(*) as n, count(*) filter (h and cirrus) as tp, count(*) filter (h and not cirrus) as fp, count(*) filter (not h and cirrus) as fn, "
    "count(*) filter (ref and not w) as missed, count(*) filter (ref and not w and h) as rec, count(*) filter (not ref and not w and h) as nf from "
    "(select *, bright > cast(0.30 as float) and ndsi > cast(-0.20 as float) as w, r10 > cast(0.0110 as float) as h from det) group by scene_id))"))
def marginal_recall(spark, sf):
    bright, slope, r10 = X.rule_columns()
    px = X.px60(spark, sf).select(
        "scene_id", "cirrus", R.class_union(F.col("opaque"), F.col("cirrus")).alias("ref"),
        ((bright > R.f32(X.RULE_A["t_bright"])) & (slope > R.f32(X.RULE_A["t_ndsi"]))).alias("white"),
        R.cirrus_flag(r10, X.RULE_A["t_cirrus"]).alias("high"))
    return A.marginal_recall(px, F.col("white"), F.col("high"), F.col("ref"), F.col("cirrus"))


_f = X._sql_refl
_RES = (
    f"fb as (select scene_id, y, x, {I('y', 6)} as cy, {I('x', 6)} as cx, cast(({_f('b02')} + {_f('b03')} + {_f('b04')})/cast(3 as float) as float) > cast(0.33 as float) as fine, b02, b03, b04 from px10), "
    "cb as (select scene_id, cy, cx, "
    "cast((" + " + ".join(f"cast((cast(sum({b})/36e0 as float) + cast(-1000 as float)) / cast(10000 as float) as float)" for b in ("b02", "b03", "b04")) + ")/cast(3 as float) as float) > cast(0.33 as float) as coarse, "
    "count(*) filter (fine) as hot from fb group by all), "
    "ob as (select *, coarse and not (coalesce(lag(coarse) over wx, false) and coalesce(lead(coarse) over wx, false) and coalesce(lag(coarse) over wy, false) and coalesce(lead(coarse) over wy, false)) as outline "
    "from cb window wx as (partition by scene_id, cy order by cx), wy as (partition by scene_id, cx order by cy)), "
    f"tb as (select scene_id, {I('y', 15)} as tr, {I('x', 15)} as tc, count(*) filter (fine) as nf, count(*) filter (coarse) as nc, count(*) filter (fine = coarse) as same from fb join cb using (scene_id, cy, cx) group by all)"
)


@query("resolution_agreement", X.sql(
    "select * from (select scene_id, 1e2 * sum(same) / (count(*) * 225) as agreement_percent, 1e2 * sum(abs(nf - nc)) / (count(*) * 225) as mean_gap, 1e2 * max(abs(nf - nc)) / 225 as max_gap, "
    "count(*) filter ((100*nf <= 6750) <> (100*nc <= 6750)) as flips from tb group by scene_id) join "
    "(select scene_id, count(*) filter (outline) as edge_cells, count(*) filter (outline and hot > 0 and hot < 36) as mixed_edge_cells from ob group by scene_id) using (scene_id)", _RES))
def resolution_agreement(spark, sf):
    """The brightness rule at 10 m against the same rule on 60 m block means."""
    return A.resolution_agreement(X.px10(spark, sf), X.GRID, 6, 0.33, X.OFFSET, X.QUANT, edge=X.EDGE)


_MOVES = ", ".join(f"({h!r}::double, {dy}, {dx})" for h, dy, dx in A.shadow_offsets(**SUN, heights=HEIGHTS, metres=60))


@query("shadow_probe", X.sql(
    "select height, count(*) as pixels, (sum(v) / (count(*) * 3e0) + -1000e0) / 10000e0 as mean_brightness from "
    "(select m.h as height, o.b02+o.b03+o.b04 as v from det c cross join moves m join det o on o.scene_id = c.scene_id and o.y = c.y + m.dy and o.x = c.x + m.dx where c.a and not o.a "
    "union all select -1e0, b02+b03+b04 from det where not a) group by height", f"moves(h, dy, dx) as (values {_MOVES})"))
def shadow_probe(spark, sf):
    """Displaced cloud cells against clear ground (height -1)."""
    return A.shadow_probe(X.masks60(spark, sf), "a", **SUN, heights=HEIGHTS, metres=60, offset=X.OFFSET, quantification=X.QUANT)


@query("dark_shares", X.sql(
    "select scene_id, " + ", ".join(f"1e2 * count(*) filter (not a and ndsi <= cast(0.4 as float) and bright < cast({t} as float)) / count(*) as below_{int(t * 100):03d}" for t in (0.06, 0.07, 0.08))
    + " from det group by scene_id"))
def dark_shares(spark, sf):
    bright, slope, r10 = X.rule_columns()
    cloud = R.cloud_rule(bright, slope, r10, **X.RULE_A)
    return A.dark_shares(X.px60(spark, sf), cloud, slope > R.f32(0.4), bright, (0.06, 0.07, 0.08))


@query("rgb_fidelity", X.sql(
    f"select scene_id, {I('y', 15)} as tile_row, {I('x', 15)} as tile_col, sum(abs(r - r2) + abs(g - g2) + abs(b - b2)) / (count(*) * 3e0) as mean_abs_diff, "
    "greatest(abs(sum(r - r2)), abs(sum(g - g2)), abs(sum(b - b2))) / cast(count(*) as double) as channel_gap "
    f"from (select *, {I('r', 4)} * 4 + 2 as r2, {I('g', 4)} * 4 + 2 as g2, {I('b', 8)} * 8 + 4 as b2 from px10) group by all"))
def rgb_fidelity(spark, sf):
    """The display image against a coarsened copy of itself."""
    px = X.px10(spark, sf).select(*KEY, "brow", "bcol", "r", "g", "b")
    coarse = px.withColumns({"r": F.expr("r div 4 * 4 + 2"), "g": F.expr("g div 4 * 4 + 2"), "b": F.expr("b div 8 * 8 + 4")})
    return A.rgb_fidelity(px, coarse, X.GRID)


@query("class_overlap", X.sql("select scene_id, count(*) as overlapping from px60 where opaque and q24 % 7 = 0 group by scene_id"))
def class_overlap(spark, sf):
    """Pixels flagged in two classes; a second layer is derived so that some exist."""
    px = X.px60(spark, sf).withColumn("other", F.col("q24") % 7 == 0)
    return px.filter(F.col("opaque") & F.col("other")).groupBy("scene_id").agg(F.count(F.lit(1)).alias("overlapping"))


@query("param_cross", X.sql(
    "select cast(setting as bigint) as setting, t_bright, t_ndsi, t_cirrus, scene_id, count(*) filter ((bright > cast(t_bright as float) and ndsi > cast(t_ndsi as float)) or r10 > cast(t_cirrus as float)) as cloud "
    "from t60 cross join settings group by all",
    "settings(setting, t_bright, t_ndsi, t_cirrus) as (values (0, 0.33e0, -1e0, 1e0), (1, 0.16e0, -0.2e0, 0.005e0), (2, 0.18e0, -0.2e0, 0.005e0), (3, 0.3e0, -0.2e0, 0.011e0))"))
def param_cross(spark, sf):
    """A handful of settings as conditional sums: pixels are never multiplied."""
    settings = [tuple(NAIVE_RULE.values()), (0.16, -0.20, 0.005), (0.18, -0.20, 0.005), tuple(X.RULE_A.values())]
    bright, slope, r10 = X.rule_columns()
    px = X.px60(spark, sf).select("scene_id", bright.alias("bright"), slope.alias("slope"), r10.alias("r10"))
    wide = px.groupBy("scene_id").agg(*[
        F.count_if(R.cloud_rule(F.col("bright"), F.col("slope"), F.col("r10"), *s)).alias(f"s{i}") for i, s in enumerate(settings)])
    rows = F.array(*[F.struct(
        F.lit(i).alias("setting"), F.lit(s[0]).alias("t_bright"), F.lit(s[1]).alias("t_ndsi"), F.lit(s[2]).alias("t_cirrus"), F.col(f"s{i}").alias("cloud"),
    ) for i, s in enumerate(settings)])
    return wide.select("scene_id", F.inline(rows))
