"""Column-expression queries: radiometry, spectral tests, rules, names."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysift.constants import NAIVE_RULE, QUANT_RANGES
from skysift.functions import geodesy
from skysift.functions import radiometry as R
from skysift.functions import tilemath as M
from skysift.operators import grid as G
from skysift.operators.tiles import run_tiles
from skysift.plans import fixtures as X
from skysift.plans.registry import query
from skysift.session import scratch_path
from skysift.sources import pixels as P

KEY = ("scene_id", "y", "x")
BANDS5 = ("b02", "b03", "b04", "b10", "b11")
DETECTORS = {"threshold": "a", "model": "b", "class_mask": "ref"}


@query("scan_band_window", X.sql(
    "select scene_id, y, x, b03 as dn from px10 where y between 40 and 109 and x between 33 and 121"))
def scan_band_window(spark, sf):
    """One band, one window of the 10 m grid, of every scene, from a stored table."""
    path = scratch_path(spark, "px10")
    px = X.rows10(spark, sf, ["b02", "b03", "b04", "b08"])
    P.write_scene_folders(px.select("brow", *KEY, "b02", "b03", "b04", "b08"), X.GRID, 10, path, dealt=True)
    stored = "scene_id bigint, y int, x int, b02 bigint, b03 bigint, b04 bigint, b08 bigint"
    return P.scan_window(spark, path, stored, ["b03"], window=(40, 110, 33, 122)).withColumnRenamed("b03", "dn")


@query("scan_class_mask", X.sql(
    "select scene_id, y, x, opaque, cirrus, snow from (select scene_id, y, x, "
    "case when opaque then 1 else 0 end > 0 as opaque, case when cirrus then 1 else 0 end > 0 as cirrus, "
    "case when snow then 1 else 0 end > 0 as snow from px60)"))
def scan_class_mask(spark, sf):
    """Three stored byte channels -> three booleans."""
    path = scratch_path(spark, "classes")
    stored = X.px60(spark, sf).select(*KEY, *[F.col(c).cast("int").alias(c) for c in ("opaque", "cirrus", "snow")])
    P.write_scene_folders(stored, X.GRID, 60, path)
    return P.scan_class_mask(spark, path)


@query("scan_rgb_window", X.sql(
    "select scene_id, y, x, r, g, b from px10 where y between 100 and 130 and x between 200 and 260"))
def scan_rgb_window(spark, sf):
    """RGB of one window; derived rows outside it are dropped before they are expanded."""
    return X.px10(spark, sf, (100, 131, 200, 261)).select(*KEY, "r", "g", "b")


_off = "case when scene_id % 5 = 4 then 0 else -1000 end"


@query("to_reflectance", X.sql(
    "select scene_id, y, x, " + ", ".join(
        f"cast(cast((cast({b} as float) + cast({_off} as float)) / cast(10000 as float) as float) as double) as {b}"
        for b in BANDS5) + " from px60"))
def to_reflectance(spark, sf):
    """Offsets come from the catalogue; a scene without an offset list uses 0."""
    catalog = X.scenes(spark, sf).select(
        "scene_id", F.when(F.col("scene_id") % 5 != 4, F.lit(X.OFFSET)).alias("offset"))
    px = X.px60(spark, sf).select(*KEY, *BANDS5).join(catalog, "scene_id")
    offset = F.coalesce("offset", F.lit(0.0))
    return px.select(*KEY, *[R.reflectance(F.col(b), offset, X.QUANT).alias(b) for b in BANDS5])


@query("clip_reflectance", X.sql(
    "select scene_id, y, x, cast(greatest(r02, cast(0 as float)) as double) as r02 from r60"))
def clip_reflectance(spark, sf):
    return X.px60(spark, sf).select(*KEY, R.clip_reflectance(X.refl("b02")).alias("r02"))


@query("nodata_flag", X.sql("select scene_id, y, x, b02 = 0 as nodata from px60"))
def nodata_flag(spark, sf):
    return X.px60(spark, sf).select(*KEY, R.nodata_flag(F.col("b02")).alias("nodata"))


@query("brightness", X.sql("select scene_id, y, x, cast(bright as double) as brightness from t60"))
def brightness(spark, sf):
    return X.px60(spark, sf).select(*KEY, X.rule_columns()[0].alias("brightness"))


@query("ndsi", X.sql("select scene_id, y, x, cast(ndsi as double) as ndsi from t60"))
def ndsi(spark, sf):
    return X.px60(spark, sf).select(*KEY, X.rule_columns()[1].alias("ndsi"))


@query("cirrus_flag", X.sql("select scene_id, y, x, r10 > cast(0.005 as float) as flag from t60"))
def cirrus_flag(spark, sf):
    return X.px60(spark, sf).select(*KEY, R.cirrus_flag(X.refl("b10"), 0.005).alias("flag"))


@query("cloud_rule", X.sql("select scene_id, y, x, a as cloud from det"))
def cloud_rule(spark, sf):
    return X.masks60(spark, sf).select(*KEY, F.col("a").alias("cloud"))


@query("naive_rule", X.sql(
    "select scene_id, y, x, (bright > cast(0.33 as float) and ndsi > cast(-1 as float)) or r10 > cast(1 as float) as cloud from t60"))
def naive_rule(spark, sf):
    return X.px60(spark, sf).select(*KEY, R.cloud_rule(*X.rule_columns(), **NAIVE_RULE).alias("cloud"))


@query("branch_code", X.sql(
    "select scene_id, cast(code as bigint) as code, count(*) as pixels from (select scene_id, case "
    "when w and c then 3 when w then 1 when c then 2 else 0 end as code from (select scene_id, "
    "bright > cast(0.30 as float) and ndsi > cast(-0.20 as float) as w, r10 > cast(0.0110 as float) as c from t60)) group by all"))
def branch_code(spark, sf):
    """Which branch of the rule fired, counted per scene."""
    bright, slope, r10 = X.rule_columns()
    white = (bright > R.f32(X.RULE_A["t_bright"])) & (slope > R.f32(X.RULE_A["t_ndsi"]))
    code = R.branch_code(white, R.cirrus_flag(r10, X.RULE_A["t_cirrus"]))
    return X.px60(spark, sf).groupBy("scene_id", code.alias("code")).agg(F.count(F.lit(1)).alias("pixels"))


def _q8_sql(col: str, lo: float, hi: float) -> str:
    f = lambda v: f"cast({v!r} as float)"
    return (f"cast(round_even(cast(cast(cast((least(greatest({col}, {f(lo)}), {f(hi)}) - {f(lo)}) / {f(hi - lo)} as float)"
            f" * cast(255 as float) as float) as double), 0) as bigint)")


_Q = {k: _q8_sql(c, *QUANT_RANGES[k]) for k, c in (("brightness", "bright"), ("ndsi", "ndsi"), ("b10", "r10"))}


@query("quantize8", X.sql(
    f"select scene_id, y, x, {_Q['brightness']} as q_bright, {_Q['ndsi']} as q_ndsi, {_Q['b10']} as q_b10 from t60"))
def quantize8(spark, sf):
    bright, slope, r10 = X.rule_columns()
    return X.px60(spark, sf).select(
        *KEY,
        R.quantize8(bright, *QUANT_RANGES["brightness"]).alias("q_bright"),
        R.quantize8(slope, *QUANT_RANGES["ndsi"]).alias("q_ndsi"),
        R.quantize8(r10, *QUANT_RANGES["b10"]).alias("q_b10"),
    )


@query("quantized_threshold", X.sql(
    "select scene_id, cast(round_even((0.1e0 + 0.01e0 * (scene_id % 30) - 0e0) / 1e0 * 255e0, 0) as bigint) as q_bright, "
    "cast(round_even((-0.4e0 + 0.02e0 * (scene_id % 15) - -1e0) / 2e0 * 255e0, 0) as bigint) as q_ndsi from ids"))
def quantized_threshold(spark, sf):
    """Per-scene thresholds on the 8-bit scale."""
    ids = X.px60(spark, sf, placed=False).select("scene_id").distinct()
    tb = F.lit(0.1) + F.lit(0.01) * (F.col("scene_id") % 30)
    tn = F.lit(-0.4) + F.lit(0.02) * (F.col("scene_id") % 15)
    return ids.select(
        "scene_id",
        R.quantized_threshold(tb, *QUANT_RANGES["brightness"]).alias("q_bright"),
        R.quantized_threshold(tn, *QUANT_RANGES["ndsi"]).alias("q_ndsi"),
    )


@query("quantized_mask", X.sql(
    "select scene_id, full_percent, quantized_percent, abs(full_percent - quantized_percent) as gap, "
    "abs(full_percent - quantized_percent) <= 0.4 as ok from (select scene_id, 1e2 * count(*) filter (a) / count(*) as full_percent, "
    "1e2 * count(*) filter ((qb > 76 and qn > 102) or qc > 140) / count(*) as quantized_percent from "
    f"(select *, {_Q['brightness']} as qb, {_Q['ndsi']} as qn, {_Q['b10']} as qc from det) group by scene_id)"))
def quantized_mask(spark, sf):
    """Scene percentage on 8-bit layers against full precision."""
    bright, slope, r10 = X.rule_columns()
    quant = R.quantized_rule(
        R.quantize8(bright, *QUANT_RANGES["brightness"]), R.quantize8(slope, *QUANT_RANGES["ndsi"]),
        R.quantize8(r10, *QUANT_RANGES["b10"]), **X.RULE_A)
    n = F.count(F.lit(1))
    both = X.px60(spark, sf).groupBy("scene_id").agg(
        (F.lit(100.0) * F.count_if(R.cloud_rule(bright, slope, r10, **X.RULE_A)) / n).alias("full_percent"),
        (F.lit(100.0) * F.count_if(quant) / n).alias("quantized_percent"),
    )
    gap = F.abs(F.col("full_percent") - F.col("quantized_percent"))
    return both.select("*", gap.alias("gap"), (gap <= 0.4).alias("ok"))


_prob = "((q24 - 838860) / 15099494e0)"


@query("encode_prob24", X.sql(
    f"select scene_id, y, x, cast(least(round_even(least(greatest({_prob}, 0e0), 1e0) * 16777216e0, 0), 16777215e0) as bigint) as code from px60"))
def encode_prob24(spark, sf):
    """Probabilities spread slightly beyond [0, 1], so both clips are met."""
    prob = (F.col("q24") - 838860) / F.lit(15099494.0)
    return X.px60(spark, sf).select(*KEY, R.encode_prob24(prob).alias("code"))


@query("prob_mask", X.sql("select scene_id, y, x, q24 / 16777216e0 > 0.6e0 as cloud from px60"))
def prob_mask(spark, sf):
    prob = F.col("q24") / F.lit(16777216.0)
    return X.px60(spark, sf).select(*KEY, R.prob_mask(prob, X.MODEL_THRESHOLD).alias("cloud"))


@query("class_union", X.sql("select scene_id, y, x, opaque or cirrus as cloud from px60"))
def class_union(spark, sf):
    return X.px60(spark, sf).select(*KEY, R.class_union(F.col("opaque"), F.col("cirrus")).alias("cloud"))


@query("mask_binarize", X.sql("select scene_id, y, x, q24 % 256 > 127 as cloud from px60"))
def mask_binarize(spark, sf):
    return X.px60(spark, sf).select(*KEY, R.mask_binarize(F.col("q24") % 256).alias("cloud"))


@query("tile_name", X.sql(
    "select scene_id, printf('tile_r%02d_c%02d', tile_row, tile_col) as name, tile_row as row_back, tile_col as col_back from tgrid"))
def tile_name(spark, sf):
    """Tile name and the numbers parsed back from it."""
    tiles = G.tile_grid(X.px60(spark, sf, placed=False).select("scene_id").distinct(), X.GRID)
    named = tiles.select("scene_id", M.tile_name(F.col("tile_row"), F.col("tile_col")).alias("name"))
    row, col = M.tile_name_parts(F.col("name"))
    return named.select("*", row.alias("row_back"), col.alias("col_back"))


def tile_runs(spark, sf):
    """Tile rows of the three detectors."""
    return run_tiles(X.masks60(spark, sf), X.GRID, 6, DETECTORS)


@query("cloud_percent", X.sql("select scene_id, tile_row, tile_col, detector, cloud_pixels, cloud_cover_percent from tiles"))
def cloud_percent(spark, sf):
    return tile_runs(spark, sf).drop("nodata_fraction", "valid")


@query("valid_rule", X.sql("select scene_id, tile_row, tile_col, detector, nodata_fraction, valid from tiles"))
def valid_rule(spark, sf):
    return tile_runs(spark, sf).drop("cloud_pixels", "cloud_cover_percent")


@query("percent_to_count", X.sql(
    "select scene_id, tile_row, tile_col, detector, cloud_pixels as recovered from tiles"))
def percent_to_count(spark, sf):
    """Counts recovered from the six-decimal text of the report."""
    text = F.format_string("%.6f", F.col("cloud_cover_percent"))
    return tile_runs(spark, sf).select(
        "scene_id", "tile_row", "tile_col", "detector",
        M.percent_to_count(text.cast("double"), X.GRID.tile_pixels).alias("recovered"))


@query("decimals_rule", X.sql(
    "select scene_id, tile_row, tile_col, detector, length(regexp_extract(txt, '\\.(\\d+)$', 1)) >= 4 as ok "
    "from (select *, case when cloud_pixels % 2 = 0 then printf('%.6f', cloud_cover_percent) else printf('%.2f', cloud_cover_percent) end as txt from tiles)"))
def decimals_rule(spark, sf):
    """Texts with six and with two decimals; only the former pass."""
    pct = F.col("cloud_cover_percent")
    text = F.when(F.col("cloud_pixels") % 2 == 0, F.format_string("%.6f", pct)).otherwise(F.format_string("%.2f", pct))
    return tile_runs(spark, sf).select(
        "scene_id", "tile_row", "tile_col", "detector", M.enough_decimals(text).alias("ok"))


@query("pixel_to_map", X.sql(
    "select scene_id, y, x, cast(600000 + 3000*(scene_id % 10) + x*60 as double) as easting, "
    f"cast(5500020 - 1800*{X._idiv('scene_id', 10)} - y*60 as double) as northing from px60"))
def pixel_to_map(spark, sf):
    px = X.with_geocoding(X.px60(spark, sf).select(*KEY))
    east, north = geodesy.pixel_to_map(F.col("origin_e"), F.col("origin_n"), F.col("y"), F.col("x"), 60)
    return px.select(*KEY, east.alias("easting"), north.alias("northing"))


_origin = f"600000 + 3000*(scene_id % 10) as oe, 5500020 - 1800*{X._idiv('scene_id', 10)} as orn"


@query("tile_utm_bounds", X.sql(
    "select scene_id, tile_row, tile_col, cast(oe + tile_col*150 as double) as east_min, cast(oe + tile_col*150 + 150 as double) as east_max, "
    "cast(orn - tile_row*150 - 150 as double) as north_min, cast(orn - tile_row*150 as double) as north_max "
    f"from (select *, {_origin} from tgrid)"))
def tile_utm_bounds(spark, sf):
    tiles = G.tile_grid(X.scenes(spark, sf).select("scene_id", "origin_e", "origin_n"), X.GRID)
    return G.tile_utm_bounds(tiles, X.GRID).select(
        "scene_id", "tile_row", "tile_col", "east_min", "east_max", "north_min", "north_max")


def inverse_views(points: str) -> str:
    """SQL stages of the inverse projection; ``points`` yields rows with e, n."""
    k = repr(geodesy.SCALE * geodesy.RECTIFYING)
    xp = "xi" + "".join(f" - {b!r} * sin({2*i}*xi) * cosh({2*i}*eta)" for i, b in enumerate(geodesy.BETA, 1))
    ep = "eta" + "".join(f" - {b!r} * cos({2*i}*xi) * sinh({2*i}*eta)" for i, b in enumerate(geodesy.BETA, 1))
    lat = "chi" + "".join(f" + {d!r} * sin({2*i}*chi)" for i, d in enumerate(geodesy.DELTA, 1))
    return (
        f"g0 as ({points}), g1 as (select *, n / {k} as xi, (e - 5e5) / {k} as eta from g0), "
        f"g2 as (select *, {xp} as xp, {ep} as ep from g1), "
        "g3 as (select *, asin(sin(xp) / cosh(ep)) as chi, atan2(sinh(ep), cos(xp)) as dl from g2), "
        f"located as (select *, degrees({lat}) as lat, 9e0 + degrees(dl) as lon from g3)"
    )


TILE_CORNERS = (
    "select scene_id, tile_row, tile_col, cast(oe + (tile_col + dx.range)*150 as double) as e, "
    f"cast(orn - (tile_row + dy.range)*150 as double) as n from (select *, {_origin} from tgrid) cross join range(2) dx cross join range(2) dy"
)
BOX_VIEWS = inverse_views(TILE_CORNERS) + (
    ", boxes as (select scene_id, tile_row, tile_col, min(lat) as min_latitude, min(lon) as min_longitude, "
    "max(lat) as max_latitude, max(lon) as max_longitude from located group by all)"
)


@query("tile_bbox", X.sql(
    "select scene_id, tile_row, tile_col, " + ", ".join(
        f"round({c}, 8) as {c}" for c in ("min_latitude", "min_longitude", "max_latitude", "max_longitude")) + " from boxes",
    BOX_VIEWS))
def tile_bbox(spark, sf):
    """Four projected corners of each tile, rounded to 8 decimals for the check."""
    tiles = G.tile_grid(X.scenes(spark, sf).select("scene_id", "epsg", "origin_e", "origin_n"), X.GRID)
    box = ("min_latitude", "min_longitude", "max_latitude", "max_longitude")
    return G.tile_bbox(tiles, X.GRID).select(
        "scene_id", "tile_row", "tile_col", *[F.round(c, 8).alias(c) for c in box])


_PIXEL_CORNERS = (
    f"select scene_id, y, x, cast(oe + x*60 as double) as e, cast(orn - y*60 as double) as n from (select scene_id, y, x, {_origin} from px60)")


@query("utm_to_wgs84", X.sql(
    "select scene_id, y, x, round(lat, 8) as lat, round(lon, 8) as lon from located", inverse_views(_PIXEL_CORNERS)))
def utm_to_wgs84(spark, sf):
    px = X.with_geocoding(X.px60(spark, sf).select(*KEY))
    east, north = geodesy.pixel_to_map(F.col("origin_e"), F.col("origin_n"), F.col("y"), F.col("x"), 60)
    located = geodesy.with_lonlat(px.withColumns({"e": east, "n": north}), [("e", "n", "lat", "lon")])
    return located.select(*KEY, F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"))


@query("wgs84_to_utm", X.sql(
    "select scene_id, y, x, round(e, 4) as easting, round(n, 4) as northing from g0", inverse_views(_PIXEL_CORNERS)))
def wgs84_to_utm(spark, sf):
    """Pixel corners to degrees and back; the oracle is the affine grid itself."""
    px = X.with_geocoding(X.px60(spark, sf).select(*KEY))
    east, north = geodesy.pixel_to_map(F.col("origin_e"), F.col("origin_n"), F.col("y"), F.col("x"), 60)
    located = geodesy.with_lonlat(px.withColumns({"e": east, "n": north}), [("e", "n", "lat", "lon")])
    back = geodesy.with_utm(located, [("lat", "lon", "e2", "n2")])
    return back.select(*KEY, F.round("e2", 4).alias("easting"), F.round("n2", 4).alias("northing"))


@query("round_coords", X.sql(
    "select scene_id, y, x, cast(round_even(lat * 1e6, 0) as bigint) as lat_micro, cast(round_even(lon * 1e6, 0) as bigint) as lon_micro from located",
    inverse_views(_PIXEL_CORNERS)))
def round_coords(spark, sf):
    """Six-decimal coordinates, as whole micro-degrees."""
    px = X.with_geocoding(X.px60(spark, sf).select(*KEY))
    east, north = geodesy.pixel_to_map(F.col("origin_e"), F.col("origin_n"), F.col("y"), F.col("x"), 60)
    located = geodesy.with_lonlat(px.withColumns({"e": east, "n": north}), [("e", "n", "lat", "lon")])
    micro = lambda c: F.rint(geodesy.round_coord(F.col(c), 6) * 1e6).cast("bigint")
    return located.select(*KEY, micro("lat").alias("lat_micro"), micro("lon").alias("lon_micro"))
