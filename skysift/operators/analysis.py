"""Class statistics, medians, agreement counts and radiometric probes.

Means are taken from integer sums, so results do not depend on merge order.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import cos, radians, sin, tan

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysift.constants import PROB_SCALE, SceneGrid
from skysift.functions import radiometry as R
from skysift.functions import tilemath as M
from skysift.operators.grid import assign_tile, block_keys, idiv
from skysift.operators.neighborhood import mask_outline
from skysift.operators.resample import overlap_weighted

VISIBLE = ("b02", "b03", "b04")


def _count(flag: Column) -> Column:
    return F.sum(flag.cast("int"))


def mean_reflectance(total: Column, n: Column, offset: float, quantification: float) -> Column:
    """Mean reflectance behind an integer DN sum; NULL where nothing is counted."""
    return F.when(n > 0, (total / n + F.lit(offset)) / F.lit(quantification))


def class_shares(px: DataFrame, classes: Sequence[str], union: Column, keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Percentage of each class and of their cloud union."""
    n = F.count(F.lit(1))
    return px.groupBy(*keys).agg(
        *[(F.lit(100.0) * _count(F.col(c)) / n).alias(c) for c in classes],
        (F.lit(100.0) * _count(union) / n).alias("total"),
    )


def class_mean_brightness(px: DataFrame, offset: float, quantification: float) -> DataFrame:
    """Mean visible reflectance inside opaque and cirrus, and whether the order is right."""
    visible = F.col("b02") + F.col("b03") + F.col("b04")
    sums = px.groupBy("scene_id").agg(
        *[F.sum(F.when(F.col(c), visible)).alias(f"{c}_sum") for c in ("opaque", "cirrus")],
        *[_count(F.col(c)).alias(f"{c}_n") for c in ("opaque", "cirrus")],
    )
    mean = {c: mean_reflectance(F.col(f"{c}_sum"), F.col(f"{c}_n") * 3, offset, quantification) for c in ("opaque", "cirrus")}
    return sums.select(
        "scene_id", mean["opaque"].alias("opaque_mean"), mean["cirrus"].alias("cirrus_mean"),
        F.coalesce(mean["opaque"] > mean["cirrus"], F.lit(True)).alias("ok"),
    )


def confusion_counts(px: DataFrame, predicted: str, reference: str, keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """TP/FP/FN/TN of two boolean columns."""
    p, r = F.col(predicted), F.col(reference)
    return px.groupBy(*keys).agg(
        _count(p & r).alias("tp"), _count(p & ~r).alias("fp"), _count(~p & r).alias("fn"), _count(~p & ~r).alias("tn"))


def with_scores(counts: DataFrame) -> DataFrame:
    return counts.withColumns(M.agreement_scores(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")))


def layer_area(px: DataFrame, classes: Sequence[str], metres: int) -> DataFrame:
    """Mask area in square metres per scene and class."""
    counts = px.groupBy("scene_id").agg(*[_count(F.col(c)).alias(c) for c in classes])
    pairs = F.array(*[F.struct(F.lit(c).alias("class"), (F.col(c).cast("double") * metres * metres).alias("area_m2")) for c in classes])
    return counts.select("scene_id", F.inline(pairs))


def bbox_union(boxes: DataFrame) -> DataFrame:
    """Union of the tile boxes of each scene."""
    return boxes.groupBy("scene_id").agg(
        F.min("min_latitude").alias("min_latitude"), F.min("min_longitude").alias("min_longitude"),
        F.max("max_latitude").alias("max_latitude"), F.max("max_longitude").alias("max_longitude"))


def footprint_bbox(footprint: Column) -> dict[str, Column]:
    """Box of an array of (lat, lon) structs."""
    lats = F.transform(footprint, lambda p: p["lat"])
    lons = F.transform(footprint, lambda p: p["lon"])
    return {
        "min_latitude": F.array_min(lats), "min_longitude": F.array_min(lons),
        "max_latitude": F.array_max(lats), "max_longitude": F.array_max(lons),
    }


def exact_median(px: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Exact medians of integer columns.

    The aggregate keeps value counts, whose number is bounded by the DN range,
    and is combined before the shuffle.
    """
    return px.groupBy(*keys).agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in columns])


def class_spectra(px: DataFrame, label: str, offset: float, quantification: float) -> DataFrame:
    """Mean green, mean SWIR and mean NDSI per surface class."""
    slope = R.ndsi(R.reflectance(F.col("b03"), offset, quantification), R.reflectance(F.col("b11"), offset, quantification))
    sums = px.groupBy(label).agg(
        F.count(F.lit(1)).alias("pixels"), F.sum("b03").alias("s03"), F.sum("b11").alias("s11"),
        F.sum(R.fixed24(slope)).alias("sn"))
    n = F.col("pixels")
    return sums.select(
        label, "pixels",
        mean_reflectance(F.col("s03"), n, offset, quantification).alias("mean_b03"),
        mean_reflectance(F.col("s11"), n, offset, quantification).alias("mean_b11"),
        (F.col("sn") / n / F.lit(float(PROB_SCALE))).alias("mean_ndsi"),
    )


def cirrus_floor(px: DataFrame, grid: SceneGrid, scale: int, offset: float, quantification: float) -> DataFrame:
    """Mean cirrus-band reflectance per tile and its ratio to the scene's lowest tile."""
    extra = block_keys(px)
    sums = (
        overlap_weighted(px, grid, scale)
        .groupBy("scene_id", *extra, "tile_row", "tile_col")
        .agg(F.sum(F.col("weight") * F.col("b10")).alias("s"), F.sum("weight").alias("w"))
    )
    means = sums.select(
        "scene_id", "tile_row", "tile_col", mean_reflectance(F.col("s"), F.col("w"), offset, quantification).alias("mean_b10"))
    floor = F.min("mean_b10").over(Window.partitionBy("scene_id"))
    return means.withColumn("floor", floor).withColumn("ratio", F.try_divide("mean_b10", "floor"))


def cohort_medians(px: DataFrame, model: str, reference: str, offset: float, quantification: float) -> DataFrame:
    """Median brightness and cirrus-band reflectance of model-only, reference and clear pixels."""
    cohort = F.when(F.col(reference), "reference").when(F.col(model), "model_only").otherwise("clear")
    visible = F.col("b02") + F.col("b03") + F.col("b04")
    med = exact_median(px.select(cohort.alias("cohort"), visible.alias("v"), "b10"), ["v", "b10"], ["cohort"])
    return med.select(
        "cohort",
        ((F.col("v") / F.lit(3.0) + F.lit(offset)) / F.lit(quantification)).alias("brightness"),
        ((F.col("b10") + F.lit(offset)) / F.lit(quantification)).alias("b10"),
    )


def marginal_recall(px: DataFrame, white: Column, high: Column, reference: Column, cirrus_class: Column,
                    keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """What the cirrus test adds to the bright-and-white test."""
    missed = reference & ~white
    sums = px.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        _count(high & cirrus_class).alias("tp"), _count(high & ~cirrus_class).alias("fp"), _count(~high & cirrus_class).alias("fn"),
        _count(missed).alias("missed"), _count(missed & high).alias("recovered"), _count(~reference & ~white & high).alias("new_fp"),
    )
    scores = M.agreement_scores(F.col("tp"), F.col("fp"), F.col("fn"), F.lit(0))
    return sums.select(
        *keys, scores["f1"].alias("cirrus_f1"), M.ratio(F.col("recovered"), F.col("missed")).alias("recovered_share"),
        M.ratio(F.col("new_fp"), F.col("n")).alias("new_false_share"),
    )


def resolution_agreement(
    fine: DataFrame, grid: SceneGrid, factor: int, t_bright: float, offset: float, quantification: float, edge: int = 183,
) -> DataFrame:
    """Brightness rule on 10 m pixels against the same rule on block means.

    Everything but the outline of the coarse mask stays inside the block.
    """
    bright = R.brightness(*[R.reflectance(F.col(b), offset, quantification) for b in VISIBLE]) > R.f32(t_bright)
    extra = block_keys(fine)
    cell = ["scene_id", *extra, "cy", "cx"]
    parts = (
        assign_tile(fine, grid)
        .groupBy(*cell[:-2], idiv(F.col("y"), factor).alias("cy"), idiv(F.col("x"), factor).alias("cx"), "tile_row", "tile_col")
        .agg(F.count(F.lit(1)).alias("w"), _count(bright).alias("hot"), *[F.sum(b).alias(b) for b in VISIBLE])
    )
    whole = Window.partitionBy(*cell)
    means = [R.reflectance(F.sum(b).over(whole) / F.lit(float(factor * factor)), offset, quantification) for b in VISIBLE]
    cells = parts.withColumns({
        "coarse": R.brightness(*means) > R.f32(t_bright),
        "cell_hot": F.sum("hot").over(whole),
    })
    per_tile = cells.groupBy("scene_id", *extra, "tile_row", "tile_col").agg(
        F.sum("w").alias("pixels"), F.sum("hot").alias("fine_n"),
        F.sum(F.when(F.col("coarse"), F.col("w")).otherwise(0)).alias("coarse_n"),
        F.sum(F.when(F.col("coarse"), F.col("hot")).otherwise(F.col("w") - F.col("hot"))).alias("same"),
    )
    gap = F.abs(F.col("fine_n") - F.col("coarse_n"))
    flips = M.within_cut(F.col("fine_n"), grid.tile_pixels) != M.within_cut(F.col("coarse_n"), grid.tile_pixels)
    by_tile = per_tile.groupBy("scene_id").agg(
        (F.lit(100.0) * F.sum("same") / F.sum("pixels")).alias("agreement_percent"),
        (F.lit(100.0) * F.sum(gap) / (F.count(F.lit(1)) * grid.tile_pixels)).alias("mean_gap"),
        (F.lit(100.0) * F.max(gap) / F.lit(grid.tile_pixels)).alias("max_gap"),
        _count(flips).alias("flips"),
    )
    one = cells.groupBy(*cell).agg(F.max("coarse").alias("coarse"), F.max("cell_hot").alias("cell_hot"))
    mixed = (F.col("cell_hot") > 0) & (F.col("cell_hot") < factor * factor)
    cell_px = one.select("scene_id", F.col("cy").alias("y"), F.col("cx").alias("x"), "coarse", mixed.alias("mixed"))
    h, w = grid.height // factor, grid.width // factor
    outline = mask_outline(cell_px, "coarse", (h, w), edge).select("scene_id", "y", "x", "outline")
    by_edge = cell_px.join(outline, ["scene_id", "y", "x"]).groupBy("scene_id").agg(
        _count(F.col("outline")).alias("edge_cells"), _count(F.col("outline") & F.col("mixed")).alias("mixed_edge_cells"))
    return by_tile.join(by_edge, "scene_id")


def shadow_offsets(zenith: float, azimuth: float, heights: Sequence[float], metres: int) -> list[tuple[float, int, int]]:
    """(height, dy, dx) in pixels: a shadow falls away from the sun."""
    out = []
    for h in heights:
        reach = h * tan(radians(zenith))
        away = radians(azimuth + 180.0)
        out.append((float(h), round(-reach * cos(away) / metres), round(reach * sin(away) / metres)))
    return out


def shadow_probe(
    px: DataFrame, cloud: str, zenith: float, azimuth: float, heights: Sequence[float], metres: int,
    offset: float, quantification: float,
) -> DataFrame:
    """Brightness under the displaced cloud mask against clear ground, per assumed height.

    Cloud pixels are displaced once per height and meet the pixel table in an
    equi-join; a displacement is one-to-one, so no key repeats within a height.
    """
    visible = F.col("b02") + F.col("b03") + F.col("b04")
    moves = shadow_offsets(zenith, azimuth, heights, metres)
    shifts = F.array(*[F.struct(F.lit(h).alias("height"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for h, dy, dx in moves])
    cast_on = px.filter(cloud).select("scene_id", "y", "x", F.inline(shifts)).select(
        "scene_id", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"), "height")
    open_px = px.filter(~F.col(cloud)).select("scene_id", "y", "x", visible.alias("v"))
    shaded = open_px.join(cast_on, ["scene_id", "y", "x"]).groupBy("height").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
    clear = open_px.groupBy().agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s")).select(F.lit(None).cast("double").alias("height"), "n", "s")
    return shaded.select("height", "n", "s").unionByName(clear).select(
        F.coalesce("height", F.lit(-1.0)).alias("height"), F.col("n").alias("pixels"),
        mean_reflectance(F.col("s"), F.col("n") * 3, offset, quantification).alias("mean_brightness"))


def dark_shares(px: DataFrame, cloud: Column, water: Column, bright: Column, limits: Sequence[float]) -> DataFrame:
    """Share of the scene that is dark, neither cloud nor water, at several limits."""
    n = F.count(F.lit(1))
    return px.groupBy("scene_id").agg(*[
        (F.lit(100.0) * _count(~cloud & ~water & (bright < R.f32(t))) / n).alias(f"below_{int(round(t * 100)):03d}") for t in limits
    ])


def rgb_fidelity(left: DataFrame, right: DataFrame, grid: SceneGrid) -> DataFrame:
    """Mean absolute difference and worst channel-mean gap of two RGB tables, per tile.

    Pixels meet in a merge join: chips unpack to hundreds of times the rows that their
    file size stands for, so a size check would send them whole through the driver.
    """
    keys = ["scene_id", *[k for k in block_keys(left) if k in right.columns], "y", "x"]
    pair = left.select(*keys, "r", "g", "b").hint("merge").join(
        right.select(*keys, *[F.col(c).alias(f"{c}2") for c in "rgb"]), keys)
    sums = assign_tile(pair, grid).groupBy(*keys[:-2], "tile_row", "tile_col").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.abs(F.col(c) - F.col(f"{c}2"))).alias(f"a{c}") for c in "rgb"],
        *[F.sum(F.col(c) - F.col(f"{c}2")).alias(f"d{c}") for c in "rgb"],
    )
    return sums.select(
        "scene_id", "tile_row", "tile_col",
        ((F.col("ar") + F.col("ag") + F.col("ab")) / (F.col("n") * 3)).alias("mean_abs_diff"),
        (F.greatest(F.abs("dr"), F.abs("dg"), F.abs("db")) / F.col("n")).alias("channel_gap"),
    )
