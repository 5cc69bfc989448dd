"""Parameter sweeps by histogram: pixels are read once, never crossed with settings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysift.constants import PROB_SCALE, SceneGrid
from skysift.functions import radiometry as R
from skysift.functions import tilemath as M
from skysift.operators.grid import block_keys, with_halo
from skysift.operators.neighborhood import averaged_fields, disk_reduce, disk_size
from skysift.operators.resample import overlap_weighted, rounded_tile

# The swept grids. NULL stands for a disabled test.
BRIGHT_GRID = [i / 100 for i in range(10, 41)]
NDSI_GRID = [i / 100 for i in range(-40, -9, 2)]
CIRRUS_GRID = [i / 10000 for i in range(20, 121, 5)]
PROB_GRID = [i / 100 for i in range(30, 96, 5)]
AVERAGE_GRID = (0, 1, 2, 4)
DILATION_GRID = (0, 1, 2)
# Best F1 of each rule family on the original scene.
EXPECTED_F1 = {"brightness_only": 0.71, "plus_ndsi": 0.72, "plus_cirrus": 0.72, "all_three": 0.72}


def _steps(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n)))


def _pick(index: Column, values: Sequence[float]) -> Column:
    """values[index - 1]; NULL outside."""
    return F.get(F.array(*[F.lit(float(v)) for v in values]), index - 1)


def threshold_sweep(
    px: DataFrame, bright: Column, slope: Column, r10: Column, reference: Column,
    bright_grid: Sequence[float] = BRIGHT_GRID, ndsi_grid: Sequence[float] = NDSI_GRID, cirrus_grid: Sequence[float] = CIRRUS_GRID,
) -> DataFrame:
    """Scores of every (t_bright, t_ndsi | off, t_cirrus | off) setting.

    The rule is monotone in each threshold, so a pixel is described by how many
    thresholds it exceeds on each axis. One map-side combined group-by leaves at
    most (nb+1)(nn+1)(nc+1) cells whatever the number of pixels; suffix sums over
    the three axes then give N(bright & white), N(cirrus) and their overlap.
    """
    nb, nn, nc = len(bright_grid), len(ndsi_grid), len(cirrus_grid)
    hist = (
        px.select(bright.alias("bright"), slope.alias("slope"), r10.alias("r10"), reference.alias("ref"))
        .select(
            R.exceeded(F.col("bright"), bright_grid).alias("b"), R.exceeded(F.col("slope"), ndsi_grid).alias("n"),
            R.exceeded(F.col("r10"), cirrus_grid).alias("c"), "ref")
        .groupBy("b", "n", "c")
        .agg(F.count_if("ref").alias("pos"), F.count_if(~F.col("ref")).alias("neg"))
    )
    # c = nc + 1 is never reached: the cirrus test switched off.
    cube = (
        px.sparkSession.range(1).select(_steps(nb).alias("b")).select("b", _steps(nn).alias("n"))
        .select("b", "n", _steps(nc + 1).alias("c"))
        .join(hist, ["b", "n", "c"], "left").fillna(0, ["pos", "neg"])
    )
    for axis, others in (("b", ["n", "c"]), ("n", ["b", "c"]), ("c", ["b", "n"])):
        above = Window.partitionBy(*others).orderBy(F.desc(axis)).rowsBetween(Window.unboundedPreceding, 0)
        cube = cube.withColumns({m: F.sum(m).over(above) for m in ("pos", "neg")})
    line = Window.partitionBy("b", "n")
    plane = Window.partitionBy("c")
    corner = (F.col("b") == 0) & (F.col("n") == 0)
    cube = cube.withColumns({f"{m}_white": F.max(m).over(line) for m in ("pos", "neg")})
    cube = cube.withColumns({
        **{f"{m}_high": F.max(F.when(corner, F.col(m))).over(plane) for m in ("pos", "neg")},
        **{f"{m}_all": F.max(F.when(corner, F.col(f"{m}_white"))).over(plane) for m in ("pos", "neg")},
    })
    tp = F.col("pos_white") + F.col("pos_high") - F.col("pos")
    fp = F.col("neg_white") + F.col("neg_high") - F.col("neg")
    counted = cube.filter((F.col("b") > 0) & (F.col("c") > 0)).select(
        _pick(F.col("b"), bright_grid).alias("t_bright"), _pick(F.col("n"), ndsi_grid).alias("t_ndsi"),
        _pick(F.col("c"), cirrus_grid).alias("t_cirrus"),
        tp.alias("tp"), fp.alias("fp"), (F.col("pos_all") - tp).alias("fn"), (F.col("neg_all") - fp).alias("tn"))
    scores = M.agreement_scores(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return counted.select(
        "t_bright", "t_ndsi", "t_cirrus",
        (F.lit(100.0) * (F.col("tp") + F.col("fp")) / total).alias("scene_cloud_percent"),
        *[scores[k].alias(k) for k in ("precision", "recall", "f1", "iou")])


def family(t_ndsi: Column, t_cirrus: Column) -> Column:
    return (
        F.when(t_ndsi.isNull() & t_cirrus.isNull(), "brightness_only").when(t_cirrus.isNull(), "plus_ndsi")
        .when(t_ndsi.isNull(), "plus_cirrus").otherwise("all_three")
    )


def best_per_ablation(sweep: DataFrame) -> DataFrame:
    """Best F1 of each rule family; the first setting in generating order wins a tie."""
    order = Window.partitionBy("family").orderBy(F.desc("f1"), "t_bright", "t_ndsi", "t_cirrus")
    ranked = sweep.withColumn("family", family(F.col("t_ndsi"), F.col("t_cirrus"))).withColumn("_rank", F.row_number().over(order))
    return ranked.filter(F.col("_rank") == 1).drop("_rank")


def optimum_on_edge(best: DataFrame, expected: dict[str, float] = EXPECTED_F1, tolerance: float = 0.02,
                    grids: dict[str, Sequence[float]] | None = None) -> DataFrame:
    """Flags optima on the edge of their swept range, and F1 off the expectation."""
    grids = grids or {"t_bright": BRIGHT_GRID, "t_ndsi": NDSI_GRID, "t_cirrus": CIRRUS_GRID}
    edges = {
        f"{name}_on_edge": F.coalesce(
            (F.abs(F.col(name) - min(g)) < 1e-9) | (F.abs(F.col(name) - max(g)) < 1e-9), F.lit(False))
        for name, g in grids.items()
    }
    want = F.lit(None).cast("double")
    for name, value in expected.items():
        want = F.when(F.col("family") == name, value).otherwise(want)
    return best.select("*", *[c.alias(n) for n, c in edges.items()], (F.abs(F.col("f1") - want) <= tolerance).alias("f1_expected"))


def prob_sweep(
    px: DataFrame, code: str, reference: str, grid: SceneGrid, shape: tuple[int, int], scale: int,
    thresholds: Sequence[float] = PROB_GRID, averages: Sequence[int] = AVERAGE_GRID, dilations: Sequence[int] = DILATION_GRID,
    edge: int = 183,
) -> DataFrame:
    """Scores and discarded tiles over threshold x averaging x dilation.

    Masks at rising thresholds are nested, so dilating each of them equals a
    maximum filter over the index of the highest threshold passed: one filter
    serves all thresholds. All fields come from a single halo exchange.
    """
    radius = max(averages) + max(dilations)
    base = px.select("scene_id", "y", "x", F.col(code).alias("v"), F.col(reference).alias("ref"))
    halo = with_halo(base, shape, radius, reflect=True, edge=edge)
    fields = averaged_fields(halo, averages, shape)

    def passed(a: int) -> Column:
        out = F.lit(0)
        for t in thresholds:
            out = out + (F.col(f"avg{a}").cast("double") > F.lit(float(t)) * F.lit(float(PROB_SCALE * disk_size(a)))).cast("int")
        return out

    binned = fields.select("scene_id", "hrow", "hcol", "y", "x", "inner", "ref", *[passed(a).alias(f"a{a}d0") for a in averages])
    if any(dilations):
        binned = disk_reduce(binned, [(f"a{a}d0", d, f"a{a}d{d}") for a in averages for d in dilations if d], "max")
    variants = F.array(*[
        F.struct(F.lit(a).alias("average_over"), F.lit(d).alias("dilation_size"), F.col(f"a{a}d{d}").alias("bin"))
        for a in averages for d in dilations])
    long = binned.filter("inner").select("scene_id", *_rounded_tile(grid, scale), "ref", F.inline(variants))
    sums = [F.struct(F.lit(float(t)).alias("threshold"), F.count_if(F.col("bin") > i).alias("n"),
                     F.count_if((F.col("bin") > i) & F.col("ref")).alias("tp")) for i, t in enumerate(thresholds)]
    per_tile = long.groupBy("average_over", "dilation_size", "scene_id", "tile_row", "tile_col").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if("ref").alias("pos"), F.array(*sums).alias("at"))
    rows = per_tile.select("average_over", "dilation_size", "cells", "pos", F.inline("at"))
    total = rows.groupBy("threshold", "average_over", "dilation_size").agg(
        F.sum("tp").alias("tp"), F.sum(F.col("n") - F.col("tp")).alias("fp"), F.sum(F.col("pos") - F.col("tp")).alias("fn"),
        F.sum("n").alias("n"), F.sum("cells").alias("cells"),
        F.count_if(F.lit(100.0) * F.col("n") / F.col("cells") > 30.0).alias("invalid_tiles"))
    scores = M.agreement_scores(F.col("tp"), F.col("fp"), F.col("fn"), F.lit(0))
    return total.select(
        "threshold", F.nullif("average_over", F.lit(0)).alias("average_over"), F.nullif("dilation_size", F.lit(0)).alias("dilation_size"),
        (F.lit(100.0) * F.col("n") / F.col("cells")).alias("scene_cloud_percent"), "invalid_tiles",
        *[scores[k].alias(k) for k in ("precision", "recall", "f1", "iou")])


def _rounded_tile(grid: SceneGrid, scale: int) -> tuple[Column, Column]:
    return (rounded_tile(F.col("y"), grid.tile_px / scale).alias("tile_row"),
            rounded_tile(F.col("x"), grid.tile_px / scale).alias("tile_col"))


def prob_curve(px: DataFrame, code: str, grid: SceneGrid, scale: int, steps: int = 100) -> DataFrame:
    """Discarded tiles and scene percentage at thresholds 0, 1/steps, ..., 1.

    Each pixel falls into the bin of thresholds it exceeds; tiles keep one
    weighted histogram each, and gaps between occupied bins are filled from the
    running sum.
    """
    # Thresholds below the code: i * 2^24 < code * steps.
    bin_ = F.least(F.lit(steps + 1), F.ceil(F.col(code) * steps / F.lit(float(PROB_SCALE))).cast("int"))
    extra = block_keys(px)
    hist = (
        overlap_weighted(px.select("scene_id", *extra, "y", "x", bin_.alias("bin")), grid, scale)
        .groupBy("scene_id", *extra, "tile_row", "tile_col", "bin").agg(F.sum("weight").alias("w"))
    )
    tile = Window.partitionBy("scene_id", *extra, "tile_row", "tile_col")
    down = tile.orderBy(F.desc("bin"))
    run = hist.withColumns({
        "count": F.sum("w").over(down.rowsBetween(Window.unboundedPreceding, 0)),
        "lower": F.coalesce(F.lead("bin").over(down), F.lit(0)),
        "top": F.lag("bin").over(down).isNull(),
    })

    def span(lo: Column, hi: Column, count: Column) -> Column:
        steps_ = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
        return F.transform(steps_, lambda i: F.struct(i.alias("i"), count.cast("bigint").alias("n")))

    filled = span(F.col("lower"), F.least(F.col("bin") - 1, F.lit(steps)), F.col("count"))
    above = F.when(F.col("top"), span(F.col("bin"), F.lit(steps), F.lit(0))).otherwise(F.array().cast("array<struct<i:int,n:bigint>>"))
    curve = run.select("scene_id", F.inline(F.concat(filled, above)))
    return curve.groupBy("scene_id", "i").agg(
        F.count_if(F.lit(100) * F.col("n") > F.lit(30 * grid.tile_pixels)).alias("invalid_tiles"),
        (F.lit(100.0) * F.sum("n") / (F.count(F.lit(1)) * grid.tile_pixels)).alias("scene_percent"),
    ).select("scene_id", (F.col("i") / F.lit(float(steps))).alias("threshold"), "invalid_tiles", "scene_percent")


def curve_monotone(curve: DataFrame) -> DataFrame:
    """Per scene: how often the discard count rises with the threshold."""
    order = Window.partitionBy("scene_id").orderBy("threshold")
    rise = F.col("invalid_tiles") > F.lag("invalid_tiles").over(order)
    return curve.withColumn("_rise", rise).groupBy("scene_id").agg(
        F.count(F.lit(1)).alias("points"), F.count_if("_rise").alias("rises"), (F.count_if("_rise") == 0).alias("ok"))


def preset_table(curve: DataFrame, presets: dict[str, float]) -> DataFrame:
    """Curve rows at named thresholds."""
    label = F.lit(None).cast("string")
    for name, t in presets.items():
        label = F.when(F.abs(F.col("threshold") - t) < 1e-9, name).otherwise(label)
    return curve.withColumn("preset", label).filter(F.col("preset").isNotNull())


def sweep_tolerance(sweep: DataFrame, expected: DataFrame, f1_tolerance: float = 0.02, tile_tolerance: int = 10) -> DataFrame:
    """Sweep rows against expected F1 and discard counts at the same setting."""
    joined = expected.join(sweep.select("threshold", "f1", "invalid_tiles"), "threshold", "left")
    f1_gap = F.abs(F.col("f1") - F.col("expected_f1"))
    tile_gap = F.abs(F.col("invalid_tiles") - F.col("expected_invalid"))
    return joined.select(
        "threshold", f1_gap.alias("f1_gap"), tile_gap.alias("tile_gap"),
        F.coalesce(f1_gap <= f1_tolerance, F.lit(False)).alias("f1_ok"), F.coalesce(tile_gap <= tile_tolerance, F.lit(False)).alias("tiles_ok"))


def threshold_sensitivity(
    px: DataFrame, bright: Column, slope: Column, r10: Column, base: dict[str, float], steps: dict[str, float],
    grid: SceneGrid, scale: int,
) -> DataFrame:
    """Tiles whose verdict changes when one threshold moves a step either way."""
    settings = [("base", 0.0, dict(base))]
    for name, step in steps.items():
        for sign in (-1, 1):
            settings.append((name, sign * step, base | {name: round(base[name] + sign * step, 6)}))
    extra = block_keys(px)
    fields = px.select("scene_id", *extra, "y", "x", bright.alias("b"), slope.alias("n"), r10.alias("c"))
    counts = overlap_weighted(fields, grid, scale).groupBy("scene_id", *extra, "tile_row", "tile_col").agg(*[
        F.sum(F.when(R.cloud_rule(F.col("b"), F.col("n"), F.col("c"), **s), F.col("weight")).otherwise(0)).alias(f"s{i}")
        for i, (_, _, s) in enumerate(settings)])
    keep = lambda i: M.within_cut(F.col(f"s{i}"), grid.tile_pixels)
    flips = counts.groupBy("scene_id").agg(*[F.count_if(keep(i) != keep(0)).alias(f"f{i}") for i in range(1, len(settings))])
    rows = F.array(*[F.struct(F.lit(n).alias("parameter"), F.lit(float(d)).alias("step"), F.col(f"f{i}").alias("flips"))
                     for i, (n, d, _) in enumerate(settings) if i])
    return flips.select("scene_id", F.inline(rows))
