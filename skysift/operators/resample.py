"""Moving between the 10, 20 and 60 m grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysift.constants import SceneGrid
from skysift.operators.grid import block_keys, idiv, with_halo


def block_sums(px: DataFrame, columns: Sequence[str], factor: int) -> DataFrame:
    """Integer sums over factor x factor blocks; a ragged block is an error."""
    keys = ["scene_id", *block_keys(px)]
    sums = (
        px.groupBy(*keys, idiv(F.col("y"), factor).alias("y"), idiv(F.col("x"), factor).alias("x"))
        .agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(c) for c in columns])
    )
    full = F.col("_n") == factor * factor
    return sums.select(
        *keys, "y", "x",
        *[F.when(full, F.col(c)).otherwise(F.raise_error(F.lit("ragged block")).cast("bigint")).alias(c) for c in columns],
    )


def block_mean(px: DataFrame, columns: Sequence[str], factor: int) -> DataFrame:
    """Exact block mean of DN columns: sum the integers, divide once."""
    sums = block_sums(px, columns, factor)
    kept = [c for c in sums.columns if c not in columns]
    return sums.select(*kept, *[(F.col(c) / F.lit(float(factor * factor))).alias(c) for c in columns])


def upsample_nearest(px: DataFrame, factor: int) -> DataFrame:
    """Repeat each pixel factor x factor times."""
    cell = F.explode(F.sequence(F.lit(0), F.lit(factor * factor - 1))).alias("_cell")
    rest = [c for c in px.columns if c not in ("y", "x")]
    return px.select(*rest, "y", "x", cell).select(
        *rest,
        (F.col("y") * factor + idiv(F.col("_cell"), factor)).alias("y"),
        (F.col("x") * factor + F.col("_cell") % factor).alias("x"),
    )


def with_cell(px: DataFrame, factor: int) -> DataFrame:
    """Key of the coarse pixel that holds each fine pixel."""
    return px.withColumns({"cy": idiv(F.col("y"), factor), "cx": idiv(F.col("x"), factor)})


def multires_join(fine: DataFrame, coarse: DataFrame, factor: int, columns: Sequence[str]) -> DataFrame:
    """Put coarse columns on the fine grid: equi-join on the enclosing pixel.

    Tables placed by block join inside their partition, without an exchange; the
    join itself is left to the planner, so either side may spill.
    """
    keys = ["scene_id", *[k for k in block_keys(fine) if k in coarse.columns]]
    right = coarse.select(*keys, F.col("y").alias("cy"), F.col("x").alias("cx"), *columns)
    return with_cell(fine, factor).join(right, [*keys, "cy", "cx"]).drop("cy", "cx")


def regrid_fine(coarse: DataFrame, factor: int, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Coarse band on the 10 m grid, optionally for (y0, y1, x0, x1) on that grid.

    The window need not fall on coarse pixel edges; the coarse rows outside it
    are filtered before they are repeated.
    """
    if window is None:
        return upsample_nearest(coarse, factor)
    y0, y1, x0, x1 = window
    reach = (
        F.col("y").between(y0 // factor, (y1 - 1) // factor)
        & F.col("x").between(x0 // factor, (x1 - 1) // factor)
    )
    return upsample_nearest(coarse.filter(reach), factor).filter(
        (F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1)
    )


def resize_linear(px: DataFrame, column: str, factor: int, shape: tuple[int, int], edge: int = 183) -> DataFrame:
    """Bilinear enlargement with half-pixel centres and a replicated border.

    Weights are multiples of 1/(2 factor), so integer input is summed exactly
    and divided once. One halo exchange brings the eight neighbours together.
    """
    halo = with_halo(px.select("scene_id", "y", "x", F.col(column).alias("v")), shape, 1, edge=edge)
    block = ["scene_id", "hrow", "hcol"]
    along_x = Window.partitionBy(*block, "y").orderBy("x")
    along_y = Window.partitionBy(*block, "x").orderBy("y")
    across = halo.select(
        *block, "y", "x", "inner",
        F.array(
            F.coalesce(F.lag("v").over(along_x), F.col("v")), F.col("v"),
            F.coalesce(F.lead("v").over(along_x), F.col("v")),
        ).alias("mid"),
    )
    around = across.select(
        "scene_id", "y", "x", "inner", "mid",
        F.coalesce(F.lag("mid").over(along_y), F.col("mid")).alias("up"),
        F.coalesce(F.lead("mid").over(along_y), F.col("mid")).alias("down"),
    ).filter("inner")
    cell = F.explode(F.sequence(F.lit(0), F.lit(factor * factor - 1))).alias("_cell")
    fine = around.select("scene_id", "y", "x", "up", "mid", "down", cell)
    # Signed distance from the centre of the source pixel, in half steps.
    dy = F.lit(2) * idiv(F.col("_cell"), factor) + 1 - factor
    dx = F.lit(2) * (F.col("_cell") % factor) + 1 - factor
    fine = fine.withColumns({"dy": dy, "dx": dx})
    whole = 2 * factor

    def mix(row: Column) -> Column:
        side = F.when(F.col("dx") < 0, row[0]).otherwise(row[2])
        return (F.lit(whole) - F.abs("dx")) * row[1] + F.abs("dx") * side

    other = F.when(F.col("dy") < 0, F.col("up")).otherwise(F.col("down"))
    total = (F.lit(whole) - F.abs("dy")) * mix(F.col("mid")) + F.abs("dy") * mix(other)
    return fine.select(
        "scene_id",
        (F.col("y") * factor + idiv(F.col("_cell"), factor)).alias("y"),
        (F.col("x") * factor + F.col("_cell") % factor).alias("x"),
        (total / F.lit(float(whole * whole))).alias(column),
    )


def majority_downsample(px: DataFrame, flag: str, factor: int) -> DataFrame:
    """Coarse mask, true where more than half of the fine pixels are."""
    sums = block_sums(px.withColumn(flag, F.col(flag).cast("int")), [flag], factor)
    return sums.withColumn(flag, F.col(flag) * 2 > factor * factor)


def rgb_thumbnail(px: DataFrame, factor: int, channels: Sequence[str] = ("r", "g", "b")) -> DataFrame:
    """Reduced RGB: block mean, truncated to a byte."""
    means = block_mean(px, channels, factor)
    return means.withColumns({c: F.col(c).cast("int") for c in channels})


def overlap_parts(grid: SceneGrid, scale: int) -> Column:
    """Tiles a coarse pixel touches, with the number of fine pixels in each.

    At most two per axis, since a tile is larger than a coarse pixel.
    """
    t = grid.tile_px

    def axis(pos: Column, tiles: int) -> Column:
        first = idiv(pos * scale, t)
        inside = F.least(F.lit(scale), (first + 1) * t - pos * scale)
        both = F.array(
            F.struct(first.alias("tile"), inside.alias("w")),
            F.struct((first + 1).alias("tile"), (F.lit(scale) - inside).alias("w")),
        )
        return F.filter(both, lambda s: (s["w"] > 0) & (s["tile"] < tiles))

    rows, cols = axis(F.col("y"), grid.rows), axis(F.col("x"), grid.cols)
    return F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: F.struct(
        r["tile"].alias("tile_row"), c["tile"].alias("tile_col"), (r["w"] * c["w"]).alias("weight")))))


def overlap_weighted(px: DataFrame, grid: SceneGrid, scale: int) -> DataFrame:
    """Coarse pixels with one row per touched tile and its overlap weight.

    Replaces enlarging a coarse mask by scale x scale and cutting it.
    """
    return px.select("*", F.inline(overlap_parts(grid, scale)))


def overlap_tile_counts(px: DataFrame, grid: SceneGrid, scale: int, flags: Sequence[str]) -> DataFrame:
    """Fine pixels per tile under each coarse boolean flag."""
    weighted = overlap_weighted(px, grid, scale)
    extra = block_keys(px)
    return (
        weighted.groupBy("scene_id", *extra, "tile_row", "tile_col")
        .agg(
            F.sum("weight").alias("pixels"),
            *[F.sum(F.when(F.col(f), F.col("weight")).otherwise(0)).alias(f) for f in flags],
        )
        .drop(*extra)
    )


def rounded_tile(pos: Column, size: float) -> Column:
    """Tile of a coarse position when tile edges are rounded half to even."""
    near = F.floor(pos / F.lit(size))
    return (
        F.when(pos >= F.rint((near + 1) * F.lit(size)), near + 1)
        .when(pos < F.rint(near * F.lit(size)), near - 1)
        .otherwise(near).cast("int")
    )


def rounded_edge_tiles(px: DataFrame, grid: SceneGrid, scale: int, flag: str) -> DataFrame:
    """Approximate tile share on the coarse grid, with half-even rounded edges.

    Kept apart from the exact cut: the verdict is a float test, > 30.0.
    """
    size = grid.tile_px / scale
    share = F.lit(100.0) * F.sum(F.col(flag).cast("int")) / F.count(F.lit(1))
    return (
        px.groupBy("scene_id", rounded_tile(F.col("y"), size).alias("tile_row"), rounded_tile(F.col("x"), size).alias("tile_col"))
        .agg(F.count(F.lit(1)).alias("cells"), share.alias("percent"))
        .withColumn("invalid", F.col("percent") > 30.0)
    )
