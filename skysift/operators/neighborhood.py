"""Disk neighbourhoods on masks and probability maps.

A halo exchange (one shuffle) makes every neighbourhood local to a block; the
disk is then a row window per distinct half-width followed by a column window,
both inside the block.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysift.constants import PROB_SCALE
from skysift.operators.grid import with_halo


def half_widths(radius: int) -> dict[int, int]:
    """Row offset -> half-width of the disk dx^2 + dy^2 <= r^2."""
    return {dy: isqrt(radius * radius - dy * dy) for dy in range(-radius, radius + 1)}


def disk_size(radius: int) -> int:
    return sum(2 * w + 1 for w in half_widths(radius).values())


Spec = tuple[str, int, str]


def disk_reduce(halo: DataFrame, specs: Sequence[Spec], how: str, keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Sum or maximum over disks, for a table that carries its halo.

    ``specs`` are (column, radius, new column); all of them share one sort by row
    and one by column. Missing pixels count as nothing. Right for pixels at
    least the radius away from the edge of the halo.
    """
    block = [*keys, "hrow", "hcol"]
    along_x = Window.partitionBy(*block, "y").orderBy("x")
    along_y = Window.partitionBy(*block, "x").orderBy("y")
    reduce = {"sum": F.sum, "max": F.max}[how]
    needed = {(c, w) for c, r, _ in specs for w in half_widths(r).values()}
    rows = halo.withColumns({
        f"_{c}_{w}": reduce(c).over(along_x.rangeBetween(-w, w)) if w else F.col(c) for c, w in sorted(needed)
    })

    def combine(c: str, radius: int) -> Column:
        shifted = [
            F.max(f"_{c}_{w}").over(along_y.rangeBetween(dy, dy)) if dy else F.col(f"_{c}_{w}") for dy, w in half_widths(radius).items()]
        if how == "max":
            return F.greatest(*shifted)
        total = F.lit(0)
        for s in shifted:
            total = total + F.coalesce(s, F.lit(0))
        return total

    outs = {name for _, _, name in specs}
    kept = [c for c in halo.columns if c not in outs]
    return rows.select(*kept, *[combine(c, r).alias(n) for c, r, n in specs])


def disk_average(
    px: DataFrame, code: str, radius: int, shape: tuple[int, int], edge: int = 183,
) -> DataFrame:
    """Mean of a 24-bit probability code over a disk, mirrored at the border."""
    halo = with_halo(px.select("scene_id", "y", "x", code), shape, radius, reflect=True, edge=edge)
    out = disk_reduce(halo, [(code, radius, code)], "sum").filter("inner")
    mean = F.col(code) / F.lit(float(disk_size(radius) * PROB_SCALE))
    return out.select("scene_id", "y", "x", mean.alias("prob"))


def disk_dilate(px: DataFrame, flag: str, radius: int, shape: tuple[int, int], edge: int = 183) -> DataFrame:
    """True where any pixel under the disk is true; outside the scene is false."""
    halo = with_halo(px.select("scene_id", "y", "x", F.col(flag).cast("int").alias(flag)), shape, radius, edge=edge)
    out = disk_reduce(halo, [(flag, radius, flag)], "max").filter("inner")
    return out.select("scene_id", "y", "x", (F.col(flag) > 0).alias(flag))


def mask_outline(px: DataFrame, flag: str, shape: tuple[int, int], edge: int = 183) -> DataFrame:
    """Mask pixels with at least one 4-neighbour outside the mask or the raster."""
    one = F.col(flag).cast("int")
    halo = with_halo(px.select("scene_id", "y", "x", one.alias(flag)), shape, 1, edge=edge)
    out = disk_reduce(halo, [(flag, 1, "_around")], "sum").filter("inner")
    on_edge = (F.col(flag) == 1) & (F.col("_around") < 5)
    return out.select("scene_id", "y", "x", (F.col(flag) == 1).alias(flag), on_edge.alias("outline"))


def prob_morph_mask(
    px: DataFrame, code: str, threshold: float, average_over: int | None, dilation_size: int | None,
    shape: tuple[int, int], edge: int = 183,
) -> DataFrame:
    """Average, threshold, dilate; each step is skipped when its size is off.

    One halo wide enough for both steps replaces two exchanges.
    """
    avg, dil = average_over or 0, dilation_size or 0
    halo = with_halo(px.select("scene_id", "y", "x", F.col(code).alias("v")), shape, avg + dil, reflect=avg > 0, edge=edge)
    fields = averaged_fields(halo, [avg], shape)
    cut = F.lit(float(threshold)) * F.lit(float(PROB_SCALE * disk_size(avg)))
    flags = fields.withColumn("cloud", (F.col(f"avg{avg}").cast("double") > cut).cast("int"))
    if dil:
        flags = disk_reduce(flags, [("cloud", dil, "cloud")], "max")
    return flags.filter("inner").select("scene_id", "y", "x", (F.col("cloud") > 0).alias("cloud"))


def averaged_fields(halo: DataFrame, radii: Sequence[int], shape: tuple[int, int]) -> DataFrame:
    """Disk sums of ``v`` for several radii as avg0, avg1, ...; padding removed."""
    out = halo.withColumn("avg0", F.col("v"))
    if any(radii):
        out = disk_reduce(out, [("v", r, f"avg{r}") for r in radii if r], "sum")
    return out.filter(F.col("y").between(0, shape[0] - 1) & F.col("x").between(0, shape[1] - 1))
