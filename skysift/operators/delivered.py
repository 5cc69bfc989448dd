"""Validity of polygons as delivered: vertices in degrees, snapped to pixel corners again.

All rules are local, so no ring is gathered: sums over its vertices, counts at
lattice points for crossings, and parity along a pixel row for holes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skysift.functions import geodesy
from skysift.session import cut_lineage

FEATURE = ("scene_id", "feature")
RING = ("scene_id", "class", "feature", "ring", "hole")
#: Rounded coordinates lie within a hundredth of a pixel of their corner.
SNAP = 0.05


def snapped(lines: DataFrame, metres: int) -> DataFrame:
    """Points of ``scan_geojson`` with their corner (vy, vx) and that of the point before (vy0, vx0).

    ``lines`` carry epsg, origin_e and origin_n. ``off`` marks points that are no corner of the grid.
    """
    points = lines.filter("kind = 'P'").drop("kind", "bad")
    placed = geodesy.with_utm(points, [("lat", "lon", "_e", "_n"), ("lat0", "lon0", "_e0", "_n0")])
    grid = {}
    for end in ("", "0"):
        grid[f"_y{end}"] = (F.col("origin_n") - F.col(f"_n{end}")) / metres
        grid[f"_x{end}"] = (F.col(f"_e{end}") - F.col("origin_e")) / metres
    near = lambda c: F.abs(F.col(c) - F.rint(c)) <= SNAP
    out = placed.withColumns(grid).withColumns({
        **{f"v{a}{e}": F.rint(f"_{a}{e}").cast("int") for a in "yx" for e in ("", "0")},
        "off": ~F.coalesce(near("_y") & near("_x"), F.lit(False)),
        # Twice the area under the side, in square metres as written.
        "cross": (F.col("_x0") * F.col("_y") - F.col("_x") * F.col("_y0")) * metres * metres})
    return out.drop(*grid, "_e", "_n", "_e0", "_n0")


def ring_figures(points: DataFrame) -> DataFrame:
    """One row per ring: sound (closed, on the grid, right-angled), area, first corner, box.

    Sides alternate between the two directions, so those along a row all stand at
    even or all at odd places.
    """
    side = F.col("seq") > 0
    flat, upright = F.col("vy") == F.col("vy0"), F.col("vx") == F.col("vx0")
    corner = F.struct("vy", "vx")
    sums = points.groupBy(*RING).agg(
        F.count_if(side).alias("sides"), F.count_if(side & (flat != upright)).alias("straight"),
        F.count_if(side & (flat == (F.col("seq") % 2 == 0))).alias("even"), F.count_if("off").alias("off"),
        F.min_by(corner, "seq").alias("first"), F.max_by(corner, "seq").alias("last"), F.min(corner).alias("top"),
        (F.abs(F.sum(F.when(side, F.col("cross")))) / 2.0).alias("area_m2"),
        *[f(c).alias(f"{c}_{n}") for c in ("lon", "lat") for n, f in (("min", F.min), ("max", F.max))])
    sound = (
        (F.col("first") == F.col("last")) & (F.col("sides") >= 4) & (F.col("sides") % 2 == 0) & (F.col("off") == 0)
        & (F.col("straight") == F.col("sides")) & F.col("even").isin(F.lit(0).cast("bigint"), F.col("sides")))
    return sums.withColumn("sound", sound).drop("first", "last", "straight", "even", "off")


def _unit_sides(points: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """Sides inside the scene cut into unit steps: from (y0, x0) to (y, x), ``inner`` where the side goes straight on."""
    within = lambda e: F.col(f"vy{e}").between(0, shape[0]) & F.col(f"vx{e}").between(0, shape[1])
    dy, dx = F.col("vy") - F.col("vy0"), F.col("vx") - F.col("vx0")
    sides = points.filter((F.col("seq") > 0) & within("") & within("0") & ((dy == 0) != (dx == 0))).select(
        *FEATURE, "vy0", "vx0", F.signum(dy).cast("int").alias("sy"), F.signum(dx).cast("int").alias("sx"), (F.abs(dy) + F.abs(dx)).alias("long"))
    cut = sides.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("long"))))
    at = lambda v, s, k: F.col(v) + F.col(s) * k
    before = F.col("k") - 1
    return cut.select(
        *FEATURE, "sy", "sx", (F.col("k") < F.col("long")).alias("inner"),
        at("vy0", "sy", before).alias("y0"), at("vx0", "sx", before).alias("x0"), at("vy0", "sy", F.col("k")).alias("y"), at("vx0", "sx", F.col("k")).alias("x"))


def crossings(units: DataFrame) -> DataFrame:
    """(scene_id, crossings): lattice points where the rings of a feature cross or share a side.

    At most four unit sides meet at a point. A point passed twice is sound if both
    passes turn, which leaves each its own quarter; a side used twice is not.
    """
    out = F.struct(F.col("y0").alias("y"), F.col("x0").alias("x"), F.lit(False).alias("arrives"), F.lit(False).alias("inner"), (F.col("sy") * 2 + F.col("sx")).alias("to"))
    into = F.struct(F.col("y"), F.col("x"), F.lit(True).alias("arrives"), F.col("inner"), (-(F.col("sy") * 2 + F.col("sx"))).alias("to"))
    ends = units.select(*FEATURE, F.inline(F.array(out, into)))
    at = ends.groupBy(*FEATURE, "y", "x").agg(
        F.count_if("arrives").alias("passes"), F.count_if("inner").alias("straight"),
        F.greatest(*[F.count_if(F.col("to") == d) for d in (-2, -1, 1, 2)]).alias("shared"))
    wrong = (F.col("shared") > 1) | ((F.col("passes") > 1) & (F.col("straight") > 0))
    return at.filter(wrong).groupBy("scene_id").agg(F.count(F.lit(1)).alias("crossings"))


def stray_holes(units: DataFrame, rings: DataFrame) -> DataFrame:
    """(scene_id, stray): holes outside their shell, or inside another hole.

    The pixel under a hole's first corner is no part of the polygon: left of its
    middle lies an even number of the feature's sides. Sides and corners are
    counted along their pixel row.
    """
    upright = units.filter("sy != 0").select(*FEATURE, F.least("y0", "y").alias("y"), "x", F.lit(False).alias("probe"))
    probes = rings.filter("hole and sound").select(*FEATURE, F.col("top.vy").alias("y"), F.col("top.vx").alias("x"), F.lit(True).alias("probe"))
    along = Window.partitionBy(*FEATURE, "y").orderBy("x", "probe").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = upright.unionByName(probes).withColumn("left", F.count_if(~F.col("probe")).over(along))
    return counted.filter("probe and left % 2 = 1").groupBy("scene_id").agg(F.count(F.lit(1)).alias("stray"))


def delivered_figures(
    lines: DataFrame, mask_area: DataFrame, shape: tuple[int, int], metres: int, tolerance: float = 1e-3, margin: float = 1e-3,
) -> DataFrame:
    """Faults of the documents of each scene, as counts.

    ``lines`` of ``scan_geojson`` carry epsg, origin_e, origin_n and the footprint box
    (min_latitude ...); ``mask_area`` has scene_id, class, area_m2. ``shape`` is the
    scene's at ``metres`` a pixel. Every scene of either table has a row.
    """
    points = cut_lineage(snapped(lines, metres), "points")
    rings = cut_lineage(ring_figures(points), "rings")
    box = lines.groupBy("scene_id").agg(
        F.count_if("bad").alias("bad_lines"), *[F.any_value(c).alias(c) for c in ("min_latitude", "min_longitude", "max_latitude", "max_longitude")])
    inside = (
        (F.col("lon_min") >= F.col("min_longitude") - margin) & (F.col("lon_max") <= F.col("max_longitude") + margin)
        & (F.col("lat_min") >= F.col("min_latitude") - margin) & (F.col("lat_max") <= F.col("max_latitude") + margin))
    bounds = rings.groupBy("scene_id").agg(
        F.count_if(~F.col("hole")).alias("features"), F.count(F.lit(1)).alias("rings"), F.count_if(~F.col("sound")).alias("broken"))
    outside = rings.join(box, "scene_id").filter(~F.coalesce(inside, F.lit(True))).groupBy("scene_id").agg(F.count(F.lit(1)).alias("outside"))
    vector = rings.groupBy("scene_id", "class").agg(F.sum(F.when(F.col("hole"), -F.col("area_m2")).otherwise(F.col("area_m2"))).alias("vector_m2"))
    both = mask_area.join(vector, ["scene_id", "class"], "full").fillna(0.0, ["area_m2", "vector_m2"])
    near = F.abs(F.col("vector_m2") - F.col("area_m2")) <= F.col("area_m2") * tolerance
    area = both.groupBy("scene_id").agg(F.count_if(~near).alias("off_area"))
    units = _unit_sides(points, shape)
    out = area.join(box.select("scene_id", "bad_lines"), "scene_id", "full")
    for part in (bounds, outside, crossings(units), stray_holes(units, rings)):
        out = out.join(part, "scene_id", "left")
    return out.withColumn("found", F.col("bad_lines").isNotNull()).fillna(0)
