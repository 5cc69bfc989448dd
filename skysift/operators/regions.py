"""Connected cloud regions: runs, touching runs, components, their statistics.

Components are found in three levels. Inside a block (a fixed-size square) runs
are joined by a small numpy helper, many blocks at a time; regions that touch a block
border are joined the same way inside a district, a square of a fixed number of blocks,
and only those that cross districts take part in the distributed label propagation.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysift.operators.graph import connected_components
from skysift.operators.grid import block_numbers, idiv, map_blocks
from skysift.session import cut_and_count, cut_lineage, shuffle_width

LAYER = ["scene_id", "class"]
DISTRICT = [*LAYER, "drow", "dcol"]
#: Blocks along the side of a district.
FAN = 8


def district(pixel: Column, width: int, side: int) -> tuple[Column, Column]:
    """Row and column of the square of ``side`` pixels that holds a pixel given as y * width + x."""
    return idiv(pixel, width * side), idiv(pixel % width, side)


def layers(px: DataFrame, classes: dict[str, str]) -> DataFrame:
    """Dense class layers in long form: class name -> boolean column."""
    pairs = F.array(*[F.struct(F.lit(n).alias("class"), F.col(c).alias("on")) for n, c in classes.items()])
    return px.select("scene_id", "y", "x", F.inline(pairs))


def mask_runs(layer: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Maximal horizontal runs of true pixels per raster row."""
    row = [*LAYER, *extra, "y"]
    order = Window.partitionBy(*row).orderBy("x")
    island = F.col("x") - F.row_number().over(order)
    return (
        layer.filter("on").withColumn("_island", island)
        .groupBy(*row, "_island").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_island")
    )


def run_overlap_join(runs: DataFrame, payload: Sequence[str] = (), bucket: int = 64, below: DataFrame | None = None) -> DataFrame:
    """Pairs of runs in adjacent rows that share a column (4-neighbours).

    Runs are keyed by the fixed-width column bucket they cross, so a crowded row
    is never compared all against all; each pair is kept in the one bucket that
    holds the start of its overlap.
    """
    def spread(df: DataFrame, tag: str) -> DataFrame:
        return df.select(
            *LAYER, F.col("y").alias(f"y_{tag}"), F.col("x0").alias(f"x0_{tag}"), F.col("x1").alias(f"x1_{tag}"),
            *[F.col(p).alias(f"{p}_{tag}") for p in payload],
            F.explode(F.sequence(idiv(F.col("x0"), bucket), idiv(F.col("x1"), bucket))).alias("_bucket"))

    upper = spread(runs, "a").withColumn("_row", F.col("y_a") + 1)
    lower = spread(runs if below is None else below, "b").withColumn("_row", F.col("y_b"))
    start = F.greatest("x0_a", "x0_b")
    touch = (start <= F.least("x1_a", "x1_b")) & (idiv(start, bucket) == F.col("_bucket"))
    return upper.join(lower, [*LAYER, "_row", "_bucket"]).filter(touch).drop("_row", "_bucket")


def _least_linked(n: int, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """The smallest of the n nodes that each is linked to, over any number of links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[upper], root[lower])
        new = root.copy()
        np.minimum.at(new, root[upper], low)
        np.minimum.at(new, root[lower], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _block_runs(px: pa.Table, width: int) -> pa.Table:
    """Runs of the true pixels of whole blocks, labelled with the first pixel of their region in the block."""
    block, _ = block_numbers(px, [*LAYER, "hrow", "hcol"])
    y, x = (px[c].to_numpy().astype(np.int64) for c in ("y", "x"))
    fresh = np.ones(len(x), bool)
    fresh[1:] = (block[1:] != block[:-1]) | (y[1:] != y[:-1]) | (x[1:] != x[:-1] + 1)
    first = np.flatnonzero(fresh)
    y, x0, x1 = y[first], x[first], x[np.append(first[1:], len(x)) - 1]
    # Blocks lie a row apart, so that runs of different ones never touch.
    row = (block[first] * (y.max() + 2) + y) * width
    # Runs of the next row that overlap run i form the index range [lo, hi).
    lo = np.searchsorted(row + x1, row + width + x0, "left")
    hi = np.searchsorted(row + x0, row + width + x1, "right")
    n = np.maximum(hi - lo, 0)
    upper = np.repeat(np.arange(len(y)), n)
    lower = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    root = _least_linked(len(y), upper, lower)
    kind = px.schema.field("x").type
    runs = px.select([*LAYER, "y"]).take(pa.array(first))
    for name, values in (("x0", pa.array(x0).cast(kind)), ("x1", pa.array(x1).cast(kind)), ("label", pa.array((y * width + x0)[root]))):
        runs = runs.append_column(name, values)
    return runs


def _district_roots(links: pa.Table) -> pa.Table:
    """The smallest node of its district that each node of whole districts is linked to."""
    block, first = block_numbers(links, DISTRICT)
    u, v = (links[c].to_numpy() for c in ("u", "v"))
    span = max(u.max(), v.max()) + 1
    nodes, at = np.unique(np.concatenate([block * span + u, block * span + v]), return_inverse=True)
    root = _least_linked(len(nodes), at[:len(u)], at[len(u):])
    out = links.select(LAYER).take(pa.array(first[nodes // span]))
    return out.append_column("node", pa.array(nodes % span)).append_column("root", pa.array((nodes % span)[root]))


def mask_components(layer: DataFrame, shape: tuple[int, int], edge: int = 183, fan: int = FAN) -> DataFrame:
    """Maximal runs with the 4-connected region each belongs to.

    A region is named after its first pixel in row-major order, so the result
    does not depend on partitioning.
    """
    width = shape[1]
    spark = layer.sparkSession
    placed = layer.filter("on").withColumns({"hrow": idiv(F.col("y"), edge), "hcol": idiv(F.col("x"), edge)}).repartition(
        shuffle_width(spark), "scene_id", "hrow", "hcol")
    block = [*LAYER, "hrow", "hcol"]
    types = {f.name: f.dataType.simpleString() for f in placed.schema.fields}
    schema = f"scene_id {types['scene_id']}, class {types['class']}, y {types['y']}, x0 {types['x']}, x1 {types['x']}, label bigint"
    labelled = cut_lineage(map_blocks(placed.select(*block, "y", "x"), block, ["y", "x"], lambda px: _block_runs(px, width), schema))

    ends = labelled.filter((F.col("x1") + 1) % edge == 0).select(*LAYER, "y", (F.col("x1") + 1).alias("x"), F.col("label").alias("u"))
    starts = labelled.filter(F.col("x0") % edge == 0).select(*LAYER, "y", F.col("x0").alias("x"), F.col("label").alias("v"))
    sideways = ends.join(starts, [*LAYER, "y", "x"]).select(*LAYER, "u", "v")
    last = labelled.filter((F.col("y") + 1) % edge == 0)
    first = labelled.filter(F.col("y") % edge == 0)
    down = run_overlap_join(last, ["label"], below=first).select(*LAYER, F.col("label_a").alias("u"), F.col("label_b").alias("v"))
    links = sideways.unionByName(down).distinct()
    merged = propagate_labels(links, width, edge * fan)
    named = cut_lineage(labelled.join(merged.select(*LAYER, F.col("node").alias("label"), "root"), [*LAYER, "label"], "left").select(
        *LAYER, "y", "x0", "x1", F.coalesce("root", "label").alias("component")), "runs")
    # Only runs that reach the side of a block may go on in the next one.
    cut = (F.col("x0") % edge == 0) | ((F.col("x1") + 1) % edge == 0)
    return named.filter(~cut).unionByName(merge_runs(named.filter(cut)))


def propagate_labels(links: DataFrame, width: int, side: int) -> DataFrame:
    """Smallest node reachable from each linked node: (scene, class, node, root).

    Nodes are pixels, y * width + x. Links inside a district of ``side`` pixels are
    followed in one pass; the least nodes of districts then stand for all of them.
    """
    spark = links.sparkSession
    near = (F.struct(*district(F.col("u"), width, side)) == F.struct(*district(F.col("v"), width, side)))
    links, crossing = cut_and_count(links.select(*LAYER, "u", "v", (~near).alias("cross")), "cross")
    # A node that only has links to other districts is linked to itself.
    own = F.when(F.col("cross"), F.array(F.struct(F.col("u"), F.col("u").alias("v")), F.struct(F.col("v").alias("u"), F.col("v")))).otherwise(F.array(F.struct("u", "v")))
    row, column = district(F.col("u"), width, side)
    dealt = links.select(*LAYER, F.inline(own)).withColumns({"drow": row, "dcol": column}).repartition(shuffle_width(spark), "scene_id", "drow", "dcol")
    types = {f.name: f.dataType.simpleString() for f in links.schema.fields}
    schema = f"scene_id {types['scene_id']}, class {types['class']}, node bigint, root bigint"
    local = map_blocks(dealt.select(*DISTRICT, "u", "v"), DISTRICT, ["u"], _district_roots, schema)
    if not crossing:
        return local
    local = cut_lineage(local, "districts")
    root = lambda end: local.select(*LAYER, F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
    far = links.filter("cross").join(root("u"), [*LAYER, "u"]).join(root("v"), [*LAYER, "v"]).select(
        *LAYER, F.col("u_root").alias("u"), F.col("v_root").alias("v"))
    least = connected_components(far, LAYER).select(*LAYER, F.col("node").alias("root"), F.col("root").alias("least"))
    return local.join(least, [*LAYER, "root"], "left").select(*LAYER, "node", F.coalesce("least", "root").alias("root"))


def merge_runs(runs: DataFrame) -> DataFrame:
    """Runs cut at block borders -> maximal runs."""
    order = Window.partitionBy(*LAYER, "y").orderBy("x0")
    fresh = F.coalesce((F.lag("x1").over(order) + 1 != F.col("x0")).cast("int"), F.lit(1))
    return (
        runs.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(order))
        .groupBy(*LAYER, "y", "_run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("component").alias("component")).drop("_run")
    )


def component_stats(runs: DataFrame, metres: int) -> DataFrame:
    """Pixels, area, box and holes of each region.

    Holes follow from the Euler number: runs are nodes and touching pairs are
    edges of a graph with one cycle per hole.
    """
    touches = run_overlap_join(runs, ["component"]).select(
        *LAYER, F.col("component_a").alias("component"), F.lit(None).cast("int").alias("y"), F.lit(None).cast("int").alias("x0"),
        F.lit(None).cast("int").alias("x1"), F.lit(1).alias("pair"))
    rows = runs.select(*LAYER, "component", "y", "x0", "x1", F.lit(0).alias("pair")).unionByName(touches)
    sums = rows.groupBy(*LAYER, "component").agg(
        F.sum(F.col("x1") - F.col("x0") + 1).cast("bigint").alias("pixels"),
        F.min("y").alias("y_min"), F.max("y").alias("y_max"), F.min("x0").alias("x_min"), F.max("x1").alias("x_max"),
        (F.sum("pair") - F.count("y") + 1).alias("holes"))
    return sums.withColumn("area_m2", F.col("pixels").cast("double") * metres * metres)
