"""Region outlines as closed rings, in pixel corners and in longitude/latitude.

A ring is a linked list of unit pixel edges. Inside a block a numpy helper, which
takes many blocks at a time, shortens it to chains; a second one joins the chains of a
district, a square of blocks. What crosses districts is ranked by pointer doubling over
DataFrames. Vertices stay one per row, so no ring is ever gathered whole.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skysift.constants import GEOJSON_DECIMALS
from skysift.functions import geodesy
from skysift.operators.grid import block_numbers, idiv, map_blocks, with_halo
from skysift.operators.regions import DISTRICT, FAN, LAYER, district
from skysift.session import cut_and_count, cut_lineage, shuffle_width

# Side of a pixel -> step to the pixel straight ahead and to the one diagonally
# ahead, when walking with the region on the right: top, right, bottom, left.
AHEAD = ((0, 1), (1, 0), (0, -1), (-1, 0))
OUTSIDE = ((-1, 0), (0, 1), (1, 0), (0, -1))
#: Places of a ring in one group, where neighbours meet.
SPAN = 4096
BLOCK = (*LAYER, "hrow", "hcol")
CHAIN_COLUMNS = ("head", "rank", "vy", "vx", "turns", "lift", "least", "least_rank", "next")


def _edges(px: pa.Table, width: int) -> tuple[np.ndarray, ...]:
    """Directed unit edges around the inner true pixels of whole blocks, with their successor.

    Columns block, id, succ, turn, vy, vx, lift, by block and id. Edge ids are 4 * pixel
    + side. Diagonal pixels are kept apart, in line with 4-connected regions.
    """
    block, _ = block_numbers(px, BLOCK)
    y, x = (px[c].to_numpy().astype(np.int64) for c in ("y", "x"))
    inner = px["inner"].to_numpy()
    # Places of the pixels, with an empty column and row on every side.
    row = width + 2
    place = (block * (y.max() + 3) + y + 1) * row + x + 1
    block, y, x, here = block[inner], y[inner], x[inner], place[inner]

    def at(dy: int, dx: int) -> np.ndarray:
        there = here + dy * row + dx
        return place[np.minimum(np.searchsorted(place, there), len(place) - 1)] == there

    on = {(dy, dx): at(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx}
    pixel = y * width + x
    sides = []
    for side in range(4):
        (ay, ax), (oy, ox) = AHEAD[side], OUTSIDE[side]
        ahead, beyond = on[ay, ax], on[ay + oy, ax + ox]
        step = lambda dy, dx, s: (pixel + dy * width + dx) * 4 + s
        succ = np.where(~ahead, step(0, 0, (side + 1) % 4), np.where(beyond, step(ay + oy, ax + ox, (side + 3) % 4), step(ay, ax, side)))
        lift = x + 1 if side == 1 else (-x if side == 3 else np.zeros_like(x))
        columns = (block, pixel * 4 + side, succ, (~ahead | beyond).astype(np.int64), y + (side in (1, 2)), x + (side in (0, 1)), lift)
        sides.append([c[~on[oy, ox]] for c in columns])
    columns = [np.concatenate(c) for c in zip(*sides)]
    order = np.lexsort((columns[1], columns[0]))
    return tuple(c[order] for c in columns)


def _follow(back: np.ndarray, rounds: int, *tracks: tuple[np.ndarray, np.ufunc | None]) -> list[np.ndarray]:
    """Pointer doubling along ``back`` (-1 ends a walk); each track is folded, or replaced where its fold is None."""
    out = [t for t, _ in tracks]
    for _ in range(rounds):
        live = back >= 0
        b = np.where(live, back, 0)
        out = [np.where(live, t[b] if fold is None else fold(t, t[b]), t) for t, (_, fold) in zip(out, tracks)]
        back = np.where(live, back[b], -1)
    return out


def _chains(px: pa.Table, width: int) -> pa.Table:
    """Follow the edges of whole blocks: turns ranked along their chain, and one row per chain.

    Chains start where an edge is entered from another block; a ring inside the
    block starts at its smallest edge. An outer ring inside the block is finished: its
    points carry its name, turns and pixels and their place, and it has no chain.
    """
    block, ids, succ, turn, vy, vx, lift = _edges(px, width)
    n = len(ids)
    if not n:
        return _chain_schema(px).empty_table()
    span = max(ids.max(), succ.max()) + 1
    keyed, wanted = block * span + ids, block * span + succ
    spot = np.minimum(np.searchsorted(keyed, wanted), n - 1)
    inside = keyed[spot] == wanted
    back = np.full(n, -1)
    back[spot[inside]] = np.flatnonzero(inside)

    rounds = int(np.bincount(block).max()).bit_length() + 1
    # Smallest edge met when walking back; a walk that ends marks an open chain.
    least, open_ = _follow(back, rounds, (np.arange(n), np.minimum), (back < 0, np.logical_or))
    back[np.unique(least[~open_])] = -1
    before = np.where(back >= 0, turn[np.maximum(back, 0)], 0)
    head, rank = _follow(back, rounds, (np.arange(n), None), (before, np.add))

    # Ids are sorted, so the first edge of a chain in this order is its smallest.
    heads, first, chain = np.unique(head, return_index=True, return_inverse=True)
    leaves = np.zeros(len(heads), np.int64)
    leaves[chain[~inside]] = succ[~inside]
    opened = np.zeros(len(heads), bool)
    opened[chain[~inside]] = True
    total = lambda values: np.bincount(chain, weights=values, minlength=len(heads)).astype(np.int64)
    turned = turn == 1
    turns, pixels = total(turn), total(lift)
    done = ~opened & (pixels > 0)
    mine = chain[turned]
    place = np.where(done[mine], (rank[turned] - rank[first][mine]) % np.maximum(turns[mine], 1), rank[turned])
    finished = {c: pa.array(v[mine], mask=~done[mine]) for c, v in (("turns", turns), ("lift", pixels), ("least", ids[first]))}
    points = {"head": ids[head[turned]], "rank": place, "vy": vy[turned], "vx": vx[turned], **finished}
    open_sums = {"head": ids[heads], "turns": turns, "lift": pixels, "least": ids[first], "least_rank": rank[first]}
    sums = {c: v[~done] for c, v in open_sums.items()} | {"next": pa.array(leaves[~done], mask=~opened[~done])}

    _, first_row = block_numbers(px, BLOCK)
    schema = _chain_schema(px)

    def rows(columns: dict, blocks: np.ndarray, is_chain: bool) -> pa.Table:
        given = px.select(LAYER).take(pa.array(first_row[blocks]))
        named = {"is_chain": pa.array(np.full(len(blocks), is_chain))} | {c: pa.array(columns[c]) if c in columns else pa.nulls(len(blocks), pa.int64()) for c in CHAIN_COLUMNS}
        return pa.table([*given.columns, *named.values()], schema=schema)

    return pa.concat_tables([rows(points, block[turned], False), rows(sums, block[heads][~done], True)])


def _joined(chains: pa.Table) -> pa.Table:
    """Follow the open chains of whole districts: the first of those that meet, and the turns before each.

    ``turns`` and ``next`` become those of all that meet; a ring inside the district
    starts at its smallest head and has no next.
    """
    block, _ = block_numbers(chains, DISTRICT)
    head, turns, succ = (chains[c].to_numpy() for c in ("head", "turns", "next"))
    n = len(head)
    span = max(head.max(), succ.max()) + 1
    keyed, wanted = block * span + head, block * span + succ
    spot = np.minimum(np.searchsorted(keyed, wanted), n - 1)
    inside = keyed[spot] == wanted
    back = np.full(n, -1)
    back[spot[inside]] = np.flatnonzero(inside)
    rounds = int(np.bincount(block).max()).bit_length() + 1
    least, open_ = _follow(back, rounds, (np.arange(n), np.minimum), (back < 0, np.logical_or))
    back[np.unique(least[~open_])] = -1
    lead, before = _follow(back, rounds, (np.arange(n), None), (np.where(back >= 0, turns[np.maximum(back, 0)], 0), np.add))
    total = np.bincount(lead, weights=turns, minlength=n).astype(np.int64)
    leaves, leaving = np.zeros(n, np.int64), np.zeros(n, bool)
    leaves[lead[~inside]], leaving[lead[~inside]] = succ[~inside], True
    out = chains.select([*LAYER, "head"])
    for name, values in (("lead", head[lead]), ("before", before), ("turns", total[lead]), ("next", pa.array(leaves[lead], mask=~leaving[lead]))):
        out = out.append_column(name, pa.array(values))
    return out


def _chain_schema(px: pa.Table) -> pa.Schema:
    return pa.schema([*[px.schema.field(c) for c in LAYER], pa.field("is_chain", pa.bool_()), *[pa.field(c, pa.int64()) for c in CHAIN_COLUMNS]])


def _rank_chains(chains: DataFrame, width: int, side: int) -> DataFrame:
    """Open chains -> ring, turns before the chain, turns of the ring.

    Chains that meet inside a district of ``side`` pixels are one chain to the others.
    """
    spark = chains.sparkSession
    row, column = district(idiv(F.col("head"), 4), width, side)
    dealt = chains.select(*LAYER, row.alias("drow"), column.alias("dcol"), "head", "turns", "next").repartition(shuffle_width(spark), "scene_id", "drow", "dcol")
    types = {f.name: f.dataType.simpleString() for f in chains.schema.fields}
    schema = f"scene_id {types['scene_id']}, class {types['class']}, head bigint, lead bigint, before bigint, turns bigint, next bigint"
    joined = map_blocks(dealt, DISTRICT, ["head"], _joined, schema)
    joined, crossing = cut_and_count(joined.withColumn("open", F.col("next").isNotNull()), "open")
    ranked = joined.filter("not open").select(*LAYER, "head", F.col("lead").alias("ring"), "before", F.col("turns").alias("n"))
    if not crossing:
        return ranked
    far = _rank_far(joined.filter("open and head = lead").select(*LAYER, "head", "turns", "next")).select(
        *LAYER, F.col("head").alias("lead"), "ring", F.col("before").alias("start"), "n")
    return ranked.unionByName(joined.filter("open").select(*LAYER, "head", "lead", "before").join(far, [*LAYER, "lead"]).select(
        *LAYER, "head", "ring", (F.col("start") + F.col("before")).alias("before"), "n"))


def _rank_far(chains: DataFrame) -> DataFrame:
    """Chains that cross districts -> ring (its smallest head), turns before the chain, turns of the ring.

    Two pointer-doubling loops: the first finds the smallest head of each ring,
    the second the number of turns from each chain round to it.
    """
    key = [*LAYER, "head"]

    def hop(df: DataFrame, cols: list[str]) -> DataFrame:
        return df.select(*LAYER, F.col("head").alias("ptr"), *[F.col(c).alias(f"{c}_far") for c in cols])

    state = chains.select(*key, "turns", "next", F.col("next").alias("ptr"), F.col("head").alias("ring"))
    while True:
        far = hop(state, ["ring", "ptr"])
        new, moved = cut_and_count(state.join(far, [*LAYER, "ptr"]).select(
            *key, "turns", "next", F.col("ptr_far").alias("ptr"), F.least("ring", "ring_far").alias("ring"),
            (F.col("ring_far") < F.col("ring")).alias("moved")), "moved")
        state = new.drop("moved")
        if not moved:
            break
    state = state.select(*key, "ring", "turns", F.col("next").alias("ptr"), F.col("turns").alias("ahead"))
    unfinished = 1
    while unfinished:
        far = hop(state, ["ahead", "ptr"])
        going = F.col("ptr") != F.col("ring")
        step = state.join(far, [*LAYER, "ptr"]).select(
            *key, "ring", "turns", F.when(going, F.col("ptr_far")).otherwise(F.col("ptr")).alias("ptr"),
            F.when(going, F.col("ahead") + F.col("ahead_far")).otherwise(F.col("ahead")).alias("ahead"))
        new, unfinished = cut_and_count(step.withColumn("going", F.col("ptr") != F.col("ring")), "going")
        state = new.drop("going")
    total = state.filter(F.col("head") == F.col("ring")).select(*LAYER, "ring", F.col("ahead").alias("n"))
    return state.join(total, [*LAYER, "ring"]).select(*key, "ring", (F.col("n") - F.col("ahead")).alias("before"), "n")


def polygon_rings(layer: DataFrame, runs: DataFrame, shape: tuple[int, int], edge: int = 183, bucket: int = 64, fan: int = FAN) -> DataFrame:
    """Ring vertices: scene, class, component, ring, hole, n, seq, vy, vx.

    Rings are closed (seq n repeats seq 0), outer rings run clockwise in image
    coordinates. ``runs`` are the labelled runs of the same layers, named as
    ``mask_components`` does; they tell whose the holes are.
    """
    width = shape[1]
    halo = with_halo(layer.filter("on").select(*LAYER, "y", "x"), shape, 1, edge=edge, keys=("scene_id",))
    types = {f.name: f.dataType.simpleString() for f in halo.schema.fields}
    schema = f"scene_id {types['scene_id']}, class string, is_chain boolean, " + ", ".join(f"`{c}` bigint" for c in CHAIN_COLUMNS)
    walked = cut_lineage(map_blocks(halo, BLOCK, ["y", "x"], lambda px: _chains(px, width), schema))
    chains = walked.filter("is_chain")
    closed = chains.filter(F.col("next").isNull()).select(*LAYER, "head", F.col("head").alias("ring"), F.lit(0).cast("bigint").alias("before"), F.col("turns").alias("n"))
    ranked = cut_lineage(closed.unionByName(_rank_chains(chains.filter(F.col("next").isNotNull()), width, edge * fan)))

    # A ring is named after its smallest edge and starts there.
    parts = chains.select(*LAYER, "head", "lift", "least", "least_rank").join(ranked, [*LAYER, "head"])
    rings = cut_lineage(parts.groupBy(*LAYER, F.col("ring").alias("lead")).agg(
        F.sum("lift").alias("pixels"), F.min("least").alias("ring"), F.min_by(F.col("before") + F.col("least_rank"), "least").alias("shift")), "rings")
    # A region and its outer ring have the same first pixel; that of a hole is the one of the run under its smallest edge.
    region = F.call_function("div", F.col("ring"), F.lit(4))
    where = rings.filter("pixels < 0").withColumns({
        "y": idiv(F.col("ring"), 4 * width), "x": idiv(F.col("ring") % (4 * width), 4),
    }).withColumn("_bucket", idiv(F.col("x"), bucket))
    spans = runs.select(*LAYER, "y", "x0", "x1", "component", F.explode(F.sequence(idiv(F.col("x0"), bucket), idiv(F.col("x1"), bucket))).alias("_bucket"))
    holes = where.join(spans, [*LAYER, "y", "_bucket"]).filter(F.col("x").between(F.col("x0"), F.col("x1")))
    owned = rings.filter("pixels > 0").withColumn("component", region).unionByName(holes.select(*rings.columns, "component"))
    # Owners are attached to chains, not to vertices: one ring may hold most vertices.
    named = ranked.withColumnRenamed("ring", "lead").join(owned, [*LAYER, "lead"]).withColumn("hole", F.col("pixels") < 0)
    walked = walked.filter(~F.col("is_chain"))
    points = walked.filter("least is null").select(*LAYER, "head", "rank", "vy", "vx").join(named, [*LAYER, "head"]).withColumn(
        "seq", F.pmod(F.col("before") + F.col("rank") - F.col("shift"), F.col("n")))
    finished = walked.filter("least is not null").select(
        *LAYER, F.col("least").alias("ring"), F.lit(False).alias("hole"), F.col("lift").alias("pixels"), F.col("turns").alias("n"), F.col("rank").alias("seq"), "vy", "vx")
    columns = [*LAYER, "component", "ring", "hole", "pixels", "n", "seq", F.col("vy").cast("int").alias("vy"), F.col("vx").cast("int").alias("vx")]
    again = F.when(F.col("seq") == 0, F.array(F.lit(0).cast("bigint"), F.col("n"))).otherwise(F.array("seq"))
    both = finished.withColumn("component", region).select(*columns).unionByName(points.select(*columns))
    return both.withColumn("seq", F.explode(again))


def features_wgs84(rings: DataFrame, scenes: DataFrame, metres: int, decimals: int = GEOJSON_DECIMALS) -> DataFrame:
    """Vertices as rounded longitude/latitude."""
    placed = rings.join(scenes.select("scene_id", "epsg", "origin_e", "origin_n"), "scene_id")
    east, north = geodesy.pixel_to_map(F.col("origin_e"), F.col("origin_n"), F.col("vy"), F.col("vx"), metres)
    located = geodesy.with_lonlat(placed.withColumns({"_e": east, "_n": north}), [("_e", "_n", "_lat", "_lon")])
    return located.select(
        *rings.columns, "epsg", geodesy.round_coord(F.col("_lon"), decimals).alias("lon"), geodesy.round_coord(F.col("_lat"), decimals).alias("lat"))


def with_next(points: DataFrame, columns: Sequence[str], span: int = SPAN) -> DataFrame:
    """Every point that starts a side, with ``next``: ``columns`` of the point at the place behind it, null if there is none.

    Rings are cut to pieces of ``span`` places and the first point of a piece also ends the
    one before, so that a ring of any length is not one group and no table meets itself.
    """
    piece = F.col("seq").cast("bigint")
    number = F.call_function("div", piece, F.lit(span))
    copies = F.when((piece > 0) & (piece % span == 0), F.array(number - 1, number)).otherwise(F.array(number))
    along = Window.partitionBy(*LAYER, "ring", "_piece").orderBy("seq")
    ahead = F.lead(F.struct("seq", *columns)).over(along)
    seen = points.withColumn("_piece", F.explode(copies)).withColumn("next", ahead)
    return seen.filter((F.col("_piece") == number) & (F.col("seq") < F.col("n"))).withColumn(
        "next", F.when(F.col("next.seq") == F.col("seq") + 1, F.col("next"))).drop("_piece")


def feature_area(features: DataFrame) -> DataFrame:
    """Area in the scene projection of each ring as written: positive outside, negative for holes.

    Neighbouring vertices meet in pieces of the ring.
    """
    ring = [*LAYER, "component", "ring", "hole"]
    back = geodesy.with_utm(features, [("lat", "lon", "_e", "_n")]).select(*ring, "n", "seq", "_e", "_n")
    # Clockwise in image coordinates is counter-clockwise downwards in northing.
    cross = F.col("next._e") * F.col("_n") - F.col("_e") * F.col("next._n")
    sides = with_next(back, ["_e", "_n"]).filter(F.col("next").isNotNull())
    return sides.groupBy(*ring).agg((F.sum(cross) / 2.0).alias("area_m2"), F.count(F.lit(1)).alias("sides"))


def feature_area_check(features: DataFrame, mask_area: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Area of the written polygons against the mask's pixel area, per scene and class."""
    total = feature_area(features).groupBy(*LAYER).agg(F.sum("area_m2").alias("vector_m2"), F.count(F.lit(1)).alias("rings"))
    both = mask_area.join(total, LAYER, "left")
    gap = F.when(F.col("area_m2") == 0, F.lit(0.0)).otherwise(F.abs(F.coalesce("vector_m2", F.lit(0.0)) - F.col("area_m2")) / F.col("area_m2"))
    return both.select(*LAYER, "area_m2", F.coalesce("rings", F.lit(0)).alias("rings"), gap.alias("gap"), (gap <= tolerance).alias("ok"))


def feature_extent_check(features: DataFrame, footprints: DataFrame, margin: float = 1e-3) -> DataFrame:
    """Every feature inside the scene footprint, longitude first.

    ``footprints`` has the footprint box of each scene.
    """
    box = features.groupBy(*LAYER, "component").agg(
        F.min("lon").alias("lon0"), F.max("lon").alias("lon1"), F.min("lat").alias("lat0"), F.max("lat").alias("lat1"))
    joined = box.join(footprints, "scene_id")
    ok = (
        (F.col("lon0") >= F.col("min_longitude") - margin) & (F.col("lon1") <= F.col("max_longitude") + margin)
        & (F.col("lat0") >= F.col("min_latitude") - margin) & (F.col("lat1") <= F.col("max_latitude") + margin)
    )
    return joined.select(*LAYER, "component", ok.alias("ok"))


def ring_validity(rings: DataFrame) -> DataFrame:
    """Per ring: closed, at least four sides, consecutive, and right-angled throughout."""
    ring = [*LAYER, "component", "ring"]
    steps = with_next(rings.select(*ring, "n", "seq", "vy", "vx"), ["vy", "vx"])
    straight = (F.col("vy") == F.col("next.vy")) != (F.col("vx") == F.col("next.vx"))
    return steps.groupBy(*ring).agg(
        F.max("n").alias("n"), F.count(F.lit(1)).alias("steps"), F.count_if(F.coalesce(straight, F.lit(False))).alias("good"),
    ).select(*ring, "n", ((F.col("n") >= 4) & (F.col("steps") == F.col("n")) & (F.col("good") == F.col("n"))).alias("ok"))
