"""Tile grid, block placement and the halo exchange.

Pixel tables carry ``scene_id, y, x`` on their own grid. ``brow, bcol`` name the
block: the smallest square that neither a tile nor a 60 m pixel straddles. Once
tables are hash-partitioned by (scene_id, brow, bcol), joins between resolutions
and per-tile aggregates run without another exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.constants import SceneGrid
from skysift.functions import geodesy
from skysift.session import shuffle_width

BLOCK = ("scene_id", "brow", "bcol")


def idiv(value: Column, by: int) -> Column:
    """Integer division of non-negative values, kept as INT."""
    return F.call_function("div", value, F.lit(by)).cast("int")


def with_block(px: DataFrame, grid: SceneGrid, resolution: int) -> DataFrame:
    edge = grid.block_px * grid.metres // resolution
    return px.withColumns({"brow": idiv(F.col("y"), edge), "bcol": idiv(F.col("x"), edge)})


def place(px: DataFrame) -> DataFrame:
    """Hash-partition by block; the width is fixed so several tables co-locate."""
    return px.repartition(shuffle_width(px.sparkSession), *BLOCK)


def block_keys(px: DataFrame) -> list[str]:
    """Block columns the table carries; grouping by them keeps work in place."""
    return [c for c in ("brow", "bcol") if c in px.columns]


def tile_grid(scenes: DataFrame, grid: SceneGrid) -> DataFrame:
    """Every (tile_row, tile_col) of every scene, with its row-major index."""
    return (
        scenes
        .withColumn("tile_row", F.explode(F.sequence(F.lit(0), F.lit(grid.rows - 1))))
        .withColumn("tile_col", F.explode(F.sequence(F.lit(0), F.lit(grid.cols - 1))))
        .withColumn("tile_index", row_major_index(F.col("tile_row"), F.col("tile_col"), grid))
    )


def row_major_index(row: Column, col: Column, grid: SceneGrid) -> Column:
    return row * F.lit(grid.cols) + col


def assign_tile(px: DataFrame, grid: SceneGrid, offsets: bool = False) -> DataFrame:
    """Tile of each 10 m pixel, and on request the position inside it."""
    t = grid.tile_px
    cols = {"tile_row": idiv(F.col("y"), t), "tile_col": idiv(F.col("x"), t)}
    if offsets:
        cols |= {"py": F.col("y") % t, "px": F.col("x") % t}
    return px.withColumns(cols)


def reassemble_scene(tiles: DataFrame, grid: SceneGrid, cells: str = "cells") -> DataFrame:
    """Tile rows with a row-major cell array -> scene pixels (inverse of the cut)."""
    t = grid.tile_px
    out = tiles.select("*", F.posexplode(cells).alias("_pos", "value"))
    return out.select(
        "scene_id",
        (F.col("tile_row") * t + idiv(F.col("_pos"), t)).alias("y"),
        (F.col("tile_col") * t + F.col("_pos") % t).alias("x"),
        "value",
    )


def grid_guard(catalog: DataFrame, grid: SceneGrid) -> DataFrame:
    """Adds ``grid_ok``: the scene is exactly rows x cols whole tiles."""
    return catalog.withColumn(
        "grid_ok", (F.col("nrows") == grid.height) & (F.col("ncols") == grid.width)
    )


def tile_utm_bounds(tiles: DataFrame, grid: SceneGrid) -> DataFrame:
    """Tile box in the scene projection; tiles outside the grid are an error."""
    m = grid.tile_metres
    inside = F.col("tile_row").between(0, grid.rows - 1) & F.col("tile_col").between(0, grid.cols - 1)
    checked = F.when(inside, F.col("tile_row")).otherwise(
        F.raise_error(F.concat(F.lit("tile outside the grid: "), F.col("tile_row"), F.lit(","), F.col("tile_col"))).cast("int"))
    north_max = F.col("origin_n") - checked * m
    east_min = F.col("origin_e") + F.col("tile_col") * m
    return tiles.withColumns({
        "east_min": east_min, "north_min": north_max - m,
        "east_max": east_min + m, "north_max": north_max,
    })


def tile_bbox(tiles: DataFrame, grid: SceneGrid) -> DataFrame:
    """Latitude/longitude box over all four projected corners of each tile.

    ``tiles`` carries ``epsg, origin_e, origin_n``.
    """
    bounded = tile_utm_bounds(tiles, grid)
    corners = [
        (e, n, f"_lat{i}", f"_lon{i}")
        for i, (e, n) in enumerate([
            ("east_min", "north_max"), ("east_max", "north_max"),
            ("east_max", "north_min"), ("east_min", "north_min"),
        ])
    ]
    located = geodesy.with_lonlat(bounded, corners)
    lats = [F.col(c[2]) for c in corners]
    lons = [F.col(c[3]) for c in corners]
    return located.select(
        *bounded.columns,
        F.least(*lats).alias("min_latitude"), F.least(*lons).alias("min_longitude"),
        F.greatest(*lats).alias("max_latitude"), F.greatest(*lons).alias("max_longitude"),
    )


def _cover(pos: str, radius: int, edge: int, blocks: int) -> Column:
    """Blocks whose halo of ``radius`` holds the (padded) coordinate."""
    return F.sequence(
        F.greatest(F.lit(0), F.floor((F.col(pos) - radius) / F.lit(edge)).cast("int")),
        F.least(F.lit(blocks - 1), F.floor((F.col(pos) + radius) / F.lit(edge)).cast("int")),
    )


def _mirrored(pos: str, radius: int, size: int) -> Column:
    """The coordinate and its reflections (edge pixel repeated) within the radius."""
    low = F.lit(-1) - F.col(pos)
    high = F.lit(2 * size - 1) - F.col(pos)
    return F.filter(
        F.array(
            F.col(pos),
            F.when(low >= -radius, low),
            F.when(high < size + radius, high),
        ),
        lambda c: c.isNotNull(),
    )


def with_halo(
    px: DataFrame, shape: tuple[int, int], radius: int, reflect: bool = False,
    edge: int = 183, keys: Sequence[str] = ("scene_id",),
) -> DataFrame:
    """Give every block its own pixels plus a border of ``radius`` pixels.

    One shuffle, after which 2-D neighbourhoods are local: windows partitioned
    by (keys, hrow, hcol, y) or (keys, hrow, hcol, x) need no further exchange.
    Only border pixels are copied. With ``reflect`` the raster is padded by
    mirroring; padded rows have coordinates outside the scene. ``inner`` marks
    the pixels a block owns.
    """
    height, width = shape
    if reflect and radius > min(height, width):
        raise ValueError("reflecting radius exceeds the raster")
    out = px
    if reflect:
        out = out.withColumn("y", F.explode(_mirrored("y", radius, height)))
        out = out.withColumn("x", F.explode(_mirrored("x", radius, width)))
    rows, cols = -(-height // edge), -(-width // edge)
    out = out.withColumn("hrow", F.explode(_cover("y", radius, edge, rows)))
    out = out.withColumn("hcol", F.explode(_cover("x", radius, edge, cols)))
    inside = (
        F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)
        & (idiv(F.col("y"), edge) == F.col("hrow")) & (idiv(F.col("x"), edge) == F.col("hcol"))
    )
    out = out.withColumn("inner", inside)
    return out.repartition(shuffle_width(px.sparkSession), *keys, "hrow", "hcol")


def _changes(rows: pa.RecordBatch | pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Places of the rows whose key differs from the row before, without row 0."""
    fresh = np.zeros(max(rows.num_rows - 1, 0), bool)
    for c in keys:
        column = rows.column(c)
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if column.null_count or not pa.types.is_integer(column.type):
            column = column.dictionary_encode("encode").indices
        values = column.to_numpy(zero_copy_only=False)
        fresh |= values[1:] != values[:-1]
    return np.flatnonzero(fresh) + 1


def block_numbers(rows: pa.Table, keys: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The block of each row, numbered from 0, and the first row of each block, where the rows of a block lie together."""
    first = np.concatenate([[0], _changes(rows, keys)])
    return np.repeat(np.arange(len(first)), np.diff(np.append(first, rows.num_rows))), first


def map_blocks(px: DataFrame, keys: Sequence[str], order: Sequence[str], make: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """Hand ``make`` the rows of whole blocks, many small ones at a time, sorted by ``keys`` and ``order``.

    ``px`` has the rows of a block (``keys``) in one partition. A call costs the same
    for one block as for many, so its number goes by rows and not by blocks.
    """
    keys = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        name = lambda batch, i: [batch.column(c)[i].as_py() for c in keys]
        for batch in batches:
            if not batch.num_rows:
                continue
            # The last block of a batch may go on in the next one.
            ends = _changes(batch, keys)
            cut = int(ends[-1]) if len(ends) else 0
            if held and (cut or name(held[-1], held[-1].num_rows - 1) != name(batch, 0)):
                yield from make(pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()).to_batches()
                held = []
            elif cut:
                yield from make(pa.Table.from_batches([batch.slice(0, cut)])).to_batches()
            held.append(batch.slice(cut))
        if held:
            yield from make(pa.Table.from_batches(held).combine_chunks()).to_batches()

    return px.sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
