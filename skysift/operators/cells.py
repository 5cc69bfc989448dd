"""Nested layout: one row per 60 m cell, with the finer pixels under it as arrays.

Joining resolutions then meets and sorts one row a cell, whatever the
resolution, all on the same key (scene, block, y, x): a 36th of the 10 m pixels,
and one sort a side. Sub-pixels stand in row-major order, so place ``p`` of a
cell of f x f is row ``p div f``, column ``p % f``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.constants import BANDS_BY_RESOLUTION
from skysift.functions import radiometry as R
from skysift.operators.grid import block_keys, idiv
from skysift.operators.model import FEATURES


def nest(px: DataFrame, factor: int, columns: Sequence[str]) -> DataFrame:
    """Flat pixels -> one row per cell of factor x factor, an array per column.

    A group is one cell. Pixels placed by block stay where they are. A cell that
    lacks a pixel or has one twice is an error.
    """
    keys = ["scene_id", *block_keys(px)]
    place = (F.col("y") % factor) * factor + F.col("x") % factor
    cells = px.groupBy(*keys, idiv(F.col("y"), factor).alias("y"), idiv(F.col("x"), factor).alias("x")).agg(
        F.sort_array(F.collect_list(F.struct(place.cast("int").alias("_p"), *columns))).alias("_c"))
    whole = F.col("_c._p") == F.sequence(F.lit(0), F.lit(factor * factor - 1))
    sound = F.when(whole, F.col("_c")).otherwise(F.raise_error(F.lit("ragged cell")).cast(cells.schema["_c"].dataType))
    return cells.withColumn("_c", sound).select(*keys, "y", "x", *[F.col("_c")[c].alias(c) for c in columns])


def unnest(cells: DataFrame, factor: int, arrays: Sequence[str], under: dict[str, int] | None = None) -> DataFrame:
    """Cells -> flat pixels of the arrays' grid, factor x factor to a cell.

    ``under`` names arrays of a coarser grid with their own factor; each pixel takes
    the value it lies in. Other columns are repeated.
    """
    under = under or {}
    rest = [c for c in cells.columns if c not in ("y", "x", *arrays, *under)]
    out = cells.select("*", F.posexplode(F.arrays_zip(*arrays)).alias("_p", "_v"))
    row, col = idiv(F.col("_p"), factor), F.col("_p") % factor

    def value(name: str, own: int) -> Column:
        return F.get(F.col(name), idiv(row, factor // own) * own + idiv(col, factor // own)).alias(name)

    return out.select(
        *rest, (F.col("y") * factor + row).alias("y"), (F.col("x") * factor + col).alias("x"),
        *[F.col("_v")[c].alias(c) for c in arrays], *[value(n, f) for n, f in under.items()])


def join_cells(*tables: DataFrame) -> DataFrame:
    """Tables of cells on one key; ``y, x`` are those of the cell."""
    out = tables[0]
    for more in tables[1:]:
        out = out.join(more, ["scene_id", *[k for k in block_keys(out) if k in more.columns], "y", "x"])
    return out


def fine_stack(cells10: DataFrame, cells20: DataFrame, px60: DataFrame) -> DataFrame:
    """The five bands of the rule on the 10 m grid, from nested tables."""
    keys = ["scene_id", *block_keys(cells10), "y", "x"]
    joined = join_cells(cells10.select(*keys, "b02", "b03", "b04"), cells20.select(*keys, "b11"), px60.select(*keys, "b10"))
    return unnest(joined, 6, ("b02", "b03", "b04"), {"b11": 3})


def feature_stack(cells10: DataFrame, cells20: DataFrame, px60: DataFrame, offset: float, quantification: float) -> DataFrame:
    """All bands on the 60 m grid in instrument order, as ``model.feature_stack``: integers summed in the cell, divided once."""
    keys = ["scene_id", *block_keys(cells10), "y", "x"]
    parts = []
    for table, resolution in ((cells10, 10), (cells20, 20), (px60, 60)):
        bands = [b.lower() for b in BANDS_BY_RESOLUTION[resolution]]
        n = (60 // resolution) ** 2

        def total(band: str) -> Column:
            return F.aggregate(band, F.lit(0).cast("bigint"), lambda a, v: a + v) if n > 1 else F.col(band)

        parts.append(table.select(*keys, *[
            R.clip_reflectance(((total(b) / F.lit(float(n)) + F.lit(offset)) / F.lit(quantification)).cast("float")).alias(b) for b in bands]))
    return join_cells(*parts).select(*[k for k in keys if k not in FEATURES], *FEATURES)
