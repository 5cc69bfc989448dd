"""Rasters derived from the ``orders`` table.

Each run of 1500 consecutive order keys is one 30 x 50 scene at 60 m; the 20 m
and 10 m rasters are expanded from it. ``PRELUDE`` states the same views for the
SQL side.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.constants import BANDS_BY_RESOLUTION, SceneGrid
from skysift.functions import radiometry as R
from skysift.operators import grid as G
from skysift.session import tune
from skysift.sources import pixels as P

GRID = SceneGrid(tile_px=15, rows=12, cols=20)
EPSG = 32632
OFFSET, QUANT = -1000.0, 10000.0
COARSE_SHAPE = GRID.shape(60)
FINE_SHAPE = GRID.shape(10)
# Neighbourhood block, in 60 m pixels; spans the fixture's small scene.
EDGE = 32
RULE_A = {"t_bright": 0.30, "t_ndsi": -0.20, "t_cirrus": 0.0110}
MODEL_THRESHOLD = 0.6
NAMED = ((11, 2, "genuinely clear"), (6, 5, "moderate cloud"), (5, 16, "heavy cloud"), (10, 19, "thin cirrus veil"))

# Spread of the bands that the five-band views do not define: name -> (divisor, modulus).
EXTRA60 = {
    "b01": (23, 4000), "b05": (31, 4500), "b06": (37, 4500), "b07": (41, 4500), "b08": (43, 5500),
    "b8a": (47, 5500), "b09": (29, 3000), "b12": (53, 5000),
}
TWENTY = {"b05": 31, "b06": 37, "b07": 41, "b8a": 43, "b11": 29, "b12": 47}
# Bands enlarged from a coarse row; i and j are row and column inside its cell.
BANDS20 = {b: f"{b} + ((i * 3 + j) * {m}) % 53" for b, m in TWENTY.items()}
BANDS10 = {
    "b02": "case when b02 = 0 then 0 else b02 + ((i * 6 + j) * 37) % 101 end",
    "b03": "b03 + ((i * 6 + j) * 41) % 103",
    "b04": "b04 + ((i * 6 + j) * 43) % 107",
    "b08": "b08 + ((i * 6 + j) * 47) % 109",
    "r": "(b04 + i * 7 + j) % 256",
    "g": "(b03 + i + j * 5) % 256",
    "b": "(b02 + i * 3 + j * 2) % 256",
}


def px60(spark: SparkSession, sf_dir: str, placed: bool = False) -> DataFrame:
    """One row per 60 m pixel, every band averaged to that grid.

    ``placed`` hash-partitions by block, which pays before a join of several
    resolutions only; projections and sums need no exchange of pixels.
    """
    orders = tune(spark).read.parquet(f"{sf_dir}/orders.parquet")
    base = orders.select(
        F.col("o_orderkey").cast("bigint").alias("k"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("p"),
        F.col("o_custkey").cast("bigint").alias("c"),
    )
    scene = F.expr("k div 1500")
    y = F.expr("cast((k % 1500) div 50 as int)")
    x = F.expr("cast(k % 50 as int)")
    out = base.select(
        scene.alias("scene_id"), y.alias("y"), x.alias("x"), "k", "p",
        F.expr("case when k % 97 = 0 then 0 else 1000 + p % 6000 end").alias("b02"),
        F.expr("1000 + (p div 7) % 6000").alias("b03"),
        F.expr("1000 + (p div 11) % 6000").alias("b04"),
        F.expr("1000 + (p div 13) % 5000").alias("b11"),
        F.expr("1000 + (c * 31 + p) % 120").alias("b10"),
        F.expr("(p div 17) % 5 = 0").alias("opaque"),
        F.expr("(p div 17) % 5 <> 0 and (p div 19) % 11 = 0").alias("cirrus"),
        F.lit(False).alias("snow"),
        F.expr("(p * 2654435761) % 16777216").alias("q24"),
        *[F.expr(f"1000 + (p div {d}) % {m}").alias(b) for b, (d, m) in EXTRA60.items()],
    )
    out = G.with_block(out, GRID, 60)
    return G.place(out) if placed else out


def _expand(px: DataFrame, factor: int) -> DataFrame:
    cell = F.explode(F.sequence(F.lit(0), F.lit(factor * factor - 1))).alias("_cell")
    return px.select("*", cell).withColumns({
        "i": G.idiv(F.col("_cell"), factor), "j": F.col("_cell") % factor,
    })


def _fine(px: DataFrame, factor: int, columns: dict[str, Column]) -> DataFrame:
    return _expand(px, factor).select(
        "scene_id", "brow", "bcol",
        (F.col("y") * factor + F.col("i")).alias("y"), (F.col("x") * factor + F.col("j")).alias("x"),
        *[c.alias(n) for n, c in columns.items()],
    )


Window = tuple[int, int, int, int]


def _within(px: DataFrame, window: Window | None, factor: int) -> DataFrame:
    """Drop coarse rows outside the fine window before they are expanded."""
    if window is None:
        return px
    y0, y1, x0, x1 = window
    return px.filter(
        F.col("y").between(y0 // factor, (y1 - 1) // factor) & F.col("x").between(x0 // factor, (x1 - 1) // factor))


def _clip(px: DataFrame, window: Window | None) -> DataFrame:
    if window is None:
        return px
    y0, y1, x0, x1 = window
    return px.filter((F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1))


def px20(spark: SparkSession, sf_dir: str, window: Window | None = None, placed: bool = True) -> DataFrame:
    """20 m bands. ``placed`` deals out the coarse rows by block before they are enlarged."""
    cols = {b: F.expr(e) for b, e in BANDS20.items()}
    return _clip(_fine(_within(px60(spark, sf_dir, placed), window, 3), 3, cols), window)


def px10(spark: SparkSession, sf_dir: str, window: Window | None = None, placed: bool = True) -> DataFrame:
    """10 m bands and the display RGB; a (y0, y1, x0, x1) window reads less, ``placed`` as above."""
    cols = {b: F.expr(e) for b, e in BANDS10.items()}
    return _clip(_fine(_within(px60(spark, sf_dir, placed), window, 6), 6, cols), window)


def rows10(spark: SparkSession, sf_dir: str, bands: list[str]) -> DataFrame:
    """10 m bands with the coarse rows dealt by scene and block row, as ``write_scene_folders`` stores them."""
    return _fine(P.deal_rows(px60(spark, sf_dir)), 6, {b: F.expr(BANDS10[b]) for b in bands})


def _cells(px: DataFrame, factor: int, columns: dict[str, str]) -> DataFrame:
    def place(expr: str, p: int) -> str:
        at = {"i": str(p // factor), "j": str(p % factor)}
        return re.sub(r"\b[ij]\b", lambda m: at[m.group()], expr)

    arrays = {b: F.array(*[F.expr(place(e, p)) for p in range(factor * factor)]) for b, e in columns.items()}
    return px.select("scene_id", "brow", "bcol", "y", "x", *[a.alias(b) for b, a in arrays.items()])


def cells20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 m bands as they are stored by cell: nine to a row."""
    return _cells(px60(spark, sf_dir, placed=True), 3, BANDS20)


def cells10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 m bands as they are stored by cell: 36 to a row."""
    return _cells(px60(spark, sf_dir, placed=True), 6, {b: e for b, e in BANDS10.items() if len(b) > 1})


def refl(band: str) -> Column:
    return R.reflectance(F.col(band), OFFSET, QUANT)


def rule_columns() -> tuple[Column, Column, Column]:
    """Brightness, NDSI and cirrus-band reflectance of a five-band row."""
    return (
        R.brightness(refl("b02"), refl("b03"), refl("b04")),
        R.ndsi(refl("b03"), refl("b11")),
        refl("b10"),
    )


def masks60(spark: SparkSession, sf_dir: str) -> DataFrame:
    """60 m masks: a (band rule), b (probability), ref (class mask), nodata."""
    bright, slope, r10 = rule_columns()
    return px60(spark, sf_dir).select(
        "scene_id", "brow", "bcol", "y", "x", "b02", "b03", "b04", "b10", "b11", "opaque", "cirrus", "snow", "q24",
        R.cloud_rule(bright, slope, r10, **RULE_A).alias("a"),
        R.prob24_mask(F.col("q24"), MODEL_THRESHOLD).alias("b"),
        R.class_union(F.col("opaque"), F.col("cirrus")).alias("ref"),
        R.nodata_flag(F.col("b02")).alias("nodata"),
    )


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene list with the geocoding of each."""
    ids = px60(spark, sf_dir, placed=False).groupBy("scene_id").agg(
        F.count(F.lit(1)).alias("cells"),
        (F.sum((F.col("opaque") | F.col("cirrus")).cast("int")) * 100.0 / F.count(F.lit(1))).alias("cloud_pct"),
        (F.sum(F.col("snow").cast("int")) * 100.0 / F.count(F.lit(1))).alias("snow_pct"),
    )
    return with_geocoding(ids)


def with_geocoding(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "epsg": F.lit(EPSG),
        "origin_e": F.expr("cast(600000 + 3000 * (scene_id % 10) as double)"),
        "origin_n": F.expr("cast(5500020 - 1800 * (scene_id div 10) as double)"),
    })


def _sql_bands(template: str, names: dict) -> str:
    return ", ".join(template.format(b=b, m=m) for b, m in names.items())


def _idiv(a: str, b: int | str) -> str:
    return f"cast(({a} - ({a}) % {b}) / {b} as bigint)"


def _sql_refl(band: str) -> str:
    return f"cast((cast({band} as float) + cast(-1000 as float)) / cast(10000 as float) as float)"


_extra = ", ".join(f"1000 + {_idiv('p', d)} % {m} as {b}" for b, (d, m) in EXTRA60.items())

PRELUDE = f"""
k0 as (select cast(o_orderkey as bigint) as k, cast(round(o_totalprice*100) as bigint) as p,
              cast(o_custkey as bigint) as c from orders),
i6 as (select cast(range as bigint) as i from range(6)),
j6 as (select cast(range as bigint) as j from range(6)),
px60 as (
  select {_idiv('k', 1500)} as scene_id, {_idiv('(k % 1500)', 50)} as y, k % 50 as x, k, p,
    case when k % 97 = 0 then 0 else 1000 + p % 6000 end as b02,
    1000 + {_idiv('p', 7)} % 6000 as b03, 1000 + {_idiv('p', 11)} % 6000 as b04,
    1000 + {_idiv('p', 13)} % 5000 as b11, 1000 + (c*31 + p) % 120 as b10,
    ({_idiv('p', 17)} % 5 = 0) as opaque,
    ({_idiv('p', 17)} % 5 <> 0 and {_idiv('p', 19)} % 11 = 0) as cirrus, false as snow,
    (p * 2654435761) % 16777216 as q24, {_extra}
  from k0),
px20 as (
  select scene_id, y*3 + i as y, x*3 + j as x, {_sql_bands('{b} + ((i*3+j)*{m}) % 53 as {b}', TWENTY)}
  from px60 cross join i6 cross join j6 where i < 3 and j < 3),
px10 as (
  select scene_id, y*6 + i as y, x*6 + j as x,
    case when b02 = 0 then 0 else b02 + ((i*6+j)*37) % 101 end as b02,
    b03 + ((i*6+j)*41) % 103 as b03, b04 + ((i*6+j)*43) % 107 as b04, b08 + ((i*6+j)*47) % 109 as b08,
    (b04 + i*7 + j) % 256 as r, (b03 + i + j*5) % 256 as g, (b02 + i*3 + j*2) % 256 as b
  from px60 cross join i6 cross join j6),
r60 as (
  select *, {_sql_refl('b02')} as r02, {_sql_refl('b03')} as r03, {_sql_refl('b04')} as r04,
    {_sql_refl('b11')} as r11, {_sql_refl('b10')} as r10 from px60),
t60 as (
  select *, cast((r02+r03+r04)/cast(3 as float) as float) as bright,
    case when r03+r11 <> 0 then cast((r03-r11)/(r03+r11) as float) else cast(0 as float) end as ndsi from r60),
det as (
  select *, ((bright > cast(0.30 as float) and ndsi > cast(-0.20 as float)) or r10 > cast(0.0110 as float)) as a,
    (cast(q24 as double) > cast(0.6 as double) * 16777216) as b, (opaque or cirrus) as ref, (b02 = 0) as nodata from t60),
ids as (select distinct scene_id from px60),
tgrid as (
  select scene_id, cast(r.range as bigint) as tile_row, cast(c.range as bigint) as tile_col
  from ids cross join range(12) r cross join range(20) c),
fine_det as (
  select scene_id, {_idiv('(y*6+i)', 15)} as tile_row, {_idiv('(x*6+j)', 15)} as tile_col,
    y*6+i as fy, x*6+j as fx, y, x, a, b, ref, nodata, q24
  from det cross join i6 cross join j6),
tiles_wide as (
  select scene_id, tile_row, tile_col, count(*) as pixels,
    count(*) filter (a) as a, count(*) filter (b) as b, count(*) filter (ref) as ref, count(*) filter (nodata) as nodata
  from fine_det group by all),
tiles as (
  select scene_id, tile_row, tile_col, detector, cnt as cloud_pixels,
    1e2 * cnt / 225 as cloud_cover_percent, cast(nodata as double) / 225 as nodata_fraction,
    (100*cnt <= 30*225 and cast(nodata as double)/225 <= 0.5) as valid
  from (select scene_id, tile_row, tile_col, nodata, unnest(['threshold','model','class_mask']) as detector,
               unnest([a, b, ref]) as cnt from tiles_wide))
"""


def sql(body: str, views: str = "", recursive: bool = False) -> str:
    """A query over the derived views; ``views`` adds further named ones."""
    extra = f",\n{views}" if views else ""
    return f"with {'recursive ' if recursive else ''}{PRELUDE}{extra}\n{body}"
