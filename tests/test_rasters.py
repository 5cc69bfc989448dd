"""Raster operators against brute force on small arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skysift.constants import FULL_GRID, SceneGrid
from skysift.operators import grid as G
from skysift.operators import neighborhood as N
from skysift.operators import resample as S
from skysift.operators import tiles as T


def image(df, column, shape, scenes=1, dtype=float):
    out = np.full((scenes, *shape), -1, dtype=dtype)
    for r in df.select("scene_id", "y", "x", column).collect():
        out[r.scene_id, r.y, r.x] = r[column]
    return out


def test_block_mean(raster):
    out = S.block_mean(raster(np.arange(36).reshape(6, 6)), ["v"], 6).collect()
    assert [(r.y, r.x, r.v) for r in out] == [(0, 0, 17.5)]


def test_ragged_block_fails(raster):
    with pytest.raises(Exception, match="ragged"):
        S.block_mean(raster(np.arange(30).reshape(5, 6)), ["v"], 3).collect()


def test_upsample_repeats(raster):
    a = np.arange(6).reshape(2, 3)
    got = image(S.upsample_nearest(raster(a), 3), "v", (6, 9))[0]
    assert np.array_equal(got, np.repeat(np.repeat(a, 3, 0), 3, 1))


@pytest.mark.parametrize("edge", [2, 5, 64])
def test_resize_linear(raster, edge):
    a = np.random.default_rng(1).integers(0, 1000, (7, 9))
    f = 4
    got = image(S.resize_linear(raster(a), "v", f, a.shape, edge=edge), "v", (28, 36))[0]

    def axis(n):
        src = (np.arange(n * f) + 0.5) / f - 0.5
        lo = np.floor(src).astype(int)
        return np.clip(lo, 0, n - 1), np.clip(lo + 1, 0, n - 1), src - lo

    y0, y1, wy = axis(7)
    x0, x1, wx = axis(9)
    top = a[y0][:, x0] * (1 - wx) + a[y0][:, x1] * wx
    low = a[y1][:, x0] * (1 - wx) + a[y1][:, x1] * wx
    assert np.allclose(got, top * (1 - wy)[:, None] + low * wy[:, None])


def disk(radius):
    span = np.arange(-radius, radius + 1)
    return [(dy, dx) for dy in span for dx in span if dy * dy + dx * dx <= radius * radius]


def brute_average(a, radius):
    pad = np.pad(a.astype(np.int64), radius, mode="symmetric")
    h, w = a.shape
    total = sum(pad[radius + dy:radius + dy + h, radius + dx:radius + dx + w] for dy, dx in disk(radius))
    return total / (len(disk(radius)) * 2.0**24)


def brute_dilate(m, radius):
    pad = np.pad(m, radius)
    h, w = m.shape
    return np.any([pad[radius + dy:radius + dy + h, radius + dx:radius + dx + w] for dy, dx in disk(radius)], axis=0)


@pytest.mark.parametrize("radius,edge", [(1, 4), (3, 4), (3, 50)])
def test_disks(raster, radius, edge):
    rng = np.random.default_rng(radius)
    a = [rng.integers(0, 2**24, (11, 13)) for _ in range(2)]
    avg = image(N.disk_average(raster(*a), "v", radius, (11, 13), edge=edge), "prob", (11, 13), 2)
    assert np.allclose(avg, [brute_average(x, radius) for x in a], rtol=0, atol=1e-15)
    m = [x > 2**24 * 0.93 for x in a]
    got = image(N.disk_dilate(raster(*m), "v", radius, (11, 13), edge=edge), "v", (11, 13), 2, bool)
    assert np.array_equal(got, [brute_dilate(x, radius) for x in m])


@pytest.mark.parametrize("avg,dil", [(None, None), (2, None), (None, 2), (2, 1)])
def test_morphology_chain(raster, avg, dil):
    a = np.random.default_rng(9).integers(0, 2**24, (12, 10))
    got = image(N.prob_morph_mask(raster(a), "v", 0.6, avg, dil, a.shape, edge=5), "cloud", a.shape, dtype=bool)[0]
    field = brute_average(a, avg) if avg else a / 2.0**24
    want = brute_dilate(field > 0.6, dil) if dil else field > 0.6
    assert np.array_equal(got, want)


def test_outline_counts_the_raster_edge(raster):
    m = np.zeros((6, 6), bool)
    m[0:4, 1:5] = True
    got = image(N.mask_outline(raster(m), "v", m.shape, edge=3), "outline", m.shape, dtype=bool)[0]
    want = m.copy()
    want[1:3, 2:4] = False
    assert np.array_equal(got, want)


def test_overlap_weights_of_the_full_grid(spark):
    px = spark.range(1830).select(F.lit(0).alias("scene_id"), F.col("id").cast("int").alias("y"), F.lit(91).alias("x"))
    parts = S.overlap_weighted(px, FULL_GRID, 6)
    per_pixel = parts.groupBy("y").agg(F.sum("weight").alias("w"), F.count("*").alias("n"))
    assert per_pixel.filter("w != 36").count() == 0
    assert per_pixel.agg(F.max("n")).first()[0] == 4
    per_tile = parts.groupBy("tile_row").agg(F.sum("weight").alias("w")).collect()
    assert len(per_tile) == 20 and {r.w for r in per_tile} == {549 * 6}


def test_weights_equal_enlarging(raster):
    grid = SceneGrid(tile_px=15, rows=2, cols=4)
    m = np.random.default_rng(4).random((5, 10)) < 0.3
    px = G.with_block(raster(m), grid, 60)
    fast = S.overlap_tile_counts(px, grid, 6, ["v"]).select("scene_id", "tile_row", "tile_col", "pixels", "v")
    slow = T.fine_tile_counts(S.upsample_nearest(px, 6), grid, ["v"]).select("scene_id", "tile_row", "tile_col", "pixels", "v")
    assert fast.exceptAll(slow).count() == 0 and fast.count() == slow.count() == 8


def test_partial_tile_fails(raster):
    grid = SceneGrid(tile_px=3, rows=1, cols=1)
    px = raster(np.ones((2, 3), bool)).withColumn("nodata", F.lit(False))
    with pytest.raises(Exception, match="not complete"):
        T.tile_stats(T.fine_tile_counts(px, grid, ["v", "nodata"]), grid, cloud="v").collect()


def test_mean_of_tiles_is_the_scene(raster):
    grid = SceneGrid(tile_px=3, rows=2, cols=2)
    m = np.random.default_rng(5).random((6, 6)) < 0.4
    px = raster(m).withColumn("nodata", F.lit(False))
    stats = T.tile_stats(T.fine_tile_counts(px, grid, ["v", "nodata"]), grid, cloud="v")
    assert T.scene_cloud_percent(stats, grid).first().scene_cloud_percent == pytest.approx(100 * m.mean())
