import math
import random

import pytest
from pyspark.sql import functions as F

from skysift.constants import FULL_GRID, QUANT_RANGES
from skysift.functions import geodesy
from skysift.functions import radiometry as R
from skysift.functions import tilemath as M
from skysift.functions.text import fixed_text
from skysift.operators import grid as G
from skysift.operators.detect import available, build


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def f(v):
    return R.f32(F.lit(v))


def test_brightness_and_ndsi(spark):
    r = one(spark, b=R.brightness(f(0.3), f(0.6), f(0.9)), same=R.ndsi(f(0.4), f(0.4)), zero=R.ndsi(f(0.0), f(0.0)))
    assert r.b == pytest.approx(0.6, abs=1e-6)
    assert (r.same, r.zero) == (0.0, 0.0)


@pytest.mark.parametrize("b03,b11,want", [
    (0.553, 0.605, -0.044), (0.202, 0.263, -0.130), (0.088, 0.143, -0.238), (0.069, 0.045, 0.217), (0.062, 0.015, 0.610)])
def test_ndsi_of_class_means(spark, b03, b11, want):
    assert one(spark, n=R.ndsi(f(b03), f(b11))).n == pytest.approx(want, abs=0.01)


@pytest.mark.parametrize("offset,want", [(-1000, 0.2), (-2000, 0.1), (0, 0.3)])
def test_reflectance_offset(spark, offset, want):
    assert one(spark, r=R.reflectance(F.lit(3000), offset, 10000.0)).r == pytest.approx(want, abs=1e-7)


def test_rule_is_strict(spark):
    at = R.cloud_rule(f(0.18), f(0.0), f(0.0), 0.18, -0.2, 0.005)
    over = R.cloud_rule(f(0.1801), f(0.0), f(0.0), 0.18, -0.2, 0.005)
    veto = R.cloud_rule(f(0.5), f(-0.25), f(0.0), 0.18, -0.2, 0.005)
    high = R.cloud_rule(f(0.0), f(-0.5), f(0.006), 0.18, -0.2, 0.005)
    r = one(spark, at=at, over=over, veto=veto, high=high)
    assert (r.at, r.over, r.veto, r.high) == (False, True, False, True)


def test_quantize_and_codes(spark):
    got = one(spark, q=F.array(*[R.quantize8(F.lit(v), 0.0, 1.0) for v in (-5.0, 0.0, 0.5, 1.0, 5.0)]),
              c=F.array(*[R.encode_prob24(F.lit(v)) for v in (-0.1, 0.0, 1.0, 1.2)]),
              t=R.quantized_threshold(0.33, *QUANT_RANGES["brightness"]))
    assert got.q == [0, 0, 128, 255, 255]
    assert got.c == [0, 0, 16777215, 16777215]
    assert got.t == round(0.33 * 255)


def test_integer_cut(spark):
    r = one(spark, ok=M.valid_rule(F.lit(90420), F.lit(0.0), 301401), over=M.valid_rule(F.lit(90421), F.lit(0.0), 301401),
            dark=M.valid_rule(F.lit(0), F.lit(1.0), 301401))
    assert (r.ok, r.over, r.dark) == (True, False, False)


def test_every_count_survives_printing(spark):
    px = FULL_GRID.tile_pixels
    text = F.format_string("%.6f", M.cloud_percent(F.col("id"), px))
    back = spark.range(px + 1).select("id", M.percent_to_count(text.cast("double"), px).alias("n"))
    assert back.filter("id != n").count() == 0


def test_agreement_example(spark):
    s = M.agreement_scores(*[F.lit(1)] * 4)
    r = one(spark, **s)
    assert (r.precision, r.recall, r.f1, r.pixel_agreement) == (0.5, 0.5, 0.5, 0.5)
    assert r.iou == pytest.approx(1 / 3)
    empty = one(spark, **M.agreement_scores(*[F.lit(0)] * 3, F.lit(9)))
    assert (empty.precision, empty.recall, empty.f1, empty.iou) == (0, 0, 0, 0)


def scene(spark):
    return spark.createDataFrame([(0, 32632, 600000.0, 5500020.0)], "scene_id bigint, epsg int, origin_e double, origin_n double")


def test_tile_box_of_the_full_grid(spark):
    tiles = G.tile_bbox(G.tile_grid(scene(spark), FULL_GRID), FULL_GRID)
    r = tiles.filter("tile_row = 6 and tile_col = 5").first()
    want = (49.29258, 10.75286, 49.34311, 10.83015)
    got = (r.min_latitude, r.min_longitude, r.max_latitude, r.max_longitude)
    assert got == pytest.approx(want, abs=2e-5)
    assert tiles.count() == 400


def test_tile_outside_the_grid_fails(spark):
    bad = scene(spark).withColumns({"tile_row": F.lit(20), "tile_col": F.lit(0)})
    with pytest.raises(Exception, match="outside the grid"):
        G.tile_utm_bounds(bad, FULL_GRID).collect()


@pytest.mark.parametrize("epsg,east,north", [(32632, 600000.0, 5500020.0), (32733, 312345.6, 7654321.0), (32601, 780000.0, 100.0)])
def test_projection_round_trip(spark, epsg, east, north):
    df = spark.createDataFrame([(epsg, east, north)], "epsg int, e double, n double")
    back = geodesy.with_utm(geodesy.with_lonlat(df, [("e", "n", "lat", "lon")]), [("lat", "lon", "e2", "n2")]).first()
    assert back.e2 == pytest.approx(east, abs=1e-5) and back.n2 == pytest.approx(north, abs=1e-5)
    assert (back.lat < 0) == (epsg // 100 == 327)


def test_fixed_text_rounds_like_c(spark):
    rng = random.Random(3)
    values = [0.2559375, 0.5, 0.0, 1.0, 0.0000005, 99.9999995, 2.5e-7, 1e-9, 100.0] + [rng.random() for _ in range(300)] + [
        rng.randrange(10**7) / 10**7 for _ in range(300)] + [rng.randrange(10**9) / 10**7 for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", fixed_text(F.col("v")).alias("t"))
    assert [r.t for r in df.collect()] == ["%.6f" % v for v in values]


def test_report_boxes_round_like_c(spark):
    """41.531934815 lies below the tie as a double; western and southern boxes keep their sign."""
    from skysift.sources.sinks import report_rows

    rng = random.Random(4)
    values = [41.531934815, -41.531934815, 179.999999995, -0.00000001, 0.0] + [rng.randrange(-18 * 10**10, 18 * 10**10) / 10**9 for _ in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "scene_id bigint, v double").select(
        "scene_id", F.lit(0).alias("tile_row"), F.lit(0).alias("tile_col"), *[F.col("v").alias(c) for c in ("min_latitude", "min_longitude", "max_latitude", "max_longitude")],
        F.lit(40.0).alias("cloud_cover_percent"), F.lit(True).alias("valid"))
    assert [r.max_longitude for r in report_rows(df).orderBy("scene_id").collect()] == ["%.8f" % v for v in values]


def test_exceeded_counts_thresholds(spark):
    import numpy as np

    from skysift.operators.sweep import CIRRUS_GRID, NDSI_GRID

    for grid in (CIRRUS_GRID, NDSI_GRID):
        marks = np.array(grid, dtype=np.float32)
        values = np.concatenate([marks, np.nextafter(marks, np.float32(9)), np.nextafter(marks, np.float32(-9)),
                                 np.linspace(marks[0] - 1, marks[-1] + 1, 101).astype(np.float32)])
        df = spark.createDataFrame([(float(v),) for v in values], "v double").select(R.f32(F.col("v")).alias("v"))
        got = [r.n for r in df.select(R.exceeded(F.col("v"), grid).alias("n")).collect()]
        assert got == [int((v > marks).sum()) for v in values]


def test_detector_registry():
    assert available() == ["class_mask", "model", "threshold"]
    with pytest.raises(ValueError, match="class_mask, model, threshold"):
        build("unknown")
