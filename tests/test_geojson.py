"""Delivered documents: read back in splits, and each fault found."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from skysift.operators import checks as H
from skysift.operators import outline as V
from skysift.operators import regions as C
from skysift.session import scratch_path
from skysift.sources import geojson as J
from skysift.sources import sinks as O
from test_regions import SHAPE, masks

PX = 3600


def scenes(spark, n):
    out = spark.range(n).select(
        F.col("id").alias("scene_id"), F.lit(32632).alias("epsg"), F.lit(600000.0).alias("origin_e"), F.lit(5500020.0).alias("origin_n"))
    return out.withColumns({"min_latitude": F.lit(49.63), "min_longitude": F.lit(10.38), "max_latitude": F.lit(49.65), "max_longitude": F.lit(10.41)})


def written(spark, raster, arrays):
    """Folder of the documents of some masks."""
    layer = raster(*arrays, name="on").select("scene_id", F.lit("cloud").alias("class"), "y", "x", "on")
    rings = V.polygon_rings(layer, C.mask_components(layer, SHAPE, 5), SHAPE, 5)
    path = scratch_path(spark, "geojson-test")
    O.write_geojson(V.features_wgs84(rings, scenes(spark, len(arrays)), 60), path)
    return path


def lines_of(path, scene):
    parts = sorted(glob.glob(os.path.join(path.removeprefix("file:"), f"scene_id={scene}", "part-*")))
    return "".join(open(p).read() for p in parts).splitlines()


def rewrite(spark, *documents):
    """Folder of one file per scene, from lists of lines."""
    path = scratch_path(spark, "geojson-edited")
    for s, lines in enumerate(documents):
        folder = os.path.join(path.removeprefix("file:"), f"scene_id={s}")
        os.makedirs(folder)
        with open(os.path.join(folder, "part-00000.txt"), "w") as f:
            f.write("\n".join(lines) + "\n")
    return path


@pytest.mark.parametrize("split", [None, "700"])
def test_points_are_those_of_the_document(spark, raster, split):
    """However small the splits: rings, places and sides as a JSON reader finds them."""
    path = written(spark, raster, masks()[:3])
    path = rewrite(spark, *[lines_of(path, s) for s in range(3)])
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = J.scan_geojson(spark, path).collect()
        splits = spark.read.text(path).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert (splits > 6 if split else splits <= 3) and not any(r.bad for r in rows)
    got = sorted((r.scene_id, r["class"], r.feature, r.ring, r.hole, r.seq, r.lon, r.lat) for r in rows if r.kind == "P")
    want, came = [], {}
    for s in range(3):
        ring_no = 0
        for f, feature in enumerate(json.loads("".join(lines_of(path, s)))["features"], 1):
            for i, ring in enumerate(feature["geometry"]["coordinates"]):
                ring_no += 1
                for seq, (lon, lat) in enumerate(ring):
                    want.append((s, "cloud", f, ring_no, i > 0, seq, lon, lat))
                    if seq:
                        came[s, ring_no, seq] = tuple(ring[seq - 1])
    assert got == sorted(want)
    assert {(r.scene_id, r.ring, r.seq): (r.lon0, r.lat0) for r in rows if r.kind == "P" and r.seq} == came


def square(y, x, side, hole=False):
    ring = [(y, x), (y, x + side), (y + side, x + side), (y + side, x)]
    return ring[::-1] if hole else ring


def check(spark, *cases):
    """Check rows of (lines, pixels of the mask, promised features), one scene each, in order."""
    path = rewrite(spark, *[lines for lines, _, _ in cases])
    mask = spark.createDataFrame([(s, "cloud", float(px * PX)) for s, (_, px, _) in enumerate(cases)], "scene_id bigint, class string, area_m2 double")
    promised = spark.createDataFrame([(s, n) for s, (_, _, n) in enumerate(cases)], "scene_id bigint, features bigint")
    rows = H.check_geojson(J.scan_geojson(spark, path, scenes(spark, len(cases))), mask, SHAPE, 60, promised).orderBy("scene_id").collect()
    assert [r.scene_id for r in rows] == list(range(len(cases)))
    return rows


@pytest.fixture(scope="module")
def degrees(spark):
    """Corner (y, x) of the test scene -> printed longitude and latitude."""
    from skysift.functions import geodesy

    corners = scenes(spark, 1).select("*", F.explode(F.sequence(F.lit(0), F.lit(SHAPE[0] + 4))).alias("y")).select("*", F.explode(F.sequence(F.lit(0), F.lit(SHAPE[1] + 4))).alias("x"))
    e, n = geodesy.pixel_to_map(F.col("origin_e"), F.col("origin_n"), F.col("y"), F.col("x"), 60)
    rows = geodesy.with_lonlat(corners.withColumns({"e": e, "n": n}), [("e", "n", "lat", "lon")]).collect()
    return {(r.y, r.x): (r.lon, r.lat) for r in rows}


@pytest.fixture
def paper(degrees):
    """Lines of a document of features, each a list of rings over corners."""

    def draw(*features, swap=False):
        out = ['{"type":"FeatureCollection","features":[']
        for i, rings in enumerate(features):
            out.append(("," if i else "") + '{"type":"Feature","properties":{"class":"cloud"},"geometry":{"type":"Polygon","coordinates":[')
            for j, ring in enumerate(rings):
                out.append(",[" if j else "[")
                for k, corner in enumerate([*ring, ring[0]]):
                    a, b = degrees[corner]
                    out.append(("," if k else "") + "[%.6f,%.6f]" % ((b, a) if swap else (a, b)))
                out.append("]")
            out.append("]}}")
        return out + ["]}"]

    return draw


def test_sound_documents_pass(spark, paper):
    rows = check(
        spark, (paper([square(1, 1, 6), square(3, 3, 2, hole=True)]), 32, 1),
        # Rings that touch in corners only: two holes, two regions.
        (paper([square(1, 1, 6), square(2, 2, 2, hole=True), square(4, 4, 2, hole=True)]), 28, 1),
        (paper([square(1, 1, 2)], [square(3, 3, 2)]), 8, 2))
    assert [r.detail for r in rows] == ["1 features, 2 rings", "1 features, 3 rings", "2 features, 2 rings"]
    assert all(r.ok for r in rows)


def test_each_fault_is_named(spark, paper):
    whole = [square(1, 1, 6), square(3, 3, 2, hole=True)]
    nested = [square(0, 0, 8), square(1, 1, 6, hole=True), square(3, 3, 2, hole=True)]
    # Two strokes of one ring cross at (3, 3).
    bow = [(1, 1), (1, 3), (5, 3), (5, 5), (3, 5), (3, 1)]
    cases = [
        ("outside the footprint", paper(whole, swap=True), 32, 1),
        ("holes outside", paper([square(1, 1, 6), square(8, 8, 2, hole=True)]), 32, 1),
        ("holes outside", paper(nested), 24, 1),
        ("features missing", paper(whole), 32, 2),
        ("area differs", paper(whole), 33, 1),
        ("rings cross", paper([bow]), 8, 1),
        # A hole that cuts through its shell, one that equals it, one along its side.
        ("rings cross", paper([square(1, 1, 6), square(5, 5, 4, hole=True)]), 20, 1),
        ("rings cross", paper([square(1, 1, 6), square(1, 1, 6, hole=True)]), 0, 1),
        ("rings cross", paper([square(1, 1, 6), square(1, 3, 2, hole=True)]), 32, 1),
        ("rings broken", paper([[(1, 1), (1, 5), (5, 6), (5, 1)]]), 18, 1),
    ]
    for (fault, *_), row in zip(cases, check(spark, *[c[1:] for c in cases])):
        assert not row.ok and fault in row.detail, (fault, row.detail)


def test_damaged_text(spark, paper):
    lines = paper([square(1, 1, 6), square(3, 3, 2, hole=True)], [square(9, 9, 2)])
    damaged = [lines[:kept] for kept in range(1, len(lines))] + [
        [*lines[:4], "oops", *lines[4:]], [*lines[:3], lines[3].lstrip("["), *lines[4:]], [*lines, "]}"], lines[1:],
        # A comma that is not there, and one too many.
        [*lines[:5], lines[5].lstrip(","), *lines[6:]], [*lines[:2], "," + lines[2], *lines[3:]]]
    for row in check(spark, *[(d, 36, 2) for d in damaged]):
        assert not row.ok and "document incomplete" in row.detail, row


def test_scenes_without_documents(spark, paper):
    path = rewrite(spark, paper([square(1, 1, 6)]))
    mask = spark.createDataFrame([(s, "cloud", a) for s, a in ((0, 36.0 * PX), (1, 36.0 * PX), (2, 0.0), (3, 36.0 * PX))], "scene_id bigint, class string, area_m2 double")
    promised = spark.createDataFrame([(0, 1), (1, 1), (2, 0)], "scene_id bigint, features bigint")
    rows = {r.scene_id: r for r in H.check_geojson(J.scan_geojson(spark, path, scenes(spark, 4)), mask, SHAPE, 60, promised).collect()}
    assert [rows[s].ok for s in range(4)] == [True, False, True, True]
    assert [rows[s].skipped for s in range(4)] == [False, False, False, True]
    assert rows[1].detail == "0 features, 0 rings; area differs; features missing"


def test_written_masks_pass(spark, raster):
    arrays = masks()[:3]
    path = written(spark, raster, arrays)
    area = spark.createDataFrame([(s, "cloud", float(m.sum() * PX)) for s, m in enumerate(arrays)], "scene_id bigint, class string, area_m2 double")
    layer = raster(*arrays, name="on").select("scene_id", F.lit("cloud").alias("class"), "y", "x", "on")
    promised = C.component_stats(C.mask_components(layer, SHAPE, 5), 60).groupBy("scene_id").agg(F.count(F.lit(1)).alias("features"))
    rows = H.check_geojson(J.scan_geojson(spark, path, scenes(spark, 3)), area, SHAPE, 60, promised).collect()
    assert len(rows) == 3 and all(r.ok and not r.skipped for r in rows), rows
