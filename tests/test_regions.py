"""Regions and rings against flood fill, for several block sizes."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from skysift.operators import outline as V
from skysift.operators import regions as C
from skysift.session import scratch_path
from skysift.sources import sinks as O

SHAPE = (14, 17)


def masks():
    rng = np.random.default_rng(11)
    ring = np.zeros(SHAPE, bool)
    ring[2:12, 3:14] = True
    ring[4:10, 5:12] = False
    ring[6, 7] = True
    spiral = rng.random(SHAPE) < 0.62
    return [ring, spiral, np.ones(SHAPE, bool), np.zeros(SHAPE, bool)]


def flood(m, eight=False):
    """Component label (first pixel) per true pixel."""
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if eight else [])
    label = {}
    for start in zip(*np.nonzero(m)):
        if start in label:
            continue
        name = int(start[0]) * m.shape[1] + int(start[1])
        stack = [start]
        label[start] = name
        while stack:
            y, x = stack.pop()
            for dy, dx in steps:
                p = (y + dy, x + dx)
                if 0 <= p[0] < m.shape[0] and 0 <= p[1] < m.shape[1] and m[p] and p not in label:
                    label[p] = name
                    stack.append(p)
    return label


def layer(raster):
    return raster(*masks(), name="on").select("scene_id", F.lit("cloud").alias("class"), "y", "x", "on")


@pytest.mark.parametrize("edge", [3, 5, 32])
def test_components(raster, edge):
    runs = C.mask_components(layer(raster), SHAPE, edge)
    got = {(r.scene_id, r.y, x): r.component for r in runs.collect() for x in range(r.x0, r.x1 + 1)}
    want = {(s, int(y), int(x)): c for s, m in enumerate(masks()) for (y, x), c in flood(m).items()}
    assert got == want


def test_holes(raster):
    stats = C.component_stats(C.mask_components(layer(raster), SHAPE, 5), 60).collect()
    for s, m in enumerate(masks()):
        background = flood(~np.pad(m, 1), eight=True)
        holes = len(set(background.values())) - 1
        mine = [r for r in stats if r.scene_id == s]
        assert sum(r.holes for r in mine) == holes
        assert sum(r.pixels for r in mine) == m.sum()


def ring_rows(raster, edge):
    runs = C.mask_components(layer(raster), SHAPE, edge)
    return V.polygon_rings(layer(raster), runs, SHAPE, edge)


def test_rings_do_not_depend_on_blocks(raster):
    found = [sorted(map(tuple, ring_rows(raster, e).collect())) for e in (3, 6, 40)]
    assert found[0] == found[1] == found[2]


def test_ring_areas_and_validity(raster):
    rings = ring_rows(raster, 4)
    assert V.ring_validity(rings).filter("not ok").count() == 0
    areas = {r.scene_id: r.px for r in rings.filter("seq = 0").groupBy("scene_id").agg(F.sum("pixels").alias("px")).collect()}
    assert areas == {s: int(m.sum()) for s, m in enumerate(masks()) if m.any()}


def test_geojson_is_a_document(spark, raster):
    scenes = spark.range(4).select(
        F.col("id").alias("scene_id"), F.lit(32632).alias("epsg"), F.lit(600000.0).alias("origin_e"), F.lit(5500020.0).alias("origin_n"))
    features = V.features_wgs84(ring_rows(raster, 4), scenes, 60)
    path = scratch_path(spark, "geojson-test")
    O.write_geojson(features, path)
    for s, m in enumerate(masks()[:3]):
        folder = os.path.join(path.removeprefix("file:"), f"scene_id={s}")
        parts = sorted(p for p in os.listdir(folder) if p.startswith("part-"))
        doc = json.loads("".join(open(os.path.join(folder, p)).read() for p in parts))
        assert doc["type"] == "FeatureCollection"
        assert len(doc["features"]) == len(set(flood(m).values()))
        for f in doc["features"]:
            assert f["properties"] == {"class": "cloud"}
            for ring in f["geometry"]["coordinates"]:
                assert ring[0] == ring[-1] and len(ring) >= 5
                assert all(10 < lon < 11 and 49 < lat < 50 for lon, lat in ring)
    area = V.feature_area(features).groupBy("scene_id").agg(F.sum("area_m2").alias("a")).collect()
    for r in area:
        assert r.a == pytest.approx(masks()[r.scene_id].sum() * 3600, rel=1e-3)


def test_crowded_rows_are_joined_by_bucket(raster):
    stripes = np.zeros((2, 40), bool)
    stripes[:, ::2] = True
    runs = C.mask_runs(raster(stripes, name="on").withColumn("class", F.lit("c")))
    pairs = C.run_overlap_join(runs, bucket=4).collect()
    assert sorted((r.x0_a, r.x0_b) for r in pairs) == [(x, x) for x in range(0, 40, 2)]


def noisy_scenes(raster, n=40):
    rng = np.random.default_rng(5)
    return raster(*[rng.random((12, 12)) < 0.5 for _ in range(n)], name="on").withColumn("class", F.lit("c"))


def test_helpers_are_called_by_rows_and_not_by_blocks(spark, raster, monkeypatch):
    calls = {name: spark.sparkContext.accumulator(0) for name in ("_block_runs", "_chains")}
    for module, name in ((C, "_block_runs"), (V, "_chains")):
        def counted(px, width, make=getattr(module, name), calls=calls[name]):
            calls.add(1)
            return make(px, width)

        monkeypatch.setattr(module, name, counted)
    layer = noisy_scenes(raster)
    V.polygon_rings(layer, C.mask_components(layer, (12, 12), 3), (12, 12), 3).count()
    # 640 blocks in eight partitions: one call for the whole blocks, one for the rest.
    assert all(0 < c.value <= 16 for c in calls.values())


@pytest.mark.parametrize("rows", [1, 7])
def test_blocks_are_whole_in_batches_of_any_size(spark, raster, rows):
    layer, setting = noisy_scenes(raster, 3), "spark.sql.execution.arrow.maxRecordsPerBatch"
    found = []
    for size in (10000, rows):
        spark.conf.set(setting, size)
        try:
            found.append(sorted(map(tuple, V.polygon_rings(layer, C.mask_components(layer, (12, 12), 5), (12, 12), 5).collect())))
        finally:
            spark.conf.unset(setting)
    assert found[0] == found[1]


def written(monkeypatch, *modules):
    """The names of tables written below the shared folder while the test runs."""
    from skysift import session

    names, cut = [], session.cut_lineage

    def seen(df, name="stage"):
        names.append(name)
        return cut(df, name)

    for module in (session, *modules):
        monkeypatch.setattr(module, "cut_lineage", seen)
    return names


def test_districts_spare_rounds(raster, monkeypatch):
    """What stays in a district takes no rounds over tables, and districts of any size give the same rings."""
    from skysift.operators import graph

    names = written(monkeypatch, C, V, graph)
    found = {}
    for fan in (1, 2, 8):
        names.clear()
        runs = C.mask_components(layer(raster), SHAPE, 3, fan)
        rings = V.polygon_rings(layer(raster), runs, SHAPE, 3, fan=fan)
        found[fan] = sorted(map(tuple, rings.collect())), len(names)
    assert found[1][0] == found[2][0] == found[8][0] and found[8][0]
    # Runs in blocks, links, labelled runs, edges, joined chains, ranks, rings.
    assert found[8][1] <= 7 < found[2][1]


def test_validity_and_area_in_pieces(raster, spark, monkeypatch):
    """A ring cut to pieces of three places has the same verdicts; a lost, doubled or slanted place is found."""
    monkeypatch.setattr(V, "SPAN", 3)
    monkeypatch.setattr(V.with_next, "__defaults__", (3,))
    traced = V.polygon_rings(layer(raster), C.mask_components(layer(raster), SHAPE, 5), SHAPE, 5).localCheckpoint()
    assert V.ring_validity(traced).filter("not ok").count() == 0
    placed = traced.select("scene_id").distinct().selectExpr("scene_id", "32632 as epsg", "600000d as origin_e", "5500020d as origin_n")
    areas = V.feature_area(V.features_wgs84(traced, placed, 60)).join(traced.filter("seq = 0").select("scene_id", "ring", "pixels", "n"), ["scene_id", "ring"])
    assert areas.count() > 0 and areas.filter("abs(area_m2 / 3600 - pixels) > 0.01 * abs(pixels) or sides <> n").count() == 0
    one = traced.orderBy(F.desc("n"), "scene_id", "ring").first()
    key = f"scene_id = {one.scene_id} and ring = {one.ring}"
    for at in (0, 2, 3, one.n):
        lost = traced.filter(f"not ({key} and seq = {at})")
        doubled = traced.unionByName(traced.filter(f"{key} and seq = {at}"))
        slanted = traced.withColumn("vx", F.expr(f"if({key} and seq = {at}, vx + 50, vx)")).withColumn("vy", F.expr(f"if({key} and seq = {at}, vy + 50, vy)"))
        for broken in (lost, slanted) if at == one.n else (lost, doubled, slanted):
            assert [(r.scene_id, r.ring) for r in V.ring_validity(broken).filter("not ok").collect()] == [(one.scene_id, one.ring)], at


def test_rings_inside_a_block_are_finished_there(raster, monkeypatch):
    """Outer rings that leave no block take part in no join; holes inside a block find their region."""
    names = written(monkeypatch, V)
    V.polygon_rings(layer(raster), C.mask_components(layer(raster), SHAPE, 32), SHAPE, 32)
    assert "rings" in names
    walked = []
    monkeypatch.setattr(V, "cut_lineage", lambda df, name="stage": walked.append(df.localCheckpoint()) or walked[-1])
    rings = V.polygon_rings(layer(raster), C.mask_components(layer(raster), SHAPE, 32), SHAPE, 32)
    holes = rings.filter("hole and seq = 0").count()
    assert walked[0].filter("is_chain").count() == holes > 0
    assert rings.filter("not hole and ring <> component * 4").count() == 0
    found = rings.filter("scene_id = 0 and seq = 0").orderBy("ring").collect()
    assert [(r.component, r.hole, r.pixels) for r in found] == [(2 * 17 + 3, False, 110), (2 * 17 + 3, True, -42), (6 * 17 + 7, False, 1)]


def test_geojson_table_has_a_file_a_task(spark, raster):
    """Thirty scenes are thirty documents, but no thirty folders."""
    small = noisy_scenes(raster, 30)
    scenes = spark.range(30).selectExpr("id as scene_id", "32632 as epsg", "600000d as origin_e", "5500020d as origin_n")
    features = V.features_wgs84(V.polygon_rings(small, C.mask_components(small, (12, 12), 5), (12, 12), 5), scenes, 60).localCheckpoint()
    table, folders = scratch_path(spark, "geojson-table"), scratch_path(spark, "geojson-folders")
    O.write_geojson_table(features, table)
    O.write_geojson(features, folders)
    names = os.listdir(table.removeprefix("file:"))
    assert not any("=" in n for n in names) and len([n for n in names if n.startswith("part-")]) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    for s in range(30):
        folder = os.path.join(folders.removeprefix("file:"), f"scene_id={s}")
        parts = sorted(p for p in os.listdir(folder) if p.startswith("part-"))
        lines = [r.value for r in spark.read.parquet(table).filter(f"scene_id = {s}").orderBy(*O.LINE_ORDER).collect()] if s < 3 else None
        if lines:
            assert json.loads("".join(lines)) == json.loads("".join(open(os.path.join(folder, p)).read() for p in parts))
    assert spark.read.parquet(table).groupBy("scene_id").count().count() == 30
