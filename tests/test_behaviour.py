"""Sweeps, readers, errors, plans and partition independence."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from skysift.constants import SceneGrid
from skysift.operators import checks as H
from skysift.operators import detect
from skysift.operators import sweep as W
from skysift.operators.model import check_order
from skysift.plans import fixtures as X
from skysift.session import scratch_path
from skysift.sources import sinks as O
from skysift.sources import tables as L

SF = "/root/testdata/sf0.001"
QUERIES = entry_module.queries()


def plan(df):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_histogram_sweep_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    n = 400
    b, s, c = (rng.random(n).astype(np.float32), (rng.random(n) - 0.5).astype(np.float32), (rng.random(n) / 50).astype(np.float32))
    ref = rng.random(n) < 0.4
    px = spark.createDataFrame([tuple(map(float, r)) for r in zip(b, s, c, ref)], "b double, s double, c double, ref double")
    grids = ([0.2, 0.4, 0.6], [-0.2, 0.0, 0.2], [0.005, 0.010, 0.015])
    got = W.threshold_sweep(px, F.col("b").cast("float"), F.col("s").cast("float"), F.col("c").cast("float"), F.col("ref") > 0, *grids).collect()
    assert len(got) == 3 * 4 * 4
    for r in got:
        white = (b > np.float32(r.t_bright)) & ((s > np.float32(r.t_ndsi)) if r.t_ndsi is not None else True)
        cloud = white | ((c > np.float32(r.t_cirrus)) if r.t_cirrus is not None else False)
        tp, fp, fn = (cloud & ref).sum(), (cloud & ~ref).sum(), (~cloud & ref).sum()
        assert r.iou == pytest.approx(tp / (tp + fp + fn) if tp + fp + fn else 0.0)
        assert r.scene_cloud_percent == pytest.approx(100 * cloud.mean())


NARROW = ["tile_stats", "prob_curve", "threshold_sweep", "disk_average", "mask_components"]


@pytest.mark.parametrize("name", NARROW)
def test_result_does_not_depend_on_partitions(spark, name):
    seen = []
    try:
        for width in (1, 4, 64):
            spark.conf.set("spark.sql.shuffle.partitions", width)
            seen.append(sorted(map(repr, QUERIES[name](spark, SF).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert seen[0] == seen[1] == seen[2]


@pytest.fixture
def large_tables(spark):
    """Plans as for tables beyond the broadcast limit."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pixels_move_once_per_source(spark, large_tables):
    """Placement is the only exchange of pixel rows: joins and the aggregate stay in place."""
    text = plan(QUERIES["multires_join"](spark, SF))
    assert len(re.findall(r"Exchange hashpartitioning\(scene_id#\d+L, brow#\d+, bcol#\d+, 8\)", text)) == 3
    assert text.count("Exchange") == 3


@pytest.mark.parametrize("name", ["tile_stats", "prob_sweep", "threshold_sweep", "prob_curve", "resolution_agreement", "disk_dilate", "feature_stack"])
def test_pixel_paths_stay_in_the_jvm(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "Python" not in text and "Pandas" not in text
    assert "SinglePartition" not in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scan_reads_only_what_it_needs(spark):
    text = plan(QUERIES["nodata_flag"](spark, SF))
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>", text)


def test_window_scan_is_pushed_down(spark):
    text = plan(QUERIES["scan_band_window"](spark, SF))
    assert "ReadSchema: struct<y:int,x:int,b03:bigint>" in text
    assert "GreaterThanOrEqual(y,40), LessThan(y,110), GreaterThanOrEqual(x,33)" in text
    from skysift.sources import pixels as P

    path = scratch_path(spark, "prune")
    P.write_scene_folders(X.px60(spark, "/root/testdata/sf0.01").select("scene_id", "y", "x", "b02"), X.GRID, 60, path)
    one = P.scan_window(spark, path, "scene_id bigint, y int, x int, b02 bigint", ["b02"], scenes=[3])
    assert "PartitionFilters: [isnotnull(scene_id" in plan(one) and one.count() == 1500


def test_bucketed_tables_need_no_exchange(spark, large_tables):
    from skysift.operators import tiles as T
    from skysift.sources import pixels as P

    names = {}
    for res, px in ((10, X.px10(spark, SF)), (20, X.px20(spark, SF)), (60, X.px60(spark, SF))):
        names[res] = f"px{res}_stored"
        spark.sql(f"drop table if exists {names[res]}")
        P.store_by_block(px, X.GRID, res, names[res], 4, scratch_path(spark, names[res]))
    stack = detect.fine_stack(*[spark.table(names[r]) for r in (10, 20, 60)])
    rule = detect.build("threshold", **X.RULE_A)
    counts = T.fine_tile_counts(rule(stack), X.GRID, ["cloud"])
    assert "Exchange" not in plan(counts)
    want = QUERIES["tile_stats"](spark, SF).select("scene_id", "tile_row", "tile_col", "cloud_pixels")
    got = counts.select("scene_id", F.col("tile_row").cast("bigint"), F.col("tile_col").cast("bigint"), "cloud")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def config(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "raw string")


def test_config_rules(spark):
    schema, keys = "prob_threshold double, average_over int", ["prob_threshold", "average_over"]
    row = L.parse_config(config(spark, '{"prob_threshold": 0.6, "average_over": null}'), "raw", schema, keys).first()
    assert (row.prob_threshold, row.average_over) == (0.6, None)
    for bad in ('{"prob_threshold": 0.6}', '{"prob_threshold": ', "[]"):
        with pytest.raises(Exception):
            L.parse_config(config(spark, bad), "raw", schema, keys).collect()
    r = spark.range(1).select(
        L.effective(F.lit(0.5), F.lit(0.6), 0.4).alias("a"), L.effective(F.lit(None).cast("double"), F.lit(0.6), 0.4).alias("b"),
        L.effective(F.lit(None).cast("double"), F.lit(None).cast("double"), 0.4).alias("c"), L.off_if_zero(F.lit(0)).alias("d")).first()
    assert tuple(r) == (0.5, 0.6, 0.4, None)


def verdict_rows(spark, n, word="clear"):
    rows = [(1, i, 0, "", "r", word) for i in range(n)]
    return spark.createDataFrame(rows, "scene_id bigint, tile_row int, tile_col int, character string, reason string, verdict string")


def test_verdict_file_rules(spark):
    for rows, problem in ((verdict_rows(spark, 16), None), (verdict_rows(spark, 15), "verdict rows"), (verdict_rows(spark, 16, "maybe"), "unknown verdict")):
        path = scratch_path(spark, "verdicts-test")
        O.write_verdicts(rows, path)
        if problem is None:
            assert L.scan_audit_verdicts(spark, path).count() == 16
        else:
            with pytest.raises(Exception, match=problem):
                L.scan_audit_verdicts(spark, path).count()


def test_audit_sample_is_never_overwritten(spark):
    path = scratch_path(spark, "sample-test")
    O.write_audit_sample(verdict_rows(spark, 3), path)
    with pytest.raises(Exception, match="(?i)exists"):
        O.write_audit_sample(verdict_rows(spark, 3), path)


def test_masks_must_be_boolean(spark):
    with pytest.raises(TypeError):
        H.require_boolean(spark.range(1).select(F.lit(0.5).alias("m")), ["m"])


def test_band_order_is_checked(spark):
    with pytest.raises(ValueError):
        check_order(spark.range(1).select(F.lit(1).alias("b02"), F.lit(1).alias("b01")), ("b01", "b02"))


def test_failed_checks_stop_the_job(spark):
    row = spark.createDataFrame([(1, "CK1", False, False, "hole")], "scene_id bigint, check_id string, ok boolean, skipped boolean, detail string")
    with pytest.raises(AssertionError, match="1 failed, first scene 1 CK1: hole"):
        H.assert_checks(row)
    H.assert_checks(row.withColumn("ok", F.lit(True)))


def test_winner_rule(spark):
    from skysift.operators import compare as C

    def runs(simple, other):
        rows = []
        for i in range(15):
            rows += [(0, "t", i, 0, i < simple), (0, "m", i, 0, i < other), (0, "ref", i, 0, True)]
        return spark.createDataFrame(rows, "scene_id bigint, detector string, tile_row int, tile_col int, valid boolean")

    truth = spark.createDataFrame([(0, i, 0, "clear") for i in range(15)] + [(0, 15, 0, "thin_cloud")], "scene_id bigint, tile_row int, tile_col int, verdict string")
    for simple, other, winner in ((13, 12, "t"), (12, 13, "t"), (10, 12, "m"), (14, 10, "t")):
        assert C.decide_winner(runs(simple, other), truth, "t", "m", "ref").first().winner == winner
    with pytest.raises(Exception, match="a run is missing"):
        C.decide_winner(runs(13, 12).filter("detector != 'm'"), truth, "t", "m", "ref").collect()


def test_arriving_scenes_reach_the_batch_result(spark):
    from skysift.streaming.arrivals import screen_arrivals, to_table

    px = X.masks60(spark, SF).select("scene_id", "y", "x", "q24")
    grid = SceneGrid(tile_px=5, rows=6, cols=10, metres=60)
    path = scratch_path(spark, "arrivals")
    px.filter("y < 15").write.parquet(path)
    px.filter("y >= 15").write.mode("append").parquet(path)
    counts = screen_arrivals(spark, path, px.schema, grid, detect.build("model", prob_threshold=0.6, average_over=0, dilation_size=0))
    to_table(counts, "arrived", scratch_path(spark, "stream")).awaitTermination()
    from skysift.operators.tiles import fine_tile_counts

    batch = fine_tile_counts(detect.build("model", prob_threshold=0.6, average_over=0, dilation_size=0)(px), grid, ["cloud"])
    assert spark.table("arrived").exceptAll(batch).count() == 0 and batch.count() == 60

    from skysift.streaming.arrivals import latest_counts, to_files

    out = scratch_path(spark, "arrived")
    to_files(counts, out, scratch_path(spark, "stream")).awaitTermination()
    got = latest_counts(spark, out).select(*batch.columns)
    assert got.exceptAll(batch).count() == 0 and got.count() == 60


def test_long_chains_take_few_rounds(spark, monkeypatch):
    from skysift.operators import graph

    rounds = []
    keep = graph._cut_and_mark
    monkeypatch.setattr(graph, "_cut_and_mark", lambda edges, keys: rounds.append(1) or keep(edges, keys))
    # A U of 64 nodes whose arms meet in the largest one, and a lone pair under another key.
    order = [*range(0, 64, 2), *range(63, 0, -2)]
    rows = [(1, a, b) for a, b in zip(order, order[1:])] + [(2, 7, 3), (2, 3, 3)]
    got = {tuple(r) for r in graph.connected_components(spark.createDataFrame(rows, "k int, u bigint, v bigint"), ["k"]).collect()}
    assert got == {(1, n, 0) for n in range(64)} | {(2, 7, 3), (2, 3, 3)}
    assert len(rounds) <= 10


def test_pixels_move_only_where_needed(spark):
    def exchanges(name):
        text = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        return text.split("Initial Plan")[0].count("Exchange ")

    for name in ("brightness", "ndsi", "cloud_rule", "clip_reflectance", "quantize8", "block_mean"):
        assert exchanges(name) <= (1 if name == "block_mean" else 0), name
    for name in ("confusion_counts", "class_shares", "branch_code", "disk_average", "mask_outline"):
        assert exchanges(name) <= 1, name


def test_model_detector_averages_and_dilates(spark):
    from skysift.operators.neighborhood import prob_morph_mask

    px = X.px60(spark, SF)
    want = prob_morph_mask(px, "q24", 0.4, 1, 1, X.COARSE_SHAPE, edge=X.EDGE)
    on = lambda df: df.filter("cloud").select("scene_id", "y", "x")
    got = detect.build("model", shape=X.COARSE_SHAPE, edge=X.EDGE)(px)
    assert on(got).exceptAll(on(want)).count() == 0 and on(got).count() == on(want).count() and got.count() == px.count()
    plain = detect.build("model", configured={"average_over": 0, "dilation_size": 0, "prob_threshold": 0.6})(px)
    assert on(plain).count() == px.filter(f"q24 > {0.6 * (1 << 24)}").count()
    with pytest.raises(ValueError):
        detect.build("model")


def test_missing_outputs_fail(spark):
    scenes = spark.createDataFrame([(1,), (2,)], "scene_id bigint")
    lines = spark.createDataFrame([], "value string, scene_id bigint")
    rows = H.check_report_schema(lines, X.GRID, scenes).collect()
    assert [(r.ok, r.detail) for r in rows] == [(False, "no report")] * 2
    lost = spark.createDataFrame([(1, "CK7", False, True, "x")], "scene_id bigint, check_id string, ok boolean, skipped boolean, detail string")
    assert H.check_totals(lost).first().fail == 1


def test_points_off_every_pixel_keep_their_row(spark):
    from skysift.operators import compare as C

    points = spark.createDataFrame([(1, 0, 0, 0, 0), (1, 9, 9, 0, 0)], "scene_id int, y int, x int, tile_row int, tile_col int")
    px = spark.createDataFrame([(1, 0, 0, True, False, False)], "scene_id int, y int, x int, opaque boolean, cirrus boolean, snow boolean")
    tiles = spark.createDataFrame([(1, 0, 0, 1.0, True)], "scene_id int, tile_row int, tile_col int, cloud_cover_percent double, valid boolean")
    assert sorted((r.y, r.opaque) for r in C.point_lookup(points, px, tiles).collect()) == [(0, True), (9, None)]


def test_chips_and_runs_are_held_against_the_scene_list(spark):
    from skysift.constants import SceneGrid
    from skysift.operators import checks as H

    grid = SceneGrid(tile_px=2, rows=1, cols=2)
    scenes = spark.createDataFrame([(1,), (2,), (3,)], "scene_id bigint")
    report = spark.createDataFrame([(1, 0, 0, True), (1, 0, 1, False), (2, 0, 0, True)], "scene_id bigint, tile_row int, tile_col int, valid boolean")
    chips = spark.createDataFrame([(1, "tile_r00_c00", [1, 2, 3, 4]), (2, "tile_r00_c00", [1, 2, 3])], "scene_id bigint, name string, cells array<int>")
    faith = spark.createDataFrame([(1, 0.0, 0.0), (2, 4.0, 0.0)], "scene_id bigint, mean_abs_diff double, channel_gap double")
    rows = {r.scene_id: (r.ok, r.detail) for r in H.check_chips(chips, report, faith, grid, scenes).collect()}
    assert rows == {1: (True, "1 chips, 0 mismatched, 0 torn, 0 unlike"), 2: (False, "1 chips, 0 mismatched, 1 torn, 1 unlike"), 3: (False, "no report")}
    same = {r.scene_id: r.ok for r in H.check_determinism(report, report, chips, chips, scenes).collect()}
    assert same == {1: True, 2: True, 3: False}
