"""Stored layouts: files, exchanges and join methods that must not grow with the number of scenes."""

import glob

from pyspark.sql import functions as F

from skysift.constants import BANDS
from skysift.operators import analysis as A
from skysift.plans import fixtures as X
from skysift.plans.inputs import write_bands, write_products
from skysift.session import scratch_path
from skysift.sources import catalog as K
from skysift.sources import pixels as P
from skysift.sources import sinks as O

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def files(path):
    return glob.glob(path.removeprefix("file:") + "/**/part-*", recursive=True)


def test_table_of_documents_reads_like_folders(spark):
    tables = write_products(spark, SF, flawed=True)
    paths = [scratch_path(spark, n) for n in ("p", "g")]
    for table, path in zip(tables, paths):
        table.withColumnRenamed("product", "safe").write.partitionBy("safe").text(path)
    rows = [sorted(K.scan_products(spark, *given).collect(), key=str) for given in (tables, paths)]
    assert rows[0] and rows[0] == rows[1]


def test_listing_reads_like_a_folder(spark, tmp_path):
    folder = tmp_path / "SCENE_000007.SAFE"
    folder.mkdir()
    for b in BANDS[:3]:
        (folder / f"SCENE_000007_{b}.jp2").write_text("-")
    walked = K.band_inventory(spark, f"file:{tmp_path}")
    listed = K.band_inventory(spark, K.listed_files(spark, f"file:{tmp_path}"))
    assert sorted(walked.collect()) == sorted(listed.collect()) and walked.count() == 3
    assert all(r.length == 0 for r in K.band_inventory(spark, write_bands(spark, SF)).collect())


def test_pixel_tables_have_a_file_a_task(spark):
    scenes = spark.range(40, numPartitions=2).select(F.col("id").alias("scene_id"), F.lit(0).alias("tile_row"), F.lit(0).alias("tile_col"))
    px = scenes.select("scene_id", F.lit(0).alias("y"), F.lit(0).alias("x"), F.lit(0.5).alias("prob"))
    sample = scenes.select("*", F.lit("").alias("character"), F.lit("r").alias("reason"))
    for write, rows in ((O.write_chips, scenes), (O.write_masks, scenes), (O.write_probability_map, px)):
        path = scratch_path(spark, "layout")
        write(rows, path)
        assert len(files(path)) == 2 and spark.read.parquet(path).select("scene_id").distinct().count() == 40
    path = scratch_path(spark, "layout")
    O.write_audit_sample(sample, path)
    assert len(files(path)) <= int(spark.conf.get("spark.sql.shuffle.partitions")) < 40


def test_fidelity_sends_no_pixels_through_the_driver(spark):
    """Unpacked chips are small by their files only."""
    px = X.px10(spark, SF).drop("brow", "bcol")
    found = A.rgb_fidelity(px.filter("scene_id = 0 and y < 15"), px, X.GRID)
    assert "SortMergeJoin" in plan(found) and "BroadcastExchange" not in plan(found)


def test_stored_fine_rows_move_once_and_coarse(spark):
    dealt = X.rows10(spark, SF, ["b03"])
    text = plan(dealt)
    assert text.count("Exchange") == 1 and text.index("Generate") < text.index("Exchange")
    path = scratch_path(spark, "fine")
    P.write_scene_folders(dealt.select("brow", "scene_id", "y", "x", "b03"), X.GRID, 10, path, dealt=True)
    back = P.scan_window(spark, path, "scene_id bigint, y int, x int, b03 bigint", ["b03"])
    want = X.px10(spark, SF).select("scene_id", "y", "x", "b03")
    assert back.exceptAll(want).isEmpty() and want.exceptAll(back).isEmpty()
