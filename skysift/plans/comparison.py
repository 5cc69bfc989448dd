"""Run comparison, audit and decision queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysift.constants import NAIVE_RULE
from skysift.functions import geodesy
from skysift.functions import radiometry as R
from skysift.functions import tilemath as M
from skysift.operators import analysis as A
from skysift.operators import compare as C
from skysift.operators import grid as G
from skysift.operators import tiles as T
from skysift.plans import fixtures as X
from skysift.plans.aggregates import COUNTS_SQL, SCORES_SQL
from skysift.plans.registry import query
from skysift.plans.scalars import DETECTORS, KEY, tile_runs
from skysift.session import cut_lineage, scratch_path
from skysift.sources.sinks import write_run_reports
from skysift.sources.tables import load_runs

I = X._idiv
NAMED_SQL = "named(tile_row, tile_col, \"character\") as (values " + ", ".join(f"({r}, {c}, '{t}')" for r, c, t in X.NAMED) + ")"
# Percentages as a report prints them.
REP = NAMED_SQL + (
    ", rep as (select * exclude (cloud_cover_percent), cast(printf('%.6f', cloud_cover_percent) as double) as pct from tiles)"
    ", diffs as (select a.scene_id, a.tile_row, a.tile_col, abs(a.pct - b.pct) as diff from rep a join rep b using (scene_id, tile_row, tile_col) where a.detector = 'threshold' and b.detector = 'model')"
    ", topd as (select *, row_number() over (partition by scene_id order by diff desc, tile_row, tile_col) as rank from diffs where not exists (select 1 from named n where n.tile_row = diffs.tile_row and n.tile_col = diffs.tile_col))"
    ", sample as (select scene_id, tile_row, tile_col, \"character\", 'named tile' as reason from ids cross join named "
    "union all select scene_id, tile_row, tile_col, '', printf('top-12 disagreement (%.4f pp between threshold and model)', diff) from topd where rank <= 12)"
    ", verd as (select s.*, case when r.pct > 32 then 'cloud' when r.pct > 28 then 'thin_cloud' else 'clear' end as verdict from sample s join rep r using (scene_id, tile_row, tile_col) where r.detector = 'class_mask')"
    ", audit as (select r.scene_id, r.detector, count(*) filter (v.verdict <> 'thin_cloud') as scored, count(*) filter ((v.verdict = 'clear' and r.valid) or (v.verdict = 'cloud' and not r.valid)) as matches, "
    "count(*) filter (v.verdict = 'thin_cloud') as excluded from rep r join verd v using (scene_id, tile_row, tile_col) group by all)"
    ", tcmp as (select o.scene_id, o.detector, count(*) as tiles, count(*) filter (not o.valid) as invalid_tiles, count(*) filter (o.valid <> f.valid) as disagreements, count(*) filter (f.valid and not o.valid) as discards_where_ref_keeps, "
    "count(*) filter (not f.valid and o.valid) as keeps_where_ref_discards from rep o join rep f using (scene_id, tile_row, tile_col) where f.detector = 'class_mask' and o.detector <> 'class_mask' group by all)"
)


def report_runs(spark, sf):
    """Run tiles with percentages as printed in a report."""
    printed = F.format_string("%.6f", F.col("cloud_cover_percent")).cast("double")
    return tile_runs(spark, sf).withColumn("cloud_cover_percent", printed)


def reported_runs(spark, sf):
    """The runs as read back from their report files, one a run and scene."""
    scenes, path = cut_lineage(X.scenes(spark, sf), "scenes"), scratch_path(spark, "reports")
    write_run_reports(T.locate_tiles(tile_runs(spark, sf), scenes, X.GRID), path)
    return cut_lineage(load_runs(spark, path, scenes, X.GRID), "runs")


def stored_runs(spark, sf):
    """The tile rows of the runs as one table, stored for comparisons that read them several times."""
    return cut_lineage(report_runs(spark, sf).select("detector", *C.TILE, "cloud_cover_percent", "cloud_pixels", "valid"), "runs")


def verdicts(runs):
    """Audit sample judged from the class mask, standing in for a human."""
    sample = C.audit_sample(runs, "threshold", "model", X.NAMED)
    ref = runs.filter(F.col("detector") == "class_mask").select(*C.TILE, F.col("cloud_cover_percent").alias("pct"))
    verdict = F.when(F.col("pct") > 32, "cloud").when(F.col("pct") > 28, "thin_cloud").otherwise("clear")
    return sample.join(ref, C.TILE).withColumn("verdict", verdict).drop("pct")


@query("pixel_compare", X.sql("select scene_id, " + COUNTS_SQL.format(p="a", r="ref") + " from det group by scene_id"))
def pixel_compare(spark, sf):
    """Two stored mask tables met on the pixel."""
    cand = X.masks60(spark, sf).select(*KEY, "brow", "bcol", F.col("a").alias("cloud"))
    ref = X.masks60(spark, sf).select(*KEY, "brow", "bcol", F.col("ref").alias("cloud"))
    return A.confusion_counts(C.pixel_compare(cand, ref), "predicted", "expected")


@query("tile_compare", X.sql("select * from tcmp", REP))
def tile_compare(spark, sf):
    return C.tile_compare(report_runs(spark, sf), "class_mask")


@query("named_tile_table", X.sql(
    "select scene_id, tile_row, tile_col, \"character\", max(pct) filter (detector = 'class_mask') as class_mask, max(pct) filter (detector = 'model') as model, "
    "max(pct) filter (detector = 'threshold') as threshold from rep join named using (tile_row, tile_col) group by all", REP).replace(
        "select scene_id, tile_row, tile_col, \"character\", max", "select scene_id, cast(tile_row as bigint) as tile_row, cast(tile_col as bigint) as tile_col, \"character\", max"))
def named_tile_table(spark, sf):
    return C.named_tile_table(report_runs(spark, sf), ["class_mask", "model", "threshold"], X.NAMED)


@query("top_disagreements", X.sql("select * from topd where rank <= 12", REP))
def top_disagreements(spark, sf):
    return C.top_disagreements(report_runs(spark, sf), "threshold", "model", X.NAMED)


_SAMPLE = "select scene_id, cast(tile_row as bigint) as tile_row, cast(tile_col as bigint) as tile_col, \"character\", reason"


@query("audit_sample", X.sql(_SAMPLE + " from sample", REP))
def audit_sample(spark, sf):
    return C.audit_sample(report_runs(spark, sf), "threshold", "model", X.NAMED)


@query("sample_equality", X.sql(
    "select side, count(*) as rows from (select 'left' as side from sample where tile_row = 5 union all select 'right' from sample where tile_row = 5) group by side", REP))
def sample_equality(spark, sf):
    """A stored sample with an altered row per named tile in row 5, against the recomputed one."""
    fresh = C.audit_sample(reported_runs(spark, sf), "threshold", "model", X.NAMED)
    stored = fresh.withColumn("reason", F.when(F.col("tile_row") == 5, F.concat("reason", F.lit("!"))).otherwise(F.col("reason")))
    return C.same_rows(fresh, stored).groupBy("side").agg(F.count(F.lit(1)).alias("rows"))


@query("audit_agreement", X.sql(
    "select *, case when scored > 0 then matches / cast(scored as double) end as agreement from audit", REP))
def audit_agreement(spark, sf):
    runs = stored_runs(spark, sf)
    out = C.audit_agreement(runs, verdicts(runs))
    return out.drop("mismatches")


@query("audit_mismatches", X.sql(
    "select r.scene_id, r.detector, cast(v.tile_row as bigint) as tile_row, cast(v.tile_col as bigint) as tile_col, v.verdict from rep r join verd v using (scene_id, tile_row, tile_col) "
    "where (v.verdict = 'clear' and not r.valid) or (v.verdict = 'cloud' and r.valid)", REP))
def audit_mismatches(spark, sf):
    """The mismatch list of the audit, one row each."""
    runs = stored_runs(spark, sf)
    out = C.audit_agreement(runs, verdicts(runs))
    return out.select("scene_id", "detector", F.inline("mismatches"))


@query("verdict_counts", X.sql(
    "select verdict, count(*) as tiles, count(*) filter (verdict <> 'thin_cloud') as scored from verd group by verdict", REP))
def verdict_counts(spark, sf):
    return C.verdict_counts(verdicts(stored_runs(spark, sf)))


@query("spread_table", X.sql(
    "select scene_id, detector, count(*) filter (not ok) as invalid_tiles, 1e2 * sum(c) / (count(*) * 225) as scene_cloud_percent from ("
    "select scene_id, detector, cloud_pixels as c, valid as ok from tiles union all select scene_id, 'naive', c, 100*c <= 6750 and cast(nd as double)/225 <= 0.5 from "
    f"(select scene_id, {I('(y*6+i)', 15)} as tr, {I('(x*6+j)', 15)} as tc, count(*) filter (bright > cast(0.33 as float)) as c, count(*) filter (nodata) as nd from det cross join i6 cross join j6 group by all)) group by all"))
def spread_table(spark, sf):
    """Invalid tiles and scene percentage of every method, the naive rule included."""
    bright, slope, r10 = X.rule_columns()
    masks = X.masks60(spark, sf).withColumn("naive", R.cloud_rule(bright, slope, r10, **NAIVE_RULE))
    runs = T.run_tiles(masks, X.GRID, 6, DETECTORS | {"naive": "naive"})
    return C.spread_table(runs, X.GRID.tile_pixels)


def pixel_scores(spark, sf):
    masks = X.masks60(spark, sf)
    flags = F.array(*[F.struct(F.lit(n).alias("detector"), F.col(c).alias("p")) for n, c in DETECTORS.items() if n != "class_mask"])
    long = masks.select("scene_id", "ref", F.inline(flags))
    return A.with_scores(A.confusion_counts(long, "p", "ref", ("scene_id", "detector")))


@query("comparison_table", X.sql(
    "select s.scene_id, s.detector, s.invalid_tiles, s.scene_cloud_percent, p.precision, p.recall, p.f1, p.iou, t.disagreements, t.discards_where_ref_keeps, t.keeps_where_ref_discards, "
    "a.scored, a.matches, a.excluded, case when a.scored > 0 then a.matches / cast(a.scored as double) end as agreement, "
    "case when s.detector = 'class_mask' then 1e2 else 1e2 * (1e0 - t.disagreements / cast(t.tiles as double)) end as reference_agreement from "
    "(select scene_id, detector, count(*) filter (not valid) as invalid_tiles, 1e2 * sum(cloud_pixels) / (count(*) * 225) as scene_cloud_percent from tiles group by all) s "
    "left join (select " + SCORES_SQL.format(src="select scene_id, 'threshold' as detector, " + COUNTS_SQL.format(p="a", r="ref") + " from det group by scene_id union all select scene_id, 'model', "
                                             + COUNTS_SQL.format(p="b", r="ref") + " from det group by scene_id") + ") p using (scene_id, detector) "
    "left join tcmp t using (scene_id, detector) left join audit a using (scene_id, detector)", REP))
def comparison_table(spark, sf):
    runs = stored_runs(spark, sf)
    return C.comparison_table(runs, pixel_scores(spark, sf), verdicts(runs), "class_mask", X.GRID.tile_pixels)


@query("decide_winner", X.sql(
    "select t.scene_id, t.scored, t.matches as simple_matches, m.matches as other_matches, case when abs(t.matches - m.matches) <= 1 or t.matches > m.matches then 'threshold' else 'model' end as winner, "
    "case when abs(t.matches - m.matches) <= 1 then 'tie: simpler method' else 'higher audit agreement' end as rule from audit t join audit m using (scene_id) where t.detector = 'threshold' and m.detector = 'model'", REP))
def decide_winner(spark, sf):
    runs = stored_runs(spark, sf)
    return C.decide_winner(runs, verdicts(runs), "threshold", "model", "class_mask")


@query("chips_vs_report", X.sql(
    "select scene_id, printf('tile_r%02d_c%02d', tile_row, tile_col) as name, case when valid then 'missing' else 'unexpected' end as problem from tiles "
    "where detector = 'class_mask' and ((valid and tile_row = 3) or (not valid and tile_row = 7))"))
def chips_vs_report(spark, sf):
    """A chip listing that lacks the valid tiles of row 3 and holds the invalid ones of row 7."""
    report = report_runs(spark, sf).filter(F.col("detector") == "class_mask")
    kept = (F.col("valid") & (F.col("tile_row") != 3)) | (~F.col("valid") & (F.col("tile_row") == 7))
    chips = report.filter(kept).select("scene_id", M.tile_name(F.col("tile_row"), F.col("tile_col")).alias("name"))
    return C.chips_vs_report(chips, report)


@query("run_recompute_diff", X.sql(
    "select scene_id, count(*) as tiles, cast(case when scene_id % 4 = 3 then 1 else 0 end as bigint) as one_sided, max(abs(t.cloud_cover_percent - r.pct)) filter (not (scene_id % 4 = 3 and tile_row = 5 and tile_col = 5)) as max_gap, 0 as verdict_changes, scene_id % 4 <> 3 and max(abs(t.cloud_cover_percent - r.pct)) <= 1e-4 as ok "
    "from tiles t join rep r using (scene_id, tile_row, tile_col, detector) where detector = 'model' group by scene_id", REP).replace("0 as verdict_changes", "cast(0 as bigint) as verdict_changes"))
def run_recompute_diff(spark, sf):
    """Tiles recomputed from the masks against the printed report, which lacks a tile in every fourth scene."""
    fresh = tile_runs(spark, sf).filter(F.col("detector") == "model")
    lost = (F.col("scene_id") % 4 == 3) & (F.col("tile_row") == 5) & (F.col("tile_col") == 5)
    stored = report_runs(spark, sf).filter((F.col("detector") == "model") & ~lost)
    return C.run_recompute_diff(fresh, stored, 1e-4)


@query("determinism_diff", X.sql("select scene_id, count(*) as tiles, cast(0 as bigint) as left_only, cast(0 as bigint) as right_only from tiles where detector = 'model' group by scene_id"))
def determinism_diff(spark, sf):
    """Two runs by different routes: overlap weights, and enlarging the mask; no row differs."""
    from skysift.operators import resample as S

    masks = X.masks60(spark, sf)
    fine = S.upsample_nearest(masks.select(*KEY, "brow", "bcol", "b", "nodata"), 6)
    slow = T.tile_stats(T.fine_tile_counts(fine, X.GRID, ["b", "nodata"]), X.GRID, cloud="b")
    fast = T.run_tiles(masks, X.GRID, 6, {"model": "b"}).drop("detector")
    seen = fast.select("scene_id", F.lit("both").alias("side")).unionByName(C.same_rows(fast, slow).select("scene_id", "side"))
    return seen.groupBy("scene_id").agg(
        F.count_if(F.col("side") == "both").alias("tiles"),
        F.count_if(F.col("side") == "left").alias("left_only"), F.count_if(F.col("side") == "right").alias("right_only"))


_points = ("pts as (select l_orderkey as k, l_linenumber as line from lineitem), "
           f"pt as (select pts.*, p.scene_id, p.y, p.x, {I('(p.y*6)', 15)} as tile_row, {I('(p.x*6)', 15)} as tile_col, p.opaque, p.cirrus, p.snow from pts join px60 p on p.k = pts.k)")


@query("point_lookup", X.sql(
    "select scene_id, y, x, tile_row, tile_col, count(*) as points, cast(sum(line) as bigint) as lines, opaque, cirrus, snow, t.cloud_cover_percent, t.valid, "
    f"cast(600000 + 3000*(scene_id % 10) + x*60 as double) as easting, cast(5500020 - 1800*{I('scene_id', 10)} - y*60 as double) as northing "
    "from pt join tiles t using (scene_id, tile_row, tile_col) where t.detector = 'class_mask' group by all", _points))
def point_lookup(spark, sf):
    """Every line item is a point on the scene; the read-out of each, counted per pixel."""
    points = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        F.expr("l_orderkey div 1500").alias("scene_id"), F.expr("cast((l_orderkey % 1500) div 50 as int)").alias("y"),
        F.expr("cast(l_orderkey % 50 as int)").alias("x"), F.col("l_linenumber").alias("line"))
    placed = points.withColumns({"tile_row": G.idiv(F.col("y") * 6, 15), "tile_col": G.idiv(F.col("x") * 6, 15)})
    tiles = tile_runs(spark, sf).filter(F.col("detector") == "class_mask")
    found = X.with_geocoding(C.point_lookup(placed, X.px60(spark, sf), tiles))
    east, north = geodesy.pixel_to_map(F.col("origin_e"), F.col("origin_n"), F.col("y"), F.col("x"), 60)
    keys = ["scene_id", "y", "x", "tile_row", "tile_col", "opaque", "cirrus", "snow", "cloud_cover_percent", "valid"]
    return found.withColumns({"easting": east, "northing": north}).groupBy(*keys, "easting", "northing").agg(
        F.count(F.lit(1)).alias("points"), F.sum("line").cast("bigint").alias("lines"))
