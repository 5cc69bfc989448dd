"""Parameter-sweep queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysift.functions import radiometry as R
from skysift.operators import analysis as A
from skysift.operators import sweep as W
from skysift.plans import fixtures as X
from skysift.plans.gridding import REFLECT_X, REFLECT_Y
from skysift.plans.registry import query

I = X._idiv
PRESETS = {"library default": 0.4, "chosen": 0.6, "agreement optimum": 0.8}

SWEEP_VIEWS = (
    "gb as (select cast(range as double) / 100 as t_bright from range(10, 41)), "
    "gn as (select cast(range as double) / 100 as t_ndsi from range(-40, -9, 2) union all select null), "
    "gc as (select cast(range as double) / 10000 as t_cirrus from range(20, 121, 5) union all select null), "
    "white as (select t_bright, t_ndsi, k from det cross join gb cross join gn where bright > cast(t_bright as float) and (t_ndsi is null or ndsi > cast(t_ndsi as float))), "
    "cells as (select cast(count(*) filter (ref) as bigint) as pos, count(*) filter (not ref) as neg from det), "
    "sweep0 as (select t_bright, t_ndsi, t_cirrus, count(*) filter (ref and hit) as tp, count(*) filter (not ref and hit) as fp, count(*) filter (ref and not hit) as fn, count(*) filter (not ref and not hit) as tn "
    "from (select t_bright, t_ndsi, t_cirrus, ref, (bright > cast(t_bright as float) and (t_ndsi is null or ndsi > cast(t_ndsi as float))) or (t_cirrus is not null and r10 > cast(t_cirrus as float)) as hit "
    "from det cross join gb cross join gn cross join gc) group by all), "
    "sweep1 as (select *, 1e2 * (tp + fp) / (tp + fp + fn + tn) as scene_cloud_percent, case when tp + fp = 0 then 0e0 else tp / cast(tp + fp as double) end as precision, "
    "case when tp + fn = 0 then 0e0 else tp / cast(tp + fn as double) end as recall, case when tp + fp + fn = 0 then 0e0 else tp / cast(tp + fp + fn as double) end as iou from sweep0), "
    "sweep as (select t_bright, t_ndsi, t_cirrus, scene_cloud_percent, precision, recall, case when precision + recall = 0 then 0e0 else 2 * precision * recall / (precision + recall) end as f1, iou from sweep1), "
    "best as (select * exclude (rk) from (select *, row_number() over (partition by family order by f1 desc, t_bright, t_ndsi, t_cirrus) as rk from (select *, "
    "case when t_ndsi is null and t_cirrus is null then 'brightness_only' when t_cirrus is null then 'plus_ndsi' when t_ndsi is null then 'plus_cirrus' else 'all_three' end as family from sweep)) where rk = 1)"
).replace("white as (select t_bright, t_ndsi, k from det cross join gb cross join gn where bright > cast(t_bright as float) and (t_ndsi is null or ndsi > cast(t_ndsi as float))), "
          "cells as (select cast(count(*) filter (ref) as bigint) as pos, count(*) filter (not ref) as neg from det), ", "")


def sweep_rows(spark, sf):
    bright, slope, r10 = X.rule_columns()
    ref = R.class_union(F.col("opaque"), F.col("cirrus"))
    return W.threshold_sweep(X.px60(spark, sf, placed=False), bright, slope, r10, ref)


@query("threshold_sweep", X.sql("select * from sweep", SWEEP_VIEWS))
def threshold_sweep(spark, sf):
    """11,594 settings against the class mask; the oracle evaluates each one."""
    return sweep_rows(spark, sf)


@query("best_per_ablation", X.sql("select * from best", SWEEP_VIEWS))
def best_per_ablation(spark, sf):
    return W.best_per_ablation(sweep_rows(spark, sf))


_EDGE = ("coalesce(abs(t_bright - 0.1e0) < 1e-9 or abs(t_bright - 0.4e0) < 1e-9, false) as t_bright_on_edge, "
         "coalesce(abs(t_ndsi - -0.4e0) < 1e-9 or abs(t_ndsi - -0.1e0) < 1e-9, false) as t_ndsi_on_edge, "
         "coalesce(abs(t_cirrus - 0.002e0) < 1e-9 or abs(t_cirrus - 0.012e0) < 1e-9, false) as t_cirrus_on_edge, "
         "abs(f1 - case when family = 'brightness_only' then 0.71e0 else 0.72e0 end) <= 0.02e0 as f1_expected")


@query("optimum_on_edge", X.sql(f"select family, {_EDGE} from best", SWEEP_VIEWS))
def optimum_on_edge(spark, sf):
    out = W.optimum_on_edge(W.best_per_ablation(sweep_rows(spark, sf)))
    return out.select("family", "t_bright_on_edge", "t_ndsi_on_edge", "t_cirrus_on_edge", "f1_expected")


@query("ablation", X.sql(f"select *, {_EDGE} from best", SWEEP_VIEWS))
def ablation(spark, sf):
    """What each test contributes, with the edge and expectation flags."""
    return W.optimum_on_edge(W.best_per_ablation(sweep_rows(spark, sf)))


PROB_VIEWS = (
    "rad as (select unnest([0, 1, 2, 4]) as r), off as (select r, cast(dy.range as bigint) - 4 as dy, cast(dx.range as bigint) - 4 as dx from rad cross join range(9) dy cross join range(9) dx "
    "where (dy.range - 4)*(dy.range - 4) + (dx.range - 4)*(dx.range - 4) <= r * r), "
    f"avgf as (select t.r as a, t.scene_id, t.y, t.x, sum(s.q24) as s, count(*) as n from (select r, scene_id, y, x, {REFLECT_Y} as sy, {REFLECT_X} as sx from px60 cross join off) t "
    "join px60 s on s.scene_id = t.scene_id and s.y = t.sy and s.x = t.sx group by all), "
    "thr as (select cast(range as double) / 100 as t from range(30, 96, 5)), "
    "hot as (select t, a, scene_id, y, x from avgf cross join thr where cast(s as double) > t * cast(n * 16777216 as double)), "
    "spread as (select distinct t, a, r as d, scene_id, y + dy as y, x + dx as x from hot cross join off where r <= 2), "
    "joined as (select s.t, s.a, s.d, s.scene_id, tr.range as tr, tc.range as tc, p.ref from spread s join det p on p.scene_id = s.scene_id and p.y = s.y and p.x = s.x "
    "join range(12) tr on s.y >= round_even(tr.range * 2.5e0, 0) and s.y < round_even((tr.range + 1) * 2.5e0, 0) join range(20) tc on s.x >= round_even(tc.range * 2.5e0, 0) and s.x < round_even((tc.range + 1) * 2.5e0, 0)), "
    "area as (select scene_id, tr.range as tr, tc.range as tc, count(*) as cells from px60 join range(12) tr on y >= round_even(tr.range * 2.5e0, 0) and y < round_even((tr.range + 1) * 2.5e0, 0) "
    "join range(20) tc on x >= round_even(tc.range * 2.5e0, 0) and x < round_even((tc.range + 1) * 2.5e0, 0) group by all), "
    "ptile as (select t, a, d, scene_id, tr, tc, count(*) as n, count(*) filter (ref) as tp from joined group by all), "
    "tot as (select t, a, d, cast(sum(n) as bigint) as n, cast(sum(tp) as bigint) as tp, count(*) filter (1e2 * n / cells > 30e0) as invalid from ptile join area using (scene_id, tr, tc) group by all), "
    "psweep0 as (select t as threshold, nullif(cast(a as bigint), 0) as average_over, nullif(cast(d as bigint), 0) as dilation_size, 1e2 * n / (select count(*) from px60) as scene_cloud_percent, invalid as invalid_tiles, "
    "case when n = 0 then 0e0 else tp / cast(n as double) end as precision, tp / cast((select count(*) from det where ref) as double) as recall, tp / cast(n + (select count(*) from det where ref) - tp as double) as iou from tot), "
    "psweep as (select *, case when precision + recall = 0 then 0e0 else 2 * precision * recall / (precision + recall) end as f1 from psweep0)"
)


def prob_rows(spark, sf, **grids):
    return W.prob_sweep(X.masks60(spark, sf), "q24", "ref", X.GRID, X.COARSE_SHAPE, 6, edge=X.EDGE, **grids)


@query("prob_sweep", X.sql(
    "select e.threshold, e.average_over, e.dilation_size, coalesce(scene_cloud_percent, 0e0) as scene_cloud_percent, coalesce(invalid_tiles, 0) as invalid_tiles, coalesce(precision, 0e0) as precision, "
    "coalesce(recall, 0e0) as recall, coalesce(f1, 0e0) as f1, coalesce(iou, 0e0) as iou from every e left join psweep p on p.threshold = e.threshold and p.average_over is not distinct from e.average_over "
    "and p.dilation_size is not distinct from e.dilation_size",
    PROB_VIEWS + ", every as (select t as threshold, nullif(cast(a.r as bigint), 0) as average_over, nullif(cast(d.r as bigint), 0) as dilation_size from thr cross join rad a cross join rad d where d.r <= 2)"))
def prob_sweep(spark, sf):
    """168 settings of the probability detector."""
    return prob_rows(spark, sf)


CURVE_VIEWS = (
    "steps as (select cast(range as double) / 100 as t from range(101)), "
    "curve_tiles as (select scene_id, tile_row, tile_col, t, count(*) filter (cast(q24 as double) > t * 16777216e0) as n from fine_det cross join steps group by all), "
    "curve as (select scene_id, t as threshold, count(*) filter (100 * n > 6750) as invalid_tiles, 1e2 * sum(n) / (count(*) * 225) as scene_percent from curve_tiles group by all)"
)


def curve_rows(spark, sf):
    return W.prob_curve(X.px60(spark, sf), "q24", X.GRID, 6)


@query("prob_curve", X.sql("select * from curve", CURVE_VIEWS))
def prob_curve(spark, sf):
    return curve_rows(spark, sf)


@query("curve_monotone", X.sql(
    "select scene_id, count(*) as points, count(*) filter (rise) as rises, count(*) filter (rise) = 0 as ok from "
    "(select scene_id, invalid_tiles > lag(invalid_tiles) over (partition by scene_id order by threshold) as rise from curve) group by scene_id", CURVE_VIEWS))
def curve_monotone(spark, sf):
    return W.curve_monotone(curve_rows(spark, sf))


@query("preset_table", X.sql(
    "select *, case threshold when 0.4 then 'library default' when 0.6 then 'chosen' else 'agreement optimum' end as preset from curve where threshold in (0.4, 0.6, 0.8)", CURVE_VIEWS))
def preset_table(spark, sf):
    return W.preset_table(curve_rows(spark, sf), PRESETS)


_EXPECT = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95)


@query("sweep_tolerance", X.sql(
    "select threshold, abs(p.f1 - (2 * pr * rc / (pr + rc))) as f1_gap, abs(p.invalid_tiles - c.inv) as tile_gap, abs(p.f1 - (2 * pr * rc / (pr + rc))) <= 0.02e0 as f1_ok, abs(p.invalid_tiles - c.inv) <= 10 as tiles_ok from psweep p "
    "join (select threshold, cast(sum(invalid_tiles) as bigint) as inv from curve group by threshold) c using (threshold) "
    "join (select t as threshold, count(*) filter (ref and h) / cast(count(*) filter (h) as double) as pr, count(*) filter (ref and h) / cast(count(*) filter (ref) as double) as rc from "
    "(select ref, t, cast(q24 as double) > t * 16777216e0 as h from det cross join thr) group by t) using (threshold) "
    f"where average_over is null and dilation_size is null and threshold in {_EXPECT}", PROB_VIEWS + ", " + CURVE_VIEWS))
def sweep_tolerance(spark, sf):
    """The approximate-edge sweep against the exact tile cut at eight thresholds."""
    curve = curve_rows(spark, sf).groupBy("threshold").agg(F.sum("invalid_tiles").alias("expected_invalid"))
    px = X.masks60(spark, sf)
    flags = F.array(*[F.struct(F.lit(t).alias("threshold"), R.prob24_mask(F.col("q24"), t).alias("p")) for t in _EXPECT])
    scores = A.with_scores(A.confusion_counts(px.select("ref", F.inline(flags)), "p", "ref", ("threshold",)))
    expected = scores.select("threshold", F.col("f1").alias("expected_f1")).join(curve, "threshold")
    return W.sweep_tolerance(prob_rows(spark, sf, averages=(0,), dilations=(0,)), expected)


_MOVES = [("t_bright", d, (0.3 + d, -0.2, 0.011)) for d in (-0.02, 0.02)] + [("t_ndsi", d, (0.3, -0.2 + d, 0.011)) for d in (-0.02, 0.02)] + [
    ("t_cirrus", d, (0.3, -0.2, 0.011 + d)) for d in (-0.0005, 0.0005)]


@query("threshold_sensitivity", X.sql(
    "select m.scene_id, m.parameter, m.step, count(*) filter ((100 * m.n <= 6750) <> (100 * b.a <= 6750)) as flips from "
    f"(select scene_id, parameter, step, {I('(y*6+i)', 15)} as tile_row, {I('(x*6+j)', 15)} as tile_col, count(*) filter ((bright > cast(tb as float) and ndsi > cast(tn as float)) or r10 > cast(tc as float)) as n "
    "from t60 cross join moves cross join i6 cross join j6 group by all) m join tiles_wide b using (scene_id, tile_row, tile_col) group by all",
    "moves(parameter, step, tb, tn, tc) as (values " + ", ".join(f"('{p}', {d!r}::double, {round(a, 6)!r}::double, {round(b, 6)!r}::double, {round(c, 6)!r}::double)" for p, d, (a, b, c) in _MOVES) + ")"))
def threshold_sensitivity(spark, sf):
    bright, slope, r10 = X.rule_columns()
    return W.threshold_sensitivity(
        X.px60(spark, sf), bright, slope, r10, X.RULE_A, {"t_bright": 0.02, "t_ndsi": 0.02, "t_cirrus": 0.0005}, X.GRID, 6)
