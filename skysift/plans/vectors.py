"""Region and outline queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysift.operators import analysis as A
from skysift.operators import outline as V
from skysift.operators import regions as C
from skysift.plans import fixtures as X
from skysift.plans.aggregates import scene_footprints
from skysift.plans.registry import query
from skysift.plans.scalars import inverse_views

CLASSES = {"threshold": "a", "class_mask": "ref"}
# Small blocks, so that the fixture's regions cross block borders.
BLOCK = 16

RUN_VIEWS = (
    "lay as (select scene_id, y, x, 'threshold' as class from det where a union all select scene_id, y, x, 'class_mask' from det where ref), "
    "runs as (select scene_id, class, y, min(x) as x0, max(x) as x1 from (select *, x - row_number() over (partition by scene_id, class, y order by x) as isl from lay) group by scene_id, class, y, isl)"
)
COMPONENT_VIEWS = RUN_VIEWS + (
    ", node as (select *, y * 50 + x0 as id from runs)"
    ", touch as (select p.scene_id, p.class, p.id as u, q.id as v from node p join node q on p.scene_id = q.scene_id and p.class = q.class and q.y = p.y + 1 and p.x0 <= q.x1 and q.x0 <= p.x1)"
    ", link as (select * from touch union all select scene_id, class, v, u from touch)"
    ", reach as (select scene_id, class, id, id as root from node union select l.scene_id, l.class, l.v, r.root from reach r join link l on l.scene_id = r.scene_id and l.class = r.class and l.u = r.id where r.root < l.v)"
    ", comp as (select n.scene_id, n.class, n.y, n.x0, n.x1, m.component from node n join (select scene_id, class, id, min(root) as component from reach group by all) m using (scene_id, class, id))"
)


RING_VIEWS = COMPONENT_VIEWS + (
    ", dense as (select scene_id, 'threshold' as class, y, x, a as o from det union all select scene_id, 'class_mask', y, x, ref from det)"
    ", d1 as (select *, coalesce(lag(o) over wx, false) as w, coalesce(lead(o) over wx, false) as e from dense window wx as (partition by scene_id, class, y order by x))"
    ", d2 as (select scene_id, class, y, x, o, w, e, y * 50 + x as p, coalesce(lag(o) over wy, false) as n, coalesce(lag(w) over wy, false) as nw, coalesce(lag(e) over wy, false) as ne, "
    "coalesce(lead(o) over wy, false) as s, coalesce(lead(w) over wy, false) as sw, coalesce(lead(e) over wy, false) as se from d1 window wy as (partition by scene_id, class, x order by y))"
    ", edge as ("
    "select scene_id, class, p*4 as id, case when not e then p*4+1 when not ne then (p+1)*4 else (p-49)*4+3 end as succ, not e or ne as turn, y as vy, x+1 as vx from d2 where o and not n "
    "union all select scene_id, class, p*4+1, case when not s then p*4+2 when not se then (p+50)*4+1 else (p+51)*4 end, not s or se, y+1, x+1 from d2 where o and not e "
    "union all select scene_id, class, p*4+2, case when not w then p*4+3 when not sw then (p-1)*4+2 else (p+49)*4+1 end, not w or sw, y+1, x from d2 where o and not s "
    "union all select scene_id, class, p*4+3, case when not n then p*4 when not nw then (p-50)*4+3 else (p-51)*4+2 end, not n or nw, y, x from d2 where o and not w)"
    ", walk as (select scene_id, class, id, id as ring, cast(0 as bigint) as seq, turn, succ from edge union all "
    "select f.scene_id, f.class, f.id, k.ring, k.seq + case when k.turn then 1 else 0 end, f.turn, f.succ from walk k join edge f on f.scene_id = k.scene_id and f.class = k.class and f.id = k.succ where k.ring < f.id)"
    ", ringed as (select k.scene_id, k.class, k.ring, k.seq, f.vy, f.vx, k.turn from walk k join (select scene_id, class, id, min(ring) as ring from walk group by all) m using (scene_id, class, id, ring) join edge f using (scene_id, class, id))"
    ", ring_n as (select scene_id, class, ring, count(*) filter (turn) as n from ringed group by all)"
    ", ring_owner as (select r.scene_id, r.class, r.ring, r.n, c.component, r.ring <> c.component * 4 as hole from ring_n r join comp c on c.scene_id = r.scene_id and c.class = r.class "
    f"and c.y = {X._idiv(X._idiv('r.ring', 4), 50)} and {X._idiv('r.ring', 4)} % 50 between c.x0 and c.x1)"
    ", vert as (select o.scene_id, o.class, o.component, o.ring, o.hole, o.n, unnest(case when v.seq = 0 then [0, o.n] else [v.seq] end) as seq, v.vy, v.vx from ringed v join ring_owner o using (scene_id, class, ring) where v.turn)"
)


def class_layers(spark, sf):
    return C.layers(X.masks60(spark, sf), CLASSES)


def component_runs(spark, sf):
    return C.mask_components(class_layers(spark, sf), X.COARSE_SHAPE, BLOCK)


@query("mask_runs", X.sql("select * from runs", RUN_VIEWS))
def mask_runs(spark, sf):
    return C.mask_runs(class_layers(spark, sf))


@query("run_overlap_join", X.sql(
    "select p.scene_id, p.class, p.y as y_a, p.x0 as x0_a, p.x1 as x1_a, q.y as y_b, q.x0 as x0_b, q.x1 as x1_b from runs p join runs q "
    "on p.scene_id = q.scene_id and p.class = q.class and q.y = p.y + 1 and p.x0 <= q.x1 and q.x0 <= p.x1", RUN_VIEWS))
def run_overlap_join(spark, sf):
    return C.run_overlap_join(C.mask_runs(class_layers(spark, sf)), bucket=8)


@query("mask_components", X.sql("select * from comp", COMPONENT_VIEWS, recursive=True))
def mask_components(spark, sf):
    return component_runs(spark, sf)


@query("component_stats", X.sql(
    "select c.*, 1 - c.nruns + coalesce(t.pairs, 0) as holes from (select scene_id, class, component, cast(sum(x1 - x0 + 1) as bigint) as pixels, min(y) as y_min, max(y) as y_max, min(x0) as x_min, max(x1) as x_max, "
    "cast(sum(x1 - x0 + 1) * 3600 as double) as area_m2, count(*) as nruns from comp group by all) c left join "
    "(select p.scene_id, p.class, p.component, count(*) as pairs from comp p join comp q on p.scene_id = q.scene_id and p.class = q.class and q.y = p.y + 1 and p.x0 <= q.x1 and q.x0 <= p.x1 group by all) t using (scene_id, class, component)",
    COMPONENT_VIEWS, recursive=True).replace("select c.*, 1 -", "select c.* exclude (nruns), 1 -"))
def component_stats(spark, sf):
    return C.component_stats(component_runs(spark, sf), 60)


def rings(spark, sf):
    return V.polygon_rings(class_layers(spark, sf), component_runs(spark, sf), X.COARSE_SHAPE, BLOCK)


@query("polygon_rings", X.sql("select * from vert", RING_VIEWS, recursive=True))
def polygon_rings(spark, sf):
    """Closed rings, one vertex per row; the oracle walks every edge recursively."""
    return rings(spark, sf).drop("pixels")


@query("ring_summary", X.sql(
    "select scene_id, class, component, cast(sum(x1 - x0 + 1) as bigint) as pixels from comp group by all", COMPONENT_VIEWS, recursive=True))
def ring_summary(spark, sf):
    """Signed ring areas add up to the pixels of their region."""
    one = rings(spark, sf).filter(F.col("seq") == 0)
    return one.groupBy("scene_id", "class", "component").agg(F.sum("pixels").alias("pixels"))


def features(spark, sf):
    return V.features_wgs84(rings(spark, sf), X.scenes(spark, sf), 60)


@query("features_wgs84", X.sql(
    "select scene_id, class, component, ring, hole, seq, cast(round_even(lon * 1e6, 0) as bigint) as lon_micro, cast(round_even(lat * 1e6, 0) as bigint) as lat_micro from located",
    RING_VIEWS + ", " + inverse_views(
        "select *, cast(600000 + 3000*(scene_id % 10) + vx*60 as double) as e, "
        f"cast(5500020 - 1800*{X._idiv('scene_id', 10)} - vy*60 as double) as n from (select * exclude (n) from vert)"), recursive=True))
def features_wgs84(spark, sf):
    """Vertices in longitude/latitude rounded to six decimals, as micro-degrees."""
    micro = lambda c: F.rint(F.col(c) * 1e6).cast("bigint").alias(f"{c}_micro")
    return features(spark, sf).select("scene_id", "class", "component", "ring", "hole", "seq", micro("lon"), micro("lat"))


@query("feature_area_check", X.sql(
    "select scene_id, class, cast(count(*) * 3600 as double) as area_m2, true as ok from lay group by all", RUN_VIEWS))
def feature_area_check(spark, sf):
    """Written polygons against the mask area."""
    area = A.layer_area(X.masks60(spark, sf).withColumnsRenamed({"a": "threshold", "ref": "class_mask"}), ["threshold", "class_mask"], 60)
    return V.feature_area_check(features(spark, sf), area).select("scene_id", "class", "area_m2", "ok")


@query("feature_extent_check", X.sql(
    "select scene_id, class, component, true as ok from (select distinct scene_id, class, component from comp)", COMPONENT_VIEWS, recursive=True))
def feature_extent_check(spark, sf):
    foot = scene_footprints(spark, sf)
    box = foot.select("scene_id", *[c.alias(n) for n, c in A.footprint_bbox(F.col("footprint")).items()])
    return V.feature_extent_check(features(spark, sf), box)


@query("ring_validity", X.sql(
    "select scene_id, class, cast(sum(1 + holes) as bigint) as rings, true as ok from (select c.scene_id, c.class, c.component, 1 - c.nruns + coalesce(t.pairs, 0) as holes from "
    "(select scene_id, class, component, count(*) as nruns from comp group by all) c left join (select p.scene_id, p.class, p.component, count(*) as pairs from comp p join comp q "
    "on p.scene_id = q.scene_id and p.class = q.class and q.y = p.y + 1 and p.x0 <= q.x1 and q.x0 <= p.x1 group by all) t using (scene_id, class, component)) group by scene_id, class",
    COMPONENT_VIEWS, recursive=True))
def ring_validity(spark, sf):
    """Rings per layer equal regions plus holes, and every ring is well formed."""
    valid = V.ring_validity(rings(spark, sf))
    return valid.groupBy("scene_id", "class").agg(F.count(F.lit(1)).alias("rings"), F.every("ok").alias("ok"))
