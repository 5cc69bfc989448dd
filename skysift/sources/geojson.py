"""Delivered FeatureCollections, read back from their lines of text.

A document is never held whole. Lines are numbered within the splits of its
files; what came before a split (features, rings, points, the last line) is a
running sum over one row per split. The form has a fixed depth, so a document is
sound exactly if it starts and ends as it should and each line may follow the
one before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skysift.session import cut_lineage

#: Kinds of line: head, feature, ring opened, point, ring closed, feature closed, end.
POINT = r"^\[(-?\d+\.\d+),(-?\d+\.\d+)\]$"
FEATURE = r'^\{"type":"Feature","properties":\{"class":"([^"\\]*)"\},"geometry":\{"type":"Polygon","coordinates":\[$'
HEAD = r'^\{"type":"FeatureCollection",.*"features":\[$'
#: A line's kind behind that of the line before, with the comma it must or must not have.
STEPS = ("H", "HF", "HE", "FR", "RP", "P,P", "PC", "C,R", "CD", "D,F", "DE")
SPLIT = ("scene_id", "file", "block")


def _parsed(lines: DataFrame) -> DataFrame:
    bare = F.regexp_replace("value", "^,", "")
    kind = (
        F.when(bare.rlike(POINT), "P").when(bare == "[", "R").when(bare == "]", "C").when(bare == "]}}", "D")
        .when(bare == "]}", "E").when(bare.rlike(FEATURE), "F").when(bare.rlike(HEAD), "H").otherwise("?")
    )
    number = lambda i: F.when(F.col("kind") == "P", F.regexp_extract(bare, POINT, i).cast("double"))
    return lines.withColumn("kind", kind).select(
        *SPLIT, "line", "kind", F.col("value").startswith(",").alias("comma"),
        F.when(F.col("kind") == "F", F.regexp_extract(bare, FEATURE, 1)).alias("class"), number(1).alias("lon"), number(2).alias("lat"))


def scan_geojson(spark: SparkSession, path: str, carry: DataFrame | None = None) -> DataFrame:
    """Lines of all documents below ``path``/scene_id=..., with their place in the document.

    Columns: scene_id, kind, bad (may not stand here), class, feature, ring, hole,
    seq, lon, lat, and lon0, lat0 of the point before it in its ring. Features and
    rings are counted from 1 in a scene, points (kind 'P') from 0 in a ring. The
    columns of ``carry`` (one row per scene) come along by split, so that a scene
    of any size is not one join key.
    """
    raw = spark.read.schema("value string, scene_id bigint").text(path).select(
        "scene_id", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), "value")
    order = Window.partitionBy(*SPLIT).orderBy("line")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = _parsed(raw).withColumns({
        "before": F.lag("kind").over(order), "lon0": F.lag("lon").over(order), "lat0": F.lag("lat").over(order),
        **{n: F.count_if(F.col("kind") == k).over(upto) for n, k in (("features", "F"), ("rings", "R"), ("points", "P"))}})
    # Rings before the last feature, points before the last ring.
    local = cut_lineage(counted.withColumns({
        "ring_base": F.max(F.when(F.col("kind") == "F", F.col("rings"))).over(upto),
        "point_base": F.max(F.when(F.col("kind") == "R", F.col("points"))).over(upto),
        "class": F.last("class", True).over(upto)}), "geojson")

    along = Window.partitionBy("scene_id").orderBy("file", "block")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c: F.max_by(c, "line").alias(c)
    splits = local.groupBy(*SPLIT).agg(
        *[last(c) for c in ("kind", "lon", "lat", "class", "features", "rings", "points", "ring_base", "point_base")], F.max("line").alias("end"))
    summed = splits.withColumns({f"{c}_0": F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in ("features", "rings", "points")})
    offsets = summed.select(
        *SPLIT, "features_0", "rings_0", "points_0",
        F.max(F.col("rings_0") + F.col("ring_base")).over(earlier).alias("ring_base_0"),
        F.max(F.col("points_0") + F.col("point_base")).over(earlier).alias("point_base_0"),
        F.last("class", True).over(earlier).alias("class_0"), F.lag("kind").over(along).alias("before_0"),
        F.lag("lon").over(along).alias("lon_0"), F.lag("lat").over(along).alias("lat_0"),
        F.when(F.lead("file").over(along).isNull(), F.col("end")).alias("end"))
    more = []
    if carry is not None:
        more = [c for c in carry.columns if c != "scene_id"]
        offsets = offsets.join(carry, "scene_id", "left")
    first = F.col("before").isNull()
    step = F.concat(F.coalesce("before", "before_0", F.lit("")), F.when(F.col("comma"), ",").otherwise(""), "kind")
    ended = F.coalesce((F.col("line") == F.col("end")) & (F.col("kind") != "E"), F.lit(False))
    ring = F.col("rings_0") + F.col("rings")
    in_feature = ring - F.coalesce(F.col("rings_0") + F.col("ring_base"), F.col("ring_base_0"))
    seq = F.col("points_0") + F.col("points") - 1 - F.coalesce(F.col("points_0") + F.col("point_base"), F.col("point_base_0"))
    came = lambda c: F.when(first, F.col(f"{c}_0")).otherwise(F.col(f"{c}0"))
    return local.join(offsets, list(SPLIT)).select(
        "scene_id", "kind", (~step.isin(*STEPS) | ended).alias("bad"), F.coalesce("class", "class_0").alias("class"),
        (F.col("features_0") + F.col("features")).alias("feature"), ring.alias("ring"), (in_feature > 1).alias("hole"), seq.alias("seq"),
        "lon", "lat", came("lon").alias("lon0"), came("lat").alias("lat0"), *more)
