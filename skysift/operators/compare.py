"""Comparing detector runs: tiles, audit sample, verdicts, decision.

``runs`` has one row per (scene_id, detector, tile_row, tile_col) with
``cloud_cover_percent`` and ``valid``; tables here are tile-sized.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysift.constants import AUDIT_TOP, NAMED_TILES
from skysift.functions import tilemath as M

TILE = ["scene_id", "tile_row", "tile_col"]
TIE_MARGIN = 1
Named = Sequence[tuple[int, int, str]]


def pixel_compare(candidate: DataFrame, reference: DataFrame, flag: str = "cloud") -> DataFrame:
    """Join two mask tables on the pixel; adds ``predicted`` and ``expected``."""
    keys = [k for k in ("scene_id", "brow", "bcol") if k in candidate.columns and k in reference.columns] + ["y", "x"]
    left = candidate.select(*keys, F.col(flag).alias("predicted"))
    return left.join(reference.select(*keys, F.col(flag).alias("expected")), keys)


def tile_compare(runs: DataFrame, reference: str) -> DataFrame:
    """Disagreement with the reference run, in both directions."""
    ref = runs.filter(F.col("detector") == reference).select(*TILE, F.col("valid").alias("ref_valid"))
    joined = runs.filter(F.col("detector") != reference).join(ref, TILE)
    v, r = F.col("valid"), F.col("ref_valid")
    return joined.groupBy("scene_id", "detector").agg(
        F.count(F.lit(1)).alias("tiles"),
        F.count_if(~v).alias("invalid_tiles"),
        F.count_if(v != r).alias("disagreements"),
        F.count_if(r & ~v).alias("discards_where_ref_keeps"),
        F.count_if(~r & v).alias("keeps_where_ref_discards"),
    )


def character(row: Column, col: Column, named: Named) -> Column:
    """Character of a named tile, NULL for the others."""
    out = F.lit(None).cast("string")
    for r, c, text in named:
        out = F.when((row == r) & (col == c), text).otherwise(out)
    return out


def named_tile_table(runs: DataFrame, detectors: Sequence[str], named: Named = NAMED_TILES) -> DataFrame:
    """Percentages of the named tiles, one column per run."""
    labelled = runs.withColumn("character", character(F.col("tile_row"), F.col("tile_col"), named))
    return (
        labelled.filter(F.col("character").isNotNull())
        .groupBy(*TILE, "character").pivot("detector", list(detectors)).agg(F.first("cloud_cover_percent"))
    )


def disagreement(runs: DataFrame, first: str, second: str) -> DataFrame:
    """Absolute percentage difference of two runs per tile."""
    pct = F.col("cloud_cover_percent")
    return runs.filter(F.col("detector").isin(first, second)).groupBy(*TILE).agg(
        F.abs(F.max(F.when(F.col("detector") == first, pct)) - F.max(F.when(F.col("detector") == second, pct))).alias("diff"))


def top_disagreements(runs: DataFrame, first: str, second: str, named: Named = NAMED_TILES, top: int = AUDIT_TOP) -> DataFrame:
    """The tiles of each scene where two runs differ most; row-major order breaks ties."""
    others = disagreement(runs, first, second).filter(character(F.col("tile_row"), F.col("tile_col"), named).isNull())
    order = Window.partitionBy("scene_id").orderBy(F.desc("diff"), "tile_row", "tile_col")
    return others.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def audit_sample(runs: DataFrame, first: str, second: str, named: Named = NAMED_TILES, top: int = AUDIT_TOP) -> DataFrame:
    """Named tiles and the top disagreements: fixed before anyone looks at them."""
    label = character(F.col("tile_row"), F.col("tile_col"), named)
    fixed = (
        runs.filter((F.col("detector") == first) & label.isNotNull())
        .select(*TILE, label.alias("character"), F.lit("named tile").alias("reason"))
    )
    ranked = top_disagreements(runs, first, second, named, top).select(
        *TILE, F.lit("").alias("character"),
        F.format_string(f"top-{top} disagreement (%.4f pp between {first} and {second})", F.col("diff")).alias("reason"))
    return fixed.unionByName(ranked)


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows found on one side only, with their multiplicity kept; empty when equal."""
    cols = left.columns
    return left.exceptAll(right.select(*cols)).withColumn("side", F.lit("left")).unionByName(
        right.select(*cols).exceptAll(left).withColumn("side", F.lit("right")))


def audit_agreement(runs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Run verdicts against human ones; thin cloud has no agreed answer and is not scored."""
    joined = runs.join(verdicts.select(*TILE, "verdict"), TILE)
    expected = F.when(F.col("verdict") == "clear", True).when(F.col("verdict") == "cloud", False)
    hit = F.col("valid") == expected
    miss = F.struct("tile_row", "tile_col", "verdict")
    return joined.groupBy("scene_id", "detector").agg(
        F.count(expected).alias("scored"),
        F.count_if(hit).alias("matches"),
        F.count_if(expected.isNull()).alias("excluded"),
        F.array_sort(F.collect_list(F.when(~hit, miss))).alias("mismatches"),
    ).withColumn("agreement", F.when(F.col("scored") > 0, F.col("matches") / F.col("scored")))


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("verdict").agg(
        F.count(F.lit(1)).alias("tiles"), F.count_if(F.col("verdict") != "thin_cloud").alias("scored"))


def spread_table(runs: DataFrame, tile_pixels: int) -> DataFrame:
    """Discarded tiles and scene percentage of each method."""
    return runs.groupBy("scene_id", "detector").agg(
        F.count_if(~F.col("valid")).alias("invalid_tiles"),
        (F.lit(100.0) * F.sum("cloud_pixels") / (F.count(F.lit(1)) * tile_pixels)).alias("scene_cloud_percent"))


def comparison_table(runs: DataFrame, scores: DataFrame | None, verdicts: DataFrame, reference: str, tile_pixels: int) -> DataFrame:
    """One row per run: spread, pixel scores, tile disagreement, audit agreement.

    A missing reference, or a run without pixel masks, leaves NULLs.
    """
    out = spread_table(runs, tile_pixels)
    tiles = tile_compare(runs, reference).drop("invalid_tiles")
    audit = audit_agreement(runs, verdicts).drop("mismatches")
    on = ["scene_id", "detector"]
    if scores is not None:
        out = out.join(scores.select(*on, "precision", "recall", "f1", "iou"), on, "left")
    out = out.join(tiles, on, "left").join(audit, on, "left")
    agree = F.lit(100.0) * (F.lit(1.0) - F.col("disagreements") / F.col("tiles"))
    return out.withColumn("reference_agreement", F.when(F.col("detector") == reference, 100.0).otherwise(agree)).drop("tiles")


def decide_winner(runs: DataFrame, verdicts: DataFrame, simple: str, other: str, reference: str) -> DataFrame:
    """More audit matches win; within one tile the simpler method wins.

    The reference run is never a candidate; a missing run is an error.
    """
    audit = audit_agreement(runs, verdicts)
    by_scene = audit.groupBy("scene_id").agg(
        F.max(F.when(F.col("detector") == simple, F.col("matches"))).alias("simple_matches"),
        F.max(F.when(F.col("detector") == other, F.col("matches"))).alias("other_matches"),
        F.max(F.when(F.col("detector") == simple, F.col("scored"))).alias("scored"),
        F.count_if(F.col("detector") == reference).alias("references"),
    )
    complete = F.col("simple_matches").isNotNull() & F.col("other_matches").isNotNull() & (F.col("references") > 0)
    gap = F.col("simple_matches") - F.col("other_matches")
    tie = F.abs(gap) <= TIE_MARGIN
    winner = F.when(tie | (gap > 0), simple).otherwise(other)
    # A filter, so that no choice of columns drops the guard.
    return by_scene.filter(F.assert_true(complete, "a run is missing").isNull()).select(
        "scene_id", "scored", "simple_matches", "other_matches", winner.alias("winner"),
        F.when(tie, "tie: simpler method").otherwise("higher audit agreement").alias("rule"),
    )


def chips_vs_report(chips: DataFrame, report: DataFrame) -> DataFrame:
    """Missing and unexpected chip names against the valid rows."""
    wanted = report.filter("valid").select("scene_id", M.tile_name(F.col("tile_row"), F.col("tile_col")).alias("name"), F.lit(True).alias("wanted"))
    found = chips.select("scene_id", "name", F.lit(True).alias("found"))
    both = wanted.join(found, ["scene_id", "name"], "full")
    return both.filter(F.col("wanted").isNull() | F.col("found").isNull()).select(
        "scene_id", "name", F.when(F.col("found").isNull(), "missing").otherwise("unexpected").alias("problem"))


def run_recompute_diff(recomputed: DataFrame, report: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Recomputed tiles against a stored report, per scene; every tile has to be on both sides."""
    joined = recomputed.select(*TILE, "cloud_cover_percent", "valid").join(
        report.select(*TILE, F.col("cloud_cover_percent").alias("stored"), F.col("valid").alias("stored_valid")), TILE, "full")
    lone = F.count_if(F.col("valid").isNull() | F.col("stored_valid").isNull())
    gap = F.max(F.abs(F.col("cloud_cover_percent") - F.col("stored")))
    flips = F.count_if(F.col("valid") != F.col("stored_valid"))
    return joined.groupBy("scene_id").agg(
        F.count(F.lit(1)).alias("tiles"), lone.alias("one_sided"), gap.alias("max_gap"), flips.alias("verdict_changes"),
        F.coalesce((gap <= tolerance) & (flips == 0) & (lone == 0), F.lit(False)).alias("ok"))


def point_lookup(points: DataFrame, px: DataFrame, tiles: DataFrame) -> DataFrame:
    """Class flags and tile verdict under each point.

    ``points`` has scene_id, y, x on the coarse grid; the tile of a point is
    that of its upper-left 10 m pixel and is given as tile_row, tile_col. Points
    may crowd on a few pixels: pixels and tiles are looked up once per distinct
    position, and the last join is one that adaptive execution may broadcast or
    split where it is skewed. A point off every pixel keeps its row, with NULL flags.
    """
    where = ["scene_id", "y", "x", "tile_row", "tile_col"]
    flags = px.select("scene_id", "y", "x", "opaque", "cirrus", "snow")
    known = points.select(*where).distinct().join(flags, ["scene_id", "y", "x"], "left").join(
        tiles.select(*TILE, "cloud_cover_percent", "valid"), TILE, "left")
    return points.join(known, where, "left")
