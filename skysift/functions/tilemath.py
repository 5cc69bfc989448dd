"""Tile naming, percentages, the validity rule and agreement ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skysift.constants import MAX_CLOUD_PERCENT, MAX_NODATA_FRACTION


def tile_name(row: Column, col: Column) -> Column:
    return F.format_string("tile_r%02d_c%02d", row, col)


def tile_name_parts(name: Column) -> tuple[Column, Column]:
    pattern = r"tile_r(\d+)_c(\d+)"
    return (
        F.regexp_extract(name, pattern, 1).cast("int"),
        F.regexp_extract(name, pattern, 2).cast("int"),
    )


def cloud_percent(count: Column, pixels: Column | int) -> Column:
    px = pixels if isinstance(pixels, Column) else F.lit(pixels)
    return F.lit(100.0) * count / px


def within_cut(count: Column, pixels: int) -> Column:
    """The 30 % rule on integers: nothing is rounded before comparing."""
    return F.lit(100) * count.cast("bigint") <= F.lit(MAX_CLOUD_PERCENT * pixels)


def valid_rule(count: Column, nodata_fraction: Column, pixels: int) -> Column:
    return within_cut(count, pixels) & (nodata_fraction <= F.lit(MAX_NODATA_FRACTION))


def percent_to_count(percent: Column, pixels: int) -> Column:
    """Pixel count behind a printed percentage."""
    return F.rint(percent / F.lit(100.0) * F.lit(pixels)).cast("bigint")


def enough_decimals(text: Column, least: int = 4) -> Column:
    return F.length(F.regexp_extract(text, r"\.(\d+)$", 1)) >= least


def ratio(num: Column, den: Column) -> Column:
    """num / den, 0 where nothing is counted."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def agreement_scores(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    precision = ratio(tp, tp + fp)
    recall = ratio(tp, tp + fn)
    both = precision + recall
    return {
        "precision": precision,
        "recall": recall,
        "f1": F.when(both == 0, F.lit(0.0)).otherwise(F.lit(2.0) * precision * recall / both),
        "iou": ratio(tp, tp + fp + fn),
        "pixel_agreement": ratio(tp + tn, tp + fp + fn + tn),
    }
