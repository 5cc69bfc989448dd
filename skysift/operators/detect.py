"""Detectors: named functions that add a boolean ``cloud`` column."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift.constants import MODEL_DEFAULTS, THRESHOLD_DEFAULTS
from skysift.functions import radiometry as R
from skysift.operators.grid import block_keys
from skysift.operators.neighborhood import prob_morph_mask
from skysift.operators.resample import multires_join

Detector = Callable[[DataFrame], DataFrame]
_FACTORIES: dict[str, Callable[..., Detector]] = {}


def register(name: str):
    """Make a detector factory available under a name."""
    def add(factory: Callable[..., Detector]) -> Callable[..., Detector]:
        _FACTORIES[name] = factory
        return factory

    return add


def available() -> list[str]:
    return sorted(_FACTORIES)


def build(name: str, **params) -> Detector:
    if name not in _FACTORIES:
        raise ValueError(f"no detector named {name!r}; known: {', '.join(available())}")
    return _FACTORIES[name](**params)


@register("class_mask")
def class_mask() -> Detector:
    """The product's own classes: opaque or cirrus."""
    return lambda px: px.withColumn("cloud", R.class_union(F.col("opaque"), F.col("cirrus")))


@register("threshold")
def threshold(
    t_bright: float | None = None, t_ndsi: float | None = None, t_cirrus: float | None = None,
    offset: float = -1000.0, quantification: float = 10000.0,
) -> Detector:
    """Brightness, spectral slope and the cirrus band on DN columns."""
    given = {"t_bright": t_bright, "t_ndsi": t_ndsi, "t_cirrus": t_cirrus}
    limits = {k: THRESHOLD_DEFAULTS[k] if v is None else v for k, v in given.items()}

    def apply(px: DataFrame) -> DataFrame:
        r = {b: R.reflectance(F.col(b), offset, quantification) for b in ("b02", "b03", "b04", "b10", "b11")}
        bright = R.brightness(r["b02"], r["b03"], r["b04"])
        return px.withColumn("cloud", R.cloud_rule(bright, R.ndsi(r["b03"], r["b11"]), r["b10"], **limits))

    return apply


@register("model")
def model(
    prob_threshold: float | None = None, average_over: int | None = None, dilation_size: int | None = None,
    shape: tuple[int, int] | None = None, edge: int = 183, column: str = "q24", configured: dict[str, float] | None = None,
) -> Detector:
    """Fixed-point probability, averaged over a disk, over a threshold, dilated by a disk.

    An argument goes before ``configured`` (a parsed file), that before the
    default; 0 turns averaging or dilation off. Both need ``shape``, the rows and
    columns of a scene.
    """
    given = {"prob_threshold": prob_threshold, "average_over": average_over, "dilation_size": dilation_size}
    used = {k: v if v is not None else (configured or {}).get(k, MODEL_DEFAULTS[k]) for k, v in given.items()}
    average, dilate = int(used["average_over"] or 0), int(used["dilation_size"] or 0)
    if not average and not dilate:
        return lambda px: px.withColumn("cloud", R.prob24_mask(F.col(column), used["prob_threshold"]))
    if shape is None:
        raise ValueError("averaging and dilation need the shape of a scene")

    def apply(px: DataFrame) -> DataFrame:
        mask = prob_morph_mask(px, column, used["prob_threshold"], average, dilate, shape, edge=edge)
        return px.join(mask.select("scene_id", "y", "x", "cloud"), ["scene_id", "y", "x"])

    return apply


def band_stack(long: DataFrame, bands: Sequence[str]) -> DataFrame:
    """(scene, band, y, x, dn) rows -> one row per pixel, one column per band."""
    keys = ["scene_id", *block_keys(long), "y", "x"]
    return (
        long.groupBy(*keys)
        .agg(*[F.max(F.when(F.col("band") == b, F.col("dn"))).alias(b) for b in bands])
    )


def fine_stack(px10: DataFrame, px20: DataFrame, px60: DataFrame) -> DataFrame:
    """The five bands of the rule on the 10 m grid."""
    out = multires_join(px10.select("scene_id", *block_keys(px10), "y", "x", "b02", "b03", "b04"), px20, 2, ["b11"])
    return multires_join(out, px60, 6, ["b10"])
