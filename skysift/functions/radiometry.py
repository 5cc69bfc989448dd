"""Radiometric conversion and the spectral cloud tests, in float32.

Spark divides FLOAT by FLOAT in double, so every quotient is cast back; the
double quotient of two floats rounds to the correctly rounded float.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skysift.constants import PROB_SCALE, QUANT_RANGES


def f32(value: Column | float) -> Column:
    col = value if isinstance(value, Column) else F.lit(float(value))
    return col.cast("float")


def f32div(num: Column | float, den: Column | float) -> Column:
    return (f32(num) / f32(den)).cast("float")


def reflectance(dn: Column, offset: Column | float = -1000.0, quantification: Column | float = 10000.0) -> Column:
    """(DN + offset) / quantification; negative noise is kept."""
    return f32div(f32(dn) + f32(offset), quantification)


def clip_reflectance(refl: Column) -> Column:
    return F.greatest(refl, f32(0.0))


def nodata_flag(dn: Column, nodata: Column | int = 0) -> Column:
    return dn == (nodata if isinstance(nodata, Column) else F.lit(nodata))


def brightness(r02: Column, r03: Column, r04: Column) -> Column:
    return f32div(r02 + r03 + r04, 3.0)


def ndsi(r03: Column, r11: Column) -> Column:
    """Green / shortwave-infrared slope; a zero denominator gives 0."""
    den = r03 + r11
    return F.when(den != f32(0.0), f32div(r03 - r11, den)).otherwise(f32(0.0))


def cirrus_flag(r10: Column, t_cirrus: Column | float) -> Column:
    return r10 > f32(t_cirrus)


def cloud_rule(
    bright: Column, slope: Column, r10: Column,
    t_bright: Column | float, t_ndsi: Column | float, t_cirrus: Column | float,
) -> Column:
    """Bright and white, or seen in the cirrus band."""
    return ((bright > f32(t_bright)) & (slope > f32(t_ndsi))) | cirrus_flag(r10, t_cirrus)


def branch_code(white: Column, cirrus: Column) -> Column:
    """0 clear, 1 bright and white, 2 cirrus band only, 3 both."""
    return (
        F.when(white & cirrus, 3).when(white, 1).when(cirrus, 2).otherwise(0)
    )


def quantize8(value: Column, lo: float, hi: float) -> Column:
    """Clip to [lo, hi] and scale to 0..255, half to even."""
    clipped = F.least(F.greatest(f32(value), f32(lo)), f32(hi))
    return F.rint(f32div(clipped - f32(lo), hi - lo) * f32(255.0)).cast("int")


def quantized_threshold(threshold: Column | float, lo: float, hi: float) -> Column:
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.rint((t - F.lit(lo)) / F.lit(hi - lo) * F.lit(255.0)).cast("int")


def quantized_rule(
    q_bright: Column, q_ndsi: Column, q_b10: Column,
    t_bright: Column | float, t_ndsi: Column | float, t_cirrus: Column | float,
) -> Column:
    """The cloud rule on 8-bit layers."""
    return (
        (q_bright > quantized_threshold(t_bright, *QUANT_RANGES["brightness"]))
        & (q_ndsi > quantized_threshold(t_ndsi, *QUANT_RANGES["ndsi"]))
    ) | (q_b10 > quantized_threshold(t_cirrus, *QUANT_RANGES["b10"]))


def encode_prob24(prob: Column) -> Column:
    """Probability as a 24-bit fixed-point integer."""
    clipped = F.least(F.greatest(prob.cast("double"), F.lit(0.0)), F.lit(1.0))
    return F.least(F.rint(clipped * F.lit(float(PROB_SCALE))), F.lit(PROB_SCALE - 1.0)).cast("int")


def prob_mask(prob: Column, threshold: Column | float) -> Column:
    return prob > threshold


def prob24_mask(code: Column, threshold: Column | float) -> Column:
    """Same test on the fixed-point code; scaling by 2^24 is exact."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return code.cast("double") > t * F.lit(float(PROB_SCALE))


def class_union(opaque: Column, cirrus: Column) -> Column:
    return opaque | cirrus


def mask_binarize(stored: Column) -> Column:
    return stored > 127


def exceeded(value: Column, grid: list[float]) -> Column:
    """How many thresholds of an evenly spaced ascending grid the value exceeds.

    The position on the grid is estimated by division and settled by comparing
    with the four float32 thresholds around it, so rounding cannot change it.
    """
    step = (grid[-1] - grid[0]) / (len(grid) - 1)
    near = F.floor((value.cast("double") - F.lit(grid[0])) / F.lit(step)).cast("int") - 1
    base = F.least(F.greatest(near, F.lit(0)), F.lit(len(grid)))
    marks = F.array(*[f32(t) for t in grid])
    out = base
    for ahead in range(4):
        out = out + F.coalesce((value > F.get(marks, base + ahead)).cast("int"), F.lit(0))
    return out


def fixed24(value: Column) -> Column:
    """Fixed-point copy of a ratio, so that sums do not depend on merge order."""
    return F.rint(value.cast("double") * F.lit(float(PROB_SCALE))).cast("bigint")
