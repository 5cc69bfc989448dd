"""Fixed-point text of doubles."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed_text(value: Column, decimals: int = 6) -> Column:
    """Decimal text of a value between -256 and 256, rounded on its exact binary value.

    ``format_string`` rounds the shortest decimal form half up and so differs on
    values such as 0.2559375, whose double lies below the tie. Scaling by a
    power of two is exact, and the rest is integer arithmetic.
    """
    size = F.abs(value)

    def rounded(bits: int) -> Column:
        whole = (size * F.lit(float(2**bits))).cast("bigint").cast("decimal(20,0)")
        scaled = whole * F.lit(Decimal(10**decimals))
        unit = F.lit(Decimal(2**bits))
        down = F.call_function("div", scaled, unit)
        twice = (scaled - down.cast("decimal(20,0)") * unit) * F.lit(Decimal(2))
        up = (twice > unit) | ((twice == unit) & (down % 2 == 1))
        return down + up.cast("bigint")

    count = F.when(size >= 64, rounded(54)).when(size >= 0.5, rounded(55)).when(size >= 2.0**-10, rounded(62)).otherwise(rounded(72))
    exact = F.concat(
        F.when(value < 0, "-").otherwise(""), F.call_function("div", count, F.lit(10**decimals)).cast("string"), F.lit("."),
        F.lpad((count % 10**decimals).cast("string"), decimals, "0"))
    # Away from a tie both ways agree; the scaled value is off by far less than 1e-3.
    scaled = size * F.lit(float(10**decimals))
    return F.when(F.abs(scaled - F.floor(scaled) - 0.5) < 1e-3, exact).otherwise(F.format_string(f"%.{decimals}f", value))
