"""Shards as runs of a Hilbert curve through several metadata dimensions.

Dimensions are quantised to cells, the cells numbered along a Hilbert curve, the
rows sorted by that number and the order cut into runs of equal length. A run
covers a compact region, so a filter on any of the dimensions skips most files.

The order is a range partitioning: no task holds more than its range, and places
in the whole order are a row's place in its partition plus the rows of the
partitions before it. Sorting by checksum and id behind the curve index lets
ranges cut through any group of copies, and keeps equal texts side by side.

Only DataFrame functions are used. Defined cases: a null text has no bytes and
the checksum 0; null dimensions are in the lowest cell. Repeated rows get slots
of their own, as do all rows with equal sort keys, in no fixed order among
themselves. An empty table gives an empty table. Columns named in ``carry``
travel with the rows; the columns added are in a struct of their own.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.session import cut_lineage

#: Bits of a dimension's cell number.
BITS = 6
#: Bytes of a string, behind what all values begin with, that place it.
PREFIX = 6


def curve_table(dims: int) -> list[int]:
    """Steps of the curve: state * 2**dims + corner -> next state * 2**dims + digit.

    A state is (entry corner, direction); a corner has one bit per dimension.
    """
    size = 1 << dims
    gray = [i ^ (i >> 1) for i in range(size)]
    digit_of = {g: i for i, g in enumerate(gray)}

    def turn(x: int, by: int) -> int:
        by %= dims
        return ((x << by) | (x >> (dims - by))) & (size - 1)

    def trailing_ones(x: int) -> int:
        return ((x ^ (x + 1)).bit_length() - 1) % dims

    out = []
    for entry in range(size):
        for axis in range(dims):
            for corner in range(size):
                digit = digit_of[turn(corner ^ entry, -(axis + 1))]
                start = gray[2 * ((digit - 1) // 2)] if digit else 0
                step = 0 if digit == 0 else trailing_ones(digit if digit % 2 else digit - 1)
                state = (entry ^ turn(start, axis + 1)) * dims + (axis + step + 1) % dims
                out.append(state * size + digit)
    return out


def curve_index(cells: Sequence[str], bits: int = BITS) -> Column:
    """Place along the Hilbert curve of the cell with the given coordinates (names of bigint columns)."""
    dims = len(cells)
    size = 1 << dims
    corner = " + ".join(f"((shiftright({c}, level) & 1L) * {1 << j}L)" for j, c in enumerate(cells))
    table = "array(" + ", ".join(map(str, curve_table(dims))) + ")"
    return F.expr(f"""aggregate(sequence({bits - 1}, 0, -1), struct(0 as state, 0L as at),
        (a, level) -> transform(array(get({table}, cast(a.state * {size} + {corner} as int))),
            v -> struct(shiftright(v, {dims}) as state, a.at * {size} + (v & {size - 1}) as at))[0],
        a -> a.at)""")


def _string_place(column: str, skip: int) -> Column:
    """The bytes behind the common ones as a number, in the order of the strings."""
    behind = F.substring(F.encode(F.col(column), "utf-8"), skip + 1, PREFIX)
    return F.conv(F.hex(F.rpad(behind, PREFIX, F.unhex(F.lit("00")))), 16, 10).cast("bigint")


def _linear(column: str, low: int, high: int, bits: int) -> Column:
    """Cell of a number between the least and the largest value."""
    return F.coalesce(F.expr(
        f"(cast({column} as decimal(20,0)) - cast({low} as decimal(20,0))) * {1 << bits} div cast({high - low + 1} as decimal(21,0))"), F.lit(0).cast("bigint"))


def _size_cell(column: str) -> Column:
    """Two cells for each power of two."""
    power = F.length(F.bin(F.col(column))) - 1
    half = F.expr(f"case when {column} > 1 then (shiftright({column}, length(bin({column})) - 2) & 1L) else 0L end")
    return F.least(2 * power.cast("bigint") + half, F.lit((1 << BITS) - 1).cast("bigint"))


def hilbert_shards(docs: DataFrame, shards: int = 8, carry: Sequence[str] = ("doc_id",), numbers: Sequence[str] = ("doc_id",), strings: Sequence[str] = ("source", "lang")) -> DataFrame:
    """(row, size, text_crc32, at, shard, slot): ``row`` is a struct of the carried columns.

    The dimensions are the size of the text, ``numbers`` and ``strings``.
    Shards differ by one row at most.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), (F.octet_length(text) + F.lit(1)).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        *[F.col(c).cast("bigint").alias(f"_n{i}") for i, c in enumerate(numbers)], *[F.col(c).cast("string").alias(f"_s{i}") for i, c in enumerate(strings)])
    # One row: the ranges of the dimensions.
    ends = docs.agg(*[f(F.col(c).cast(kind)).alias(f"{name}{at}") for name, kind, columns in (("n", "bigint", numbers), ("s", "string", strings))
                      for i, c in enumerate(columns) for f, at in ((F.min, f"{i}_low"), (F.max, f"{i}_high"))]).first()
    cells = {"_c": _size_cell("size")}
    for i, _ in enumerate(numbers):
        cells[f"_cn{i}"] = _linear(f"_n{i}", ends[f"n{i}_low"] or 0, ends[f"n{i}_high"] or 0, BITS)
    for i, _ in enumerate(strings):
        low, high = (ends[f"s{i}_low"] or "").encode(), (ends[f"s{i}_high"] or "").encode()
        skip = len(os.path.commonprefix([low, high]))
        first, last = (int.from_bytes(x[skip:skip + PREFIX].ljust(PREFIX, b"\0"), "big") for x in (low, high))
        rows = rows.withColumn(f"_p{i}", _string_place(f"_s{i}", skip))
        cells[f"_cs{i}"] = _linear(f"_p{i}", first, last, BITS)
    placed = rows.withColumns(cells).withColumn("at", curve_index(list(cells))).select("row", "size", "text_crc32", "at", *[f"_n{i}" for i, _ in enumerate(numbers)])
    keys = ["at", "text_crc32", *[f"_n{i}" for i, _ in enumerate(numbers)]]
    # Written once, so that the numbers of partitions and rows are settled.
    ordered = cut_lineage(
        placed.repartitionByRange(*keys).sortWithinPartitions(*keys).select("row", "size", "text_crc32", "at", F.monotonically_increasing_id().alias("_id")), "ordered")
    # A few numbers for each partition.
    counts = ordered.groupBy(F.shiftright("_id", 33).alias("_part")).agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()
    total, before = 0, {}
    for r in counts:
        before[r._part] = total
        total += r.n
    offsets = docs.sparkSession.createDataFrame([*before.items()] or [(0, 0)], "_part bigint, _before bigint")
    nth = F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)
    numbered = ordered.withColumn("_part", F.shiftright("_id", 33)).join(F.broadcast(offsets), "_part").withColumn("_nth", nth)
    shard = F.expr(f"_nth * {shards} div {max(total, 1)}")
    return numbered.withColumn("_shard", shard).select(
        "row", "size", "text_crc32", "at", F.col("_shard").cast("int").alias("shard"), F.expr(f"_nth - (_shard * {max(total, 1)} + {shards - 1}) div {shards}").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> None:
    """The documents, all columns, in one folder per shard, in the order of the curve.

    The curve's order is kept by range partitions, so a shard is a few files that each cover a run.
    """
    placed = hilbert_shards(docs, shards, docs.columns)
    placed.select("shard", "slot", "row.*").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").parquet(path)
