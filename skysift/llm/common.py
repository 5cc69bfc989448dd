"""Shared helpers: tables, Arrow texts, words as byte ranges."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Bytes of text that one step of a batch works on.
STEP_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Which of the 256 bytes lie in none of the (first, last) ranges."""
    out = np.ones(256, bool)
    for first, last in ranges:
        out[first:last + 1] = False
    return out


#: Bytes of words that white space separates; bytes from 0x80 are parts of other characters.
PLAIN_WORD = byte_class((0x09, 0x0D), (0x20, 0x20))
#: Digits, letters and everything that is not ASCII.
ALNUM_WORD = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the n + 1 offsets of the texts; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, wide)[column.offset:column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of at most ``size`` bytes of text (one row at least)."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the n + 1 word offsets of the texts."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = is_word[data]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[edges - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, is_word: np.ndarray) -> pa.Array:
    """The words as one binary array."""
    packed = data[is_word[data]]
    cuts = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=cuts[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(packed)])


def ramp(counts: np.ndarray) -> np.ndarray:
    """0 .. c - 1 for each count c, one after the other."""
    total = int(counts.sum())
    first = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(first, counts)


def list_array(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """The values dealt to lists of the given lengths."""
    cuts = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=cuts[1:])
    return pa.ListArray.from_arrays(pa.array(cuts), values)


def free_names(carry: Sequence[str], own: Sequence[str]) -> list[str]:
    """The carried names, with as many underscores behind as keep them apart from an operator's own."""
    out: list[str] = []
    for name in carry:
        while name in own or name in out:
            name += "_"
        out.append(name)
    return out


def by_text(docs: DataFrame, carry: Sequence[str], own: str, make: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """The carried columns and those that ``make`` gives for the texts; ``own`` names and types the latter.

    A carried column with a name of the operator's own gets an underscore behind it.
    """
    added = StructType.fromDDL(own)
    schema = StructType([StructField(n, docs.schema[c].dataType) for n, c in zip(free_names(carry, added.names), carry)] + added.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "_text"):
            yield pa.RecordBatch.from_arrays([*part.columns[1:], *make(part.column("_text"))], schema.names)

    return docs.select(F.col("text").alias("_text"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(carry)]).mapInArrow(run, schema)
