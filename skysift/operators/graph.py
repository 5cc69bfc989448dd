"""Connected components of a link table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from skysift.session import cut_lineage, drop_scratch


def connected_components(links: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Smallest node reachable from each linked node: (keys, node, root).

    ``links`` has the columns (keys, u, v). Large-star and small-star steps
    alternate until every component is a star around its smallest node, which
    takes a number of rounds logarithmic in the longest path. Each round is
    written to the shared folder; the round before it is deleted.
    """
    keys = list(keys)
    forward = links.select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct()
    edges, mark = _cut_and_mark(forward, keys)
    while True:
        both = edges.unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*keys, "u").agg(F.min("v").alias("m")).select(*keys, "u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        small = large.join(least, [*keys, "u"]).select(
            *keys, F.inline(F.array(
                F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b"))))
        ).select(*keys, F.col("a").alias("u"), F.col("b").alias("v")).filter("u != v").distinct()
        new, new_mark = _cut_and_mark(small, keys)
        drop_scratch(edges)
        edges = new
        if new_mark == mark:
            break
        mark = new_mark
    roots = edges.select(*keys, F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(*keys, F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _cut_and_mark(edges: DataFrame, keys: list[str]) -> tuple[DataFrame, tuple]:
    """The edges written out, with their count and an order-free checksum."""
    seen = Observation()
    out = cut_lineage(edges.observe(
        seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)")).alias("mark")), "links")
    return out, (seen.get["n"], seen.get["mark"])
