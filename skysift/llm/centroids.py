"""Clusters of integer vectors by k-means over DataFrame expressions alone.

Vectors are quantised to integers once and written; each round is one scan of that
table. The distance to a centroid is ``zip_with`` and ``aggregate`` over the vector and
a literal array, the nearest centroid ``array_min`` over structs of (distance, number),
and new centroids come from column sums by cluster: partial sums of k rows a task, so a
cluster with most of the vectors costs no more than a small one. Only k rows of sums
reach the driver. All arithmetic is on 64-bit integers and exact.

Defined cases: vectors that are null, of another length, or with a null or non-finite
component are left out. Components are held within 2**27 on either side, so that a
squared distance fits 64 bits. A null id is hashed as an empty one. Rows with equal ids
are vectors of their own; equal hashes are ordered by the vector. With fewer vectors than
clusters there are as many clusters as vectors. An empty table gives an empty table;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.session import cut_lineage, drop_scratch

SIZE, SCALE, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Largest size of a component.
FAR = 1 << 27


def quantised(vectors: DataFrame, size: int = SIZE, scale: int = SCALE, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): the usable vectors, as arrays of integers."""
    wide = vectors.select(F.col(id_column).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    fine = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("x", lambda x: F.greatest(F.lit(-FAR), F.least(F.lit(FAR), F.floor(F.greatest(F.lit(-2.0 * FAR), F.least(F.lit(2.0 * FAR), x * float(scale)))))).cast("bigint"))
    return wide.filter((F.size("x") == size) & F.coalesce(fine, F.lit(False))).select("vec_id", whole.alias("v"))


def _literal(centre: Sequence[int]) -> Column:
    return F.array(*[F.lit(x).cast("bigint") for x in centre])


def _nearest(centres: Sequence[Sequence[int]]) -> Column:
    """struct(distance, cluster) of the nearest centroid; ties go to the smaller number."""
    far = lambda c: F.aggregate(F.zip_with("v", _literal(c), lambda a, b: (a - b) * (a - b)), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return F.array_min(F.array(*[F.struct(far(c).alias("distance"), F.lit(k).alias("cluster")) for k, c in enumerate(centres)]))


def _assigned(points: DataFrame, centres: Sequence[Sequence[int]], *columns: str) -> DataFrame:
    return points.select(*columns, _nearest(centres).alias("best")).select(*columns, "best.cluster", "best.distance")


def _moved(points: DataFrame, centres: list[list[int]], size: int) -> list[list[int]]:
    """Centroids after one round; those without vectors stay."""
    sums = _assigned(points, centres, "v").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(size)])
    out = list(centres)
    for row in sums.collect():  # one row a cluster
        out[row.cluster] = [row[f"s{i}"] // row.n for i in range(size)]
    return out


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, size: int = SIZE, scale: int = SCALE) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of each usable vector, written, and the final centroids."""
    points = cut_lineage(quantised(vectors, size, scale), "points")
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    centres = [list(r.v) for r in points.orderBy(mark, "v").limit(clusters).select("v").collect()]
    if not centres:
        return points.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), []
    for _ in range(rounds):
        centres = _moved(points, centres, size)
    out = cut_lineage(_assigned(points, centres, "vec_id"), "assigned")
    drop_scratch(points)
    return out, centres


def report(assigned: DataFrame, centres: list[list[int]]) -> DataFrame:
    """``assigned`` with the inertia of its cluster and of all, and a digest of its final centroid."""
    if not centres:
        return assigned.select("*", *[F.lit(None).cast(t).alias(n) for n, t in (("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string"))])
    sums = {r.cluster: r.s for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # one row a cluster
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    of = lambda values, kind: F.array(*[F.lit(x).cast(kind) for x in values])[F.col("cluster")]
    return assigned.select(
        "*", of([sums.get(k, 0) for k in range(len(centres))], "bigint").alias("cluster_inertia"), F.lit(sum(sums.values())).cast("bigint").alias("inertia"),
        of(digests, "string").alias("centroid_sha256"))
