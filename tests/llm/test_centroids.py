import hashlib
import math
import random

from skysift.llm import centroids


def plain(rows, clusters=16, rounds=3, size=64, scale=64):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [max(-(1 << 27), min(1 << 27, math.floor(x * scale))) for x in v]))
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:clusters]
    centres = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centres))
    for _ in range(rounds):
        homes = [near(v)[1] for _, v in kept]
        centres = [[sum(col) // len(own) for col in zip(*own)] if (own := [v for (_, v), h in zip(kept, homes) if h == k]) else c for k, c in enumerate(centres)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = {k: sum(d for _, c, d in found if c == k) for k in range(len(centres))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, c, d in found), key=str)


def rows(n=300, size=64):
    r = random.Random(5)
    hubs = [[r.gauss(0, 0.3) for _ in range(size)] for _ in range(5)]
    out = [(i, [x + r.gauss(0, 0.05) for x in r.choice(hubs[:1] if i % 3 == 0 else hubs)]) for i in range(n)]
    base = out[1][1]
    return out + [
        (None, base), (None, base), (4, base), (4, base), (7_001, None), (7_002, base[:-1]), (7_003, base + [0.0]), (7_004, [None] + base[1:]), (7_005, [math.nan] + base[1:]),
        (7_006, [-math.inf] + base[1:]), (7_007, [1e30] + base[1:]), (7_008, [-1e30] * size), (7_009, [])]


def run(spark, table, **options):
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in table], "vec_id bigint, embedding array<float>, cluster int, distance int").repartition(4)
    return sorted(map(tuple, centroids.report(*centroids.cluster(frame, **options)).collect()), key=str)


def as_float(table):
    import numpy as np

    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in table]


def test_matches_plain_rounds(spark):
    table = as_float(rows())
    assert run(spark, table) == plain(table)


def test_ties_and_few_vectors(spark):
    same = [(i, [0.5] * 64) for i in range(40)]
    assert run(spark, same) == plain(same)
    few = as_float(rows(6))[:5]
    assert run(spark, few) == plain(few)


def test_other_parameters(spark):
    table = as_float(rows(120, 8))
    assert run(spark, table, clusters=4, rounds=5, size=8, scale=1000) == plain(table, 4, 5, 8, 1000)


def test_empty_table(spark):
    assert run(spark, []) == [] and run(spark, [(1, None)]) == []


def test_no_python_worker(spark):
    frame = spark.createDataFrame(rows(50), "vec_id bigint, embedding array<float>")
    plan = centroids._assigned(centroids.quantised(frame), [[0] * 64, [1] * 64], "vec_id")._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan
