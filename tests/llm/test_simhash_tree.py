import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from skysift.llm import simhash_tree


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [words[i:i + 3] for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    """{id: smallest reachable id} of (id, fingerprint) pairs."""
    root = {i: i for i, _ in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a) in enumerate(prints):
        for j, b in prints[:n]:
            if (a ^ b).bit_count() <= 3:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in root}


ODD = ["", None, " \t\n", "one", "one two", "One  TWO x three", "a b c", "a b c", "é ß ü ñ", "x " * 30000, "\n a\tb\x0bc d "]


def test_matches_pairwise_search(documents, texts):
    rows = texts + [(10_000 + i, t) for i, t in enumerate(ODD)]
    got = simhash_tree.near_duplicates(documents(rows)).toPandas()
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    assert dict(zip(got.doc_id, got.fp.astype("int64").to_numpy().view(np.uint64).tolist())) == dict(prints)
    assert dict(zip(got.doc_id, got.component_id)) == plain_components(prints)


@pytest.mark.parametrize("leaf", [4, 64])
def test_trees_find_every_link(spark, leaf):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2 ** 63, 300, dtype=np.int64)
    near = base[rng.integers(0, 300, 2500)]
    for _ in range(3):
        near = near ^ (np.int64(1) << rng.integers(0, 63, len(near)))
    fps = np.unique(np.concatenate([base, near, rng.integers(0, 2 ** 63, 1000, dtype=np.int64)]))
    df = spark.createDataFrame([(int(x),) for x in fps], "fp bigint").repartition(3)
    got = simhash_tree.connected_components(simhash_tree.links(df, leaf=leaf)).toPandas()
    found = dict(zip(got.node, got.root))
    label = np.arange(len(fps))
    close = np.bitwise_count(fps[:, None] ^ fps[None]) <= 3
    while True:
        new = np.where(close, label[None], len(fps)).min(1)
        if (new == label).all():
            break
        label = new
    same = {}
    for fp, l in zip(fps.tolist(), label.tolist()):
        assert same.setdefault(found.get(fp, fp), l) == l
    assert len(same) == len(set(label.tolist()))


def test_empty_table_and_null_id(documents):
    assert simhash_tree.near_duplicates(documents([])).count() == 0
    rows = simhash_tree.near_duplicates(documents([(None, "a b c"), (4, "a b c"), (9, "q")])).collect()
    assert {(r.doc_id, r.component_id) for r in rows} == {(None, 4), (4, 4), (9, 9)}


def test_a_step_of_texts_takes_bounded_memory(spark):
    class Caught:
        select = lambda self, *columns: self
        mapInArrow = lambda self, run, schema: run

    r = random.Random(3)
    texts = [" ".join(f"w{r.randrange(10 ** 4)}" for _ in range(1000)) for _ in range(700)]
    batch = pa.record_batch({"doc_id": pa.array(range(700)), "tag": pa.array(range(700)), "text": texts})
    run = simhash_tree.fingerprints(Caught())
    tracemalloc.start()
    found = [x for part in run(iter([batch])) for x in part.column("fp").to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20
    assert found == simhash_tree.fingerprint_array(batch.column("text")).tolist()
