import itertools
import zlib

import pytest

from skysift.llm import hilbert_shards


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_neighbours(spark, dims, bits):
    cells = [f"c{i}" for i in range(dims)]
    df = spark.createDataFrame(list(itertools.product(range(1 << bits), repeat=dims)), ", ".join(f"{c} bigint" for c in cells))
    rows = df.withColumn("at", hilbert_shards.curve_index(cells, bits)).orderBy("at").collect()
    assert [r["at"] for r in rows] == list(range(len(rows)))
    assert all(sum(abs(a[c] - b[c]) for c in cells) == 1 for a, b in zip(rows, rows[1:]))


ODD = [None, "", "a", "é", "x" * 100_000, "same", "same", "\n"]


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_are_level(documents, shards):
    rows = [*enumerate(ODD), (5, "same"), (None, "no id"), (-(1 << 63), "least"), ((1 << 63) - 1, "most")]
    got = hilbert_shards.hilbert_shards(documents(rows), shards).collect()
    assert sorted((r["row"].doc_id is not None, r["row"].doc_id or 0, r["size"], r.text_crc32) for r in got) == sorted(
        (i is not None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    sizes = [sorted(r.slot for r in got if r.shard == s) for s in range(shards)]
    assert all(s == list(range(len(s))) for s in sizes)
    assert max(map(len, sizes)) - min(map(len, sizes)) <= 1


def test_order_follows_curve(documents, texts):
    got = hilbert_shards.hilbert_shards(documents(texts).repartition(5)).collect()
    order = [(r["at"], r.text_crc32, r["row"].doc_id) for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)


def test_files_hold_every_row(spark, documents, texts, tmp_path):
    docs = documents([*texts, (3, None)])
    hilbert_shards.write_shards(docs, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.drop("shard").exceptAll(docs).count() == 0 and back.count() == len(texts) + 1
    assert back.select("shard").distinct().count() == 8


def test_empty_table(documents):
    assert hilbert_shards.hilbert_shards(documents([])).count() == 0
