import zlib

import numpy as np
import pyarrow as pa
import pytest

from skysift.llm import byte_conv
from skysift.llm.queries import QUERIES


def plain_score(net, text):
    """The network position by position."""
    data = (text or "").encode() or b"\0"
    flat = data + b"\0" * 80
    symbols = [flat[t] + 256 * (flat[t] > 0 and any(t - p >= 0 and flat[t:t + 4] == flat[t - p:t - p + 4] for p in range(1, byte_conv.REACH))) for t in range(len(data) + 10)]
    act = np.array([np.maximum(sum(net.tables[k][symbols[t + k]] for k in range(byte_conv.WIDTH)) + net.bias, 0) for t in range(len(data))])
    h = byte_conv.HALF
    halves = -(-(len(data) + byte_conv.REACH) // h)
    chunks = [act[i * h:(i + 2) * h].sum(0) / max(1, len(act[i * h:(i + 2) * h])) for i in range(max(1, halves - 1))]
    pool = np.concatenate([np.max(chunks, 0), np.max(-np.array(chunks), 0)])
    return 1 / (1 + np.exp(-(pool @ net.head + net.offset)))


@pytest.fixture
def net():
    rng = np.random.default_rng(0)
    net = byte_conv.Network.fresh(0.6)
    net.head[:] = rng.normal(0, 1, len(net.head))
    net.bias[:] = rng.normal(0, 0.1, len(net.bias))
    return net


ODD = [None, "", "a", "ab " * 50, "é" * 100, "x" * 63, "y" * 64, "word " * 13, "z" * 24, "z" * 25, "same", "same", "tail\n"]


def test_scores_match_plain_network(net, texts):
    rows = ODD + [t[:900] for _, t in texts[:5]]
    got = byte_conv.scores(net, pa.array(rows, pa.string()))
    assert np.allclose(got, [plain_score(net, t) for t in rows], atol=1e-4)
    # A score doesn't depend on what stands beside the text.
    assert np.allclose(got[::-1], byte_conv.scores(net, pa.array(rows[::-1], pa.string())), atol=1e-6)


def test_long_text(net):
    assert 0 <= byte_conv.scores(net, pa.array(["long text " * 50_000]))[0] <= 1


def test_learns_held_out_rows(spark):
    got = QUERIES["op8_byte_conv_quality"](spark, "/root/testdata/sf0.1").toPandas().set_index("doc_id")
    assert got.score.between(0, 1).all() and len(got) == 10_000
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in got.held_out.items())
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas().set_index("doc_id").quality
    both = got[got.held_out].join(labels, how="inner")
    assert (both.predicted == both.quality).mean() > 0.98
    assert (both.predicted[both.quality == 0] == 0).mean() > 0.9


def test_labels_of_one_class(spark, documents):
    docs = documents(["a", None, "b"])
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert byte_conv.fit(docs, none) == 0.5
    assert byte_conv.fit(docs, spark.createDataFrame([(1, 1), (2, 1), (1, None)], "doc_id bigint, quality int")) == 1.0
    assert {r.score for r in byte_conv.score(docs, 0.5).collect()} == {0.5}
    assert byte_conv.score(documents([]), byte_conv.Network.fresh(0.5)).count() == 0


def test_null_id_is_held_out(documents):
    assert documents([(None, "a")]).select(byte_conv.held_out().alias("h")).first().h is True
