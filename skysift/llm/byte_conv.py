"""Quality of a text from a byte-level convolutional network.

Filters of ``WIDTH`` symbols run over every byte of the whole document. A symbol
is the byte and one bit: whether the four bytes from it on also stood within the
``REACH`` bytes before, so that filters can see repetition. The
rectified answers are averaged over overlapping chunks (two halves of ``HALF``
bytes, each half in two chunks), the largest and the smallest average of each
filter over all chunks are taken (a maximum of the answer and of its negative),
and one logistic unit combines them. Everything is learned by
gradient descent in numpy. A filter is kept as one table of byte values per
offset, so a convolution is a few row lookups.

The network is fitted on at most ``PER_CLASS`` labelled documents of each class,
the first by a hash of their id, weighted to the classes' true shares. The id
only picks rows; neither it nor any other column but the text is an input.

Defined cases: a null or empty text is scored like one padding byte. Rows with a
null id are held out. Without labels of both classes the score is the share of
the one there is, or 0.5. Several labels of one document: the least counts.
Repeated rows get equal scores; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.llm.common import steps, text_bytes

WIDTH, FILTERS, HALF, REACH = 6, 16, 64, 40
#: Symbols: 256 bytes, new or repeated.
SYMBOLS = 512
PER_CLASS = 1500
#: Rounds over the sample, documents per step, learning rate, weight decay.
ROUNDS, BATCH, RATE, DECAY = 8, 64, 0.01, 1e-4
#: Halves worked on at a time.
BLOCK = 1024
#: Lowest score that is predicted as 1.
CUT = 0.3


@dataclass
class Network:
    tables: np.ndarray  # (WIDTH, SYMBOLS, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    head: np.ndarray  # (2 * FILTERS,)
    offset: float

    @staticmethod
    def fresh(share: float) -> Network:
        rng = np.random.default_rng(7)
        return Network(rng.normal(0, 0.15, (WIDTH, SYMBOLS, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32),
                       rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), float(np.log(share / (1 - share))))


def layout(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts padded with zeros to whole halves: the symbols, the halves of each text, the positions in each half."""
    lengths = np.diff(offsets)
    used = np.maximum(lengths, 1)
    halves = -(-(used + REACH) // HALF)  # zeros enough that no text sees the one before
    start = (np.cumsum(halves) - halves) * HALF
    flat = np.zeros(int(halves.sum()) * HALF + WIDTH, np.uint8)
    within = np.arange(len(data)) - np.repeat(offsets[:-1], lengths)
    flat[np.repeat(start, lengths) + within] = data
    nth = np.arange(int(halves.sum())) - np.repeat(np.cumsum(halves) - halves, halves)
    count = np.clip(np.repeat(used, halves) - nth * HALF, 0, HALF)
    return repeats(flat), halves, count


def repeats(flat: np.ndarray) -> np.ndarray:
    """Bytes, 256 higher where the four bytes from there on stood within reach before."""
    four = flat[:-3].astype(np.uint32)
    for k in (1, 2, 3):
        four = four << np.uint32(8) | flat[k:len(flat) - 3 + k]
    seen = np.zeros(len(four), bool)
    for back in range(1, REACH):
        seen[back:] |= four[back:] == four[:-back]
    seen &= flat[:-3] > 0
    out = flat.astype(np.uint16)
    out[:-3] += seen * np.uint16(256)
    return out


def responses(net: Network, flat: np.ndarray, first: int, last: int) -> np.ndarray:
    """Rectified answers at all positions of some halves: (positions, FILTERS)."""
    a, b = first * HALF, last * HALF
    out = net.tables[0][flat[a:b]]
    for k in range(1, WIDTH):
        out += net.tables[k][flat[a + k:b + k]]
    out += net.bias
    return np.maximum(out, 0, out=out)


def pooled(net: Network, flat: np.ndarray, halves: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts, 2 * FILTERS): the largest chunk average of each filter and of its negative, and the half that chunk starts with."""
    sums = np.empty((len(count), FILTERS), np.float32)
    for i in range(0, len(count), BLOCK):
        j = min(len(count), i + BLOCK)
        act = responses(net, flat, i, j).reshape(j - i, HALF, FILTERS)
        for h in np.flatnonzero(count[i:j] < HALF):
            act[h, count[i + h]:] = 0
        sums[i:j] = act.sum(1)
    # A chunk is a half and the next one of the same text; the last half alone counts for a text of one.
    end = np.cumsum(halves)
    last = np.zeros(len(count), bool)
    last[end - 1] = True
    pair, size = sums.copy(), count.astype(np.float32)
    go = np.flatnonzero(~last)
    pair[go] += sums[go + 1]
    size[go] += count[go + 1]
    mean = pair / np.maximum(size, 1)[:, None]
    lone = last & (np.repeat(halves, halves) > 1)
    mean = np.concatenate([mean, -mean], 1)
    mean[lone] = -np.inf
    start = end - halves
    top = np.maximum.reduceat(mean, start, axis=0)
    hit = mean == np.repeat(top, halves, axis=0)
    where = np.minimum.reduceat(np.where(hit, np.arange(len(count))[:, None], len(count)), start, axis=0)
    return top, where


def scores(net: Network, texts: pa.Array) -> np.ndarray:
    if not len(texts):
        return np.zeros(0)
    top, _ = pooled(net, *layout(*text_bytes(texts)))
    return 1 / (1 + np.exp(-np.clip(top.astype(np.float64) @ net.head + net.offset, -40, 40)))


def train(texts: list[str], labels: np.ndarray, share: float) -> Network:
    """Gradient descent (Adam) on weighted log loss; ``share`` is the share of label 1 among all rows."""
    net = Network.fresh(share)
    ones = labels.mean()
    weight = np.where(labels == 1, share / ones, (1 - share) / (1 - ones))
    params = [net.tables, net.bias, net.head, np.array([net.offset], np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    rng = np.random.default_rng(11)
    count = 0
    for turn in range(ROUNDS):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            rows = order[i:i + BATCH]
            flat, halves, size = layout(*text_bytes(pa.array([texts[r] for r in rows], pa.string())))
            top, where = pooled(net, flat, halves, size)
            p = 1 / (1 + np.exp(-np.clip(top @ net.head + params[3][0], -40, 40)))
            slope = ((p - labels[rows]) * weight[rows] / len(rows)).astype(np.float32)
            grads = [np.zeros_like(net.tables), np.zeros_like(net.bias), top.T @ slope, np.array([slope.sum()], np.float32)]
            back = slope[:, None] * net.head
            text_of = np.repeat(np.arange(len(rows)), halves)
            for g in range(2 * FILTERS):
                f, sign = g % FILTERS, 1 if g < FILTERS else -1
                # Both halves of the winning chunks, where they belong to the text.
                half = np.stack([where[:, g], np.minimum(where[:, g] + 1, len(size) - 1)], 1)
                mine = np.stack([np.ones(len(rows), bool), (text_of[half[:, 1]] == np.arange(len(rows))) & (half[:, 1] != half[:, 0])], 1)
                total = (size[half] * mine).sum(1)
                at = half[:, :, None] * HALF + np.arange(HALF)
                live = mine[:, :, None] & (np.arange(HALF) < size[half][:, :, None])
                at, share_of = at[live], np.broadcast_to((sign * back[:, g] / np.maximum(total, 1))[:, None, None], live.shape)[live]
                answer = sum(net.tables[k][flat[at + k], f] for k in range(WIDTH)) + net.bias[f]
                on = answer > 0
                at, share_of = at[on], share_of[on]
                for k in range(WIDTH):
                    grads[0][k, :, f] += np.bincount(flat[at + k], share_of, SYMBOLS)
                grads[1][f] += share_of.sum()
            count += 1
            rate = RATE * (1 - turn / ROUNDS)
            for n, (x, g) in enumerate(zip(params, grads)):
                g = g + DECAY * x if n in (0, 2) else g
                first[n] += 0.1 * (g - first[n])
                second[n] += 0.001 * (g * g - second[n])
                x -= (rate * (first[n] / (1 - 0.9 ** count)) / (np.sqrt(second[n] / (1 - 0.999 ** count)) + 1e-8)).astype(np.float32)
    net.offset = float(params[3][0])
    return net


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Network | float:
    """A network from labels (doc_id, quality) of rows that are not held out; a bare share without both classes."""
    known = labels.filter("quality in (0, 1)").filter(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    shares = {r.quality: r.n for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(shares) < 2:
        return float(next(iter(shares), 0.5))
    # At most 2 * per_class rows, so both the broadcast and what comes back are bounded.
    picked = known.filter("quality = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).unionByName(
        known.filter("quality = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(
        F.min("text").alias("text"), F.min("quality").alias("quality")).collect()
    rows.sort(key=lambda r: r.doc_id)
    y = np.array([r.quality for r in rows], np.float32)
    if not len(rows) or y.min() == y.max():
        return float(y[0]) if len(rows) else 0.5
    return train([r.text or "" for r in rows], y, shares[1] / (shares[0] + shares[1]))


def score(docs: DataFrame, net: Network | float) -> DataFrame:
    """(doc_id, score): the probability of label 1 for each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches):
            p = scores(net, part.column("text")) if isinstance(net, Network) else np.full(part.num_rows, net)
            yield pa.record_batch({"doc_id": part.column("doc_id"), "score": pa.array(p, pa.float64())})

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, score double")
