"""Near duplicates by SimHash and vantage-point trees.

Fingerprints are 64 votes of word-shingle hashes. Two fingerprints that differ
in at most 3 bits differ in at most one bit on one of their two halves, so two
vantage-point trees, one over the Hamming distance on each half, find every
such pair with a search radius of 1. The upper levels of a tree are built from
a bounded sample of fingerprints and only decide where fingerprints are dealt:
every fingerprint has one home leaf, and visits those leaves whose side of a
vantage circle its own circle of radius 1 overlaps. Below them each leaf goes on
splitting by vantage points of its own.

Copies collapse to one fingerprint before anything is dealt, and a leaf hands
back a spanning forest of its links, never all pairs.

Defined cases: a null or empty text, or one of white space, has the fingerprint
zero, which links like any other. A text of fewer words than a shingle is one
shingle. Rows with the same id and different texts keep their own fingerprints;
the id belongs to the component of each. A null id is carried along and takes
part in no minimum. An empty table gives an empty table. Other columns of the
input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift.llm.common import LOWER, PLAIN_WORD, steps, text_bytes, words
from skysift.operators.graph import connected_components
from skysift.session import cut_lineage, drop_scratch

SEED = 42
BITS = 64
#: Differing bits of a link, and of the nearer half of a link.
RADIUS = 3
HALF_RADIUS = RADIUS // 2
#: Fingerprints that a leaf should hold, sampled fingerprints that place the vantage
#: points (at most), and sampled fingerprints needed to split a node.
LEAF, SAMPLE, SPLIT = 512, 16384, 16
#: Rows a task compares in one go.
BLOCK = 1024
#: Bytes of text hashed in one go: the hashes of a step and their bits take some 50 times as much, in every worker.
HASH_BYTES = 1 << 20


def fingerprint_array(texts: pa.Array, shingle: int = 3) -> np.ndarray:
    """The fingerprint of each text, as int64."""
    data, offsets = text_bytes(texts)
    data = LOWER[data]
    starts, ends, bounds = words(data, offsets, PLAIN_WORD)
    out = np.zeros(len(texts), np.int64)
    if not len(starts):
        return out
    # Words with one space behind each, so that a shingle is a slice.
    lengths = ends - starts
    inside = PLAIN_WORD[data]
    behind = np.zeros(len(data) + 1, bool)
    behind[ends] = True
    keep = inside | (behind[:-1] & ~inside)
    packed = np.where(inside, data, 32)[keep].astype(np.uint8)
    place = np.cumsum(keep) - keep
    starts = place[starts]
    ends = starts + lengths
    counts = np.diff(bounds)
    votes = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    width = np.minimum(counts, shingle)
    first = np.repeat(bounds[:-1], votes) + _ramp(votes)
    last = first + np.repeat(width, votes) - 1
    text, digest = packed.tobytes(), xxhash.xxh64_digest
    hashes = b"".join([digest(text[a:b], SEED) for a, b in zip(starts[first].tolist(), ends[last].tolist())])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, BITS)
    filled = np.flatnonzero(votes)
    cuts = (np.cumsum(votes) - votes)[filled]
    ones = np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
    major = 2 * ones > votes[filled][:, None]
    out[filled] = np.packbits(major, axis=1).view(">u8")[:, 0].astype(np.uint64).view(np.int64)
    return out


def _ramp(counts: np.ndarray) -> np.ndarray:
    first = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) - np.repeat(first, counts)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, tag, fp): the SimHash of each whole text; tag is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, size=HASH_BYTES):
            yield pa.record_batch({"doc_id": part.column("doc_id"), "tag": part.column("tag"), "fp": pa.array(fingerprint_array(part.column("text"), shingle))})

    return docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("tag"), F.col("text")).mapInArrow(run, "doc_id bigint, tag bigint, fp bigint")


def half(fps: np.ndarray, tree: int) -> np.ndarray:
    """The upper (0) or lower (1) 32 bits."""
    return (fps.view(np.uint64) >> np.uint64(32) if tree == 0 else fps.view(np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def vantage(points: np.ndarray) -> tuple[int, int]:
    """A vantage point among the points and the distance that splits them most evenly."""
    best = (-1.0, 0, 64)
    for p in points[np.linspace(0, len(points) - 1, 8).astype(int)]:
        reach = np.cumsum(np.bincount(np.bitwise_count(points ^ p), minlength=33)) / len(points)
        cut = int(np.abs(reach - 0.5).argmin())
        even = min(reach[cut], 1 - reach[cut])
        if even > best[0]:
            best = (even, int(p), cut)
    return best[1], best[2]


def build_tree(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and distances of a tree's inner nodes; the children of i are 2i + 1 and 2i + 2."""
    centre, cut = np.zeros(2 ** depth - 1, np.uint32), np.full(2 ** depth - 1, 64, np.int64)
    parts = {0: points}
    for i in range(2 ** depth - 1):
        here = parts.pop(i)
        if len(here) >= SPLIT:
            centre[i], cut[i] = vantage(here)
        near = np.bitwise_count(here ^ centre[i]) <= cut[i]
        parts[2 * i + 1], parts[2 * i + 2] = here[near], here[~near]
    return centre, cut


def walk(points: np.ndarray, centre: np.ndarray, cut: np.ndarray, depth: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of every leaf that the points' circles of ``radius`` meet."""
    rows, node = np.arange(len(points)), np.zeros(len(points), np.int64)
    for _ in range(depth):
        d = np.bitwise_count(points[rows] ^ centre[node]).astype(np.int64)
        near, far = d - radius <= cut[node], d + radius > cut[node]
        rows, node = np.concatenate([rows[near], rows[far]]), np.concatenate([2 * node[near] + 1, 2 * node[far] + 2])
    return rows, node - (2 ** depth - 1)


def link_leaf(homes: np.ndarray, guests: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among the homes, and between homes and guests."""
    everyone = np.concatenate([homes, guests])
    label = np.arange(len(everyone))

    def join(a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            la, lb = label[a], label[b]
            split = la != lb
            a, b, la, lb = a[split], b[split], la[split], lb[split]
            low = np.minimum(la, lb)
            np.minimum.at(label, la, low)
            np.minimum.at(label, lb, low)
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up

    def search(h: np.ndarray, g: np.ndarray) -> None:
        """h, g: places of homes and guests in ``everyone``."""
        if len(h) > 2 * BLOCK:
            part = half(everyone[h], tree)
            centre, cut = vantage(part)
            d = np.bitwise_count(part ^ np.uint32(centre)).astype(np.int64)
            near = d <= cut
            if near.any() and not near.all():
                e = np.bitwise_count(half(everyone[g], tree) ^ np.uint32(centre)).astype(np.int64)
                # Homes of the near side within reach of the border are guests of the far side.
                search(h[near], g[e - HALF_RADIUS <= cut])
                search(h[~near], np.concatenate([h[near & (d + HALF_RADIUS > cut)], g[e + HALF_RADIUS > cut]]))
                return
        others = np.concatenate([h, g])
        right = everyone[others].view(np.uint64)
        for i in range(0, len(h), BLOCK):
            rows = h[i:i + BLOCK]
            step = max(1, (BLOCK * BLOCK) // max(1, len(rows)))
            for j in range(i, len(others), step):
                x, y = np.nonzero(np.bitwise_count(everyone[rows].view(np.uint64)[:, None] ^ right[None, j:j + step]) <= RADIUS)
                join(rows[x], others[j:j + step][y])

    search(np.arange(len(homes)), np.arange(len(homes), len(everyone)))
    child = np.flatnonzero(label != np.arange(len(everyone)))
    return everyone[child], everyone[label[child]]


def links(distinct: DataFrame, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """(u, v): links that connect all fingerprints (fp) with a chain of links between them."""
    total = distinct.count()
    if total < 2:
        return distinct.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0)
    # The sample only places vantage points; it is bounded by ``sample``.
    points = np.array([r.fp for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()], np.int64)
    depth = max(0, min(math.ceil(math.log2(total / leaf)), int(math.log2(max(1, len(points) / SPLIT)))))
    trees = [build_tree(half(points, t), depth) for t in (0, 1)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column("fp").to_numpy()
            for i in range(0, len(whole), 8192):
                fps = whole[i:i + 8192]
                for t, (centre, cut) in enumerate(trees):
                    points = half(fps, t)
                    _, home = order = walk(points, centre, cut, depth, 0)
                    home = np.empty(len(fps), np.int64)
                    home[order[0]] = order[1]
                    rows, leaves = walk(points, centre, cut, depth, HALF_RADIUS)
                    # Of a pair in two leaves, the one in the lower leaf visits the other.
                    keep = leaves >= home[rows]
                    rows, leaves = rows[keep], leaves[keep]
                    yield pa.record_batch({
                        "leaf": pa.array(leaves * 2 + t), "fp": pa.array(fps[rows]), "guest": pa.array(leaves != home[rows])})

    def match(group: pa.Table) -> pa.Table:
        fps = group.column("fp").to_numpy()
        guest = group.column("guest").to_numpy()
        u, v = link_leaf(fps[~guest], fps[guest], int(group.column("leaf")[0].as_py()) & 1)
        return pa.table({"u": pa.array(u), "v": pa.array(v)})

    return distinct.mapInArrow(deal, "leaf bigint, fp bigint, guest boolean").groupBy("leaf").applyInArrow(match, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, tag, fp, component_id, root): component_id is the smallest id reachable over links, root names the component."""
    prints = cut_lineage(fingerprints(docs, shingle), "prints")
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    parts = connected_components(links(distinct.select("fp")))
    # Fingerprints with a link, and the smallest id of their component.
    rooted = distinct.join(parts.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id", "root")
    return prints.join(named, "fp").select("doc_id", "tag", "fp", "component_id", "root")


def candidate_pairs(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(u, v): hashes of texts that connect all texts whose fingerprints link, for a check of the pairs.

    Texts of one fingerprint meet its text of least hash, linked fingerprints meet by those.
    """
    prints = cut_lineage(fingerprints(docs, shingle).select("fp", "tag").distinct(), "prints")
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("tag").alias("first")), "distinct")
    same = prints.join(distinct, "fp").filter("tag != first").select(F.col("first").alias("u"), F.col("tag").alias("v"))
    side = lambda name: distinct.select(F.col("fp").alias(name), F.col("first").alias(f"{name}_first"))
    near = links(distinct.select("fp")).distinct().join(side("u"), "u").join(side("v"), "v").select(F.col("u_first").alias("u"), F.col("v_first").alias("v"))
    out = cut_lineage(same.unionByName(near), "pairs")
    drop_scratch(prints, distinct)
    return out


def deduplicate(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """The documents, all columns, with one row of each component."""
    return keep_least(docs, near_duplicates(docs, shingle))


def keep_least(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents with one row of each component (root) of ``found`` (doc_id, tag, root).

    The row with the smallest id stays (of several texts with that id the one of
    least hash, of equal rows one); a null id stays only where there is no other.
    """
    key = lambda c: F.coalesce(c.cast("bigint"), F.lit(-(1 << 63)))
    stay = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("least"))
    stay = stay.select(key(F.col("least.doc_id")).alias("key"), F.col("least.tag").alias("tag"))
    # The document's own columns travel in a struct, whatever their names.
    keyed = docs.select(key(F.col("doc_id")).alias("key"), F.xxhash64("text").alias("tag"), F.struct("*").alias("doc"))
    return keyed.join(stay, ["key", "tag"], "left_semi").dropDuplicates(["key", "tag"]).select("doc.*")
