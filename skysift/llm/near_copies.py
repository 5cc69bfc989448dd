"""Near copies: texts whose word shingles have a Jaccard similarity of 0.8 or more.

Candidates. Each text has 120 minima over permuted hashes of its shingles; five
minima in a row are a band, and texts that share one of the 24 bands meet in a
bucket. Two texts of similarity 0.8 share a band with probability 0.99993, more
alike ones more surely.

Checking. A bucket is never listed, and its texts are never compared all with all:
each text meets one other of its bucket, the centre. At first that is the text
with most company over all its buckets: in a group of copies made by edits from one
base, the base shares buckets with all and two copies with each other less often.
Buckets of more than two that span several components then take other centres, chosen
by a hash that differs by bucket and round, and the texts of other components meet
those; a bucket goes on as long as a round has joined one of its texts. A text has 24
buckets, so a round tries up to 24 different partners for it. What still spans components meets once more in
buckets of 40 bands of ten minima, where chance company of low similarity is rare.
Every pair that meets is compared by its exact shingle sets in a join; a round's rows
are at most the texts times their bands.

SimHash alone can't bring all these pairs together: at similarity 0.8 fingerprints differ
in about 10 bits and often in 16, and a vantage-point tree searched that widely visits
nearly every leaf (figures in the README). The pairs it does find (``pairs``) are compared
first, with the first centres, and the bands add the rest.

Defined cases: null texts, empty ones and those of white space are copies of each
other and of nothing else. A text of fewer words than a shingle is one shingle.
Texts are compared without regard to ASCII case and to white space. Rows with the
same id and different texts are texts of their own. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift.llm import bloom
from skysift.llm.common import LOWER, PLAIN_WORD, list_array, ramp, steps, text_bytes, word_array, words
from skysift.operators.graph import connected_components
from skysift.session import cut_lineage, drop_scratch

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
#: How far below the wanted similarity the share of equal minima may lie (5 standard deviations).
SLACK = 0.2
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text hashed in one go; a worker's arrays are many times as large.
HASH_BYTES = 1 << 20
#: Bands of the second look.
LONG_BANDS, LONG_ROWS = 40, 10


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def shingles(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all shingles, how many each text has, and a hash of each text's words."""
    data, offsets = text_bytes(texts)
    data = LOWER[data]
    starts, ends, bounds = words(data, offsets, PLAIN_WORD)
    counts = np.diff(bounds)
    if not len(starts):
        return np.zeros(0, np.uint64), counts, np.zeros(len(texts), np.uint64)
    coded = word_array(data, starts, ends, PLAIN_WORD).dictionary_encode()
    h = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)[coded.indices.to_numpy()]
    votes = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    first = np.repeat(bounds[:-1], votes) + ramp(votes)
    width = np.repeat(np.minimum(counts, shingle), votes)
    out = width.astype(np.uint64)
    for j in range(shingle):
        here = np.flatnonzero(width > j)
        out[here] = out[here] * ODD + h[first[here] + j]
    out = _mix(out)
    body = np.zeros(len(texts), np.uint64)
    filled = np.flatnonzero(votes)
    raw = out.tobytes()
    cuts = np.cumsum(votes) * 8
    body[filled] = [xxhash.xxh64_intdigest(raw[b - 8 * n:b]) for b, n in zip(cuts[filled].tolist(), votes[filled].tolist())]
    return out, votes, body


def minima_bands(hashes: np.ndarray, votes: np.ndarray, bands: int, rows: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the bands (texts x bands) and the minima (texts x bands * rows)."""
    least = np.zeros((len(votes), bands * rows), np.uint32)
    filled = np.flatnonzero(votes)
    if len(filled):
        cuts = (np.cumsum(votes) - votes)[filled]
        low = (hashes >> np.uint64(32)).astype(np.uint32)
        factor, shift = np.random.default_rng(seed).integers(0, 1 << 31, (2, bands * rows), dtype=np.uint32)
        for j in range(bands * rows):
            least[filled, j] = np.minimum.reduceat(low * (2 * factor[j] + np.uint32(1)) + shift[j], cuts)
    out = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None], len(votes), 0)
    for j in range(rows):
        out = _mix(out * ODD + least[:, j::rows].astype(np.uint64))
    return out, least


def signatures(hashes: np.ndarray, votes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bands (texts x 24) and one byte of each minimum (texts x 120)."""
    bands, least = minima_bands(hashes, votes, BANDS, ROWS, 42)
    return bands.view(np.int64), least.astype(np.uint8)


def _prints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, size=HASH_BYTES):
            hashes, votes, body = shingles(part.column("text"), shingle)
            bands, sketch = signatures(hashes, votes)
            yield pa.record_batch({
                "doc_id": part.column("doc_id"), "tag": part.column("tag"), "body": pa.array(body.view(np.int64)),
                "bands": list_array(pa.array(bands.ravel()), np.full(len(votes), BANDS)), "sketch": pa.array([s.tobytes() for s in sketch], pa.binary())})

    return run


def _sets(shingle: int, listed):
    """(tag, members): the exact sets of the different texts of a step that ``listed`` may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, size=HASH_BYTES):
            tags, first = np.unique(part.column("tag").to_numpy(), return_index=True)
            part = part.take(pa.array(first[listed.value.might_hold(tags)]))
            hashes, votes, _ = shingles(part.column("text"), shingle)
            text = np.repeat(np.arange(len(votes)), votes)
            order = np.lexsort((hashes, text))
            text, hashes = text[order], hashes[order]
            fresh = np.ones(len(text), bool)
            fresh[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
            sizes = np.bincount(text[fresh], minlength=len(votes))
            yield pa.record_batch({"tag": part.column("tag"), "members": list_array(pa.array(hashes[fresh].view(np.int64)), sizes)})

    return run


def _listed(column: str, listed):
    """The rows whose key may be listed."""
    return lambda batches: (b.filter(pa.array(listed.value.might_hold(b.column(column).to_numpy()))) for b in batches)


def _long_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(body, bands): bands of ten minima from the exact sets."""
    for batch in batches:
        for i in range(0, batch.num_rows, 1024):
            part = batch.slice(i, 1024)
            members = part.column("members")
            sizes = members.value_lengths().to_numpy().astype(np.int64)
            bands = minima_bands(members.flatten().to_numpy().view(np.uint64), sizes, LONG_BANDS, LONG_ROWS, 43)[0]
            yield pa.record_batch({"body": part.column("body"), "bands": list_array(pa.array(bands.view(np.int64).ravel()), np.full(len(sizes), LONG_BANDS))})


def _agreeing(least: int):
    """Pairs whose sketches agree in at least ``least`` places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("u_sketch", "v_sketch")]
            keep = pa.array((sides[0] == sides[1]).sum(1) >= least)
            yield pa.record_batch({c: batch.column(c).filter(keep) for c in ("u", "v")})

    return run


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v): the pairs whose exact sets are similar enough."""
    side = lambda name: sets.select(F.col("body").alias(name), F.col("members").alias(f"{name}_set"))
    both = pairs.join(side("u"), "u").join(side("v"), "v").withColumn("common", F.size(F.array_intersect("u_set", "v_set")))
    return both.filter(F.col("common") / (F.size("u_set") + F.size("v_set") - F.col("common")) >= similarity).select("u", "v")


def _met(bands: DataFrame) -> DataFrame:
    """(band, body, n) of (body, bands): the buckets with more than one text."""
    rows = bands.select(F.explode("bands").alias("band"), "body")
    sizes = cut_lineage(rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sizes")
    # Most bands have one text: a filter of bounded size keeps them from being shuffled again, the join is exact.
    listed = bands.sparkSession.sparkContext.broadcast(bloom.build(sizes, "band"))
    out = cut_lineage(rows.mapInArrow(_listed("band", listed), rows.schema).join(sizes, "band"), "met")
    listed.destroy()
    drop_scratch(sizes)
    return out


def _components(links: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """(body, root) over links (u, v) and the components before them.

    Links are first drawn between the roots of the components before, so that the
    rounds over links see what has changed and not all that was joined earlier.
    """
    if parts is None:
        return connected_components(links).select(F.col("node").alias("body"), "root")
    for end in ("u", "v"):
        home = parts.select(F.col("body").alias(end), F.col("root").alias("home"))
        links = links.join(home, end, "left").withColumn(end, F.coalesce("home", end)).drop("home")
    moved = connected_components(links)
    kept = parts.join(moved.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("body", F.coalesce("to", "root").alias("root"))
    # Texts that had no component until now.
    fresh = moved.select(F.col("node").alias("body"), "root").join(parts.select("body"), "body", "left_anti")
    out = cut_lineage(kept.unionByName(fresh), "parts")
    drop_scratch(parts)
    return out


def _spanning(met: DataFrame, parts: DataFrame) -> DataFrame:
    """(band, body, n, root) of the buckets that hold several components."""
    rooted = cut_lineage(met.select("band", "body", "n").join(parts, "body", "left").withColumn("root", F.coalesce("root", "body")), "rooted")
    mixed = rooted.groupBy("band").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least != most")
    out = cut_lineage(rooted.join(mixed.select("band"), "band"), "spanning")
    drop_scratch(rooted)
    return out


def _round(spanning: DataFrame, salt: int) -> DataFrame:
    """(u, v): the texts of each bucket against one of another component."""
    order = F.xxhash64("band", "body", F.lit(salt))
    centres = spanning.groupBy("band").agg(F.min(F.struct(order.alias("order"), F.col("body").alias("centre"), F.col("root").alias("home"))).alias("c")).select("band", "c.centre", "c.home")
    return _pairs(spanning.join(centres, "band").filter("root != home"))


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.filter("body != centre").select(F.least("body", "centre").alias("u"), F.greatest("body", "centre").alias("v")).distinct()


def near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, pairs: DataFrame | None = None) -> DataFrame:
    """(doc_id, tag, root): root names the component of texts linked by a similarity of at least ``similarity``; tag is a hash of the text.

    ``pairs`` (u, v) are further candidates by tag, checked like the others.
    """
    whole = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("tag"), F.col("text"))
    prints = cut_lineage(whole.mapInArrow(_prints(shingle), "doc_id bigint, tag bigint, body bigint, bands array<bigint>, sketch binary"), "prints")
    # Copies of the same words are one text from here on.
    bodies = cut_lineage(prints.select("body", "tag", "bands", "sketch").dropDuplicates(["body"]), "bodies")
    met = _met(bodies.select("body", "bands"))
    wanted, seeds = met.select("body"), None
    if pairs is not None:
        named = prints.select("tag", "body").distinct()
        side = lambda name: named.select(F.col("tag").alias(name), F.col("body").alias(f"{name}_body"))
        met_pairs = pairs.join(side("u"), "u").join(side("v"), "v").filter("u_body != v_body")
        seeds = cut_lineage(met_pairs.select(F.least("u_body", "v_body").alias("u"), F.greatest("u_body", "v_body").alias("v")).distinct(), "seeds")
        wanted = wanted.unionByName(seeds.select(F.explode(F.array("u", "v")).alias("body")))
    chosen = bodies.join(wanted.distinct(), "body", "left_semi").select("body", "tag", "sketch")
    chosen = cut_lineage(chosen, "chosen")
    listed = docs.sparkSession.sparkContext.broadcast(bloom.build(chosen, "tag"))
    members = whole.select("tag", "text").mapInArrow(_sets(shingle, listed), "tag bigint, members array<bigint>")
    sets = cut_lineage(members.join(chosen, "tag").dropDuplicates(["body"]).select("body", "sketch", "members"), "sets")
    listed.destroy()

    def linked(pairs: DataFrame) -> DataFrame:
        side = lambda name: sets.select(F.col("body").alias(name), F.col("sketch").alias(f"{name}_sketch"))
        near = pairs.join(side("u"), "u").join(side("v"), "v").mapInArrow(_agreeing(int(np.ceil((similarity - SLACK) * BANDS * ROWS))), "u bigint, v bigint")
        return cut_lineage(_alike(near, sets, similarity), "links")

    def by_company(rows: DataFrame, apart: bool) -> DataFrame:
        """(u, v): the texts of each bucket against the one with most company; ``apart``: only across components."""
        company = rows.groupBy("body").agg(F.sum("n").alias("company"))
        home = ["root"] if apart else []
        centres = rows.join(company, "body").groupBy("band").agg(F.max(F.struct("company", "body", *home)).alias("c"))
        centres = centres.select("band", F.col("c.body").alias("centre"), *[F.col("c.root").alias("home") for _ in home])
        met = rows.join(centres, "band")
        return _pairs(met.filter("root != home") if apart else met)

    def rounds(met: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Components after rounds of other centres, and the buckets that still span several.

        After two rounds over all buckets those stay in which the last round has joined a text.
        """
        spanning = every = _spanning(met, parts)
        salt = 0
        while True:
            links = linked(_round(spanning, salt) if salt else by_company(spanning, True))
            if links.isEmpty() and salt:
                break
            parts, salt = _components(links, parts), salt + 1
            if salt > 1:
                fresh = links.select(F.explode(F.array("u", "v")).alias("body")).distinct()
                live = spanning.join(spanning.join(fresh, "body", "left_semi").select("band").distinct(), "band", "left_semi")
            else:
                live = spanning
            left = _spanning(live, parts)
            drop_scratch(links, *[t for t in (spanning,) if t is not every])
            spanning = left
        rest = _spanning(every, parts)
        drop_scratch(links, every, spanning)
        return parts, rest

    first = by_company(met, False)
    parts = _components(linked(first if seeds is None else first.unionByName(seeds).distinct()))
    # The only pair of a bucket of two has met.
    parts, spanning = rounds(met.filter("n > 2"), parts)
    again = sets.join(spanning.select("body").distinct(), "body", "left_semi").select("body", "members")
    longer = _met(cut_lineage(again.mapInArrow(_long_bands, "body bigint, bands array<bigint>"), "long"))
    parts, rest = rounds(longer, parts)
    out = cut_lineage(prints.join(parts, "body", "left").select("doc_id", "tag", F.coalesce("root", "body").alias("root")), "copies")
    drop_scratch(prints, bodies, chosen, met, sets, spanning, longer, rest, parts, *[t for t in (seeds,) if t is not None])
    return out
