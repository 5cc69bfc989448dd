"""Collocations by SON: shards mined whole at a lowered support, then an exact count.

Documents are dealt to ``SHARDS`` shards by a hash of their text. A phrase with
``support`` occurrences in a language occurs in at least one shard as often as that
shard's share of the language's words asks for, so

1. each shard is mined completely, word by word longer: of its phrases those remain that
   reach ceil(support * words of the shard / words of the language). A longer phrase is
   only looked at where both phrases it is made of may have remained,
2. the union of what remains is the list of candidates, and
3. another scan counts all candidates over all shards exactly.

The number of shards doesn't grow with the data: a shard is a third of the corpus,
itself counted by many tasks. With as many shards as tasks the lowered support would
be one occurrence, and nothing would be pruned.

Mining works on 64-bit hashes, where a collision can only add a candidate; the last scan
counts words. The candidates reach the scans as a Bloom filter of bounded size, and the
join at the end decides. Inside a task occurrences are counted by numpy before anything
leaves it, so a frequent word costs one row a step. Lookups of parts of phrases are
salted, since one word can begin a large share of all phrases.

Defined cases: a null text has no words, a null language is "und". Words are joined by
one space; a word holds no space, so phrases are unambiguous. Repeated rows count each
time. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysift.llm import bloom
from skysift.llm.common import LOWER, byte_class, ramp, steps, text_bytes, word_array, words
from skysift.session import cut_lineage, drop_scratch

SUPPORT, LONGEST, TOP = 10, 3, 2000
#: A longer candidate hides those inside it from this share of their count.
INSIDE_PERCENT = 50
#: Shards of the corpus; fewer than ``SUPPORT``, so that a shard's own support is more than one.
SHARDS = 3
#: Parts of a hot phrase's lookups, and of a language's ranking.
SALTS, RANKERS = 8, 64
#: Bytes of text whose occurrences are counted together; fewer where phrases are carried as text.
STEP, TEXT_STEP = 4 << 20, 2 << 20

#: Pieces end at these; words at these and at space and tab.
ENDS = ~byte_class((0x0A, 0x0D), *[(ord(c), ord(c)) for c in ".,;:!?"])
WORD = byte_class((0x09, 0x0D), (0x20, 0x20), *[(ord(c), ord(c)) for c in ".,;:!?"])
ODD = np.uint64(0x9E3779B97F4A7C15)


def _stir(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _encode(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense ids of the codes and the code of each id."""
    coded = pa.array(codes).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy()


def _hashes(names: pa.Array) -> np.ndarray:
    """64-bit hashes of binary values: polynomials over their bytes."""
    _, offsets, data = names.buffers()
    cuts = np.frombuffer(offsets, np.int64)[names.offset:names.offset + len(names) + 1]
    data = np.frombuffer(data, np.uint8)[cuts[0]:cuts[-1]]
    sizes = np.diff(cuts)
    powers = np.cumprod(np.full(int(sizes.max()), ODD, np.uint64))
    return _stir(np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * powers[ramp(sizes)], cuts[:-1] - cuts[0]))


class Step:
    """The phrases of one step of text: distinct ones of each group of documents, with counts and hashes."""

    def __init__(self, texts: pa.Array, group: np.ndarray, seeds: np.ndarray):
        data, offsets = text_bytes(texts)
        data = LOWER[data]
        starts, ends, bounds = words(data, offsets, WORD)
        self.own = np.zeros(0, np.int64)
        if not len(starts):
            return
        coded = word_array(data, starts, ends, WORD).dictionary_encode()
        self.words, size = coded.dictionary, len(coded.dictionary)
        text = np.repeat(np.arange(len(texts)), np.diff(bounds))
        # Whether the next word belongs to the same piece.
        self.joined = np.append((text[1:] == text[:-1]) & (np.diff(np.cumsum(ENDS[data], dtype=np.int32)[starts]) == 0), False)
        # Ids of (group, word).
        self.own, base = _encode(group[text] * size + coded.indices.to_numpy())
        self.group, self.word = base // size, base % size
        self.hashes = _hashes(self.words)
        self.seeds = seeds

    def phrases(self, longest: int, listed: bloom.Bloom | None = None) -> Iterator[tuple[int, np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]]:
        """For 1 to ``longest`` words: their number; group, words by position, count and hash of each distinct phrase.

        With ``listed`` a longer phrase is only built where both phrases that it is made of may be listed.
        """
        if not len(self.own):
            return
        ids, at, group, places = self.own, np.arange(len(self.own)), self.group, [self.word]
        inner = self.hashes[self.word]
        for k in range(1, longest + 1):
            h = _stir(inner ^ self.seeds[group]).view(np.int64)
            yield k, group, places, np.bincount(ids, minlength=len(group)), h
            if k == longest:
                return
            alive = np.full(len(self.own) + 1, -1)
            alive[at] = ids if listed is None else np.where(listed.might_hold(h)[ids], ids, -1)
            on = np.flatnonzero((alive[:-1] >= 0) & (alive[1:] >= 0) & self.joined)
            if not len(on):
                return
            ids, codes = _encode(alive[on] * len(self.word) + self.own[on + k])
            at, head, tail = on, codes // len(self.word), self.word[codes % len(self.word)]
            group, places = group[head], [p[head] for p in places] + [tail]
            inner = _stir(inner[head] * ODD + self.hashes[tail])

    def names(self, places: list[np.ndarray]) -> pa.Array:
        parts = [self.words.take(pa.array(p)) for p in places]
        joined = parts[0] if len(parts) == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", parts[0].type))
        return joined.cast(pa.large_string()).cast(pa.string())


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The rows in steps of about ``most`` bytes of text, put together from small batches and cut from large ones."""
    waiting, size = [], 0
    for batch in batches:
        own = pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
        if waiting and size + own > most:
            yield from steps(iter([pa.concat_batches(waiting)]), size=most)
            waiting, size = [], 0
        waiting.append(batch)
        size += own
    if waiting:
        yield from steps(iter([pa.concat_batches(waiting)]), size=most)


def _walk(batches: Iterator[pa.RecordBatch], longest: int, listed: bloom.Bloom | None, apart: bool = True, most: int = STEP):
    """What ``Step.phrases`` finds, with the step and the shard, language and language hash of each group; shards are kept ``apart``."""
    for part in _gathered(batches, most):
        lang = part.column("lang").dictionary_encode()
        group, pairs = _encode(lang.indices.to_numpy().astype(np.int64) * SHARDS + part.column("shard").to_numpy() * apart)
        names = lang.dictionary.take(pa.array(pairs // SHARDS))
        seeds = np.array([xxhash.xxh64_intdigest(x) for x in names.to_pylist()], np.uint64)
        step = Step(part.column("text"), group, seeds)
        for found in step.phrases(longest, listed):
            yield step, pairs % SHARDS, names, seeds.view(np.int64), found
        # Workers are used again by later scans: what a step has freed goes back.
        pa.default_memory_pool().release_unused()


ROWS = 1 << 17


def _mine(size: int, listed=None):
    """(shard, tongue, h, n) of the phrases of ``size`` words, counted by step; tongue is the hash of the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, shard, _, seeds, (k, group, _, n, h) in _walk(batches, size, listed and listed.value):
            for i in range(0, len(group) if k == size else 0, ROWS):
                cut = slice(i, i + ROWS)
                yield pa.record_batch({
                    "shard": pa.array(shard[group[cut]].astype(np.int32)), "tongue": pa.array(seeds[group[cut]]), "h": pa.array(h[cut]), "n": pa.array(n[cut].astype(np.int64))})

    return run


def _count(longest: int, listed):
    """(lang, size, phrase, h, n) of the phrases that ``listed`` may hold, counted by step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step, _, names, _, (k, group, places, n, h) in _walk(batches, longest, listed.value, apart=False, most=TEXT_STEP):
            keep = np.flatnonzero(listed.value.might_hold(h))
            for i in range(0, len(keep), ROWS):
                cut = keep[i:i + ROWS]
                yield pa.record_batch({
                    "lang": names.take(pa.array(group[cut])), "size": pa.array(np.full(len(cut), k, np.int32)),
                    "phrase": step.names([p[cut] for p in places]), "h": pa.array(h[cut]), "n": pa.array(n[cut].astype(np.int64))})

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, tongue, lang, n): words by shard and language."""
    for _, shard, names, seeds, (_, group, _, n, _) in _walk(batches, 1, None):
        yield pa.record_batch({
            "shard": pa.array(shard.astype(np.int32)), "tongue": pa.array(seeds), "lang": names, "n": pa.array(np.bincount(group, n, len(shard)).astype(np.int64))})


def _exact(x: Column) -> Column:
    return x.cast("decimal(18,0)")


def counts(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, n) of all phrases of 1 to ``longest`` words that occur ``support`` times, and (lang, total) words."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"),
        F.pmod(F.xxhash64("text"), F.lit(SHARDS)).alias("shard"))
    sizes = rows.mapInArrow(_totals, "shard int, tongue bigint, lang string, n bigint").groupBy("shard", "tongue", "lang").agg(F.sum("n").alias("n"))
    sizes = cut_lineage(sizes, "sizes")
    totals = cut_lineage(sizes.groupBy("lang").agg(F.sum("n").alias("total")).filter("total > 0"), "totals")
    # The smallest whole number that reaches the shard's share of the support.
    share = cut_lineage(sizes.join(totals, "lang").select(
        "shard", "tongue", F.greatest(F.lit(1), F.expr(f"({support} * n + total - 1) div total")).alias("least")), "share")
    candidates, listed = None, None
    for size in range(1, longest + 1):
        mined = rows.mapInArrow(_mine(size, listed), "shard int, tongue bigint, h bigint, n bigint").groupBy("shard", "tongue", "h").agg(F.sum("n").alias("n"))
        found = mined.join(share, ["shard", "tongue"]).filter("n >= least").select("h").distinct()
        new = cut_lineage(found if candidates is None else candidates.unionByName(found), "candidates")
        drop_scratch(*[t for t in (candidates,) if t])
        candidates = new
        if listed:
            listed.destroy()
        listed = sc.broadcast(bloom.build(candidates))
    seen = rows.mapInArrow(_count(longest, listed), "lang string, size int, phrase string, h bigint, n bigint").groupBy("lang", "size", "phrase", "h").agg(F.sum("n").alias("n"))
    frequent = seen.filter(F.col("n") >= support).join(candidates, "h", "left_semi").select("lang", "size", "phrase", "n")
    frequent = cut_lineage(frequent, "frequent")
    listed.destroy()
    drop_scratch(sizes, share, candidates)
    return frequent, totals


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language.

    A phrase of a occurrences, cut into parts with l and r occurrences, scores
    floor(10^6 * a * a / (l * r)); its lowest-scoring cut counts. Phrases inside a longer
    one that has half of their occurrences are left out.
    """
    found, totals = counts(docs, support, longest)
    parts = F.expr("""transform(sequence(1, size - 1), k -> struct(k as k,
        array_join(slice(split(phrase, ' '), 1, k), ' ') as head, array_join(slice(split(phrase, ' '), k + 1, size - k), ' ') as tail))""")
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")
    long = found.filter("size >= 2").select("lang", "phrase", F.col("n").alias("a"), salt.alias("salt"), F.explode(parts).alias("cut"))
    long = long.select("lang", "phrase", "a", "salt", "cut.k", F.explode(F.array(
        F.struct(F.lit(True).alias("left"), F.col("cut.head").alias("part")), F.struct(F.lit(False).alias("left"), F.col("cut.tail").alias("part")))).alias("side"))
    looked = long.select("lang", "phrase", "a", "k", "salt", "side.left", "side.part")
    known = found.filter(F.col("size") < longest).select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    both = looked.join(known, ["lang", "part", "salt"]).groupBy("lang", "phrase", "a", "k").agg(
        F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    score = F.call_function("div", _exact(F.lit(1_000_000)) * _exact(F.col("a")) * _exact(F.col("a")), _exact(F.col("l")) * _exact(F.col("r")))
    cuts = both.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = F.expr(f"""flatten(transform(sequence(2, size - 1), w -> transform(sequence(1, size - w + 1), i ->
        array_join(slice(split(phrase, ' '), i, w), ' '))))""")
    hidden = found.filter("size >= 3").select("lang", F.col("n"), F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = cuts.join(hidden, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < INSIDE_PERCENT * F.col("a")))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    # A language's best are among the best of each of its parts, so no task ranks a whole language.
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANKERS))).orderBy(*order)
    first = kept.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
