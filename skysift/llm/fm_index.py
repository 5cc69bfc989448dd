"""Substring deduplication with FM-indexes.

A window of 20 words that starts earlier elsewhere (smaller doc_id, or earlier
in the same document) is removed; what several windows cover is removed once.

Dealing to shards. Every window is owned by one of its word 5-grams, the one of
least hash (the leftmost of equals), so equal windows have equal owners at the
same place. The windows of one owner follow each other; the words they cover are
a fragment. Fragments with equal owners meet in one shard, whatever documents
they come from, and no window has to be compared beyond its shard.

Collapsing. Equal fragments first become one: copies that come later are
duplicates as a whole, in the batch that finds them and once more for all. An
owner left with one fragment has nothing to match. Words travel only for
fragments that share an owner and differ.

Dealing again. A passage that very many documents share gives each of them
fragments at its borders, which run into the document's own words: all differ, all
have one owner. An owner with more words than an index may hold is dealt again by
its windows' two least grams, then four, eight and the whole window, and equal
fragments collapse again. Equal windows still meet, and every index stays bounded.

Matching. Each shard indexes its fragments: a wavelet matrix over the
Burrows-Wheeler transform in packed bits, with counts per 64 bits, and range
minima of the places in suffix order. Fragments then stream against the index by
backward search. A search goes on while the matched words occur at an earlier
place; it reports the words that matched far enough, and words that match
nowhere earlier rule out every window around them.

Defined cases: null and empty texts, and texts under 20 words, lose nothing. A
null doc_id comes before all others. Rows with the same doc_id and text are one
reading of a document and get the same result, however many there are; rows with
the same doc_id and other texts, as all rows without one, are compared by place in
the text, equal places not being earlier than each other. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skysift.llm.common import PLAIN_WORD, ramp, steps, text_bytes, word_array, words
from skysift.session import cut_lineage

WINDOW, GRAM = 20, 5
#: Words of the fragments of one owner, and of an index before its last owner.
INDEX_WORDS = 400_000
FIRST_KEY = -(1 << 63)
ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(ODD), -1, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Runs:
    """The words of some texts and the runs of windows with one owner.

    doc, first, count: text of each run, its first window, its windows;
    owner, body: hashes of the owning grams and of all words of the fragment.
    ``depth``: how many of a window's least grams own it; ``only``: lists of runs
    (first, windows) of each text, to which the windows are limited.
    """

    def __init__(self, texts: pa.Array, window: int = WINDOW, gram: int = GRAM, depth: int = 1, only: pa.Array | None = None):
        data, offsets = text_bytes(texts)
        self.data = data
        self.starts, self.ends, self.bounds = words(data, offsets, PLAIN_WORD)
        total = len(self.starts)
        if total < window:
            none = np.zeros(0, np.int64)
            self.doc = self.first = self.count = none
            self.owner = self.body = none.astype(np.uint64)
            return
        coded = word_array(data, self.starts, self.ends, PLAIN_WORD).dictionary_encode()
        h = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)[coded.indices.to_numpy()]
        grams = np.zeros(total - gram + 1, np.uint64)
        for j in range(gram):
            grams = grams * ODD + h[j:j + len(grams)]
        grams = _mix(grams)
        width = window - gram + 1
        doc = np.repeat(np.arange(len(texts)), np.diff(self.bounds))
        inside = doc[:total - window + 1] == doc[window - 1:]
        if only is not None:
            inside &= self._marked(only, len(inside))
        whole = np.flatnonzero(inside)
        view = np.lib.stride_tricks.sliding_window_view(grams, width)
        # No window occurs twice in a run: its least gram would lie in another place.
        least = view.argmin(1)[whole] + whole
        owner = grams[least] if depth == 1 else self._deeper(view, whole, depth)
        fresh = np.ones(len(whole), bool)
        fresh[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | (whole[1:] != whole[:-1] + 1)
        at = np.flatnonzero(fresh)
        self.start = whole[at]
        self.count = np.diff(np.append(at, len(whole)))
        self.doc = doc[self.start]
        self.first = self.start - self.bounds[self.doc]
        self.owner = owner[at]
        # Hash of the words between two places, by prefix sums of a polynomial.
        powers = np.ones(total + 1, np.uint64)
        powers[1:] = ODD
        powers = np.cumprod(powers)
        prefix = np.zeros(total + 1, np.uint64)
        np.cumsum(h * powers[:-1], out=prefix[1:])
        back = np.full(total + 1, _INVERSE, np.uint64)
        back[0] = 1
        back = np.cumprod(back)
        length = self.count + window - 1
        self.body = _mix((prefix[self.start + length] - prefix[self.start]) * back[self.start] + _mix(length.astype(np.uint64)))

    def _marked(self, only: pa.Array, windows: int) -> np.ndarray:
        """Which windows lie in the listed runs."""
        entry = only.flatten()
        doc = np.repeat(np.arange(len(only)), only.value_lengths().to_numpy())
        start = self.bounds[doc] + entry.field("first").to_numpy()
        edge = np.zeros(windows + 1, np.int64)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + entry.field("windows").to_numpy(), -1)
        return np.cumsum(edge[:-1]) > 0

    @staticmethod
    def _deeper(view: np.ndarray, whole: np.ndarray, depth: int) -> np.ndarray:
        """A hash of each window's ``depth`` least grams; of all its grams in their order if there are no more."""
        out = np.empty(len(whole), np.uint64)
        for i in range(0, len(whole), 1 << 16):
            rows = view[whole[i:i + (1 << 16)]]
            if depth < rows.shape[1]:
                rows = np.sort(np.partition(rows, depth - 1, 1)[:, :depth], 1)
            h = np.full(len(rows), depth, np.uint64)
            for j in range(rows.shape[1]):
                h = _mix(h * ODD + rows[:, j])
            out[i:i + (1 << 16)] = h
        return out


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


OWNED = "owner bigint, body bigint, key bigint, tag bigint, first int, windows int, later boolean"


def _owners(window: int, gram: int, depth: int = 1):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches):
            runs = Runs(part.column("text"), window, gram, depth, part.column("runs") if depth > 1 else None)
            if not len(runs.doc):
                continue
            key = part.column("key").to_numpy()[runs.doc]
            order = np.lexsort((runs.first, key, runs.body, runs.owner))
            owner, body, key, first = runs.owner[order], runs.body[order], key[order], runs.first[order]
            same = np.zeros(len(order), bool)
            same[1:] = (owner[1:] == owner[:-1]) & (body[1:] == body[:-1])
            lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
            # A later copy within the batch is settled; it is dealt out at random.
            later = same & ((key != key[lead]) | (first != first[lead]))
            spread = _mix(owner + np.arange(len(order), dtype=np.uint64) + key.astype(np.uint64) * ODD)
            yield pa.record_batch({
                "owner": _signed(np.where(later, spread, owner)), "body": _signed(body), "key": pa.array(key),
                "tag": pa.array(part.column("tag").to_numpy()[runs.doc[order]]), "first": pa.array(first.astype(np.int32)),
                "windows": pa.array(runs.count[order].astype(np.int32)), "later": pa.array(later)})

    return run


def _live(owned: DataFrame, window: int) -> DataFrame:
    """The fragments that are settled as later copies, or differ from another of their owner; ``load``: the owner's words to be matched."""
    ranked = owned.withColumn("nth", F.rank().over(Window.partitionBy("owner", "body").orderBy("key", "first")))
    known = ranked.withColumn("later", F.col("later") | (F.col("nth") > 1))
    group = Window.partitionBy("owner")
    shared = known.withColumns({
        "least": F.min("body").over(group), "most": F.max("body").over(group),
        "load": F.coalesce(F.sum(F.when(~F.col("later"), F.col("windows") + window - 1)).over(group), F.lit(0))})
    return shared.filter("later or least != most").select("owner", "key", "tag", "first", "windows", "later", "load")


def deal(whole: DataFrame, window: int, gram: int, index_words: int) -> DataFrame:
    """(owner, key, tag, first, windows, later, load) of ``whole`` (key, tag, text): no owner's load is above ``index_words``."""
    live = cut_lineage(_live(whole.mapInArrow(_owners(window, gram), OWNED), window), "live")
    settled = live
    width = window - gram + 1
    for depth in [d for d in (2, 4, 8) if d < width] + [width]:
        crowded = live.filter(~F.col("later") & (F.col("load") > index_words))
        if crowded.isEmpty():
            break
        settled = settled.filter(F.col("later") | (F.col("load") <= index_words))
        runs = crowded.groupBy("key", "tag").agg(F.collect_set(F.struct("first", "windows")).alias("runs"))
        live = cut_lineage(_live(whole.join(runs, ["key", "tag"]).mapInArrow(_owners(window, gram, depth), OWNED), window), "live")
        settled = settled.unionByName(live)
    return settled


FRAGMENT = "owner bigint, key bigint, tag bigint, first int, last int, body string"


def _fragments(window: int):
    """Words of the fragments to be matched, and the merged ranges of those that are settled (no body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches):
            # Equal rows are one reading.
            pairs = np.stack([part.column("key").to_numpy(), part.column("tag").to_numpy()], 1)
            part = part.take(pa.array(np.unique(pairs, axis=0, return_index=True)[1]))
            key, tag, live = part.column("key").to_numpy(), part.column("tag").to_numpy(), part.column("live")
            data, offsets = text_bytes(part.column("text"))
            starts, ends, bounds = words(data, offsets, PLAIN_WORD)
            entry = live.flatten()
            doc = np.repeat(np.arange(part.num_rows), live.value_lengths().to_numpy())
            first = entry.field("first").to_numpy().astype(np.int64)
            order = np.lexsort((first, doc))
            doc, first = doc[order], first[order]
            last = first + entry.field("windows").to_numpy()[order] + window - 1
            owner, later = entry.field("owner").to_numpy()[order], entry.field("later").to_numpy(zero_copy_only=False)[order]
            if later.any():
                d, a, b = doc[later], first[later], last[later]
                fresh = np.ones(len(d), bool)
                fresh[1:] = (d[1:] != d[:-1]) | (a[1:] > b[:-1])
                head = np.flatnonzero(fresh)
                tail = np.append(head[1:], len(d)) - 1
                spread = _mix(key[d[head]].astype(np.uint64) * ODD + a[head].astype(np.uint64))
                yield pa.record_batch({
                    "owner": _signed(spread), "key": pa.array(key[d[head]]), "tag": pa.array(tag[d[head]]), "first": pa.array(a[head].astype(np.int32)),
                    "last": pa.array(b[tail].astype(np.int32)), "body": pa.nulls(len(head), pa.string())})
            ask = ~later
            if ask.any():
                d, a, b = doc[ask], first[ask], last[ask]
                inside = PLAIN_WORD[data]
                behind = np.zeros(len(inside) + 1, bool)
                behind[ends] = True
                keep = inside | (behind[:-1] & ~inside)
                text = np.where(inside, data, 32)[keep].astype(np.uint8).tobytes()
                to = np.cumsum(keep) - keep
                begin = to[starts[bounds[d] + a]]
                end = to[ends[bounds[d] + b - 1] - 1] + 1
                yield pa.record_batch({
                    "owner": pa.array(owner[ask]), "key": pa.array(key[d]), "tag": pa.array(tag[d]), "first": pa.array(a.astype(np.int32)),
                    "last": pa.array(b.astype(np.int32)), "body": pa.array([text[x:y].decode() for x, y in zip(begin.tolist(), end.tolist())], pa.string())})

    return run


class FMIndex:
    """Compressed full-text index of sequences of symbols from 1; each sequence ends a text of its own.

    ``place`` orders the positions; searches ask for an occurrence at a smaller place.
    """

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray, place: np.ndarray):
        # One separator behind each sequence, smaller than every symbol and unlike all others.
        count = len(lengths)
        self.offset = np.cumsum(lengths + 1) - (lengths + 1)
        n = len(symbols) + count
        text = np.zeros(n, np.int64)
        filled = np.ones(n, bool)
        filled[self.offset + lengths] = False
        text[filled] = symbols
        self.text, self.n = text, n
        rank = text + count
        rank[~filled] = np.arange(count)
        order, rank = self._sorted(rank)
        size = 1
        while rank[order[-1]] < n - 1:
            key = rank * (n + 1)
            key[:n - size] += rank[size:] + 1
            order, rank = self._sorted(key)
            size *= 2
        before = text[order - 1]  # the first text has no symbol before it: the last separator
        top = int(symbols.max()) if len(symbols) else 0
        self.levels = max(1, top.bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        current = before
        for level in reversed(range(self.levels)):
            bit = (current >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
            self.bits.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int32)]).astype(np.int32))
            self.zeros.append(n - int(bit.sum()))
            current = np.concatenate([current[~bit], current[bit]])
        tally = np.bincount(before, minlength=top + 1)
        smaller = np.cumsum(tally) - tally
        begin = np.zeros(top + 1, np.int64)
        begin[current[::-1]] = np.arange(n)[::-1]
        self.shift = smaller - begin
        # Range minima of the places, in suffix order.
        spot = np.full(n, np.iinfo(np.int32).max, np.int32)
        spot[filled] = place
        minima = [spot[order]]
        width = 1
        while 2 * width <= n:
            minima.append(np.minimum(minima[-1][:-width], minima[-1][width:]))
            width *= 2
        self.minima = minima
        self.spot = spot

    @staticmethod
    def _sorted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(np.append(False, ordered[1:] != ordered[:-1]))
        return order, rank

    def back(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix ranges after one more symbol on the left."""
        at = np.concatenate([low, high])
        twice = np.concatenate([symbol, symbol])
        for level, bits, counts, zeros in zip(reversed(range(self.levels)), self.bits, self.counts, self.zeros):
            block = at >> 6
            ones = counts[block] + np.bitwise_count(bits[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(twice >> level & 1, zeros + ones, at - ones)
        at = at + self.shift[twice]
        return at[:len(low)], at[len(low):]

    def earliest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least place in each nonempty suffix range."""
        out = np.empty(len(low), np.int32)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level):
            here = level == k
            table = self.minima[k]
            out[here] = np.minimum(table[low[here]], table[high[here] - (1 << int(k))])
        return out

    def repeated(self, windows: np.ndarray, window: int) -> np.ndarray:
        """For each sequence's windows, in a row: does the window occur at an earlier place?

        A lane per sequence keeps the windows it has not settled, ``low`` to ``high``.
        After a failure it tries the leftmost one: the words on which a search fails
        rule out all windows around them. After a success it tries the rightmost one and
        extends leftwards, settling a window with every further word.
        """
        cuts = np.cumsum(windows) - windows
        out = np.zeros(int(windows.sum()), bool)
        lane = np.arange(len(windows))
        first, last = np.zeros(len(windows), np.int64), windows.astype(np.int64) - 1
        backwards = np.zeros(len(windows), bool)
        end = first + window
        at = end.copy()
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), self.n, np.int64)
        while len(lane):
            base = self.offset[lane]
            at = at - 1
            low, high = self.back(self.text[base + at], low, high)
            alive = high > low
            some = np.flatnonzero(alive)
            alive[some] = self.earliest(low[some], high[some]) < self.spot[base[some] + at[some]]
            # A window that starts here and matched in full is repeated.
            full = alive & (end - at >= window)
            out[cuts[lane[full]] + at[full]] = True
            # Where the search ends: all done, success at the leftmost window, or failure.
            ended = ~alive | (full & (at == first)) | (full & ~backwards)
            if ended.any():
                won = ended & alive
                lost = ended & ~alive
                # Forward: one window at the left is settled, or all up to the failing word.
                f = ended & ~backwards
                first = np.where(f, np.where(won, first + 1, at + 1), first)
                b = ended & backwards
                last = np.where(b & won, first - 1, np.where(b & lost, np.minimum(at, last - 1), last))
                backwards = np.where(ended, won, backwards)
                left = first <= last
                keep = ~ended | left
                end = np.where(ended, np.where(backwards, last, first) + window, end)
                at = np.where(ended, end, at)
                low, high = np.where(ended, 0, low), np.where(ended, self.n, high)
                lane, first, last, backwards, end, at, low, high = (x[keep] for x in (lane, first, last, backwards, end, at, low, high))
        return out


def _match(window: int, index_words: int):
    def settle(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        key, tag = rows.column("key").to_numpy(), rows.column("tag").to_numpy()
        first, stop = rows.column("first").to_numpy().astype(np.int64), rows.column("last").to_numpy().astype(np.int64)
        data, offsets = text_bytes(rows.column("body").chunk(0))
        starts, ends, bounds = words(data, offsets, PLAIN_WORD)
        coded = word_array(data, starts, ends, PLAIN_WORD).dictionary_encode()
        lengths = np.diff(bounds)
        source = np.repeat(np.arange(len(lengths)), lengths)
        # Places order words by document and word; words of one place are equals.
        where = first[source] + ramp(lengths)
        order = np.lexsort((where, key[source]))
        k, w = key[source][order], where[order]
        place = np.empty(len(order), np.int32)
        place[order] = np.cumsum(np.append(False, (k[1:] != k[:-1]) | (w[1:] != w[:-1])))
        windows = lengths - window + 1
        index = FMIndex(coded.indices.to_numpy().astype(np.int64) + 1, lengths, place)
        hit = index.repeated(windows, window)
        # Runs of repeated windows as ranges of words.
        source = np.repeat(np.arange(len(lengths)), windows)
        where = first[source] + ramp(windows)
        source, where = source[hit], where[hit]
        fresh = np.ones(len(source), bool)
        fresh[1:] = (source[1:] != source[:-1]) | (where[1:] != where[:-1] + 1)
        head = np.flatnonzero(fresh)
        tail = np.append(head[1:], len(source))[:len(head)] - 1
        return pa.record_batch({
            "key": pa.array(key[source[head]]), "tag": pa.array(tag[source[head]]), "first": pa.array(where[head].astype(np.int32)),
            "last": pa.array((where[tail] + window).astype(np.int32))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, owner = 0, None
        for batch in batches:
            settled = batch.filter(batch.column("body").is_null())
            yield settled.select(["key", "tag", "first", "last"])
            batch = batch.filter(batch.column("body").is_valid())
            if not batch.num_rows:
                continue
            owners = batch.column("owner").to_numpy()
            sizes = np.cumsum(batch.column("last").to_numpy().astype(np.int64) - batch.column("first").to_numpy())
            change = np.flatnonzero(np.append(owner is not None and owners[0] != owner, owners[1:] != owners[:-1]))
            done = 0
            for cut in change.tolist():
                now = size + (int(sizes[cut - 1]) if cut else 0) - (int(sizes[done - 1]) if done else 0)
                if now >= index_words:
                    held.append(batch.slice(done, cut - done))
                    yield settle([x for x in held if x.num_rows])
                    held, size, done = [], 0, cut
            held.append(batch.slice(done))
            size += int(sizes[-1]) - (int(sizes[done - 1]) if done else 0)
            owner = owners[-1]
        if held:
            yield settle(held)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts without the words in their spans."""
    for part in steps(batches):
        data, offsets = text_bytes(part.column("text"))
        starts, ends, bounds = words(data, offsets, PLAIN_WORD)
        spans = part.column("spans")
        entry = spans.flatten()
        doc = np.repeat(np.arange(part.num_rows), spans.value_lengths().fill_null(0).to_numpy())
        edge = np.zeros(len(starts) + 1, np.int64)
        np.add.at(edge, bounds[doc] + entry.field("first").to_numpy(), 1)
        np.add.at(edge, bounds[doc] + entry.field("last").to_numpy(), -1)
        kept = np.cumsum(edge[:-1]) == 0
        # Bytes of kept words, with a space between two of one text.
        inside = np.zeros(len(data) + 1, np.int64)
        np.add.at(inside, starts[kept], 1)
        np.add.at(inside, ends[kept], -1)
        inside = np.cumsum(inside[:-1]) > 0
        left = np.add.reduceat(np.append(kept, False), np.minimum(bounds[:-1], len(kept))) * (np.diff(bounds) > 0)
        text = np.repeat(np.arange(part.num_rows), np.diff(bounds))[kept]
        last = np.ones(len(text), bool)
        last[:-1] = text[1:] != text[:-1]
        sizes = (ends - starts)[kept] + ~last
        out = np.full(int(sizes.sum()), 32, np.uint8)
        begin = np.cumsum(sizes) - sizes
        length = (ends - starts)[kept]
        out[np.repeat(begin, length) + ramp(length)] = data[inside]
        cuts = np.zeros(part.num_rows + 1, np.int64)
        np.add.at(cuts, text + 1, sizes)
        cuts = np.cumsum(cuts)
        yield pa.record_batch({
            "key": part.column("key"), "n_words": pa.array(np.diff(bounds)), "n_removed": pa.array(np.diff(bounds) - left),
            "kept": pa.Array.from_buffers(pa.string(), part.num_rows, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(out)])})


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, index_words: int = INDEX_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words left of each text, joined by one space."""
    whole = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(FIRST_KEY)).alias("key"), F.xxhash64("text").alias("tag"), F.col("text"))
    live = deal(whole, window, gram, index_words)
    # Lists are of one text each, whatever number of rows has its key.
    lists = live.groupBy("key", "tag").agg(F.collect_set(F.struct("owner", "first", "windows", "later")).alias("live"))
    fragments = whole.join(lists, ["key", "tag"]).mapInArrow(_fragments(window), FRAGMENT)
    spans = fragments.repartition("owner").sortWithinPartitions("owner").mapInArrow(_match(window, index_words), "key bigint, tag bigint, first int, last int")
    removed = spans.groupBy("key", "tag").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    out = whole.join(removed, ["key", "tag"], "left").select("key", "text", "spans").mapInArrow(_cut, "key bigint, n_words bigint, n_removed bigint, kept string")
    return out.select(F.when(F.col("key") != FIRST_KEY, F.col("key")).alias("doc_id"), "n_words", "n_removed", "kept")
