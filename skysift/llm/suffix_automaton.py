"""Benchmark decontamination with a generalised suffix automaton.

All test items, as words, go into one suffix automaton. The words of a document
run through it; the state and the matched length say which windows of which
items end at each word. Words, and pairs of neighbouring words, that no item has
reset the automaton, so the runs between them are found with array operations
and only runs as long as the shortest window are walked word by word.

The items are a stated query set. They are read in blocks of at most
``BLOCK_WORDS`` words; each block's automaton is sent to the executors once and
makes one pass over the documents. With more than one block the rows are written
after each pass and the automaton is given back before the next is built, so
neither the driver nor a task holds more than one.

Defined cases: null, empty and wordless texts have no words, no hits and are not
contaminated. Items without words have no window. Items with equal ids count as
one; an item with a null id hits words but is not listed. Every document row is
judged on its own, so repeated rows get equal results. Columns named in
``carry`` come through unchanged (those called like a result get an underscore
behind), others are not read. Empty tables are fine on
either side.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from skysift.llm.common import ALNUM_WORD, LOWER, free_names, list_array, steps, text_bytes, word_array, words
from skysift.session import cut_lineage, drop_scratch

WINDOW = 13
#: A document is contaminated if the hit words are at least one in so many.
COVERAGE = 20
BLOCK_WORDS = 1_000_000


class Automaton:
    """Suffix automaton of several word sequences, with the windows that end in each state."""

    def __init__(self, items: Sequence[tuple[int | None, list[bytes]]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.following: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in text]
            last = 0
            for w in ids:
                last = self._extend(last, w)
            coded.append((item, ids))
        ends: dict[int, dict[int, set[int]]] = {}
        self.shortest = window
        pairs = set()
        for item, ids in coded:
            size = min(window, len(ids))
            if not size:
                continue
            self.shortest = min(self.shortest, size)
            pairs.update(zip(ids, ids[1:]))
            state = 0
            for n, w in enumerate(ids, 1):
                state = self.following[state][w]
                if n >= size:
                    top = state
                    while self.length[self.link[top]] >= size:
                        top = self.link[top]
                    ends.setdefault(top, {}).setdefault(size, set()).update(() if item is None else (item,))
        # Windows that end in a state are its own and those of the shorter suffixes.
        self.ending: list[tuple[tuple[int, frozenset[int]], ...]] = [()] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            own = tuple((size, frozenset(found)) for size, found in sorted(ends.get(state, {}).items()))
            self.ending[state] = self.ending[self.link[state]] + own
        self.values = pa.array(list(self.vocabulary), pa.large_binary())
        self.pairs = np.array(sorted(a * len(self.vocabulary) + b for a, b in pairs), np.int64)

    def _extend(self, last: int, w: int) -> int:
        following, link, length = self.following, self.link, self.length
        if w in following[last]:
            q = following[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = self._state({}, length[last] + 1)
        p = last
        while p >= 0 and w not in following[p]:
            following[p][w] = cur
            p = link[p]
        if p < 0:
            link[cur] = 0
        else:
            q = following[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _state(self, following: dict[int, int], length: int) -> int:
        self.following.append(following)
        self.link.append(0)
        self.length.append(length)
        return len(self.link) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        twin = self._state(dict(self.following[q]), self.length[p] + 1)
        self.link[twin], self.link[q] = self.link[q], twin
        while p >= 0 and self.following[p].get(w) == q:
            self.following[p][w] = twin
            p = self.link[p]
        return twin

    def matches(self, ids: Sequence[int]) -> Iterator[tuple[int, int]]:
        """(state, matched length) after each word."""
        following, link, length = self.following, self.link, self.length
        state = size = 0
        for w in ids:
            while state and w not in following[state]:
                state = link[state]
                size = length[state]
            if w in following[state]:
                state = following[state][w]
                size += 1
            else:
                state = size = 0
            yield state, size

    def runs(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 word of the runs that can hold a window; ids below 0 are foreign words."""
        if not len(ids) or not len(self.values):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        tied = np.zeros(len(ids) + 1, bool)  # word i belongs with word i - 1
        both = np.flatnonzero((ids[1:] >= 0) & (ids[:-1] >= 0)) + 1
        code = ids[both - 1].astype(np.int64) * len(self.values) + ids[both]
        if len(self.pairs):
            place = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            tied[both[self.pairs[place] == code]] = True
        tied[bounds] = False
        first = np.flatnonzero(~tied[:-1])
        last = np.append(first[1:], len(ids))
        keep = (last - first >= self.shortest) & (ids[first] >= 0)
        return first[keep], last[keep]


def _scan(automaton: Automaton, texts: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[int]]]:
    """Words, hit word ranges (merged, in order) and items of each text."""
    data, offsets = text_bytes(texts)
    data = LOWER[data]
    starts, ends, bounds = words(data, offsets, ALNUM_WORD)
    spans: list[list[tuple[int, int]]] = [[] for _ in range(len(texts))]
    items: list[set[int]] = [set() for _ in range(len(texts))]
    if len(starts):
        ids = pc.fill_null(pc.index_in(word_array(data, starts, ends, ALNUM_WORD), value_set=automaton.values), -1).to_numpy()
        for a, b in zip(*automaton.runs(ids, bounds)):
            doc = int(np.searchsorted(bounds, a, "right")) - 1
            at = int(a - bounds[doc])
            for n, (state, size) in enumerate(automaton.matches(ids[a:b].tolist()), at + 1):
                for width, found in automaton.ending[state]:
                    if width > size:
                        break
                    items[doc] |= found
                    own = spans[doc]
                    first = n - width
                    while own and own[-1][1] >= first:
                        first = min(first, own.pop()[0])
                    own.append((first, n))
    return np.diff(bounds), spans, items


SPANS = "array<struct<start:int,end:int>>"


def hits(docs: DataFrame, bench: DataFrame, carry: Sequence[str] = ("doc_id",), window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(carry, n_words, spans, items): word ranges inside windows of ``bench`` (item_id, text), and whose they are."""
    own = ("n_words", "spans", "items")
    added = StructType.fromDDL(f"_n bigint, _spans {SPANS}, _items array<bigint>")
    schema = StructType([StructField("_text", StringType()), *[StructField(f"_{i}", docs.schema[c].dataType) for i, c in enumerate(carry)], *added.fields])
    out = docs.select(
        F.col("text").alias("_text"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(carry)], F.lit(0).cast("bigint").alias("_n"),
        F.expr(f"cast(array() as {SPANS})").alias("_spans"), F.expr("cast(array() as array<bigint>)").alias("_items"))
    shared, done = None, None
    for block in _blocks(bench, block_words):
        if shared:
            # Further items: what the last block found is written, and its automaton given back, before the next is built.
            out = cut_lineage(out, "hits")
            shared.destroy()
            if done:
                drop_scratch(done)
            done = out
        shared = docs.sparkSession.sparkContext.broadcast(Automaton(block, window))
        out = out.mapInArrow(_pass(shared), schema)
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(free_names(carry, own))], *[F.col(f"_{a}").alias(c) for a, c in zip(("n", "spans", "items"), own)])


def _blocks(bench: DataFrame, limit: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """The items in blocks of a bounded number of words; an empty block if there is no item."""
    block, size, any_block = [], 0, False
    for row in bench.select(F.col("item_id").cast("bigint"), "text").toLocalIterator():
        data, offsets = text_bytes(pa.array([row.text], pa.string()))
        data = LOWER[data]
        starts, ends, _ = words(data, offsets, ALNUM_WORD)
        block.append((row.item_id, word_array(data, starts, ends, ALNUM_WORD).to_pylist()))
        size += len(starts)
        if size >= limit:
            yield block
            block, size, any_block = [], 0, True
    if block or not any_block:
        yield block


def _pass(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for part in steps(batches, "_text"):
            counts, spans, items = _scan(automaton, part.column("_text"))
            for n, (before, known) in enumerate(zip(part.column("_spans").to_pylist(), part.column("_items").to_pylist())):
                if before:
                    spans[n] = _merged(spans[n] + [(s["start"], s["end"]) for s in before])
                items[n].update(known)
            flat = [s for own in spans for s in own]
            pairs = pa.StructArray.from_arrays([pa.array([s for s, _ in flat], pa.int32()), pa.array([e for _, e in flat], pa.int32())], ["start", "end"])
            yield pa.record_batch(
                [*part.columns[:-3], pa.array(counts, pa.int64()), list_array(pairs, np.array([len(s) for s in spans], np.int64)),
                 pa.array([sorted(i) for i in items], pa.list_(pa.int64()))], part.schema.names)

    return run


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words", coverage: int = COVERAGE):
    return (F.col(n_hit) > 0) & (coverage * F.col(n_hit) >= F.col(n_words))


def decontaminate(docs: DataFrame, bench: DataFrame, remove: str = "documents", window: int = WINDOW, coverage: int = COVERAGE,
                  longest: int | None = None) -> DataFrame:
    """The documents, all columns, without contamination.

    Documents whose hit words reach the coverage limit go (``remove="documents"``),
    or lose the words of their hit spans (``"spans"``; the words left are joined by
    one space). Documents below the limit stay as they are, except that with
    ``longest`` they lose the words of hit spans of more words than that.
    """
    # The document's own columns travel in a struct, whatever their names.
    found = hits(docs.select("text", F.struct("*").alias("doc")), bench, ["doc"], window)
    found = found.withColumn("n_hit", F.expr("aggregate(spans, 0L, (a, s) -> a + s.end - s.start)"))
    bad = contaminated("n_hit", "n_words", coverage)
    if remove == "documents":
        found = found.filter(~bad)
    if remove == "documents" and longest is None:
        return found.select("doc.*")
    without = lambda least: F.expr(rf"""array_join(filter(regexp_extract_all(doc.text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+', 0),
        (w, i) -> not exists(spans, s -> s.end - s.start > {least} and i >= s.start and i < s.end)), ' ')""")  # noqa: E731
    text = F.when(bad, without(0))
    if longest is not None:
        text = text.when(F.exists("spans", lambda s: s["end"] - s["start"] > longest), without(longest))
    return found.select(F.col("doc").withField("text", text.otherwise(F.col("doc.text"))).alias("doc")).select("doc.*")
