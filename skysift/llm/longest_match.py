"""Token counts by a linear longest-match automaton.

Greedy word pieces take the longest vocabulary entry that a word goes on with,
again and again. The automaton is a trie of the vocabulary whose nodes carry a
failure link and the number of pieces popped on the way there: where no child
takes the next byte, the matched prefix gives up its longest pieces and the rest
of it is a node again. Each byte is read once and no piece is ever built.

A worker walks all different words of a batch side by side, one byte a step.

Words are runs without white space, each with one blank in front, as the
vocabulary has its word beginnings. The vocabulary file must be readable on the
executors, as installed packages are.

Defined cases: null, empty and blank texts have no words and no pieces. A byte
that no entry begins with is one piece. Rows are counted one by one. Columns
named in ``carry`` come through unchanged, others are not read. An empty table
gives an empty table.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift.llm.common import PLAIN_WORD, by_text, text_bytes, word_array, words

RANKS = "byte_bpe_50k.tiktoken"


class Automaton:
    def __init__(self, vocabulary: Iterable[bytes]):
        child: list[dict[int, int]] = [{}]
        entry = [False]
        for piece in vocabulary:
            node = 0
            for c in piece:
                if c not in child[node]:
                    child[node][c] = len(child)
                    child.append({})
                    entry.append(False)
                node = child[node][c]
            entry[node] = bool(piece)
        link, pops = [0] * len(child), [0] * len(child)
        # Breadth first: the links of shorter prefixes are known.
        layer = [(0, c, v) for c, v in child[0].items()]
        while layer:
            below = []
            for up, c, v in layer:
                if entry[v]:
                    link[v], pops[v] = 0, 1
                else:
                    # What is left of the prefix above, then this byte.
                    link[v], pops[v] = self._step(child, link, pops, link[up], c) if up else (0, 1)
                    pops[v] += pops[up] if up else 0
                below += ((v, c2, v2) for c2, v2 in child[v].items())
            layer = below
        self.link, self.pops = np.array(link, np.int64), np.array(pops, np.int64)
        edges = sorted((u << 8 | c, v) for u, own in enumerate(child) for c, v in own.items())
        self.keys = np.array([k for k, _ in edges], np.int64)
        self.targets = np.array([v for _, v in edges], np.int64)

    @staticmethod
    def _step(child, link, pops, node: int, c: int) -> tuple[int, int]:
        """The node and the pops after one byte."""
        count = 0
        while c not in child[node]:
            if not node:
                return 0, count + 1
            count += pops[node]
            node = link[node]
        return child[node][c], count

    def counts(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, blank: bool = True) -> np.ndarray:
        """Pieces of each word (bytes starts to ends of ``flat``), with a blank in front."""
        out = np.zeros(len(starts), np.int64)
        node = np.zeros(len(starts), np.int64)
        # Long words first, so that the words still read are the first ones.
        order = np.argsort(starts - ends, kind="stable")
        starts, ends = starts[order], ends[order]
        sizes = ends - starts
        if blank and len(starts):
            self._read(np.arange(len(starts)), np.full(len(starts), 32, np.int64), node, out)
        live = len(starts)
        for i in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes[:live], -i, "left"))
            lanes = np.arange(live)
            self._read(lanes, flat[starts[:live] + i].astype(np.int64), node, out)
        rest = np.flatnonzero(node)
        while len(rest):
            out[rest] += self.pops[node[rest]]
            node[rest] = self.link[node[rest]]
            rest = rest[node[rest] != 0]
        back = np.empty_like(out)
        back[order] = out
        return back

    def _read(self, lanes: np.ndarray, byte: np.ndarray, node: np.ndarray, out: np.ndarray) -> None:
        while len(lanes):
            key = node[lanes] << 8 | byte
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[place] == key
            node[lanes[found]] = self.targets[place[found]]
            lanes, byte = lanes[~found], byte[~found]
            root = node[lanes] == 0
            out[lanes[root]] += 1  # a byte that nothing begins with
            lanes, byte = lanes[~root], byte[~root]
            out[lanes] += self.pops[node[lanes]]
            node[lanes] = self.link[node[lanes]]


@lru_cache(maxsize=2)
def automaton(ranks: str) -> Automaton:
    """One per Python worker."""
    with open(public_tokenizers.path(ranks), "rb") as lines:
        return Automaton([base64.b64decode(line.split()[0]) for line in lines])


def token_counts(docs: DataFrame, carry: Sequence[str] = ("doc_id",), ranks: str = RANKS) -> DataFrame:
    """(carry, n_words, n_tokens, longest): words, greedy pieces, and the most pieces of one word of each whole text."""

    def make(texts: pa.Array) -> list[pa.Array]:
        own = automaton(ranks)
        data, offsets = text_bytes(texts)
        starts, ends, bounds = words(data, offsets, PLAIN_WORD)
        total, most = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        if len(starts):
            coded = word_array(data, starts, ends, PLAIN_WORD).dictionary_encode()
            _, cuts, flat = coded.dictionary.buffers()
            cuts = np.frombuffer(cuts, np.int64)[:len(coded.dictionary) + 1]
            each = own.counts(np.frombuffer(flat, np.uint8), cuts[:-1], cuts[1:])[coded.indices.to_numpy()]
            some = np.flatnonzero(np.diff(bounds))
            total[some] = np.add.reduceat(each, bounds[some])
            most[some] = np.maximum.reduceat(each, bounds[some])
        return [pa.array(np.diff(bounds)), pa.array(total), pa.array(most)]

    return by_text(docs, carry, "n_words bigint, n_tokens bigint, longest bigint", make)
