"""Byte-level BPE, long pieces as a tree reduction.

Pieces of at most ``LEAF`` bytes, which nearly all are, are merged directly.
Encoding a longer piece is a reduction over its halves. Two encoded neighbours join
by re-encoding a window around their border: a sequence of tokens is the
encoding of its bytes exactly when every two adjacent tokens are (the pair
encodes to itself), because merges inside a token don't look at its neighbours
and the first merge across a border would already happen in the pair alone. So
a window has grown far enough once the token left of it and the token right of
it each form such a pair with the window's edge. Decoding is a flat lookup of the
tokens' bytes, one after the other; it needs no tree.

The matches of the splitting pattern are found for a whole batch of texts from
the classes of their bytes, each different match is reduced once, and its tokens
are copied to all its places. That holds for texts of ASCII and the letters from
U+00C0 to U+00FF; texts with other characters, or under another pattern, are
split by the pattern itself.

Defined cases: a null or empty text has no tokens and decodes to no bytes. Rows
are encoded one by one, so repeated rows and ties need no rule. Columns named in
``carry`` come through unchanged (``encode`` gives one called ``token_ids`` back as
``token_ids_``), others are not read. The rank file must be
readable on the executors, as installed packages are.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from skysift.llm.common import free_names, list_array, ramp, steps, text_bytes

RANKS = "byte_bpe_50k.tiktoken"
#: Bytes from which merging uses a heap.
SHORT = 96
#: Bytes of a leaf of the tree, and pieces and pairs a worker remembers.
LEAF, KNOWN = 24, 250_000
#: Tokens decoded in one step (more where one text has more).
DECODED = 1 << 18
#: Bytes of text that a step encodes; workers live on between stages and keep what a step took.
ENCODED = 1 << 20
#: Classes of bytes: other, letter, digit, white space; bytes from 0x80 are parts of letters here.
OTHER, LETTER, DIGIT, SPACE = range(4)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
CLASS[48:58] = DIGIT
CLASS[[*range(9, 14), 32]] = SPACE


def plain_texts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts have no characters but ASCII and the letters U+00C0 to U+00FF (nor the separators 1C to 1F)."""
    before = np.empty_like(data)
    before[:1], before[1:] = 0, data[:-1]
    tail = (data & 0xC0 == 0x80) & (before == 0xC3) & (data != 0x97) & (data != 0xB7)
    odd = (data >= 0x80) & (data != 0xC3) & ~tail | (data >= 0x1C) & (data < 0x20)
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(odd, out=total[1:])
    return total[offsets[1:]] == total[offsets[:-1]]


def pieces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the matches of the splitting pattern begin in plain texts; they cover every byte."""
    n = len(data)
    kind = CLASS[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    change = first[:n].copy()
    change[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(change)
    stop = np.append(run[1:], n)
    what = kind[run]
    followed = ~first[stop]
    begin = change
    # Of white space before something else, the last character stands alone: a blank goes with what follows.
    last = stop[(what == SPACE) & followed] - 1
    begin[last] = True
    blank = data[last] == 32
    begin[last[blank] + 1] = False
    # 's 't 'm 'd 're 've 'll, where a match begins at the apostrophe.
    mark = run[(what == OTHER) & followed & (stop == run + 1)]
    mark = mark[(data[mark] == 39) & begin[mark]]
    one = np.append(data, [0, 0])[mark + 1]
    two = np.append(data, [0, 0])[mark + 2]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = ~first[np.minimum(mark + 2, n)] & ((two == 101) & ((one == 114) | (one == 118)) | (one == 108) & (two == 108))
    for at, size in ((mark[short], 2), (mark[long], 3)):
        begin[at + 1] = False
        rest = at + size
        rest = rest[rest < n]
        begin[rest] |= kind[rest] == LETTER
    return np.flatnonzero(begin)


def merge(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The encoding of a run of bytes: merge the leftmost pair of least rank until none is left."""
    n = len(data)
    if n == 1:
        return [ranks[data]]
    if n > SHORT:
        return _merge_long(data, ranks)
    get, none = ranks.get, len(ranks) + 256
    cut = list(range(n + 1))
    rank = [get(data[i:i + 2], none) for i in range(n - 1)]
    while rank and (least := min(rank)) != none:
        i = rank.index(least)
        del cut[i + 1], rank[i]
        if i < len(rank):
            rank[i] = get(data[cut[i]:cut[i + 2]], none)
        if i:
            rank[i - 1] = get(data[cut[i - 1]:cut[i + 1]], none)
    return [ranks[data[a:b]] for a, b in zip(cut, cut[1:])]


def _merge_long(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap, for windows that have grown."""
    n = len(data)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or end[after[i]] != stop:
            continue
        j = after[i]
        alive[j] = False
        end[i], after[i] = stop, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(data[i:end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if before[i] >= 0 and (r := ranks.get(data[before[i]:stop])) is not None:
            heapq.heappush(heap, (r, before[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[data[i:end[i]]])
        i = after[i]
    return out


class Codec:
    """Encoder and decoder of one rank file; what it has seen is remembered up to a bound."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.split = regex.compile(pattern).findall
        self.usual = pattern == public_tokenizers.PATTERN
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def stable(self, a: int, b: int) -> bool:
        """Whether the two tokens side by side are the encoding of their bytes."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= KNOWN:
                self.pairs.clear()
            known = self.pairs[a, b] = merge(self.tokens[a] + self.tokens[b], self.ranks) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of two encodings."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        a, b = 1, 1
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            window = merge(b"".join([self.tokens[t] for t in chain(left[-a:], right[:b])]), self.ranks)
            left_done = a == len(left) or self.stable(left[-a - 1], window[0])
            right_done = b == len(right) or self.stable(window[-1], right[b])
            if left_done and right_done:
                return left[:-a] + window + right[b:]
            a, b = (a if left_done else 2 * a), (b if right_done else 2 * b)

    def tree(self, data: bytes) -> list[int]:
        if len(data) <= LEAF:
            return merge(data, self.ranks) if data else []
        middle = len(data) // 2
        return self.join(self.tree(data[:middle]), self.tree(data[middle:]))

    def piece(self, text: str) -> tuple[int, ...]:
        """The tokens of one match of the pattern; a match that is a token is that token."""
        data = text.encode()
        whole = self.ranks.get(data)
        found = (whole,) if whole is not None else tuple(self.tree(data))
        if len(text) <= 64:
            if len(self.pieces) >= KNOWN:
                self.pieces.clear()
            self.pieces[text] = found
        return found

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable([self.known(p) for p in self.split(text)]))

    def known(self, text: str) -> tuple[int, ...]:
        return self.pieces.get(text) or self.piece(text)

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all texts, and how many each has."""
        data, offsets = text_bytes(texts)
        counts = np.zeros(len(texts), np.int64)
        plain = plain_texts(data, offsets) if self.usual else np.zeros(len(texts), bool)
        odd = np.flatnonzero(~plain)
        if len(odd):
            whole = data.tobytes()
            slow = [self.encode(whole[offsets[i]:offsets[i + 1]].decode()) for i in odd]
            counts[odd] = [len(x) for x in slow]
            data = data[np.repeat(plain, np.diff(offsets))]
            offsets = np.append(0, np.cumsum(np.diff(offsets) * plain))
        ids = np.zeros(0, np.int32)
        if len(data):
            begin = pieces(data, offsets)
            cuts = np.append(begin, len(data))
            coded = pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
            found = [self.known(p) for p in coded.dictionary.to_pylist()]
            size = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter(chain.from_iterable(found), np.int32, int(size.sum()))
            which = coded.indices.to_numpy()
            each = size[which]
            ids = flat[np.repeat((np.cumsum(size) - size)[which], each) + ramp(each)]
            total = np.append(0, np.cumsum(each))
            counts[plain] = np.diff(total[np.searchsorted(begin, offsets)])[plain]
        if len(odd):
            out = np.empty(int(counts.sum()), np.int32)
            mine = np.repeat(plain, counts)
            out[mine] = ids
            out[~mine] = np.fromiter(chain.from_iterable(slow), np.int32)
            ids = out
        return ids, counts

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the tokens one after the other, and the length of each."""
        size = self.sizes[ids]
        return self.bytes[np.repeat(self.begins[ids], size) + ramp(size)], size

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The bytes of each text, from the tokens of all and how many each has."""
        data, size = self.decode(ids)
        ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(counts))]
        return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


@lru_cache(maxsize=2)
def codec(ranks: str, pattern: str) -> Codec:
    """One per Python worker."""
    return Codec(public_tokenizers.path(ranks), pattern)


def encode(docs: DataFrame, carry: Sequence[str] = ("doc_id",), ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(carry, token_ids): the tokens of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for part in steps(batches, "_text", ENCODED):
            ids, counts = own.encode_all(part.column("_text"))
            yield pa.record_batch([*part.columns[1:], list_array(pa.array(ids), counts)], [*names, "token_ids"])

    names = free_names(carry, ("token_ids",))
    schema = StructType([*(StructField(n, docs.schema[c].dataType) for n, c in zip(names, carry)), StructField("token_ids", ArrayType(IntegerType()))])
    return docs.select(F.col("text").alias("_text"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(carry)]).mapInArrow(run, schema)


def decode(tokens: DataFrame, carry: Sequence[str] = ("doc_id",), ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(carry, token_ids, decoded): the bytes that the tokens stand for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for batch in batches:
            total = np.cumsum(batch.column("token_ids").value_lengths().fill_null(0).to_numpy().astype(np.int64))
            start = 0
            while start < batch.num_rows:
                stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + DECODED, "right")))
                part = batch.slice(start, stop - start)
                start = stop
                lists = part.column("token_ids")
                cells = own.decode_all(lists.flatten().to_numpy(), lists.value_lengths().fill_null(0).to_numpy())
                yield pa.record_batch([*part.columns, cells], schema.names)

    schema = StructType([*(tokens.schema[n] for n in (*carry, "token_ids")), StructField("decoded", BinaryType())])
    return tokens.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(carry)], "token_ids").mapInArrow(run, schema)


def round_trip(docs: DataFrame, carry: Sequence[str] = ("doc_id",), ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(carry, token_ids, decoded) of ``decode(encode(docs))`` in one pass.

    Two passes in a row keep two Python workers for each task, each with the tokens
    and what it has seen; here it is one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for part in steps(batches, "_text", ENCODED):
            ids, counts = own.encode_all(part.column("_text"))
            yield pa.record_batch([*part.columns[1:], list_array(pa.array(ids), counts), own.decode_all(ids, counts)], schema.names)
            pa.default_memory_pool().release_unused()

    names = free_names(carry, ("token_ids", "decoded"))
    schema = StructType([*(StructField(n, docs.schema[c].dataType) for n, c in zip(names, carry)),
                         StructField("token_ids", ArrayType(IntegerType())), StructField("decoded", BinaryType())])
    return docs.select(F.col("text").alias("_text"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(carry)]).mapInArrow(run, schema)
