import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skysift.llm import fm_index


def plain(rows, window=20):
    """(doc_id, words, kept) by a table of all windows; a missing id comes first, rows of one id are compared by place."""
    first, split = {}, []
    for i, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        split.append((i, w))
        for k in range(len(w) - window + 1):
            here = first.setdefault(tuple(w[k:k + window]), (i, k))
            if here[0] == i and k < here[1]:
                first[tuple(w[k:k + window])] = (i, k)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] != (i, k):
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for n, x in enumerate(w) if n not in gone)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect()), key=repr)


def odd():
    r = random.Random(2)
    say = lambda n, k=400: " ".join(f"w{r.randrange(k)}" for _ in range(n))
    passage, other = say(60), say(25)
    rows = [None, "", " \n\t", "one two", passage, say(30) + " " + passage + "\n" + say(40), passage[5:] + " " + say(10), other + " " + other + "  " + other,
            "a " * 500, "a b " * 300, "a a b " * 100, say(3000, 3), " ".join(passage.split()[7:40]) + " tail", say(20), "é ß " * 30, passage.upper()]
    near = passage.split()
    for n in range(40):
        w = list(near)
        w[r.randrange(60)] = f"x{n}"
        rows.append(say(r.randrange(5)) + " " + " ".join(w) + " " + other)
    return rows


@pytest.mark.parametrize("index_words", [50, 400_000])
def test_matches_window_table(documents, texts, index_words):
    rows = texts + [(100_000 + i, t) for i, t in enumerate(odd())] + [(None, odd()[4])]
    assert got(fm_index.remove_repeats(documents(rows).repartition(3), index_words=index_words)) == plain(rows)


def test_repeated_rows_are_one_reading(documents):
    t = " ".join(f"w{i}" for i in range(50))
    rows = [(1, t), (1, t), (2, t + " end"), (3, "x " + t)]
    assert got(fm_index.remove_repeats(documents(rows))) == [(1, 50, 0, t), (1, 50, 0, t), (2, 51, 50, "end"), (3, 51, 50, "x")]


def crowd():
    """One passage in a third of the texts, amid words of their own, at changing places; many texts without an id."""
    r = random.Random(8)
    say = lambda n: " ".join(f"v{r.randrange(3000)}" for _ in range(n))
    passage = say(45)
    rows = [(i, say(r.randrange(5, 40)) + " " + (passage if i % 3 == 0 else say(45)) + " " + say(r.randrange(5, 40))) for i in range(450)]
    return rows + [(None, say(i % 7) + " " + passage + " " + say(20)) for i in range(60)] + [(None, rows[0][1])] * 50


def test_crowded_owners_are_dealt_again(documents):
    rows = crowd()
    assert got(fm_index.remove_repeats(documents(rows).repartition(5), index_words=400)) == plain(rows)


def test_no_owner_exceeds_an_index(spark):
    rows = [(-1 if i is None else i, n, t) for n, (i, t) in enumerate(crowd())]
    whole = spark.createDataFrame(rows, "key bigint, tag bigint, text string").repartition(5)
    loads = {}
    for bound in (400, 10 ** 9):
        matched = fm_index.deal(whole, 20, 5, bound).filter("not later")
        loads[bound] = matched.groupBy("owner").agg(F.sum(F.col("windows") + 19).alias("words")).agg(F.max("words")).first()[0] or 0
    assert loads[400] <= 400 < loads[10 ** 9]


def test_empty_table(documents):
    assert fm_index.remove_repeats(documents([])).count() == 0


def test_backward_search():
    rng = np.random.default_rng(0)
    lengths = rng.integers(25, 40, 30)
    symbols = rng.integers(1, 4, int(lengths.sum()))
    index = fm_index.FMIndex(symbols, lengths, np.arange(len(symbols), dtype=np.int32))
    pieces = np.split(symbols, np.cumsum(lengths)[:-1])
    for size in (1, 3, 6):
        pattern = pieces[7][4:4 + size]
        low, high = np.zeros(1, np.int64), np.full(1, index.n)
        for c in pattern[::-1]:
            low, high = index.back(np.array([c]), low, high)
        want = sum((p[i:i + size] == pattern).all() for p in pieces for i in range(len(p) - size + 1))
        assert high[0] - low[0] == want
