import random
import re
from collections import Counter

import pytest

from skysift.llm import phrases


def plain(rows, support=10, longest=3, top=2000):
    """rows: (lang, text)."""
    f, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(ws)
            for k in range(1, longest + 1):
                for i in range(len(ws) - k + 1):
                    f.setdefault(lang, Counter())[tuple(ws[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= support}
        scored = []
        for p, a in found.items():
            if any(100 * b >= 50 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items() if len(q) > len(p)):
                continue
            cuts = [(1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
            score, _, l, r = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def texts(n=300):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)] + ["Ünder", "ÄB", "x\x00y", "日本"]
    out = []
    for i in range(n):
        words = [r.choice(vocabulary[:6] if r.random() < 0.5 else vocabulary) for _ in range(r.randrange(60))]
        if r.random() < 0.5:
            words[:0] = ["New", "york", "CITY"]
        text = "".join(w + r.choice([" ", " ", " ", "\t ", ", ", "\n", ".", "\x0b", "!? "]) for w in words)
        out.append((r.choice(["en", "en", "en", "de", None]), text))
    return out + [("fr", None), (None, ""), ("fr", " \t\n"), ("en", "a" * 100_000), ("de", "b c " * 20_000)] + [("es", "same row here")] * 12


@pytest.fixture
def make(spark):
    def table(rows):
        return spark.createDataFrame([(i, l, t, 5, "p") for i, (l, t) in enumerate(rows)], "doc_id bigint, lang string, text string, n bigint, phrase string")

    return table


def test_matches_plain_counts(make):
    rows = texts()
    got = sorted(map(tuple, phrases.collocations(make(rows).repartition(5)).collect()))
    assert got == plain(rows) and len(got) > 50


def test_other_parameters(make):
    rows = texts(120)
    got = sorted(map(tuple, phrases.collocations(make(rows), support=5, longest=4, top=7).collect()))
    assert got == plain(rows, 5, 4, 7)


def test_small_steps_and_few_blocks(make, monkeypatch):
    """A filter of one block lets nearly everything pass; results stay."""
    monkeypatch.setattr(phrases.bloom, "build", lambda keys, f=phrases.bloom.build: f(keys, max_blocks=1))
    rows = texts(80)
    assert sorted(map(tuple, phrases.collocations(make(rows)).collect())) == plain(rows)


def test_counts_beyond_64_bits(spark):
    """10^6 * a * a passes 64 bits from a = 3.1 * 10^6 on."""
    a = 5_000_000
    frame = spark.createDataFrame([(a, a + 7, a + 9)], "a bigint, l bigint, r bigint")
    from pyspark.sql import functions as F
    score = F.call_function("div", phrases._exact(F.lit(1_000_000)) * phrases._exact(F.col("a")) * phrases._exact(F.col("a")), phrases._exact(F.col("l")) * phrases._exact(F.col("r")))
    assert frame.select(score.alias("s")).first().s == 1_000_000 * a * a // ((a + 7) * (a + 9))


def test_empty_table(make):
    assert phrases.collocations(make([])).count() == 0
    assert phrases.collocations(make([("en", None), (None, " ")])).count() == 0
