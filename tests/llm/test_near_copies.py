import random
import re
from collections import Counter

import corpus_pipeline
from skysift.llm import near_copies

SF = "/root/testdata/sf0.001"


def plain(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))}


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def plain_components(rows):
    root, sets = {i: i for i, _ in rows}, {i: plain(t) for i, t in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, _) in enumerate(rows):
        for j, _ in rows[:n]:
            if alike(sets[i], sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in root}


def edited(r, words, edits):
    out = list(words)
    for k in r.sample(range(len(out)), edits):
        out[k] = f"e{r.randrange(10 ** 9)}"
    return " ".join(out)


def rows():
    """Groups of near copies with one edited word in a hundred or two, chains, near misses, and odd texts."""
    r = random.Random(7)
    say = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    out = [None, "", " \n", "one", "ONE ", "a b c", "a b c d e", "A b  c d\te"]
    for _ in range(40):
        base = say(300)
        out += [" ".join(base), edited(r, base, 3), edited(r, base, 6), edited(r, base, 40)]
    base = say(400)
    out += [edited(r, base, 5) for _ in range(60)]  # copies of one text, most pairs a little under or over the limit
    for _ in range(10):
        base = edited(r, base.split() if isinstance(base, str) else base, 6)
        out.append(base)
    common = say(100)
    out += [" ".join(common + say(200)) for _ in range(60)]
    return list(enumerate(out))


def test_matches_pairwise_sets(documents, texts):
    table = texts + [(10_000 + i, t) for i, t in rows()]
    got = near_copies.near_copies(documents(table).repartition(3)).collect()
    want = plain_components(table)
    assert Counter((r.doc_id for r in got)) == Counter(i for i, _ in table)
    names = {}
    for r in got:
        assert names.setdefault(r.root, want[r.doc_id]) == want[r.doc_id]
    assert len(names) == len(set(want.values()))


def test_stage_drops_edited_copies(documents, spark):
    table = [(i, t) for i, t in rows() if t and len(t.split()) > 50]
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, documents(table), SF).collect()}
    assert got == set(plain_components(table).values())


def test_empty_table_and_null_id(documents):
    assert near_copies.near_copies(documents([])).count() == 0
    found = near_copies.near_copies(documents([(None, "a b c"), (4, "a b c"), (9, "q")])).collect()
    assert len({r.root for r in found if r.doc_id != 9}) == 1 and len({r.root for r in found}) == 2


def test_copies_of_one_base(documents):
    """Two edits of a hundred words: copies of the base, but mostly not of each other."""
    r = random.Random(11)
    base = [f"w{r.randrange(5000)}" for _ in range(100)]
    table = [(i, edited(r, base, 2)) for i in range(400)] + [(400, " ".join(base))]
    found = Counter(x.root for x in near_copies.near_copies(documents(table).repartition(4)).collect())
    assert max(found.values()) >= 0.99 * len(table)


def test_recall_without_a_base(documents):
    """Chains and loose groups whose links have no common centre."""
    r = random.Random(5)
    table = []
    for g in range(6):
        text = [f"w{r.randrange(5000)}" for _ in range(150)]
        for i in range(40):
            text = edited(r, text, 2).split()
            table.append((1000 * g + i, " ".join(text)))
    want = plain_components(table)
    names = {x.doc_id: x.root for x in near_copies.near_copies(documents(table)).collect()}
    linked = [(i, j) for n, (i, s) in enumerate(table) for j, t in table[max(0, n - 3):n] if want[i] == want[j] and alike(plain(s), plain(t))]
    assert sum(names[i] == names[j] for i, j in linked) >= 0.95 * len(linked) > 0
    assert all(want[i] == want[j] for i, _ in table for j, _ in table if names[i] == names[j])
