import re

from skysift.llm import suffix_automaton

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(rows, items, window=13):
    windows = {}
    for i, t in items:
        w = split(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add(i)
    sizes = {len(w) for w in windows}
    out = []
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k:k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= own
        out.append((i, len(w), len(hit), sorted(x for x in found if x is not None)))
    return sorted(out)


def got(df):
    rows = df.collect()
    return sorted((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), list(r["items"])) for r in rows)


def bench(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string")


ITEMS = [(1, "one two three"), (2, "Two, three!"), (3, None), (4, "..."), (5, "a b a b a b a b a b a b a b a b"), (6, "b a b a b a b a b a b a b a"),
         (7, "x y z " * 8), (1, "one two"), (8, "x y z x y z x y z x y z x q"), (None, "null item here")]
ODD = [None, "", "... !", "one two", "ONE-two three", "two three two three", "a b " * 40, "b a " * 7, "x y z " * 30 + "x q", "z x y " * 9, "null item here", "Straße one two é"]


def test_odd_items(spark, documents):
    rows = [*enumerate(ODD), (3, "one two")]
    docs = documents(rows)
    want = plain(rows, ITEMS)
    assert got(suffix_automaton.hits(docs, bench(spark, ITEMS))) == want
    # The same in several blocks of items.
    assert got(suffix_automaton.hits(docs, bench(spark, ITEMS).coalesce(1), block_words=20)) == want


def test_documents_of_the_driver(spark, texts, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    rows = texts + [(5000, texts[0][1] + " " + items[0][1]), (5001, items[1][1].upper())]
    assert got(suffix_automaton.hits(documents(rows), bench(spark, items))) == plain(rows, items)


def test_empty_tables(spark, documents):
    assert suffix_automaton.hits(documents([]), bench(spark, ITEMS)).count() == 0
    assert got(suffix_automaton.hits(documents(["a b"]), bench(spark, []))) == [(0, 2, 0, [])]


def test_removal(spark, documents):
    passage = "p q r s t u v w k l m n o"
    docs = documents([f"Clean text, {passage}. The rest", "long " * 1000 + passage, "clean", None])
    items = bench(spark, [(1, passage)])
    kept = suffix_automaton.decontaminate(docs, items).collect()
    assert sorted(r.doc_id for r in kept) == [1, 2, 3] and set(kept[0].asDict()) == set(docs.columns)
    cut = {r.doc_id: r.text for r in suffix_automaton.decontaminate(docs, items, remove="spans").collect()}
    assert cut == {0: "Clean text The rest", 1: "long " * 1000 + passage, 2: "clean", 3: None}


def test_long_spans_go_below_the_coverage(spark, documents):
    passage = " ".join(f"p{i}" for i in range(40))
    docs = documents(["long " * 2000 + passage + " tail", "long " * 2000 + " ".join(passage.split()[:20]), passage, None])
    items = bench(spark, [(1, passage)])
    for remove, rest in (("documents", {}), ("spans", {2: ""})):
        got = {r.doc_id: r.text for r in suffix_automaton.decontaminate(docs, items, remove=remove, longest=30).collect()}
        assert got == {0: "long " * 2000 + "tail", 1: docs.collect()[1].text, 3: None} | rest
