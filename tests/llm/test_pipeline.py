import base64

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from skysift.llm import pii_votes
from test_host_rules import plain as measured
from test_pii_votes import plain as private
from test_near_copies import plain_components
from test_suffix_automaton import plain as hit

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(name, rows in, rows out) of every stage, over documents with some odd rows added."""
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, "en", "src0", 0), (70_000, "", None, None, 0), (1, raw.filter("doc_id = 1").first().text, "en", "src1", 1)], raw.schema)
    docs, out = raw.unionByName(odd), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(path)
        new = spark.read.parquet(path)
        assert new.columns[:5] == raw.columns and (name == "byte_level_bpe" or new.schema == raw.schema)
        out.append((name, docs.collect(), new.collect()))
        docs = new
    return {name: (before, after) for name, before, after in out}


def test_quality(stages):
    before, after = stages["quality_rules"]
    ok = [r for r in before if (m := measured(r.text))[0] >= 50 and 100 * m[4] <= 50 * m[0]]
    assert sorted(map(tuple, ok)) == sorted(map(tuple, after))  # no host of this table is notorious


def test_dedup(stages):
    before, after = stages["near_dedup"]
    component = plain_components(list({r.doc_id: (r.doc_id, r.text) for r in before}.values()))
    assert sorted(r.doc_id for r in after) == sorted(set(component.values()))


def test_dedup_takes_the_trees_pairs(spark, monkeypatch):
    """Pairs of SimHash fingerprints are checked and linked, also where no band proposes them."""
    from pyspark.sql import functions as F

    from skysift.llm import near_copies, simhash_tree

    words = [f"w{i}" for i in range(400)]
    # The second shares all but one word with the first; the third is another text.
    texts = [" ".join(words), " ".join([*words[:-1], "x"]), " ".join(reversed(words))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    pairs = simhash_tree.candidate_pairs(docs)
    assert pairs.count() == 1
    monkeypatch.setattr(near_copies, "_met", lambda bands: bands.select(F.lit(0).cast("bigint").alias("band"), "body", F.lit(2).cast("bigint").alias("n")).limit(0))
    assert len({r.root for r in near_copies.near_copies(docs).collect()}) == 3
    assert len({r.root for r in near_copies.near_copies(docs, pairs=pairs).collect()}) == 2
    kept = corpus_pipeline.near_dedup(spark, docs, SF).collect()
    assert sorted(r.doc_id for r in kept) == [0, 2]


def test_decontamination(stages, spark):
    before, after = stages["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = [i for i, n, h, _ in hit([(r.doc_id, r.text) for r in before], items) if not (h and 20 * h >= n)]
    assert sorted(clean) == sorted(r.doc_id for r in after) and len(after) < len(before)
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}


def test_pii(stages):
    before, after = stages["pii"]
    texts = {r.doc_id: r for r in after}
    assert len(texts) == len(before)
    for r in before:
        new = texts[r.doc_id]
        assert new.n_chars == len(new.text)
        spans = private(r.text)
        assert all(r.text[a:b] not in new.text for _, a, b in spans)
        if not pii_votes.scan(r.text)[1] and not spans:
            assert new.text == r.text


def test_bpe(stages):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in stages["byte_level_bpe"][1]:
        assert r.token_ids == own.encode_ordinary(r.text) and r.n_tokens == len(r.token_ids) and r.round_trip


def test_run(spark, stages):
    got = {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()}
    assert got == {r.doc_id for r in stages["byte_level_bpe"][1]}


def test_deduplicate_odd_rows(documents):
    from skysift.llm import simhash_tree

    rows = [(None, "a b c d"), (None, "other"), (None, "other"), (5, "a b c d"), (5, "a b c d"), (9, "A B C D"), (7, None), (8, ""), (5, "else entirely")]
    got = simhash_tree.deduplicate(documents(rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(5, "a b c d"), (None, "other"), (7, None), (5, "else entirely")], key=str)


NAMES = ("_key", "_tag", "key", "tag", "spans", "items", "n_words", "n_hit", "token_ids", "n_tokens", "decoded", "_text", "_0", "doc", "a.b", "sp ace")


def test_clashing_names(spark):
    """Extra columns called like an operator's own come through every stage unchanged."""
    from pyspark.sql import functions as F

    raw = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    docs = raw.select("*", *[(F.col("doc_id") * 10 + k).alias(n) for k, n in enumerate(NAMES)])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        back = [n + "_" if name == "byte_level_bpe" and n in ("token_ids", "n_tokens") else n for n in NAMES]
        assert name == "byte_level_bpe" or out.columns == docs.columns
        rows = out.select("doc_id", *[F.col(f"`{n}`") for n in back]).collect()
        assert rows and all(tuple(r)[1:] == tuple(r.doc_id * 10 + k for k in range(len(NAMES))) for r in rows), name


def test_clashing_carry(spark):
    from skysift.llm import bpe_tree, longest_match, suffix_automaton

    docs = spark.createDataFrame([(1, "mail a@b.cd", 5, 6, 7, 8)], "doc_id int, text string, spans int, n_words int, token_ids int, `a.b` int")
    carry = [c for c in docs.columns if c != "text"]
    bench = spark.createDataFrame([(3, "mail a b")], "item_id bigint, text string")
    for found, own in ((pii_votes.find(docs, carry), "spans"), (longest_match.token_counts(docs, carry), "n_words"), (bpe_tree.decode(bpe_tree.encode(docs, carry), ["spans"]), "token_ids"),
                       (suffix_automaton.hits(docs, bench, carry), "items")):
        row = found.first().asDict()
        assert row[own] is not None and 5 in (row.get("spans"), row.get("spans_"))
